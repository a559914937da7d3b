"""Queries of the tokenizer operators over the driver's tables.

The corpus is documents.text; its specials are those of both presets. Training queries stop after
a few merges, which is a parameter of the feature and no cut of the rows.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.bytetext import byte_alphabet, format_bytes_column, to_word, token_char
from lexloom.functions.pretok import by_regex, digits, parse_spec
from lexloom.functions.specials import PRESETS, SpecialTokens, segments
from lexloom.operators import chunks, compare, encode, evaluate, export, merges, ordered, validate
from lexloom.session import discard, file_system, materialize, shared_dir, spread, table
from lexloom.sources import text as sources

MERGES = 12
TOP = 20
MOST_CHARS = 200_000
WORDS = r"[A-Za-z]+|[0-9]+"
BUDGET = 200_000
CORPUS_SCALE = 100_000  # the jobs' targets are for a corpus of 180 GB
SPECIALS = SpecialTokens(dict.fromkeys(PRESETS["code"] + PRESETS["chat"]))
GPT4, GPT4_DIGITS = parse_spec("gpt4").build, parse_spec("gpt4+digits").build
SANITY = ["while left < right:", "let total = 0;", "SELECT name FROM shelf", "        yield node"]  # short samples to look at
MANY_MERGES = 64
WHITESPACE = validate.WHITESPACE


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that splitting and encoding need, over all cores where the table is small."""
    return spread(docs(spark, sf_dir).select("doc_id", "text"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_counts(texts(spark, sf_dir), "text", GPT4, SPECIALS)


def trained(spark: SparkSession, sf_dir: str, n: int = MERGES) -> list[merges.Merge]:
    return merges.train(counts(spark, sf_dir), 256 + n)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(texts(spark, sf_dir), "doc_id", "text", trained(spark, sf_dir), GPT4, SPECIALS)


def pair_ids(df: DataFrame) -> DataFrame:
    left, right = merges.ids_of(F.col("pair"))
    return df.withColumn("left_id", left).withColumn("right_id", right).drop("pair")


# sources, filters, projections


def scan_documents(spark, d):
    return docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_points"), F.md5("text").alias("digest"))


def scan_parquet_prune(spark, d):
    return sources.from_parquet(spark, f"{d}/code_files.parquet", "content", ["lang"]).groupBy("lang").agg(F.count("content").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


def scan_lines(spark, d):
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}.txt"
    fs, at = file_system(spark, path)
    out = fs.create(at)
    out.write(bytearray(b"one\r\ntwo\rstill two\n\nbad \xff byte\nlast without end"))
    out.close()
    fs.deleteOnExit(at)
    return sources.from_lines(spark, [path, f"{path}.missing"])


def html_doc_split(spark, d):
    parts = sources.html_documents(docs(spark, d), "doc_id", "text")
    return parts.select("doc_id", F.octet_length("html").cast("long").alias("n_bytes"), F.md5("html").alias("digest"))


def category_concat(spark, d):
    laid = sources.category_layout(docs(spark, d).select("category", "doc_id", "text"), "category", "doc_id", "text")
    return laid.select("category", "doc_id", F.col("begins").alias("begins"))


def min_bytes_filter(spark, d):
    return sources.corpus(docs(spark, d), "text").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


def seed_filter(spark, d):
    return sources.corpus(table(spark, d, "cosmopedia_v2"), "text", sources.seed_condition("!= auto_math_text", F.col("seed_data"))).select("row_id", "seed_data")


def byte_budget(spark, d):
    rows = sources.corpus(docs(spark, d), "text").select("doc_id", "text")
    return sources.budgeted(rows, "text", [F.col("doc_id")], BUDGET, key=["doc_id"]).select("doc_id", "written")


def corpus_jobs(spark, d) -> list[sources.Job]:
    """The jobs of the table jobs, their byte targets scaled down to these tables."""
    latest = W.partitionBy("job").orderBy(F.col("updated_at").desc_nulls_last(), F.col("target_bytes").desc_nulls_last())
    held = table(spark, d, "jobs").where("job is not null").withColumn("_n", F.row_number().over(latest)).where("_n = 1 and target_bytes > 0 and source is not null").orderBy("job").collect()
    tables = {"content": ("code_files", "file_id", "content"), "text": ("cosmopedia_v2", "row_id", "text")}
    out = []
    for j in held:
        name, key, text = ("fineweb_edu_dedup", "row_id", "text") if "fineweb" in j["source"].lower() else tables[j["text_column"]]
        out.append(sources.Job(j["job"], table(spark, d, name), key, text, j["target_bytes"] // CORPUS_SCALE, j["source"], j["seed_filter"]))
    return out


def build_corpus(spark, d):
    """Each job's rows in the corpus, with where they begin in the job's output."""
    built = sources.build_corpus(corpus_jobs(spark, d))
    return built.select("job", "key", "written", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest"))


def corpus_sizes(spark, d):
    """The corpus written and read back: rows and bytes per job."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return sources.write_corpus(sources.build_corpus(corpus_jobs(spark, d)), path)


def shard_shuffle(spark, d):
    rows = docs(spark, d).select("doc_id")
    return ordered.row_numbers(rows, sources.shuffled_order("doc_id"), "place").select("doc_id", "place")


def separator_join(spark, d):
    rows = sources.separated(docs(spark, d).where("text is not null"), "text")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest"))


def truncate_chars(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.substring("text", 1, MOST_CHARS)).alias("digest"))


# splitting


def special_split(spark, d):
    return texts(spark, d).select("doc_id", F.posexplode(segments(F.col("text"), SPECIALS)).alias("seg_pos", "s")).select("doc_id", "seg_pos", F.col("s.special").alias("special"), F.col("s.seg").alias("seg"))


def _split(pretok):
    return lambda spark, d: texts(spark, d).select("doc_id", F.posexplode(chunks.text_chunks(F.col("text"), pretok)).alias("pos", "chunk"))


# counting


def chunk_counts(spark, d):
    return counts(spark, d)


def chunk_counts_words(spark, d):
    return chunks.chunk_counts(texts(spark, d), "text", by_regex(WORDS))


def ingest_stats(spark, d):
    return chunks.ingest_stats(texts(spark, d), "text", GPT4, SPECIALS)


def unique_chunks(spark, d):
    return counts(spark, d).agg(F.count("*").alias("unique_chunks"))


def min_frequency_filter(spark, d):
    return chunks.at_least(counts(spark, d), 2)


def canonical_sort(spark, d):
    return ordered.row_numbers(counts(spark, d), chunks.canonical_order()).select("rank", "chunk", "cnt")


def stored_merge_counts(spark, d):
    """The aggregate artifacts of agg_chunks as one: counts of equal chunks add up."""
    rows = table(spark, d, "agg_chunks").where("chunk is not null and cnt > 0").select(F.decode("chunk", "UTF-8").alias("chunk"), "cnt")
    return chunks.merge_counts(rows)


def agg_roundtrip(spark, d):
    c = materialize(counts(spark, d))
    path = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    stats = {"total_bytes": 0, "total_sequences": 0, "total_chunks": c.agg(F.sum("cnt")).first()[0] or 0}
    chunks.write_artifact(c, path, "gpt4", parse_spec("gpt4").pattern, SPECIALS, stats)
    discard(c)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return chunks.read_artifact(spark, path)[0]


def stream_counts(spark, d):
    from lexloom.streaming.chunk_stream import count_stream, running_counts

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    fs, at = file_system(spark, base)
    fs.deleteOnExit(at)
    docs(spark, d).select("doc_id", "text").repartition(3, "doc_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    count_stream(stream, "text", GPT4, f"{base}/out", f"{base}/state", SPECIALS).awaitTermination()
    return running_counts(spark, f"{base}/out")


# merging


def pair_counts(spark, d):
    return pair_ids(merges.pair_counts(merges.words(counts(spark, d))))


def pair_index(spark, d):
    return pair_ids(merges.pair_index(merges.words(counts(spark, d))))


def top_pairs(spark, d):
    return pair_ids(merges.top_pairs(merges.words(counts(spark, d)), TOP))


def merge_step(spark, d):
    """Words after the first merge: their number of tokens."""
    first = trained(spark, d, 1)[0]
    new = [(token_char(first.left_id) + token_char(first.right_id), token_char(first.new_id))]
    return counts(spark, d).select("chunk", F.length(merges.apply_merges(to_word(F.col("chunk")), new)).cast("long").alias("n_tokens"))


def bpe_train(spark, d):
    """By DataFrame rounds, whatever the number of words."""
    found = merges.train(counts(spark, d), 256 + MERGES, merge_mode="scan")
    return merges.merge_table(spark, found)


def bpe_train_many(spark, d):
    """By rounds to a larger vocabulary."""
    return merges.merge_table(spark, merges.train(counts(spark, d), 256 + MANY_MERGES, merge_mode="scan"))


def train_full(spark, d):
    return merges.merge_table(spark, merges.train(counts(spark, d), 256 + MERGES, merge_mode="full"))


def top_merges(spark, d):
    names = merges.token_bytes(found := trained(spark, d))
    return spark.createDataFrame([(m.rank, names[m.new_id].hex().upper()) for m in found], "rank int, token_hex string").where(F.col("rank") < TOP)


def vocab_sweep(spark, d):
    """One training serves every smaller vocabulary: merges and chunks' tokens by size."""
    found = trained(spark, d)
    c = materialize(counts(spark, d))
    parts = []
    for n in (4, 8, MERGES):
        steps = [(token_char(m.left_id) + token_char(m.right_id), token_char(m.new_id)) for m in found[:n]]
        parts.append(c.agg(F.lit(256 + n).alias("vocab_size"), F.sum(F.length(merges.apply_merges(to_word(F.col("chunk")), steps)) * F.col("cnt")).cast("long").alias("n_tokens")))
    return reduce(DataFrame.unionByName, parts)


# vocabulary


def special_ids(spark, d):
    return spark.createDataFrame(list(SPECIALS.ids(256 + MERGES).items()), "token string, id int")


def byte_alphabet_query(spark, d):
    return spark.createDataFrame(list(enumerate(byte_alphabet())), "byte int, letter string")


def mergeable_ranks(spark, d):
    return export.rank_table(spark, trained(spark, d)).select("id", F.hex("token").alias("token_hex"))


def tiktoken_lines(spark, d):
    return export.rank_lines(export.rank_table(spark, trained(spark, d)))


# encoding


def encode_tokens(spark, d):
    return encode.tokens(encoded(spark, d), "doc_id")


def decode_roundtrip(spark, d):
    found = trained(spark, d)
    ids = encode.encode(texts(spark, d), "doc_id", "text", found, GPT4, SPECIALS)
    return encode.decode(ids, "doc_id", "ids", found, SPECIALS).select("doc_id", F.md5("text").alias("digest"))


def roundtrip_report(spark, d):
    found = trained(spark, d)
    ids = materialize(encode.encode(texts(spark, d), "doc_id", "text", found, GPT4, SPECIALS))
    back = encode.decode(ids, "doc_id", "ids", found, SPECIALS).withColumnRenamed("text", "back")
    both = docs(spark, d).select("doc_id", "text").where("text is not null").join(back, "doc_id").join(ids.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id")
    return evaluate.round_trip(both)


def round_trip_failures(spark, d):
    """First difference of each text that is changed by one known fault: its first carriage return is lost."""
    rows = docs(spark, d).where("text is not null").select("doc_id", "text", F.regexp_replace("text", "(?s)^([^\r]*)\r(.*)$", "$1$2").alias("back"))
    return evaluate.failures(rows, "doc_id")


def _single(spark, d, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "pattern int, text string")
    ids = encode.encode(rows, "pattern", "text", trained(spark, d), GPT4, SPECIALS)
    return ids.select("pattern", F.size("ids").cast("long").alias("n_tokens"), (F.size("ids") == 1).alias("single"))


def whitespace_coverage(spark, d):
    return _single(spark, d, WHITESPACE)


def sanity_encodes(spark, d):
    return _single(spark, d, SANITY)


def report_order(spark, d):
    """Place of each tokenizer in the report, bytes alone counted as one's own."""
    rows = evaluate.macro(per_category(spark, d)).withColumn("own", F.col("tokenizer") == "bytes")
    return ordered.row_numbers(rows, evaluate.report_order(F.col("own")), "place").select("place", "tokenizer")


def special_atomicity(spark, d):
    return _single(spark, d, SPECIALS.tokens)


def vocab_composition(spark, d):
    """How often each token is used in the corpus, and how many bytes it stands for."""
    found = trained(spark, d)
    ids = encode.encode(texts(spark, d), "doc_id", "text", found, GPT4, SPECIALS)
    used = ids.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("uses"))
    names = [(i, len(b)) for i, b in enumerate(merges.token_bytes(found))] + [(i, len(t.encode())) for t, i in SPECIALS.ids(256 + len(found)).items()]
    return used.join(F.broadcast(spark.createDataFrame(names, "token_id int, n_bytes int")), "token_id")


# evaluation: two tokenizers, bytes alone and bytes with merges


def comparison(spark, d) -> DataFrame:
    """``tokenizer, category, n_chars, n_tokens`` of both tokenizers."""
    # one pass gives both: a text's bytes are its tokens before any merge
    ids = encoded(spark, d).select("doc_id", F.size("ids").cast("long").alias("merged"))
    text = docs(spark, d).where("text is not null")
    segs = F.aggregate(segments(F.col("text"), SPECIALS), F.lit(0).cast("long"), lambda a, s: a + F.when(s["special"], F.lit(1)).otherwise(F.octet_length(s["seg"])).cast("long"))
    rows = text.select("doc_id", "category", F.length("text").cast("long").alias("n_chars"), segs.alias("bytes")).join(ids, "doc_id")
    return rows.select("category", "n_chars", F.explode(F.array(F.struct(F.lit("bytes").alias("tokenizer"), F.col("bytes").alias("n_tokens")), F.struct(F.lit("merged").alias("tokenizer"), F.col("merged").alias("n_tokens")))).alias("t")).select("t.tokenizer", "category", "n_chars", "t.n_tokens")


def per_category(spark, d) -> DataFrame:
    return evaluate.by_category(comparison(spark, d), "tokenizer", "category")


def tokens_by_category(spark, d):
    return evaluate.with_totals(comparison(spark, d))


def chars_per_token(spark, d):
    return per_category(spark, d).withColumn("chars_per_token", F.round("chars_per_token", 6))


def macro_geomean(spark, d):
    return evaluate.macro(per_category(spark, d)).withColumn("macro_chars_per_token", F.round("macro_chars_per_token", 6))


def best_per_category(spark, d):
    return evaluate.best(per_category(spark, d)).withColumn("best_chars_per_token", F.round("best_chars_per_token", 6))


def rank_per_category(spark, d):
    return evaluate.ranked(per_category(spark, d)).select("category", "tokenizer", "place")


def compare_tokenizers(spark, d):
    """Public tokenizers on the corpus; their folder is LEXLOOM_TOKENIZERS, and all their files must be there."""
    folder = os.environ.get("LEXLOOM_TOKENIZERS", "/opt/tokenizers")
    gpt2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    known = {"byte_bpe_50k": compare.Loader("ranks", f"{folder}/byte_bpe_50k.tiktoken", gpt2), "word_bpe_49k": compare.Loader("hf", f"{folder}/word_bpe_49k.json"), "piece_bpe_32k": compare.Loader("piece", f"{folder}/piece_bpe_32k.model")}
    if missing := [x.path for x in known.values() if not os.path.exists(x.path)]:
        raise FileNotFoundError(f"tokenizer files are missing: {', '.join(missing)}")
    rows = spread(docs(spark, d).select("category", "text"))
    return compare.compare(rows, "category", "text", known).drop("encode_seconds").withColumn("chars_per_tok", F.round("chars_per_tok", 6))


def validate_report(spark, d):
    """A trained tokenizer, written as its file and loaded by another implementation, on the documents."""
    content = json.dumps(export.tokenizer_json(trained(spark, d), parse_spec("gpt4").pattern, SPECIALS, False), ensure_ascii=False)
    got = validate.report(texts(spark, d), "text", content)
    return spark.createDataFrame([(got["texts"], got["passed"], got["n_bytes"], got["n_tokens"], sum(n == 1 for n in got["specials"].values()))], "texts long, passed long, n_bytes long, n_tokens long, whole_specials long")


def validate_scan(spark, d):
    return docs(spark, d).where("text is not null").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


def format_bytes(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", format_bytes_column(F.octet_length("text").cast("long")).alias("size"))


QUERIES = {
    "scan_documents": scan_documents, "scan_parquet_prune": scan_parquet_prune, "scan_lines": scan_lines, "html_doc_split": html_doc_split, "category_concat": category_concat,
    "min_bytes_filter": min_bytes_filter, "seed_filter": seed_filter, "byte_budget": byte_budget, "build_corpus": build_corpus, "corpus_sizes": corpus_sizes, "shard_shuffle": shard_shuffle, "separator_join": separator_join, "truncate_chars": truncate_chars,
    "special_split": special_split, "pretok_regex": _split(by_regex(WORDS)), "pretok_gpt4": _split(GPT4), "pretok_digits": _split(digits), "pretok_gpt4_digits": _split(GPT4_DIGITS),
    "chunk_counts": chunk_counts, "chunk_counts_words": chunk_counts_words, "ingest_stats": ingest_stats, "unique_chunks": unique_chunks, "min_frequency_filter": min_frequency_filter, "canonical_sort": canonical_sort,
    "stored_merge_counts": stored_merge_counts, "agg_roundtrip": agg_roundtrip, "stream_counts": stream_counts,
    "pair_counts": pair_counts, "pair_index": pair_index, "top_pairs": top_pairs, "merge_step": merge_step, "bpe_train": bpe_train, "bpe_train_many": bpe_train_many, "train_full": train_full, "top_merges": top_merges, "vocab_sweep": vocab_sweep,
    "special_ids": special_ids, "byte_alphabet": byte_alphabet_query, "mergeable_ranks": mergeable_ranks, "tiktoken_lines": tiktoken_lines,
    "encode_tokens": encode_tokens, "decode_roundtrip": decode_roundtrip, "roundtrip_report": roundtrip_report, "round_trip_failures": round_trip_failures, "whitespace_coverage": whitespace_coverage, "sanity_encodes": sanity_encodes, "report_order": report_order, "special_atomicity": special_atomicity, "vocab_composition": vocab_composition,
    "tokens_by_category": tokens_by_category, "chars_per_token": chars_per_token, "macro_geomean": macro_geomean, "best_per_category": best_per_category, "rank_per_category": rank_per_category, "compare_tokenizers": compare_tokenizers,
    "validate_scan": validate_scan, "validate_report": validate_report, "format_bytes": format_bytes,
}
