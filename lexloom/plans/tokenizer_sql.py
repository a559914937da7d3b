"""The same results as plain SQL, for comparison with another engine.

Words here are strings of bracketed hex ids, a form of their own: ``<0074><0068>``. The default
pattern has possessive and lookahead parts that RE2 lacks; texts are marked in front of the last
blank of a run instead.
"""

from __future__ import annotations

import re

from lexloom.functions.specials import PRESETS
from lexloom.plans.tokenizer_queries import BUDGET, CORPUS_SCALE, MANY_MERGES, MERGES, MOST_CHARS, SANITY, SPECIALS, TOP, WHITESPACE, WORDS
from lexloom.sources.text import SEPARATOR

_BLANK_LINE = r"\x{0B}\x{0C} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\t"
_BLANK = _BLANK_LINE + r"\n\r"
_GPT4 = rf"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}\x{{E000}}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{_BLANK}\p{{L}}\p{{N}}\x{{E000}}]+[\r\n]*|[{_BLANK}]*[\r\n]|[{_BLANK}]+\x{{E000}}|[{_BLANK}]+"


def gpt4(text: str) -> str:
    marked = rf"regexp_replace({text}, '([{_BLANK}])([{_BLANK_LINE}][^{_BLANK}])', '\1' || chr(57344) || '\2', 'g')"
    return f"list_transform(regexp_extract_all({marked}, '{_GPT4}'), lambda c: replace(c, chr(57344), ''))"


def _quoted(tokens) -> str:
    return "|".join(re.sub(r"([|<>()\[\].*+?^$\\{}])", r"\\\1", t) for t in tokens)


_SPECIAL = _quoted(SPECIALS.longest_first())
_LIST = ", ".join("'" + t + "'" for t in SPECIALS.tokens)


def split(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace({text}, '({_SPECIAL})', chr(57345) || '\1' || chr(57345), 'g'), chr(57345)), lambda s: s <> '')"


def placed(alias: str, items: str, source: str, keep: str) -> str:
    """One row per list element with its place from 0."""
    return f"SELECT {keep}, unnest(range(0, len({alias}))) AS pos, unnest({alias}) AS item FROM (SELECT {keep}, {items} AS {alias} FROM {source})"


_SEGS = "segs AS (SELECT doc_id, CAST(pos AS INTEGER) AS seg_pos, item IN (" + _LIST + ") AS special, item AS seg FROM (" + placed("l", split("text"), "documents WHERE text IS NOT NULL", "doc_id") + "))"
_PARTS = "parts AS (SELECT doc_id, seg_pos, special, CAST(pos AS INTEGER) AS chunk_pos, item AS chunk FROM (" + placed("l", f"CASE WHEN special THEN [seg] ELSE {gpt4('seg')} END", "segs", "doc_id, seg_pos, special") + "))"
_COUNTS = "counts AS (SELECT chunk, CAST(count(*) AS BIGINT) AS cnt FROM parts WHERE NOT special GROUP BY chunk)"
_W0 = r"w0 AS (SELECT chunk, cnt, regexp_replace(hex(encode(chunk)), '(..)', '<00\1>', 'g') AS w FROM counts)"
BASE = f"WITH {_SEGS}, {_PARTS}, {_COUNTS}"
WORDS_BASE = f"{BASE}, {_W0}"


def _pairs(k: int) -> str:
    return f"SELECT unnest(list_transform(range(0, length(w) // 6 - 1), lambda i: substr(w, CAST(i * 6 + 1 AS BIGINT), 12))) AS p, chunk, cnt FROM w{k} WHERE length(w) >= 12"


def unrolled(n: int) -> str:
    """CTEs m1 .. mn (the merges) and w1 .. wn (the words after them)."""
    out = []
    for k in range(n):
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT p, CAST(sum(cnt) AS BIGINT) AS freq FROM ({_pairs(k)}) GROUP BY p ORDER BY freq DESC, p LIMIT 1)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT chunk, cnt, replace(w, (SELECT p FROM m{k + 1}), '<{256 + k:04X}>') AS w FROM w{k})")
    return f"{WORDS_BASE.replace('w0 AS (', 'w0 AS MATERIALIZED (')}, " + ", ".join(out)


def _id(text: str) -> str:
    return f"CAST(('0x' || {text}) AS INTEGER)"


def _train(n: int) -> str:
    every = " UNION ALL ".join(f"SELECT {k} AS rank, {256 + k} AS new_id, p, freq FROM m{k + 1}" for k in range(n))
    return f"{unrolled(n)} SELECT CAST(rank AS INTEGER) AS rank, CAST(new_id AS INTEGER) AS new_id, {_id('substr(p, 2, 4)')} AS left_id, {_id('substr(p, 8, 4)')} AS right_id, freq FROM ({every})"


TRAINED, _TRAIN = unrolled(MERGES), _train(MERGES)
# token bytes in hex: replace ids by their parts, the newest first
_EXPANDED = "'<' || lpad(hex(id), 4, '0') || '>'"
for _k in range(MERGES, 0, -1):
    _EXPANDED = f"replace({_EXPANDED}, '<{255 + _k:04X}>', (SELECT p FROM m{_k}))"
_RANKS = rf"ranks AS (SELECT CAST(id AS INTEGER) AS id, regexp_replace({_EXPANDED}, '<00(..)>', '\1', 'g') AS token_hex FROM (SELECT unnest(range(0, {256 + MERGES})) AS id))"
# ids follow the merges that were found, in the order of the presets, each string once
_SPECIAL_IDS = (
    f"SELECT token, CAST((SELECT count(*) FROM ({' UNION ALL '.join(f'SELECT p FROM m{k + 1}' for k in range(MERGES))})) + 255 + row_number() OVER (ORDER BY nth) AS INTEGER) AS id "
    f"FROM (SELECT token, min(nth) AS nth FROM (SELECT unnest([{', '.join(repr(t) for t in PRESETS['code'] + PRESETS['chat'])}]) AS token, unnest(range(0, {len(PRESETS["code"] + PRESETS["chat"])})) AS nth) GROUP BY token)"
)
_TOKENS = (
    f"special_ids AS ({_SPECIAL_IDS}), joined AS (SELECT doc_id, seg_pos, chunk_pos, CASE WHEN special THEN '<' || lpad(hex(s.id), 4, '0') || '>' ELSE w.w END AS w FROM parts p LEFT JOIN w{MERGES} w ON NOT p.special AND p.chunk = w.chunk LEFT JOIN special_ids s ON p.special AND p.chunk = s.token), "
    f"texts AS (SELECT doc_id, string_agg(w, '' ORDER BY seg_pos, chunk_pos) AS w FROM joined GROUP BY doc_id)"
)
_SIZES = f"{TRAINED}, {_TOKENS}, rows_ AS (SELECT d.doc_id, d.category, length(d.text) AS n_chars, coalesce(length(t.w) // 6, 0) AS merged, coalesce(b.n, 0) AS bytes FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, sum(CASE WHEN special THEN 1 ELSE octet_length(encode(seg)) END) AS n FROM segs GROUP BY doc_id) b ON d.doc_id = b.doc_id WHERE d.text IS NOT NULL), long_ AS (SELECT 'bytes' AS tokenizer, category, n_chars, bytes AS n_tokens FROM rows_ UNION ALL SELECT 'merged', category, n_chars, merged FROM rows_), cats AS (SELECT tokenizer, category, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CASE WHEN sum(n_tokens) > 0 THEN CAST(sum(n_chars) AS DOUBLE) / sum(n_tokens) ELSE 0.0 END AS cpt FROM long_ GROUP BY ALL)"


# what the ids of a text stand for, in hex, against the text's own bytes
_BACK = (
    "names AS (SELECT id, token_hex AS h FROM ranks UNION ALL SELECT id, hex(encode(token)) FROM special_ids), "
    f"back AS (SELECT d.doc_id, coalesce(string_agg(n.h, '' ORDER BY t.pos), '') = any_value(hex(encode(d.text))) AS same FROM documents d LEFT JOIN (SELECT doc_id, pos, {_id('substr(w, pos * 6 + 2, 4)')} AS id FROM (SELECT doc_id, w, unnest(range(0, length(w) // 6)) AS pos FROM texts)) t ON d.doc_id = t.doc_id LEFT JOIN names n ON t.id = n.id WHERE d.text IS NOT NULL GROUP BY d.doc_id)"
)


def _listed(texts) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS pattern, " + " || ".join(f"chr({ord(c)})" for c in t) + " AS text" for k, t in enumerate(texts))


# a text that is no chunk of the corpus is merged by its own words
_OWN = "regexp_replace(hex(encode(c)), '(..)', '<00\\1>', 'g')"
for _k in range(1, MERGES + 1):
    _OWN = f"replace({_OWN}, (SELECT p FROM m{_k}), '<{255 + _k:04X}>')"


def _coverage(texts) -> str:
    return f"{TRAINED}, own AS (SELECT pattern, unnest({gpt4('text')}) AS c FROM ({_listed(texts)})) SELECT CAST(pattern AS INTEGER) AS pattern, CAST(sum(length({_OWN}) // 6) AS BIGINT) AS n_tokens, sum(length({_OWN}) // 6) = 1 AS single FROM own GROUP BY pattern"


_LETTERS = "CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(CAST(b AS INTEGER)) ELSE chr(CAST(256 + row_number() OVER (PARTITION BY b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 ORDER BY b) - 1 AS INTEGER)) END"
_SEP = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in re.findall(r"[^\n]+|\n", SEPARATOR))
_BYTES = "octet_length(encode(text))"


def _text_split(expression: str) -> str:
    return f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, item AS chunk FROM ({placed('l', expression, 'documents WHERE text IS NOT NULL', 'doc_id')})"


_SHUFFLED = "md5('42|' || {0}), {0}"
_CORPUS = f"""WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY updated_at DESC NULLS LAST, target_bytes DESC NULLS LAST) AS n FROM jobs WHERE job IS NOT NULL) WHERE n = 1 AND target_bytes > 0 AND source IS NOT NULL),
rows_ AS (SELECT source, file_id AS key, content AS text, NULL AS seed FROM code_files UNION ALL SELECT source, row_id, text, seed_data FROM cosmopedia_v2 UNION ALL SELECT source, row_id, text, NULL FROM fineweb_edu_dedup),
own AS (SELECT DISTINCT ON (job, key) c.job, c.target_bytes // {CORPUS_SCALE} AS target, r.key, r.text FROM rows_ r JOIN cur c ON lower(trim(r.source)) = lower(trim(c.source))
  AND (c.seed_filter IS NULL OR (starts_with(c.seed_filter, '=') AND lower(trim(r.seed)) = lower(trim(substr(c.seed_filter, 2)))) OR (starts_with(c.seed_filter, '!=') AND lower(trim(r.seed)) IS DISTINCT FROM lower(trim(substr(c.seed_filter, 3)))))
  WHERE octet_length(encode(r.text)) >= 100 AND r.key IS NOT NULL),
placed AS (SELECT *, CAST(coalesce(sum(octet_length(encode(text)) + {len(SEPARATOR)}) OVER (PARTITION BY job ORDER BY {_SHUFFLED.format("key")} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS written FROM own),
corpus AS (SELECT job, key, written, CAST(octet_length(encode(text)) + {len(SEPARATOR)} AS BIGINT) AS n_bytes, md5(text || {_SEP}) AS digest FROM placed WHERE written < target)"""
_DIGITS = "regexp_extract_all({}, '(?s)[0-9]|[^0-9]+')"
SQL = {
    "scan_documents": f"SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n_bytes, length(text) AS n_points, md5(text) AS digest FROM documents",
    "scan_parquet_prune": "SELECT lang, count(content) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS n_bytes FROM code_files GROUP BY lang",
    "html_doc_split": f"SELECT doc_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, md5(html) AS digest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?i)(<!doctype)', chr(57345) || '\\1', 'g'), chr(57345))) AS html FROM documents) WHERE octet_length(encode(html)) >= 100",
    "category_concat": "SELECT category, doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY category ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM documents WHERE text IS NOT NULL AND category IS NOT NULL",
    "min_bytes_filter": f"SELECT doc_id, CAST({_BYTES} AS BIGINT) AS n_bytes FROM documents WHERE {_BYTES} >= 100",
    "seed_filter": f"SELECT row_id, seed_data FROM cosmopedia_v2 WHERE {_BYTES} >= 100 AND lower(trim(seed_data)) IS DISTINCT FROM 'auto_math_text'",
    "byte_budget": f"SELECT doc_id, written FROM (SELECT doc_id, CAST(coalesce(sum({_BYTES} + {len(SEPARATOR)}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS written FROM documents WHERE {_BYTES} >= 100) WHERE written < {BUDGET}",
    "build_corpus": f"{_CORPUS} SELECT * FROM corpus",
    "corpus_sizes": f"{_CORPUS} SELECT job, count(*) AS rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM corpus GROUP BY job",
    "shard_shuffle": f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {_SHUFFLED.format('doc_id')}) - 1 AS BIGINT) AS place FROM documents",
    "scan_lines": "SELECT * FROM (VALUES ('one'), ('two' || chr(13) || 'still two'), (''), ('last without end')) v(text)",
    "separator_join": f"SELECT doc_id, CAST(octet_length(encode(text || {_SEP})) AS BIGINT) AS n_bytes, md5(text || {_SEP}) AS digest FROM documents WHERE text IS NOT NULL",
    "truncate_chars": f"SELECT doc_id, md5(substr(text, 1, {MOST_CHARS})) AS digest FROM documents",
    "special_split": f"WITH {_SEGS} SELECT * FROM segs",
    "pretok_regex": _text_split(f"regexp_extract_all(text, '{WORDS}')"),
    "pretok_gpt4": _text_split(gpt4("text")),
    "pretok_digits": _text_split(_DIGITS.format("text")),
    "pretok_gpt4_digits": _text_split(f"flatten(list_transform({gpt4('text')}, lambda x: {_DIGITS.format('x')}))"),
    "chunk_counts": f"{BASE} SELECT * FROM counts",
    "chunk_counts_words": f"SELECT chunk, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS chunk FROM documents) GROUP BY chunk",
    "ingest_stats": f"{BASE} SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS total_sequences, (SELECT CAST(sum({_BYTES}) AS BIGINT) FROM documents) AS total_bytes, (SELECT CAST(sum(cnt) AS BIGINT) FROM counts) AS total_chunks",
    "unique_chunks": f"{BASE} SELECT count(*) AS unique_chunks FROM counts",
    "min_frequency_filter": f"{BASE} SELECT * FROM counts WHERE cnt >= 2",
    "canonical_sort": f"{BASE} SELECT CAST(row_number() OVER (ORDER BY cnt DESC, encode(chunk)) - 1 AS BIGINT) AS rank, chunk, cnt FROM counts",
    "stored_merge_counts": "SELECT decode(chunk) AS chunk, CAST(sum(cnt) AS BIGINT) AS cnt FROM agg_chunks WHERE chunk IS NOT NULL AND cnt > 0 GROUP BY chunk",
    "agg_roundtrip": f"{BASE} SELECT * FROM counts",
    "stream_counts": f"{BASE} SELECT * FROM counts",
    "pair_counts": f"{WORDS_BASE} SELECT {_id('substr(p, 2, 4)')} AS left_id, {_id('substr(p, 8, 4)')} AS right_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({_pairs(0)}) GROUP BY p",
    "pair_index": f"{WORDS_BASE} SELECT {_id('substr(p, 2, 4)')} AS left_id, {_id('substr(p, 8, 4)')} AS right_id, count(DISTINCT chunk) AS n_words FROM ({_pairs(0)}) GROUP BY p",
    "top_pairs": f"{WORDS_BASE} SELECT {_id('substr(p, 2, 4)')} AS left_id, {_id('substr(p, 8, 4)')} AS right_id, cnt FROM (SELECT p, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({_pairs(0)}) GROUP BY p ORDER BY cnt DESC, p LIMIT {TOP})",
    "merge_step": f"{unrolled(1)} SELECT chunk, CAST(length(w) // 6 AS BIGINT) AS n_tokens FROM w1",
    "bpe_train": _TRAIN,
    "bpe_train_many": _train(MANY_MERGES),
    "train_full": _TRAIN,
    "top_merges": f"{TRAINED}, {_RANKS} SELECT CAST(id - 256 AS INTEGER) AS rank, token_hex FROM ranks WHERE id BETWEEN 256 AND {255 + TOP}",
    "vocab_sweep": f"{TRAINED} " + " UNION ALL ".join(f"SELECT CAST({256 + n} AS INTEGER) AS vocab_size, CAST(sum(length(w) // 6 * cnt) AS BIGINT) AS n_tokens FROM w{n}" for n in (4, 8, MERGES)),
    "special_ids": f"{TRAINED} SELECT token, id FROM ({_SPECIAL_IDS})",
    "byte_alphabet": f"SELECT CAST(b AS INTEGER) AS byte, {_LETTERS} AS letter FROM (SELECT unnest(range(0, 256)) AS b)",
    "mergeable_ranks": f"{TRAINED}, {_RANKS} SELECT id, token_hex FROM ranks",
    "tiktoken_lines": f"{TRAINED}, {_RANKS} SELECT id, to_base64(unhex(token_hex)) || ' ' || id AS line FROM ranks",
    "encode_tokens": f"{TRAINED}, {_TOKENS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_id('substr(w, pos * 6 + 2, 4)')} AS token_id FROM (SELECT doc_id, w, unnest(range(0, length(w) // 6)) AS pos FROM texts)",
    "decode_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "roundtrip_report": f"{_SIZES}, {_RANKS}, {_BACK} SELECT count(*) AS texts, count(*) FILTER (WHERE same) AS passed, round(CAST(sum(n_chars) FILTER (WHERE same) AS DOUBLE) / sum(merged) FILTER (WHERE same), 6) AS chars_per_token FROM rows_ JOIN back USING (doc_id)",
    "round_trip_failures": "SELECT doc_id, CAST(strpos(text, chr(13)) - 1 + CASE WHEN substr(text, strpos(text, chr(13)) + 1, 1) = chr(13) THEN length(regexp_extract(substr(text, strpos(text, chr(13))), '^\r+')) - 1 ELSE 0 END AS INTEGER) AS first_difference FROM documents WHERE contains(text, chr(13))",
    "whitespace_coverage": _coverage(WHITESPACE),
    "sanity_encodes": _coverage(SANITY),
    "report_order": f"{_SIZES}, macro AS (SELECT tokenizer, exp(avg(ln(cpt))) AS m FROM cats WHERE cpt > 0 GROUP BY tokenizer) SELECT CAST(row_number() OVER (ORDER BY tokenizer = 'bytes' DESC, m DESC, tokenizer) - 1 AS BIGINT) AS place, tokenizer FROM macro",
    "special_atomicity": f"SELECT CAST(pattern AS INTEGER) AS pattern, sum(CASE WHEN item IN ({_LIST}) THEN 1 ELSE octet_length(encode(item)) END)::BIGINT AS n_tokens, sum(CASE WHEN item IN ({_LIST}) THEN 1 ELSE octet_length(encode(item)) END) = 1 AS single FROM (SELECT pattern, unnest({split('text')}) AS item FROM ({_listed(SPECIALS.tokens)})) GROUP BY pattern",
    "vocab_composition": f"{TRAINED}, {_RANKS}, {_TOKENS}, names AS (SELECT id, length(token_hex) // 2 AS n FROM ranks UNION ALL SELECT id, octet_length(encode(token)) FROM special_ids) SELECT token_id, CAST(count(*) AS BIGINT) AS uses, CAST(any_value(n) AS INTEGER) AS n_bytes FROM (SELECT {_id('substr(w, pos * 6 + 2, 4)')} AS token_id FROM (SELECT w, unnest(range(0, length(w) // 6)) AS pos FROM texts)) t JOIN names ON token_id = names.id GROUP BY token_id",
    "tokens_by_category": f"{_SIZES} SELECT tokenizer, category, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM long_ GROUP BY tokenizer, category UNION ALL SELECT tokenizer, NULL, CAST(sum(n_tokens) AS BIGINT) FROM long_ GROUP BY tokenizer",
    "chars_per_token": f"{_SIZES} SELECT tokenizer, category, n_chars, n_tokens, round(cpt, 6) AS chars_per_token FROM cats",
    "macro_geomean": f"{_SIZES} SELECT tokenizer, round(exp(avg(ln(cpt))), 6) AS macro_chars_per_token, CAST(sum(n_tokens) AS BIGINT) AS total_tokens FROM cats WHERE cpt > 0 GROUP BY tokenizer",
    "best_per_category": f"{_SIZES} SELECT category, round(max(cpt), 6) AS best_chars_per_token, min(n_tokens) AS fewest_tokens FROM cats GROUP BY category",
    "rank_per_category": f"{_SIZES} SELECT category, tokenizer, CAST(row_number() OVER (PARTITION BY category ORDER BY cpt DESC, tokenizer) AS INTEGER) AS place FROM cats",
    "validate_scan": f"SELECT count(*) AS texts, CAST(sum({_BYTES}) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL",
    "validate_report": f"{_SIZES} SELECT (SELECT count(*) FROM rows_) AS texts, (SELECT count(*) FROM rows_) AS passed, (SELECT CAST(sum({_BYTES}) AS BIGINT) FROM documents) AS n_bytes, (SELECT CAST(sum(merged) AS BIGINT) FROM rows_) AS n_tokens, (SELECT count(*) FROM special_ids) AS whole_specials",
    "format_bytes": f"SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE n || ' B' END AS size FROM (SELECT doc_id, {_BYTES} AS n FROM documents WHERE text IS NOT NULL)",
}
