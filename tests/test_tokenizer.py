import base64
import json
import random

import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Loaded

from lexloom import cli
from lexloom.functions.specials import SpecialTokens
from lexloom.memory import MemoryMonitor
from lexloom.operators import chunks, compare, encode, evaluate, export, ordered
from lexloom.operators.merges import Merge
from lexloom.sources import text as sources
from lexloom.tokenizer import Tokenizer

CORPUS = ["Hello world, hello there!", "def add(a, b):\n    return a + b", "In 2025 we counted 1234 things.", "hello hello hello\r\n\tworld", "naïve café 文字 🙂"] * 20
SPECIAL = ["<|endoftext|>", "<|end|>"]


@pytest.fixture(scope="module")
def tok(spark):
    t = Tokenizer(spark)
    t.train_from_iterator(CORPUS, 340, special_tokens=SPECIAL)
    return t


def test_untrained(spark):
    t = Tokenizer(spark)
    assert t.vocab_size == 256 and t.encode("hé") == [104, 195, 169] and t.decode([104, 195, 169]) == "hé" and t.encode("") == []


def test_encode_as_tiktoken(tok):
    e = tiktoken.Encoding("own", pat_str=tok.get_pattern(), mergeable_ranks=dict(tok.get_mergeable_ranks()), special_tokens=tok.specials.ids(tok.vocab_size))
    texts = CORPUS[:5] + ["", "a<|endoftext|>b<|end|>", "<|endof", "x" * 500, "hello" * 200, "unseen Wörter\n\n  x"]
    assert tok.batch_encode(texts) == [e.encode(t, allowed_special="all") for t in texts]
    assert [tok.decode(i, with_specials=True) for i in tok.batch_encode(texts)] == texts


def test_decode_is_strict(tok):
    with pytest.raises(ValueError):
        tok.decode([tok.vocab_size])
    with pytest.raises(ValueError):
        tok.decode([99_999])
    with pytest.raises(UnicodeDecodeError):
        tok.decode([195])


def test_decode_tables(spark, tok):
    rows = [(1, tok.encode("héllo")), (2, None), (3, []), (4, tok.encode("文字"))]
    df = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    assert {r["k"]: r["text"] for r in tok.decode_dataframe(df, "k", "ids").collect()} == {1: "héllo", 2: None, 3: "", 4: "文字"}
    for bad in ([99_999], [-1], [195], [None]):
        with pytest.raises(Exception, match="Unknown token id|UTF"):
            tok.decode_dataframe(spark.createDataFrame([(1, bad)], "k int, ids array<int>"), "k", "ids").collect()
    halves = spark.createDataFrame([(1, [195]), (2, [169])], "k int, ids array<int>").coalesce(1)
    with pytest.raises(Exception, match="UTF"):
        tok.decode_dataframe(halves, "k", "ids").collect()


def test_long_chunks_as_short_ones():
    rng = random.Random(3)
    e = encode.ChunkEncoder([Merge(k, 256 + k, *p, 1) for k, p in enumerate([(97, 97), (98, 97), (256, 256), (257, 98), (97, 98), (258, 97)])])
    for _ in range(300):
        ids = rng.choices([97, 98], k=rng.randint(1, 60))
        assert e.merge_long(list(ids)) == e.merge(bytes(ids))


def test_two_phases_equal_one(spark, tok, tmp_path):
    path = str(tmp_path / "agg")
    stats = Tokenizer(spark).aggregate(CORPUS, path, special_tokens=SPECIAL)
    assert stats["total_sequences"] == 100 and stats["total_bytes"] == sum(len(t.encode()) for t in CORPUS)
    t = Tokenizer(spark)
    t.train_from_aggregate(path, 340)
    assert t.merges == tok.merges and t.get_special_tokens() == SPECIAL
    t.train_from_aggregate(path, 280)
    assert t.merges == tok.merges[:24] == tok.truncated(280).merges
    rows = spark.read.parquet(f"{path}/chunks").count()
    assert rows == stats["unique_chunks"]
    with pytest.raises(chunks.ArtifactError):
        chunks.read_artifact(spark, str(tmp_path / "none"))
    spark.createDataFrame([(chunks.MAGIC, 99)], "magic string, version int").write.parquet(str(tmp_path / "old/meta"))
    with pytest.raises(chunks.ArtifactError, match="version"):
        chunks.read_artifact(spark, str(tmp_path / "old"))
    spark.createDataFrame([("x", 1)], "a string, version int").write.parquet(str(tmp_path / "other/meta"))
    with pytest.raises(chunks.ArtifactError):
        chunks.read_artifact(spark, str(tmp_path / "other"))


def test_training_arguments(spark, tok):
    t = Tokenizer(spark)
    t.train_from_iterator(["AAA BBB AAA BBB "] * 5, 300, pattern="[A-Z]+")
    assert t.encode("AAA bbb") == t.encode("AAA")
    t.train_from_iterator(["hello world "] * 100 + ["QXZ"], 300, min_frequency=10)
    assert not {m for m in t.merges if ord("Q") in (m.left_id, m.right_id)}
    t.train_from_iterator(CORPUS, 340, special_tokens=SPECIAL, merge_mode="scan", monitor_ram=True, ram_warn_at="64GB")
    assert t.merges == tok.merges and t.peak_rss_bytes > 0
    for bad in ({"pattern": "a", "pre_tokenizer": "gpt4"}, {"merge_mode": "x"}, {"pre_tokenizer": "x"}, {"ram_warn_at": "much"}):
        with pytest.raises(ValueError):
            t.train_from_iterator(["a"], 300, **bad)
    with pytest.raises(TypeError):
        t.train_from_iterator(["a", 1], 300)
    t.add_special_tokens(["<|new|>"])
    assert t.encode("<|new|>") == [t.vocab_size + 2]


def test_exports(spark, tok, tmp_path):
    t = Tokenizer(spark)
    t.train_from_iterator(CORPUS, 340, pre_tokenizer="gpt4+digits", special_tokens=SPECIAL)
    t.save_huggingface(str(tmp_path))
    loaded = Loaded.from_file(str(tmp_path / "tokenizer.json"))
    texts = CORPUS[:5] + ["a<|endoftext|>b", "year 1999"]
    assert [loaded.encode(x).ids for x in texts] == t.batch_encode(texts)
    data = json.loads((tmp_path / "tokenizer.json").read_text())
    assert [x["type"] for x in data["pre_tokenizer"]["pretokenizers"]] == ["Split", "Digits", "ByteLevel"] and data["added_tokens"][0]["id"] == t.vocab_size
    assert len(data["model"]["vocab"]) == t.vocab_size + 2 and json.loads((tmp_path / "tokenizer_config.json").read_text())["backend"] == "tokenizers"
    tok.save_huggingface(str(tmp_path / "b"), special_tokens=["<|only|>"], write_config=False)
    data = json.loads((tmp_path / "b/tokenizer.json").read_text())
    assert len(data["pre_tokenizer"]["pretokenizers"]) == 2 and [x["content"] for x in data["added_tokens"]] == ["<|only|>"] and not (tmp_path / "b/tokenizer_config.json").exists()
    t.save_tiktoken(str(tmp_path))
    lines = (tmp_path / "tiktoken.bpe").read_text().split("\n")
    assert [(base64.b64decode(a), int(b)) for a, b in map(str.split, lines[:-1])] == t.get_mergeable_ranks()
    assert json.loads((tmp_path / "tiktoken.json").read_text())["special_tokens"]["<|end|>"] == t.vocab_size + 1
    assert export.parse_formats("hf, TikToken") == {"hf", "tiktoken"}
    for bad in ("", "onnx"):
        with pytest.raises(ValueError):
            export.parse_formats(bad)
    assert "a\\_b" in export.latex_table(["a_b", "n"], [("x", 1.5)])
    with pytest.raises(ValueError):
        export.ranks([Merge(0, 256, 97, 98, 1), Merge(1, 257, 97, 98, 1)])


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "in.txt"
    f.write_bytes("\n".join(CORPUS).encode())
    agg, out = str(tmp_path / "agg"), str(tmp_path / "out")
    assert cli.main(["train", "--files", str(f), "--agg-file", agg, "--special-preset", "code", "--reserve", "2"]) == 0
    assert cli.main(["train", "--agg-file", agg, "--vocab-size", "300", "--output", out, "--ram-limit", "64GB"]) == 0
    assert (tmp_path / "out/tiktoken.bpe").exists() and "<|reserved_1|>" in (tmp_path / "out/tokenizer.json").read_text()
    assert cli.main(["validate", "--tokenizer", out, "--test-files", str(f), "--check"]) == 0
    for bad in (["--vocab-size", "300"], ["--files", "x", "--vocab-size", "300"], ["--files", "x"], ["--files", "x", "--vocab-size", "9", "--output", "o"], ["--files", "x", "--special-preset", "code", "--special-tokens", "a"], ["--files", "x", "--format", "z"], ["--files", "x", "--agg-file", agg, "--ram-limit", "lots"]):
        assert cli.main(["train", *bad]) == 2
    assert cli.main(["validate", "--tokenizer", str(tmp_path)]) == 2
    capsys.readouterr()


def test_line_files(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_bytes(b"one\r\ntwo\rx\n\nbad \xff\nend")
    assert [r[0] for r in sources.from_lines(spark, [str(f), str(tmp_path / "gone")]).collect()] == ["one", "two\rx", "", "end"]
    assert sources.from_lines(spark, []).count() == 0


def test_folders(spark, tmp_path):
    for p, b in {"c/b/2.txt": b"two", "c/1.txt": b"o\xffne", "results/x": b"no", ".git/y": b"no", "py/z.py": "é".encode()}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {(r["category"], r["path"]): r["text"] for r in sources.category_folders(spark, str(tmp_path)).collect()}
    assert got == {("c", "c/1.txt"): "o�ne", ("c", "c/b/2.txt"): "two", ("py", "py/z.py"): "é"}
    for name, n in (("small", 3), ("big", 5)):
        (tmp_path / "t" / name).mkdir(parents=True)
        (tmp_path / "t" / name / "tokenizer.json").write_text(json.dumps({"model": {"vocab": {str(k): k for k in range(n)}}}))
        (tmp_path / "t" / name / "config.json").write_text("{}")
    assert [x["name"] for x in sources.tokenizer_folders(str(tmp_path / "t"))] == ["big", "small"]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, n long").repartition(7)
    expected, sums = {}, {}
    for k, g, n in rows:
        expected[k] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + n
    assert {r["k"]: r["offset"] for r in ordered.running_sum(df, F.col("n"), [F.col("k")], group="g").collect()} == expected
    assert sorted(r["rank"] for r in ordered.row_numbers(df, [F.col("n").desc(), F.col("k")]).collect()) == list(range(500))
    assert ordered.running_sum(df.limit(0), F.col("n"), [F.col("k")]).count() == 0


def test_stream(spark, tmp_path):
    from lexloom.functions.pretok import parse_spec
    from lexloom.streaming.chunk_stream import count_stream, running_counts

    df = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pre = parse_spec("gpt4").build
    for _ in range(2):  # a second start finds nothing new
        count_stream(stream, "text", pre, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, running_counts(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, chunks.chunk_counts(df, "text", pre).collect()))


def test_evaluation(spark):
    rows = spark.createDataFrame([("t", "a", 10, 5), ("t", "b", 9, 1), ("u", "a", 10, 2), ("u", "b", 0, 0)], "tokenizer string, category string, n_chars long, n_tokens long")
    per = evaluate.by_category(rows, "tokenizer", "category")
    assert {r["tokenizer"]: r["macro_chars_per_token"] for r in evaluate.macro(per).collect()} == {"t": pytest.approx(18**0.5), "u": pytest.approx(5)}
    assert evaluate.with_totals(rows).where("category is null and tokenizer = 't'").first()["n_tokens"] == 6
    assert {(r["category"], r["tokenizer"]): r["place"] for r in evaluate.ranked(per).collect()}[("a", "u")] == 1
    df = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "x"), ("q", "q")], "a string, b string")
    assert [r[0] for r in df.select(evaluate.first_difference(F.col("a"), F.col("b"))).collect()] == [2, 2, 0, None]


def test_comparison(spark, tok, tmp_path):
    tok.save_huggingface(str(tmp_path))
    tok.save_tiktoken(str(tmp_path))
    both = {"json": compare.Loader("hf", str(tmp_path / "tokenizer.json")), "ranks": compare.Loader("ranks", str(tmp_path / "tiktoken.bpe"), tok.get_pattern())}
    df = spark.createDataFrame([("a", "hello world"), ("a", None), (None, "x" * 50), ("b", "")], "category string, text string")
    got = {(r["tokenizer"], r["category"]): (r["vocab_size"], r["n_chars"], r["n_tokens"], r["chars_per_tok"]) for r in compare.compare(df, "category", "text", both, most_chars=20).collect()}
    assert got["json", "a"][1:] == got["ranks", "a"][1:] == (11, len(tok.encode("hello world")), 11 / len(tok.encode("hello world")))
    assert got["ranks", None][1] == 20 and got["json", "b"][1:] == (0, 0, 0.0) and got["ranks", "a"][0] == tok.vocab_size
    with pytest.raises(ValueError):
        compare.load(compare.Loader("x", "y"))


def test_long_iterables(spark):
    texts = [f"row {k} " * 5 for k in range(300)]
    rows = sources.from_iterable(spark, iter(texts), buffer_size=50, part_chars=1000).collect()
    assert [r["text"] for r in sorted(rows)] == texts


def test_memory_monitor():
    with MemoryMonitor(warn_at=1, interval=0.01) as m:
        pass
    assert m.peak > 0 and m.warned


def test_specials_in_training(spark):
    t = Tokenizer(spark)
    t.train_from_iterator(["hello<|x|>world"] * 30, 350, special_tokens=["<|x|>"])
    assert not any(b"|" in b and len(b) > 1 for b, _ in t.get_mergeable_ranks()) and SpecialTokens(["<|x|>"]).split("a<|x|>")[1] == (True, "<|x|>")


def test_unreadable_files_are_named(spark, tmp_path, caplog):
    from lexloom.sources import text as sources

    folder = str(tmp_path / "t")
    spark.createDataFrame([(k, f"text {k}") for k in range(8)], "k int, text string").repartition(2).write.parquet(folder)
    (tmp_path / "t" / "zz-broken.parquet").write_bytes(b"PAR1 nothing here PAR1")
    with caplog.at_level("WARNING"):
        assert sources.from_parquet(spark, folder, "text", ["k"]).count() == 8
    assert [r.getMessage() for r in caplog.records if "zz-broken" in r.getMessage()] and not [r for r in caplog.records if "part-" in r.getMessage()]


def test_corpus_is_built_and_written(spark, tmp_path):
    from lexloom.sources import text as sources

    rows = [(k, " Code/A" if k % 2 else "code/a", "x" * (100 + k), "Auto " if k % 3 == 0 else None if k % 3 == 1 else "other") for k in range(40)]
    rows += [(0, "code/a", "x" * 100, "Auto "), (90, "code/a", None, None), (91, "code/a", "short", None), (None, "code/a", "y" * 200, None), (92, "web", "z" * 300, None)]
    t = spark.createDataFrame(rows, "key long, source string, text string, seed_data string")
    jobs = [sources.Job("all", t, "key", "text", 1000, "code/a"), sources.Job("not auto", t, "key", "text", 10**9, "CODE/A", "!= auto"), sources.Job("auto", t, "key", "text", 10**9, None, "= auto")]
    built = sources.build_corpus(jobs)
    got = {j: sorted((r for r in built.collect() if r["job"] == j), key=lambda r: r["written"]) for j in ("all", "not auto", "auto")}
    assert {r["key"] for r in got["auto"]} == {k for k in range(40) if k % 3 == 0} and {r["key"] for r in got["not auto"]} == {k for k in range(40) if k % 3}
    sizes = [len(r["text"]) for r in got["all"]]
    assert all(r["text"].endswith(sources.SEPARATOR) for r in got["all"]) and [r["written"] for r in got["all"]] == [sum(sizes[:k]) for k in range(len(sizes))]
    assert sum(sizes[:-1]) < 1000 <= sum(sizes)
    report = {r["job"]: (r["rows"], r["n_bytes"]) for r in sources.write_corpus(built, str(tmp_path / "c")).collect()}
    assert report == {j: (len(rs), sum(len(r["text"]) for r in rs)) for j, rs in got.items()}


def test_shared_folder_is_asked_for_off_local(spark):
    from types import SimpleNamespace

    from lexloom.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    remote = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://h:7077"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(remote)


def test_commands_compare_and_validate(spark, tmp_path, capsys):
    from lexloom.cli import main
    from lexloom.tokenizer import Tokenizer

    lines = ["the quick brown fox", "jumps over 12 lazy dogs", "<|endoftext|>", "", "\tindented"] * 4
    tok = Tokenizer(spark)
    seen = []
    tok.on_round = lambda done, of: seen.append((done, of))
    tok.train_from_iterator(lines, 280, special_tokens=["<|endoftext|>"], merge_mode="scan")
    assert seen and seen[-1][0] == len(tok.merges)
    for name, size in (("small", 260), ("large", 280)):
        tok.truncated(size).save_huggingface(str(tmp_path / "tokenizers" / name))
    for category in ("prose", "code"):
        (tmp_path / "texts" / category).mkdir(parents=True)
        (tmp_path / "texts" / category / "a.txt").write_text("\n".join(lines))
    assert main(["compare", "--tokenizers", str(tmp_path / "tokenizers"), "--texts", str(tmp_path / "texts"), "--own", "small", "--output", str(tmp_path / "out")]) == 0
    report = (tmp_path / "out" / "results.csv").read_text().splitlines()
    assert len(report) == 5 and report[1].startswith("small,") and "small" in (tmp_path / "out" / "results.tex").read_text()
    test_file = tmp_path / "t.txt"
    test_file.write_text("\n".join(lines))
    assert main(["validate", "--tokenizer", str(tmp_path / "tokenizers" / "large"), "--test-files", str(test_file), "--check"]) == 0
    said = capsys.readouterr().out
    assert f"round trip: {len(lines)} of {len(lines)} lines" in said and "specials: 1 of 1" in said


def test_errors_of_artifacts(spark, tmp_path):
    with pytest.raises(chunks.ArtifactMissing):
        chunks.read_artifact(spark, str(tmp_path / "none"))
    (tmp_path / "other").mkdir()
    with pytest.raises(chunks.ArtifactMarkWrong):
        chunks.read_artifact(spark, str(tmp_path / "other"))
    path = str(tmp_path / "a")
    counts = spark.createDataFrame([("a", 1), (None, 2)], "chunk string, cnt long")
    chunks.write_artifact(counts, path, "gpt4", "x", SpecialTokens(), {"total_bytes": 1, "total_chunks": 3, "total_sequences": 1})
    with pytest.raises(chunks.ArtifactBroken):
        chunks.read_artifact(spark, path)


@pytest.mark.parametrize(("a", "b", "at"), [("abc", "abc", None), ("abc", "abd", 2), ("abc", "ab", 2), ("", "x", 0), ("😀x", "😀y", 1), ("ab" * 50_000 + "c", "ab" * 50_000 + "d", 100_000)])
def test_first_difference(spark, a, b, at):
    from lexloom.operators.evaluate import first_difference

    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(first_difference(df["a"], df["b"])).first()[0] == at
