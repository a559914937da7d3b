import pytest
import regex
from pyspark.sql import functions as F

from lexloom.functions import pretok as p
from lexloom.functions.bytetext import byte_alphabet, format_bytes, format_bytes_column, parse_size, token_char, token_id
from lexloom.functions.specials import PRESETS, SpecialTokens, segments
from lexloom.operators.chunks import placed_chunks, text_chunks

TEXTS = ["Hello world!", "v2.0.1", "é1é", "a　　b", "x y\u0085z", "it'ſ ok", "don't  stop\r\n\r\n now", "   lead", "tail   ", "\t\n x", "1234567", "文字 mixed テスト", "🙂🙂 a", "a\x00b", "", "q r"]


def run(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["c"] for r in df.select("i", column(F.col("t")).alias("c")).orderBy("i").collect()]


def test_default_pattern_as_the_regex_module(spark):
    assert run(spark, p.parse_spec("gpt4").build, TEXTS) == [regex.findall(p.GPT4_PATTERN, t) for t in TEXTS]


def test_digits_and_sequences(spark):
    assert run(spark, p.digits, ["v1234", "", "a12é3-4", "٣4", "7"]) == [["v", "1", "2", "3", "4"], [], ["a", "1", "2", "é", "3", "-", "4"], ["٣", "4"], ["7"]]
    assert run(spark, p.parse_spec("gpt4+digits").build, ["in 2025!"]) == [["in", " ", "2", "0", "2", "5", "!"]]
    assert run(spark, p.sequence(), ["a b"]) == [["a b"]]
    assert run(spark, p.parse_spec("regex:[A-Z]+").build, ["AAA bbb AAA", "x"]) == [["AAA", "AAA"], []]
    assert run(spark, p.by_regex(r"\w*"), ["ab  c"]) == [["ab", "c"]]


def test_specs():
    assert p.parse_spec("regex+digits:x:y")[1:] == ("x:y", "regex+digits:x:y", True)
    assert p.resolve_spec(None, "a+").canonical == "regex:a+" and p.resolve_spec().canonical == "gpt4"
    for bad in ("", "gpt5", "gpt4:x", "regex"):
        with pytest.raises(ValueError):
            p.parse_spec(bad)
    with pytest.raises(ValueError, match="not both"):
        p.resolve_spec("gpt4", "x")


def test_special_registry():
    s = SpecialTokens.preset("code")
    s.add_reserved(2)
    assert s.tokens[:8] == PRESETS["code"] and s.ids(300)["<|reserved_1|>"] == 309
    for bad in ("", "a\0", s.tokens[0]):
        with pytest.raises(ValueError):
            s.add(bad)
    with pytest.raises(ValueError):
        SpecialTokens.preset("poetry")


@pytest.mark.parametrize("tokens", [["<|a|>", "<|a|>b", "é", "(x)"], ["\\E", "[0]"], []])
def test_segments(spark, tokens):
    s = SpecialTokens(tokens)
    texts = ["", "plain", "<|a|>", "x<|a|>y", "<|a|>b<|a|><|a|>", "\n<|a|\né(x)\n", "\\E[0]\\Ex", "x" * 3000 + "<|a|>"]
    got = run(spark, lambda t: segments(t, s), texts)
    assert [[(r["special"], r["seg"]) for r in g] for g in got] == [s.split(t) for t in texts]
    assert run(spark, lambda t: segments(t, s), [None]) == [None] or run(spark, lambda t: F.size(segments(t, s)), [None])[0] <= 0


def test_chunks_leave_specials_out(spark):
    s = SpecialTokens(["<|x|>"])
    assert run(spark, lambda t: text_chunks(t, p.parse_spec("gpt4").build, s), ["a<|x|>b", None]) == [["a", "b"], []]
    df = spark.createDataFrame([(1, "a b<|x|>"), (2, None)], "k int, t string")
    assert [tuple(r) for r in placed_chunks(df, "k", "t", p.parse_spec("gpt4").build, s).orderBy("seg_pos", "chunk_pos").collect()] == [(1, 0, False, 0, "a"), (1, 0, False, 1, " b"), (1, 1, True, 0, "<|x|>")]


def test_bytes(spark):
    letters = byte_alphabet()
    assert len(set(letters)) == 256 and letters[32] == "Ġ" and letters[10] == "Ċ" and letters[65] == "A"
    ids = [0, 255, 256, 0xD6FF, 0xD700, 60_000, 1_000_000]
    assert [token_id(token_char(i)) for i in ids] == ids and [token_char(i) for i in ids] == sorted(token_char(i) for i in ids)
    assert [parse_size(x) for x in ("64GB", "1.5g", "1024", " 2 kb ", "-1", "nan", "inf", "x", "")] == [64 << 30, 3 << 29, 1024, 2048, None, None, None, None, None]
    sizes = [0, 1023, 1024, 3712, 1664, 1234567, 5 << 30]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long")
    assert [r["s"] for r in df.select("i", format_bytes_column(F.col("n")).alias("s")).orderBy("i").collect()] == [format_bytes(n) for n in sizes]
