import os
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from lexloom.llm import encoding as e
from lexloom.llm.queries import tokenizer_dir

PATH = f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")
VOCABULARY = e.Vocabulary.from_bytes(open(PATH, "rb").read()) if os.path.exists(PATH) else None
TEXTS = ["", None, " ", "Hello  world's\n\n\tdon't <|endoftext|> stop", "文字と漢字 ñ é é 🙂🙂​\x00\x1f", "a" * 5000, " " * 3000 + "x", "=" * 4000, "1234567890" * 50, "ſ K ﬁ İ", "﻿\r\nx"]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


def test_ids_equal_another_implementation(oracle):
    offsets, flat = e.encode_texts(TEXTS, e.PieceCache(VOCABULARY))
    for k, t in enumerate(TEXTS):
        assert list(flat[offsets[k] : offsets[k + 1]]) == (oracle.encode_ordinary(t) if t else [])


def test_prefixes_appends_and_edits_are_exact():
    v = VOCABULARY
    rng = random.Random(5)
    for _ in range(400):
        b = bytes(rng.choice(b"abcd ereingth\xc3\xa9\n--==0") for _ in range(rng.randint(0, 80)))
        p = e.PrefixEncoder(v, b)
        assert p.ids() == v.merge(b)
        cut = rng.randint(0, len(b))
        q = e.PrefixEncoder(v, b[:cut])
        assert q.ids() == v.merge(b[:cut])
        q.append(b[cut:])
        assert q.last == p.last
        at = rng.randint(0, len(b))
        gone = rng.randint(0, len(b) - at)
        put = bytes(rng.choice(b"aeth \xc3") for _ in range(rng.randint(0, 5)))
        p.edit(at, gone, put)
        assert p.last == e.PrefixEncoder(v, b[:at] + put + b[at + gone :]).last


def test_table(spark, oracle):
    rows = [(k, t, "other") for k, t in enumerate(TEXTS)] + [(0, "", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = e.encode(df, "doc_id", "text", PATH)
    assert out.columns == ["doc_id", "ids"] and out.count() == len(rows)
    got = {r["doc_id"]: r["ids"] for r in out.where(F.col("doc_id") > 0).collect()}
    assert got[1] == [] and got[3] == oracle.encode_ordinary(TEXTS[3])
    assert e.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
