import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import repetition as r


def brute(text, run=5):
    w = [x.lower() for x in re.findall(r"[^\W\d_]+", text or "")]
    seen, hit = set(), [False] * len(w)
    for k in range(len(w) - run + 1):
        g = tuple(w[k : k + run])
        if g in seen:
            hit[k : k + run] = [True] * run
        seen.add(g)
    return len(w), sum(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "B", "b", "é", "文字", "c1d", "7", ".", "\r\n", "𝒜", "x_y"]), max_size=60).map(" ".join)), max_size=6))
def test_counts_as_brute_force(texts):
    n, k = r.repeated_words(texts)
    assert [(int(a), int(b)) for a, b in zip(n, k)] == [brute(t) for t in texts]


def test_very_long_text():
    random.seed(1)
    text = " ".join("".join(random.choices("abcdefghij", k=7)) for _ in range(400_000))
    n, k = r.repeated_words([text, text + " " + text[:800_000]])
    assert n[0] == 400_000 and k[0] == 0 and k[1] > 90_000


def test_documents_and_hosts(spark):
    spam = "one two three four five six seven. " * 4
    good = "every word here stands only once in this short text"
    rows = [(k, spam, "bad", 1.0) for k in range(6)] + [(10 + k, good, "fine", None) for k in range(30)] + [(50, None, None, 0.0), (51, "", None, 0.0), (52, "12 34 !!", "fine", 0.0), (53, spam, "fine", 0.0), (53, good, "fine", 0.0)]
    df = spark.createDataFrame(rows, "row_id long, text string, site string, share double")
    out = {x["row_id"]: x for x in r.judge(r.measure(df, "t", "row_id", "text", "site")).collect()}
    assert {k for k, x in out.items() if x["found"]} == {0, 1, 2, 3, 4, 5, 53}
    assert out[50]["n_words"] == 0 and out[52]["share"] == 0 and out[50]["host"] == "" and len(out) == 40
    assert out[0]["host_verdict"] and not out[10]["host_verdict"] and out[0]["host_rate"] < 1
    assert r.judge(r.measure(df.limit(0), "t", "row_id", "text", "site")).count() == 0


def test_each_table_has_its_prior(spark):
    def measured(tbl, hosts, salt=0):
        return [(tbl, 1000 * h + k, f"h{h}", 10, 5, 0.5 if k < bad else 0.0) for h, (n, bad) in enumerate(hosts) for k in range(n)]

    schema = "tbl string, row_id long, host string, n_words long, n_repeated long, share double"
    clean, mixed = measured("clean", [(20, 0)] * 9 + [(2, 1)]), measured("mixed", [(20, 18), (20, 1), (20, 19), (20, 0), (2, 1)])
    both = spark.createDataFrame(clean + mixed, schema)
    got = {(x["tbl"], x["host"]): x["host_rate"] for x in r.host_verdicts(both).collect()}
    assert got == {(x["tbl"], x["host"]): x["host_rate"] for part in (clean, mixed) for x in r.host_verdicts(spark.createDataFrame(part, schema)).collect()}
    assert got["clean", "h9"] < 0.35 < got["mixed", "h4"] and got["mixed", "h0"] > 0.8
    # hosts beyond the broadcast are joined with a salt
    whole = sorted(map(tuple, r.judge(both).select("tbl", "row_id", "host_rate", "found").collect()))
    assert sorted(map(tuple, r.judge(both, broadcast_hosts=0).select("tbl", "row_id", "host_rate", "found").collect())) == whole and len(whole) == len(clean + mixed)
