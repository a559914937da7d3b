import random
from collections import Counter

import pytest

from lexloom.llm.heavy_hitters import SpaceSaving, frequent_items


def table(spark, rows, parts=6):
    return spark.createDataFrame(rows, "item binary, cnt long, error long").repartition(parts)


def test_summary_bounds():
    rng = random.Random(2)
    s, truth = SpaceSaving(20), Counter()
    for _ in range(50):
        rows = [(b"%d" % int(rng.paretovariate(0.7)), rng.randint(1, 9)) for _ in range(200)]
        s.add(*zip(*((k, w, w) for k, w in rows)))
        for k, w in rows:
            truth[k] += w
    assert len(s.gain) <= 20 and s.floor * 21 <= sum(truth.values())
    assert all(low <= truth[k] <= high for k, (low, high) in s.bounds().items())
    assert all(n <= s.floor for k, n in truth.items() if k not in s.gain)


def test_a_replaced_counter_is_the_error_of_the_next():
    s = SpaceSaving(2)
    for item, n in ((b"a", 5), (b"b", 3), (b"c", 2), (b"a", 1)):
        s.add([item], [n], [n])
    # c found no smaller counter than its own weight; a was there from the beginning
    assert s.bounds()[b"a"] == (6, 6) and s.floor == 2
    s.add([b"d"], [4], [4])
    assert s.bounds()[b"d"] == (4, 6)


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_frequent_items_are_exact(spark, hot):
    rng = random.Random(4)
    rows = [(b"hot" if rng.random() < hot else b"v%d" % int(rng.paretovariate(0.9)), rng.randint(-1, 20), 7) for _ in range(20_000)]
    rows += [(None, 1000, 0), (b"none", None, 0), (b"", 5000, 0), ("é".encode(), 4000, 0), ("é".encode(), 1, 0)]
    truth = Counter()
    for k, n, _ in rows:
        if k is not None and n is not None and n > 0:
            truth[k] += n
    total = sum(truth.values())
    expected = {k: n for k, n in truth.items() if n * 100 >= total}
    got = frequent_items(table(spark, rows), "item", "cnt", per=100, counters=100, fan_in=2).collect()
    assert {bytes(r["item"]): r["exact"] for r in got} == expected
    assert all(r["approx"] - r["error"] <= r["exact"] <= r["approx"] and r["total"] == total for r in got)


def test_rows_without_weight_count_one(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert {(bytes(r["item"]).decode(), r["exact"]) for r in frequent_items(df, "s", per=2).collect()} == {("a", 2)}


def test_ties_and_empty(spark):
    rows = [(b"a", 1, 0), (b"b", 1, 0)]
    assert frequent_items(table(spark, rows), "item", "cnt", per=2).count() == 2
    assert frequent_items(table(spark, []), "item", "cnt").count() == 0
    with pytest.raises(ValueError):
        frequent_items(table(spark, rows), "item", "cnt", per=500, counters=100)


def test_long_items(spark):
    big = b"x" * 2_000_000
    assert bytes(frequent_items(table(spark, [(big, 9, 0), (b"y", 1, 0)]), "item", "cnt", per=2).first()["item"]) == big
