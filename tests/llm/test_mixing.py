import datetime as dt

import pytest

from lexloom.llm import mixing as m


def job(name, target, available, repeats=1, records=10):
    return {"job": name, "source": name, "target_bytes": target, "max_repeats": repeats, "available_bytes": available, "records": records}


def test_plan_keeps_shares_within_caps():
    plan = {p["job"]: p for p in m.plan_mix([job("a", 30, 1000), job("b", 10, 100, 4), job("c", None, 9)])}
    assert set(plan) == {"a", "b"} and plan["a"]["budget_bytes"] == 1000 and plan["b"]["budget_bytes"] == 333
    assert plan["b"]["passes"] == 3 and plan["b"]["rest_bytes"] == 33


def test_capped_job_leaves_its_rest_to_others():
    plan = {p["job"]: p for p in m.plan_mix([job("a", 50, 10_000), job("b", 50, 100)], total_bytes=1000)}
    assert plan["b"]["budget_bytes"] == 100 and plan["a"]["budget_bytes"] == 900
    plan = m.plan_mix([job("a", 1, 10), job("b", 1, 0)], total_bytes=10**6)
    assert [p["budget_bytes"] for p in plan] == [10, 0]


def test_temperature_is_bisected():
    shares = [0.9, 0.1]
    a = m.bisect_exponent(shares, lambda ws: m.entropy(ws) >= 0.6)
    assert 0 < a < 1 and abs(m.entropy(m.weights(shares, a)) - 0.6) < 1e-6
    assert m.bisect_exponent(shares, lambda ws: True) == 1.0
    plan = m.plan_mix([job("a", 90, 100, 9), job("b", 10, 900, 9)], total_bytes=400, max_epochs=2.5)
    assert 249 <= plan[0]["budget_bytes"] <= 250


def test_exponent_within_caps():
    plan = m.plan_mix([job("a", 90, 600), job("b", 10, 1000)], total_bytes=1000, within_caps=True)
    assert plan[0]["exponent"] < 1 and [p["budget_bytes"] for p in plan] == [600, 400]


def test_exponent_between_two_caps():
    # a breaks its cap near 1, c near 0: only exponents between them fit
    jobs = [job("a", 90, 800), job("b", 8, 500), job("c", 2, 100)]
    plan = m.plan_mix(jobs, total_bytes=1000, within_caps=True)
    assert 0 < plan[0]["exponent"] < 1 and all(p["budget_bytes"] <= p["available_bytes"] for p in plan) and plan[0]["budget_bytes"] == 800
    # none fits: the exponent stays
    assert m.plan_mix([job("a", 90, 500), job("b", 10, 100)], total_bytes=1000, within_caps=True)[0]["exponent"] == 1


def test_total_in_proportion(spark):
    rows = [("a", 60, "code/a", None, 1, None), ("b", 60, "web/b", "= auto", 3, None)]
    plan, used = m.mix(jobs(spark, rows), tables(spark), total_share=1.25)
    have, caps = sum(p["available_bytes"] for p in plan), {p["job"]: p["available_bytes"] * p["max_repeats"] for p in plan}
    assert abs(sum(p["budget_bytes"] for p in plan) - int(1.25 * have)) <= 1 and plan[1]["budget_bytes"] == caps["b"]


def test_no_jobs():
    assert m.plan_mix([]) == []


@pytest.mark.parametrize(("rule", "seed", "passes"), [("= x", " X ", True), ("= x", None, False), ("!= x", None, True), ("!= x", "X", False), ("!= x", "y", True), (None, None, True), ("  ", "q", True)])
def test_seed_filters(spark, rule, seed, passes):
    df = spark.createDataFrame([(seed,)], "s string")
    assert df.where(m.seed_condition(rule, df["s"])).count() == passes


def test_unknown_filter():
    with pytest.raises(ValueError):
        m.seed_condition("like x", None)


def tables(spark):
    code = [(k, "Code/A " if k % 3 else "code/a", "x" * (10 + k % 7), "extra") for k in range(400)] + [(0, "code/a", "x" * 10, "twice"), (900, "code/a", None, None), (901, None, "x", None), (902, "code/a", "", None), (None, "code/a", "xx", None)]
    web = [(k, "web/b", "é" * 10, "auto") for k in range(50)] + [(60, "web/b", "y" * 20, None), (61, "web/b", "y" * 20, "AUTO ")]
    return {"code": (spark.createDataFrame(code, "file_id long, source string, content string, job string"), "file_id", "content"), "web": (spark.createDataFrame(web, "row_id long, source string, text string, seed_data string"), "row_id", "text")}


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job string, target_bytes long, source string, seed_filter string, max_repeats int, updated_at timestamp")


def test_mix(spark):
    old, new = dt.datetime(2023, 1, 1), dt.datetime(2023, 2, 1)
    rows = [("a", 1, "code/a", None, 1, old), ("a", 60, "CODE/A", None, 1, new), ("b", 30, "web/b", "= auto", 3, new), ("c", 30, "web/none", None, 2, new), ("d", None, "code/a", None, 2, new), (None, 5, "code/a", None, 1, new)]
    plan, used = m.mix(jobs(spark, rows), tables(spark), block_records=16)
    rows = used.collect()
    by = {j: [r for r in rows if r["job"] == j] for j in ("a", "b", "c")}
    assert not by["c"] and len({(r["job"], r["tbl"], r["record_id"], r["pass"]) for r in rows}) == len(rows)
    assert max(r["pass"] for r in by["a"]) == 0 and max(r["pass"] for r in by["b"]) <= 2
    # passes are permutations of their own
    order = [[r["record_id"] for r in sorted(by["b"], key=lambda r: r["slot"]) if r["pass"] == k] for k in (0, 1)]
    assert sorted(order[0]) == sorted(order[1]) and order[0] != order[1]
    assert {r["block"] for r in rows} <= set(range(64)) and len({r["slot"] for r in rows}) == len(rows)
    assert 60 not in {r["record_id"] for r in by["b"]} and 61 in {r["record_id"] for r in by["b"]} | {61}
    size = {j: sum(r["n_bytes"] for r in rs) for j, rs in by.items()}
    assert abs(size["a"] / size["b"] - 2) < 0.05
    again = m.mix(jobs(spark, [tuple(r) for r in jobs(spark, [("a", 60, "code/a", None, 1, new), ("b", 30, "web/b", "= auto", 3, new)]).collect()]), tables(spark), block_records=1)[1].drop("block")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used.drop("block").collect()))  # the same in every run, whatever the blocks
    report = {r["job"]: r for r in m.share_report(plan, used).collect()}
    assert report["c"]["reached_share"] == 0 and abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9


def test_empty_tables(spark):
    t = {k: (df.limit(0), a, b) for k, (df, a, b) in tables(spark).items()}
    plan, used = m.mix(jobs(spark, [("a", 1, "code/a", None, 1, None)]), t)
    assert used.count() == 0 and m.share_report(plan, used).first()["reached_share"] == 0
    plan, used = m.mix(jobs(spark, []), tables(spark))
    assert plan == [] and used.count() == 0
