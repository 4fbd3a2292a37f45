"""Completeness cells, outages, sketches, footers and planned ranges on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridmeter.operators import quality as Q
from gridmeter.operators import sketches as K
from gridmeter.sources import footers as FT
from gridmeter.sources import io as IO

T = dt.datetime


def test_months_without_readings_are_cells(spark):
    rows = [("s", "a", T(2024, 1, 31, 23, 45)), ("s", "a", T(2024, 1, 31, 23, 50)), ("s", "a", T(2024, 3, 1)), ("s", "b", T(2024, 3, 1, 0, 20)),
            (None, "c", T(2024, 5, 5)), ("s", None, T(2024, 4, 1)), ("s", "d", None)]
    df = spark.createDataFrame(rows, "site string, k string, t timestamp")
    got = {(r.site, str(r.period)[:7]): (r.n_keys, r.expected, r.present) for r in Q.completeness_matrix(df, "site", "k", "t").collect()}
    assert got == {("s", "2024-01"): (1, 1, 1), ("s", "2024-02"): (1, 29 * 96, 0), ("s", "2024-03"): (2, 2, 2), (None, "2024-05"): (1, 1, 1)}
    year = Q.completeness_matrix(df, "site", "k", "t", 15, "year").where("site IS NOT NULL").collect()
    assert [(r.n_keys, r.expected, r.present) for r in year] == [(2, 29 * 96 + 3, 3)]
    day = Q.completeness_matrix(df, "site", "k", "t", 1440).where("site IS NOT NULL").collect()
    assert sorted((r.expected, r.present) for r in day) == [(1, 1), (2, 2), (29, 0)]
    assert Q.completeness_matrix(df.limit(0), "site", "k", "t").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_outages_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for k in "abc":
        t, states = T(2024, 1, 1), []
        for i in range(120):
            t += dt.timedelta(minutes=15 * rng.choice([0, 1, 1, 5, 60, 200]))
            states.append((t, rng.choice([0, 0, 1, 1, 1, None]), i))
        rows += [(k, t, s, i) for t, s, i in states]
        known = [(t, s) for t, s, _ in states if s is not None]
        start = None
        for t, s in known:
            if s == 0 and start is None:
                start = t
            elif s == 1 and start is not None:
                want.append((k, start, t, True))
                start = None
        if start is not None:
            want.append((k, start, known[-1][0], False))
    rows += [(None, T(2024, 1, 1), 0, 1), ("a", None, 0, 1), ("up", T(2024, 1, 1), 1, 1), ("down", T(2024, 1, 1), 0, 1)]
    want.append(("down", T(2024, 1, 1), T(2024, 1, 1), False))
    df = spark.createDataFrame(rows, "k string, t timestamp, s int, i int").repartition(4)
    o = Q.outage_intervals(df, "k", "t", F.col("s") == 1, ["i"])
    assert sorted((r.k, r.outage_start, r.outage_end, r.ended) for r in o.collect()) == sorted(want)


def test_uptime_is_covered_time(spark):
    rows = [("m", T(2024, 1, 31), 1), ("m", T(2024, 1, 31, 12), 0), ("m", T(2024, 2, 1, 12), 1), ("m", T(2024, 2, 2), 1)]
    df = spark.createDataFrame(rows, "k string, t timestamp, s int").withColumn("site", F.lit("x"))
    u = Q.uptime_from_outages(df, Q.outage_intervals(df, "k", "t", F.col("s") == 1), "site", "k", "t")
    assert {r.ym: (r.covered_s, r.down_s, r.uptime) for r in u.collect()} == {"2024-01": (86400.0, 43200.0, 0.5), "2024-02": (86400.0, 43200.0, 0.5)}


def test_asof_join_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, "a", T(2024, 1, 5)), (2, None, T(2024, 1, 5)), (3, "a", None), (3, "a", None), (4, "a", T(2023, 1, 1))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", T(2024, 1, 1), 7), (None, T(2024, 1, 1), 8), ("a", None, 9)], "k string, u timestamp, v int")
    got = sorted((r.id, r.v) for r in Q.asof_join(left, right, "k", "t", "u", ["v"]).collect())
    assert got == [(1, 7), (2, None), (3, None), (3, None), (4, None)]


def test_sketches_of_months_make_those_of_a_year(spark):
    rng = random.Random(1)
    rows = [("s", T(2024, 1 + i % 12, 1), f"m{rng.randrange(4000)}", rng.lognormvariate(0, 2)) for i in range(30_000)] + [("t", T(2024, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "site string, t timestamp, k string, x double")
    year = F.year("month").alias("year")
    d = {r.site: (r.n_rows, r.n_distinct) for r in K.distinct_estimates(K.distinct_sketches(df, ["site"], "t", "k"), ["site", year]).collect()}
    exact = len({k for _, _, k, _ in rows if k})
    assert abs(d["s"][1] - exact) <= 4 * K.HLL_ERROR * exact and d["t"] == (1, 0)
    q = K.quantile_estimates(K.quantile_sketches(df, ["site"], "t", "x"), ["site", year], [0.1, 0.5, 0.9]).collect()
    xs = sorted(x for _, _, _, x in rows if x is not None)
    assert len(q) == 1 and q[0].n == len(xs)
    for p, v in zip((0.1, 0.5, 0.9), (q[0].q0, q[0].q1, q[0].q2)):
        assert abs(sum(x <= v for x in xs) / len(xs) - p) <= 2 * K.KLL_ERROR


def test_profile_and_ranges_come_from_footers(spark):
    paths = {n: f"/root/testdata/sf0.001/{n}.parquet" for n in ("orders", "events")}
    for d in (FT.table_profile(spark, paths), FT.ranges(spark, {"orders": (paths["orders"], "o_orderkey")})):
        plan = d._jdf.queryExecution().toString()
        assert "PushedAggregation: [COUNT(*)" in plan, plan
    import os
    got = {r.table_name: (r.n_rows, r.bytes) for r in FT.table_profile(spark, paths).collect()}
    size = lambda p: os.path.getsize(p) if os.path.isfile(p) else sum(os.path.getsize(f"{p}/{x}") for x in os.listdir(p) if x.endswith(".parquet"))
    assert got == {n: (spark.read.parquet(p).count(), size(p)) for n, p in paths.items()}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "false"


def test_ranges_take_every_row_once(spark):
    rng = random.Random(2)
    rows = [(T(2017, 1, 1) + dt.timedelta(hours=rng.randrange(70_000)),) for _ in range(900)] + [(None,)] * 5
    df = spark.createDataFrame(rows, "ts timestamp")
    counts = [(str(r.m), r.n) for r in df.groupBy(F.trunc("ts", "month").alias("m")).agg(F.count("*").alias("n")).collect() if r.m and r.m.year > 2018]
    for predicates in (IO.range_predicates("ts", counts, 100), IO.range_predicates("ts", [], 100), IO.range_predicates("ts", [("2019-01-01", 9)], 1),
                       IO.year_predicates("ts", [2018, 2020], rest=True), IO.year_predicates("ts", [], rest=True)):
        hits = df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates).alias("n")).groupBy("n").count().collect()
        assert [(r.n, r["count"]) for r in hits] == [(1, 905)], predicates
    sizes = [df.where(p).count() for p in IO.range_predicates("ts", counts, 100)]
    assert len(sizes) > 5 and max(sizes[1:]) <= 100
