"""Hand-worked vectors: histograms, tests, box plots, regressions, FX, emissions, pseudonyms."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeter.operators import carbon as K
from gridmeter.operators import release as R
from gridmeter.operators import stats as S
from gridmeter.operators import usage as U


def test_hi1_voltage_bins(spark):
    df = spark.createDataFrame([(50.0,), (50.5,), (51.0,), (300.0,), (49.0,), (300.5,)], "v double")
    got = [r.b for r in df.select(S.bin_index("v", 50.0, 300.0, 250).alias("b")).collect()]
    assert got == [0, 0, 1, 249, None, None]


def test_hi2_pf_edges_match_numpy(spark):
    vals = [k * 0.005 for k in range(0, 201)] + [k / 100 for k in range(0, 101)]
    edges = np.linspace(0.0, 1.0, 201)
    expect = np.histogram(vals, bins=edges)[0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = np.zeros(200, dtype=int)
    for r in df.select(S.bin_index("x", 0.0, 1.0, 200).alias("b")).collect():
        got[r.b] += 1
    assert (got == expect).all()


def test_t_test_vector(spark):
    # slopes 1, 2, 3: n=3, mean 2, t=3.4641, df 2, p=0.0742
    t = 2 / (1 / np.sqrt(3))
    assert round(t, 4) == 3.4641
    # df=2 closed form: p = 1 - t/sqrt(2+t^2); df=1: p = 1 - 2 atan(t)/pi
    rows = [(tv, 2) for tv in (0.0, 0.3, 1.7, 5.0, float(t))] + [(-1.0, 1), (3.0, 1), (1.9599639845400545, 10_000_000), (None, 3)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, dof bigint").select(S.t_pvalue("t", "dof").alias("p")).collect()]
    want = [1 - tv / np.sqrt(2 + tv * tv) for tv, _ in rows[:5]] + [1 - 2 * np.arctan(x) / np.pi for x in (1.0, 3.0)] + [0.05]
    assert got[:8] == pytest.approx(want, abs=1e-7) and got[8] is None


def test_t_pvalue_of_slopes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "g string, s double")
    r = S.one_sample_t(df, "s", ["g"]).select(S.t_pvalue("t", "dof").alias("p"), "n", "t").collect()[0]
    assert r.n == 3 and round(r.t, 4) == 3.4641 and round(r.p, 4) == 0.0742


def test_bx1_boxplot(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, 4, 100)], "site string, x double")
    r = S.boxplot_stats(df, "x", ["site"]).collect()[0]
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (2, 3, 4, 1, 4, 1)
    out = S.boxplot_outliers(df, "x", ["site"], "x").collect()
    assert [o.x for o in out] == [100.0]


def test_ol1_slopes(spark):
    rows = [("a", 0, 10.0), ("a", 1, 20.0), ("a", 2, 30.0), ("b", 0, 1.0), ("b", 1, 2.0),
            ("c", 1, 1.0), ("c", 1, 2.0), ("c", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, x int, y double")
    got = {r.k: r.slope for r in S.group_slopes(df, "y", "x", ["k"]).collect()}
    assert got["a"] == pytest.approx(10.0) and got["b"] is None and got["c"] is None


def test_fx1_nearest_year(spark):
    rates = spark.createDataFrame([("K", 2018, 100.0), ("K", 2020, 110.0)], "country string, year int, rate double")
    keys = spark.createDataFrame([("K", 2019), ("K", 2025), ("K", 2015), ("K", 2020)], "country string, year int")
    got = {r.year: r.fx_rate for r in U.nearest_year_rates(keys, rates).collect()}
    assert got == {2019: 100.0, 2025: 110.0, 2015: 100.0, 2020: 110.0}


def test_co1_emissions(spark):
    df = spark.createDataFrame([(100.0, True), (40.0, True), (100.0, False)], "annual_kwh double, is_residential boolean")
    got = [round(r.c, 6) for r in df.select(K.co2e().alias("c")).collect()]
    assert got == [0.1856, 0.1088, 0.08]


def test_ps1_pseudonym(spark):
    df = spark.createDataFrame([("A1",), (None,), ("  ",)], "v string")
    got = [r.v for r in R.pseudonymize(df, ["v"], "salt").collect()]
    assert got[0] == "3818a17e432aae1b5f28a0a6c39c19bdd73e06f6cebddea570fe4250a1c9840c"
    assert got[0] == hashlib.sha256(b"A1salt").hexdigest()
    assert got[1] is None and got[2] == "  "


def test_nl1_null_safe_flags(spark):
    df = spark.createDataFrame([(None,), (0,), (1,)], "isReversed int")
    from gridmeter.functions.core import neq_nullsafe
    assert df.where(neq_nullsafe("isReversed", 1)).count() == 2


def test_describe_matches_pandas(spark):
    import pandas as pd
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    d = pd.Series(vals).describe(percentiles=[0.25, 0.5, 0.75, 0.95])
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x double")
    r = S.describe(df, "x", ["g"]).collect()[0]
    assert r["count"] == d["count"] and r.mean == pytest.approx(d["mean"]) and r["std"] == pytest.approx(d["std"])
    assert (r.p25, r.p50, r.p75, r.p95) == pytest.approx((d["25%"], d["50%"], d["75%"], d["95%"]))


def test_log_histogram_counts(spark):
    rng = np.random.default_rng(3)
    vals = rng.lognormal(3, 1, 400)
    df = spark.createDataFrame([("c", "A" if i % 2 else "B", float(v)) for i, v in enumerate(vals)],
                               "country string, cls string, x double")
    h = S.log_histogram(df, "x", "country", "cls").collect()
    lo = max(np.quantile(vals, 0.01), 1e-3)
    hi = np.quantile(vals, 0.99)
    edges = np.logspace(np.log10(lo), np.log10(hi), 50)
    edges[0], edges[-1] = lo, hi
    for cls, sel in (("A", vals[1::2]), ("B", vals[0::2])):
        expect = np.histogram(sel, bins=edges)[0]
        got = [r["count"] for r in sorted((r for r in h if r.cls == cls), key=lambda r: r.bin)]
        assert list(expect) == got


def test_histogram_dense_total(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(40, 310, 1000)], "v double")
    h = S.histogram(df, ["v"], 50.0, 300.0, 250).collect()
    assert len(h) == 250
    inside = [v for v in np.linspace(40, 310, 1000) if 50 <= v <= 300]
    assert sum(r["count"] for r in h) == len(inside)


def test_log_histogram_keeps_a_constant_group(spark):
    df = spark.createDataFrame([("c", "A", 5.0), ("c", "A", 5.0), (None, "A", 1.0), (None, "A", 2.0)], "country string, cls string, x double")
    h = S.log_histogram(df, "x", "country", "cls").collect()
    c = [r for r in h if r.country == "c"]
    assert len(c) == 49 and sum(r["count"] for r in c) == 2 and {r.density for r in c} <= {None, 0.0}
    assert len([r for r in h if r.country is None]) == 49


def test_clipped_histogram_is_dense(spark):
    df = spark.createDataFrame([("c", float(i)) for i in (1, 2, 100)] + [("d", 7.0)], "country string, x double")
    h = S.clipped_histogram(df, "x", "country", 60).collect()
    assert len(h) == 120 and sum(r["count"] for r in h) == 4


@pytest.mark.parametrize("few, digit", [(200_000, 16), (3_000, 16), (50, 4), (1, 8)])
def test_exact_quantiles_equal_percentile(spark, monkeypatch, few, digit):
    """Ordered at once or after refinements; also where 60 % of a group are one value, and for a NULL group."""
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "DIGIT", digit)
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.exponential(2.0, 30000)] + \
        [("b", float(v)) for v in rng.integers(0, 5, 200)] + [("c", 1.0)] + \
        [("t", 0.0)] * 6000 + [("t", float(v)) for v in rng.normal(0, 1, 4000)] + [(None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in S.exact_quantiles(df, "x", ["g"], [0.25, 0.5, 0.75]).collect()}
    ref = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("p")).collect()}
    assert got.keys() == ref.keys()
    for g in ref:
        assert got[g] == pytest.approx(ref[g], abs=1e-12)


@pytest.mark.parametrize("n", [2, 2001, 7000])
def test_exact_quantiles_with_ties(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(0, 1, n), 3)          # many ties
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    r = S.exact_quantiles(df, "x", ["g"], probs).collect()[0]
    got = [r[f"q{i}"] for i in range(len(probs))]
    assert got == pytest.approx(list(np.quantile(vals, probs)), abs=1e-12)


def test_ordered_bits_are_those_of_the_number(spark):
    """Every power of two and its neighbours, subnormals, infinities, NaN and both signs."""
    from gridmeter.functions.core import ordered_bits
    powers = np.concatenate([np.ldexp(1.0, np.arange(-1074, 1024)), [np.finfo(float).max, 5e-324, 3e-310]])
    rng = np.random.default_rng(4)
    x = np.concatenate([powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0), rng.lognormal(0, 200, 3000), rng.uniform(0, 1, 3000)])
    x = np.concatenate([x, -x, [0.0, np.inf, -np.inf]])
    want = np.where(x < 0, -np.abs(x).view(np.int64), np.abs(x).view(np.int64))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = {r.i: r.b for r in df.select("i", ordered_bits("x").alias("b")).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
    nan = spark.sql("SELECT double('NaN') AS x").select(ordered_bits("x").alias("b")).first().b
    assert nan > max(want)


def test_moments_of_counts(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(1e6, 1, 500), 1)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [(None, 3.0)], "g string, x double")
    got = {r.g: r for r in S.moments_of_counts(S.value_counts(df, "x", ["g"]), ["g"]).collect()}
    assert (got["a"].n, got["a"]["min"], got["a"]["max"]) == (500, v.min(), v.max())
    assert got["a"].mean == pytest.approx(v.mean(), rel=1e-13) and got["a"]["std"] == pytest.approx(v.std(ddof=1), rel=1e-9)
    assert got[None].n == 1 and got[None]["std"] is None


def test_p_value_of_a_group_of_equal_slopes_is_null(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0), ("b", 2.0), ("b", 3.0), ("c", 1.0)], "g string, s double")
    t = S.one_sample_t(df, "s", ["g"]).withColumn("p", S.t_pvalue("t", "dof"))
    p = {r.g: r.p for r in t.collect()}
    assert p["a"] is None and p["c"] is None and p["b"] == pytest.approx(0.0742, abs=1e-4)
    import duckdb
    sql = S.sql_t_pvalue("t", "dof")
    assert duckdb.sql(f"SELECT {sql} FROM (SELECT CAST(NULL AS DOUBLE) AS t, 3 AS dof)").fetchall() == [(None,)]
