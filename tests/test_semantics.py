"""Rows that must neither vanish nor multiply."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gridmeter.operators import profiles as P
from gridmeter.operators import quality as Q
from gridmeter.operators import release as R
from gridmeter.sources import io as IO


def folder():
    return tempfile.mkdtemp(prefix="gm-sem-", dir="/tmp")


def test_incremental_write_knows_null_keys(spark):
    df = spark.createDataFrame([("a/b c", 2020, 1), (None, 2020, 2), (None, None, 3)], "site_name string, year int, v int")
    path = os.path.join(folder(), "t")
    for _ in range(3):
        IO.incremental_write(df, path, ["site_name", "year"])
    got = spark.read.schema(df.schema).parquet(path).select(df.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert IO.incremental_write(df, path, ["site_name", "year"], dry_run=True) == 0


def test_written_partitions_does_not_hide_errors(spark):
    assert IO.written_partitions(spark, "/tmp/no-such-folder-here", ["a"]) is None
    with pytest.raises(Exception):  # noqa: B017 - a store that does not exist is not an empty table
        IO.written_partitions(spark, "nosuchstore://x/y", ["a"])


def test_write_series_keeps_a_meter_month_in_one_file(spark):
    rows = [("s", f"m{i % 7}", "customer", f"2024-0{1 + i % 3}-{10 + i % 15} 00:00:00", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "site_name string, meter_customer_code string, meter_type string, slot_start string, energy_kwh double")
    path = os.path.join(folder(), "t")
    IO.write_series(df.withColumn("slot_start", F.col("slot_start").cast("timestamp")), path)
    got = spark.read.parquet(path).select("meter_customer_code", F.trunc("slot_start", "month").alias("m"), F.input_file_name().alias("f"))
    assert got.groupBy("meter_customer_code", "m").agg(F.countDistinct("f").alias("n")).where("n > 1").count() == 0


def test_merge_years_refuses_what_does_not_fit(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, v double")
    b = spark.createDataFrame([(2, "abc", "x")], "id int, v string, late string")
    assert R.cast_failures(b, a.schema).where("n_failed > 0").collect() == [("v", 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.merge_years([a, b]).collect()
    ok = R.merge_years([a, b.withColumn("v", F.lit("3"))])
    assert ok.columns == ["id", "v", "late"] and sorted(ok.collect()) == [(1, 2.0, None), (2, 3.0, "x")]


def test_unknown_table_is_not_released(spark):
    df = spark.createDataFrame([("secret",)], "name string")
    with pytest.raises(ValueError, match="no release rules"):
        R.release_table(df, "custmers", "salt")
    assert R.release_table(df, "exchange_rates", "salt", unlisted=True).count() == 1


def clean(spark, rows):
    df = spark.createDataFrame(rows, "site_name string, meter_customer_code string, slot_start string, energy_kwh double")
    return df.select("site_name", "meter_customer_code", F.lit("customer").alias("meter_type"), F.lit("observed").alias("imputation_method"),
                     F.col("slot_start").cast("timestamp").alias("slot_start"), "energy_kwh")


def test_load_profile_keeps_sites_without_an_offset(spark):
    c = clean(spark, [("a", "m", "2024-01-01 00:00:00", 1.0), ("b", "m", "2024-01-01 00:00:00", 2.0)])
    off = spark.createDataFrame([("a", 1), ("b", None)], "site_name string, utc_offset int")
    with pytest.raises(Exception, match="no UTC offset for site b"):
        P.load_profile(c, off).collect()
    got = P.load_profile(c, off, default_offset=2).where("level = 'hour'").orderBy("grp").collect()
    assert [(r.grp, r["mean"]) for r in got] == [(1, 1.0), (2, 2.0)]


def test_load_profile_selects_a_code_at_its_own_site(spark):
    c = clean(spark, [("a", "m", "2024-01-01 00:00:00", 1.0), ("b", "m", "2024-01-01 00:00:00", 2.0)])
    off = spark.createDataFrame([("a", 0), ("b", 0)], "site_name string, utc_offset int")
    pick = spark.createDataFrame([("b", "m")], "site_name string, meter_customer_code string")
    assert [r["mean"] for r in P.load_profile(c, off, pick).where("level = 'hour'").collect()] == [2.0]


def test_asof_and_history_cross_buckets(spark):
    right = spark.createDataFrame([("k", "2024-01-05", 1, 10.0), ("k", "2024-01-05", 2, 11.0), ("k", "2024-04-01", 1, 12.0),
                                   ("k", "2024-06-01", 1, 12.0), (None, "2024-01-01", 1, 99.0)], "k string, t string, o int, v double")
    right = right.withColumn("t", F.col("t").cast("timestamp"))
    left = spark.createDataFrame([(1, "k", "2024-01-01"), (2, "k", "2024-01-05"), (3, "k", "2024-03-01"), (4, "k", "2024-04-01"),
                                  (5, "k", "2024-12-01"), (6, "x", "2024-12-01"), (7, None, "2024-12-01"), (8, "k", None)], "id int, k string, ts string")
    left = left.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.v for r in Q.asof_join(left, right, "k", "ts", "t", ["v"], ["o"]).collect()}
    assert got == {1: None, 2: 11.0, 3: 11.0, 4: 12.0, 5: 12.0, 6: None, 7: None, 8: None}
    h = Q.tariff_changes(right.where("k = 'k'"), "k", "t", "v", ["o"]).orderBy("t", "o").collect()
    assert [(r.v, r.prev_rate) for r in h] == [(10.0, None), (11.0, 10.0), (12.0, 11.0)]
