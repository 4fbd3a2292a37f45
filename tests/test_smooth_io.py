"""LOWESS properties and the sources/sinks (write, partitioned, incremental, CSV)."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from gridmeter.operators import smooth as SM
from gridmeter.sources import io as IO


def test_lowess_reproduces_a_line(spark):
    x = np.arange(30, dtype=float)
    rows = [("a", int(v), float(3.0 + 2.0 * v)) for v in x] + [("b", int(v), 1.0) for v in x[:5]]
    df = spark.createDataFrame(rows, "g string, m int, y double")
    out = SM.lowess(df, "g", "m", "y").collect()
    assert {r.g for r in out} == {"a"}            # group b has < 11 points
    assert all(abs(r.smooth - r.y) < 1e-9 for r in out)


def test_lowess_is_robust_to_an_outlier(spark):
    x = np.arange(40, dtype=float)
    y = 0.5 * x + 1.0 + 0.3 * np.sin(x)
    y[20] += 100.0
    df = spark.createDataFrame([("a", int(v), float(w)) for v, w in zip(x, y)], "g string, m int, y double")
    out = sorted(SM.lowess(df, "g", "m", "y", frac=0.3).collect(), key=lambda r: r.m)
    fit = np.array([r.smooth for r in out])
    assert abs(fit[20] - (0.5 * 20 + 1.0)) < 1.0
    assert np.max(np.abs(np.delete(fit - (0.5 * x + 1.0), 20))) < 1.0


def test_partitioned_and_incremental_write(spark):
    out = tempfile.mkdtemp(prefix="gm-io-", dir="/tmp")
    path = os.path.join(out, "t")
    df = spark.createDataFrame([("s1", 2020, 1.0), ("s1", 2021, 2.0), ("s2", 2020, 3.0)],
                               "site_name string, year int, v double")
    assert IO.write_partitioned(df, path, dry_run=True) == 3
    IO.write_partitioned(df, path)
    assert spark.read.parquet(path).count() == 3
    more = spark.createDataFrame([("s1", 2020, 9.0), ("s3", 2022, 4.0)], "site_name string, year int, v double")
    # (s1, 2020) exists -> skipped; (s3, 2022) is new
    assert IO.incremental_write(more, path, ["site_name", "year"], dry_run=True) == 1
    IO.incremental_write(more, path, ["site_name", "year"])
    got = sorted((r.site_name, r.year, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("s1", 2020, 1.0), ("s1", 2021, 2.0), ("s2", 2020, 3.0), ("s3", 2022, 4.0)]
    # overwrite replaces only the partitions present
    IO.incremental_write(more, path, ["site_name", "year"], overwrite=True)
    got = sorted((r.site_name, r.year, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("s1", 2020, 9.0), ("s1", 2021, 2.0), ("s2", 2020, 3.0), ("s3", 2022, 4.0)]


def test_csv_roundtrip_and_single_write(spark):
    out = tempfile.mkdtemp(prefix="gm-io-", dir="/tmp")
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, x double")
    IO.write_csv(df, os.path.join(out, "c"))
    back = IO.read_csv(spark, os.path.join(out, "c"), df.schema)
    assert sorted(back.collect(), key=lambda r: r.k) == sorted(df.collect(), key=lambda r: r.k)
    IO.write_parquet(df, os.path.join(out, "p"))
    assert IO.write_parquet(df, os.path.join(out, "q"), dry_run=True) == 2
    assert not os.path.exists(os.path.join(out, "q"))


def test_read_sites_names_from_files(spark):
    d = tempfile.mkdtemp(prefix="gm-io-", dir="/tmp")
    for name, v in (("one", 1), ("two", 2)):
        spark.createDataFrame([(v,)], "v int").toPandas().to_parquet(f"{d}/{name}.parquet")
    s = IO.read_sites(spark, [f"{d}/one.parquet", f"{d}/two.parquet"], col="site")
    assert sorted(s.select("site", "v").collect()) == [("one", 1), ("two", 2)]


def test_table_profile_counts(spark):
    d = "/root/testdata/sf0.001"
    t = IO.table_profile({"region": spark.read.parquet(f"{d}/region.parquet")}).collect()[0]
    assert t.n_rows == 5 and t.n_columns == 2 and t.bytes == os.path.getsize(f"{d}/region.parquet")


def test_year_predicates():
    assert IO.year_predicates("ts", [2018, 2019]) == [
        "ts >= '2018-01-01' AND ts < '2019-01-01'", "ts >= '2019-01-01' AND ts < '2020-01-01'"]


def test_release_table_and_series_writer(spark):
    from datetime import datetime

    from gridmeter.operators import release as R
    pay = spark.createDataFrame(
        [("A1", " M-Pesa ", datetime(2020, 1, 1), "x"), ("B2", "mpesa", None, "y"),
         ("C3", "Cash", datetime(2001, 1, 1), "z")],
        "customerAccountNumber string, paymentProcessor string, transactionDatetime timestamp, phoneNumber string")
    out = R.release_table(pay, "paymentconfirmations", "salt").collect()
    assert len(out) == 1 and "phoneNumber" not in out[0].asDict()
    assert out[0].paymentProcessor == "m-pesa" and len(out[0].customerAccountNumber) == 64
    al = R.clean_payments(pay, 2015, aliases={"m-pesa": "mpesa"}).collect()
    assert [r.paymentProcessor for r in al] == ["mpesa"]
    path = os.path.join(tempfile.mkdtemp(prefix="gm-io-", dir="/tmp"), "s")
    s = spark.createDataFrame([("s1", "c", "customer", datetime(2024, 1, 1), 1.0)],
                              "site_name string, meter_customer_code string, meter_type string, "
                              "slot_start timestamp, energy_kwh double")
    IO.write_series(s, path)
    assert spark.read.parquet(path).where("site_name = 's1'").count() == 1


def test_read_nanosecond_timestamps(spark):
    from datetime import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq
    d = tempfile.mkdtemp(prefix="gm-io-", dir="/tmp")
    t = pa.table({"ts": pa.array([1_700_000_000_123_456_789, None], pa.timestamp("ns")),
                  "v": pa.array([1.0, 2.0])})
    pq.write_table(t, os.path.join(d, "x.parquet"), coerce_timestamps=None, version="2.6")
    got = IO.read_parquet_ns(spark, d, ["ts"]).orderBy("v").collect()
    assert got[0].ts == datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert got[1].ts is None


def test_cli_jobs(spark):
    from gridmeter import cli
    from gridmeter.plans import bindings as B
    d = "/root/testdata/sf0.001"
    base = tempfile.mkdtemp(prefix="gm-cli-", dir="/tmp")
    r = B.readings(spark, d).join(
        B.customers(spark, d).select(F.col("customerAccountNumber").alias("meter_customer_code"),
                                     F.col("projectName").alias("site_name")), "meter_customer_code", "inner")
    r.write.parquet(f"{base}/readings")
    assert cli.main(["clean", "--readings", f"{base}/readings", "--out", f"{base}/clean"]) == 0
    a = spark.read.parquet(f"{base}/clean")
    assert a.count() > 0 and "site_name" in a.columns
    # resumable: a second run adds nothing
    cli.main(["clean", "--readings", f"{base}/readings", "--out", f"{base}/clean"])
    assert spark.read.parquet(f"{base}/clean").count() == a.count()
    B.site_map(spark, d).write.option("header", True).csv(f"{base}/site_map")
    assert cli.main(["monthly", "--clean", f"{base}/clean", "--site-map", f"{base}/site_map",
                     "--out", f"{base}/monthly"]) == 0
    assert spark.read.option("header", True).csv(f"{base}/monthly").count() > 0


def test_release_materialized(spark):
    from gridmeter.session import _WRITTEN, materialize, release_materialized
    df = materialize(spark.range(10), "t")
    path = _WRITTEN[-1]
    assert df.count() == 10 and os.path.exists(path.replace("file:", ""))
    assert release_materialized(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))
