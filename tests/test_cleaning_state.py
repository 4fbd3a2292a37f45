"""Cleaning from batch to batch against cleaning all at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridmeter.operators import clean as C
from gridmeter.streaming import cleaning as S
from gridmeter.streaming import ingest as I

KINDS = "meter_customer_code string, meter_type string, heartbeatStart timestamp, energy double, state int, meter_tariff_name string, row_id bigint"


def heartbeats(n=160, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for meter in ("a", "b", "c", "lone", None):
        t, e = start, 0.0
        for _ in range(1 if meter == "lone" else n // 4):
            t += dt.timedelta(minutes=15 * rng.choice([0, 1, 1, 1, 1, 2, 7, 40, 150]))
            e = 0.0 if rng.random() < 0.04 else e + rng.randrange(300) / 100
            rows.append((meter, rng.choice(["customer", "customer", "pue"]) if meter == "c" else "customer",
                         None if rng.random() < 0.03 else t, None if rng.random() < 0.03 else e, rng.choice([1, 1, 1, 1, 1, 0, None]),
                         rng.choice([None, "", "x", "y"]) if meter != "b" else None, len(rows)))
    return rows


def result(df):
    return sorted((r.meter_customer_code, r.meter_type, r.slot_start, round(r.energy_kwh, 6), r.imputation_method, r.tariff) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark):
    df = spark.createDataFrame(heartbeats(), KINDS)
    return df, result(C.clean_readings(df, order_extra=["row_id"]))


@pytest.mark.parametrize("seed", [3, 4])
def test_any_split_in_any_order(spark, whole, tmp_path, seed):
    """Rows of every day in every batch; one batch runs twice, one is empty."""
    df, want = whole
    rng = random.Random(seed)
    parts = [df.where(F.pmod(F.hash("row_id", F.lit(seed)), F.lit(3)) == k) for k in range(3)] + [df.limit(0)]
    rng.shuffle(parts)
    folder = str(tmp_path / "state")
    for n, part in enumerate(parts):
        S.apply_batch(spark, folder, part, n, order_extra=["row_id"])
        if n == 1:
            S.apply_batch(spark, folder, part, n, order_extra=["row_id"])
    got = result(S.series(spark, folder))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)
    # pairs made and taken back leave the valid pairs
    net = S._read(spark, folder, "changes").groupBy("meter_customer_code", "meter_type", "t_prev", "t_next", "diff").agg(F.sum("sign").alias("n")).where("n <> 0")
    t = C.transitions(C.coerce_readings(df, order_extra=["row_id"]), order_extra=["energy", "row_id"]).where("valid")
    pairs = sorted(tuple(r) for r in t.select("meter_customer_code", "meter_type", "t_prev", "t_next", "diff").collect())
    assert sorted(tuple(r)[:5] for r in net.collect() for _ in range(r.n)) == pairs


def test_a_late_file_takes_back_the_pair_that_it_splits(spark, tmp_path):
    t = [dt.datetime(2024, 1, d, h) for d, h in ((1, 0), (1, 6), (3, 0), (5, 0))]
    row = lambda i, e: ("m", "customer", t[i], e, 1, "x", i)
    folder = str(tmp_path / "state")
    S.apply_batch(spark, folder, spark.createDataFrame([row(0, 0.0), row(3, 9.0)], KINDS), 0)
    S.apply_batch(spark, folder, spark.createDataFrame([row(1, 1.0), row(2, 4.0)], KINDS), 1)
    said = lambda k: sorted((r.t_prev, r.t_next, r.diff, r.sign) for r in S.changes(spark, folder, k).collect())
    assert said(0) == [(t[0], t[3], 9.0, 1)]
    assert said(1) == sorted([(t[0], t[3], 9.0, -1), (t[0], t[1], 1.0, 1), (t[1], t[2], 3.0, 1), (t[2], t[3], 5.0, 1)])
    # a batch that touches other days alone changes nothing of these
    S.apply_batch(spark, folder, spark.createDataFrame([("m", "customer", dt.datetime(2024, 2, 1), 9.5, 1, "x", 9)], KINDS), 2)
    assert said(2) == [(t[3], dt.datetime(2024, 2, 1), 0.5, 1)]


def test_stream_of_files(spark, whole, tmp_path):
    df, want = whole
    for k in (2, 0, 1):
        df.where(F.pmod("row_id", F.lit(3)) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    s = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "state")
    S.clean_stream(spark, s, folder, order_extra=["row_id"])
    got = result(S.series(spark, folder))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]


def test_ingest_reads_the_touched_dates_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5)) for i in range(20)] + [(None, None), (None, dt.datetime(2024, 1, 1)), (50, None)]
    d = spark.createDataFrame(rows, "id long, ts timestamp")
    d.withColumn("_date", F.to_date("ts")).write.partitionBy("_date").parquet(f"{out}/_batch=0")
    seen = I.written_ids(spark, out, 1, "id", [dt.date(2024, 1, 2), None])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "_date" in filters and "_batch" in filters
    assert sorted((r._seen, str(r._day)) for r in seen.collect()) == [(1, "2024-01-02"), (6, "2024-01-02"), (11, "2024-01-02"), (16, "2024-01-02"), (50, "None")]


def test_ingest_keeps_rows_without_id_or_time(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    one = [(1, day, 1.0), (1, day, 1.0), (None, day, 2.0), (None, day, 2.0), (None, None, 3.0), (2, None, 4.0)]
    two = [(1, day, 1.0), (1, dt.datetime(2024, 1, 2), 5.0), (None, day, 2.0), (2, None, 4.0), (None, None, 3.0)]
    kinds = "id long, ts timestamp, v double"
    for n, rows in enumerate((one, two)):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    read = lambda: spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted(r.v for r in I.ingest_stream(spark, read(), "id", "ts").collect())
    assert got == [1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 4.0, 5.0]
    usage = {(r.id, r.window_start): (r.total, r.n) for r in I.daily_usage_stream(spark, read(), "id", "ts", "v").collect()}
    assert usage[None, None] == (6.0, 2) and usage[2, None] == (8.0, 2) and usage[1, day] == (3.0, 3)


def test_ingest_goes_on_after_files_without_rows(spark, tmp_path):
    """A part's first file is empty where its first split holds no rows."""
    kinds = "id long, ts timestamp, v double"
    for n, rows in enumerate(([], [(1, dt.datetime(2024, 1, 1), 1.0)], [], [(1, dt.datetime(2024, 1, 1), 1.0), (1, dt.datetime(2024, 1, 2), 2.0)])):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    s = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert sorted(r.v for r in I.ingest_stream(spark, s, "id", "ts").collect()) == [1.0, 2.0]


def test_gaps_over_a_table_whose_first_split_lacks_the_latest_rows(spark, tmp_path):
    from gridmeter.plans import q_stream as Q

    rows = [(i, dt.datetime(2024, 1, 1 + i // 40, i % 20), i % 3, "e", float(i), None) for i in range(1, 160)]
    early = [r for r in rows if r[1].day < 3 and r[0] % 13]
    for k, part in enumerate((early, [r for r in rows if r not in early])):
        spark.createDataFrame(part, Q.EVENTS_SCHEMA).coalesce(1).write.mode("append").option("compression", ("none", "gzip")[k]).parquet(str(tmp_path / "events.parquet"))
    lay = spark.read.parquet(str(tmp_path / "events.parquet")).select(F.spark_partition_id().alias("p"), "event_id").collect()
    assert {r.event_id for r in lay if r.p == 0} == {r[0] for r in early}
    got = Q.q_stream_ingest_gaps(spark, str(tmp_path))
    assert sorted(r.value for r in got.collect()) == [r[4] for r in rows]
    assert got.where("event_id IS NULL").count() == sum(r[0] % 11 == 0 for r in rows)
    assert got.where("ts IS NULL").count() == sum(r[0] % 13 == 0 for r in rows)


def test_rows_tell_the_first_of_each_day(spark, tmp_path):
    """The ends of a day come from the rows as written, without ordering them again."""
    folder = str(tmp_path / "state")
    S.apply_batch(spark, folder, spark.createDataFrame(heartbeats(40), KINDS), 0, order_extra=["row_id"])
    rows, ends = S._read(spark, folder, "rows"), S._read(spark, folder, "ends")
    day = lambda d, t: sorted((r.meter_customer_code, r.meter_type, r._b, r.t) for r in d.select(*S.KEYS, "_b", F.col(t).alias("t")).collect())
    assert day(rows.where("_first"), "heartbeatStart") == day(ends, "_first.t")
    assert day(rows.where("_n IS NULL"), "heartbeatStart") == day(ends, "_last.t")
