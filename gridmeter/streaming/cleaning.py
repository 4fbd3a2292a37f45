"""Cleaning that goes on from batch to batch (G1-G4 over files that arrive in any order).

A state folder holds, written by each micro-batch under its own ``_batch``:

    rows/     the heartbeats of every (meter, day) that the batch touched, whole, each
              with its successor inside the day and whether it is the day's first
              (partitioned by day)
    ends/     first and last heartbeat of those days
    links/    the pair that leads from a day to the meter's next day with data, for the
              days whose link the batch changed (a touched day, or the day before one)
    changes/  valid pairs that the batch made (sign 1) or took back (sign -1)
    profile/  signed sums and counts of the clean pairs by meter and slot of the day
    tariffs/  counts of tariff names by customer

A day's rows and link are those of its latest batch; sums and counts of all batches are
added up.  A late file thus rewrites the days that it touches and nothing else, and takes
back exactly the pairs that it splits.  ``series`` is the clean series of all heartbeats so
far, ``changes`` what a batch corrects in it.  A batch that runs again overwrites its own
folders and reads earlier ones alone, so it counts once.

Sums are kept to 12 decimals (as decimals, so what is added and taken back cancels).  No
step holds a whole meter: windows run over (meter, day), and over one row for each of a
meter's days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import slot_of_day
from ..operators import clean as C
from .ingest import MOST_DATES, _exists

KEYS = ["meter_customer_code", "meter_type"]
_METER = "meter_customer_code string, meter_type string"
_POINT = "struct<t: timestamp, e: double, s: double>"
SCHEMAS = {
    "rows": f"{_METER}, heartbeatStart timestamp, energy double, state double, _n {_POINT}, _first boolean, _b bigint, _batch bigint",
    "ends": f"{_METER}, _b bigint, _first {_POINT}, _last {_POINT}, _batch bigint",
    "links": f"{_METER}, _b bigint, _p {_POINT}, _n {_POINT}, _batch bigint",
    "changes": f"{_METER}, t_prev timestamp, t_next timestamp, diff double, n_slots bigint, clean boolean, sign bigint, _batch bigint",
    "profile": f"{_METER}, tod int, total decimal(38,12), n bigint, _batch bigint",
    "tariffs": "meter_customer_code string, tariff string, n bigint, _batch bigint",
}


def _read(spark: SparkSession, folder: str, table: str, schema=None) -> DataFrame:
    schema = schema or T._parse_datatype_string(SCHEMAS[table])
    if not _exists(spark, f"{folder}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}")


def _latest(d: DataFrame) -> DataFrame:
    """Of each (meter, day) the row of the latest batch."""
    w = Window.partitionBy(*KEYS, "_b").orderBy(F.desc("_batch"))
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _days(ends: DataFrame) -> DataFrame:
    return _latest(ends).select(*KEYS, "_b", "_batch")


def _point() -> Column:
    return F.struct(F.col("heartbeatStart").alias("t"), F.col("energy").alias("e"), F.col("state").alias("s"))


def _pairs(d: DataFrame) -> DataFrame:
    """Pairs with both ends: meter, day, and the columns that ``clean.judged`` takes."""
    ends = [F.col(f"_{side}.{c}").alias(f"{c}_{name}") for side, name in (("p", "prev"), ("n", "next")) for c in ("t", "e", "s")]
    return d.where("_n IS NOT NULL").select(*KEYS, "_b", *ends)


def apply_batch(spark: SparkSession, folder: str, batch: DataFrame, batch_id: int, order_extra=(), slot_minutes: int = C.SLOT_MINUTES,
                bucket_seconds: int = C.DAY_SECONDS) -> None:
    """Take a batch of heartbeats (``clean.coerce_readings``' columns) into the state.

    ``order_extra``: columns that order equal (time, energy), as in ``clean.clean_readings``.
    """
    new = C.coerce_readings(batch, order_extra=order_extra)
    order = ["heartbeatStart", "energy", *order_extra]
    payload = [*order, "state"]
    kinds = {f.name: f for f in new.schema.fields}
    rows_schema = T.StructType([*(kinds[c] for c in order_extra if c != "energy"), *T._parse_datatype_string(SCHEMAS["rows"]).fields])

    def write(d: DataFrame, table: str, *by: str) -> DataFrame:
        w = (d.hint("rebalance", *by) if by else d).write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{folder}/{table}/_batch={batch_id}")
        return here(table)

    def before(table: str, schema=None) -> DataFrame:
        return _read(spark, folder, table, schema).where(F.col("_batch") < batch_id)

    def here(table: str, schema=None) -> DataFrame:
        return _read(spark, folder, table, schema).where(F.col("_batch") == batch_id)

    # 1. the touched days, whole: what is known of them and what comes in
    new = new.withColumn("_b", C._bucket(F.col("heartbeatStart"), bucket_seconds))
    touched = new.select(*KEYS, "_b").distinct()
    days = [r[0] for r in touched.select("_b").distinct().limit(MOST_DATES + 1).collect()]
    known = before("rows", rows_schema)
    if len(days) <= MOST_DATES:
        known = known.where(F.col("_b").isin(days))      # literals prune the partitions
    known = known.join(touched, [*KEYS, "_b"], "left_semi").join(_days(before("ends")), [*KEYS, "_b", "_batch"], "left_semi")
    every = known.select(*KEYS, "_b", *payload).unionByName(new.select(*KEYS, "_b", *payload))
    w = Window.partitionBy(*KEYS, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    every = every.withColumns({"_n": F.lead(_point()).over(w), "_first": F.row_number().over(w) == 1})
    rows = write(every.select(*payload, *KEYS, "_n", "_first", "_b"), "rows", "_b")

    # 2. first and last heartbeat of each touched day, by the order of the rows just written
    side = rows.where("_first OR _n IS NULL").withColumn("_p", _point())
    ends = (side.groupBy(*KEYS, "_b")
                .agg(F.max(F.when(F.col("_first"), F.struct("_p"))).alias("_f"), F.max(F.when(F.col("_n").isNull(), F.struct("_p"))).alias("_l"))
                .select(*KEYS, "_b", F.col("_f._p").alias("_first"), F.col("_l._p").alias("_last")))
    touched = write(ends, "ends").select(*KEYS, "_b")    # the same days, without another pass over the batch

    # 3. links of the touched days and of the days before them
    ends = _latest(_read(spark, folder, "ends").where(F.col("_batch") <= batch_id)).join(touched.select(*KEYS).distinct(), KEYS, "left_semi")
    by_day = Window.partitionBy(*KEYS).orderBy("_b")
    links = ends.withColumns({"_n": F.lead("_first").over(by_day), "_next": F.lead("_batch").over(by_day)})
    links = write(links.where((F.col("_batch") == batch_id) | (F.col("_next") == batch_id)).select(*KEYS, "_b", F.col("_last").alias("_p"), "_n"), "links")

    # 4. pairs that the batch made and took back
    old_rows = (before("rows").where(F.col("_b").isin(days)) if len(days) <= MOST_DATES else before("rows")) \
        .join(touched, [*KEYS, "_b"], "left_semi").join(_days(before("ends")), [*KEYS, "_b", "_batch"], "left_semi")
    old_links = _latest(before("links")).join(links.select(*KEYS, "_b"), [*KEYS, "_b"], "left_semi")
    rows, old_rows = rows.withColumn("_p", _point()), old_rows.withColumn("_p", _point())
    signed = reduce(DataFrame.unionByName, [_pairs(d).withColumn("sign", F.lit(s)) for d, s in ((rows, 1), (links, 1), (old_rows, -1), (old_links, -1))])
    changes = (C.judged(signed, slot_minutes).where("valid").groupBy(*KEYS, "t_prev", "t_next", "diff", "n_slots", "clean")
                .agg(F.sum("sign").alias("sign")).where("sign <> 0"))
    changes = write(changes, "changes")

    # 5. what that changes in the sums
    write(changes.where("clean").groupBy(*KEYS, slot_of_day("t_prev", slot_minutes).alias("tod"))
                 .agg(F.sum((F.col("diff").cast("decimal(38,12)") * F.col("sign").cast("decimal(10,0)")).cast("decimal(38,12)")).cast("decimal(38,12)").alias("total"),
                      F.sum("sign").alias("n")), "profile")
    write(new.groupBy("meter_customer_code", F.col("meter_tariff_name").alias("tariff")).agg(F.count(F.lit(1)).alias("n")), "tariffs")


def modal_tariff(spark: SparkSession, folder: str, unknown: str = "Unknown") -> DataFrame:
    """(meter_customer_code, tariff) as ``clean.modal_tariff`` gives it, from the counts."""
    n = _read(spark, folder, "tariffs").groupBy("meter_customer_code", "tariff").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("meter_customer_code")
    best = w.orderBy(F.col("tariff").isNull(), F.desc("n"), "tariff")
    n = n.withColumns({"_any": F.max(F.length("tariff") > 0).over(w), "_r": F.row_number().over(best)}).where("_r = 1")
    return n.select("meter_customer_code", F.when(F.col("_any"), F.col("tariff")).otherwise(F.lit(unknown)).alias("tariff"))


def profile(spark: SparkSession, folder: str, slot_minutes: int = C.SLOT_MINUTES) -> DataFrame:
    """``clean.daily_profile`` of all clean pairs so far, from the sums."""
    p = _read(spark, folder, "profile").groupBy(*KEYS, "tod").agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n")).where("n > 0")
    return C.profile_of_means(p.select(*KEYS, "tod", (F.col("total") / F.col("n")).alias("m")), KEYS, slot_minutes)


def series(spark: SparkSession, folder: str, slot_minutes: int = C.SLOT_MINUTES) -> DataFrame:
    """The clean series of all heartbeats so far, as ``clean.clean_readings`` gives it."""
    rows = _read(spark, folder, "rows").join(_days(_read(spark, folder, "ends")), [*KEYS, "_b", "_batch"], "left_semi").withColumn("_p", _point())
    t = C.judged(_pairs(rows).unionByName(_pairs(_latest(_read(spark, folder, "links")))), slot_minutes).where("valid")
    meta = (_read(spark, folder, "changes").select(*KEYS).distinct().join(profile(spark, folder, slot_minutes), KEYS, "left")
            .join(modal_tariff(spark, folder), "meter_customer_code", "left"))
    return C.expand(t, meta, KEYS, slot_minutes)


def changes(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Valid pairs that a batch made (sign 1) or took back (sign -1)."""
    return _read(spark, folder, "changes").where(F.col("_batch") == batch_id).drop("_batch")


def clean_stream(spark: SparkSession, stream: DataFrame, folder: str, **options) -> None:
    """Take every file of a stream into the state (``trigger(availableNow=True)``)."""
    from .ingest import _run

    _run(stream, lambda batch, batch_id: apply_batch(spark, folder, batch, batch_id, **options), folder)
