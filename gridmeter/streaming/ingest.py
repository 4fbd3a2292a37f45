"""Structured Streaming ingest of heartbeat files.

Site files arrive in any order of time (a backfill brings 2025 before 2018), so
nothing is dropped for being late.  Each micro-batch is written with
``foreachBatch`` into a folder of its own batch id, overwritten if the batch runs
again, so every file counts once whatever the trigger takes:

- ``ingest_stream`` drops copies of a heartbeat (same id and date) inside the batch and
  against what earlier batches wrote for the batch's dates: only those partitions are
  read.  Rows without an id are nobody's copy and all stay; rows without a time have a
  partition of their own;
- ``daily_usage_stream`` writes partial sums per window, added up when read; rows without
  a time are a window of their own (NULL).

Both run with ``trigger(availableNow=True)``; output and checkpoints live under the
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


#: dates of a batch that are told one by one; a batch with more reads all dates
MOST_DATES = 4_000


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/gridmeter-stream-{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def _run(stream: DataFrame, write, out: str) -> None:
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", out + "-ckpt")
               .trigger(availableNow=True).start())
    q.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written_ids(spark: SparkSession, out: str, before: int, id_col: str, dates: list | None, schema: T.StructType | None = None) -> DataFrame:
    """(_seen, _day): the ids that batches before ``before`` wrote, of ``dates`` (None: all) alone.

    The dates are literals, so that they prune partitions when the read is planned.
    ``schema``: that of the folder; without files (batches without rows write none) it
    cannot be told from them.
    """
    read = spark.read.option("basePath", out)
    seen = (read.schema(schema) if schema else read).parquet(out).where(F.col("_batch") < before)
    if dates is not None:
        day = F.col("_date").isin([d for d in dates if d is not None])
        seen = seen.where(day | F.col("_date").isNull() if None in dates else day)
    return seen.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_seen"), F.col("_date").alias("_day"))


def ingest_stream(spark: SparkSession, stream: DataFrame, id_col: str, ts_col: str,
                  out: str | None = None) -> DataFrame:
    """Deduplicate by id and date and append to Parquet; returns the written table.

    An id on two dates is two heartbeats, whichever batches they come in.
    """
    out = out or _scratch(spark, "ingest")
    names = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_date", T.DateType())])

    def write(batch: DataFrame, batch_id: int):
        b = batch.withColumn("_date", F.to_date(ts_col))
        known = b.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "_date"])
        if _exists(spark, out):
            dates = [r[0] for r in b.select("_date").distinct().limit(MOST_DATES + 1).collect()]
            seen = written_ids(batch.sparkSession, out, batch_id, id_col, dates if len(dates) <= MOST_DATES else None, schema)
            known = known.join(seen, (known[id_col] == seen["_seen"]) & known["_date"].eqNullSafe(seen["_day"]), "left_anti")
        b = known.unionByName(b.where(F.col(id_col).isNull()))
        b.write.mode("overwrite").partitionBy("_date").parquet(f"{out}/_batch={batch_id}")

    _run(stream, write, out)
    # a stream without files has written nothing
    if not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(schema).option("basePath", out).parquet(out).select(*names)


def daily_usage_stream(spark: SparkSession, stream: DataFrame, key: str, ts_col: str, value: str,
                       window: str = "1 day", out: str | None = None) -> DataFrame:
    """Sum and count of ``value`` per key and tumbling window over all rows of the stream."""
    out = out or _scratch(spark, "usage")
    width = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {window})").first()[0]
    start = F.timestamp_micros(F.unix_micros(ts_col) - F.pmod(F.unix_micros(ts_col), F.lit(width)))

    def write(batch: DataFrame, batch_id: int):
        (batch.groupBy(F.col(key), start.alias("window_start"))      # window() would leave NULL times out
              .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
              .write.mode("overwrite").parquet(f"{out}/_batch={batch_id}"))

    _run(stream, write, out)
    if not _exists(spark, out):
        kind = dict(stream.dtypes)[key]
        return spark.createDataFrame([], f"`{key}` {kind}, window_start timestamp, total double, n bigint")
    t = spark.read.option("basePath", out).parquet(out)
    return t.groupBy(key, "window_start").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
