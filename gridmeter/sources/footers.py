"""Answers from Parquet footers alone (SRC8, SRC9, A19).

The V2 Parquet source turns ``count(*)``, ``min`` and ``max`` without a filter into
a read of the files' footers (``PushedAggregation`` in the plan): no column is read.
Its settings are those of a session of its own, so the caller's stay as they are.
Whole numbers, floats, booleans and dates have bounds in footers that Spark trusts;
for other types ``ranges`` reads the column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

_CONF = {
    "spark.sql.parquet.aggregatePushdown": "true",
    # Parquet by the V2 source; the others stay as they are by default
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
}


def footer_session(spark: SparkSession) -> SparkSession:
    s = prepare(spark.newSession())
    for k, v in _CONF.items():
        s.conf.set(k, v)
    return s


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the Parquet files under a path, from the store's listing."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    total = 0
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if name.endswith(".parquet") and not name.startswith(("_", ".")):
            total += f.getLen()
    return total


def table_profile(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_name, n_rows, bytes, n_columns, columns of each table (SRC8, SRC9)."""
    s = footer_session(spark)
    parts = []
    for name, path in paths.items():
        d = s.read.parquet(path)
        parts.append(d.agg(F.count(F.lit(1)).alias("n_rows"))
                      .select(F.lit(name).alias("table_name"), "n_rows", F.lit(file_bytes(s, path)).cast("long").alias("bytes"),
                              F.lit(len(d.columns)).alias("n_columns"), F.lit(",".join(d.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


def ranges(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> DataFrame:
    """table_name, n_rows, first_key, last_key for ``{name: (path, key column)}``."""
    s = footer_session(spark)
    return reduce(DataFrame.unionByName, [
        s.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
         .select(F.lit(name).alias("table_name"), "n_rows", "first_key", "last_key") for name, (path, key) in tables.items()])
