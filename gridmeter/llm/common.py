"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize  # noqa: F401  (re-exported)

#: ASCII white space; ``WORD`` is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that also tells which of them are null."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(c), F.col(c).isNull())])


def one_row(df: DataFrame, *keys: Column) -> DataFrame:
    """One row of each group of equal keys, the first by a hash; no task holds a group."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, row_hash(df)).alias("_row")).select("_row.*")


#: the folders that ``shared_folder`` has named in this process
NAMED: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``."""
    NAMED.append(f"{checkpoint_dir(spark).rstrip('/')}/gridmeter-{name}-{uuid.uuid4().hex}")
    return NAMED[-1]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this operator's own, on whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
