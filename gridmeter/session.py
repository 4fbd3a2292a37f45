"""Session setup shared by the library, tests and the bench.

Everything the library needs from the session is SQL configuration that a
cluster operator may already have set; we only fill in what is missing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on for correct results (not tuning knobs).
REQUIRED_CONF = {
    # Readings are UTC; month/hour buckets are UTC (only the load profile
    # shifts to site-local time, by an explicit offset).
    "spark.sql.session.timeZone": "UTC",
}

# Tuning defaults; applied only when the session does not set them already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot meter/site partition is split and its join partner replicated
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # reducers sized by bytes, not by the number of cores
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of finished queries are removed with their frames
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need on an existing session."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset,
    a folder in the warehouse, which a cluster shares as well."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df, name: str = "frame", **options):
    """Cut the lineage of a frame that several branches reuse: write it once
    as a Parquet table under the shared ``spark.checkpoint.dir`` and read it
    back.  Executor loss then costs no recomputation of the upstream
    shuffles, and the frame is computed once (``Dataset.checkpoint`` would
    compute an unpersisted frame twice).  ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gridmeter-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


_WRITTEN: list[str] = []


def materialized() -> int:
    """How many folders this process has materialized and not released."""
    return len(_WRITTEN)


def release_materialized(spark: SparkSession, keep: int = 0) -> int:
    """Delete the folders this process materialized (call when the frames
    that read them are no longer used, e.g. after a job), but for the first
    ``keep``; returns the count."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while len(_WRITTEN) > keep:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "gridmeter") -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **REQUIRED_CONF}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.ui.enabled", os.environ.get("GRIDMETER_UI", "false"))
    b = b.config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("GRIDMETER_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    prepare(spark)
    return spark
