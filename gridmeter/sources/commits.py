"""Partitioned tables with a commit marker for each partition (SNK2, SNK3, SNK5).

    path/attempt=<id>/site_name=S/year=Y/part-*.parquet    what an attempt wrote
    path/_commits/<sequence>-<attempt>/<partition>         one empty file for each
                                                           partition of the attempt
    path/_commits/_schema                                  the table's schema

A job writes under an attempt of its own and sets the markers only when all its
files are there, so a job that is killed leaves files that nobody reads: readers
and reruns go by markers alone.  A partition with several markers is that of the
highest sequence, which is how an overwrite replaces it without a moment in which
neither is there.  Markers name partitions, so the driver handles as many names as
there are partitions and never rows.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import written_partitions


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path and a function that makes paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, make = _store(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(make(folder))] if fs.exists(make(folder)) else []


def _marker(values) -> str:
    """A partition's file name: its key values, ``-`` for NULL, ``=`` before others."""
    return ",".join("-" if v is None else "=" + quote(v, safe="") for v in values)


def _values(marker: str) -> tuple:
    return tuple(None if v == "-" else unquote(v[1:]) for v in marker.split(","))


def committed(spark: SparkSession, path: str) -> dict[tuple, str]:
    """Key values (as text) of the committed partitions and the attempt that holds each."""
    found: dict[tuple, str] = {}
    for name in sorted(n for n in _names(spark, f"{path}/_commits") if n[0].isdigit()):
        attempt = name.split("-", 1)[1]
        found |= {_values(m): attempt for m in _names(spark, f"{path}/_commits/{name}")}
    return found


def write_attempt(df: DataFrame, path: str, keys) -> str:
    """Write a frame under a new attempt, which no reader sees yet; returns its id."""
    attempt = uuid.uuid4().hex
    keys = list(keys)
    df.hint("rebalance", *keys).write.mode("errorifexists").partitionBy(*keys).parquet(f"{path}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, attempt: str, keys, schema: T.StructType) -> list[tuple]:
    """Set the markers of an attempt's partitions; returns their key values.

    The markers are set in a folder that gets its name when all are there (a rename,
    which stores do at once), so an attempt's partitions are committed together.
    """
    fs, make = _store(spark, path)
    done = written_partitions(spark, f"{path}/attempt={attempt}", keys) or []
    last = max([int(n.split("-")[0]) for n in _names(spark, f"{path}/_commits") if n[0].isdigit()], default=-1)
    own = f"{path}/_commits/.{attempt}"
    fs.mkdirs(make(own))
    if not fs.exists(make(f"{path}/_commits/_schema")):
        f = fs.create(make(f"{path}/_commits/_schema"), True)
        f.write(bytearray(schema.json().encode()))
        f.close()
    for values in done:
        fs.create(make(f"{own}/{_marker(values)}"), False).close()
    if not fs.rename(make(own), make(f"{path}/_commits/{last + 1:08d}-{attempt}")):
        raise OSError(f"the markers of attempt {attempt} could not be set")
    return done


def committed_write(df: DataFrame, path: str, keys, overwrite: bool = False, dry_run: bool = False) -> list[tuple] | int:
    """Write the partitions that are not committed yet (all of them with ``overwrite``).

    Returns the key values of the partitions written, with ``dry_run`` the number of rows.
    Equal keys are told apart null-safely.
    """
    spark, keys = df.sparkSession, list(keys)
    done = [] if overwrite else list(committed(spark, path))
    todo = df
    if done:
        d = spark.createDataFrame(done, ", ".join(f"_w{i} string" for i in range(len(keys))))
        todo = df.join(d, [F.col(k).cast("string").eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)], "left_anti")
    if dry_run:
        return todo.count()
    return commit(spark, path, write_attempt(todo, path, keys), keys, df.schema)


def read_committed(spark: SparkSession, path: str, keys) -> DataFrame:
    """The committed partitions, with the schema of the first write."""
    fs, make = _store(spark, path)
    if not fs.exists(make(f"{path}/_commits/_schema")):
        raise FileNotFoundError(f"nothing has been committed under {path}")
    size = fs.getFileStatus(make(f"{path}/_commits/_schema")).getLen()
    f = fs.open(make(f"{path}/_commits/_schema"))
    schema = T.StructType.fromJson(json.loads(bytes(f.readNBytes(size)).decode()))
    f.close()
    plain = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else plain(v)
    places = ["/".join([path, f"attempt={a}", *(f"{k}={folder(v)}" for k, v in zip(keys, values))])
              for values, a in sorted(committed(spark, path).items(), key=str)]
    if not places:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    return spark.read.schema(whole).option("basePath", path).parquet(*places).select(*schema.names)


def sweep(spark: SparkSession, path: str, keep=()) -> int:
    """Delete the files of attempts that hold no committed partition, but for those in
    ``keep`` (attempts that are still being written); returns how many attempts went."""
    fs, make = _store(spark, path)
    used = {*committed(spark, path).values(), *keep}
    gone = [n for n in _names(spark, path) if n.startswith("attempt=") and n[8:] not in used]
    for n in gone:
        fs.delete(make(f"{path}/{n}"), True)
    return len(gone)
