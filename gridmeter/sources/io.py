"""Sources and sinks (SRC1-SRC10, SNK1-SNK6).

Readers return lazy DataFrames so that Catalyst prunes columns and pushes
filters into the scan; the database readers split the scan into
half-open time ranges that run as parallel tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ------------------------------------------------------------------ sources
def read_table(spark: SparkSession, name: str, *, path: str | None = None, url: str | None = None,
               props: dict | None = None, schema: T.StructType | None = None,
               columns=None) -> DataFrame:
    """Full table (SRC1) from Parquet (``path``) or a JDBC database (``url``),
    optionally a column list (SRC4); an explicit schema avoids inference
    (all-NULL columns would otherwise read as INT)."""
    if url:
        df = spark.read.jdbc(url, name, properties=props or {})
    else:
        r = spark.read.schema(schema) if schema is not None else spark.read
        df = r.parquet(path)
    return df.select(*columns) if columns else df


def read_query(spark: SparkSession, url: str, query: str, props: dict | None = None, predicates=None, fetchsize: int = 200_000) -> DataFrame:
    """Projected database query (SRC2); ``predicates`` over its columns read it in as
    many tasks."""
    p = {"fetchsize": str(fetchsize), **(props or {})}
    if predicates:
        return spark.read.jdbc(url, f"({query}) q", predicates=list(predicates), properties=p)
    return spark.read.format("jdbc").options(url=url, query=query, **p).load()


def year_predicates(column: str, years, rest: bool = False) -> list[str]:
    """Half-open ``[y, y+1)`` ranges, one per year (SRC3); with ``rest`` one more for
    NULL and all other times, so that every row is in exactly one."""
    years = sorted(set(years))
    p = [f"{column} >= '{y}-01-01' AND {column} < '{y + 1}-01-01'" for y in years]
    if rest:
        p.append(" OR ".join([f"{column} IS NULL", *(["NOT (" + " OR ".join(f"({x})" for x in p) + ")"] if p else [f"{column} IS NOT NULL"])]))
    return p


def range_predicates(column: str, counts, rows: int) -> list[str]:
    """Ranges of about ``rows`` rows each, from (day or month, count) pairs (SRC1, SRC3).

    ``counts``: the first day of each period (as text or date) and its rows, in any
    order; periods that are not named belong to the range before them.  The first
    range has no lower and the last no upper end, and NULL has a range of its own, so
    every row is in exactly one whatever the counts say: they only even out the tasks.
    """
    starts, held = [], 0
    for period, n in sorted((str(p)[:10], n) for p, n in counts if p is not None):
        if held and held + n > rows:
            starts.append(period)
            held = 0
        held += n
    if not starts:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(starts, starts[1:])]
    return [f"{column} < '{starts[0]}'", *inner, f"{column} >= '{starts[-1]}'", f"{column} IS NULL"]


def read_by_ranges(spark: SparkSession, url: str, table: str, ts: str, counts, rows: int = 5_000_000, props: dict | None = None,
                   fetchsize: int = 200_000) -> DataFrame:
    """Database scan of ranges of like size, a task each (SRC1, SRC3)."""
    p = dict(props or {})
    p.setdefault("fetchsize", str(fetchsize))
    return spark.read.jdbc(url, table, predicates=range_predicates(ts, counts, rows), properties=p)


def read_by_years(spark: SparkSession, url: str, table: str, ts: str, years,
                  props: dict | None = None, fetchsize: int = 200_000) -> DataFrame:
    """Time-range partitioned database scan: one task per year, and one for NULL and
    other times (SRC3)."""
    p = dict(props or {})
    p.setdefault("fetchsize", str(fetchsize))
    return spark.read.jdbc(url, table, predicates=year_predicates(ts, years, rest=True), properties=p)


def read_sites(spark: SparkSession, paths, name_pattern: str = r"^(.*)\.parquet$",
               schema: T.StructType | None = None, col: str = "site_name") -> DataFrame:
    """Multi-file scan; the site name is taken from each file name (SRC5)."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    df = r.parquet(*paths) if isinstance(paths, (list, tuple)) else r.parquet(paths)
    return df.withColumn(col, F.regexp_extract(F.col("_metadata.file_name"), name_pattern, 1))


def read_parquet_ns(spark: SparkSession, path: str, ts_cols) -> DataFrame:
    """Parquet written with nanosecond timestamps (pandas/Arrow defaults),
    which Spark rejects: the session reads them as int64 nanoseconds
    (``spark.sql.legacy.parquet.nanosAsLong``; left set for the scan) and
    they become microsecond TIMESTAMPs (H-4)."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(path)
    return df.withColumns({c: F.timestamp_micros(F.floor(F.col(c) / F.lit(1000)).cast("long"))
                           for c in ts_cols})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV with header (SRC7)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns (number and list) and file bytes per table (SRC8, SRC9).

    File bytes are summed over the distinct files of the scan (from the
    ``_metadata`` column); the row count reads no data columns.  For tables
    that are plain Parquet, :func:`gridmeter.sources.footers.table_profile`
    reads the footers alone.
    """
    parts = []
    for name, df in tables.items():
        # rows per file, then rows and bytes over the files: one aggregate chain, no join
        per_file = (df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
                      .groupBy("f", "s").agg(F.count(F.lit(1)).alias("n")))
        parts.append(per_file.agg(F.sum("n").alias("n_rows"), F.sum("s").alias("bytes"))
                             .select(F.lit(name).alias("table_name"), "n_rows", "bytes",
                                     F.lit(len(df.columns)).alias("n_columns"),
                                     F.lit(",".join(df.columns)).alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ sinks
def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", dry_run: bool = False):
    """Single-table Parquet write (SNK1); ``dry_run`` only counts (SNK6)."""
    if dry_run:
        return df.count()
    df.write.mode(mode).parquet(path)
    return None


def write_partitioned(df: DataFrame, path: str, keys=("site_name", "year"), mode: str = "overwrite",
                      dry_run: bool = False):
    """Parquet routed by keys into ``key=value`` folders (SNK2, SNK3).

    Rows are rebalanced by the keys: AQE splits a large key into as many tasks
    as its bytes need and joins small ones.  A ``dynamic`` partition overwrite
    only replaces the partitions present.
    """
    keys = list(keys)
    if dry_run:
        return df.count()
    (df.hint("rebalance", *keys).write.mode(mode)
       .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))
    return None


def write_series(df: DataFrame, path: str, keys=("site_name",),
                 sort=("meter_customer_code", "meter_type", "slot_start"), mode: str = "overwrite"):
    """Clean series per site (SNK3): partitioned by the site; a meter's rows of a
    month lie in one file, in time order (good compression and row-group
    pruning by meter and time), and a large site spreads over meters and months."""
    keys = list(keys)
    *meter, ts = sort
    (df.repartition(*keys, *meter, F.trunc(ts, "month")).sortWithinPartitions(*keys, *sort)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite"):
    """CSV with header (SNK4)."""
    df.write.mode(mode).option("header", True).csv(path)


def written_partitions(spark: SparkSession, path: str, keys) -> list[tuple] | None:
    """Key values (as text, None for NULL) of the ``key=value`` folders under
    ``path``, from the file listing; None where ``path`` does not exist.  Errors
    of the store are not taken for an empty table."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    level = [(top, ())]
    for k in keys:
        below = []
        for folder, values in level:
            for s in fs.listStatus(folder):
                name = s.getPath().getName()
                if s.isDirectory() and name.startswith(f"{k}="):
                    v = name[len(k) + 1:]
                    below.append((s.getPath(), (*values, None if v == "__HIVE_DEFAULT_PARTITION__" else plain(v))))
        level = below
    return [v for _, v in level]


def incremental_write(df: DataFrame, path: str, keys, overwrite: bool = False, dry_run: bool = False):
    """Resumable write (SNK5): partitions whose keys already exist under
    ``path``, NULL keys included, are skipped unless ``overwrite``; new
    partitions are appended."""
    keys = list(keys)
    spark = df.sparkSession
    if overwrite:
        return write_partitioned(df, path, keys, "overwrite", dry_run)
    done = written_partitions(spark, path, keys)
    todo = df
    if done:
        d = spark.createDataFrame(done, ", ".join(f"_w{i} string" for i in range(len(keys))))
        same = [F.col(k).cast("string").eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)]
        todo = df.join(d, same, "left_anti")
    if dry_run:
        return todo.count()
    todo.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)
    return None
