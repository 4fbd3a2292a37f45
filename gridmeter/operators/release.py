"""Anonymised release of the source tables (PRJ1-PRJ7, FLT1, FLT3, FLT4, FLT11, J5, U1, U2).

All transforms are column expressions or broadcast joins of small lookup
lists; nothing goes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import neq_nullsafe, not_in_nullsafe


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """Drop listed columns; names not in the frame are ignored (PRJ1)."""
    return df.drop(*[c for c in cols if c in df.columns])


def allow_columns(df: DataFrame, cols) -> DataFrame:
    """Keep only the listed columns, in list order (PRJ2)."""
    return df.select(*[c for c in cols if c in df.columns])


# "Blank" follows Python's ``str.strip()``: the characters for which
# ``str.isspace()`` holds (built from that rule, not listed by hand).
_PY_SPACE = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
_NONBLANK = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in _PY_SPACE) + "]"


def pseudonym(col, salt: str):
    """SHA-256 hex of ``str(value) || salt``; NULL stays NULL and values
    that are empty or only whitespace stay as they are (PRJ3)."""
    s = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    return F.when(s.rlike(_NONBLANK), F.sha2(F.concat(s, F.lit(salt)), 256)).otherwise(s)


def pseudonymize(df: DataFrame, cols, salt: str) -> DataFrame:
    return df.withColumns({c: pseudonym(c, salt) for c in cols if c in df.columns})


def normalize_types(df: DataFrame) -> DataFrame:
    """decimal -> double, all-NULL (void) -> string (PRJ5)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.NullType):
            out.append(F.col(f.name).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def cast_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a target schema; missing columns become NULL (PRJ6).

    A value that does not fit its type is an error (ANSI cast), not a NULL;
    :func:`cast_failures` counts such values beforehand.
    """
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def cast_failures(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column_name, n_failed): values that :func:`cast_to_schema` would refuse."""
    both = [f for f in schema.fields if f.name in df.columns]
    bad = [F.sum(F.when(F.col(f.name).isNotNull() & F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").isNull(), 1)
                  .otherwise(0)).cast("long") for f in both]
    return (df.agg(F.array(*bad).alias("_n"))
              .select(F.posexplode("_n").alias("_i", "n_failed"))
              .select(F.element_at(F.array(*[F.lit(f.name) for f in both]), F.col("_i") + 1).alias("column_name"),
                      F.coalesce("n_failed", F.lit(0)).alias("n_failed")))


def clean_payments(df: DataFrame, min_year: int = 2015, ts="transactionDatetime",
                   processor="paymentProcessor", aliases: dict | None = None) -> DataFrame:
    """Drop NULL / zero dates (year < min_year); processor lower + trim (FLT1).

    ``aliases`` (off by default, S16) maps further spellings after lower/trim,
    e.g. ``{"m-pesa": "mpesa"}``; it is a fixed list applied as a CASE.
    """
    p = F.trim(F.lower(F.col(processor)))
    if aliases:
        m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        p = F.coalesce(m[p], p)
    return (df.where(F.col(ts).isNotNull() & (F.year(ts) >= min_year))
              .withColumn(processor, p))


def release_table(df: DataFrame, table: str, salt: str, min_year: int = 2015,
                  unlisted: bool = False) -> DataFrame:
    """Release one source table: drop its listed columns, pseudonymise its
    listed columns, then the per-table cleaning (payments) (PRJ1, PRJ3, FLT1).

    A table that no rule names is refused (a misspelt name would be released
    raw) unless ``unlisted`` says that it has nothing to hide.
    """
    from .. import release_spec as RS
    ruled = {*RS.DROP_COLS, *RS.PSEUDO_COLS, *RS.PAYMENT_TABLES, "minigridprojects", "vrmgeneration",
             "meteringbasestations"}
    if table not in ruled and not unlisted:
        raise ValueError(f"no release rules for table {table!r}")
    out = pseudonymize(drop_columns(df, RS.DROP_COLS.get(table, [])), RS.PSEUDO_COLS.get(table, []), salt)
    if table in RS.PAYMENT_TABLES:
        out = clean_payments(out, min_year)
    if table == "minigridprojects":
        out = drop_test_sites(out)
    if table == "vrmgeneration":
        out = exclude_values(out, "Project_Name", RS.EXCLUDED_GENERATION_SITES)
    if table == "meteringbasestations":
        out = allow_columns(out, RS.STATION_SAFE_COLS)
    return out


def drop_test_sites(df: DataFrame, lat="lat", lon="long") -> DataFrame:
    """Keep rows unless both coordinates are 0; NULLs kept (FLT3, S11)."""
    return df.where(neq_nullsafe(lat, 0) | neq_nullsafe(lon, 0))


def exclude_values(df: DataFrame, col: str, values) -> DataFrame:
    """NOT IN a fixed list; NULL rows kept (FLT4)."""
    return df.where(not_in_nullsafe(col, values))


def uuid_prefix(col: str):
    """File stem that starts like a UUID (consumption rule, FLT11)."""
    return F.coalesce(F.col(col).rlike("^[0-9a-f]{8}-"), F.lit(False))


def uuid_shape(col: str):
    """File stem of length 36 with 4 dashes (carbon rule, FLT11)."""
    c = F.col(col)
    return F.coalesce((F.length(c) == 36) &
                      (F.length(c) - F.length(F.regexp_replace(c, "-", "")) == 4), F.lit(False))


def without_uuid_sites(df: DataFrame, col: str) -> DataFrame:
    """Rows whose site file is named like a UUID left out, by either rule (FLT11)."""
    return df.where(~(uuid_prefix(col) | uuid_shape(col)))


def safe_name(col):
    """File-safe site name: '/' -> '-', ' ' -> '_'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(c, "/", "-"), " ", "_")


def site_lookup(stations: DataFrame) -> DataFrame:
    """Site id -> station name, legacy ids included.

    The reference fills a dict with the current ids first and then the
    legacy ids, so a legacy id overrides and, among equals, the last
    station wins; here "last" is the largest station id (a total order).
    """
    cur = stations.select(F.col("meteringSiteId").alias("site"), "meteringBaseStation",
                          F.lit(0).alias("_p"), F.col("meteringSiteId").alias("_o"))
    old = (stations.where(F.col("olderMeteringSiteIds").isNotNull())
                   .select(F.explode(F.split("olderMeteringSiteIds", ",")).alias("site"),
                           "meteringBaseStation", F.lit(1).alias("_p"),
                           F.col("meteringSiteId").alias("_o"))
                   .withColumn("site", F.trim("site"))
                   .where(F.length("site") > 0))
    u = cur.unionByName(old)
    w = Window.partitionBy("site").orderBy(F.desc("_p"), F.desc("_o"))
    return (u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
             .select("site", F.col("meteringBaseStation").alias("site_name")))


def resolve_site(readings: DataFrame, stations: DataFrame, site="site") -> DataFrame:
    """Add ``site_name`` right after ``site``; unmapped ids -> 'unknown' (J5, PRJ4).

    The lookup has one row per site id (stations and their legacy ids); AQE
    broadcasts it by its measured size or shuffles both sides.
    """
    lk = site_lookup(stations).withColumnRenamed("site", site)
    j = readings.join(lk, site, "left")
    cols = []
    for c in readings.columns:
        cols.append(F.col(c))
        if c == site:
            cols.append(F.coalesce(F.col("site_name"), F.lit("unknown")).alias("site_name"))
    return j.select(*cols)


def merge_years(frames) -> DataFrame:
    """Union of yearly pieces (U2, PRJ6): a column has the type of the first piece
    that has it, and a column that only a later year has is kept."""
    frames = list(frames)
    fields = {}
    for f in (f for df in frames for f in df.schema.fields):
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    schema = T.StructType(list(fields.values()))
    return reduce(lambda a, b: a.unionByName(b), [cast_to_schema(f, schema) for f in frames])


def union_sites(frames) -> DataFrame:
    """Union by column name, columns missing in a piece become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(frames))
