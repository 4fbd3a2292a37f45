"""Data-quality and coverage reports (A17-A23, X2-X7) and the as-of tariff join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .series import running_sum


def is_blank(col: str):
    """NULL or empty after trimming (FLT16)."""
    return F.col(col).isNull() | (F.trim(F.col(col).cast("string")) == "")


def null_blank_profile(df: DataFrame, cols) -> DataFrame:
    """Rows and NULL-or-blank count per column (FLT16, A22), one row per column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [
        F.sum(F.when(is_blank(c), 1).otherwise(0)).cast("long").alias(f"_b_{c}") for c in cols]
    wide = df.agg(*aggs)
    long = wide.select("n_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("n_null_or_blank")) for c in cols
    ])).alias("_s"))
    return long.select(F.col("_s.column").alias("column"), "n_rows", F.col("_s.n_null_or_blank"))


def most_frequent(df: DataFrame, key: str, value: str, out: str = "value") -> DataFrame:
    """Most frequent non-NULL value per key by count (A10, O6); ties -> the
    smallest value (a documented total order; the reference takes the
    first one met)."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    # one row per (key, distinct value): the window is over a key's few values
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    return (c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
             .select(key, F.col(value).alias(out), "n"))


def counts_by_key(df: DataFrame, keys) -> DataFrame:
    """count(*) by key(s), largest first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def count_and_distinct(df: DataFrame, by, distinct_col: str) -> DataFrame:
    """count(*) and count(DISTINCT c) by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.countDistinct(distinct_col).alias("n_distinct"))


def coverage(df: DataFrame, ts: str, key: str, by=(), extra_aggs=()) -> DataFrame:
    """min/max timestamp, rows, distinct keys and further aggregates, optionally by group."""
    return df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                               F.count(F.lit(1)).alias("n_rows"),
                               F.countDistinct(key).alias("n_keys"), *extra_aggs)


def state_share(df: DataFrame, state="state", by=()) -> DataFrame:
    """Share of each state code among the rows of its group.

    Group totals are a second small aggregate joined back (no global
    window, which would put every row in one task).
    """
    by = list(by)
    c = df.groupBy(*by, state).agg(F.count(F.lit(1)).alias("n"))
    if by:
        tot = c.groupBy(*by).agg(F.sum("n").alias("_t"))
        j = c.join(tot, by, "inner")
    else:
        tot = c.agg(F.sum("n").alias("_t")).withColumn("_k", F.lit(1))
        j = c.withColumn("_k", F.lit(1)).join(tot, "_k", "inner").drop("_k")
    return j.withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def completeness(df: DataFrame, key: str, ts: str, slot_minutes: int = 15, by=()) -> DataFrame:
    """Readings per (group, key, day) over the slots of a day."""
    spd = 24 * 60 // slot_minutes
    return (df.groupBy(*by, key, F.to_date(ts).alias("day"))
              .agg(F.count(F.lit(1)).alias("n_readings"))
              .withColumn("completeness", F.col("n_readings") / F.lit(float(spd))))


def completeness_matrix(df: DataFrame, site: str, key: str, ts: str, slot_minutes: int = 15, unit: str = "month") -> DataFrame:
    """Expected and present slots by site and month or year (X2): site, period,
    n_keys, expected, present, completeness.

    A key is expected in every slot from its first reading to its last, so a
    period between them without a reading is a cell with 0 present.  A slot
    counts once however many readings it holds.  Rows without a key or time are
    left out, a NULL site is a site.

    Present slots are bits of a (site, key, day) row, which partial aggregation
    combines before the shuffle; spans, calendar and sums work on those rows.
    """
    spd = 24 * 60 // slot_minutes
    words = -(-spd // 60)
    second = F.unix_seconds(F.col(ts))
    d = (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
           .select(F.col(site).alias("site"), F.col(key).alias("key"), F.floor(second / F.lit(86400)).alias("_day"),
                   F.floor(F.pmod(second, F.lit(86400)) / F.lit(slot_minutes * 60)).cast("int").alias("_s")))
    bit = lambda w: F.when(F.floor(F.col("_s") / 60) == w, F.expr("shiftleft(1L, _s % 60)")).otherwise(F.lit(0).cast("long"))
    days = (d.groupBy("site", "key", "_day")
             .agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), *[F.bit_or(bit(w)).alias(f"_w{w}") for w in range(words)])
             .select("site", "key", "_day", (F.col("_day") * spd + F.col("_lo")).alias("_a"), (F.col("_day") * spd + F.col("_hi")).alias("_b"),
                     sum(F.bit_count(f"_w{w}") for w in range(words)).cast("long").alias("_present")))
    days = materialize(days, "present-slots")
    start = lambda c: F.trunc(F.date_from_unix_date(F.col(c).cast("int")), unit)
    spans = days.groupBy("site", "key").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    first, last = (F.trunc(F.date_from_unix_date(F.floor(F.col(c) / F.lit(spd)).cast("int")), unit) for c in ("_a", "_b"))
    cells = spans.select("site", "_a", "_b", F.explode(F.sequence(first, last, F.expr(f"INTERVAL 1 {unit}"))).alias("period"))
    begin = F.unix_date("period").cast("long") * spd
    end = F.unix_date(F.add_months("period", 12 if unit == "year" else 1)).cast("long") * spd
    inside = F.least(F.col("_b"), end - 1) - F.greatest(F.col("_a"), begin) + 1
    # expected and present slots meet in one aggregate
    e = cells.select("site", "period", F.lit(1).cast("long").alias("_k"), inside.alias("_e"), F.lit(0).cast("long").alias("_p"))
    p = days.select("site", start("_day").alias("period"), F.lit(0).cast("long").alias("_k"), F.lit(0).cast("long").alias("_e"), F.col("_present").alias("_p"))
    return (e.unionByName(p).groupBy("site", "period")
             .agg(F.sum("_k").alias("n_keys"), F.sum("_e").alias("expected"), F.sum("_p").alias("present"))
             .withColumn("completeness", F.col("present") / F.col("expected")))


def outage_intervals(df: DataFrame, key: str, ts: str, up, order_extra=(), slot_minutes: int = 15, bucket: str = "day") -> DataFrame:
    """Outages as intervals (X3): key, outage_start, outage_end, slots, ended.

    An outage is a maximal run of down readings of a key (``up``: a condition;
    rows for which it is NULL, and those without a key or time, are left out),
    from its first reading to the next up reading, or to the key's last reading
    where none follows (``ended`` is then false).

    Each reading is compared with the one before inside (key, day); a day's first
    reading with the last of the key's day before, from a table of one row for
    each day.  The k-th start and the k-th end are an outage; they are numbered
    inside days plus a prefix over days, so no task holds a key.
    """
    d = (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_t"), (~up).cast("int").alias("_down"),
                                                                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_extra)])
           .where("_down IS NOT NULL").withColumn("_bk", F.date_trunc(bucket, F.col("_t"))))
    order = ["_t", *[f"_o{i}" for i in range(len(order_extra))]]
    inside = Window.partitionBy("_k", "_bk").orderBy(*order)
    d = d.withColumns({"_prev": F.lag("_down").over(inside), "_i": F.row_number().over(inside),
                       "_n": F.count(F.lit(1)).over(Window.partitionBy("_k", "_bk"))})
    d = materialize(d, "states")
    days = Window.partitionBy("_k").orderBy("_bk")
    ends = (d.where("_i = _n").select("_k", "_bk", F.lag("_down").over(days).alias("_before")))
    j = d.join(ends, ["_k", "_bk"]).withColumn("_prev", F.coalesce(F.when(F.col("_i") == 1, F.col("_before")).otherwise(F.col("_prev")), F.lit(0)))
    turns = j.where("_down <> _prev").select("_k", "_t", "_down", *order[1:])
    turns = materialize(turns, "turns")
    numbered = running_sum(turns, ["_k"], "_t", [*order[1:]], "_down", "_outage")
    lasts = d.groupBy("_k").agg(F.max("_t").alias("_last"))
    o = numbered.groupBy("_k", "_outage").agg(F.max(F.when(F.col("_down") == 1, F.col("_t"))).alias("outage_start"),
                                              F.max(F.when(F.col("_down") == 0, F.col("_t"))).alias("_end"))
    o = o.join(lasts, "_k").withColumn("outage_end", F.coalesce("_end", "_last"))
    seconds = F.unix_seconds("outage_end") - F.unix_seconds("outage_start")
    return o.select(F.col("_k").alias(key), "outage_start", "outage_end", F.bround(seconds / F.lit(slot_minutes * 60.0), 0).cast("long").alias("slots"),
                    F.col("_end").isNotNull().alias("ended"))


def _by_month(df: DataFrame, by, start: str, end: str, out: str) -> DataFrame:
    """Seconds of the intervals in each month that they touch: by, ym, ``out``."""
    m = df.select(*by, start, end, F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begin, stop = F.unix_micros(F.col("_m").cast("timestamp")), F.unix_micros(F.add_months("_m", 1).cast("timestamp"))
    return m.select(*by, F.date_format("_m", "yyyy-MM").alias("ym"), ((F.least(at(end), stop) - F.greatest(at(start), begin)) / F.lit(1e6)).alias(out))


def uptime_from_outages(df: DataFrame, outages: DataFrame, site: str, key: str, ts: str) -> DataFrame:
    """Uptime by site and month as covered time (X3): site, ym, covered_s, down_s, uptime.

    A key is covered from its first reading to its last; an outage takes its own
    time away.  Months in which nothing is covered have no uptime.  ``df`` holds one
    site for each key.
    """
    d = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    spans = d.groupBy(key).agg(F.first(site).alias("site"), F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    spans = materialize(spans, "spans")
    covered = _by_month(spans, ["site"], "_a", "_b", "covered_s").withColumn("down_s", F.lit(0.0))
    down = _by_month(outages.join(spans.select(key, "site"), key), ["site"], "outage_start", "outage_end", "down_s").withColumn("covered_s", F.lit(0.0))
    return (covered.unionByName(down).groupBy("site", "ym").agg(F.sum("covered_s").alias("covered_s"), F.sum("down_s").alias("down_s"))
            .withColumn("uptime", F.try_divide(F.col("covered_s") - F.col("down_s"), F.col("covered_s"))))


def uptime_by_month(df: DataFrame, ts: str, up, by) -> DataFrame:
    """Mean of an up/down indicator by group and month."""
    return (df.groupBy(*by, F.date_format(ts, "yyyy-MM").alias("ym"))
              .agg(F.avg(F.when(up, 1.0).otherwise(0.0)).alias("uptime"),
                   F.count(F.lit(1)).alias("n")))


def grid_losses(clean: DataFrame, site="site_name", ts="slot_start") -> DataFrame:
    """Totaliser energy vs the sum over customer meters by site and slot."""
    e = F.col("energy_kwh")
    mt = F.col("meter_type")
    g = clean.groupBy(site, ts).agg(
        F.sum(F.when(mt == "totalizer", e)).alias("totalizer_kwh"),
        F.sum(F.when(mt == "customer", e)).alias("customer_kwh"))
    return (g.where(F.col("totalizer_kwh").isNotNull() & F.col("customer_kwh").isNotNull())
             .withColumn("loss_kwh", F.col("totalizer_kwh") - F.col("customer_kwh")))


def cutoff_flags(df: DataFrame, inst="truePowerInst", avg="truePowerAvg") -> DataFrame:
    """Heartbeats of meters cut off while drawing: inst = 0 and avg > 0."""
    return df.where((F.col(inst) == 0) & (F.col(avg) > 0))


def tariff_changes(tariffs: DataFrame, station: str, ts: str, rate: str, order_extra=(),
                   bucket: str = "month") -> DataFrame:
    """Tariff history per station: rows whose rate differs from the previous
    one (X4).

    The previous row is looked up inside (station, bucket); a bucket's first row
    takes the last rate of the station's bucket before, from a table with one
    row per station and bucket.  No task holds a station.
    """
    d = tariffs.withColumn("_bk", F.date_trunc(bucket, F.col(ts)))
    inside = Window.partitionBy(station, "_bk")
    up = inside.orderBy(ts, *order_extra)
    d = (d.withColumn("prev_rate", F.lag(rate).over(up)).withColumn("_i", F.row_number().over(up))
          .withColumn("_n", F.count(F.lit(1)).over(inside)))
    ends = (d.where(F.col("_i") == F.col("_n"))
             .select(F.col(station).alias("_st"), F.col("_bk").alias("_b"),
                     F.lag(rate).over(Window.partitionBy(station).orderBy("_bk")).alias("_before")))
    j = d.join(ends, d[station].eqNullSafe(ends["_st"]) & d["_bk"].eqNullSafe(ends["_b"]))
    j = j.withColumn("prev_rate", F.when(F.col("_i") == 1, F.col("_before")).otherwise(F.col("prev_rate")))
    return (j.where(F.col("prev_rate").isNull() | (F.col("prev_rate") != F.col(rate)))
             .drop("_bk", "_i", "_n", "_st", "_b", "_before"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              values, order_extra=(), bucket: str = "month") -> DataFrame:
    """For every left row, the values of the latest right row of the same key
    with ``right_ts <= left_ts`` (X1); left rows before the first right row,
    or without a key or timestamp, get NULLs.

    Both sides are unioned and ordered inside (key, bucket) windows, where the
    last right row so far is carried along (among equal times the last in
    ``order_extra`` order wins).  What a bucket carries over from earlier ones
    comes from a table with one row per (key, bucket).  Each side is read and
    shuffled once (what the windows give is written, as two branches read it),
    pairs are never formed, and a hot key spreads over its buckets.  Rows without
    a key or time match nothing and pass beside the windows.
    """
    values = list(values)
    names = left.columns
    row, got = F.struct(*[F.col(c) for c in names]), F.struct(*[F.col(v) for v in values])
    extra = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_extra)]
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), row.alias("_row"))
    b = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), *extra, got.alias("_got"))
    placed = F.col("_k").isNotNull() & F.col("_ts").isNotNull()
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_bk", F.date_trunc(bucket, F.col("_ts")))
    # a row without a key or time has a window of its own: it matches nothing
    u = u.where(placed | (F.col("_side") == 1)).withColumn("_spare", F.when(~placed, F.monotonically_increasing_id()))
    inside = Window.partitionBy("_k", "_bk", "_spare")
    up = inside.orderBy("_ts", "_side", *[f"_o{i}" for i in range(len(extra))])
    u = (u.withColumn("_own", F.last("_got", True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_i", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(inside))
          .select("_k", "_ts", "_bk", "_side", "_row", "_own", (F.col("_i") == F.col("_n")).alias("_end")))
    u = materialize(u, "asof")
    earlier = Window.partitionBy("_k").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    ends = (u.where(placed & F.col("_end"))
             .select(F.col("_k").alias("_ek"), F.col("_bk").alias("_ebk"), F.last("_own", True).over(earlier).alias("_before")))
    u = u.where("_side = 1")
    j = u.join(ends, (u["_k"] == ends["_ek"]) & (u["_bk"] == ends["_ebk"]), "left")
    v = F.when(placed, F.coalesce("_own", "_before"))
    return j.select("_row", v.alias("_v")).select("_row.*", *[F.col("_v")[c].alias(c) for c in values])
