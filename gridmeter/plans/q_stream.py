"""Registered queries: streaming ingest and LOWESS of tenure curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_half_up as r_, sql_round as rs
from ..operators import smooth as SM
from ..operators import usage as U
from ..session import materialize
from ..streaming import cleaning as CL
from ..streaming import ingest as ST
from . import bindings as B
from .q_clean import SQL as CLEAN_SQL
from .q_usage import _monthly2_c

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events_stream(spark, d):
    s = ST.read_stream(spark, d, EVENTS_SCHEMA, glob="events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_ingest(spark, d):
    t = ST.ingest_stream(spark, _events_stream(spark, d), "event_id", "ts")
    return t.select("event_id", "user_id", "ts", r_("value", 2).alias("value"))


def q_stream_daily_usage(spark, d):
    t = ST.daily_usage_stream(spark, _events_stream(spark, d), "user_id", "ts", "value")
    return t.select("user_id", "window_start", r_("total", 2).alias("total"), "n")


def _events(spark, d):
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{d}/events.parquet")


def _gaps(spark, d):
    """Events some of which lack their id or time."""
    e = _events(spark, d)
    return e.withColumns({"event_id": F.when(F.pmod("event_id", F.lit(11)) != 0, F.col("event_id")),
                          "ts": F.when(F.pmod("event_id", F.lit(13)) != 0, F.col("ts"))})


def _parts(e, ts, orders=(3, 2, 1, 0)):
    """The rows by quarters of their time span, in the given order; those without a time come with the first."""
    lo, hi = e.agg(F.min(ts), F.max(ts)).first()
    for n, k in enumerate(orders):
        if lo is None:
            yield e if n == 0 else e.limit(0)
            continue
        a, b = lo + (hi - lo) * k / 4, lo + (hi - lo) * (k + 1) / 4
        here = (F.col(ts) >= F.lit(a)) & ((F.col(ts) <= F.lit(b)) if k == 3 else (F.col(ts) < F.lit(b)))
        yield e.where(here | F.col(ts).isNull() if n == 0 else here)


def _backfill(spark, e):
    """The events as files that arrive latest first, one file for each trigger."""
    folder = ST._scratch(spark, "backfill")
    for n, part in enumerate(_parts(e, "ts")):
        part.write.parquet(f"{folder}/p{n}")
    s = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").parquet(folder))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_ingest_backfill(spark, d):
    t = ST.ingest_stream(spark, _backfill(spark, _events(spark, d)), "event_id", "ts")
    return t.select("event_id", "user_id", "ts", r_("value", 2).alias("value"))


def q_stream_daily_usage_backfill(spark, d):
    t = ST.daily_usage_stream(spark, _backfill(spark, _events(spark, d)), "user_id", "ts", "value")
    return t.select("user_id", "window_start", r_("total", 2).alias("total"), "n")


def q_stream_ingest_gaps(spark, d):
    """A backfill of which some rows lack their id or time: every one of them stays."""
    t = ST.ingest_stream(spark, _backfill(spark, _gaps(spark, d)), "event_id", "ts")
    return t.select("event_id", "user_id", "ts", r_("value", 2).alias("value"))


def q_stream_usage_gaps(spark, d):
    """Daily usage of such a backfill, the rows without a time as a day of their own."""
    t = ST.daily_usage_stream(spark, _backfill(spark, _gaps(spark, d)), "user_id", "ts", "value")
    return t.select("user_id", "window_start", r_("total", 2).alias("total"), "n")


def q_clean_series_by_batches(spark, d):
    """The clean series from heartbeats that arrive in four parts out of order (G1-G4):
    each part goes into the cleaning state, which corrects what earlier parts gave."""
    folder = ST._scratch(spark, "cleaning")
    for n, part in enumerate(_parts(materialize(B.readings(spark, d), "readings"), "heartbeatStart", (2, 0, 3, 1))):
        CL.apply_batch(spark, folder, part, n, order_extra=["row_id"])
    return CL.series(spark, folder).select("meter_customer_code", "meter_type", "slot_start", r_("energy_kwh", 6).alias("energy_kwh"),
                                           "imputation_method", "tariff")


def q_tenure_lowess(spark, d):
    t = U.tenure_curve(_monthly2_c(spark, d), "monthly_kwh", ["country"], 10)
    s = SM.lowess(t, "country", "months_since_first", "mean", frac=0.2)
    return s.select("country", "months_since_first", r_("mean", 4).alias("mean"),
                    r_("smooth", 4).alias("smooth"))


def q_revenue_tenure_lowess(spark, d):
    from .q_usage import _monthly2_r
    t = U.tenure_curve(_monthly2_r(spark, d), "monthly_revenue", ["country"], 10)
    s = SM.lowess(t, "country", "months_since_first", "mean", frac=0.2)
    return s.select("country", "months_since_first", r_("mean", 2).alias("mean"),
                    r_("smooth", 2).alias("smooth"))


QUERIES = {
    "revenue_tenure_lowess": q_revenue_tenure_lowess,
    "stream_ingest": q_stream_ingest,
    "stream_ingest_backfill": q_stream_ingest_backfill,
    "stream_daily_usage_backfill": q_stream_daily_usage_backfill,
    "stream_daily_usage": q_stream_daily_usage,
    "stream_ingest_gaps": q_stream_ingest_gaps,
    "stream_usage_gaps": q_stream_usage_gaps,
    "clean_series_by_batches": q_clean_series_by_batches,
    "tenure_lowess": q_tenure_lowess,
}

SQL = {
    "stream_ingest": f"SELECT event_id, user_id, ts, {rs('value', 2)} AS value FROM events",
    "stream_daily_usage": f"""SELECT user_id, date_trunc('day', ts) AS window_start, {rs('sum(value)', 2)} AS total,
        count(*) AS n FROM events GROUP BY user_id, date_trunc('day', ts)""",
}
_GAPS = """(SELECT CASE WHEN event_id % 11 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts,
    user_id, value FROM events)"""
SQL["stream_ingest_gaps"] = SQL["stream_ingest"].replace("FROM events", f"FROM {_GAPS}")
SQL["stream_usage_gaps"] = SQL["stream_daily_usage"].replace("FROM events", f"FROM {_GAPS}")
SQL["clean_series_by_batches"] = CLEAN_SQL["clean_series"]
SQL["stream_ingest_backfill"] = SQL["stream_ingest"]
SQL["stream_daily_usage_backfill"] = SQL["stream_daily_usage"]


def _lowess_sql(curve: str, upto: list[str], digits: int) -> str:
    from .q_usage import _steps
    from .sql_bindings import with_
    body, steps = SM.sql_lowess("tc", "country", "months_since_first", "mean")
    st = _steps()
    return with_(["clean_long", "site_map", "payments", "customers"],
                 f"SELECT country, months_since_first, {rs('mean', digits)} AS mean, {rs('smooth', digits)} AS smooth FROM ({body})",
                 {**{k: st[k] for k in upto}, "tc": curve, **steps})


SQL["tenure_lowess"] = _lowess_sql("""SELECT country, months_since_first, avg(monthly_kwh) AS mean FROM m2c
    GROUP BY country, months_since_first HAVING count(monthly_kwh) >= 10""", ["mc", "mm", "mw", "m2c"], 4)
SQL["revenue_tenure_lowess"] = _lowess_sql("""SELECT country, months_since_first, avg(monthly_revenue) AS mean FROM m2r
    GROUP BY country, months_since_first HAVING count(monthly_revenue) >= 10""", ["rev", "pc", "mr", "m2r"], 2)
