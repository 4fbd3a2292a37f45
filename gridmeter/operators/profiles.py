"""24-hour load profiles in site-local time.

The rows are reduced once to (slot, value, count), which is written; slot and
hour statistics both come from those counts, an hour from those of its slots
(so over the 15-minute values, not over hourly sums).

Quantiles are exact by default with :func:`stats.quantiles_of_counts` (radix
selection), so no task holds a whole time-of-day group; ``method="map"`` uses
``percentile`` (a value->count map per group) and ``method="approx"``
``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import contains_ci
from . import stats as S

SLOT_MINUTES = 15


def time_of_day(df: DataFrame, ts="slot_start", offset="utc_offset",
                slot_minutes=SLOT_MINUTES) -> DataFrame:
    """Local slot-of-day (0..95) and hour (0..23) after adding a whole-hour
    UTC offset column (G6)."""
    local = F.timestamp_add("HOUR", F.col(offset).cast("int"), F.col(ts))
    minutes = F.hour(local) * 60 + F.minute(local)
    return (df.withColumn("tod_slot", F.floor(minutes / F.lit(slot_minutes)).cast("int"))
              .withColumn("tod_hour", F.hour(local).cast("int")))


def site_utc_offset(stations: DataFrame, projects: DataFrame) -> DataFrame:
    """Station name (spaces -> '_') -> UTC offset of its project."""
    p = projects.select("projectName", F.col("timezoneOffsetUtc").alias("utc_offset"))
    return (stations.select(F.regexp_replace("meteringBaseStation", " ", "_").alias("site_name"),
                            "projectName")
                    .join(p, "projectName", "left"))


def customers_by_tariff(modal: DataFrame, pattern: str, code="meter_customer_code",
                        tariff="tariff", site: str | None = None) -> DataFrame:
    """Customers whose modal tariff contains ``pattern`` (regex, any case) (J4, S12);
    with ``site``, (site, code) pairs, as a code may stand for others elsewhere."""
    return modal.where(contains_ci(tariff, pattern)).select(*([site] if site else []), code).distinct()


def load_profile(clean: DataFrame, offsets: DataFrame, customers: DataFrame | None = None,
                 observed_only: bool = False, site="site_name", code="meter_customer_code",
                 method: str = "exact", slot_minutes=SLOT_MINUTES, default_offset: int | None = None) -> DataFrame:
    """mean, sample std, n, median, q1, q3 of slot energy by local slot and
    by local hour (A7), for customer meters of the selected customers.

    ``offsets`` is (site, utc_offset): one row per site.  A site without an
    offset takes ``default_offset``; without one it is an error, never left
    out.  ``customers`` restricts the meters by a left-semi join (J4), on
    (site, code) if it has the site, else on the code.
    """
    c = clean.where(F.col("meter_type") == "customer")
    if observed_only:
        c = c.where(F.col("imputation_method") == "observed")
    if customers is not None:
        c = c.join(customers, [k for k in (site, code) if k in customers.columns], "left_semi")
    c = c.join(offsets.select(site, "utc_offset"), site, "left")
    missing = (F.lit(default_offset).cast("int") if default_offset is not None else
               F.raise_error(F.concat(F.lit("no UTC offset for site "), F.coalesce(F.col(site), F.lit("NULL")))).cast("int"))
    c = c.withColumn("utc_offset", F.coalesce(F.col("utc_offset").cast("int"), missing))
    t = time_of_day(c, offset="utc_offset", slot_minutes=slot_minutes)
    levels = F.explode(F.array(F.struct(F.lit("slot").alias("level"), F.col("tod_slot").alias("grp")),
                               F.struct(F.lit("hour").alias("level"), F.col("tod_hour").alias("grp")))).alias("_l")
    if method == "exact":
        vc = S.value_counts(t, "energy_kwh", ["tod_slot", "tod_hour"])
        vc, by = vc.select(levels, "_x", "_b", "_c").select("_l.level", "_l.grp", "_x", "_b", "_c"), ["level", "grp"]
        q = S.quantiles_of_counts(vc, by, [0.25, 0.5, 0.75]).drop("n").join(S.moments_of_counts(vc, by), by)
        return q.select("level", "grp", "mean", "std", "n", F.col("q1").alias("median"),
                        F.col("q0").alias("q1"), F.col("q2").alias("q3"))
    lv = t.select(F.col("energy_kwh").alias("x"), levels).select("_l.level", "_l.grp", "x")
    qf = (F.percentile_approx("x", [0.25, 0.5, 0.75], 10000) if method == "approx"
          else F.percentile("x", [0.25, 0.5, 0.75]))
    return (lv.groupBy("level", "grp")
              .agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                   F.count("x").alias("n"), qf.alias("_q"))
              .select("level", "grp", "mean", "std", "n", F.col("_q")[1].alias("median"),
                      F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3")))


def load_profile_ci(stats: DataFrame, slot_minutes=SLOT_MINUTES) -> DataFrame:
    """Dense 96-slot and 24-hour profile in Wh: mean with a 95% band
    (mean +- 1.96 sd/sqrt(n), lower end clipped at 0) and median with
    q1-q3; slot values x1000, hour values x4000 (G7, J16, PRJ9, S24)."""
    spark = stats.sparkSession
    spd = 24 * 60 // slot_minutes
    spine = (spark.range(spd).select(F.lit("slot").alias("level"), F.col("id").cast("int").alias("grp"))
             .unionByName(spark.range(24).select(F.lit("hour").alias("level"),
                                                F.col("id").cast("int").alias("grp"))))
    j = spine.join(stats, ["level", "grp"], "left")
    scale = F.when(F.col("level") == "slot", F.lit(1000.0)).otherwise(F.lit(1000.0 * spd / 24))
    centre = F.col("mean") * scale
    margin = F.lit(1.96) * F.col("std") / F.sqrt("n") * scale
    return j.select("level", "grp", F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                    centre.alias("mean_wh"),
                    F.greatest(centre - margin, F.lit(0.0)).alias("ci_lo_wh"),
                    (centre + margin).alias("ci_hi_wh"),
                    (F.col("median") * scale).alias("median_wh"),
                    (F.col("q1") * scale).alias("q1_wh"), (F.col("q3") * scale).alias("q3_wh"))
