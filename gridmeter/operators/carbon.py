"""Avoided-emission accounting per mini-grid project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import contains_ci
from ..session import materialize

# Fixed values of the accounting rule (small-scale methodology for
# renewable mini-grids): threshold per residential customer-year and the
# two emission factors, tCO2e per kWh.
RESIDENTIAL_THRESHOLD_KWH = 55.0
EF_RESIDENTIAL_BELOW = 2.72 / 1000
EF_ABOVE = 0.80 / 1000


def site_rollup(df: DataFrame, overrides: DataFrame, site="site_name", out="project") -> DataFrame:
    """Project of a site: override map, else the site name with '_' -> ' ' (J7).

    ``overrides`` (site_name, project) is a short list.
    """
    o = overrides.select(F.col("site_name").alias(site), F.col("project").alias("_ov"))
    return (df.join(o, site, "left")
              .withColumn(out, F.coalesce(F.col("_ov"), F.regexp_replace(F.col(site), "_", " ")))
              .drop("_ov"))


def annual_consumption(clean: DataFrame, overrides: DataFrame, site="site_name",
                       code="meter_customer_code", ts="slot_start", energy="energy_kwh",
                       tariff="tariff") -> DataFrame:
    """kWh per (project, customer, year, is_residential) (A2).

    Summed per site first (as the site files are), then re-summed per
    project; residential = tariff contains 'Residential' (case-insensitive).
    """
    c = clean.where(F.col("meter_type") == "customer")
    per_site = (c.groupBy(site, F.col(code).alias("meter_customer_code"), F.year(ts).alias("year"),
                          contains_ci(tariff, "Residential").alias("is_residential"))
                 .agg(F.sum(energy).alias("annual_kwh")))
    p = site_rollup(per_site, overrides, site)
    return (p.groupBy("project", "meter_customer_code", "year", "is_residential")
             .agg(F.sum("annual_kwh").alias("annual_kwh")))


def co2e(kwh: str = "annual_kwh", is_res: str = "is_residential"):
    """tCO2e avoided for one customer-year."""
    k = F.col(kwh)
    below = F.least(k, F.lit(RESIDENTIAL_THRESHOLD_KWH))
    above = F.greatest(k - F.lit(RESIDENTIAL_THRESHOLD_KWH), F.lit(0.0))
    res = below * F.lit(EF_RESIDENTIAL_BELOW) + above * F.lit(EF_ABOVE)
    return F.when(F.col(is_res), res).otherwise(k * F.lit(EF_ABOVE))


def project_years(annual: DataFrame) -> DataFrame:
    """co2e per (project, year) with the first and last year of every
    project dropped (partial years) (A12, J8)."""
    py = (annual.withColumn("co2e_tonne", co2e())
                .groupBy("project", "year").agg(F.sum("co2e_tonne").alias("co2e_tonne")))
    w = Window.partitionBy("project")              # a row for each year
    return (py.withColumn("_min", F.min("year").over(w)).withColumn("_max", F.max("year").over(w))
              .where((F.col("year") > F.col("_min")) & (F.col("year") < F.col("_max")))
              .drop("_min", "_max"))


def projects_without_full_years(annual: DataFrame) -> DataFrame:
    """Projects left with no full calendar year."""
    full = project_years(annual).select("project").distinct()
    return annual.select("project").distinct().join(full, "project", "left_anti")


def carbon_accounting(annual: DataFrame, projects: DataFrame) -> DataFrame:
    """Mean annual co2e over full years, n_years, all-time customer count and
    project metadata, largest first (R6).  Years and customers both come from the
    annual frame, which is written once."""
    annual = materialize(annual, "annual")
    py = project_years(annual)
    avg = py.groupBy("project").agg(F.avg("co2e_tonne").alias("avg_annual_co2e"),
                                    F.countDistinct("year").cast("int").alias("n_years"))
    cust = annual.groupBy("project").agg(
        F.countDistinct("meter_customer_code").cast("int").alias("customer_count"))
    meta = projects.select(F.col("projectName").alias("project"), "sizePv", "capex")
    return (avg.join(cust, "project", "inner").join(meta, "project", "left")
               .select("project", "avg_annual_co2e", "n_years", "customer_count", "sizePv", "capex")
               .orderBy(F.desc("avg_annual_co2e")))
