"""Consumption and revenue per user (A1-A5, A11, G8, J1, J3, J11, J13, FLT2, FLT14).

All aggregations are two-phase hash aggregates (map-side partial sums), so a
hot customer or site is combined before the shuffle.  Per-customer tables
are one row per customer; per-site tables one row per site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import month_ordinal, neq_nullsafe
from ..session import materialize
from .stats import exact_quantiles

RESIDENTIAL = "Residential"


# ------------------------------------------------------------ customer class
def consumption_class(tariff: str = "tariff"):
    """Consumption: exact match after trim/lower (S13); NULL -> Commercial."""
    return F.when(F.coalesce(F.lower(F.trim(F.col(tariff))) == "residential", F.lit(False)),
                  F.lit(RESIDENTIAL)).otherwise(F.lit("Commercial"))


def revenue_class(customer_type: str = "customerType"):
    """Revenue: exact customerType; missing customer -> 'Unknown' (S10, S13)."""
    return (F.when(F.col(customer_type).isNull(), F.lit("Unknown"))
             .when(F.col(customer_type) == RESIDENTIAL, F.lit(RESIDENTIAL))
             .otherwise(F.lit("Commercial")))


# ------------------------------------------------------------ consumption
def monthly_consumption(clean: DataFrame, site: str = "site_name", code="meter_customer_code",
                        ts="slot_start", energy="energy_kwh", tariff="tariff",
                        meter_type="meter_type") -> DataFrame:
    """kWh per (customer, class, month, site) over customer meters (A1, FLT5).

    ``site`` stays a key (S19): a customer seen in two site files counts twice.
    """
    c = clean.where(F.col(meter_type) == "customer")
    # group on an integer month; the yyyy-MM label is made per group, not per row
    m = F.year(ts) * 100 + F.month(ts)
    g = (c.groupBy(F.col(code).alias("meter_customer_code"),
                   consumption_class(tariff).alias("cust_class"),
                   m.alias("_m"), F.col(site).alias("site_name"))
          .agg(F.sum(energy).alias("monthly_kwh")))
    return g.select("meter_customer_code", "cust_class", _ym_label("_m").alias("ym"), "site_name",
                    "monthly_kwh")


def _ym_label(m: str):
    """yyyy-MM from an integer year*100+month."""
    return F.concat(F.lpad(F.floor(F.col(m) / 100).cast("string"), 4, "0"), F.lit("-"),
                    F.lpad(F.pmod(F.col(m), F.lit(100)).cast("string"), 2, "0"))


def map_sites(df: DataFrame, site_map: DataFrame, site="site_name") -> DataFrame:
    """Static site -> (projectName, country) map, inner: unmapped sites drop.

    ``site_map`` is a list with one row per site file.
    """
    return df.join(site_map, site, "inner")


def _ord_label(c):
    """yyyy-MM of a month ordinal ((year-1970)*12 + month-1)."""
    o = F.col(c)
    y = (F.floor(o / F.lit(12)) + 1970).cast("int")
    m = (F.pmod(o, F.lit(12)) + 1).cast("int")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))


def per_user_summary(monthly: DataFrame, keys, value: str, ym="ym", prefix="") -> DataFrame:
    """sum, count, first/last month, mean and span of months.

    Months are aggregated as integer ordinals (hash aggregate; min/max of a
    string would force a sort aggregate) and labelled afterwards.
    """
    ym_ord = month_ordinal(F.to_date(F.concat(F.col(ym), F.lit("-01"))))
    g = (monthly.withColumn("_ord", ym_ord)
                .groupBy(*keys)
                .agg(F.sum(value).alias(f"total_{prefix}"),
                     F.count(value).alias("active_months"),
                     F.min("_ord").alias("_first"), F.max("_ord").alias("_last"),
                     F.avg(value).alias(prefix or "mean")))
    return g.select(*keys, f"total_{prefix}", "active_months",
                    _ord_label("_first").alias("first_month"), _ord_label("_last").alias("last_month"),
                    prefix or "mean", (F.col("_last") - F.col("_first") + 1).alias("date_range_months"))


def min_site_customers(df: DataFrame, n: int, site_keys=("country", "projectName"),
                       code="meter_customer_code") -> DataFrame:
    """Keep sites with at least ``n`` distinct customers (A5, FLT12, J3).

    The per-site count is one row per site; a left-semi join keeps rows.
    """
    site_keys = list(site_keys)
    ok = (df.groupBy(*site_keys).agg(F.countDistinct(code).alias("_n"))
            .where(F.col("_n") >= n).select(*site_keys))
    return df.join(ok, site_keys, "left_semi")


def acpu(monthly_mapped: DataFrame, min_site_n: int = 30) -> DataFrame:
    """Average consumption per user, Wh/month, sites with >= n users."""
    m = (monthly_mapped.withColumn("monthly_wh", F.col("monthly_kwh") * 1000.0)
                       .where(F.col("monthly_wh") > 0))
    s = per_user_summary(m, ["meter_customer_code", "country", "cust_class", "projectName"],
                         "monthly_wh", prefix="acpu").withColumnRenamed("total_acpu", "total_wh")
    return min_site_customers(s, min_site_n)


def months_since_first(df: DataFrame, code: str, ym="ym") -> DataFrame:
    """Months since the customer's first month over all its rows.

    ``df`` has a row per customer and month (and site), so a window over a
    customer holds a few hundred rows at most, and the monthly frame is read
    and shuffled once.
    """
    ord_ = month_ordinal(F.to_date(F.concat(F.col(ym), F.lit("-01"))))
    first = F.min("_ord").over(Window.partitionBy(code))
    return (df.withColumn("_ord", ord_)
              .withColumn("months_since_first", (F.col("_ord") - first).cast("int"))
              .drop("_ord"))


# ------------------------------------------------------------ revenue
def revenue_payments(pay: DataFrame, countries, min_year: int = 2015) -> DataFrame:
    """Recurring revenue filter (FLT2): null-safe flags (S1), amount > 0,
    valid timestamp in/after ``min_year``, country (title-cased) in list."""
    p = pay.withColumn("country", F.initcap(F.trim(F.col("country"))))
    cond = (neq_nullsafe("isTest", 1) & neq_nullsafe("isReversed", 1)
            & neq_nullsafe("isSignup", 1) & neq_nullsafe("isBalanceTransfer", 1)
            & (F.col("amount") > 0) & F.col("transactionDatetime").isNotNull()
            & (F.year("transactionDatetime") >= min_year)
            & F.col("country").isin(list(countries)))
    return p.where(cond).select("customerAccountNumber", "amount", "currency", "country",
                                "projectName", "transactionDatetime")


def nearest_year_rates(keys: DataFrame, rates: DataFrame, country="country", year="year",
                       rate="rate") -> DataFrame:
    """Rate per (country, year): exact year, else nearest year, tie -> earlier.

    ``keys`` are the distinct (country, year) pairs in use; ``rates`` is the
    published rate table (countries x years).  NULL rates are ignored.
    """
    r = rates.where(F.col(rate).isNotNull()).select(
        F.col(country), F.col(year).alias("_ry"), F.col(rate).alias("_rate"))
    j = keys.join(r, country, "inner")
    # total order (distance, year) as one integer key: a hash aggregate
    order = F.abs(F.col("_ry") - F.col(year)).cast("long") * F.lit(1_000_000) + F.col("_ry")
    return j.groupBy(country, year).agg(F.min_by("_rate", order).alias("fx_rate"))


def fx_convert(pay: DataFrame, rates: DataFrame, amount="amount", ts="transactionDatetime",
               country="country") -> DataFrame:
    """Divide amounts by the LCU-per-USD rate of the nearest year; rows
    without any rate for their country are dropped (`figures` warning)."""
    p = pay.withColumn("tx_year", F.year(ts))
    keys = p.select(country, F.col("tx_year").alias("year")).distinct()
    fx = nearest_year_rates(keys, rates, country, "year").withColumnRenamed("year", "tx_year")
    return (p.join(fx, [country, "tx_year"], "inner")
             .withColumn(amount, F.try_divide(F.col(amount), F.col("fx_rate")))
             .drop("tx_year", "fx_rate"))


def payments_with_class(pay: DataFrame, customers: DataFrame) -> DataFrame:
    """LEFT join payments x customers on the account; class with 'Unknown' (J1)."""
    c = customers.select("customerAccountNumber", "customerType")
    return (pay.join(c, "customerAccountNumber", "left")
               .withColumn("cust_class", revenue_class("customerType")))


def monthly_revenue(pay_cls: DataFrame) -> DataFrame:
    """Revenue per (customer, country, class, project, month) (A3)."""
    keys = ["customerAccountNumber", "country", "cust_class", "projectName"]
    p = pay_cls.dropna(subset=keys)
    m = F.year("transactionDatetime") * 100 + F.month("transactionDatetime")
    g = p.groupBy(*keys, m.alias("_m")).agg(F.sum("amount").alias("monthly_revenue"))
    return g.select(*keys, _ym_label("_m").alias("ym"), "monthly_revenue")


def arpu(monthly_rev: DataFrame, min_site_n: int = 30) -> DataFrame:
    """Average revenue per user over sites with >= n users."""
    s = per_user_summary(monthly_rev, ["customerAccountNumber", "country", "cust_class",
                                       "projectName"], "monthly_revenue", prefix="arpu")
    s = s.withColumnRenamed("total_arpu", "total_revenue")
    return min_site_customers(s, min_site_n, code="customerAccountNumber")


# ------------------------------------------------------------ tenure
def quantile_cap(df: DataFrame, value: str, q: float, by=()) -> DataFrame:
    """Keep rows with value <= the q-quantile of their group (FLT14).

    The caps are one row per group, joined back on the group key (a
    constant key when ``by`` is empty).  The frame is written once and read
    for the value counts and for the rows.
    """
    by = list(by)
    if not by:
        df, by = df.withColumn("_g", F.lit(0)), ["_g"]
    df = materialize(df, "capped")
    caps = exact_quantiles(df, value, by, [q]).select(*by, F.col("q0").alias("_cap"))
    out = df.join(caps, by, "inner").where(F.col(value) <= F.col("_cap")).drop("_cap")
    return out.drop("_g") if "_g" in out.columns else out


def tenure_curve(df: DataFrame, value: str, by=("country",), min_count: int = 10) -> DataFrame:
    """Mean and count of ``value`` by months since first, HAVING count >= n."""
    return (df.groupBy(*by, "months_since_first")
              .agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
              .where(F.col("count") >= min_count))
