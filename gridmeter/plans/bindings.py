"""Domain inputs derived from the driver's tables.

Every registered query reads the given parquet tables through these
functions, so its work grows with the tables.  Each binding has a twin SQL
text in :mod:`gridmeter.plans.sql_bindings` that DuckDB runs for the oracle.

Fixed values of the bindings (not taken from the reference):
  * resets of the energy counter: every event whose id is a multiple of 37
    reads 0 (a counter roll-back);
  * meter type by ``user_id mod 10``: 0 totalizer, 1 pue, otherwise customer;
  * state 0 for ``event_type = 'error'``, otherwise 1;
  * order status P/O/F -> isReversed NULL/0/1;
  * order priority '5-LOW' -> isTest 1, '3-MEDIUM' -> isTest NULL, else 0;
    '1-URGENT' -> isSignup 1; '4-NOT SPECIFIED' -> isBalanceTransfer NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import running_sum
from ..session import prepare

RESET_EVERY = 37


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ts(c: str):
    return F.col(c).cast("timestamp")


def meter_type_of(user_col: str):
    m = F.pmod(F.col(user_col), F.lit(10))
    return (F.when(m == 0, F.lit("totalizer")).when(m == 1, F.lit("pue"))
             .otherwise(F.lit("customer")))


def readings(spark: SparkSession, d: str, slot_minutes: int = 15) -> DataFrame:
    """Raw heartbeats: meter_customer_code, meter_type, heartbeatStart,
    energy (cumulative kWh), state, meter_tariff_name, row_id.

    The counter is derived by a running sum.
    """
    ev = table(spark, d, "events").select(
        "event_id", _ts("ts").alias("ts"), "user_id", "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"))
    cum = running_sum(ev, ["user_id"], "ts", ["event_id"], "cents", "cum")
    slot_s = slot_minutes * 60
    hb = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.lit(slot_s)) * F.lit(slot_s))
    energy = (F.when(F.pmod(F.col("event_id"), F.lit(RESET_EVERY)) == 0, F.lit(0.0))
               .otherwise(F.col("cum").cast("double") / F.lit(100.0)))
    out = cum.select(
        F.col("user_id").cast("string").alias("meter_customer_code"),
        meter_type_of("user_id").alias("meter_type"),
        hb.alias("heartbeatStart"),
        energy.alias("energy"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1)).alias("state"),
        F.col("event_type").alias("meter_tariff_name"),
        F.col("event_id").alias("row_id"))
    return out


def power_readings(spark: SparkSession, d: str) -> DataFrame:
    """Voltage and power-factor columns of the heartbeats."""
    ev = table(spark, d, "events")
    v = F.col("value")
    return ev.select(
        F.col("user_id").cast("string").alias("meter_customer_code"),
        meter_type_of("user_id").alias("meter_type"),
        _ts("ts").alias("heartbeatStart"),
        v.alias("voltageAvg"), (v * 0.95).alias("voltageMin"), (v * 1.05).alias("voltageMax"),
        (F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)") / 100.0).alias("powerFactorAvg"),
        F.col("event_type").alias("meter_tariff_name"))


def customers_keyed(spark: SparkSession, d: str) -> DataFrame:
    """c_custkey plus customerAccountNumber, customerType, projectName, country."""
    c = table(spark, d, "customer")
    n = F.broadcast(table(spark, d, "nation"))      # 25 rows, fixed
    r = F.broadcast(table(spark, d, "region"))      # 5 rows, fixed
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
             .select("c_custkey",
                     F.col("c_custkey").cast("string").alias("customerAccountNumber"),
                     F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("Residential"))
                      .otherwise(F.col("c_mktsegment")).alias("customerType"),
                     F.col("n_name").alias("projectName"),
                     F.col("r_name").alias("country")))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """customerAccountNumber, customerType, projectName, country."""
    return customers_keyed(spark, d).drop("c_custkey")


def clean_series_long(spark: SparkSession, d: str) -> DataFrame:
    """A multi-year clean series: one row per line item.

    meter_customer_code=o_custkey, slot_start=l_shipdate, energy_kwh=l_quantity,
    tariff from the market segment, site/project=nation, country=region.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", _ts("l_shipdate").alias("slot_start"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cu = customers_keyed(spark, d)
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
           .join(cu, F.col("o_custkey") == cu.c_custkey, "left"))
    return j.select(
        F.col("o_custkey").cast("string").alias("meter_customer_code"),
        F.lit("customer").alias("meter_type"),
        "slot_start",
        F.col("l_quantity").alias("energy_kwh"),
        F.lit("observed").alias("imputation_method"),
        F.col("customerType").alias("tariff"),
        F.col("projectName").alias("site_name"),
        "country")


def payments(spark: SparkSession, d: str, located: bool = True) -> DataFrame:
    """Payment confirmations (country, projectName only if ``located``): id, customerAccountNumber, amount, transactionDatetime,
    paymentProcessor, flags (isTest, isReversed, isSignup, isBalanceTransfer),
    country, projectName, currency."""
    o = table(spark, d, "orders")
    pr = F.col("o_orderpriority")
    st = F.col("o_orderstatus")
    p = o.select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.col("o_custkey").cast("string").alias("customerAccountNumber"),
        F.col("o_totalprice").alias("amount"),
        _ts("o_orderdate").alias("transactionDatetime"),
        F.concat(F.lit("  "), F.upper(F.substring(pr, 3, 100)), F.lit(" ")).alias("paymentProcessor"),
        F.when(pr == "5-LOW", F.lit(1)).when(pr == "3-MEDIUM", F.lit(None)).otherwise(F.lit(0))
         .cast("tinyint").alias("isTest"),
        F.when(st == "F", F.lit(1)).when(st == "O", F.lit(0)).otherwise(F.lit(None))
         .cast("tinyint").alias("isReversed"),
        F.when(pr == "1-URGENT", F.lit(1)).otherwise(F.lit(0)).cast("tinyint").alias("isSignup"),
        F.when(pr == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.lit(0))
         .cast("tinyint").alias("isBalanceTransfer"))
    p = p.withColumn("currency", F.lit("LCU"))
    if not located:
        return p.drop("o_custkey")
    cu = customers_keyed(spark, d).select("c_custkey", "projectName", "country")
    return p.join(cu, p.o_custkey == cu.c_custkey, "left").drop("o_custkey", "c_custkey")


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Metering base stations: meteringSiteId, meteringBaseStation, projectName,
    olderMeteringSiteIds (comma list), lat, long, timezoneOffsetUtc."""
    s = table(spark, d, "supplier")
    n = F.broadcast(table(spark, d, "nation"))
    k = F.col("s_suppkey")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
             .select(F.concat(F.lit("SITE-"), k.cast("string")).alias("meteringSiteId"),
                     F.concat(F.lit("Station "), F.col("n_name"), F.lit(" "),
                              k.cast("string")).alias("meteringBaseStation"),
                     F.col("n_name").alias("projectName"),
                     F.concat_ws(",", F.concat(F.lit("OLD-"), k.cast("string")),
                                 F.concat(F.lit("OLDER-"), k.cast("string"))).alias("olderMeteringSiteIds"),
                     F.when(F.pmod(k, F.lit(7)) == 0, F.lit(0.0)).otherwise(F.col("s_acctbal") / 100.0).alias("lat"),
                     F.when(F.pmod(k, F.lit(7)) == 0, F.lit(0.0)).otherwise(F.col("s_acctbal") / 50.0).alias("long"),
                     (F.pmod(F.col("s_nationkey"), F.lit(5)) - 1).cast("int").alias("timezoneOffsetUtc"),
                     F.when(F.pmod(k, F.lit(5)) == 0, _uuid_like(k)).otherwise(
                         F.regexp_replace(F.concat(F.lit("Station "), F.col("n_name"), F.lit(" "),
                                                   k.cast("string")), " ", "_")).alias("site_file")))


def _uuid_like(k):
    h = F.md5(k.cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def readings_with_site(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats carrying a site id: current ids and the two legacy id
    forms of the stations, and ids of no station."""
    ev = table(spark, d, "events")
    k = F.pmod(F.col("user_id"), F.lit(120)).cast("string")
    m = F.pmod(F.col("event_id"), F.lit(3))
    site = (F.when(m == 0, F.concat(F.lit("SITE-"), k)).when(m == 1, F.concat(F.lit("OLD-"), k))
             .otherwise(F.concat(F.lit("OLDER-"), k)))
    return ev.select(F.col("event_id").alias("row_id"),
                     F.col("user_id").cast("string").alias("meter_customer_code"),
                     meter_type_of("user_id").alias("meter_type"),
                     site.alias("site"), _ts("ts").alias("heartbeatStart"),
                     F.col("value").alias("truePowerAvg"),
                     F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value"))
                      .alias("truePowerInst"),
                     F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1)).alias("state"))


def tariffs(spark: SparkSession, d: str) -> DataFrame:
    """Tariff changes per station: one per line item (l_suppkey station,
    l_shipdate start, l_discount rate, return flag as the tariff name)."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("station"), _ts("l_shipdate").alias("startingDatetime"),
                     F.col("l_orderkey").alias("tariff_order"), F.col("l_linenumber").alias("tariff_line"),
                     F.col("l_returnflag").alias("name"), F.col("l_discount").alias("totalRate"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Mini-grid projects: projectName, country, sizePv, capex (sums of supplier balances)."""
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation")
    r = F.broadcast(table(spark, d, "region"))
    agg = s.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("bal"), F.count(F.lit(1)).alias("ns"))
    return (n.join(agg, n.n_nationkey == agg.s_nationkey, "left")
             .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
             .select(F.col("n_name").alias("projectName"), F.col("r_name").alias("country"),
                     (F.col("bal") / 1000.0).alias("sizePv"),
                     (F.col("ns") * 1000.0).alias("capex"),
                     (F.col("n_regionkey") + 1).cast("int").alias("timezoneOffsetUtc")))


def title(c: str):
    return F.initcap(F.col(c))


def site_map(spark: SparkSession, d: str) -> DataFrame:
    """Static site-file -> (projectName, country) list (J6); sites of one
    region are left unmapped to exercise the inner join."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "inner")
    return j.where(F.col("r_name") != "MIDDLE EAST").select(
        F.col("n_name").alias("site_name"),
        F.regexp_replace("n_name", "_", " ").alias("projectName"),
        F.initcap("r_name").alias("country"))


# Fixed values for the tests: project overrides for two sites, and an
# exchange-rate table (LCU per USD) with gaps in the years.
PROJECT_OVERRIDES = [("NATION_1", "Nations 1 and 2"), ("NATION_2", "Nations 1 and 2")]
FX_RATES = [("Africa", 1996, 100.0), ("Africa", 1999, 110.0),
            ("America", 1995, 1.0), ("America", 2000, 1.2),
            ("Asia", 1998, 7.5), ("Asia", 2002, None),
            ("Europe", 1995, 0.9), ("Europe", 1997, 0.95), ("Europe", 2001, 1.1)]
COUNTRIES = ["Africa", "America", "Asia", "Europe"]


def project_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECT_OVERRIDES, "site_name string, project string")


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FX_RATES, "country string, year int, rate double")
