"""Registered queries: data-quality profiling and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_half_up as r_, sql_round as rs
from ..operators import quality as Q
from ..operators import sketches as K
from ..session import materialize
from . import bindings as B
from .q_grid import _clean_site, _lp_steps
from .sql_bindings import with_


def _r(spark, d):
    return B.readings(spark, d)


def q_counts_by_key(spark, d):
    return Q.counts_by_key(_r(spark, d), ["meter_type", "state"])


def q_meters_by_type(spark, d):
    return Q.count_and_distinct(_r(spark, d), ["meter_type"], "meter_customer_code")


def q_coverage(spark, d):
    return Q.coverage(_r(spark, d), "heartbeatStart", "meter_customer_code")


def q_coverage_by_group(spark, d):
    r = _r(spark, d)
    c = Q.coverage(r, "heartbeatStart", "meter_customer_code", ["meter_type"], [F.max("energy").alias("max_energy")])
    return c.select("meter_type", "first_ts", "last_ts", "n_rows", "n_keys",
                                                   r_("max_energy", 2).alias("max_energy"))


def q_field_divergence(spark, d):
    p = B.power_readings(spark, d)
    spread = F.abs(F.col("voltageMax") - F.col("voltageMin"))
    g = p.groupBy("meter_type").agg(
        F.sum(F.when(F.col("voltageAvg") > F.col("voltageMax"), 1).otherwise(0)).cast("long").alias("n_avg_above_max"),
        F.avg(spread).alias("avg_spread"), F.max(spread).alias("max_spread"))
    return g.select("meter_type", "n_avg_above_max", r_("avg_spread", 4).alias("avg_spread"),
                    r_("max_spread", 4).alias("max_spread"))


def q_latest_n(spark, d):
    r = _r(spark, d)
    return (r.orderBy(F.desc("heartbeatStart"), F.desc("row_id")).limit(10)
             .select("row_id", "meter_customer_code", "heartbeatStart", r_("energy", 2).alias("energy")))


def q_state_share(spark, d):
    s = Q.state_share(_r(spark, d), "state", ["meter_type"])
    return s.select("meter_type", "state", "n", r_("share", 6).alias("share"))


def q_completeness(spark, d):
    c = Q.completeness(_r(spark, d), "meter_customer_code", "heartbeatStart")
    return c.select("meter_customer_code", "day", "n_readings", r_("completeness", 6).alias("completeness"))


def q_uptime_by_month(spark, d):
    u = Q.uptime_by_month(_r(spark, d), "heartbeatStart", F.col("state") == 1, ["meter_type"])
    return u.select("meter_type", "ym", r_("uptime", 6).alias("uptime"), "n")


def q_grid_losses(spark, d):
    g = Q.grid_losses(_clean_site(spark, d))
    return g.select("site_name", "slot_start", r_("totalizer_kwh", 6).alias("totalizer_kwh"),
                    r_("customer_kwh", 6).alias("customer_kwh"), r_("loss_kwh", 6).alias("loss_kwh"))


def q_cutoff_flags(spark, d):
    c = Q.cutoff_flags(B.readings_with_site(spark, d))
    return c.select("row_id", "meter_customer_code", "heartbeatStart", r_("truePowerAvg", 4).alias("truePowerAvg"))


def q_payments_by_year(spark, d):
    p = B.payments(spark, d, located=False)
    return p.groupBy(F.year("transactionDatetime").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def q_flag_sums(spark, d):
    p = B.payments(spark, d)
    return p.groupBy("country").agg(
        F.sum("isTest").cast("long").alias("n_test"), F.sum("isReversed").cast("long").alias("n_reversed"),
        F.sum("isSignup").cast("long").alias("n_signup"), F.count(F.lit(1)).alias("n_rows"),
        F.count("isReversed").alias("n_reversed_known"))


def q_null_blank_profile(spark, d):
    p = B.payments(spark, d)
    return Q.null_blank_profile(p, ["isTest", "isReversed", "isBalanceTransfer", "projectName",
                                    "paymentProcessor"])


def q_tariff_by_count(spark, d):
    return Q.most_frequent(_r(spark, d), "meter_customer_code", "meter_tariff_name", "tariff")


def q_readings_with_customer(spark, d):
    """LEFT join of heartbeats and customers, first five by time."""
    r = _r(spark, d)
    c = B.customers(spark, d).select(F.col("customerAccountNumber").alias("meter_customer_code"),
                                     "customerType", "projectName")
    return (r.join(c, "meter_customer_code", "left")
             .orderBy("heartbeatStart", "row_id").limit(5)
             .select("row_id", "meter_customer_code", "heartbeatStart", "customerType", "projectName"))


def _sited(spark, d):
    """Heartbeats with the site of their customer."""
    c = B.customers(spark, d).select(F.col("customerAccountNumber").alias("meter_customer_code"), F.col("projectName").alias("site_name"))
    return _r(spark, d).join(c, "meter_customer_code", "left")


def q_completeness_matrix(spark, d):
    """Expected and present slots by table, site and month, empty months included."""
    out = None
    for name, df, site, key, ts, slot in (
            ("readings", _sited(spark, d), "site_name", "meter_customer_code", "heartbeatStart", 15),
            ("payments", B.payments(spark, d), "projectName", "customerAccountNumber", "transactionDatetime", 1440)):
        m = Q.completeness_matrix(df, site, key, ts, slot).select(
            F.lit(name).alias("table_name"), "site", F.date_format("period", "yyyy-MM").alias("ym"), "n_keys", "expected", "present",
            r_("completeness", 6).alias("completeness"))
        out = m if out is None else out.unionByName(m)
    return out


def q_completeness_by_year(spark, d):
    m = Q.completeness_matrix(B.payments(spark, d), "projectName", "customerAccountNumber", "transactionDatetime", 1440, "year")
    return m.select("site", F.year("period").alias("year"), "n_keys", "expected", "present", r_("completeness", 6).alias("completeness"))


def q_outage_intervals(spark, d):
    return Q.outage_intervals(_r(spark, d), "meter_customer_code", "heartbeatStart", F.col("state") == 1, ["row_id"])


def q_uptime_from_outages(spark, d):
    r = materialize(_sited(spark, d), "sited")
    o = Q.outage_intervals(r, "meter_customer_code", "heartbeatStart", F.col("state") == 1, ["row_id"])
    u = Q.uptime_from_outages(r, o, "site_name", "meter_customer_code", "heartbeatStart")
    return u.select("site", "ym", r_("covered_s", 0).alias("covered_s"), r_("down_s", 0).alias("down_s"), r_("uptime", 6).alias("uptime"))


def q_distinct_meters_by_year(spark, d):
    """Distinct customers by site and year from monthly sketches, held against the exact count."""
    c = B.clean_series_long(spark, d).select("site_name", "meter_customer_code", "slot_start")
    by = ["site_name", F.year("month").alias("year")]
    est = K.distinct_estimates(K.distinct_sketches(c, ["site_name"], "slot_start", "meter_customer_code"), by)
    exact = c.groupBy(F.col("site_name").alias("_s"), F.year("slot_start").alias("_y")).agg(F.countDistinct("meter_customer_code").alias("n_exact"))
    j = est.join(exact, F.col("site_name").eqNullSafe(F.col("_s")) & F.col("year").eqNullSafe(F.col("_y")))
    off = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(1.0), F.lit(4 * K.HLL_ERROR) * F.col("n_exact"))
    return j.select("site_name", "year", "n_rows", "n_exact", off.alias("within_error"))


def q_usage_quantiles_by_year(spark, d):
    """Median and quartiles of slot energy by site and year from monthly sketches: is the rank of each within the error (A6, A7)?"""
    c = materialize(B.clean_series_long(spark, d).select("site_name", "slot_start", F.col("energy_kwh").cast("double").alias("x")), "usage")
    probs = [0.25, 0.5, 0.75]
    q = K.quantile_estimates(K.quantile_sketches(c, ["site_name"], "slot_start", "x"), ["site_name", F.year("month").alias("year")], probs)
    q = q.withColumnsRenamed({"site_name": "_s", "year": "_y"})
    j = c.join(q, c["site_name"].eqNullSafe(q["_s"]) & F.year("slot_start").eqNullSafe(q["_y"]))
    ranks = j.groupBy("_s", "_y", "n").agg(*[F.count_if(F.col("x") < F.col(f"q{i}")).alias(f"_b{i}") for i in range(3)],
                                           *[F.count_if(F.col("x") <= F.col(f"q{i}")).alias(f"_u{i}") for i in range(3)])
    slack = F.lit(2 * K.KLL_ERROR) * F.col("n") + 1
    ok = [(F.col(f"_b{i}") - slack <= F.lit(p) * F.col("n")) & (F.lit(p) * F.col("n") <= F.col(f"_u{i}") + slack) for i, p in enumerate(probs)]
    return ranks.select(F.col("_s").alias("site_name"), F.col("_y").alias("year"), "n", (ok[0] & ok[1] & ok[2]).alias("within_error"))


QUERIES = {
    "completeness_matrix": q_completeness_matrix,
    "completeness_by_year": q_completeness_by_year,
    "outage_intervals": q_outage_intervals,
    "uptime_from_outages": q_uptime_from_outages,
    "distinct_meters_by_year": q_distinct_meters_by_year,
    "usage_quantiles_by_year": q_usage_quantiles_by_year,
    "null_blank_profile": q_null_blank_profile,
    "tariff_by_count": q_tariff_by_count,
    "readings_with_customer": q_readings_with_customer,
    "counts_by_key": q_counts_by_key,
    "meters_by_type": q_meters_by_type,
    "coverage": q_coverage,
    "coverage_by_group": q_coverage_by_group,
    "field_divergence": q_field_divergence,
    "latest_n": q_latest_n,
    "state_share": q_state_share,
    "completeness": q_completeness,
    "uptime_by_month": q_uptime_by_month,
    "grid_losses": q_grid_losses,
    "cutoff_flags": q_cutoff_flags,
    "payments_by_year": q_payments_by_year,
    "flag_sums": q_flag_sums,
}


def _grid_losses_sql():
    lp = _lp_steps()
    steps = {k: lp[k] for k in ["r", "s", "t", "tv", "v", "cl", "fl", "tc", "tm", "ta", "tar", "x", "y",
                                "z", "zz", "o", "cs"]}
    return with_(["readings", "customers"], f"""SELECT site_name, slot_start,
        {rs('totalizer_kwh', 6)} AS totalizer_kwh, {rs('customer_kwh', 6)} AS customer_kwh,
        {rs('totalizer_kwh - customer_kwh', 6)} AS loss_kwh FROM (
          SELECT site_name, slot_start,
                 sum(CASE WHEN meter_type = 'totalizer' THEN energy_kwh END) AS totalizer_kwh,
                 sum(CASE WHEN meter_type = 'customer' THEN energy_kwh END) AS customer_kwh
          FROM cs GROUP BY site_name, slot_start)
        WHERE totalizer_kwh IS NOT NULL AND customer_kwh IS NOT NULL""", steps)


def _matrix_sql(src: str, site: str, key: str, ts: str, slot_minutes: int, unit: str = "MONTH") -> str:
    us = slot_minutes * 60 * 1_000_000
    return f"""(
        WITH x AS (SELECT {site} AS site, {key} AS key, epoch_us({ts}) // {us} AS slot FROM {src} WHERE {key} IS NOT NULL AND {ts} IS NOT NULL),
        sp AS (SELECT site, key, min(slot) AS a, max(slot) AS b FROM x GROUP BY site, key),
        ce AS (SELECT site, a, b, unnest(generate_series(date_trunc('{unit}', make_timestamp(a * {us})), make_timestamp(b * {us}), INTERVAL 1 {unit})) AS m FROM sp),
        ex AS (SELECT site, CAST(m AS DATE) AS period, count(*) AS n_keys,
                      CAST(sum(least(b, epoch_us(CAST(m AS TIMESTAMP) + INTERVAL 1 {unit}) // {us} - 1) - greatest(a, epoch_us(CAST(m AS TIMESTAMP)) // {us}) + 1) AS BIGINT) AS expected
               FROM ce GROUP BY site, m),
        ob AS (SELECT site, CAST(date_trunc('{unit}', make_timestamp(slot * {us})) AS DATE) AS period, count(*) AS present
               FROM (SELECT DISTINCT site, key, slot FROM x) GROUP BY ALL)
        SELECT ex.site, ex.period, n_keys, expected, coalesce(present, 0) AS present
        FROM ex LEFT JOIN ob ON ob.period = ex.period AND ob.site IS NOT DISTINCT FROM ex.site)"""


_SITED = {"sited": """SELECT r.*, c.projectName AS site_name FROM readings r LEFT JOIN customers c ON c.customerAccountNumber = r.meter_customer_code"""}
_OUTAGES = {
    "st": "SELECT meter_customer_code AS k, heartbeatStart AS t, row_id, state <> 1 AS down FROM readings WHERE state IS NOT NULL AND heartbeatStart IS NOT NULL AND meter_customer_code IS NOT NULL",
    "pv": "SELECT *, coalesce(lag(down) OVER (PARTITION BY k ORDER BY t, row_id), false) AS prev FROM st",
    "tu": "SELECT *, sum(CAST(down AS INTEGER)) OVER (PARTITION BY k ORDER BY t, row_id) AS o FROM pv WHERE down <> prev",
    "la": "SELECT k, max(t) AS last_t FROM st GROUP BY k",
    "og": """SELECT k AS meter_customer_code, outage_start, coalesce(e, last_t) AS outage_end, e IS NOT NULL AS ended FROM (
        SELECT k, o, max(CASE WHEN down THEN t END) AS outage_start, max(CASE WHEN NOT down THEN t END) AS e FROM tu GROUP BY k, o) JOIN la USING (k)""",
}


def _overlap_sql(src: str, a: str, b: str) -> str:
    return f"""SELECT site, strftime(m, '%Y-%m') AS ym, epoch(least({b}, CAST(m AS TIMESTAMP) + INTERVAL 1 MONTH)) - epoch(greatest({a}, CAST(m AS TIMESTAMP))) AS s
        FROM (SELECT *, unnest(generate_series(date_trunc('MONTH', {a}), {b}, INTERVAL 1 MONTH)) AS m FROM {src})"""


SQL = {
    "completeness_matrix": with_(["readings", "customers", "payments"], " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, site, strftime(period, '%Y-%m') AS ym, n_keys, expected, present,
        {rs('CAST(present AS DOUBLE) / expected', 6)} AS completeness FROM {_matrix_sql(*a)}""" for name, a in (
            ("readings", ("sited", "site_name", "meter_customer_code", "heartbeatStart", 15)),
            ("payments", ("payments", "projectName", "customerAccountNumber", "transactionDatetime", 1440)))), _SITED),
    "completeness_by_year": with_(["payments"], f"""SELECT site, CAST(year(period) AS INTEGER) AS year, n_keys, expected, present,
        {rs('CAST(present AS DOUBLE) / expected', 6)} AS completeness
        FROM {_matrix_sql("payments", "projectName", "customerAccountNumber", "transactionDatetime", 1440, "YEAR")}"""),
    "outage_intervals": with_(["readings"], """SELECT meter_customer_code, outage_start, outage_end,
        CAST(round_even((epoch(outage_end) - epoch(outage_start)) / 900.0, 0) AS BIGINT) AS slots, ended FROM og""", _OUTAGES),
    "uptime_from_outages": with_(["readings", "customers"], f"""SELECT site, ym, {rs('sum(c)', 0)} AS covered_s, {rs('sum(d)', 0)} AS down_s,
        {rs('CASE WHEN sum(c) <> 0 THEN (sum(c) - sum(d)) / sum(c) END', 6)} AS uptime FROM (
        SELECT site, ym, s AS c, 0.0 AS d FROM ({_overlap_sql("spn", "a", "b")}) UNION ALL
        SELECT site, ym, 0.0, s FROM ({_overlap_sql("ogs", "outage_start", "outage_end")})) GROUP BY site, ym""",
        {**_SITED, **_OUTAGES,
         "spn": "SELECT meter_customer_code, any_value(site_name) AS site, min(heartbeatStart) AS a, max(heartbeatStart) AS b FROM sited GROUP BY meter_customer_code",
         "ogs": "SELECT og.*, spn.site FROM og JOIN spn USING (meter_customer_code)"}),
    "distinct_meters_by_year": with_(["clean_long"], """SELECT site_name, CAST(year(slot_start) AS INTEGER) AS year, count(*) AS n_rows,
        count(DISTINCT meter_customer_code) AS n_exact, true AS within_error FROM clean_long GROUP BY ALL"""),
    "usage_quantiles_by_year": with_(["clean_long"], """SELECT site_name, CAST(year(slot_start) AS INTEGER) AS year, count(energy_kwh) AS n, true AS within_error
        FROM clean_long GROUP BY ALL"""),
    "null_blank_profile": with_(["payments"], """SELECT c AS "column", n_rows, n_null_or_blank FROM (
        SELECT count(*) AS n_rows,
          CAST(sum(CASE WHEN isTest IS NULL OR trim(CAST(isTest AS VARCHAR)) = '' THEN 1 ELSE 0 END) AS BIGINT) AS a,
          CAST(sum(CASE WHEN isReversed IS NULL OR trim(CAST(isReversed AS VARCHAR)) = '' THEN 1 ELSE 0 END) AS BIGINT) AS b,
          CAST(sum(CASE WHEN isBalanceTransfer IS NULL OR trim(CAST(isBalanceTransfer AS VARCHAR)) = '' THEN 1 ELSE 0 END) AS BIGINT) AS c2,
          CAST(sum(CASE WHEN projectName IS NULL OR trim(projectName) = '' THEN 1 ELSE 0 END) AS BIGINT) AS d,
          CAST(sum(CASE WHEN paymentProcessor IS NULL OR trim(paymentProcessor) = '' THEN 1 ELSE 0 END) AS BIGINT) AS e
        FROM payments) UNPIVOT (n_null_or_blank FOR c IN (a AS 'isTest', b AS 'isReversed', c2 AS 'isBalanceTransfer',
          d AS 'projectName', e AS 'paymentProcessor'))"""),
    "tariff_by_count": with_(["readings"], """SELECT meter_customer_code, tariff, n FROM (
        SELECT meter_customer_code, meter_tariff_name AS tariff, count(*) AS n, row_number() OVER (
          PARTITION BY meter_customer_code ORDER BY count(*) DESC, meter_tariff_name) AS rn
        FROM readings WHERE meter_tariff_name IS NOT NULL GROUP BY meter_customer_code, meter_tariff_name)
        WHERE rn = 1"""),
    "readings_with_customer": with_(["readings", "customers"], """SELECT row_id, meter_customer_code,
        heartbeatStart, c.customerType, c.projectName FROM readings r LEFT JOIN customers c
        ON c.customerAccountNumber = r.meter_customer_code ORDER BY heartbeatStart, row_id LIMIT 5"""),
    "counts_by_key": with_(["readings"], """SELECT meter_type, state, count(*) AS n FROM readings
        GROUP BY meter_type, state"""),
    "meters_by_type": with_(["readings"], """SELECT meter_type, count(*) AS n_rows,
        count(DISTINCT meter_customer_code) AS n_distinct FROM readings GROUP BY meter_type"""),
    "coverage": with_(["readings"], """SELECT min(heartbeatStart) AS first_ts, max(heartbeatStart) AS last_ts,
        count(*) AS n_rows, count(DISTINCT meter_customer_code) AS n_keys FROM readings"""),
    "coverage_by_group": with_(["readings"], f"""SELECT meter_type, min(heartbeatStart) AS first_ts,
        max(heartbeatStart) AS last_ts, count(*) AS n_rows, count(DISTINCT meter_customer_code) AS n_keys,
        {rs('max(energy)', 2)} AS max_energy FROM readings GROUP BY meter_type"""),
    "field_divergence": with_(["power_readings"], f"""SELECT meter_type,
        CAST(sum(CASE WHEN voltageAvg > voltageMax THEN 1 ELSE 0 END) AS BIGINT) AS n_avg_above_max,
        {rs('avg(abs(voltageMax - voltageMin))', 4)} AS avg_spread,
        {rs('max(abs(voltageMax - voltageMin))', 4)} AS max_spread FROM power_readings GROUP BY meter_type"""),
    "latest_n": with_(["readings"], f"""SELECT row_id, meter_customer_code, heartbeatStart,
        {rs('energy', 2)} AS energy FROM readings ORDER BY heartbeatStart DESC, row_id DESC LIMIT 10"""),
    "state_share": with_(["readings"], f"""SELECT meter_type, state, n, {rs('n / sum(n) OVER (PARTITION BY meter_type)', 6)}
        AS share FROM (SELECT meter_type, state, count(*) AS n FROM readings GROUP BY meter_type, state)"""),
    "completeness": with_(["readings"], f"""SELECT meter_customer_code, CAST(heartbeatStart AS DATE) AS day,
        count(*) AS n_readings, {rs('count(*) / 96.0', 6)} AS completeness FROM readings
        GROUP BY meter_customer_code, CAST(heartbeatStart AS DATE)"""),
    "uptime_by_month": with_(["readings"], f"""SELECT meter_type, strftime(heartbeatStart, '%Y-%m') AS ym,
        {rs('avg(CASE WHEN state = 1 THEN 1.0 ELSE 0.0 END)', 6)} AS uptime, count(*) AS n FROM readings
        GROUP BY ALL"""),
    "grid_losses": _grid_losses_sql(),
    "cutoff_flags": with_(["readings_with_site"], f"""SELECT row_id, meter_customer_code, heartbeatStart,
        {rs('truePowerAvg', 4)} AS truePowerAvg FROM readings_with_site WHERE truePowerInst = 0 AND truePowerAvg > 0"""),
    "payments_by_year": with_(["payments"], """SELECT CAST(year(transactionDatetime) AS INTEGER) AS year,
        count(*) AS n FROM payments GROUP BY ALL"""),
    "flag_sums": with_(["payments"], """SELECT country, CAST(sum(isTest) AS BIGINT) AS n_test,
        CAST(sum(isReversed) AS BIGINT) AS n_reversed, CAST(sum(isSignup) AS BIGINT) AS n_signup,
        count(*) AS n_rows, count(isReversed) AS n_reversed_known FROM payments GROUP BY country"""),
}
