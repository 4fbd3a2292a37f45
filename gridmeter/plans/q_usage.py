"""Registered queries: consumption and revenue per user, their statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.core import round_half_up as r_, sql_round as rs
from ..operators import stats as S
from ..operators import totals as N
from ..operators import usage as U
from ..session import checkpoint_dir
from . import bindings as B
from .sql_bindings import COUNTRIES_SQL, with_

MIN_SITE_N = 30


# ------------------------------------------------------------------ spark side
def _monthly_c(spark, d):
    return U.monthly_consumption(B.clean_series_long(spark, d))


def _monthly_mapped(spark, d):
    return U.map_sites(_monthly_c(spark, d), B.site_map(spark, d))


def _acpu(spark, d, n=MIN_SITE_N):
    return U.acpu(_monthly_mapped(spark, d), n)


def _monthly2_c(spark, d):
    m = _monthly_mapped(spark, d).where(F.col("monthly_kwh") * 1000.0 > 0)
    return U.months_since_first(m, "meter_customer_code")


def _rev(spark, d):
    return U.revenue_payments(B.payments(spark, d), B.COUNTRIES, 1995)


def _monthly_r(spark, d):
    return U.monthly_revenue(U.payments_with_class(_rev(spark, d), B.customers(spark, d)))


def _arpu(spark, d, n=MIN_SITE_N):
    return U.arpu(_monthly_r(spark, d), n)


def _monthly2_r(spark, d):
    return U.months_since_first(_monthly_r(spark, d), "customerAccountNumber")


def _rslopes(spark, d):
    m = _monthly2_r(spark, d)
    return S.group_slopes(m, "monthly_revenue", "months_since_first",
                          ["customerAccountNumber", "country"])


def _cslopes(spark, d):
    m = _monthly2_c(spark, d)
    return S.group_slopes(m, "monthly_kwh", "months_since_first",
                          ["meter_customer_code", "country"])


def q_monthly_consumption(spark, d):
    m = _monthly_c(spark, d)
    return m.select("meter_customer_code", "cust_class", "ym", "site_name",
                    r_("monthly_kwh", 4).alias("monthly_kwh"))


def _totals_by_batches(spark, d):
    """Monthly totals after two batches: in the first some values are wrong and some rows
    missing; the second takes the wrong ones back and brings the right ones, and runs twice."""
    c = B.clean_series_long(spark, d)
    part = F.pmod(F.xxhash64("meter_customer_code", "slot_start", "energy_kwh"), F.lit(10))
    wrong = c.where(part < 2).withColumn("energy_kwh", F.col("energy_kwh") + 1.5)
    plus, minus = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/gridmeter-totals-{uuid.uuid4().hex}"
    N.apply_batch(folder, 0, c.where(part >= 3).select("*", plus).unionByName(wrong.select("*", plus)))
    for _ in range(2):
        N.apply_batch(folder, 1, c.where(part < 3).select("*", plus).unionByName(wrong.select("*", minus)))
    return N.monthly_consumption(spark, folder)


def q_monthly_totals_by_batches(spark, d):
    return _totals_by_batches(spark, d).select("meter_customer_code", "cust_class", "ym", "site_name", r_("monthly_kwh", 4).alias("monthly_kwh"))


def q_consumption_slopes_by_batches(spark, d):
    m = U.map_sites(_totals_by_batches(spark, d), B.site_map(spark, d)).where(F.col("monthly_kwh") * 1000.0 > 0)
    s = S.group_slopes(U.months_since_first(m, "meter_customer_code"), "monthly_kwh", "months_since_first", ["meter_customer_code", "country"])
    return s.select("meter_customer_code", "country", "n", r_("slope", 6).alias("slope"))


def q_map_site_project(spark, d):
    m = _monthly_mapped(spark, d)
    return m.select("meter_customer_code", "cust_class", "ym", "projectName", "country",
                    r_("monthly_kwh", 4).alias("monthly_kwh"))


def _summary_out(df, code, total, mean):
    return df.select(code, "country", "cust_class", "projectName",
                     r_(total, 2).alias(total), "active_months", "first_month", "last_month",
                     r_(mean, 4).alias(mean), "date_range_months")


def q_acpu(spark, d):
    return _summary_out(_acpu(spark, d), "meter_customer_code", "total_wh", "acpu")


def q_min_site_customers(spark, d):
    a = _acpu(spark, d, 60)
    return a.select("meter_customer_code", "country", "projectName")


def q_months_since_first(spark, d):
    m = _monthly2_c(spark, d)
    return m.select("meter_customer_code", "ym", "site_name", "months_since_first")


def q_tenure_points(spark, d):
    m = _monthly2_c(spark, d)
    p = U.quantile_cap(m, "monthly_kwh", 0.99, ["country"])
    return p.select("meter_customer_code", "country", "ym", "site_name", "months_since_first",
                    r_("monthly_kwh", 4).alias("monthly_kwh"))


def q_tenure_curve(spark, d):
    m = _monthly2_c(spark, d)
    t = U.tenure_curve(m, "monthly_kwh", ["country"], 10)
    return t.select("country", "months_since_first", r_("mean", 4).alias("mean"), "count")


def q_consumption_slopes(spark, d):
    s = _cslopes(spark, d)
    return s.select("meter_customer_code", "country", "n", r_("slope", 6).alias("slope"))


def q_revenue_payments(spark, d):
    p = _rev(spark, d)
    return p.select("customerAccountNumber", r_("amount", 2).alias("amount"), "country",
                    "projectName", "transactionDatetime")


def q_payments_with_class(spark, d):
    p = U.payments_with_class(_rev(spark, d), B.customers(spark, d))
    return p.select("customerAccountNumber", r_("amount", 2).alias("amount"), "country",
                    "cust_class", "transactionDatetime")


def q_monthly_revenue(spark, d):
    m = _monthly_r(spark, d)
    return m.select("customerAccountNumber", "country", "cust_class", "projectName", "ym",
                    r_("monthly_revenue", 2).alias("monthly_revenue"))


def q_arpu(spark, d):
    return _summary_out(_arpu(spark, d), "customerAccountNumber", "total_revenue", "arpu")


def q_fx_convert(spark, d):
    p = U.fx_convert(_rev(spark, d), B.fx_rates(spark))
    return p.select("customerAccountNumber", "country", "transactionDatetime",
                    r_("amount", 4).alias("amount_usd"))


def q_revenue_slopes(spark, d):
    s = _rslopes(spark, d)
    return s.select("customerAccountNumber", "country", "n", r_("slope", 4).alias("slope"))


def q_slope_ttest(spark, d):
    t = S.one_sample_t(_rslopes(spark, d), "slope", ["country"])
    return t.select("country", "n", r_("mean", 4).alias("mean"), r_("t", 6).alias("t"), "dof")


def q_slope_ttest_pvalue(spark, d):
    t = S.one_sample_t(_rslopes(spark, d), "slope", ["country"])
    return t.select("country", "n", r_("t", 6).alias("t"), r_(S.t_pvalue("t", "dof"), 6).alias("p"))


def q_site_medians(spark, d):
    a = _arpu(spark, d)
    g = S.exact_quantiles(a, "arpu", ["country", "projectName"], [0.5])
    g = g.withColumnRenamed("q0", "median_arpu")
    # sites ordered by their median within each country (O3)
    return (g.select("country", "projectName", r_("median_arpu", 4).alias("median_arpu"), "n")
             .orderBy("country", "median_arpu", "projectName"))


def q_describe_by_class(spark, d):
    a = _acpu(spark, d)
    s = S.describe(a, "acpu", ["country", "cust_class"])
    return s.select("country", "cust_class", "count",
                    *[r_(c, 1).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "p95", "max"]])


def q_log_histogram(spark, d):
    a = _arpu(spark, d)
    h = S.log_histogram(a, "arpu", "country", "cust_class", exclude_classes=["Unknown"])
    return h.select("country", "cust_class", "bin", r_("edge_lo", 4).alias("edge_lo"),
                    r_("edge_hi", 4).alias("edge_hi"), "count", r_("density", 10).alias("density"),
                    r_("class_mean", 4).alias("class_mean"), "n_class")


def q_slope_histogram(spark, d):
    h = S.clipped_histogram(_rslopes(spark, d), "slope", "country", 60)
    return h.select("country", "bin", r_("edge_lo", 4).alias("edge_lo"), "count")


def q_boxplot_stats(spark, d):
    b = S.boxplot_stats(_arpu(spark, d), "arpu", ["country", "projectName"])
    return b.select("country", "projectName", "n",
                    *[r_(c, 4).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                    "n_outliers")


def q_boxplot_outliers(spark, d):
    b = S.boxplot_outliers(_arpu(spark, d), "arpu", ["country", "projectName"],
                           "customerAccountNumber")
    return b.select("country", "projectName", "customerAccountNumber", r_("arpu", 4).alias("arpu"))


def q_quantile_cap(spark, d):
    m = _monthly2_r(spark, d)
    p = U.quantile_cap(m, "monthly_revenue", 0.99, ["country"])
    return p.select("customerAccountNumber", "country", "ym", "months_since_first",
                    r_("monthly_revenue", 2).alias("monthly_revenue"))


def q_arpu_usd(spark, d):
    """ARPU with amounts converted to USD at the nearest year's rate."""
    p = U.fx_convert(_rev(spark, d), B.fx_rates(spark))
    m = U.monthly_revenue(U.payments_with_class(p, B.customers(spark, d)))
    return _summary_out(U.arpu(m, MIN_SITE_N), "customerAccountNumber", "total_revenue", "arpu")


def q_acpu_log_histogram(spark, d):
    h = S.log_histogram(_acpu(spark, d), "acpu", "country", "cust_class")
    return h.select("country", "cust_class", "bin", r_("edge_lo", 4).alias("edge_lo"),
                    r_("edge_hi", 4).alias("edge_hi"), "count", r_("density", 12).alias("density"),
                    r_("class_mean", 4).alias("class_mean"), "n_class")


def q_acpu_boxplot_stats(spark, d):
    b = S.boxplot_stats(_acpu(spark, d), "acpu", ["country", "projectName"])
    return b.select("country", "projectName", "n",
                    *[r_(c, 4).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                    "n_outliers")


def q_consumption_slope_histogram(spark, d):
    h = S.clipped_histogram(_cslopes(spark, d), "slope", "country", 60)
    return h.select("country", "bin", r_("edge_lo", 6).alias("edge_lo"), "count")


def q_consumption_slope_ttest(spark, d):
    t = S.one_sample_t(_cslopes(spark, d), "slope", ["country"])
    return t.select("country", "n", r_("mean", 6).alias("mean"), r_("t", 6).alias("t"), "dof")


def q_revenue_tenure_curve(spark, d):
    t = U.tenure_curve(_monthly2_r(spark, d), "monthly_revenue", ["country"], 10)
    return t.select("country", "months_since_first", r_("mean", 2).alias("mean"), "count")


QUERIES = {
    "arpu_usd": q_arpu_usd,
    "acpu_log_histogram": q_acpu_log_histogram,
    "acpu_boxplot_stats": q_acpu_boxplot_stats,
    "consumption_slope_histogram": q_consumption_slope_histogram,
    "consumption_slope_ttest": q_consumption_slope_ttest,
    "revenue_tenure_curve": q_revenue_tenure_curve,
    "monthly_consumption": q_monthly_consumption,
    "map_site_project": q_map_site_project,
    "acpu": q_acpu,
    "min_site_customers": q_min_site_customers,
    "months_since_first": q_months_since_first,
    "tenure_points": q_tenure_points,
    "tenure_curve": q_tenure_curve,
    "consumption_slopes": q_consumption_slopes,
    "revenue_payments": q_revenue_payments,
    "payments_with_class": q_payments_with_class,
    "monthly_revenue": q_monthly_revenue,
    "arpu": q_arpu,
    "fx_convert": q_fx_convert,
    "revenue_slopes": q_revenue_slopes,
    "slope_ttest": q_slope_ttest,
    "slope_ttest_pvalue": q_slope_ttest_pvalue,
    "site_medians": q_site_medians,
    "monthly_totals_by_batches": q_monthly_totals_by_batches,
    "consumption_slopes_by_batches": q_consumption_slopes_by_batches,
    "describe_by_class": q_describe_by_class,
    "log_histogram": q_log_histogram,
    "slope_histogram": q_slope_histogram,
    "boxplot_stats": q_boxplot_stats,
    "boxplot_outliers": q_boxplot_outliers,
    "quantile_cap": q_quantile_cap,
}


# ------------------------------------------------------------------ oracle SQL
ORD = "(CAST(substr(ym, 1, 4) AS INTEGER) * 12 + CAST(substr(ym, 6, 2) AS INTEGER))"

STEPS = {
    "mc": """SELECT meter_customer_code,
        CASE WHEN coalesce(lower(trim(tariff)) = 'residential', false) THEN 'Residential' ELSE 'Commercial' END AS cust_class,
        strftime(slot_start, '%Y-%m') AS ym, site_name, sum(energy_kwh) AS monthly_kwh
      FROM clean_long WHERE meter_type = 'customer' GROUP BY ALL""",
    "mm": "SELECT mc.*, sm.projectName, sm.country FROM mc JOIN site_map sm USING (site_name)",
    "mw": "SELECT *, monthly_kwh * 1000.0 AS monthly_wh FROM mm WHERE monthly_kwh * 1000.0 > 0",
    "acpu0": f"""SELECT meter_customer_code, country, cust_class, projectName,
        sum(monthly_wh) AS total_wh, count(monthly_wh) AS active_months,
        min(ym) AS first_month, max(ym) AS last_month, avg(monthly_wh) AS acpu,
        CAST(max({ORD}) - min({ORD}) + 1 AS INTEGER) AS date_range_months
      FROM mw GROUP BY meter_customer_code, country, cust_class, projectName""",
    "acpu_sites": f"""SELECT country, projectName FROM acpu0 GROUP BY ALL
      HAVING count(DISTINCT meter_customer_code) >= {MIN_SITE_N}""",
    "acpu": "SELECT * FROM acpu0 SEMI JOIN acpu_sites USING (country, projectName)",
    "m2c": f"""SELECT mw.*, CAST({ORD} - min({ORD}) OVER (PARTITION BY meter_customer_code) AS INTEGER)
        AS months_since_first FROM mw""",
    "rev": f"""SELECT customerAccountNumber, amount, currency, {{title}} AS country, projectName, transactionDatetime
      FROM payments
      WHERE isTest IS DISTINCT FROM 1 AND isReversed IS DISTINCT FROM 1 AND isSignup IS DISTINCT FROM 1
        AND isBalanceTransfer IS DISTINCT FROM 1 AND amount > 0 AND transactionDatetime IS NOT NULL
        AND year(transactionDatetime) >= 1995 AND {{title}} IN {COUNTRIES_SQL}""",
    "pc": """SELECT rev.*, c.customerType,
        CASE WHEN c.customerType IS NULL THEN 'Unknown' WHEN c.customerType = 'Residential' THEN 'Residential'
             ELSE 'Commercial' END AS cust_class
      FROM rev LEFT JOIN (SELECT customerAccountNumber, customerType FROM customers) c USING (customerAccountNumber)""",
    "mr": """SELECT customerAccountNumber, country, cust_class, projectName,
        strftime(transactionDatetime, '%Y-%m') AS ym, sum(amount) AS monthly_revenue
      FROM pc WHERE customerAccountNumber IS NOT NULL AND country IS NOT NULL AND cust_class IS NOT NULL
        AND projectName IS NOT NULL GROUP BY ALL""",
    "arpu0": f"""SELECT customerAccountNumber, country, cust_class, projectName,
        sum(monthly_revenue) AS total_revenue, count(monthly_revenue) AS active_months,
        min(ym) AS first_month, max(ym) AS last_month, avg(monthly_revenue) AS arpu,
        CAST(max({ORD}) - min({ORD}) + 1 AS INTEGER) AS date_range_months
      FROM mr GROUP BY customerAccountNumber, country, cust_class, projectName""",
    "arpu_sites": f"""SELECT country, projectName FROM arpu0 GROUP BY ALL
      HAVING count(DISTINCT customerAccountNumber) >= {MIN_SITE_N}""",
    "arpu": "SELECT * FROM arpu0 SEMI JOIN arpu_sites USING (country, projectName)",
    "m2r": f"""SELECT mr.*, CAST({ORD} - min({ORD}) OVER (PARTITION BY customerAccountNumber) AS INTEGER)
        AS months_since_first FROM mr""",
    "rs": """SELECT customerAccountNumber, country, count(*) AS n,
        CASE WHEN count(*) >= 3 THEN regr_slope(monthly_revenue, months_since_first) END AS slope
      FROM m2r GROUP BY customerAccountNumber, country""",
    "cs": """SELECT meter_customer_code, country, count(*) AS n,
        CASE WHEN count(*) >= 3 THEN regr_slope(monthly_kwh, months_since_first) END AS slope
      FROM m2c GROUP BY meter_customer_code, country""",
}


def _steps():
    from .sql_bindings import title
    s = dict(STEPS)
    s["rev"] = s["rev"].replace("{title}", title("trim(country)"))
    return s


def _sql(body: str, upto: list[str], bindings=("clean_long", "site_map", "payments", "customers")) -> str:
    st = _steps()
    extra = {k: st[k] for k in upto}
    return with_(list(bindings), body, extra)


_C = ["mc", "mm", "mw", "acpu0", "acpu_sites", "acpu"]
_C2 = ["mc", "mm", "mw", "m2c"]
_R = ["rev", "pc", "mr", "arpu0", "arpu_sites", "arpu"]
_R2 = ["rev", "pc", "mr", "m2r"]


def _summary_sql(src, code, total, mean):
    return f"""SELECT {code}, country, cust_class, projectName, {rs(total, 2)} AS {total},
        active_months, first_month, last_month, {rs(mean, 4)} AS {mean}, date_range_months FROM {src}"""


def _qhist_sql(src="arpu", val="arpu", exclude_unknown=True):
    from ..operators.stats import sql_bin_index
    bins = 49
    a = "log10(lo)"
    b = "log10(hi)"
    step = f"((({b}) - ({a})) / {float(bins)})"

    def edge(i):
        return (f"(CASE WHEN ({i}) <= 0 THEN lo WHEN ({i}) >= {bins} THEN hi "
                f"ELSE least(greatest(pow(10.0, CAST({i} AS DOUBLE) * {step} + {a}), lo), hi) END)")
    i0 = f"CAST(floor((log10({val}) - {a}) / nullif({step}, 0)) AS BIGINT)"
    i1 = f"(CASE WHEN {val} < {edge(i0)} THEN {i0} - 1 WHEN {val} >= {edge(i0 + ' + 1')} THEN {i0} + 1 ELSE {i0} END)"
    binc = (f"(CASE WHEN {val} >= lo AND {val} <= hi THEN CAST(CASE WHEN {val} = hi THEN {bins - 1} "
            f"ELSE least(greatest({i1}, 0), {bins - 1}) END AS INTEGER) END)")
    del sql_bin_index
    extra = {
        "hd": f"SELECT * FROM {src} WHERE {val} IS NOT NULL" + (" AND cust_class <> 'Unknown'" if exclude_unknown else ""),
        "hq": f"""SELECT country, greatest(quantile_cont({val}, 0.01), 0.001) AS lo,
                 quantile_cont({val}, 0.99) AS hi FROM hd GROUP BY country""",
        "hq2": "SELECT country, lo, greatest(lo, hi) AS hi FROM hq",
        "hj": f"SELECT hd.*, hq2.lo, hq2.hi, {binc} AS bin_i FROM hd JOIN hq2 USING (country)",
        "hs": f"""SELECT country, cust_class, avg({val}) AS class_mean, count({val}) AS n_class,
                 count(bin_i) AS n_in_range FROM hj GROUP BY ALL""",
        "hc": "SELECT country, cust_class, bin_i, count(*) AS count FROM hj WHERE bin_i IS NOT NULL GROUP BY ALL",
        "hsp": "SELECT hs.*, CAST(unnest(range(49)) AS INTEGER) AS bin_i FROM hs",
        "ho": f"""SELECT hsp.country, hsp.cust_class, hsp.bin_i, coalesce(hc.count, 0) AS count,
                 n_in_range, class_mean, n_class, {edge('hsp.bin_i')} AS edge_lo, {edge('hsp.bin_i + 1')} AS edge_hi
                 FROM hsp LEFT JOIN hc USING (country, cust_class, bin_i) JOIN hq2 USING (country)""",
    }
    body = f"""SELECT country, cust_class, bin_i AS "bin", {rs('edge_lo', 4)} AS edge_lo, {rs('edge_hi', 4)} AS edge_hi,
        CAST(count AS BIGINT) AS count,
        {rs('CASE WHEN n_in_range > 0 THEN count / nullif(n_in_range * (edge_hi - edge_lo), 0) END', 10)} AS density,
        {rs('class_mean', 4)} AS class_mean, n_class FROM ho"""
    return body, extra


def _slope_hist_sql(src="rs", digits=4):
    from ..operators.stats import sql_bin_index
    clipped = "least(greatest(slope, lo), hi)"
    extra = {
        "sd": f"SELECT * FROM {src} WHERE slope IS NOT NULL",
        "sq": "SELECT country, quantile_cont(slope, 0.01) AS lo, quantile_cont(slope, 0.99) AS hi FROM sd GROUP BY country",
        "sb": f"""SELECT country, lo, hi, CASE WHEN hi > lo THEN {sql_bin_index(clipped, 'lo', 'hi', 60)} ELSE 0 END AS bin_i
                  FROM sd JOIN sq USING (country)""",
    }
    edge = "CAST(s.bin_i AS DOUBLE) * ((hi - lo) / 60.0) + lo"
    body = f"""SELECT s.country, s.bin_i AS "bin", {rs(edge, digits)} AS edge_lo, coalesce(c.n, 0) AS count
        FROM (SELECT sq.*, CAST(unnest(range(60)) AS INTEGER) AS bin_i FROM sq) s
        LEFT JOIN (SELECT country, bin_i, count(*) AS n FROM sb GROUP BY country, bin_i) c
        ON c.country IS NOT DISTINCT FROM s.country AND c.bin_i = s.bin_i"""
    return body, extra


def _box_extra(src="arpu", val="arpu"):
    return {
        "bq": f"""SELECT country, projectName, count({val}) AS n, quantile_cont({val}, 0.25) AS q1,
                  quantile_cont({val}, 0.5) AS median, quantile_cont({val}, 0.75) AS q3
                  FROM {src} WHERE {val} IS NOT NULL GROUP BY country, projectName""",
        "bw": f"""SELECT country, projectName,
                  min(CASE WHEN {val} >= q1 - 1.5 * (q3 - q1) THEN {val} END) AS whisker_lo,
                  max(CASE WHEN {val} <= q3 + 1.5 * (q3 - q1) THEN {val} END) AS whisker_hi,
                  count(CASE WHEN {val} < q1 - 1.5 * (q3 - q1) OR {val} > q3 + 1.5 * (q3 - q1) THEN {val} END) AS n_outliers
                  FROM {src} JOIN bq USING (country, projectName) WHERE {val} IS NOT NULL
                  GROUP BY country, projectName""",
    }


def _build_sql():
    from .sql_bindings import title
    sql = {}
    sql["monthly_consumption"] = _sql(f"""SELECT meter_customer_code, cust_class, ym, site_name,
        {rs('monthly_kwh', 4)} AS monthly_kwh FROM mc""", ["mc"])
    sql["map_site_project"] = _sql(f"""SELECT meter_customer_code, cust_class, ym, projectName, country,
        {rs('monthly_kwh', 4)} AS monthly_kwh FROM mm""", ["mc", "mm"])
    sql["acpu"] = _sql(_summary_sql("acpu", "meter_customer_code", "total_wh", "acpu"), _C)
    st = _steps()
    extra60 = {k: st[k] for k in _C}
    extra60["acpu_sites"] = extra60["acpu_sites"].replace(f">= {MIN_SITE_N}", ">= 60")
    sql["min_site_customers"] = with_(["clean_long", "site_map"],
                                      "SELECT meter_customer_code, country, projectName FROM acpu", extra60)
    sql["months_since_first"] = _sql("""SELECT meter_customer_code, ym, site_name, months_since_first
        FROM m2c""", _C2)
    sql["tenure_points"] = _sql(f"""SELECT meter_customer_code, m2c.country, ym, site_name, months_since_first,
        {rs('monthly_kwh', 4)} AS monthly_kwh FROM m2c JOIN (SELECT country, quantile_cont(monthly_kwh, 0.99) AS cap
        FROM m2c GROUP BY country) q ON q.country = m2c.country WHERE monthly_kwh <= cap""", _C2)
    sql["tenure_curve"] = _sql(f"""SELECT country, months_since_first, {rs('avg(monthly_kwh)', 4)} AS mean,
        count(monthly_kwh) AS count FROM m2c GROUP BY country, months_since_first
        HAVING count(monthly_kwh) >= 10""", _C2)
    sql["consumption_slopes"] = _sql(f"""SELECT meter_customer_code, country, n, {rs('slope', 6)} AS slope
        FROM cs""", _C2 + ["cs"])
    sql["monthly_totals_by_batches"], sql["consumption_slopes_by_batches"] = sql["monthly_consumption"], sql["consumption_slopes"]
    sql["revenue_payments"] = _sql(f"""SELECT customerAccountNumber, {rs('amount', 2)} AS amount, country,
        projectName, transactionDatetime FROM rev""", ["rev"])
    sql["payments_with_class"] = _sql(f"""SELECT customerAccountNumber, {rs('amount', 2)} AS amount, country,
        cust_class, transactionDatetime FROM pc""", ["rev", "pc"])
    sql["monthly_revenue"] = _sql(f"""SELECT customerAccountNumber, country, cust_class, projectName, ym,
        {rs('monthly_revenue', 2)} AS monthly_revenue FROM mr""", ["rev", "pc", "mr"])
    sql["arpu"] = _sql(_summary_sql("arpu", "customerAccountNumber", "total_revenue", "arpu"), _R)
    sql["fx_convert"] = _sql(f"""SELECT customerAccountNumber, rev.country, transactionDatetime,
        {rs('amount / fx.rate', 4)} AS amount_usd
        FROM rev JOIN (
          SELECT country, year, rate FROM (
            SELECT k.country, k.year, r.rate, row_number() OVER (
              PARTITION BY k.country, k.year ORDER BY abs(r.year - k.year), r.year) AS rn
            FROM (SELECT DISTINCT country, year(transactionDatetime) AS year FROM rev) k
            JOIN fx_rates r ON r.country = k.country AND r.rate IS NOT NULL) WHERE rn = 1) fx
        ON fx.country = rev.country AND fx.year = year(rev.transactionDatetime)""", ["rev"],
        bindings=("payments", "customers", "fx_rates"))
    sql["revenue_slopes"] = _sql(f"""SELECT customerAccountNumber, country, n, {rs('slope', 4)} AS slope
        FROM rs""", _R2 + ["rs"])
    sql["slope_ttest"] = _sql(f"""SELECT country, count(slope) AS n, {rs('avg(slope)', 4)} AS mean,
        {rs('avg(slope) / (stddev_samp(slope) / sqrt(count(slope)))', 6)} AS t,
        CAST(count(slope) - 1 AS BIGINT) AS dof FROM rs WHERE slope IS NOT NULL GROUP BY country""",
                              _R2 + ["rs"])
    sql["slope_ttest_pvalue"] = _sql(f"""SELECT country, n, {rs('t', 6)} AS t, {rs(S.sql_t_pvalue('t', 'dof'), 6)} AS p FROM (
        SELECT country, count(slope) AS n, avg(slope) / (stddev_samp(slope) / sqrt(count(slope))) AS t,
        CAST(count(slope) - 1 AS DOUBLE) AS dof FROM rs WHERE slope IS NOT NULL GROUP BY country)""", _R2 + ["rs"])
    sql["site_medians"] = _sql(f"""SELECT country, projectName, {rs('quantile_cont(arpu, 0.5)', 4)} AS median_arpu,
        count(*) AS n FROM arpu GROUP BY country, projectName""", _R)
    pc = ", ".join(f"{rs(f'quantile_cont(acpu, {p})', 1)} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95))
    sql["describe_by_class"] = _sql(f"""SELECT country, cust_class, count(acpu) AS count,
        {rs('avg(acpu)', 1)} AS mean, {rs('stddev_samp(acpu)', 1)} AS std, {rs('min(acpu)', 1)} AS min,
        {pc}, {rs('max(acpu)', 1)} AS max FROM acpu WHERE acpu IS NOT NULL GROUP BY country, cust_class""", _C)
    body, extra = _qhist_sql()
    st = _steps()
    ex = {k: st[k] for k in _R}
    ex.update(extra)
    sql["log_histogram"] = with_(["payments", "customers"], body, ex)
    body, extra = _slope_hist_sql()
    ex = {k: st[k] for k in _R2 + ["rs"]}
    ex.update(extra)
    sql["slope_histogram"] = with_(["payments", "customers"], body, ex)
    ex = {k: st[k] for k in _R}
    ex.update(_box_extra())
    sql["boxplot_stats"] = with_(["payments", "customers"], f"""SELECT country, projectName, n,
        {rs('q1', 4)} AS q1, {rs('median', 4)} AS median, {rs('q3', 4)} AS q3,
        {rs('whisker_lo', 4)} AS whisker_lo, {rs('whisker_hi', 4)} AS whisker_hi, n_outliers
        FROM bq JOIN bw USING (country, projectName)""", ex)
    sql["boxplot_outliers"] = with_(["payments", "customers"], f"""SELECT country, projectName,
        customerAccountNumber, {rs('arpu', 4)} AS arpu FROM arpu JOIN bw USING (country, projectName)
        WHERE arpu IS NOT NULL AND (arpu < whisker_lo OR arpu > whisker_hi)""", ex)
    sql["quantile_cap"] = _sql(f"""SELECT customerAccountNumber, m2r.country, ym, months_since_first,
        {rs('monthly_revenue', 2)} AS monthly_revenue FROM m2r JOIN (SELECT country,
        quantile_cont(monthly_revenue, 0.99) AS cap FROM m2r GROUP BY country) q ON q.country = m2r.country
        WHERE monthly_revenue <= cap""", _R2)
    # ARPU in USD: the payments pass through the nearest-year rate first
    st = _steps()
    exu = {k: st[k] for k in _R}
    exu["rev"] = f"""SELECT r0.customerAccountNumber, r0.amount / fx.rate AS amount, r0.currency, r0.country,
        r0.projectName, r0.transactionDatetime FROM ({st['rev']}) r0 JOIN (
          SELECT country, year, rate FROM (
            SELECT k.country, k.year, r.rate, row_number() OVER (
              PARTITION BY k.country, k.year ORDER BY abs(r.year - k.year), r.year) AS rn
            FROM (SELECT DISTINCT {title('trim(country)')} AS country, year(transactionDatetime) AS year
                  FROM payments) k
            JOIN fx_rates r ON r.country = k.country AND r.rate IS NOT NULL) WHERE rn = 1) fx
        ON fx.country = r0.country AND fx.year = year(r0.transactionDatetime)"""
    sql["arpu_usd"] = with_(["payments", "customers", "fx_rates"],
                            _summary_sql("arpu", "customerAccountNumber", "total_revenue", "arpu"), exu)
    # consumption / revenue mirrors of the statistics above
    body, extra = _qhist_sql("acpu", "acpu", exclude_unknown=False)
    body = body.replace(f"{rs('CASE WHEN n_in_range > 0 THEN count / nullif(n_in_range * (edge_hi - edge_lo), 0) END', 10)}",
                        f"{rs('CASE WHEN n_in_range > 0 THEN count / nullif(n_in_range * (edge_hi - edge_lo), 0) END', 12)}")
    ex = {k: st[k] for k in _C}
    ex.update(extra)
    sql["acpu_log_histogram"] = with_(["clean_long", "site_map"], body, ex)
    ex = {k: st[k] for k in _C}
    ex.update(_box_extra("acpu", "acpu"))
    sql["acpu_boxplot_stats"] = with_(["clean_long", "site_map"], f"""SELECT country, projectName, n,
        {rs('q1', 4)} AS q1, {rs('median', 4)} AS median, {rs('q3', 4)} AS q3,
        {rs('whisker_lo', 4)} AS whisker_lo, {rs('whisker_hi', 4)} AS whisker_hi, n_outliers
        FROM bq JOIN bw USING (country, projectName)""", ex)
    body, extra = _slope_hist_sql("cs", 6)
    ex = {k: st[k] for k in _C2 + ["cs"]}
    ex.update(extra)
    sql["consumption_slope_histogram"] = with_(["clean_long", "site_map"], body, ex)
    sql["consumption_slope_ttest"] = _sql(f"""SELECT country, count(slope) AS n, {rs('avg(slope)', 6)} AS mean,
        {rs('avg(slope) / (stddev_samp(slope) / sqrt(count(slope)))', 6)} AS t,
        CAST(count(slope) - 1 AS BIGINT) AS dof FROM cs WHERE slope IS NOT NULL GROUP BY country""",
                                          _C2 + ["cs"])
    sql["revenue_tenure_curve"] = _sql(f"""SELECT country, months_since_first, {rs('avg(monthly_revenue)', 2)} AS mean,
        count(monthly_revenue) AS count FROM m2r GROUP BY country, months_since_first
        HAVING count(monthly_revenue) >= 10""", _R2)
    return sql


SQL = _build_sql()
