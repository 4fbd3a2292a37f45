"""Registered queries: power quality, load profile and carbon accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_half_up as r_, sql_round as rs
from ..operators import carbon as K
from ..operators import clean as C
from ..operators import profiles as P
from ..operators import stats as S
from . import bindings as B
from .q_clean import _sql_steps
from .sql_bindings import with_
from ..session import materialize

V = (50.0, 300.0, 250)
PF = (0.0, 1.0, 200)
TARIFF_PATTERN = "click"


# ------------------------------------------------------------------ power quality
def _pq(spark, d):
    p = B.power_readings(spark, d).where(F.col("meter_type") == "customer")
    vmask = None
    for c in ("voltageMin", "voltageAvg", "voltageMax"):
        m = (F.col(c) > V[0]) & (F.col(c) <= V[1])
        vmask = m if vmask is None else vmask & m
    return p.where(vmask)


def _vhist(spark, d):
    return S.histogram(_pq(spark, d), ["voltageMin", "voltageAvg", "voltageMax"], *V)


def q_voltage_histogram(spark, d):
    h = _vhist(spark, d)
    return h.select("series", "bin", r_("bin_center", 4).alias("bin_center"), "count")


def q_voltage_pf_density(spark, d):
    p = _pq(spark, d).where((F.col("powerFactorAvg") > PF[0]) & (F.col("powerFactorAvg") <= PF[1]))
    h = S.histogram2d(p, "voltageAvg", "powerFactorAvg", V, PF)
    return h.select(F.col("x_bin").alias("v_bin"), F.col("y_bin").alias("pf_bin"),
                    r_("x_bin_center", 4).alias("v_bin_center"),
                    r_("y_bin_center", 4).alias("pf_bin_center"), "count")


def q_hist_density(spark, d):
    h = S.hist_density(_vhist(spark, d), (V[1] - V[0]) / V[2])
    return h.select("series", "bin", "count", "total", r_("density", 8).alias("density"),
                    r_("series_mean", 4).alias("series_mean"))


def q_pivot_counts(spark, d):
    """Histogram counts pivoted to one column per series (reshape)."""
    h = _vhist(spark, d)
    return (h.groupBy("bin").pivot("series", ["voltageMin", "voltageAvg", "voltageMax"])
             .agg(F.sum("count")))


# ------------------------------------------------------------------ load profile
def _clean_site(spark, d, only=None, readings=None):
    """Clean series with the customer's site.  ``only`` (meter codes) limits
    the meters before cleaning -- cleaning is per meter, so this equals
    filtering the clean series afterwards, for a fraction of the work."""
    r = readings if readings is not None else B.readings(spark, d, 15)
    if only is not None:
        r = r.join(only, "meter_customer_code", "left_semi")
    c = C.clean_readings(r, order_extra=["row_id"])
    cu = B.customers(spark, d).select(F.col("customerAccountNumber").alias("meter_customer_code"),
                                      F.col("projectName").alias("site_name"))
    return c.join(cu, "meter_customer_code", "inner")


def _offsets(spark, d):
    return B.projects(spark, d).select(F.col("projectName").alias("site_name"),
                                       F.col("timezoneOffsetUtc").alias("utc_offset"))


def _matching(spark, d, readings=None):
    r = C.coerce_readings(readings if readings is not None else B.readings(spark, d))
    modal = C.modal_tariff(r, "meter_customer_code", "meter_tariff_name", "tariff")
    return P.customers_by_tariff(modal, TARIFF_PATTERN)


def q_site_utc_offset(spark, d):
    return P.site_utc_offset(B.stations(spark, d), B.projects(spark, d))


def q_customers_by_tariff(spark, d):
    return _matching(spark, d)


def q_time_of_day(spark, d):
    c = _clean_site(spark, d).join(_offsets(spark, d), "site_name", "inner")
    t = P.time_of_day(c)
    return t.select("meter_customer_code", "meter_type", "slot_start", "utc_offset", "tod_slot", "tod_hour")


def _lp(spark, d, observed_only=False):
    r = B.readings(spark, d, 15)
    # the matching meters are a small table read by two joins: written once
    m = materialize(_matching(spark, d, r), "matching-meters")
    return P.load_profile(_clean_site(spark, d, m, r), _offsets(spark, d), m,
                          observed_only=observed_only)


def q_load_profile(spark, d):
    s = _lp(spark, d)
    return s.select("level", "grp", "n", *[r_(c, 6).alias(c) for c in ["mean", "std", "median", "q1", "q3"]])


def q_load_profile_ci(spark, d):
    s = P.load_profile_ci(_lp(spark, d))
    return s.select("level", "grp", "n", *[r_(c, 4).alias(c) for c in
                                           ["mean_wh", "ci_lo_wh", "ci_hi_wh", "median_wh", "q1_wh", "q3_wh"]])


def q_load_profile_observed(spark, d):
    s = _lp(spark, d, observed_only=True)
    return s.select("level", "grp", "n", *[r_(c, 6).alias(c) for c in ["mean", "median"]])


# ------------------------------------------------------------------ carbon
def _annual(spark, d):
    return K.annual_consumption(B.clean_series_long(spark, d), B.project_overrides(spark))


def _projects_meta(spark, d):
    return B.projects(spark, d).withColumn("projectName", F.regexp_replace("projectName", "_", " "))


def _carbon(spark, d):
    return K.carbon_accounting(_annual(spark, d), _projects_meta(spark, d))


def q_annual_consumption(spark, d):
    a = _annual(spark, d)
    return a.select("project", "meter_customer_code", "year", "is_residential",
                    r_("annual_kwh", 4).alias("annual_kwh"))


def q_site_rollup(spark, d):
    s = B.clean_series_long(spark, d).select("site_name").distinct().where(F.col("site_name").isNotNull())
    return K.site_rollup(s, B.project_overrides(spark)).select("site_name", "project")


def q_co2e_by_customer_year(spark, d):
    a = _annual(spark, d).withColumn("co2e_tonne", K.co2e())
    return a.select("project", "meter_customer_code", "year", "is_residential",
                    r_("co2e_tonne", 8).alias("co2e_tonne"))


def q_carbon_accounting(spark, d):
    c = _carbon(spark, d)
    return c.select("project", r_("avg_annual_co2e", 6).alias("avg_annual_co2e"), "n_years",
                    "customer_count", r_("sizePv", 4).alias("sizePv"), r_("capex", 4).alias("capex"))


def q_projects_without_full_years(spark, d):
    return K.projects_without_full_years(_annual(spark, d))


def _fit(spark, d, exclude=None):
    c = _carbon(spark, d)
    if exclude:
        c = c.where(F.col("project") != exclude)
    f = S.linear_fit(c, "avg_annual_co2e", {"sizePv": F.col("sizePv"),
                                            "customer_count": F.col("customer_count"),
                                            "capex_k": F.col("capex") * 1e-3})
    return f.select("variable", "n", r_("slope", 6).alias("slope"), r_("intercept", 6).alias("intercept"))


def q_carbon_fit(spark, d):
    return _fit(spark, d)


def q_carbon_fit_excluding(spark, d):
    return _fit(spark, d, "Nations 1 and 2")


QUERIES = {
    "voltage_histogram": q_voltage_histogram,
    "voltage_pf_density": q_voltage_pf_density,
    "hist_density": q_hist_density,
    "pivot_counts": q_pivot_counts,
    "site_utc_offset": q_site_utc_offset,
    "customers_by_tariff": q_customers_by_tariff,
    "time_of_day": q_time_of_day,
    "load_profile": q_load_profile,
    "load_profile_ci": q_load_profile_ci,
    "load_profile_observed": q_load_profile_observed,
    "annual_consumption": q_annual_consumption,
    "site_rollup": q_site_rollup,
    "co2e_by_customer_year": q_co2e_by_customer_year,
    "carbon_accounting": q_carbon_accounting,
    "projects_without_full_years": q_projects_without_full_years,
    "carbon_fit": q_carbon_fit,
    "carbon_fit_excluding": q_carbon_fit_excluding,
}


# ------------------------------------------------------------------ oracle SQL
def _centers_sql(lo, hi, bins, col):
    cs = S.bin_centers(lo, hi, bins)
    return "list_value(" + ", ".join(repr(float(c)) for c in cs) + f")[{col} + 1]"


PQ_STEPS = {
    "pq": f"""SELECT * FROM power_readings WHERE meter_type = 'customer'
        AND voltageMin > {V[0]} AND voltageMin <= {V[1]} AND voltageAvg > {V[0]} AND voltageAvg <= {V[1]}
        AND voltageMax > {V[0]} AND voltageMax <= {V[1]}""",
    "pl": """SELECT 'voltageMin' AS series, voltageMin AS x FROM pq UNION ALL
        SELECT 'voltageAvg', voltageAvg FROM pq UNION ALL SELECT 'voltageMax', voltageMax FROM pq""",
    "pb": f"SELECT series, {S.sql_bin_index('x', str(V[0]), str(V[1]), V[2])} AS bin_i FROM pl",
    "pc": "SELECT series, bin_i, count(*) AS c FROM pb WHERE bin_i IS NOT NULL GROUP BY ALL",
    "sp": """SELECT s.series, CAST(g.bin_i AS INTEGER) AS bin_i FROM (VALUES ('voltageMin'), ('voltageAvg'),
        ('voltageMax')) s(series) CROSS JOIN range(250) g(bin_i)""",
    "vh": f"""SELECT sp.series, sp.bin_i, {_centers_sql(*V, 'sp.bin_i')} AS bin_center,
        CAST(coalesce(pc.c, 0) AS BIGINT) AS count FROM sp LEFT JOIN pc USING (series, bin_i)""",
}


def _lp_steps():
    st = _sql_steps(15)
    st["cs"] = """SELECT o.*, c.projectName AS site_name FROM o JOIN customers c
        ON c.customerAccountNumber = o.meter_customer_code"""
    st["off"] = "SELECT projectName AS site_name, timezoneOffsetUtc AS utc_offset FROM projects"
    st["mt"] = f"SELECT DISTINCT code AS meter_customer_code FROM tar WHERE coalesce(regexp_matches(tariff, '(?i){TARIFF_PATTERN}'), false)"
    st["tl"] = """SELECT cs.*, off.utc_offset, cs.slot_start + to_hours(CAST(off.utc_offset AS BIGINT)) AS lt
        FROM cs JOIN off USING (site_name)"""
    st["td"] = """SELECT *, CAST((hour(lt) * 60 + minute(lt)) // 15 AS INTEGER) AS tod_slot,
        CAST(hour(lt) AS INTEGER) AS tod_hour FROM tl"""
    st["lv"] = """SELECT 'slot' AS level, tod_slot AS grp, energy_kwh AS x, imputation_method FROM td
          WHERE meter_type = 'customer' AND meter_customer_code IN (SELECT meter_customer_code FROM mt)
        UNION ALL SELECT 'hour', tod_hour, energy_kwh, imputation_method FROM td
          WHERE meter_type = 'customer' AND meter_customer_code IN (SELECT meter_customer_code FROM mt)"""
    st["ls"] = """SELECT level, grp, avg(x) AS mean, stddev_samp(x) AS std, count(x) AS n,
        quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
        FROM lv GROUP BY level, grp"""
    st["lso"] = """SELECT level, grp, avg(x) AS mean, count(x) AS n, quantile_cont(x, 0.5) AS median
        FROM lv WHERE imputation_method = 'observed' GROUP BY level, grp"""
    return st


CARBON_STEPS = {
    "an0": """SELECT site_name, meter_customer_code, CAST(year(slot_start) AS INTEGER) AS year,
        coalesce(regexp_matches(tariff, '(?i)Residential'), false) AS is_residential, sum(energy_kwh) AS annual_kwh
        FROM clean_long WHERE meter_type = 'customer' GROUP BY ALL""",
    "an1": """SELECT an0.*, coalesce(po.project, replace(an0.site_name, '_', ' ')) AS project
        FROM an0 LEFT JOIN project_overrides po USING (site_name)""",
    "an": """SELECT project, meter_customer_code, year, is_residential, sum(annual_kwh) AS annual_kwh
        FROM an1 GROUP BY ALL""",
    "co": """SELECT *, CASE WHEN is_residential THEN least(annual_kwh, 55.0) * (2.72 / 1000)
          + greatest(annual_kwh - 55.0, 0.0) * (0.80 / 1000) ELSE annual_kwh * (0.80 / 1000) END AS co2e_tonne FROM an""",
    "py0": "SELECT project, year, sum(co2e_tonne) AS co2e_tonne FROM co GROUP BY ALL",
    "py": """SELECT py0.* FROM py0 JOIN (SELECT project, min(year) AS mn, max(year) AS mx FROM py0 GROUP BY project) r
        USING (project) WHERE year > mn AND year < mx""",
    "ca": """SELECT a.project, a.avg_annual_co2e, a.n_years, c.customer_count, m.sizePv, m.capex FROM
        (SELECT project, avg(co2e_tonne) AS avg_annual_co2e, CAST(count(DISTINCT year) AS INTEGER) AS n_years
         FROM py GROUP BY project) a
        JOIN (SELECT project, CAST(count(DISTINCT meter_customer_code) AS INTEGER) AS customer_count FROM an
              GROUP BY project) c USING (project)
        LEFT JOIN (SELECT replace(projectName, '_', ' ') AS project, sizePv, capex FROM projects) m USING (project)""",
}


def _fit_sql(exclude=None):
    w = f"WHERE project <> '{exclude}'" if exclude else ""
    return f"""SELECT variable, count(*) AS n, {rs('regr_slope(y, x)', 6)} AS slope,
        {rs('regr_intercept(y, x)', 6)} AS intercept FROM (
          SELECT 'sizePv' AS variable, CAST(sizePv AS DOUBLE) AS x, avg_annual_co2e AS y FROM ca {w}
          UNION ALL SELECT 'customer_count', CAST(customer_count AS DOUBLE), avg_annual_co2e FROM ca {w}
          UNION ALL SELECT 'capex_k', capex * 1e-3, avg_annual_co2e FROM ca {w})
        WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY variable HAVING count(*) >= 2"""


def _build_sql():
    sql = {}
    sql["voltage_histogram"] = with_(["power_readings"], f"""SELECT series, bin_i AS "bin",
        {rs('bin_center', 4)} AS bin_center, count FROM vh""", PQ_STEPS)
    pf = f"""SELECT v_bin, pf_bin, {rs(_centers_sql(*V, 'v_bin'), 4)} AS v_bin_center,
        {rs(_centers_sql(*PF, 'pf_bin'), 4)} AS pf_bin_center, count(*) AS count FROM (
          SELECT {S.sql_bin_index('voltageAvg', str(V[0]), str(V[1]), V[2])} AS v_bin,
                 {S.sql_bin_index('powerFactorAvg', str(PF[0]), str(PF[1]), PF[2])} AS pf_bin
          FROM pq WHERE powerFactorAvg > 0.0 AND powerFactorAvg <= 1.0)
        WHERE v_bin IS NOT NULL AND pf_bin IS NOT NULL GROUP BY v_bin, pf_bin"""
    sql["voltage_pf_density"] = with_(["power_readings"], pf, {"pq": PQ_STEPS["pq"]})
    width = (V[1] - V[0]) / V[2]
    sql["hist_density"] = with_(["power_readings"], f"""SELECT vh.series, bin_i AS "bin", count, t.total,
        {rs(f'count / (t.total * {width})', 8)} AS density, {rs('t.series_mean', 4)} AS series_mean
        FROM vh JOIN (SELECT series, sum(count) AS total, sum(bin_center * count) / sum(count) AS series_mean
        FROM vh GROUP BY series) t USING (series)""", PQ_STEPS)
    sql["hist_density"] = sql["hist_density"].replace("count, t.total,", "count, CAST(t.total AS BIGINT) AS total,")
    sql["pivot_counts"] = with_(["power_readings"], """SELECT bin_i AS "bin",
        CAST(sum(CASE WHEN series = 'voltageMin' THEN count END) AS BIGINT) AS voltageMin,
        CAST(sum(CASE WHEN series = 'voltageAvg' THEN count END) AS BIGINT) AS voltageAvg,
        CAST(sum(CASE WHEN series = 'voltageMax' THEN count END) AS BIGINT) AS voltageMax
        FROM vh GROUP BY bin_i""", PQ_STEPS)
    sql["site_utc_offset"] = with_(["stations", "projects"], """SELECT replace(s.meteringBaseStation, ' ', '_')
        AS site_name, s.projectName, p.timezoneOffsetUtc AS utc_offset FROM stations s
        LEFT JOIN projects p ON p.projectName = s.projectName""")
    lp = _lp_steps()
    sql["customers_by_tariff"] = with_(["readings"], "SELECT meter_customer_code FROM mt",
                                       {k: lp[k] for k in ["r", "tc", "tm", "ta", "tar", "mt"]})
    sql["time_of_day"] = with_(["readings", "customers", "projects"], """SELECT meter_customer_code, meter_type,
        slot_start, utc_offset, tod_slot, tod_hour FROM td""",
                               {k: v for k, v in lp.items() if k not in ("lv", "ls", "lso", "mt")})
    sql["load_profile"] = with_(["readings", "customers", "projects"], f"""SELECT level, grp, n,
        {rs('mean', 6)} AS mean, {rs('std', 6)} AS std, {rs('median', 6)} AS median,
        {rs('q1', 6)} AS q1, {rs('q3', 6)} AS q3 FROM ls""", {k: v for k, v in lp.items() if k != "lso"})
    sc = "(CASE WHEN sp.level = 'slot' THEN 1000.0 ELSE 4000.0 END)"
    half = f"(1.96 * std / sqrt(n) * {sc})"
    sql["load_profile_ci"] = with_(["readings", "customers", "projects"], f"""SELECT sp.level, sp.grp,
        coalesce(n, 0) AS n, {rs(f'mean * {sc}', 4)} AS mean_wh,
        {rs(f'greatest(mean * {sc} - {half}, 0.0)', 4)} AS ci_lo_wh, {rs(f'mean * {sc} + {half}', 4)} AS ci_hi_wh,
        {rs(f'median * {sc}', 4)} AS median_wh, {rs(f'q1 * {sc}', 4)} AS q1_wh, {rs(f'q3 * {sc}', 4)} AS q3_wh
        FROM (SELECT 'slot' AS level, CAST(range AS INTEGER) AS grp FROM range(96)
              UNION ALL SELECT 'hour', CAST(range AS INTEGER) FROM range(24)) sp
        LEFT JOIN ls ON ls.level = sp.level AND ls.grp = sp.grp""", {k: v for k, v in lp.items() if k != "lso"})
    sql["load_profile_observed"] = with_(["readings", "customers", "projects"], f"""SELECT level, grp, n,
        {rs('mean', 6)} AS mean, {rs('median', 6)} AS median FROM lso""", {k: v for k, v in lp.items() if k != "ls"})
    cb = ["clean_long", "project_overrides", "projects"]
    sql["annual_consumption"] = with_(cb, f"""SELECT project, meter_customer_code, year, is_residential,
        {rs('annual_kwh', 4)} AS annual_kwh FROM an""", CARBON_STEPS)
    sql["site_rollup"] = with_(["clean_long", "project_overrides"], """SELECT s.site_name,
        coalesce(po.project, replace(s.site_name, '_', ' ')) AS project FROM
        (SELECT DISTINCT site_name FROM clean_long WHERE site_name IS NOT NULL) s
        LEFT JOIN project_overrides po USING (site_name)""")
    sql["co2e_by_customer_year"] = with_(cb, f"""SELECT project, meter_customer_code, year, is_residential,
        {rs('co2e_tonne', 8)} AS co2e_tonne FROM co""", CARBON_STEPS)
    sql["carbon_accounting"] = with_(cb, f"""SELECT project, {rs('avg_annual_co2e', 6)} AS avg_annual_co2e,
        n_years, customer_count, {rs('sizePv', 4)} AS sizePv, {rs('capex', 4)} AS capex FROM ca""", CARBON_STEPS)
    sql["projects_without_full_years"] = with_(cb, """SELECT DISTINCT project FROM an
        WHERE project NOT IN (SELECT project FROM py)""", CARBON_STEPS)
    sql["carbon_fit"] = with_(cb, _fit_sql(), CARBON_STEPS)
    sql["carbon_fit_excluding"] = with_(cb, _fit_sql("Nations 1 and 2"), CARBON_STEPS)
    return sql


SQL = _build_sql()
