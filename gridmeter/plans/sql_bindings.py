"""DuckDB twins of :mod:`gridmeter.plans.bindings` (CTE bodies).

``with_(names, body)`` builds ``WITH a AS (...), b AS (...) <body>``
including every binding the named ones depend on.
"""

from __future__ import annotations

RESET_EVERY = 37


def _readings(slot_minutes: int = 15) -> str:
    slot_us = slot_minutes * 60 * 1_000_000
    return f"""
SELECT CAST(user_id AS VARCHAR) AS meter_customer_code,
       CASE user_id % 10 WHEN 0 THEN 'totalizer' WHEN 1 THEN 'pue' ELSE 'customer' END AS meter_type,
       make_timestamp((epoch_us(ts) // {slot_us}) * {slot_us}) AS heartbeatStart,
       CASE WHEN event_id % {RESET_EVERY} = 0 THEN 0.0
            ELSE CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (
                   PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 100.0
       END AS energy,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS state,
       event_type AS meter_tariff_name,
       event_id AS row_id
FROM events"""


_METER_TYPE = "CASE user_id % 10 WHEN 0 THEN 'totalizer' WHEN 1 THEN 'pue' ELSE 'customer' END"

CTES = {
    "readings": (_readings(15), ()),
    "readings6h": (_readings(360), ()),
    "power_readings": (f"""
SELECT CAST(user_id AS VARCHAR) AS meter_customer_code, {_METER_TYPE} AS meter_type,
       ts AS heartbeatStart, value AS voltageAvg, value * 0.95 AS voltageMin,
       value * 1.05 AS voltageMax,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS powerFactorAvg,
       event_type AS meter_tariff_name
FROM events""", ()),
    "customers": ("""
SELECT CAST(c_custkey AS VARCHAR) AS customerAccountNumber,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Residential' ELSE c_mktsegment END AS customerType,
       n_name AS projectName, r_name AS country
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
              LEFT JOIN region ON n_regionkey = r_regionkey""", ()),
    "clean_long": ("""
SELECT CAST(o_custkey AS VARCHAR) AS meter_customer_code, 'customer' AS meter_type,
       l_shipdate AS slot_start, l_quantity AS energy_kwh, 'observed' AS imputation_method,
       cu.customerType AS tariff, cu.projectName AS site_name, cu.country
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     LEFT JOIN customers cu ON CAST(o_custkey AS VARCHAR) = cu.customerAccountNumber""",
                   ("customers",)),
    "payments": ("""
SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS customerAccountNumber,
       o_totalprice AS amount, o_orderdate AS transactionDatetime,
       '  ' || upper(substring(o_orderpriority, 3, 100)) || ' ' AS paymentProcessor,
       CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 1 WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 0 END AS TINYINT) AS isTest,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE NULL END AS TINYINT) AS isReversed,
       CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS TINYINT) AS isSignup,
       CAST(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 0 END AS TINYINT) AS isBalanceTransfer,
       cu.projectName, cu.country, 'LCU' AS currency
FROM orders LEFT JOIN customers cu ON CAST(o_custkey AS VARCHAR) = cu.customerAccountNumber""",
                 ("customers",)),
    "stations": ("""
SELECT 'SITE-' || CAST(s_suppkey AS VARCHAR) AS meteringSiteId,
       'Station ' || n_name || ' ' || CAST(s_suppkey AS VARCHAR) AS meteringBaseStation,
       n_name AS projectName,
       concat_ws(',', 'OLD-' || CAST(s_suppkey AS VARCHAR), 'OLDER-' || CAST(s_suppkey AS VARCHAR)) AS olderMeteringSiteIds,
       CASE WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE s_acctbal / 100.0 END AS lat,
       CASE WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE s_acctbal / 50.0 END AS long,
       CAST(s_nationkey % 5 - 1 AS INTEGER) AS timezoneOffsetUtc,
       CASE WHEN s_suppkey % 5 = 0 THEN concat_ws('-', substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 8),
              substring(md5(CAST(s_suppkey AS VARCHAR)), 9, 4), substring(md5(CAST(s_suppkey AS VARCHAR)), 13, 4),
              substring(md5(CAST(s_suppkey AS VARCHAR)), 17, 4), substring(md5(CAST(s_suppkey AS VARCHAR)), 21, 12))
            ELSE replace('Station ' || n_name || ' ' || CAST(s_suppkey AS VARCHAR), ' ', '_') END AS site_file
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""", ()),
    "readings_with_site": ("""
SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS meter_customer_code,
       CASE user_id % 10 WHEN 0 THEN 'totalizer' WHEN 1 THEN 'pue' ELSE 'customer' END AS meter_type,
       CASE event_id % 3 WHEN 0 THEN 'SITE-' WHEN 1 THEN 'OLD-' ELSE 'OLDER-' END || CAST(user_id % 120 AS VARCHAR) AS site,
       ts AS heartbeatStart, value AS truePowerAvg,
       CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS truePowerInst,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS state
FROM events""", ()),
    "tariffs": ("""
SELECT l_suppkey AS station, l_shipdate AS startingDatetime, l_orderkey AS tariff_order,
       l_linenumber AS tariff_line, l_returnflag AS name, l_discount AS totalRate FROM lineitem""", ()),
    "projects": ("""
SELECT n_name AS projectName, r_name AS country, a.bal / 1000.0 AS sizePv,
       a.ns * 1000.0 AS capex, CAST(n_regionkey + 1 AS INTEGER) AS timezoneOffsetUtc
FROM nation
LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS bal, count(*) AS ns FROM supplier GROUP BY s_nationkey) a
       ON n_nationkey = a.s_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""", ()),
}


def with_(names, body: str, extra: dict | None = None) -> str:
    """``WITH`` clause of the named bindings (dependencies first) + body.

    ``extra`` maps further CTE names to SQL bodies, appended in order.
    """
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]}\n)" for n in order]
    parts += [f"{k} AS ({v}\n)" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def title(x: str) -> str:
    """DuckDB text of Spark ``initcap`` (words split on spaces)."""
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(w[1:1]) || w[2:]), ' ')")


CTES["site_map"] = (f"""
SELECT n_name AS site_name, replace(n_name, '_', ' ') AS projectName, {title('r_name')} AS country
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'""", ())

CTES["project_overrides"] = ("""
SELECT * FROM (VALUES ('NATION_1', 'Nations 1 and 2'), ('NATION_2', 'Nations 1 and 2')) t(site_name, project)""", ())

CTES["fx_rates"] = ("""
SELECT country, CAST(year AS INTEGER) AS year, CAST(rate AS DOUBLE) AS rate FROM (VALUES
  ('Africa', 1996, 100.0), ('Africa', 1999, 110.0), ('America', 1995, 1.0), ('America', 2000, 1.2),
  ('Asia', 1998, 7.5), ('Asia', 2002, NULL), ('Europe', 1995, 0.9), ('Europe', 1997, 0.95),
  ('Europe', 2001, 1.1)) t(country, year, rate)""", ())

COUNTRIES_SQL = "('Africa', 'America', 'Asia', 'Europe')"
