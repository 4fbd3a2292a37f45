"""Registered queries: anonymised release, site resolution, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.core import round_half_up as r_, sql_round as rs, to_number
from ..operators import quality as Q
from ..operators import release as R
from ..session import checkpoint_dir
from ..sources import commits as W
from ..sources import footers as FT
from ..sources import io as IO
from . import bindings as B
from .sql_bindings import with_

SALT = "salt"
CUSTOMER_DROP = ["c_name", "c_phone", "c_acctbal"]          # c_phone is not in the table
STATION_SAFE = ["meteringSiteId", "meteringBaseStation", "projectName", "timezoneOffsetUtc",
                "olderMeteringSiteIds"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TABLE_KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
              "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}
EXCLUDED_PROJECTS = ["NATION_3", "NATION_4"]


def q_release_drop_cols(spark, d):
    return R.drop_columns(B.table(spark, d, "customer"), CUSTOMER_DROP)


def q_release_allowlist(spark, d):
    return R.allow_columns(B.stations(spark, d), STATION_SAFE)


def q_pseudonymize(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customerAccountNumber"),
                                             "c_name", "c_mktsegment")
    return R.pseudonymize(c, ["customerAccountNumber", "c_name"], SALT)


def q_normalize_types(spark, d):
    li = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("l_extendedprice"),
        F.lit(None).alias("note"))
    return R.normalize_types(li)


def q_coerce_numeric(spark, d):
    ev = B.table(spark, d, "events").select(
        "event_id",
        F.regexp_extract("props", r'"k": (\d+)', 1).alias("k_str"),
        F.concat(F.col("value").cast("string"),
                 F.when(F.col("event_type") == "error", F.lit("d")).otherwise(F.lit(""))).alias("v_str"))
    return ev.select("event_id", to_number(ev, "k_str").alias("k_num"), to_number(ev, "v_str").alias("v_num"))


def q_clean_payments(spark, d):
    p = R.clean_payments(B.payments(spark, d, located=False), 1997)
    return p.select("id", "paymentProcessor", "transactionDatetime", r_("amount", 2).alias("amount"))


def q_bad_date_payments(spark, d):
    """Missing dates first, then the earliest."""
    p = B.payments(spark, d, located=False)
    ts = F.col("transactionDatetime")
    return (p.where(ts.isNull() | (F.year(ts) < 1996))
             .orderBy(ts.asc_nulls_first(), "id").limit(20)
             .select("id", "customerAccountNumber", "transactionDatetime"))


def q_drop_test_sites(spark, d):
    s = R.drop_test_sites(B.stations(spark, d))
    return s.select("meteringSiteId", r_("lat", 4).alias("lat"), r_("long", 4).alias("long"))


def q_exclude_sites(spark, d):
    s = R.exclude_values(B.stations(spark, d), "projectName", EXCLUDED_PROJECTS)
    return s.select("meteringSiteId", "projectName")


def q_exclude_uuid_sites(spark, d):
    """Sites whose file is not named like a UUID, by either rule."""
    return R.without_uuid_sites(B.stations(spark, d), "site_file").select("site_file")


def q_uuid_site_flags(spark, d):
    s = B.stations(spark, d)
    return s.select("site_file", R.uuid_prefix("site_file").alias("uuid_prefix"),
                    R.uuid_shape("site_file").alias("uuid_shape"))


def q_safe_site_name(spark, d):
    s = B.stations(spark, d)
    return s.select("meteringSiteId", R.safe_name("meteringBaseStation").alias("safe_name"))


def q_resolve_site(spark, d):
    r = R.resolve_site(B.readings_with_site(spark, d), B.stations(spark, d))
    return r.select("row_id", "site", "site_name")


def q_merge_years(spark, d):
    """Years of different types, and a column that only the later ones have."""
    o = B.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    a = o.where(F.year("o_orderdate") <= 1997).drop("o_orderstatus")
    b = o.where(F.year("o_orderdate") > 1997).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    m = R.merge_years([a, b])
    return m.select("o_orderkey", r_("o_totalprice", 2).alias("o_totalprice"), "o_orderdate", "o_orderstatus")


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/gridmeter-{name}-{uuid.uuid4().hex}"


def q_incremental_write_rerun(spark, d):
    """A resumable write, run three times; NULL keys are written once, too."""
    o = B.table(spark, d, "orders").select(
        "o_orderkey", r_("o_totalprice", 2).alias("o_totalprice"),
        F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.concat(F.lit("site "), F.pmod("o_orderkey", F.lit(3)))).alias("site_name"),
        F.year("o_orderdate").alias("year"))
    path = _folder(spark, "incremental")
    IO.incremental_write(o.where("year < 1996 OR site_name IS NULL"), path, ["site_name", "year"])
    for _ in range(2):
        IO.incremental_write(o, path, ["site_name", "year"])
    return spark.read.schema(o.schema).parquet(path)


def q_resumable_after_kill(spark, d):
    """Partitions go by commit markers (SNK2, SNK5): one half is committed, a run that is
    killed before its markers leaves files, and a rerun writes what is not committed."""
    o = B.table(spark, d, "orders").select(
        "o_orderkey", r_("o_totalprice", 2).alias("o_totalprice"),
        F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.concat(F.lit("site "), F.pmod("o_orderkey", F.lit(3)))).alias("site_name"),
        F.year("o_orderdate").alias("year"))
    path, keys = _folder(spark, "committed"), ["site_name", "year"]
    W.committed_write(o.where("year < 1996 OR site_name IS NULL"), path, keys)
    W.write_attempt(o.where("year < 1998"), path, keys)          # killed: no markers
    W.committed_write(o, path, keys)
    return W.read_committed(spark, path, keys)


def q_table_key_ranges(spark, d):
    """Rows and key range of each table, from the footers."""
    return FT.ranges(spark, {n: (f"{d}/{n}.parquet", k) for n, k in TABLE_KEYS.items()})


def q_write_read_csv(spark, d):
    c = B.table(spark, d, "customer").select("c_custkey", "c_name", r_("c_acctbal", 2).alias("c_acctbal"))
    path = _folder(spark, "csv")
    IO.write_csv(c, path)
    return IO.read_csv(spark, path, c.schema)


def q_write_read_series(spark, d):
    t = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r_("l_quantity", 2).alias("l_quantity"), F.col("l_returnflag").alias("site_name"), "l_shipdate")
    path = _folder(spark, "series")
    IO.write_series(t, path, sort=("l_orderkey", "l_linenumber", "l_shipdate"))
    return spark.read.schema(t.schema).parquet(path).drop("l_shipdate")


def q_union_sites(spark, d):
    c = IO.read_sites(spark, f"{d}/customer.parquet", col="source").select(
        "source", F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    s = IO.read_sites(spark, f"{d}/supplier.parquet", col="source").select(
        "source", F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"))
    u = R.union_sites([c, s])
    return u.select("source", "key", "nationkey", r_("acctbal", 2).alias("acctbal"), "c_mktsegment")


def q_time_range_scan(spark, d):
    p = B.power_readings(spark, d)
    t = p.where((F.col("heartbeatStart") >= F.lit("2024-01-10").cast("timestamp"))
                & (F.col("heartbeatStart") < F.lit("2024-01-20").cast("timestamp"))
                & (F.col("heartbeatStart") != F.lit("1970-01-01").cast("timestamp")))
    return t.select("meter_customer_code", "heartbeatStart", r_("voltageAvg", 4).alias("voltageAvg"))


def q_active_sites(spark, d):
    r = R.resolve_site(B.readings_with_site(spark, d), B.stations(spark, d))
    day = r.where((F.col("heartbeatStart") >= F.lit("2024-01-15").cast("timestamp"))
                  & (F.col("heartbeatStart") < F.lit("2024-01-16").cast("timestamp")))
    st = B.stations(spark, d).select(F.col("meteringBaseStation").alias("site_name"), "projectName")
    return day.join(st, "site_name", "inner").select("site_name", "projectName").distinct()


def q_table_profile(spark, d):
    """Rows and columns of every table."""
    return q_table_bytes(spark, d).drop("bytes")


def q_table_bytes(spark, d):
    return FT.table_profile(spark, {n: f"{d}/{n}.parquet" for n in TABLES})


def q_tariff_history(spark, d):
    t = Q.tariff_changes(B.tariffs(spark, d).where(F.col("totalRate") > 0), "station",
                         "startingDatetime", "totalRate", ["tariff_order", "tariff_line"])
    return t.select("station", "startingDatetime", "tariff_order", "tariff_line",
                    r_("totalRate", 4).alias("totalRate"), r_("prev_rate", 4).alias("prev_rate"))


def q_tariff_asof(spark, d):
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("station"))
    o = B.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    left = li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")
    right = B.tariffs(spark, d).where(F.col("totalRate") > 0)
    j = Q.asof_join(left, right, "station", "ts", "startingDatetime", ["name", "totalRate"],
                    ["tariff_order", "tariff_line"])
    return j.select("l_orderkey", "l_linenumber", "station", "ts", "name",
                    r_("totalRate", 4).alias("totalRate"))


def q_tariff_rate_check(spark, d):
    """Does a row's own rate equal the tariff in force at its time (X1 check)?
    Counts per station of matching, differing and unmatched rows."""
    li = B.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_discount").alias("own_rate"))
    right = B.tariffs(spark, d).where(F.col("totalRate") > 0)
    j = Q.asof_join(li, right, "station", "ts", "startingDatetime", ["totalRate"],
                    ["tariff_order", "tariff_line"])
    return (j.groupBy("station")
             .agg(F.sum(F.when(F.col("totalRate") == F.col("own_rate"), 1).otherwise(0)).cast("long").alias("n_equal"),
                  F.sum(F.when(F.col("totalRate") != F.col("own_rate"), 1).otherwise(0)).cast("long").alias("n_differ"),
                  F.sum(F.when(F.col("totalRate").isNull(), 1).otherwise(0)).cast("long").alias("n_no_tariff")))


def q_release_customers(spark, d):
    """The customers table through the release spec (drop, pseudonymise)."""
    return R.release_table(B.customers(spark, d), "customers", SALT)


def q_release_payments(spark, d):
    """Payments through the release spec (pseudonymise, clean dates/processor)."""
    p = R.release_table(B.payments(spark, d, located=False), "paymentconfirmations", SALT, 1997)
    return p.select("id", "customerAccountNumber", "paymentProcessor", "transactionDatetime")


QUERIES = {
    "release_customers": q_release_customers,
    "release_payments": q_release_payments,
    "tariff_rate_check": q_tariff_rate_check,
    "release_drop_cols": q_release_drop_cols,
    "release_allowlist": q_release_allowlist,
    "pseudonymize": q_pseudonymize,
    "normalize_types": q_normalize_types,
    "coerce_numeric": q_coerce_numeric,
    "clean_payments": q_clean_payments,
    "bad_date_payments": q_bad_date_payments,
    "drop_test_sites": q_drop_test_sites,
    "exclude_sites": q_exclude_sites,
    "exclude_uuid_sites": q_exclude_uuid_sites,
    "uuid_site_flags": q_uuid_site_flags,
    "incremental_write_rerun": q_incremental_write_rerun,
    "resumable_after_kill": q_resumable_after_kill,
    "table_key_ranges": q_table_key_ranges,
    "write_read_csv": q_write_read_csv,
    "write_read_series": q_write_read_series,
    "safe_site_name": q_safe_site_name,
    "resolve_site": q_resolve_site,
    "merge_years": q_merge_years,
    "union_sites": q_union_sites,
    "time_range_scan": q_time_range_scan,
    "active_sites": q_active_sites,
    "table_profile": q_table_profile,
    "table_bytes": q_table_bytes,
    "tariff_history": q_tariff_history,
    "tariff_asof": q_tariff_asof,
}

# ------------------------------------------------------------------ oracle SQL
_NUM = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[Nn]a[Nn]|[Ii]nf(inity)?)\s*$"


def _num(x):
    return f"(CASE WHEN regexp_matches({x}, '{_NUM}') THEN TRY_CAST({x} AS DOUBLE) END)"


def _pseudo(x):
    return f"(CASE WHEN regexp_matches({x}, '\\S') THEN sha256({x} || '{SALT}') ELSE {x} END)"


_LOOKUP = {
    "cur": "SELECT meteringSiteId AS site, meteringBaseStation, 0 AS p, meteringSiteId AS o FROM stations",
    "old": """SELECT trim(unnest(string_split(olderMeteringSiteIds, ','))) AS site, meteringBaseStation,
        1 AS p, meteringSiteId AS o FROM stations WHERE olderMeteringSiteIds IS NOT NULL""",
    "lk": """SELECT site, meteringBaseStation AS site_name FROM (SELECT *, row_number() OVER (
        PARTITION BY site ORDER BY p DESC, o DESC) AS rn FROM (SELECT * FROM cur UNION ALL
        SELECT * FROM old WHERE length(site) > 0)) WHERE rn = 1""",
    "rs": """SELECT r.*, coalesce(lk.site_name, 'unknown') AS site_name FROM readings_with_site r
        LEFT JOIN lk USING (site)""",
}

SQL = {
    "release_customers": with_(["customers"], f"""SELECT {_pseudo('customerAccountNumber')} AS customerAccountNumber,
        customerType, projectName, country FROM customers"""),
    "release_payments": with_(["payments"], f"""SELECT id, {_pseudo('customerAccountNumber')} AS customerAccountNumber,
        trim(lower(paymentProcessor)) AS paymentProcessor, transactionDatetime FROM payments
        WHERE transactionDatetime IS NOT NULL AND year(transactionDatetime) >= 1997"""),
    "tariff_rate_check": with_(["tariffs"], """SELECT l.station,
        CAST(sum(CASE WHEN t.totalRate = l.own_rate THEN 1 ELSE 0 END) AS BIGINT) AS n_equal,
        CAST(sum(CASE WHEN t.totalRate <> l.own_rate THEN 1 ELSE 0 END) AS BIGINT) AS n_differ,
        CAST(sum(CASE WHEN t.totalRate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_no_tariff
        FROM (SELECT l_suppkey AS station, l_shipdate AS ts, l_discount AS own_rate FROM lineitem) l
        ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, startingDatetime
                          ORDER BY tariff_order DESC, tariff_line DESC) AS rn FROM tariffs WHERE totalRate > 0)
                        WHERE rn = 1) t
        ON l.station = t.station AND l.ts >= t.startingDatetime
        GROUP BY l.station"""),
    "release_drop_cols": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "release_allowlist": with_(["stations"], """SELECT meteringSiteId, meteringBaseStation, projectName,
        timezoneOffsetUtc, olderMeteringSiteIds FROM stations"""),
    "pseudonymize": f"""SELECT {_pseudo('CAST(c_custkey AS VARCHAR)')} AS customerAccountNumber,
        {_pseudo('c_name')} AS c_name, c_mktsegment FROM customer""",
    "normalize_types": """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)
        AS l_extendedprice, CAST(NULL AS VARCHAR) AS note FROM lineitem""",
    "coerce_numeric": f"""SELECT event_id, {_num('k_str')} AS k_num, {_num('v_str')} AS v_num FROM (
        SELECT event_id, regexp_extract(props, '"k": (\\d+)', 1) AS k_str,
        CAST(value AS VARCHAR) || CASE WHEN event_type = 'error' THEN 'd' ELSE '' END AS v_str FROM events)""",
    "clean_payments": with_(["payments"], f"""SELECT id, trim(lower(paymentProcessor)) AS paymentProcessor,
        transactionDatetime, {rs('amount', 2)} AS amount FROM payments
        WHERE transactionDatetime IS NOT NULL AND year(transactionDatetime) >= 1997"""),
    "bad_date_payments": with_(["payments"], """SELECT id, customerAccountNumber, transactionDatetime
        FROM payments WHERE transactionDatetime IS NULL OR year(transactionDatetime) < 1996
        ORDER BY transactionDatetime NULLS FIRST, id LIMIT 20"""),
    "drop_test_sites": with_(["stations"], f"""SELECT meteringSiteId, {rs('lat', 4)} AS lat, {rs('long', 4)} AS long
        FROM stations WHERE lat IS DISTINCT FROM 0 OR long IS DISTINCT FROM 0"""),
    "exclude_sites": with_(["stations"], """SELECT meteringSiteId, projectName FROM stations
        WHERE NOT coalesce(projectName IN ('NATION_3', 'NATION_4'), false)"""),
    "exclude_uuid_sites": with_(["stations"], """SELECT site_file FROM stations
        WHERE NOT coalesce(regexp_matches(site_file, '^[0-9a-f]{8}-'), false)
          AND NOT coalesce(length(site_file) = 36 AND length(site_file) - length(replace(site_file, '-', '')) = 4, false)"""),
    "incremental_write_rerun": f"""SELECT o_orderkey, {rs('o_totalprice', 2)} AS o_totalprice,
        CASE WHEN o_orderkey % 3 > 0 THEN 'site ' || (o_orderkey % 3) END AS site_name, year(o_orderdate)::INTEGER AS year FROM orders""",
    "table_key_ranges": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, min({k}) AS first_key, max({k}) AS last_key FROM {n}" for n, k in TABLE_KEYS.items()),
    "write_read_csv": f"SELECT c_custkey, c_name, {rs('c_acctbal', 2)} AS c_acctbal FROM customer",
    "write_read_series": f"""SELECT l_orderkey, l_linenumber, {rs('l_quantity', 2)} AS l_quantity, l_returnflag AS site_name FROM lineitem""",
    "uuid_site_flags": with_(["stations"], """SELECT site_file,
        coalesce(regexp_matches(site_file, '^[0-9a-f]{8}-'), false) AS uuid_prefix,
        coalesce(length(site_file) = 36 AND length(site_file) - length(replace(site_file, '-', '')) = 4, false)
          AS uuid_shape FROM stations"""),
    "safe_site_name": with_(["stations"], """SELECT meteringSiteId,
        replace(replace(meteringBaseStation, '/', '-'), ' ', '_') AS safe_name FROM stations"""),
    "resolve_site": with_(["stations", "readings_with_site"], "SELECT row_id, site, site_name FROM rs", _LOOKUP),
    "merge_years": f"""SELECT o_orderkey, {rs('o_totalprice', 2)} AS o_totalprice, o_orderdate,
        CASE WHEN year(o_orderdate) > 1997 THEN o_orderstatus END AS o_orderstatus FROM orders""",
    "union_sites": f"""SELECT 'customer' AS source, c_custkey AS key, c_nationkey AS nationkey,
        {rs('c_acctbal', 2)} AS acctbal, c_mktsegment FROM customer UNION ALL
        SELECT 'supplier', s_suppkey, s_nationkey, {rs('s_acctbal', 2)}, NULL FROM supplier""",
    "time_range_scan": with_(["power_readings"], f"""SELECT meter_customer_code, heartbeatStart,
        {rs('voltageAvg', 4)} AS voltageAvg FROM power_readings WHERE heartbeatStart >= TIMESTAMP '2024-01-10'
        AND heartbeatStart < TIMESTAMP '2024-01-20' AND heartbeatStart <> TIMESTAMP '1970-01-01'"""),
    "active_sites": with_(["stations", "readings_with_site"], """SELECT DISTINCT rs.site_name, s.projectName
        FROM rs JOIN stations s ON s.meteringBaseStation = rs.site_name
        WHERE heartbeatStart >= TIMESTAMP '2024-01-15' AND heartbeatStart < TIMESTAMP '2024-01-16'""", _LOOKUP),
    "tariff_history": with_(["tariffs"], f"""SELECT station, startingDatetime, tariff_order, tariff_line,
        {rs('totalRate', 4)} AS totalRate, {rs('prev_rate', 4)} AS prev_rate FROM (
          SELECT *, lag(totalRate) OVER (PARTITION BY station ORDER BY startingDatetime, tariff_order, tariff_line)
            AS prev_rate FROM tariffs WHERE totalRate > 0)
        WHERE prev_rate IS NULL OR prev_rate <> totalRate"""),
    "tariff_asof": with_(["tariffs"], f"""SELECT l.l_orderkey, l.l_linenumber, l.station, l.ts, t.name,
        {rs('t.totalRate', 4)} AS totalRate
        FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS station, o_orderdate AS ts
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l
        ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, startingDatetime
                          ORDER BY tariff_order DESC, tariff_line DESC) AS rn FROM tariffs WHERE totalRate > 0)
                        WHERE rn = 1) t
        ON l.station = t.station AND l.ts >= t.startingDatetime"""),
}

SQL["table_profile"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows, c.n_columns, c.columns FROM (
        SELECT count(*)::INTEGER AS n_columns, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns
        FROM information_schema.columns WHERE table_name = '{n}') c""" for n in TABLES)
SQL["resumable_after_kill"] = SQL["incremental_write_rerun"]
