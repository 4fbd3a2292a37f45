"""Registered queries: cleaning of cumulative counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_half_up as r_, sql_round as rs
from ..operators import clean as C
from . import bindings as B
from .sql_bindings import with_

KEYS = ["meter_customer_code", "meter_type"]


def _trans(spark, d, slot=15):
    r = C.coerce_readings(B.readings(spark, d, slot), order_extra=["row_id"])
    return C.transitions(r, KEYS, "heartbeatStart", "energy", "state", ["energy", "row_id"], slot)


def q_energy_diffs(spark, d):
    t = _trans(spark, d)
    return t.select(*KEYS, "t_prev", "t_next", r_("diff", 4).alias("diff"), "n_slots")


def q_valid_transitions(spark, d):
    t = _trans(spark, d)
    return (t.where("valid")
             .select(*KEYS, "t_prev", "n_slots", r_("diff", 4).alias("diff"), "clean"))


def q_daily_profile(spark, d):
    t = _trans(spark, d, 360)
    p = C.daily_profile(t, KEYS, 360)
    x = p.select(*KEYS, "has", F.posexplode("w").alias("tod", "weight"))
    return x.select(*KEYS, "tod", r_("weight", 6).alias("weight"),
                    F.col("has")[F.col("tod")].alias("has_data"))


def _clean(spark, d, slot):
    return C.clean_readings(B.readings(spark, d, slot), order_extra=["row_id"], slot_minutes=slot)


def _round_out(df):
    return df.select(*KEYS, "slot_start", r_("energy_kwh", 6).alias("energy_kwh"),
                     "imputation_method", "tariff")


def q_clean_series(spark, d):
    """Flagship: the 15-minute clean series of every meter."""
    return _round_out(_clean(spark, d, 15))


def q_clean_readings(spark, d):
    """Same pipeline on 6-hour slots (profile-rich: most slots observed)."""
    return _round_out(_clean(spark, d, 360))


def q_energy_conservation(spark, d):
    out, t = C.clean_readings(B.readings(spark, d, 15), order_extra=["row_id"],
                              return_transitions=True)
    c = C.conservation_check(out, t)
    return c.select("n_rows", r_("raw_total", 4).alias("raw_total"),
                    r_("out_total", 4).alias("out_total"), "ok")


def q_modal_tariff(spark, d):
    r = C.coerce_readings(B.readings(spark, d))
    return C.modal_tariff(r, "meter_customer_code", "meter_tariff_name", "tariff")


QUERIES = {
    "energy_diffs": q_energy_diffs,
    "valid_transitions": q_valid_transitions,
    "daily_profile": q_daily_profile,
    "clean_series": q_clean_series,
    "clean_readings": q_clean_readings,
    "energy_conservation": q_energy_conservation,
    "modal_tariff": q_modal_tariff,
}


# ------------------------------------------------------------------ oracle SQL
def _sql_steps(slot: int) -> dict:
    slot_us = slot * 60 * 1_000_000
    spd = 24 * 60 // slot
    src = "readings" if slot == 15 else "readings6h"
    return {
        "r": f"""SELECT meter_customer_code AS code, meter_type AS mtype, heartbeatStart AS ts,
                 CAST(energy AS DOUBLE) AS energy, CAST(state AS DOUBLE) AS state,
                 meter_tariff_name AS tariff, row_id
          FROM {src}
          WHERE meter_customer_code IS NOT NULL AND meter_type IS NOT NULL AND heartbeatStart IS NOT NULL""",
        "s": """SELECT code, mtype, ts AS t_prev, energy AS e_prev, state AS s_prev,
                 lead(ts) OVER w AS t_next, lead(energy) OVER w AS e_next, lead(state) OVER w AS s_next
          FROM r WINDOW w AS (PARTITION BY code, mtype
                              ORDER BY ts ASC NULLS FIRST, energy ASC NULLS FIRST, row_id ASC NULLS FIRST)""",
        "t": f"""SELECT *, e_next - e_prev AS diff,
                 CAST(round_even((epoch_us(t_next) - epoch_us(t_prev)) / {float(slot_us)}, 0) AS BIGINT) AS n_slots,
                 CAST(((epoch_us(t_prev) // 1000000) % 86400) // {slot * 60} AS INTEGER) AS tod0
          FROM s WHERE t_next IS NOT NULL""",
        "tv": """SELECT *, coalesce(diff >= 0, false) AND coalesce(s_prev = 1, false)
                        AND coalesce(s_next = 1, false) AND n_slots > 0 AS valid FROM t""",
        "v": "SELECT *, row_number() OVER () AS tid FROM tv WHERE valid",
        "cl": "SELECT code, mtype, tod0 AS tod, avg(diff) AS m FROM v WHERE n_slots = 1 GROUP BY ALL",
        "fl": "SELECT code, mtype, avg(m) AS fill FROM cl GROUP BY ALL",
        "tc": "SELECT code, tariff, count(*) AS c FROM r WHERE tariff IS NOT NULL GROUP BY ALL",
        "tm": """SELECT code, tariff FROM (SELECT *, row_number() OVER (
                   PARTITION BY code ORDER BY c DESC, tariff ASC) AS rn FROM tc) WHERE rn = 1""",
        "ta": "SELECT code, max(length(tariff)) > 0 AS anyne FROM r GROUP BY code",
        "tar": """SELECT ta.code, CASE WHEN anyne THEN tm.tariff ELSE 'Unknown' END AS tariff
          FROM ta LEFT JOIN tm USING (code)""",
        "x": "SELECT v.*, unnest(range(v.n_slots)) AS k FROM v",
        "y": f"SELECT x.*, CAST((x.tod0 + x.k) % {spd} AS INTEGER) AS tod FROM x",
        "z": """SELECT y.*, cl.m IS NOT NULL AS has, coalesce(cl.m, fl.fill, 0.0) AS w
          FROM y LEFT JOIN cl ON cl.code = y.code AND cl.mtype = y.mtype AND cl.tod = y.tod
                 LEFT JOIN fl ON fl.code = y.code AND fl.mtype = y.mtype""",
        "zz": "SELECT z.*, sum(w) OVER (PARTITION BY tid) AS wsum FROM z",
        "o": f"""SELECT zz.code AS meter_customer_code, zz.mtype AS meter_type,
                 make_timestamp(epoch_us(t_prev) + k * {slot_us}) AS slot_start,
                 CASE WHEN n_slots = 1 THEN diff WHEN wsum > 0 THEN diff * w / wsum
                      ELSE diff / n_slots END AS energy_kwh,
                 CASE WHEN n_slots = 1 THEN 'observed' WHEN has THEN 'profile' ELSE 'uniform' END
                   AS imputation_method,
                 tar.tariff
          FROM zz LEFT JOIN tar ON tar.code = zz.code""",
    }


def _clean_sql(slot: int, body: str) -> str:
    src = "readings" if slot == 15 else "readings6h"
    return with_([src], body, _sql_steps(slot))


_OUT = f"""SELECT meter_customer_code, meter_type, slot_start, {rs('energy_kwh', 6)} AS energy_kwh,
       imputation_method, tariff FROM o"""

SQL = {
    "energy_diffs": _clean_sql(15, f"""SELECT code AS meter_customer_code, mtype AS meter_type,
        t_prev, t_next, {rs('diff', 4)} AS diff, n_slots FROM t"""),
    "valid_transitions": _clean_sql(15, f"""SELECT code AS meter_customer_code, mtype AS meter_type,
        t_prev, n_slots, {rs('diff', 4)} AS diff, n_slots = 1 AS clean FROM tv WHERE valid"""),
    "daily_profile": _clean_sql(360, f"""SELECT f.code AS meter_customer_code, f.mtype AS meter_type,
        CAST(g.tod AS INTEGER) AS tod, {rs('coalesce(cl.m, f.fill)', 6)} AS weight, cl.m IS NOT NULL AS has_data
        FROM fl f CROSS JOIN range(4) g(tod)
        LEFT JOIN cl ON cl.code = f.code AND cl.mtype = f.mtype AND cl.tod = g.tod"""),
    "clean_series": _clean_sql(15, _OUT),
    "clean_readings": _clean_sql(360, _OUT),
    "energy_conservation": _clean_sql(15, f"""SELECT (SELECT count(*) FROM o) AS n_rows,
        {rs('(SELECT coalesce(sum(diff), 0.0) FROM v)', 4)} AS raw_total,
        {rs('(SELECT coalesce(sum(energy_kwh), 0.0) FROM o)', 4)} AS out_total,
        abs((SELECT coalesce(sum(diff), 0.0) FROM v) - (SELECT coalesce(sum(energy_kwh), 0.0) FROM o))
          <= 1e-8 + 1e-5 * abs((SELECT coalesce(sum(energy_kwh), 0.0) FROM o)) AS ok"""),
    "modal_tariff": _clean_sql(15, "SELECT code AS meter_customer_code, tariff FROM tar"),
}
