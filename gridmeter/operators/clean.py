"""Raw cumulative-counter heartbeats -> clean, regular energy series.

Data flow (all native DataFrame operators, no UDF):

    readings --coerce--> r --transitions--> t (one row per consecutive pair)
                                  |                 |
                          clean 1-slot pairs        | valid pairs
                                  v                 v
                          daily_profile -----> expand (sequence + explode)
                                                    v
                                             clean series rows

Scale design.  A single meter may hold a large share of all rows, so no step
keeps a whole meter in one task:

* ``transitions`` orders rows inside (meter, time bucket) windows -- one
  shuffle and one sort of the input; the last row of every bucket gets the
  first row of the meter's next non-empty bucket from a small per-bucket
  table (one row per meter-bucket), so ``lead()`` crosses bucket borders
  without any task holding a whole meter.
* the daily profile is a partial/final hash aggregate to (meter, slot) and
  then a 96-entry array per meter.
* the window output feeds three branches (profile, meter keys, expansion)
  and is materialized once in the checkpoint folder.
* per-meter facts (96-slot profile, modal tariff) form one small row per
  meter, joined to the valid transitions on the meter keys; AQE's skew-join
  handling splits the partition of a hot meter (the meter table side is
  replicated per split), so no task holds a whole hot meter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import nan_to_null, slot_of_day, to_number, to_timestamp_utc
from ..session import materialize as _materialize

SLOT_MINUTES = 15
DAY_SECONDS = 86400

OUT_COLS = ["meter_customer_code", "meter_type", "slot_start", "energy_kwh",
            "imputation_method", "tariff"]


def coerce_readings(df: DataFrame, code="meter_customer_code", mtype="meter_type",
                    ts="heartbeatStart", energy="energy", state="state",
                    tariff="meter_tariff_name", order_extra=()) -> DataFrame:
    """Coerce types and drop rows that cannot be placed.

    Output columns: code, mtype, ts (TIMESTAMP), energy (double, NaN->NULL),
    state (double, NaN->NULL), tariff, plus ``order_extra`` tie-breakers.
    """
    cols = [F.col(code).cast("string").alias(code), F.col(mtype).cast("string").alias(mtype),
            to_timestamp_utc(df, ts).alias(ts),
            nan_to_null(to_number(df, energy)).alias(energy),
            nan_to_null(to_number(df, state)).alias(state)]
    if tariff is not None:
        cols.append(F.col(tariff).cast("string").alias(tariff))
    cols += [F.col(c) for c in order_extra]
    # NULL code/type: pandas groupby drops the row.  NULL timestamp: the
    # reference would wrap int64; we drop it (documented deviation).
    return df.select(*cols).dropna(subset=[code, mtype, ts])


def modal_tariff(df: DataFrame, code="meter_customer_code", tariff="meter_tariff_name",
                 out="tariff", unknown="Unknown", by=()) -> DataFrame:
    """Most common non-NULL tariff per customer; ties -> smallest value;
    ``unknown`` when the customer has no non-empty tariff (A9, S6, S27).

    ``mode`` keeps one counter per distinct value and merges partially, so a
    hot customer is combined map-side.
    """
    return (df.groupBy(*by, code)
              .agg(F.mode(F.col(tariff), True).alias("_mode"),
                   F.max(F.length(tariff) > 0).alias("_any"))
              .select(*by, code, F.when(F.col("_any"), F.col("_mode"))
                                   .otherwise(F.lit(unknown)).alias(out)))


def _bucket(ts: Column, bucket_seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(bucket_seconds))


def transitions(df: DataFrame, keys=("meter_customer_code", "meter_type"), ts="heartbeatStart",
                counter="energy", state="state", order_extra=(), slot_minutes=SLOT_MINUTES,
                ok_state=1, bucket_seconds=DAY_SECONDS, materialize=False) -> DataFrame:
    """One row per consecutive pair of readings of a meter (G1, W1, W2, FLT15).

    Rows are ordered by ``(ts, *order_extra)`` (a total order; S14).
    Output: keys, ``_b`` (time bucket of the earlier row), t_prev, t_next,
    e_prev, e_next, s_prev, s_next, diff, n_slots, valid, clean.

    valid  = diff >= 0 and both states == ok_state and round(gap/slot) >= 1
    clean  = valid and exactly one slot apart.

    One window pass over (meter, bucket) gives every row its successor
    inside the bucket and flags the bucket's first row.  The last row of a
    bucket (one per meter-bucket, a small set) takes the first row of the
    meter's next non-empty bucket through a window over the small
    per-bucket table and a join on (meter, bucket).  ``materialize`` writes
    the window output once to the checkpoint folder.
    """
    keys = list(keys)
    order = [ts, *order_extra]
    payload = order + [c for c in (counter, state) if c not in order]
    base = (df.select(*keys, *payload)
              .withColumn("_b", _bucket(F.col(ts), bucket_seconds)))
    w = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    row = F.struct(F.col(ts).alias("t"), F.col(counter).alias("e"), F.col(state).alias("s"))
    win = (base.withColumn("_n", F.lead(row).over(w))
               .withColumn("_first", F.row_number().over(w) == 1)
               .select(*keys, "_b", row.alias("_p"), "_n", "_first"))
    if materialize:
        win = _materialize(win, "series")
    firsts = win.where("_first").select(*keys, "_b", F.col("_p").alias("_f"))
    nxt = (firsts.withColumn("_nf", F.lead("_f").over(Window.partitionBy(*keys).orderBy("_b")))
                 .where(F.col("_nf").isNotNull()).select(*keys, "_b", "_nf"))
    # only a bucket's last row has no successor of its own
    t = (win.join(nxt, [*keys, "_b"], "left")
            .withColumn("_n", F.coalesce("_n", "_nf")).where(F.col("_n").isNotNull())
            .select(*keys, "_b", F.col("_p.t").alias("t_prev"), F.col("_n.t").alias("t_next"),
                    F.col("_p.e").alias("e_prev"), F.col("_n.e").alias("e_next"),
                    F.col("_p.s").alias("s_prev"), F.col("_n.s").alias("s_next")))
    return judged(t, slot_minutes, ok_state)


def judged(pairs: DataFrame, slot_minutes=SLOT_MINUTES, ok_state=1) -> DataFrame:
    """``pairs`` (t_prev, t_next, e_prev, e_next, s_prev, s_next) with diff, n_slots, valid, clean."""
    slot_us = slot_minutes * 60 * 1_000_000
    gap = F.bround((F.unix_micros("t_next") - F.unix_micros("t_prev")) / F.lit(float(slot_us)), 0)
    t = (pairs.withColumn("diff", F.col("e_next") - F.col("e_prev"))
              .withColumn("n_slots", gap.cast("long")))
    ok = F.lit(float(ok_state))
    valid = (F.coalesce(F.col("diff") >= 0, F.lit(False))
             & F.coalesce(F.col("s_prev") == ok, F.lit(False))
             & F.coalesce(F.col("s_next") == ok, F.lit(False))
             & (F.col("n_slots") > 0))
    return (t.withColumn("valid", valid)
             .withColumn("clean", F.col("valid") & (F.col("n_slots") == 1)))


def daily_profile(trans: DataFrame, keys=("meter_customer_code", "meter_type"),
                  slot_minutes=SLOT_MINUTES) -> DataFrame:
    """Per meter: mean diff of clean transitions for each slot of the day.

    Returns keys, ``w`` (array of slots-per-day weights: the slot mean, or
    the mean of the slot means where a slot has no data), ``has`` (array of
    booleans) and ``w_total`` (sum of ``w``).  Only meters with at least one
    clean transition get a row.
    """
    keys = list(keys)
    per_slot = (trans.where("clean")
                     .groupBy(*keys, slot_of_day("t_prev", slot_minutes).alias("tod"))
                     .agg(F.avg("diff").alias("m")))
    return profile_of_means(per_slot, keys, slot_minutes)


def profile_of_means(per_slot: DataFrame, keys=("meter_customer_code", "meter_type"), slot_minutes=SLOT_MINUTES) -> DataFrame:
    """:func:`daily_profile` from the mean ``m`` of each slot ``tod`` that has one."""
    keys = list(keys)
    spd = 24 * 60 // slot_minutes
    prof = (per_slot.groupBy(*keys)
                    .agg(F.map_from_entries(F.collect_list(F.struct("tod", "m"))).alias("pm"),
                         F.avg("m").alias("fill")))
    idx = F.sequence(F.lit(0), F.lit(spd - 1))
    w = F.transform(idx, lambda i: F.coalesce(F.col("pm")[i], F.col("fill")))
    has = F.transform(idx, lambda i: F.col("pm")[i].isNotNull())
    return (prof.select(*keys, w.alias("w"), has.alias("has"))
                .withColumn("w_total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x)))


def expand(trans: DataFrame, meta: DataFrame, keys=("meter_customer_code", "meter_type"),
           slot_minutes=SLOT_MINUTES) -> DataFrame:
    """Spread every valid transition over its ``n_slots`` slots.

    ``meta`` has one row per meter with ``w``/``has``/``w_total`` (NULL when
    the meter has no profile) and ``tariff``.  It is joined on the meter
    keys; a hot meter's partition is split by AQE's skew-join handling.  Slot k starts at
    ``t_prev + k*slot`` (not snapped to a grid) and gets
    ``diff*w/sum(w)``, or ``diff/n`` when all weights are 0; single-slot
    transitions keep their diff.  Labels: observed / profile / uniform.
    """
    keys = list(keys)
    spd = 24 * 60 // slot_minutes
    v = trans.where("valid").join(meta, keys, "left")
    tod0 = slot_of_day("t_prev", slot_minutes)
    # sum of weights over the gap in closed form: full days + remainder.
    rem = F.pmod(F.col("n_slots"), F.lit(spd)).cast("int")
    part = F.aggregate(F.sequence(F.lit(0), rem - 1),
                       F.lit(0.0),
                       lambda a, j: a + F.col("w")[F.pmod(F.col("_tod0") + j, F.lit(spd))])
    wsum = F.when(rem > 0, part).otherwise(F.lit(0.0)) + \
        F.floor(F.col("n_slots") / F.lit(spd)) * F.col("w_total")
    v = (v.withColumn("_tod0", tod0)
          .withColumn("_wsum", F.when(F.col("n_slots") > 1,
                                      F.coalesce(wsum, F.lit(0.0)))))
    x = v.select(*keys, "t_prev", "diff", "n_slots", "_tod0", "_wsum", "w", "has", "tariff",
                 F.explode(F.sequence(F.lit(0), (F.col("n_slots") - 1).cast("int"))).alias("k"))
    tod = F.pmod(F.col("_tod0") + F.col("k"), F.lit(spd))
    wk = F.coalesce(F.col("w")[tod], F.lit(0.0))
    single = F.col("n_slots") == 1
    energy = (F.when(single, F.col("diff"))
               .when(F.col("_wsum") > 0, F.col("diff") * wk / F.col("_wsum"))
               .otherwise(F.col("diff") / F.col("n_slots")))
    method = (F.when(single, F.lit("observed"))
               .when(F.coalesce(F.col("has")[tod], F.lit(False)), F.lit("profile"))
               .otherwise(F.lit("uniform")))
    slot_start = F.timestamp_micros(F.unix_micros("t_prev")
                                    + F.col("k").cast("long") * F.lit(slot_minutes * 60 * 1_000_000))
    return x.select(*[F.col(k) for k in keys], slot_start.alias("slot_start"),
                    energy.alias("energy_kwh"), method.alias("imputation_method"),
                    F.col("tariff"))


def clean_readings(readings: DataFrame, code="meter_customer_code", mtype="meter_type",
                   ts="heartbeatStart", energy="energy", state="state",
                   tariff="meter_tariff_name", order_extra=(), slot_minutes=SLOT_MINUTES,
                   bucket_seconds=DAY_SECONDS, return_transitions=False, materialize=True, by=()):
    """The full cleaning pipeline (G4): raw heartbeats -> 6-column clean series.

    ``by``: further key columns in front of the meter keys (e.g. the site,
    as the reference cleans one site file at a time: meters and modal
    tariffs are then per site); they are kept in the output.

    Meters with < 2 rows or without a valid transition yield nothing.
    With ``return_transitions`` also returns the transitions frame (for the
    conservation check, which must see the same pairs).  The transitions
    feed three branches (profile, key set, expansion); ``materialize``
    checkpoints them once instead of recomputing the big shuffle per branch.
    """
    by = list(by)
    r = coerce_readings(readings, code, mtype, ts, energy, state, tariff,
                        order_extra=by + [c for c in order_extra if c not in (energy,)])
    if by:
        r = r.dropna(subset=by)
    # energy is a natural tie-breaker after the timestamp.
    extra = [energy] + [c for c in order_extra if c != energy]
    keys = [*by, code, mtype]
    t = transitions(r, keys, ts, energy, state, extra, slot_minutes, 1, bucket_seconds,
                    materialize=materialize)
    prof = daily_profile(t, keys, slot_minutes)
    tar = modal_tariff(r, code, tariff, "tariff", by=by)
    # one row per meter: its profile and its customer's modal tariff
    meta = (t.where("valid").select(*keys).distinct().join(prof, keys, "left")
             .join(tar, [*by, code], "left"))
    out = expand(t, meta, keys, slot_minutes)
    out = out.withColumnsRenamed({code: "meter_customer_code", mtype: "meter_type"}) \
        if (code, mtype) != ("meter_customer_code", "meter_type") else out
    return (out, t) if return_transitions else out


def conservation_check(out: DataFrame, trans: DataFrame, rtol=1e-5, atol=1e-8) -> DataFrame:
    """Sum of output energy vs sum of valid diffs; ``np.isclose`` rule.

    Both sums come from one aggregate over a tagged union (no join).
    """
    o = out.select(F.col("energy_kwh").alias("_o"), F.lit(None).cast("double").alias("_r"),
                   F.lit(1).alias("_n"))
    r = trans.where("valid").select(F.lit(None).cast("double").alias("_o"),
                                    F.col("diff").alias("_r"), F.lit(0).alias("_n"))
    a = o.unionByName(r).agg(F.sum("_n").cast("long").alias("n_rows"),
                             F.coalesce(F.sum("_r"), F.lit(0.0)).alias("raw_total"),
                             F.coalesce(F.sum("_o"), F.lit(0.0)).alias("out_total"))
    ok = F.abs(F.col("raw_total") - F.col("out_total")) <= \
        F.lit(atol) + F.lit(rtol) * F.abs(F.col("out_total"))
    return a.select("n_rows", "raw_total", "out_total", ok.alias("ok"))
