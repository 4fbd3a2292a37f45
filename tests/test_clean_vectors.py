"""Hand-worked vectors for the cleaning pipeline (FIXTURES.md section 2)."""

from datetime import datetime, timedelta

import pytest

from gridmeter.operators import clean as C

D = datetime(2024, 3, 5)
SCHEMA = "meter_customer_code string, meter_type string, heartbeatStart timestamp, energy double, state double, meter_tariff_name string, row_id long"


def _df(spark, rows, code="c1", mtype="customer", tariff="Residential"):
    data = [(code, mtype, ts, e, None if s is None else float(s), tariff, i)
            for i, (ts, e, s) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def _clean(spark, rows, **kw):
    out = C.clean_readings(_df(spark, rows, **kw), order_extra=["row_id"]).collect()
    return sorted(out, key=lambda r: r.slot_start)


def _summary(rows):
    s = {}
    for r in rows:
        n, e = s.get(r.imputation_method, (0, 0.0))
        s[r.imputation_method] = (n + 1, e + r.energy_kwh)
    return {k: (n, round(e, 9)) for k, (n, e) in s.items()}


def test_cr1_gap_filling(spark):
    m = lambda h, mi=0, d=0: D + timedelta(days=d, hours=h, minutes=mi)
    rows = [(m(0), 10.0, 1), (m(0, 15), 10.4, 1), (m(0, 30), 11.0, 1), (m(1, 15), 11.9, 1),
            (m(1, 30), 1.0, 1), (m(1, 45), 1.5, 0), (m(2), 1.7, 1), (m(0, 0, 1), 10.5, 1),
            (m(0, 45, 1), 12.0, 1)]
    out = _clean(spark, rows)
    assert len(out) == 96
    assert _summary(out) == {"observed": (2, 1.0), "profile": (2, 1.0), "uniform": (92, 10.2)}
    assert round(sum(r.energy_kwh for r in out), 9) == 12.2
    last3 = [(r.slot_start, round(r.energy_kwh, 9), r.imputation_method) for r in out[-3:]]
    assert last3 == [(m(0, 0, 1), 0.4, "profile"), (m(0, 15, 1), 0.6, "profile"),
                     (m(0, 30, 1), 0.5, "uniform")]
    assert {r.tariff for r in out} == {"Residential"}


def test_cr2_no_clean_transition(spark):
    out = _clean(spark, [(D, 0.0, 1), (D + timedelta(hours=1), 2.0, 1)])
    assert [(round(r.energy_kwh, 9), r.imputation_method) for r in out] == [(0.5, "uniform")] * 4


def test_cr3_all_zero_profile(spark):
    rows = [(D, 5.0, 1), (D + timedelta(minutes=15), 5.0, 1),
            (D + timedelta(days=1, minutes=15), 14.6, 1)]
    out = _clean(spark, rows)
    assert out[0].imputation_method == "observed" and out[0].energy_kwh == 0.0
    rest = out[1:]
    assert len(rest) == 96
    assert all(abs(r.energy_kwh - 0.1) < 1e-12 for r in rest)
    labels = [r.imputation_method for r in rest]
    assert labels.count("profile") == 1 and labels.count("uniform") == 95


@pytest.mark.parametrize("minutes,slots", [(7.5, 0), (22.5, 2), (37.5, 2), (0, 0), (15, 1), (30, 2)])
def test_cr4_gap_rounding_half_even(spark, minutes, slots):
    rows = [(D, 1.0, 1), (D + timedelta(minutes=minutes), 2.0, 1)]
    df = C.coerce_readings(_df(spark, rows), order_extra=["row_id"])
    t = C.transitions(df, order_extra=["energy", "row_id"]).collect()
    assert len(t) == 1
    assert t[0].n_slots == slots
    assert t[0].valid == (slots > 0)


def test_cr5_edges(spark):
    # one reading -> nothing; NULL state -> invalid; NULL energy -> invalid
    assert _clean(spark, [(D, 1.0, 1)]) == []
    rows = [(D, 1.0, None), (D + timedelta(minutes=15), 2.0, 1), (D + timedelta(minutes=30), None, 1),
            (D + timedelta(minutes=45), 4.0, 1)]
    assert _clean(spark, rows) == []
    nan = float("nan")
    rows = [(D, 1.0, 1), (D + timedelta(minutes=15), nan, 1), (D + timedelta(minutes=30), 3.0, 1)]
    assert _clean(spark, rows) == []


def test_null_code_and_timestamp_dropped(spark):
    data = [(None, "customer", D, 1.0, 1.0, "a", 0), ("c", "customer", None, 2.0, 1.0, "a", 1),
            ("c", "customer", D, 1.0, 1.0, "a", 2), ("c", "customer", D + timedelta(minutes=15), 2.0, 1.0, "a", 3)]
    out = C.clean_readings(spark.createDataFrame(data, SCHEMA), order_extra=["row_id"]).collect()
    assert [(r.meter_customer_code, r.energy_kwh) for r in out] == [("c", 1.0)]


def test_md1_modal_tariff(spark):
    data = [("a", v) for v in ["b", "a", "a", "b", None]] + [("n", None), ("e", ""), ("e", "")] + \
        [("t", "z"), ("t", "y")]
    df = spark.createDataFrame(data, "meter_customer_code string, meter_tariff_name string")
    got = {r.meter_customer_code: r.tariff for r in C.modal_tariff(df).collect()}
    assert got == {"a": "a", "n": "Unknown", "e": "Unknown", "t": "y"}


def test_hot_meter_spans_buckets(spark):
    """A meter whose readings span many day buckets gives the same series
    as with one bucket (the ghost-row stitching across buckets)."""
    rows = [(D + timedelta(minutes=15 * i), float(i) * 0.25 + (i % 7) * 0.01, 1) for i in range(400)]
    a = C.clean_readings(_df(spark, rows), order_extra=["row_id"], bucket_seconds=3600).collect()
    b = C.clean_readings(_df(spark, rows), order_extra=["row_id"], bucket_seconds=10 ** 9).collect()
    key = lambda r: r.slot_start
    assert [(r.slot_start, round(r.energy_kwh, 12)) for r in sorted(a, key=key)] == \
        [(r.slot_start, round(r.energy_kwh, 12)) for r in sorted(b, key=key)]
    assert len(a) == 399


def test_conservation(spark):
    rows = [(D + timedelta(minutes=15 * i * (1 + i % 3)), float(i * i) / 10, 1) for i in range(60)]
    out, t = C.clean_readings(_df(spark, rows), order_extra=["row_id"], return_transitions=True)
    r = C.conservation_check(out, t).collect()[0]
    assert r.ok and abs(r.raw_total - r.out_total) < 1e-6
