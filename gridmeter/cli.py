"""Command line jobs: the data products of the library as Spark jobs.

    python -m gridmeter.cli export  --table T --input PATH --out PATH --salt S [--dry-run]
    python -m gridmeter.cli clean   --readings PATH --out PATH [--site NAME] [--overwrite]
    python -m gridmeter.cli monthly --clean PATH --site-map CSV --out PATH
    python -m gridmeter.cli carbon  --clean PATH --projects PATH --out PATH [--overrides CSV]
    python -m gridmeter.cli power-quality --readings PATH --out PATH
    python -m gridmeter.cli load-profile --clean PATH --readings PATH --stations PATH \
                                         --projects PATH --tariff T --out PATH [--observed-only]

Inputs are Parquet in the released layout (readings carry ``site_name``);
outputs are Parquet or CSV folders.  Every job runs on the session's
cluster; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import carbon as K
from .operators import clean as C
from .operators import profiles as P
from .operators import release as R
from .operators import stats as S
from .operators import usage as U
from .session import get_session
from .sources import io as IO

V_RANGE = (50.0, 300.0, 250)
PF_RANGE = (0.0, 1.0, 200)


def _export(spark, a):
    raw = spark.read.parquet(a.input)
    if a.table == "sparkmeterreadings" and "heartbeatStart" in raw.columns:
        # half-open time range; readings without a time have no year to go to
        ts = F.col("heartbeatStart")
        raw = raw.where((ts >= F.lit(f"{a.from_year}-01-01").cast("timestamp"))
                        & (ts < F.lit(f"{a.to_year + 1}-01-01").cast("timestamp")))
        if a.stations:
            raw = R.resolve_site(raw, spark.read.parquet(a.stations))
        df = R.release_table(raw, a.table, a.salt, unlisted=True)
        df = df.withColumn("site_name", R.safe_name("site_name")).withColumn("year", F.year("heartbeatStart"))
        return IO.incremental_write(df, a.out, ["site_name", "year"], overwrite=a.overwrite,
                                    dry_run=a.dry_run)
    df = R.release_table(raw, a.table, a.salt, unlisted=a.unlisted)
    if not a.overwrite and IO.written_partitions(spark, a.out, []) is not None:
        return 0                                   # a finished output is kept
    return IO.write_parquet(df, a.out, "overwrite", dry_run=a.dry_run)


def _clean(spark, a):
    r = spark.read.parquet(a.readings)
    if a.site:
        r = r.where(F.col("site_name") == a.site)
    # one series per (site, meter), as the site files are cleaned one by one
    extra = ["row_id"] if "row_id" in r.columns else []     # total order of equal timestamps
    out = C.clean_readings(r, by=["site_name"], order_extra=extra)
    return IO.incremental_write(out, a.out, ["site_name"], overwrite=a.overwrite)


def _monthly(spark, a):
    clean = R.without_uuid_sites(spark.read.parquet(a.clean), "site_name")
    site_map = spark.read.option("header", True).csv(a.site_map)
    m = U.map_sites(U.monthly_consumption(clean), site_map)
    IO.write_csv(m, a.out)


def _carbon(spark, a):
    clean = R.without_uuid_sites(spark.read.parquet(a.clean), "site_name")
    over = (spark.read.option("header", True).csv(a.overrides) if a.overrides
            else spark.createDataFrame([], "site_name string, project string"))
    res = K.carbon_accounting(K.annual_consumption(clean, over), spark.read.parquet(a.projects))
    IO.write_csv(res, a.out)


def _power_quality(spark, a):
    r = spark.read.parquet(a.readings).where(F.col("meter_type") == "customer")
    m = None
    for c in ("voltageMin", "voltageAvg", "voltageMax"):
        cond = (F.col(c) > V_RANGE[0]) & (F.col(c) <= V_RANGE[1])
        m = cond if m is None else m & cond
    v = r.where(m)
    IO.write_csv(S.histogram(v, ["voltageMin", "voltageAvg", "voltageMax"], *V_RANGE), a.out + "/histograms")
    pf = v.where((F.col("powerFactorAvg") > PF_RANGE[0]) & (F.col("powerFactorAvg") <= PF_RANGE[1]))
    IO.write_csv(S.histogram2d(pf, "voltageAvg", "powerFactorAvg", V_RANGE, PF_RANGE), a.out + "/scatter")


def _load_profile(spark, a):
    clean = spark.read.parquet(a.clean)
    raw = C.coerce_readings(spark.read.parquet(a.readings))
    site = ["site_name"] if "site_name" in raw.columns else []
    modal = C.modal_tariff(raw, "meter_customer_code", "meter_tariff_name", "tariff") if not site else \
        C.modal_tariff(raw.withColumn("_key", F.struct("site_name", "meter_customer_code")), "_key", "meter_tariff_name", "tariff") \
         .select("_key.*", "tariff")
    customers = P.customers_by_tariff(modal, a.tariff, site="site_name" if site else None)
    offsets = P.site_utc_offset(spark.read.parquet(a.stations), spark.read.parquet(a.projects))
    stats = P.load_profile(clean, offsets, customers, observed_only=a.observed_only, default_offset=a.default_offset)
    IO.write_csv(P.load_profile_ci(stats), a.out)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="gridmeter")
    sub = ap.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("export")
    e.add_argument("--table", required=True)
    e.add_argument("--input", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--salt", required=True)
    e.add_argument("--overwrite", action="store_true")
    e.add_argument("--dry-run", action="store_true")
    e.add_argument("--unlisted", action="store_true", help="release a table that no rule names")
    e.add_argument("--stations", help="stations table, to resolve site ids of readings")
    e.add_argument("--from-year", type=int, default=2015)
    e.add_argument("--to-year", type=int, default=2100)
    c = sub.add_parser("clean")
    c.add_argument("--readings", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--site")
    c.add_argument("--overwrite", action="store_true")
    m = sub.add_parser("monthly")
    m.add_argument("--clean", required=True)
    m.add_argument("--site-map", required=True)
    m.add_argument("--out", required=True)
    k = sub.add_parser("carbon")
    k.add_argument("--clean", required=True)
    k.add_argument("--projects", required=True)
    k.add_argument("--overrides")
    k.add_argument("--out", required=True)
    q = sub.add_parser("power-quality")
    q.add_argument("--readings", required=True)
    q.add_argument("--out", required=True)
    lp = sub.add_parser("load-profile")
    for o in ("--clean", "--readings", "--stations", "--projects", "--tariff", "--out"):
        lp.add_argument(o, required=True)
    lp.add_argument("--observed-only", action="store_true")
    lp.add_argument("--default-offset", type=int, help="UTC offset of sites without one (else an error)")
    a = ap.parse_args(argv)
    spark = get_session()
    jobs = {"export": _export, "clean": _clean, "monthly": _monthly, "carbon": _carbon,
            "power-quality": _power_quality, "load-profile": _load_profile}
    res = jobs[a.cmd](spark, a)
    if res is not None:
        print(res)
    return 0


if __name__ == "__main__":
    sys.exit(main())
