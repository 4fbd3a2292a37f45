"""Monthly totals kept up to date by signed batches.

A batch holds rows of the clean series with a ``sign``: 1 for rows that come in, -1
for rows that are taken back (a correction is both).  It is reduced to one signed
row for each (customer, class, month, site) and written under its own id, so a batch
that runs again counts once and old months are not read to add a new one.  Totals are
the sums over the batches; a group whose rows were all taken back is gone.

Sums are kept to 12 decimals, so what is added and taken back cancels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .usage import _ym_label, consumption_class

KEYS = ["meter_customer_code", "cust_class", "_m", "site_name"]
SCHEMA = ("meter_customer_code string, cust_class string, _m int, site_name string, total decimal(38,12), n_values bigint, n_rows bigint, _batch bigint")


def apply_batch(folder: str, batch_id: int, rows: DataFrame, site="site_name", code="meter_customer_code", ts="slot_start",
                energy="energy_kwh", tariff="tariff", meter_type="meter_type", sign="sign") -> None:
    """Write the signed sums of a batch (overwritten if the batch runs again)."""
    c = rows.where(F.col(meter_type) == "customer")
    value = F.col(energy).cast("decimal(38,12)") * F.col(sign).cast("decimal(1,0)")
    (c.groupBy(F.col(code).alias(KEYS[0]), consumption_class(tariff).alias(KEYS[1]), (F.year(ts) * 100 + F.month(ts)).alias(KEYS[2]), F.col(site).alias(KEYS[3]))
      .agg(F.sum(value.cast("decimal(38,12)")).cast("decimal(38,12)").alias("total"),
           F.sum(F.when(F.col(energy).isNotNull(), F.col(sign)).otherwise(0)).cast("long").alias("n_values"), F.sum(sign).cast("long").alias("n_rows"))
      .write.mode("overwrite").parquet(f"{folder}/_batch={batch_id}"))


def monthly_consumption(spark: SparkSession, folder: str) -> DataFrame:
    """``usage.monthly_consumption`` of all batches so far."""
    d = spark.read.schema(SCHEMA).option("basePath", folder).parquet(folder)
    t = d.groupBy(*KEYS).agg(F.sum("total").cast("double").alias("_t"), F.sum("n_values").alias("_v"), F.sum("n_rows").alias("_n")).where("_n > 0")
    return t.select("meter_customer_code", "cust_class", _ym_label("_m").alias("ym"), "site_name", F.when(F.col("_v") > 0, F.col("_t")).alias("monthly_kwh"))
