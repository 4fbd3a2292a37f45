"""Connected components of a table of edges, by hooking and pointer jumping.

Labels only fall; every round each node takes the smallest label next to it, hands
it to the node that its old label names, and then looks up its label's label.
Rounds grow with the logarithm of a component's width, and each is written to the
shared checkpoint folder, so nothing hangs on an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, shared_folder


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in edges (u, v); label: the smallest node of the component."""
    spark, made = edges.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(shared_folder(spark, name))
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    e = edges.where("u <> v").select("u", "v").distinct()
    both = keep(e.union(e.select(F.col("v"), F.col("u"))), "edges")
    lab = keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (both.join(lab.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m")))
        got = lab.join(near, lab["node"] == near["u"]).select("node", "label", F.least("label", "m").alias("m"))
        low = got.select("node", "m").union(got.where("m < label").select(F.col("label"), "m")).groupBy("node").agg(F.min("m").alias("m"))
        low = keep(low, "low")
        up = low.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        new = keep(low.join(up, "m").select("node", F.col("mm").alias("label")), "labels")
        same = new.join(lab, ["node", "label"], "left_anti").isEmpty()
        lab = new
        for p in made[1:-1]:
            drop_folder(spark, p)
        made[1:-1] = []
        if same:
            return lab
