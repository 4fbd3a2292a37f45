"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects the same number of copies, its source's
target over its source's size.  Expected copies are summed up along the source,
ordered by size class, one random offset of the source is added, and a copy is
emitted for each integer boundary that the running sum crosses.  Ordered by
size, the words taken come within about one document of the target.

The running sum is two-level, so that no task holds a source: sums inside
(source, size class, hash block of the id) windows, plus the total of all earlier
blocks, a window over at most about 150 classes x 64 blocks of a source,
whatever its rows.  Sums are integers (units of 2^-28 copies), so that blocks
meet without rounding.  Weights and targets are computed over the table of
sources, one row each.

Defined results: a null text has no words; a source without words has target 0
and no copies; a null source is a source of its own, the last.  Rows that
repeat an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, row_hash, table, text_of

UNIT = 2 ** 28
WEIGHTS = (3.0, 1.0, 2.0)
#: copies of one of several equal rows that a task writes at a time
RUN = 1000


def hash60(c: Column) -> Column:
    """60 bits of the MD5 of a value's text, as a bigint (any engine can compute it)."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes; none gets over ``cap`` times its size, the excess
    goes to the others by weight.  In closed form: sources saturate in the order
    of cap / weight, and the level of the rest is what is left over their weight.
    """
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (sizes.withColumn("i", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
              .withColumn("all", F.sum("source_size").over(every) * F.lit(float(share))))
    order = every.orderBy(F.col("most") / F.col("w"), "i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source below its cap sets the level for itself and all later ones
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") < F.col("most"),
                                           F.struct(F.col("most") / F.col("w"), "i", "level"))).over(every)["level"])
    return s.select("source", "source_size",
                    F.coalesce(F.least("most", F.col("level") * F.col("w")), F.col("most")).alias("target"))


def sample_copies(docs: DataFrame, goal: DataFrame, seed: str = "mix", ties: Sequence[str] = ()) -> DataFrame:
    """``docs`` (doc_id, source, size, ...) with ``source_size``, ``target`` and ``copies``.

    ``goal`` has (source, source_size, target).  ``ties``: columns that order rows of one id.
    """
    g = goal.withColumn("_e", F.coalesce(F.round(F.try_divide(F.col("target"), F.col("source_size")) * F.lit(UNIT)), F.lit(0.0)).cast("bigint")) \
            .withColumn("_u", F.pmod(hash60(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("?")))), F.lit(UNIT))) \
            .withColumnRenamed("source", "_src")
    d = docs.join(g, docs["source"].eqNullSafe(g["_src"])).drop("_src")
    h = hash60(F.col("doc_id"))
    d = d.withColumn("_h", h).withColumn("_k", F.floor(F.log2(F.col("size") + F.lit(1.0)) * F.lit(8.0)).cast("int")) \
         .withColumn("_b", F.shiftright("_h", 54).cast("int"))
    block = ["source", "_k", "_b"]
    tot = d.groupBy(*block).agg(F.sum("_e").alias("_t"))
    earlier = Window.partitionBy("source").orderBy("_k", "_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*[F.col(c).alias("o" + c) for c in block], F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*block).orderBy("_h", "doc_id", *ties).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("_e").over(upto))
    d = d.join(tot, d["source"].eqNullSafe(tot["osource"]) & (d["_k"] == tot["o_k"]) & (d["_b"] == tot["o_b"]))
    end = F.col("_off") + F.col("_in") + F.col("_u")
    d = d.withColumn("copies", F.shiftright(end, 28) - F.shiftright(end - F.col("_e"), 28))
    return d.drop("_e", "_u", "_h", "_k", "_b", "_in", "_off", *["o" + c for c in block])


def words(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                    words(text_col).alias("size"))
    d = materialize(d, "sizes")  # the texts are read once
    goal = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    return sample_copies(d, goal, seed).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns as they were."""
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"),
                    F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), row_hash(docs).alias("seen"))
    lean = materialize(d.select("doc_id", "source", "size", "seen"), "sizes")
    goal = targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    keys = ["doc_id", "source", "size", "seen"]
    # rows that repeat an id have copies of their own; only rows equal in all columns share theirs
    c = sample_copies(lean, goal, seed, ["size", "seen"]).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    c = c.where("copies > 0").select(*[F.col(k).alias("_" + k) for k in keys], F.floor(F.col("copies") / F.col("rows")).cast("int").alias("each"),
                                     (F.col("copies") % F.col("rows")).alias("more"))
    c = materialize(c, "copies")
    same = d["doc_id"].eqNullSafe(c["_doc_id"]) & d["source"].eqNullSafe(c["_source"]) & (d["size"] == c["_size"]) & (d["seen"] == c["_seen"])
    times = lambda j, n: j.select("row", F.explode(F.sequence(F.lit(1), n)).alias("_n")).select("row.*")
    out = times(d.join(c.where("each > 0"), same), F.col("each"))
    if c.where("more > 0").isEmpty():
        return out
    # what equal rows have beyond that: copies of one of them, in runs that are dealt to tasks
    more = d.join(c.where("more > 0"), same).groupBy(*keys).agg(F.first("row").alias("row"), F.first("more").alias("more"))
    more = more.select("row", "seen", F.explode(F.sequence(F.lit(0), F.col("more") - 1, F.lit(RUN))).alias("at"), "more").repartition("seen", "at")
    return out.union(times(more, F.least(F.col("more") - F.col("at"), F.lit(RUN)).cast("int")))


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + (i - 1) % 3] AS w, source_size * 2.0::DOUBLE AS most FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY most / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
lv AS (SELECT lv AS level FROM s3 WHERE lv * w < most ORDER BY most / w, i LIMIT 1),
s AS (SELECT source, source_size, coalesce(least(most, (SELECT level FROM lv) * w), most) AS target FROM s3),
e AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target,
  CASE WHEN s.source_size > 0 THEN round(s.target / s.source_size * {UNIT})::BIGINT ELSE 0 END AS e,
  ('0x' || substr(md5('mix:' || coalesce(d.source, '?')), 1, 15))::BIGINT % {UNIT} AS u,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
  floor(log2(d.size + 1.0::DOUBLE) * 8.0)::INT AS k FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, sum(e) OVER (PARTITION BY source ORDER BY k, h, doc_id ROWS UNBOUNDED PRECEDING) + u AS top FROM e)
SELECT doc_id, size, source_size, target, ((top::BIGINT >> 28) - ((top - e)::BIGINT >> 28)) * size AS taken FROM c"""
