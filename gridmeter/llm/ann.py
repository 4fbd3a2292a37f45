"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors of each length, a bounded sample by a hash of the id, are ordered by
their distance from each vector: its permutation.  Vectors are dealt into blocks of about
``BLOCK_ROWS``.  A block has an inverted file for each pivot, and a vector is posted in the
files of its ``POSTED`` nearest pivots alone.  A query reads the files of its own ``READ``
nearest pivots; what it finds there is ranked by how far the places of all pivots in the two
permutations lie apart (the footrule distance).  The ``CANDIDATES`` best of each block are
ranked again by the true distance.  Every vector is indexed; recall against brute force is in
the README (0.9 and more).  A block of fewer vectors than that has no use for files: all of
them are ranked by the true distance.

Equal vectors are one entry of the index that keeps its k + 1 smallest ids, so a
vector that a third of all rows hold does not fill the candidates.  Queries are dealt
into strips of about ``STRIP_ROWS``, and each strip meets each block in a task of its
own, which gives back k + 1 entries for each query.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without an id.  Vectors of one length are searched among
themselves, as no distance joins two lengths.  Rows that repeat an id and its vector
count once.  Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

PIVOTS, CANDIDATES = 256, 600
POSTED, READ = 8, 32
BLOCK_ROWS, STRIP_ROWS = 20_000, 4_000


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    d = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return d.where(F.col("vec_id").isNotNull() & F.forall("v", good) & F.exists("v", lambda x: x != 0)) \
            .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T, 0))


def permutations(d: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``d`` (with ``v`` and its length ``n``) with ``perm``: the pivots of that length from the
    nearest to the farthest, as 16-bit integers; empty for a length without pivots."""
    names = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                size = part.column("n").to_numpy()
                perms = [b""] * len(size)
                for n in np.unique(size).tolist():
                    if n in pivots:
                        rows = np.flatnonzero(size == n)
                        far = distances(matrix(part.column("v").take(pa.array(rows))), pivots[n])
                        for k, x in zip(rows.tolist(), np.argsort(far, 1, kind="stable").astype(np.int16)):
                            perms[k] = x.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(perms, pa.binary())], [*names, "perm"])

    return d.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", perm binary")


class Block:
    """The inverted files of a block: who is posted under each pivot, and every pivot's place in each permutation."""

    def __init__(self, perm: np.ndarray, posted: int):
        n, pivots = perm.shape
        self.place = np.empty_like(perm)
        np.put_along_axis(self.place, perm, np.arange(pivots, dtype=perm.dtype)[None], 1)
        near = perm[:, :posted].ravel()
        order = np.argsort(near, kind="stable")
        self.rows = np.repeat(np.arange(n), min(posted, pivots))[order]
        self.at = np.searchsorted(near[order], np.arange(pivots + 1))

    def file(self, pivot: int) -> np.ndarray:
        return self.rows[self.at[pivot]:self.at[pivot + 1]]

    def best(self, order: np.ndarray, read: int, candidates: int) -> np.ndarray:
        """The entries of the query's nearest files that come first by the footrule distance."""
        seen = np.zeros(len(self.place), bool)
        for pivot in order[:read].tolist():
            seen[self.file(pivot)] = True
        found = np.flatnonzero(seen)
        if len(found) <= candidates:
            return found
        own = np.empty_like(order)
        own[order] = np.arange(len(order), dtype=order.dtype)
        apart = np.abs(self.place[found] - own).sum(1, dtype=np.int32)
        return found[np.argpartition(apart, candidates)[:candidates]]


def search(index: DataFrame, visitors: DataFrame, k: int, candidates: int, posted: int, read: int) -> DataFrame:
    """(quid, members, score): the k + 1 nearest entries of each block for each visitor."""
    out = pa.schema([("quid", pa.int64()), ("members", pa.list_(pa.int64())), ("score", pa.float64())])

    def meet(block: pa.Table, strip: pa.Table) -> pa.Table:
        if not block.num_rows or not strip.num_rows:
            return out.empty_table()
        perm, asked = (np.frombuffer(b"".join(x["perm"].to_pylist()), np.int16).reshape(x.num_rows, -1) for x in (block, strip))
        v, qv = (matrix(x["v"].combine_chunks()) for x in (block, strip))
        first = block["uid"].to_numpy()
        files = Block(perm, posted) if block.num_rows > candidates and perm.shape[1] else None
        quid, rows, scores = [], [], []
        for i, q in enumerate(strip["quid"].to_pylist()):
            best = files.best(asked[i], read, candidates) if files else np.arange(block.num_rows)
            score = np.sqrt(((v[best] - qv[i]) ** 2).sum(1))
            o = np.lexsort((first[best], score))[:k + 1]
            quid.append(np.full(len(o), q))
            rows.append(best[o])
            scores.append(score[o])
        members = block["members"].combine_chunks().take(pa.array(np.concatenate(rows)))
        return pa.table([pa.array(np.concatenate(quid), pa.int64()), members, pa.array(np.concatenate(scores))], schema=out)

    keys = ["n", "block", "strip"]
    return index.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(meet, "quid bigint, members array<bigint>, score double")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
               pivots: int = PIVOTS, candidates: int = CANDIDATES, block_rows: int = BLOCK_ROWS, posted: int = POSTED,
               read: int = READ) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found in ``vectors`` for each row of ``queries``."""
    every = usable(vectors, id_col, vec_col).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    index = (every.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
                  .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
                  .select(F.size("v").alias("n"), "v", "members", F.element_at("members", 1).alias("uid")))
    index = materialize(index, "vectors")
    # pivots only for lengths of which there are more vectors than are ranked by the true distance
    many = index.groupBy("n").agg(F.count("*").alias("rows")).where(F.col("rows") > candidates).select("n")
    by_hash = Window.partitionBy("n").orderBy(F.xxhash64("uid", "v"), "uid")
    sample: dict[int, list] = {}
    for r in index.join(many, "n").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= pivots).select("n", "r", "v").orderBy("n", "r").collect():
        sample.setdefault(r.n, []).append(r.v)
    sample = {n: np.array(v) for n, v in sample.items()}
    index = materialize(permutations(index, sample), "permutations")

    asked = usable(queries, id_col, vec_col).distinct()
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("quid"), F.size("v").alias("n"), "v"), "queries")
    visitors = materialize(permutations(asked.groupBy("quid", "n").agg(F.first("v").alias("v")), sample), "visitors")

    parts = lambda d, c, m: d.groupBy("n").agg(F.ceil(F.count("*") / m).alias(c))
    sizes = parts(index, "blocks", block_rows).join(parts(visitors, "strips", STRIP_ROWS), "n")
    every_one = lambda c, m: F.explode(F.sequence(F.lit(0), F.col(m).cast("int") - 1)).alias(c)
    dealt = lambda c, m, *by: F.pmod(F.xxhash64(*by), F.col(m)).cast("int").alias(c)
    found = search(index.join(sizes, "n").select("n", "uid", "members", "v", "perm", dealt("block", "blocks", "v"), every_one("strip", "strips")),
                   visitors.join(sizes, "n").select("n", "quid", "v", "perm", dealt("strip", "strips", "quid"), every_one("block", "blocks")),
                   k, candidates, posted, read)
    near = found.select("quid", "score", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("quid").orderBy("score", "vec_id")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("quid", "score", "vec_id")
    mine = Window.partitionBy("query_id", "quid").orderBy("score", "vec_id")
    return (asked.select("query_id", "quid").join(near, "quid").where("query_id <> vec_id")
                 .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


def op7_ann(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return neighbours(v, v.where("vec_id % 100 = 0"))
