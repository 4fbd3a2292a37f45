"""Ranked lexical search by norm buckets of impact vectors.

A document is a vector over the terms that the items hold: w times the saturated
frequency of each, all integers.  An item is the indicator vector of its terms, so a score is
an inner product, and the best documents of an item are found as in LEMP:

*   Vectors are ordered by length and dealt to partitions by ranges of it; a partition goes
    through its vectors from the longest on, in buckets of ``BUCKET``.
*   For a whole bucket and all items at once, Cauchy-Schwarz (the greatest length times the
    root of the number of terms) and the sum of the bucket's coordinate maxima bound the score;
    items that cannot reach their threshold skip the bucket.
*   Inside, coordinates are taken from the greatest maximum down.  Only documents that hold one
    of the first coordinates can still reach the threshold; after each further coordinate those
    go whose sum and what is left of the maxima stay below it, or whose sum and length do.
    The survivors' sums are then complete, exact 64-bit integers.

A threshold is the k-th best (score, id) so far, in the partition and in a sample: a row's
level is the number of leading zeros of a hash in steps of ``STEP`` bits, the rows of a level
and above are nested samples, each 64 times as large, and each round's k-th best hold for the
next.  The last round goes through all rows, so samples decide what is skipped, never results.

Items come in blocks of at most ``ITEM_BYTES`` of text (a longer item is a block of its own).
Only a block's items and its terms' counts reach the driver and the tasks.

Defined results: documents and items without a term (null, empty, signs alone) have no rows;
repeated documents are documents of their own, null ``doc_id`` rank after others of the same
score; items that repeat id and text are one, those that share an id alone are items of their
own under it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import materialize, table

#: bytes of item text in a block
ITEM_BYTES = 4 << 20
#: vectors of a partition and of a bucket
PART_ROWS, BUCKET = 20_000, 2_048
#: bits of a level, levels, and rows that a sample has at least
STEP, LEVELS, SAMPLE_ROWS = 6, 8, 1_000
#: partial results that one task orders
GROUP_PARTS = 256
LAST = np.iinfo(np.int64).max

#: letters and digits stay, A-Z in lower case, other ASCII parts terms
_PARTS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text with repeats."""
    return (text or "").encode().translate(_PARTS).split()


class Items:
    """A block of items: their terms by number, as flat arrays."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.vocab: dict[bytes, int] = {}
        self.ids, lists = [], []
        for item_id, text in rows:
            own = sorted({self.vocab.setdefault(t, len(self.vocab)) for t in terms(text)})
            if own:
                self.ids.append(item_id)
                lists.append(own)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.terms = np.array([t for x in lists for t in x], np.int64)


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items, in blocks of at most ``ITEM_BYTES``."""
    d = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")) \
             .where("text IS NOT NULL").distinct()
    d = materialize(d.withColumn("h", F.xxhash64("item_id", "text")), "items")
    size = F.sum(F.octet_length("text") + 8).alias("size")
    n = max(1, -(-(d.agg(size).first()[0] or 0) // (ITEM_BYTES // 2)))
    while d.groupBy(F.pmod("h", F.lit(n))).agg(size, F.count("*").alias("n")).where(f"size > {ITEM_BYTES} AND n > 1").limit(1).count():
        n *= 2
    for b in range(n):
        yield Items(sorted(((r.item_id, r.text) for r in d.where(F.pmod("h", F.lit(n)) == b).collect()), key=lambda r: (r[0] is None, r)))


def vectors(docs: DataFrame, vocab: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms array<int>, tfs array<int> of every row, over the terms of ``vocab``."""
    width = max(1, len(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocab.get
        for whole in batches:
            for b in slices(whole, "text"):
                n, found, doc = [], [], []
                for i, x in enumerate(b.column("text").to_pylist()):
                    words = terms(x)
                    hit = [v for v in map(get, words) if v is not None]
                    n.append(len(words))
                    found += hit
                    doc.append(len(hit))
                key, tf = np.unique(np.repeat(np.arange(len(n)), doc) * width + np.array(found, np.int64), return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array((key % width).astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tfs"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of int lists, as 64-bit integers, and how many each list has."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)


def impacts(found: DataFrame, weight: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """doc_id, norm, terms, parts array<int> (the saturated frequency) of each vector that is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, size = flat(b.column("terms"))
            tf, _ = flat(b.column("tfs"))
            m = np.array([50 + 50 * x * n_docs // n_words for x in b.column("n").to_pylist()], np.int64)
            part = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size))
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            square = np.concatenate([[0.0], np.cumsum((weight[t] * part).astype(float) ** 2)])
            norm = np.sqrt(np.maximum(square[at[1:]] - square[at[:-1]], 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(norm), b.column("terms"),
                                              pa.ListArray.from_arrays(pa.array(at), pa.array(part.astype(np.int32)))],
                                             ["doc_id", "norm", "terms", "parts"])

    d = found.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs")
    return d.mapInArrow(run, "doc_id bigint, norm double, terms array<int>, parts array<int>").where("norm > 0")


class Best:
    """The best of each item so far, and what a document must reach."""

    def __init__(self, items: int, k: int, floor: np.ndarray, floor_id: np.ndarray):
        self.k = k
        self.rows: list[tuple] = [(np.empty(0, np.int64),) * 3] * items
        self.score, self.last = floor.copy(), floor_id.copy()

    def offer(self, item: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = (score > self.score[item]) | (score == self.score[item]) & (ids <= self.last[item])
        if not good.any():
            return
        s, i, z = (np.concatenate([a, b[good]]) for a, b in zip(self.rows[item], (score, ids, none)))
        o = np.lexsort((z, i, -s))[:self.k]
        self.rows[item] = s[o], i[o], z[o]
        if len(o) == self.k:     # no lower than before: all in the list reached the threshold
            self.score[item], self.last[item] = s[o[-1]], i[o[-1]]


def search_bucket(items: Items, best: Best, ids: np.ndarray, none: np.ndarray, norm: np.ndarray, term: np.ndarray, value: np.ndarray,
                  size: np.ndarray) -> int:
    """Offer the documents of a bucket to all items; returns for how many items it was not skipped."""
    order = np.argsort(term, kind="stable")
    row = np.repeat(np.arange(len(ids)), size)[order]
    present, at = np.unique(term[order], return_index=True)
    value = value[order]
    most = np.maximum.reduceat(value, at)
    at = np.append(at, len(order))
    place = np.minimum(np.searchsorted(present, items.terms), len(present) - 1)
    there = present[place] == items.terms
    top = np.where(there, most[place], 0)
    count = np.diff(items.at)
    bound = np.minimum(np.add.reduceat(top, items.at[:-1]), np.sqrt(count) * norm.max() * (1 + 1e-9) + 1)
    live = np.flatnonzero(bound >= best.score)
    sums = np.zeros(len(ids), np.int64)
    for item in live.tolist():
        own = slice(items.at[item], items.at[item + 1])
        here = place[own][there[own]]
        here = here[np.argsort(-most[here], kind="stable")]
        left = np.append(np.cumsum(most[here][::-1])[::-1], 0)     # what the coordinates from here on can add
        goal = best.score[item]
        first = int(np.searchsorted(-left[:-1], -goal, "right"))
        sums[:] = 0
        for c in here[:first].tolist():
            sums[row[at[c]:at[c + 1]]] += value[at[c]:at[c + 1]]
        seen = np.flatnonzero(sums)
        s = sums[seen]
        rest = np.minimum(left[first], np.sqrt(len(here) - first) * norm[seen] * (1 + 1e-9) + 1)
        keep = s + rest >= goal
        seen, s = seen[keep], s[keep]
        for i in range(first, len(here)):
            if not len(seen):
                break
            a, b = at[here[i]], at[here[i] + 1]
            p = np.minimum(np.searchsorted(row[a:b], seen) + a, b - 1)
            s = s + np.where(row[p] == seen, value[p], 0)
            keep = s + left[i + 1] >= goal
            seen, s = seen[keep], s[keep]
        if len(seen):
            best.offer(item, s, ids[seen], none[seen])
    return len(live)


KINDS = "item int, item_id bigint, doc_id bigint, score bigint, part int"
OUT = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])


def best_of(found: DataFrame, items: Items, weight: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> DataFrame:
    """The best k rows of each item, from impact vectors: item, item_id, doc_id, score, rank."""
    parts = max(1, -(-found.count() // PART_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k, floor, floor_id)
        for whole in batches:
            for lo in range(0, whole.num_rows, BUCKET):
                b = whole.slice(lo, BUCKET)
                term, size = flat(b.column("terms"))
                value = weight[term] * flat(b.column("parts"))[0]
                none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = np.where(none, LAST, b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                search_bucket(items, best, ids, none, b.column("norm").to_numpy(), term, value, size)
        part = TaskContext.get().partitionId()
        for i, (score, ids, none) in enumerate(best.rows):
            if len(score):
                n = len(score)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, i), pa.int32()), pa.array([items.ids[i]] * n, pa.int64()), pa.array(ids, mask=none.astype(bool)),
                    pa.array(score), pa.array(np.full(n, part), pa.int32())], schema=OUT)

    rows = found.repartitionByRange(parts, F.desc("norm"), F.xxhash64("doc_id", "terms", "parts")).sortWithinPartitions(F.desc("norm")) \
                .mapInArrow(run, KINDS)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", F.floor(F.col("part") / GROUP_PARTS)], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return rows.select("item", "item_id", "doc_id", "score", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0."""
    results = []
    for block in blocks(items, item_col, item_text_col):
        if not block.ids:
            continue
        level = F.least(F.lit(LEVELS), F.floor((64 - F.length(F.bin(F.col("h").bitwiseOR(F.lit(1))))) / STEP)).cast("int").alias("level")
        found = vectors(docs, block.vocab, id_col, text_col).withColumn("h", F.xxhash64("doc_id", F.monotonically_increasing_id()))
        found = materialize(found.select("doc_id", "n", "terms", "tfs", level), "vectors")
        n_docs, n_words = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(block.vocab))
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():     # one row for each term of the block
            df[r[0]] = r[1]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        sizes = dict(found.groupBy("level").count().collect())
        rounds = [j for j in range(LEVELS, 0, -1) if sum(c for v, c in sizes.items() if v >= j) >= SAMPLE_ROWS] + [0]
        floor, floor_id = np.ones(len(block.ids), np.int64), np.full(len(block.ids), LAST)
        for j in rounds:
            got = best_of(impacts(found.where(F.col("level") >= j), weight, n_docs, n_words), block, weight, k, floor, floor_id)
            if j:
                for r in got.where(F.col("rank") == k).collect():    # one row for each item of the block
                    floor[r.item], floor_id[r.item] = r.score, LAST if r.doc_id is None else r.doc_id
        results.append(got.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return functools.reduce(DataFrame.unionByName, results)


def op13_lexical(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_words FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
       FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM tf, total GROUP BY term, n_docs),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
    FROM i JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
