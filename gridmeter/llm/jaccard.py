"""N-gram Jaccard join: count-vector R-trees over documents that can be near each other.

A document's set is its distinct shingles, as 64-bit hashes.  Sets that are equal are
one node.  Two nodes link when their Jaccard similarity reaches the threshold; the
result is the class (connected component) of each document.

1.  Sets whose similarity reaches t differ in at most D elements.  Elements are dealt
    into D + 1 + E parts by a hash, so two linked sets agree in E + 1 parts.  A part's
    signature is a key; empty parts give none, unless a set has over E of them.
    Shingles that a sample shows to be frequent are left out of the parts of all
    sets, which leaves no link out and keeps passages that many documents share from
    making candidates.  Nodes that share a key form stars, and the components of the
    stars hold every possible link.
2.  A component's sets are worked on together: shingles are hashed into groups, the
    counts of a set's groups are a point, and an R-tree is built over the points,
    packed by size and by the groups that vary most.  A node keeps the largest count
    of each group and its range of sizes.  The overlap of a set with anything below a
    node is at most the sum of the coordinate minima; where that is too small for the
    threshold the node is dropped.  Pairs that survive are verified on the sets,
    unless earlier links have joined them already.
3.  Components of up to ``BLOCK`` sets are packed into tasks.  In a larger one passages
    chain sets that are unlike each other, the more of them the more documents there
    are.  It falls into finer components first: of two linked sets each has a shingle
    of the other among its rarest, so many that the rest falls short of the threshold,
    whatever the order is as long as it is one for all.  The order is by how many sets
    of such components have a shingle, counted on ``SLOTS`` places by hash, so what it
    takes does not grow with the input.
4.  What is larger even then is mostly of one class, and is cut into blocks: all its
    sets meet its first ``LEADERS`` sets; then the sets outside of the largest class so
    far meet all sets, block by block.  A link between two others cannot change a
    class.  So a large group of near copies costs time in proportion to its size, and
    no task holds it whole.

D and the number of parts go by bands of sizes, each 1.12 times the one below; a set
has keys in the bands of all sizes that may be linked with its own.

Defined results: null or empty texts have no shingles, link with nothing, and are
their own class; a text with fewer words than ``n`` has its word sequence as one
shingle.  Rows that repeat an id are one document more each, all with the class's
smallest id; a class whose ids are all null has a null ``component_id``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BATCH_CHARS, slices
from .common import materialize, one_row, table
from .components import components

GROUPS, LEAF = 128, 16
BLOCK, LEADERS = 3000, 256
BAND, BUCKET_BYTES = 1.12, 8 << 20
#: the bounded sample that frequent shingles are taken from
SAMPLE, SAMPLE_CHARS, FREQUENT = 3000, 20_000, 4
#: places that the shingles of large components are counted on, and rows that a task hands them on in
SLOTS, SLOT_ROWS = 1 << 22, 256

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(11).integers(0, 2 ** 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U(salt * 0xD1342543DE82EF95 % 2 ** 64)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


_STEP = 1 << 18
_UP, _DOWN = _powers(_BASE, _STEP), _powers(pow(_BASE, -1, 2 ** 64), _STEP)


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of b[s:e] for each word: differences of one running sum, taken step by step."""
    at_s, at_e, carry = np.empty(len(s), np.uint64), np.empty(len(s), np.uint64), _U(0)
    for k, o in enumerate(range(0, len(b), _STEP)):
        part = b[o:o + _STEP]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[part] * _UP[:len(part)])]) * _U(pow(_BASE, k * _STEP, 2 ** 64)) + carry
        for at, x, first in ((at_s, s, 0), (at_e, e, 1)):
            i, j = np.searchsorted(x, o + first), np.searchsorted(x, o + len(part) + first)
            at[i:j] = sums[x[i:j] - o]
        carry = sums[-1]
    high = np.array([pow(_BASE, -k * _STEP, 2 ** 64) for k in range(len(b) // _STEP + 1)], np.uint64)
    return scramble((at_e - at_s) * _DOWN[s % _STEP] * high[s // _STEP])


def shingle_sets(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    raw = np.frombuffer(b"\n".join(x.as_buffer() for x in texts) if len(texts) else b"", np.uint8)
    if not len(raw):
        return [np.empty(0, np.uint64) for _ in range(len(texts))]
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size + 1) - 1  # where each text ends in raw
    b = _LOWER[raw]
    inside = ~_GAP[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = word_hashes(b, s, e)
    first = np.searchsorted(s, np.concatenate([[0], end[:-1] + 1]))
    last = np.searchsorted(s, end)
    h = np.zeros(len(word), np.uint64)
    for k in range(n):
        h[:max(0, len(word) - k)] += scramble(word[k:], 101 + k)
    h = scramble(h, n)
    out = []
    for i, j in zip(first.tolist(), last.tolist()):
        if j - i >= n:
            out.append(np.unique(h[i:j - n + 1]))
        elif j > i:
            short = np.zeros(1, np.uint64)
            for k in range(i, j):
                short += scramble(word[k:k + 1], 101 + k - i)
            out.append(scramble(short, 1000 + j - i))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Threshold:
    """Similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, total):
        """The overlap that sizes adding up to ``total`` need."""
        return -(-self.num * total // (self.num + self.den))

    def band(self, size: int) -> int:
        return int(math.log(size) / math.log(BAND) + 1e-9)

    def differ(self, band: int) -> int:
        """In how many elements two linked sets differ at most, the smaller of this band."""
        least = math.ceil(BAND ** (band + 1)) + 1
        most = least + least * self.den // self.num
        return max(t - 2 * self.need(t) for t in range(max(2, most - 2 * (self.num + self.den)), most + 1))

    def schemes(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, parts that may be empty) under which a set of this size has keys.

        A pair is met in the band of the smaller set, so a set has keys in the
        bands of all sizes that may be linked with its own, up to its own.
        """
        out = []
        for band in range(self.band(max(1, -(-size * self.num // self.den))), self.band(size) + 1):
            d = self.differ(band)
            if d > 0:
                empty = -(-6 * d // 100) + 1
                out.append((band, d + 1 + empty, empty))
        return out


def signature(s: np.ndarray) -> int:
    """64 bits that stand for the set."""
    return int(scramble(scramble(s, 1).sum(dtype=np.uint64, keepdims=True) + _U(len(s)), 2).view(np.int64)[0])


def part_keys(sets: list[np.ndarray], t: Threshold, frequent: np.ndarray) -> list[np.ndarray]:
    """The keys of each set: signatures of its parts, without ``frequent`` (sorted) elements."""
    known: dict[int, list[tuple[int, int, int]]] = {}
    out = []
    for s in sets:
        if not len(s):
            out.append(np.empty(0, np.uint64))
            continue
        if len(s) not in known:
            known[len(s)] = t.schemes(len(s))
        schemes = known[len(s)]
        if len(frequent):
            s = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
        place, sign, keys = scramble(s, 3) >> _U(32), scramble(s, 4), []
        for band, parts, empty in schemes:
            part = (place % _U(parts)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            p = part[o]
            at = np.flatnonzero(np.diff(p, prepend=-1))
            sums = np.zeros(parts, np.uint64)
            if len(at):
                sums[p[at]] = np.add.reduceat(sign[o], at)
            k = scramble(sums + scramble(np.arange(parts, dtype=np.uint64) + _U(band << 32), 5), 6)
            keys.append(k[p[at]] if parts - len(at) <= empty else k)
        out.append(np.concatenate(keys) if keys else np.empty(0, np.uint64))
    return out


class CountTree:
    """An R-tree over count vectors, packed from the leaves up."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.order = self._pack(points, size)
        self.levels = [(points[self.order], size[self.order], size[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            hi, small, large = self.levels[-1]
            at = np.arange(0, len(hi), LEAF)
            self.levels.append((np.maximum.reduceat(hi, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))

    @staticmethod
    def _pack(points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sort-tile: slabs of like size, each sorted by the groups that vary most."""
        o = np.argsort(size, kind="stable")
        wide = np.argsort(-points.var(0))[:3]
        slab = max(LEAF, int(math.sqrt(len(o) / LEAF) + 1) * LEAF)
        return np.concatenate([p[np.lexsort(points[p][:, wide].T)] for p in (o[i:i + slab] for i in range(0, len(o), slab))])

    def near(self, point: np.ndarray, size: int, t: Threshold) -> np.ndarray:
        """Which points may reach the threshold with this one."""
        least, most = -(-t.num * size // t.den), t.den * size // t.num
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, small, large = self.levels[depth]
            at = at[(large[at] >= least) & (small[at] <= most)]
            if len(at):
                bound = np.minimum(hi[at], point).sum(1)
                at = at[bound >= t.need(size + np.maximum(small[at], least))]
            if not len(at):
                return at
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of the groups that a set's shingles are hashed into."""
    flat = np.concatenate(sets)
    group = (scramble(flat, 7) >> _U(40)) % _U(GROUPS)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return np.bincount(row * GROUPS + group.astype(np.int64), minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def classes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, root: list[int], t: Threshold) -> None:
    """Join in ``root`` what links of a set in ``left`` with one in ``right`` connect."""

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    p = points(sets)
    tree = CountTree(p[right], size[right])
    for i in left.tolist():
        for j in right[tree.near(p[i], int(size[i]), t)].tolist():
            a, b = find(i), find(j)
            if a != b and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= t.need(int(size[i] + size[j])):
                root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = find(i)


def scanned(docs: DataFrame, t: Threshold, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node (the signature of its set), seen (hash of the text) of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("seen", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(b.column("text"), n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("seen"), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([signature(s) for s in sets], pa.int64())], schema=out)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("seen", F.xxhash64("text"))
    return d.select("doc_id", "seen", "text").mapInArrow(run, "doc_id bigint, seen bigint, n_shingles bigint, node bigint")


def frequent_shingles(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """Shingles of ``FREQUENT`` documents or more of a sample: the first ``SAMPLE`` different texts by hash, of at most ``SAMPLE_CHARS``.

    Parts are signed without them.  Whatever is left out of both sets of a pair,
    they differ in no more elements than before, so the sample decides how many
    candidates there are and never which links are found.
    """
    d = docs.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    d = d.select(F.xxhash64("text").alias("h"), "text")
    # hashes first, so that only the sample's own texts reach the driver
    last = d.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    some = d.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text")) if last is not None else d.limit(0)
    texts = {r.h: r.text for r in some.collect()}
    sets = [s for k in range(0, len(texts), 200) for s in shingle_sets(pa.array(list(texts.values())[k:k + 200], pa.string()), n)]
    found, count = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
    return found[count >= FREQUENT]


def contracted(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest node that they connect it with (itself left out)."""
    node, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        for k in (0, 1):
            np.minimum.at(new, at[:, k], low)
            np.minimum.at(new, label[at[:, k]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    u = np.flatnonzero(label != np.arange(len(node)))
    return node[u], node[label[u]]


def stars(docs: DataFrame, t: Threshold, n: int, text_col: str) -> DataFrame:
    """(u, v): nodes that share a part, each with the smallest node that its bucket connects it with."""
    frequent = frequent_shingles(docs, n, text_col)
    return meeting(docs.select(F.col(text_col).cast("string").alias("text")), n, lambda b, sets: part_keys(sets, t, frequent))


def meeting(d: DataFrame, n: int, keys_of: Callable[[pa.RecordBatch, list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """(u, v): nodes of rows (text, and what ``keys_of`` reads) that share keys, each with the smallest that its bucket connects it with.

    A task joins the nodes that share a key in its own batch and sends the key
    on with the smallest of them only, so a key that very many sets share costs
    a bucket one entry for each batch.  Keys are dealt into buckets as packed
    arrays, 40 bits of each beside the bucket: keys that agree by chance add
    candidates, nothing else.
    """
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) or 1
    packed = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary()), ("edges", pa.binary())])
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", 4 * BATCH_CHARS)):
            nodes, parts = [], []
            for part in slices(b, "text"):
                sets = shingle_sets(part.column("text"), n)
                nodes += [signature(s) for s in sets]
                parts += keys_of(part, sets)
            key = np.concatenate(parts)
            if not len(key):
                continue
            node = np.repeat(np.array(nodes, np.int64), [len(k) for k in parts])
            o = np.lexsort((node, key))
            key, node = key[o], node[o]
            first = np.diff(key, prepend=key[:1] + _U(1)) != 0
            low = node[np.flatnonzero(first)][np.cumsum(first) - 1]
            edge = np.unique(np.stack([node, low], 1)[node != low], axis=0)
            key, node = key[first], node[first]
            bucket = (key % _U(buckets)).astype(np.int64)
            o = np.lexsort((node, bucket))
            key, node, bucket = key[o], node[o], bucket[o]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            home = (edge[:, 0].astype(np.uint64) % _U(buckets)).astype(np.int64) if len(edge) else np.empty(0, np.int64)
            rows = []
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(key)]):
                k = (key[i:j] // _U(buckets)).view(np.uint8).reshape(-1, 8)[:, :5]
                who, c = np.unique(node[i:j], return_counts=True)
                rows.append((int(bucket[i]), k.tobytes(), who.tobytes(), c.astype(np.uint16).tobytes() if c.max() < 1 << 16 else c.astype(np.uint32).tobytes(), b""))
            rows += [(int(h), b"", b"", b"", edge[home == h].tobytes()) for h in np.unique(home)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), packed)], schema=packed)

    def meet(rows: pa.Table) -> pa.Table:
        keys, nodes, edges = [], [], [np.empty((0, 2), np.int64)]
        for k, who, c, e in zip(*(rows[x].to_pylist() for x in ("keys", "nodes", "counts", "edges"))):
            who = np.frombuffer(who, np.int64)
            wide = np.zeros((len(k) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
            keys.append(wide.view(np.uint64).ravel())
            nodes.append(np.repeat(who, np.frombuffer(c, np.uint16 if len(c) == 2 * len(who) else np.uint32)))
            edges.append(np.frombuffer(e, np.int64).reshape(-1, 2))
        key, node = np.concatenate(keys), np.concatenate(nodes)
        o = np.lexsort((node, key))
        key, node = key[o], node[o]
        first = np.diff(key, prepend=key[:1] + _U(1)) != 0
        low = node[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else node
        edges.append(np.stack([node, low], 1)[node != low])
        u, v = contracted(np.concatenate(edges))
        return pa.table([pa.array(u), pa.array(v)], schema=out)

    rows = d.mapInArrow(pack, "bucket bigint, keys binary, nodes binary, counts binary, edges binary")
    return rows.groupBy("bucket").applyInArrow(meet, "u bigint, v bigint")


def slots(s: np.ndarray) -> np.ndarray:
    return (scramble(s, 8) % _U(SLOTS)).astype(np.int64)


def shingle_counts(d: DataFrame, n: int) -> np.ndarray:
    """How many rows of ``text`` have a shingle that falls on each place (65,535 at most)."""
    out = pa.schema([("part", pa.int64()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(SLOTS, np.uint32)
        for b in (part for whole in batches for part in slices(whole, "text")):
            at, many = np.unique(slots(np.concatenate(shingle_sets(b.column("text"), n))), return_counts=True)
            c[at] += many.astype(np.uint32)
        c = c.reshape(SLOT_ROWS, -1)
        has = np.flatnonzero(c.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array([c[i].tobytes() for i in has], pa.binary())], schema=out)

    def add(rows: pa.Table) -> pa.Table:
        c = np.zeros(SLOTS // SLOT_ROWS, np.uint64)
        for x in rows["counts"]:
            c += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table([rows["part"].slice(0, 1).combine_chunks(), pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes()], pa.binary())], schema=out)

    got = np.zeros((SLOT_ROWS, SLOTS // SLOT_ROWS), np.uint16)
    for r in d.select("text").mapInArrow(count, "part bigint, counts binary").groupBy("part").applyInArrow(add, "part bigint, counts binary").collect():
        got[r.part] = np.frombuffer(r.counts, np.uint16)
    return got.ravel()


def rare_keys(sets: list[np.ndarray], t: Threshold, counts: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """The rarest shingles of each set, as keys of its component; linked sets share one.

    The overlap of linked sets is at least the threshold's part of either, so what
    comes first in an order of all shingles, one more than may be missing, holds the
    first that they share.  A place that was counted once meets nothing.
    """
    out = []
    for s, own in zip(sets, scramble(label.view(np.uint64), 9)):
        seen = counts[slots(s)]
        o = np.lexsort((s, seen))[:len(s) - -(-t.num * len(s) // t.den) + 1]
        out.append(scramble(s[o[seen[o] > 1]] ^ own, 10))
    return out


def finer(large: DataFrame, t: Threshold, n: int) -> DataFrame:
    """(node, label, count) of the sets of large components (label, node, text) that may be linked, by the rarest shingles."""
    counts = shingle_counts(large, n)
    got = components(meeting(large.select("label", "text"), n, lambda b, sets: rare_keys(sets, t, counts, b.column("label").to_numpy())))
    return got.join(got.groupBy("label").count(), "label").select("node", "label", "count")


def linked(rows: DataFrame, t: Threshold, n: int) -> DataFrame:
    """(node, root) from rows (unit, side, part, node, text).

    ``part`` keeps apart what a unit holds; side 1 meets everything, side 0 only side 1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "node", "side"], ascending=[True, True, False]).drop_duplicates(["part", "node"])
        whole = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], ["text"])
        sets = [s for part in slices(whole, "text") for s in shingle_sets(part.column(0), n)]
        root = list(range(len(sets)))
        part, side = pdf["part"].to_numpy(), pdf["side"].to_numpy()
        edge = np.flatnonzero(np.diff(part, prepend=part[0] - 1, append=part[-1] + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = list(range(b - a))
            classes(sets[a:b], np.flatnonzero(side[a:b] == 1), np.arange(b - a), own, t)
            root[a:b] = [a + r for r in own]
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"part": part, "node": node, "root": node[root]})

    return rows.groupBy("unit").applyInPandas(run, "part bigint, node bigint, root bigint")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = class_rows(docs, id_col, text_col, n, num, den)
    least = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(least, "node").select("doc_id", "n_shingles", F.col("least").alias("component_id")).union(alone)


def class_rows(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """doc_id, seen (hash of the text), n_shingles, node (the same for all rows of a class that have shingles), written."""
    t = Threshold(num, den)
    scan = materialize(scanned(docs, t, n, id_col, text_col), "shingles")
    may = materialize(components(stars(docs, t, n, text_col)), "candidates")  # node, label: what may be linked
    many = may.groupBy("label").count()
    # one row of documents stands for each node
    stand = scan.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "seen")).alias("s"))
    stand = stand.join(may, "node").join(many, "label").select("label", "node", "count", F.col("s.doc_id").alias("_id"), F.col("s.seen").alias("_seen"))
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.join(stand, d["doc_id"].eqNullSafe(stand["_id"]) & (F.xxhash64(d["text"]) == stand["_seen"]))
    d = materialize(d.select("label", "node", "count", "text"), "candidate-texts")
    total = may.count()
    small, large = (d.where(c) for c in (F.col("count") <= BLOCK, F.col("count") > BLOCK))
    if not large.isEmpty():
        large = materialize(large.select("node", "text").join(finer(large, t, n), "node").select(*d.columns), "finer")
        small = small.union(large.where(F.col("count") <= BLOCK))
        large = large.where(F.col("count") > BLOCK)
    else:
        large = None
    # small components, packed into units of about BLOCK sets
    units = max(1, -(-total // BLOCK))
    small = small.select(F.pmod(F.xxhash64("label"), F.lit(units)).alias("unit"), F.lit(1).alias("side"), F.col("label").alias("part"), "node", "text")
    done = linked(small, t, n).select("node", "root")
    if large is not None and not large.isEmpty():
        done = done.unionByName(large_classes(large, t, n))
    done = materialize(done.distinct(), "classes")
    ids = scan.join(done, "node", "left").select("doc_id", "seen", "n_shingles", F.coalesce("root", "node").alias("node"))
    return materialize(ids, "nodes")


def large_classes(large: DataFrame, t: Threshold, n: int) -> DataFrame:
    """(node, root) of components above BLOCK sets: rows (label, node, count, text)."""
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    d = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the first LEADERS sets of a component by node; counted block by block first, so that no task ranks a whole component
    from pyspark.sql import Window
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("node"))
    lead = d.select("label", "block", "node").withColumn("r", rank("label", "block")).where(F.col("r") <= LEADERS)
    lead = lead.withColumn("r", rank("label")).where(F.col("r") <= LEADERS).select("label", "node")
    unit = lambda *c: F.xxhash64(*c)
    side0 = d.select("label", "block", F.lit(0).alias("side"), "node", "text")
    side1 = (d.join(lead, ["label", "node"], "left_semi")
              .select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "node", "text"))
    first = materialize(linked(side0.union(side1).select(unit("label", "block").alias("unit"), "side", F.col("label").alias("part"), "node", "text"), t, n), "first-links")
    lab = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")))
    lab = materialize(large.select("label", "node").join(lab.withColumnRenamed("label", "root"), "node", "left")
                      .select("label", "node", F.coalesce("root", "node").alias("root")), "first-classes")
    size = lab.groupBy("label", "root").count()
    core = size.groupBy("label").agg(F.max(F.struct("count", "root"))["root"].alias("core"))
    rest = lab.join(core, "label").where("root <> core").select("label", "node")
    count = rest.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("strips"))
    out = d.join(rest, ["label", "node"], "left_semi").join(count, "label").withColumn("strip", F.pmod(F.xxhash64("node"), F.col("strips")).cast("int"))
    side1 = out.select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "strip", F.lit(1).alias("side"), "node", "text")
    side0 = d.join(count, "label").select("label", "block", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"), F.lit(0).alias("side"), "node", "text")
    second = linked(side0.union(side1).select(unit("label", "block", "strip").alias("unit"), "side", F.col("label").alias("part"), "node", "text"), t, n)
    edges = second.select(F.col("node").alias("u"), F.col("root").alias("v")).union(lab.select(F.col("node").alias("u"), F.col("root").alias("v")))
    final = components(materialize(edges.where("u <> v").distinct(), "links"))
    return large.select("node").join(final, "node", "left").select("node", F.coalesce("label", "node").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each class; all columns as they were.

    The row of the smallest id stays (null last, then by a hash of the text); rows
    are told apart by id and text, and of rows equal in both one stays.
    """
    rows = class_rows(docs, id_col, text_col, n, num, den).where("n_shingles > 0")
    mine = F.struct(F.col("doc_id").isNull(), "doc_id", "seen")
    first = rows.groupBy("node").agg(F.min(mine).alias("_first"))
    gone = rows.join(first, "node").where(mine != F.col("_first")).select(F.col("doc_id").alias("_id"), F.col("seen").alias("_seen")).distinct()
    twice = rows.groupBy("doc_id", "seen").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("seen").alias("_seen"))
    twice = materialize(twice.join(gone, twice["_id"].eqNullSafe(gone["_id"]) & (twice["_seen"] == gone["_seen"]), "left_anti"), "repeated")
    same = lambda x: docs[id_col].cast("bigint").eqNullSafe(x["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == x["_seen"])
    left = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, same(twice), "left_anti").union(one_row(docs.join(twice, same(twice), "left_semi"), F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))))


def op10_jaccard(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))
