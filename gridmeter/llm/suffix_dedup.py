"""Suffix-array dedup: bytes under a string of ``length`` bytes that also starts in a
document with a smaller id are removed.

The Burrows-Wheeler transform and the common prefixes of a collection are built
column by column (``CollectionBwt``): each round inserts one more symbol of every
string, from its end to its start, into the transform, and the common prefixes
around it, reading the files of the round before and writing new ones in order.
Windows that share ``length`` bytes are then neighbours without a shorter common
prefix between them.

A document may be long and rounds go with the longest string, so the collection is
not the documents but short pieces that together hold every window once, dealt so
that equal windows meet: a window goes where the smallest hash of its 24-byte
strings sends it (its minimizer), and windows in a row with the same one form a
piece of at most 76 bytes.  Shorter strings recur by chance, in ever more of the
pieces as the input grows.

1.  Documents are dealt into blocks of about ``BLOCK_BYTES``.  A block tells each
    bucket of minimizers which it has, and gets back which are in two documents or
    more.  Only pieces of those can hold a repeat.
2.  A block sends its distinct pieces of those with the smallest id of the block
    that has them.  A bucket builds the transform of all and answers with the
    smallest id for each window.  A minimizer with over ``HOT`` distinct pieces
    (a very frequent string in ever other surroundings) is not dealt whole: its
    windows are pieces of their own, dealt by all their bytes.
3.  A block removes what starts in a smaller id elsewhere.

Blocks and buckets both grow with the input, so what goes between them is handed over
by groups of buckets: one row, compressed as a whole, for each block and group.  A
group's buckets are worked on one after the other.

Copies meet inside a block before anything moves, so a passage of a third of all
documents is one piece for each block, and no key gathers more than ``HOT`` pieces
or one for each block.

Defined results: matches never cross documents; overlaps count; strings are judged
on the input.  A null text counts as empty.  Rows that repeat an id are one document
to each other: they remove nothing from one another.  A null id comes after all
others, and two null ids remove nothing from one another.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

LENGTH, MINIMIZER = 50, 24
BLOCK_BYTES, BUCKET_BYTES, SLICE = 12 << 20, 4 << 20, 1 << 17
HOT = 100_000
#: a group is one bucket up to so many buckets, then several, so that there are about so many groups; and at most how many
GROUPS, GROUP_MOST = 256, 8

_U = np.uint64
_LAST = np.iinfo(np.int64).max
_RANDOM = np.random.default_rng(17).integers(0, 2 ** 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(33))


def _powers(base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, as many as a slice needs."""
    out = np.full(2 * SLICE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _BACK = _powers(_BASE), _powers(pow(_BASE, -1, 2 ** 64))


def prefixes(b: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers up to each place of at most ``2 * SLICE`` bytes.

    The difference of two, times the power that takes the first place back to 0, is a hash of the bytes between.
    """
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_RANDOM[b] * _POWER[:len(b)], dtype=np.uint64, out=out[1:])
    return out


def rolling(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on (the last places have none)."""
    n = len(b) - size + 1
    out = np.empty(max(0, n), np.uint64)
    for a in range(0, n, SLICE):
        p = prefixes(b[a:min(a + SLICE, n) + size - 1])
        out[a:a + SLICE] = _mix((p[size:] - p[:-size]) * _BACK[:len(p) - size])
    return out


def hashes_at(b: np.ndarray, at: np.ndarray, size: np.ndarray | int, stride: int) -> np.ndarray:
    """The hashes of the ``size`` bytes from each place in ``at`` (ascending) on, slice by slice."""
    out, size = np.empty(len(at), np.uint64), np.broadcast_to(size, len(at))
    stride = min(stride, SLICE)
    for a in range(0, len(b), stride):
        i, j = np.searchsorted(at, (a, a + stride))
        if i < j:
            here, n = at[i:j] - a, size[i:j]
            p = prefixes(b[a:a + int((here + n).max())])
            out[i:j] = _mix((p[here + n] - p[here]) * _BACK[here])
    return out


class Block:
    """The texts of one block, one after the other, in the order of their ids."""

    def __init__(self, t: pa.Table):
        ids = pc.fill_null(t["doc_id"], _LAST).to_numpy()
        texts = pc.fill_null(t["text"], "").cast(pa.large_binary()).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
        digest = [zlib.crc32(raw[a - off[0]:b - off[0]]) for a, b in zip(off[:-1], off[1:])]
        self.rows = np.lexsort((digest, size, ids))
        self.ids, self.size = ids[self.rows], size[self.rows]
        start = (off[:-1] - off[0])[self.rows]
        self.bytes = np.concatenate([raw[a:a + n] for a, n in zip(start, self.size)]) if len(raw) else raw
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def windows(self, length: int, m: int, stride: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, start and number of windows of each piece."""
        wide = length - m + 1
        keys, starts, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, max(0, len(self.bytes) - length + 1), stride):
            b = self.bytes[a:a + stride + length - 1]
            h = rolling(b, m)
            place = np.arange(len(h), dtype=np.uint64)
            x, n = (h & ~_U((1 << 20) - 1)) | place, 1
            while n * 2 <= wide:
                x = np.minimum(x[:-n], x[n:])
                n *= 2
            if n < wide:
                x = np.minimum(x[:len(x) - (wide - n)], x[wide - n:])
            best = (x & _U((1 << 20) - 1)).astype(np.int64)
            start = np.arange(len(best))
            # a window belongs to the document that it starts in, if it ends there
            edge = self.at[np.searchsorted(self.at, a + 1):np.searchsorted(self.at, a + len(b))] - a
            fits = np.ones(len(best) + 1, np.int64)
            for e in edge:
                fits[max(0, e - length + 1):e] = 0
            new = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(fits[:-1], prepend=0) != 0))
            new = np.append(new, len(best))
            n_of, first = np.diff(new), new[:-1]
            ok = fits[first] == 1
            keys.append(h[best[first[ok]]])
            starts.append(first[ok] + a)
            counts.append(n_of[ok])
        return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)

    def doc(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, start, "right") - 1


class Pieces:
    """The distinct pieces of a block whose minimizers are shared, by group of buckets and bucket."""

    def __init__(self, block: Block, length: int, m: int, buckets: int, stride: int = SLICE):
        self.block, self.length, self.m, self.buckets, self.group = block, length, m, buckets, group_of(buckets)
        self.key, self.start, self.count = block.windows(length, m, stride)
        # a piece is known by the hash of its bytes, and how many they are
        self.hash = lambda at, size: hashes_at(block.bytes, at, size, stride)
        self.same = _mix(self.hash(self.start, self.count + length - 1) + self.count.astype(np.uint64) * _U(3))

    def told(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """group, keys, whether in two documents, distinct pieces (up to 65535) of this block."""
        o = np.lexsort((self.same, self.key))
        k, doc, same = self.key[o], self.block.ids[self.block.doc(self.start[o])], self.same[o]
        at = np.flatnonzero(np.diff(k, prepend=k[:1] + _U(1)) != 0) if len(k) else np.empty(0, np.int64)
        if not len(at):
            return
        two = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        other = np.add.reduceat((np.diff(same, prepend=same[:1] + _U(1)) != 0).astype(np.int64), at)
        k = k[at]
        for i, rows in grouped(self.bucket(k) // self.group):
            yield i, k[rows].tobytes(), two[rows].astype(np.uint8).tobytes(), np.minimum(other[rows], 65535).astype(np.uint16).tobytes()

    def bucket(self, k: np.ndarray) -> np.ndarray:
        return ((k >> _U(8)) % _U(self.buckets)).astype(np.int64)

    def chosen(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the pieces of shared minimizers (sorted keys); cut those of hot ones into windows."""
        state = is_in(self.key, shared), is_in(self.key, hot)
        whole = np.flatnonzero(state[0] & ~state[1])
        cut = np.flatnonzero(state[1])
        n = self.count[cut]
        single = np.repeat(self.start[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start_of = np.concatenate([self.start[whole], single])
        self.count_of = np.concatenate([self.count[whole], np.ones(len(single), np.int64)])
        own = self.hash(single, self.length)
        key = np.concatenate([self.key[whole], own])
        same = np.concatenate([self.same[whole], _mix(own + _U(5))])
        bucket = self.bucket(key)
        o = np.lexsort((self.start_of, same, bucket))
        new = (np.diff(bucket[o], prepend=-1) != 0) | (np.diff(same[o], prepend=same[o][:1] + _U(1)) != 0)
        self.order, self.first = o, np.flatnonzero(new)
        self.bucket_of = bucket[o][self.first] if len(o) else np.empty(0, np.int64)

    def sent(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """group, lengths, smallest ids, texts of the distinct pieces, whether several documents have them, how many each bucket has."""
        if not len(self.order):
            return
        start, size = self.start_of[self.order], self.count_of[self.order] + self.length - 1
        ids = self.block.ids[self.block.doc(start)]
        least = np.minimum.reduceat(ids, self.first)
        several = (least != np.maximum.reduceat(ids, self.first)).astype(np.uint8)
        start, size = start[self.first], size[self.first]
        for i, rows in grouped(self.bucket_of // self.group):
            many = np.bincount(self.bucket_of[rows] - i * self.group, minlength=self.group).astype(np.int64)
            n = size[rows]
            take = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield i, n.astype(np.uint8).tobytes(), zlib.compress(least[rows].tobytes(), 1), zlib.compress(self.block.bytes[take].tobytes(), 3), several[rows].tobytes(), many.tobytes()

    def layout(self) -> bytes:
        """Where the chosen pieces lie, for :func:`cover`: starts, windows, which begin a distinct piece, groups of those."""
        new = np.zeros(len(self.order), np.uint8)
        new[self.first] = 1
        return zlib.compress(b"".join([np.int64(len(self.order)).tobytes(), self.start_of[self.order].astype(np.int64).tobytes(),
                                       self.count_of[self.order].astype(np.uint8).tobytes(), new.tobytes(),
                                       (self.bucket_of // self.group).astype(np.int64).tobytes()]), 1)


def cover(block: Block, layout: bytes, answers: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Which bytes of a block go, from the smallest id of each window of each chosen piece, by group."""
    raw = zlib.decompress(layout)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    gone = np.zeros(len(block.bytes) + 1, np.int64)
    if n:
        start = np.frombuffer(raw, np.int64, n, 8)
        count = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
        new = np.frombuffer(raw, np.uint8, n, 8 + 9 * n)
        first, piece = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.concatenate([answers[i] for i, _ in grouped(np.frombuffer(raw, np.int64, len(first), 8 + 10 * n))])
        at = (np.cumsum(count[first]) - count[first])[piece]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = least[np.repeat(at, count) + inside] < np.repeat(block.ids[block.doc(start)], count)
        place = (np.repeat(start, count) + inside)[hit]
        gone += np.bincount(place, minlength=len(gone)) - np.bincount(place + length, minlength=len(gone))
    return np.cumsum(gone)[:-1] > 0


def group_of(buckets: int) -> int:
    """How many buckets a group has."""
    return min(GROUP_MOST, -(-buckets // GROUPS))


def grouped(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of an array and where it is, by value."""
    o = np.argsort(of, kind="stable")
    at = np.flatnonzero(np.diff(of[o], prepend=-1) != 0)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(o)]):
        yield int(of[o[a]]), o[a:b]


def is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


class CollectionBwt:
    """The transform and common prefixes of a collection of strings, built column by column.

    Rows of ``text`` hold the strings flush right.  Strings end in terminators of
    their own, smaller than any symbol; symbol 0 of the transform stands before a
    string's start.  A round's file holds a byte of each for every suffix (the symbols
    before them, then the prefixes that they share with the ones above); it is read
    and the next one written in order.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, folder: str):
        self.text, self.size, self.n = text, size, len(text)
        self.name = os.path.join(folder, "round")
        self._put(0, text[:, -1], np.zeros(self.n, np.uint8))
        # places of the transform by symbol (0 left out), each symbol's ascending, and where a symbol's begin
        self.by = np.argsort(text[:, -1], kind="stable").astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text[:, -1], minlength=256))])
        # what the last round put in, in the order of ``by``: string, place, index in ``by``
        self.new = self.by.astype(np.int64), self.by.astype(np.int64), np.arange(self.n)
        self.rounds = int(size.max())
        for j in range(1, self.rounds + 1):
            self._insert(j)

    def _put(self, j: int, symbol: np.ndarray, lcp: np.ndarray) -> None:
        with open(f"{self.name}.{j}", "wb") as f:
            np.ascontiguousarray(symbol).tofile(f)
            lcp.tofile(f)

    def _get(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.fromfile(f"{self.name}.{j}", np.uint8)
        return both[:len(both) // 2], both[len(both) // 2:]

    def _insert(self, j: int) -> None:
        """Put the suffixes of j symbols in: their symbols before, and the prefixes around them."""
        before, lcp = self._get(j - 1)
        own, r, i = self.new
        by, c = self.by, before[r].astype(np.int64)
        q = self.n + i  # ascending places in the new array
        symbol = np.where(self.size[own] > j, self.text[own, -j - 1 if j < self.text.shape[1] else 0], 0).astype(np.uint8)
        has, more = i > self.begin[c], i + 1 < self.begin[c + 1]
        up = np.zeros(len(r), np.uint8)
        up[has] = least(lcp, by[i[has] - 1] + 1, r[has] + 1) + 1
        down = least(lcp, r[more] + 1, by[i[more] + 1] + 1) + 1
        old = np.ones(len(lcp) + len(q), bool)
        old[q] = False
        symbols, shared = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        symbols[old], shared[old] = before, lcp
        symbols[q], shared[q] = symbol, up
        shared[q[more] + 1] = down
        self._put(j, symbols, shared)
        os.remove(f"{self.name}.{j - 1}")
        moved = np.flatnonzero(old)
        # the old places move, and the new ones come in among those of their symbol
        by = moved[by].astype(np.int32)
        o = np.argsort(symbol, kind="stable")
        o = o[np.count_nonzero(symbol == 0):]
        own, q, symbol = own[o], q[o], symbol[o]
        count = np.bincount(symbol, minlength=256)
        at, before = np.empty(len(q), np.int64), 0
        for s in np.flatnonzero(count).tolist():
            part = slice(before, before + count[s])
            at[part] = self.begin[s] + np.searchsorted(by[self.begin[s]:self.begin[s + 1]], q[part])
            before += count[s]
        at += np.arange(len(q))
        keep = np.ones(len(by) + len(q), bool)
        keep[at] = False
        self.by = np.empty(len(keep), np.int32)
        self.by[keep], self.by[at] = by, q
        self.begin[1:] += np.cumsum(count)
        self.new = own, q, at

    def least_of_windows(self, value: np.ndarray, length: int) -> np.ndarray:
        """For each window of each string in order, the least value of a string with the same window."""
        lcp = self._get(self.rounds)[1]
        to = np.zeros(len(lcp), np.int32)  # from a suffix to the one that is a symbol longer
        to[self.by] = np.arange(self.n, self.n + len(self.by), dtype=np.int32)
        group = np.cumsum(lcp < length)
        place, alive = np.arange(self.n), np.arange(self.n)
        windows = self.size - length + 1
        at = np.cumsum(windows) - windows
        where = np.empty(int(windows.sum()), np.int64)
        for j in range(1, self.rounds + 1):
            alive = alive[self.size[alive] >= j]
            place[alive] = to[place[alive]]
            if j >= length:
                where[at[alive] + self.size[alive] - j] = group[place[alive]]
        v = np.repeat(value, windows)
        o = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.diff(where[o], prepend=-1) != 0)
        low = np.minimum.reduceat(v[o], first)
        out = np.empty(len(v), np.int64)
        out[o] = np.repeat(low, np.diff(np.append(first, len(o))))
        return out


def least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a:b] for each a < b."""
    if not len(a):
        return np.empty(0, x.dtype)
    o = np.argsort(a, kind="stable")
    both = np.stack([a[o], b[o]], 1).ravel()
    out = np.empty(len(a), x.dtype)
    if both.max() == len(x):      # reduceat takes no end beyond the last entry
        x = np.append(x, x.dtype.type(0))
    out[o] = np.minimum.reduceat(x, both)[::2]
    return out


def answer(rows: list[tuple[bytes, bytes, bytes, bytes]], length: int) -> list[np.ndarray]:
    """For each block's pieces (lengths, ids, texts, several; ids and texts compressed), the smallest id of each window."""
    return solved([unpacked(*r) for r in rows], length)


def unpacked(size: bytes, ids: bytes, texts: bytes, several: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(size, np.uint8).astype(np.int64), np.frombuffer(zlib.decompress(ids), np.int64),
            np.frombuffer(zlib.decompress(texts), np.uint8), np.frombuffer(several, np.uint8))


def answered(rows: list[tuple[bytes, bytes, bytes, bytes, bytes]], length: int) -> list[bytes]:
    """The same for rows of a group of buckets, each bucket for itself; compressed."""
    parts = [unpacked(*r[:4]) for r in rows]
    many = np.stack([np.frombuffer(r[4], np.int64) for r in rows])
    end = np.cumsum(many, 1)
    place = [np.concatenate([[0], np.cumsum(p[0])]) for p in parts]
    out: list[list[np.ndarray]] = [[] for _ in rows]
    for k in np.flatnonzero(many.sum(0)).tolist():
        has = np.flatnonzero(many[:, k]).tolist()
        own = []
        for i in has:
            a, b = int(end[i, k] - many[i, k]), int(end[i, k])
            size, ids, flat, several = parts[i]
            own.append((size[a:b], ids[a:b], flat[place[i][a]:place[i][b]], several[a:b]))
        for i, x in zip(has, solved(own, length)):
            out[i].append(x)
    return [zlib.compress(b"".join(x.tobytes() for x in got), 1) for got in out]


def solved(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each block's pieces (lengths, ids, texts, several) of one bucket, the smallest id of each window.

    A piece that one document has, and none of whose windows has the hash of
    another piece's, repeats nothing; the others make up the collection.  Windows
    at a piece's ends that no other piece has are repeated as the piece is, and so
    are all of a piece that has no such window: its last window stands in a
    collection of such; of the others the run from the first to the last shared
    window stands in another.
    """
    size = [r[0] for r in rows]
    n, ids, flat, several = (np.concatenate([r[k] for r in rows]) for k in range(4))
    flat = np.where(flat == 0, np.uint8(255), flat)  # 255 is in no UTF-8 text, and 0 means something here
    wide = int(n.max())
    text = np.zeros((len(n), wide), np.uint8)
    text[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(wide - n, n)] = flat
    _, first, of = np.unique(np.ascontiguousarray(text).view(f"V{wide}").ravel(), return_index=True, return_inverse=True)
    low = np.full(len(first), _LAST)
    np.minimum.at(low, of, ids)
    text, size_of = text[first], n[first]
    windows = size_of - length + 1
    begin = np.cumsum(windows) - windows
    got = np.repeat(low, windows)
    row, twice = meeting(text, size_of, length)
    inner = np.arange(len(row)) - begin[row]
    run_from, run_to = np.full(len(first), wide, np.int64), np.full(len(first), -1, np.int64)
    np.minimum.at(run_from, row[twice], inner[twice])
    np.maximum.at(run_to, row[twice], inner[twice])
    met = run_to >= 0
    alike = np.flatnonzero(~met & ((np.bincount(of) > 1) | (np.bincount(of, several) > 0)))
    if len(alike):
        least_ = transformed(np.ascontiguousarray(text[alike, wide - length:]), np.full(len(alike), length), low[alike], length)
        got[spread(begin[alike], windows[alike])] = np.repeat(least_, windows[alike])
    met = np.flatnonzero(met)
    if len(met):
        run_from, run_to = run_from[met], run_to[met]
        held = run_to - run_from + length
        columns = np.arange(wide) - (size_of[met] - run_to - length)[:, None]     # the run flush right
        strings = np.take_along_axis(text[met], np.maximum(columns, 0), 1)[:, wide - int(held.max()):]
        got[spread(begin[met] + run_from, held - length + 1)] = transformed(np.ascontiguousarray(strings), held, low[met], length)
    w = n - length + 1
    all_ = got[np.repeat(begin[of], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)]
    return np.split(all_, np.cumsum([int((s - length + 1).sum()) for s in size])[:-1])


def transformed(text: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    with tempfile.TemporaryDirectory() as folder:
        return CollectionBwt(text, size, folder).least_of_windows(low, length)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``n`` numbers."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def meeting(text: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The string of each window (strings are rows, flush right), and whether another window has its hash too."""
    h = rolling(text.ravel(), length) if text.size >= length else np.empty(0, np.uint64)
    windows = size - length + 1
    row = np.repeat(np.arange(len(text)), windows)
    start = row * text.shape[1] + text.shape[1] - np.repeat(size, windows) + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    h = h[start]
    o = np.argsort(h)
    same = np.diff(h[o]) == 0
    twice = np.zeros(len(h), bool)
    twice[o[1:][same]] = twice[o[:-1][same]] = True
    return row, twice


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, m: int = MINIMIZER,
            hot: int = HOT, stride: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = -(-total // BLOCK_BYTES) or 1, -(-total // BUCKET_BYTES) or 1
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(blocks)))

    def pieces(t: pa.Table) -> Pieces:
        return Pieces(Block(t), length, m, buckets, stride)

    def tell(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        rows = list(pieces(t).told())
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()),
                         **{c: pa.array([r[k] for r in rows], pa.binary()) for k, c in ((1, "keys"), (2, "two"), (3, "other"))}})

    def compare(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        k = np.concatenate(keys)
        two, other = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("two", np.uint8), ("other", np.uint16)))
        o = np.argsort(k, kind="stable")
        at = np.flatnonzero(np.diff(k[o], prepend=k[o][:1] + _U(1)) != 0)
        many = np.diff(np.append(at, len(o)))
        shared = (many > 1) | (np.maximum.reduceat(two[o], at) > 0)
        state = np.where(shared, np.where(np.add.reduceat(other[o], at, dtype=np.int64) > hot, 2, 1), 0)
        back = np.empty(len(k), np.uint8)
        back[o] = np.repeat(state, many)
        parts = np.split(back, np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"block": t["block"].cast(pa.int64()),
                         "shared": pa.array([x[s == 1].tobytes() for x, s in zip(keys, parts)], pa.binary()),
                         "hot": pa.array([x[s == 2].tobytes() for x, s in zip(keys, parts)], pa.binary())})

    def chosen(t: pa.Table, s: pa.Table) -> Pieces:
        p = pieces(t)
        p.chosen(*(np.sort(np.frombuffer(b"".join(s[c].to_pylist()), np.uint64)) for c in ("shared", "hot")))
        return p

    def send(t: pa.Table, s: pa.Table) -> pa.Table:
        p = chosen(t, s) if t.num_rows else None
        rows = list(p.sent()) if p else []
        block = t["block"][0].as_py() if t.num_rows else 0
        if p:      # a group of its own, which ``transform`` hands on to the block
            rows.append((-1 - block, b"", b"", p.layout(), b"", b""))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()),
                         **{c: pa.array([r[k] for r in rows], pa.binary()) for k, c in ((1, "sizes"), (2, "ids"), (3, "texts"), (4, "several"), (5, "many"))}})

    def transform(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return pa.table({"block": t["block"].cast(pa.int64()), "bucket": t["bucket"].cast(pa.int64()), "told": t["texts"].cast(pa.binary())})
        got = answered(list(zip(*(t[c].to_pylist() for c in ("sizes", "ids", "texts", "several", "many")))), length)
        return pa.table({"block": t["block"].cast(pa.int64()), "bucket": t["bucket"].cast(pa.int64()),
                         "told": pa.array(got, pa.binary())})

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def cut(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        b = Block(t)
        told = dict(zip(s["bucket"].to_pylist(), s["told"].to_pylist()))
        layout = told.pop(-1 - t["block"][0].as_py())
        gone = cover(b, layout, {i: np.frombuffer(zlib.decompress(x), np.int64) for i, x in told.items()}, length)
        kept, spans, less = [], [], []
        for a, e in zip(b.at[:-1], b.at[1:]):
            g = gone[a:e]
            kept.append(b.bytes[a:e][~g].tobytes())
            less.append(int(g.sum()))
            spans.append(int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)))
        return pa.table([pa.array(b.ids, mask=b.ids == _LAST), pa.array(b.size), pa.array(less, pa.int64()), pa.array(spans, pa.int64()),
                         pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], schema=out)

    told = d.groupBy("block").applyInArrow(tell, "bucket bigint, block bigint, keys binary, two binary, other binary")
    shared = told.groupBy("bucket").applyInArrow(compare, "block bigint, shared binary, hot binary")
    shared = materialize(shared, "shared-keys")
    sent = d.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, "bucket bigint, block bigint, sizes binary, ids binary, texts binary, several binary, many binary")
    answers = sent.groupBy("bucket").applyInArrow(transform, "block bigint, bucket bigint, told binary")
    return d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def op1_suffix_dedup(spark, sf_dir):
    return removed(table(spark, sf_dir, "documents")).drop("kept")
