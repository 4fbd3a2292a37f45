"""Harmonic packing: token ids into sequences of a fixed capacity C.

A remaining length r belongs to class k if k of its like fill a sequence but for ``slack``
tokens at most, that is C - k*r <= slack.  Documents may be cut: whole capacities go first,
each a sequence of its own; a rest that is of no class gives up a head of C // k tokens for
the smallest k that it reaches, and what is left is looked at again.  Each step leaves less
than a k-th of the rest, so a document has few pieces (the sums of reciprocals are the greedy
ones).  With a slack of at least the root of C every length below it is of a class as it is.

Every worker (a partition) fills the sequences of each class by itself, one open sequence a
class, k pieces each, in one pass without a shuffle.  A full sequence wants at most ``slack``
tokens, whatever the data.  What is left open is bounded for a worker by the number of
classes (at most 2 * root of C), not by its rows; the open sequences of ``FAN_IN`` workers
are then filled together by the same rule, level by level, until one worker is left.  Its open
sequences, a bounded number, are closed without padding: their pieces follow each other, cut
at capacities, and the tail is cut into powers of two.

Ids are held as little-endian 32-bit integers in a binary column: a row of thousands of ids
is then moved and written as one value.

Each level is a written table below ``spark.checkpoint.dir``, so a lost executor costs its
tasks of one level only.

Defined results: a null text counts as empty; with an end id every row has a token, without
one a row that has none has no piece, nor has one with null ids; null and repeated ``doc_id`` pass through, each row
being a document of its own; an empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _OTHER, _WORDS, byte_letters, default_path, slices
from .common import materialize, table

CAPACITY = 4096
#: workers whose open sequences one task of the next level takes
FAN_IN = 8
#: words kept by a worker; beyond it the table starts anew
KEPT_WORDS = 500_000
#: tokens for each batch that a task gives back
BATCH_TOKENS = 1_000_000


class LibraryWords(dict):
    """The ids of a text by the tokenizers library; a different word goes to its model once and is kept."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        mapped = word.encode().decode("latin-1").translate(self.letters)
        self[word] = ids = np.array([t.id for t in self.model.tokenize(mapped)], np.int32).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or self.special and "<" in text and self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))


@functools.lru_cache(2)
def words_of(path: str) -> LibraryWords:
    return LibraryWords(path)


def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or self.special and "<" in text and self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))


@functools.lru_cache(2)
def words_of(path: str) -> LibraryWords:
    return LibraryWords(path)


def list_column(parts: list[bytes]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """doc_id, ids (binary) of every row, the end id last."""
    path = path or default_path()
    end = b"" if end_id is None else np.int32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words_of(path)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = [w.encode(x or "") + end for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, ids binary")


def slack_of(capacity: int) -> int:
    """The least slack with which every shorter length is of a class as it is."""
    return int(np.ceil(np.sqrt(capacity)))


@functools.lru_cache(1 << 16)
def cuts(rest: int, capacity: int, slack: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a rest below the capacity."""
    out = []
    while rest:
        k = capacity // rest
        size = rest
        if capacity - k * rest > slack:
            k += 1
            size = capacity // k
        out.append((size, k))
        rest -= size
    return tuple(out)


ROW = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
       ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class", pa.int32()), ("worker", pa.int32()), ("number", pa.int64())]
SCHEMA = pa.schema(ROW)
KINDS = ("doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, class int, "
         "worker int, number bigint")


class Worker:
    """The open sequences of one worker: pieces (doc_id, start, ids, doc_tokens) by class."""

    def __init__(self, level: int, worker: int):
        self.worker, self.next = worker, (level << 58) + (worker << 32)
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.tokens = 0

    def sequence(self, pieces: list[tuple], k: int) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p, self.next, at, k))
            at += len(p[2]) // 4
        self.tokens += at
        self.next += 1

    def add(self, piece: tuple, k: int) -> None:
        if k == 1:
            return self.sequence([piece], 1)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.sequence(held, k)
            del self.open[k]

    def leave(self) -> None:
        """What is open, without a sequence."""
        for k in sorted(self.open):
            self.rows += [(*p, None, None, k) for p in self.open[k]]
        self.open = {}

    def close(self, capacity: int) -> None:
        """What is open in sequences that need no padding."""
        pieces, left = [], 0
        whole = sum(len(p[2]) // 4 for held in self.open.values() for p in held)
        for k in sorted(self.open):
            for i, start, ids, total in self.open[k]:
                while ids:
                    if not left:
                        left = capacity if whole >= capacity else 1 << (whole.bit_length() - 1)
                    n = min(left, len(ids) // 4)
                    pieces.append((i, start, ids[:4 * n], total))
                    start, ids, left, whole = start + n, ids[4 * n:], left - n, whole - n
                    if not left:
                        self.sequence(pieces, 0)
                        pieces = []
        self.open = {}

    def batch(self) -> pa.RecordBatch:
        """The rows so far."""
        rows, self.rows, self.tokens = self.rows, [], 0
        col = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([
            pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array(col[2], pa.binary()), pa.array(col[3], pa.int64()),
            pa.array(col[4], pa.int64()), pa.array(col[5], pa.int64()), pa.array(col[6], pa.int32()),
            pa.array(np.full(len(rows), self.worker), pa.int32()), pa.array(np.arange(len(rows)), pa.int64())], schema=SCHEMA)


def pack(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", capacity: int = CAPACITY, slack: int | None = None,
         fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, start, ids, doc_tokens, sequence_id, offset: a row for each piece."""
    slack = slack_of(capacity) if slack is None else slack
    if slack < slack_of(capacity):
        raise ValueError(f"the slack of capacity {capacity} is at least {slack_of(capacity)}")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Worker(0, TaskContext.get().partitionId())
        for b in batches:
            for i, ids in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids = ids.as_py() or b""
                start, total = 0, len(ids) // 4
                for size, k in ((capacity, 1),) * (total // capacity) + cuts(total % capacity, capacity, slack):
                    w.add((i, start, ids[4 * start:4 * (start + size)], total), k)
                    start += size
                if w.tokens >= BATCH_TOKENS:
                    yield w.batch()
        w.leave()
        yield w.batch()

    def later(key: tuple, t: pa.Table, level: int, last: bool) -> pa.Table:
        w = Worker(level, key[0].as_py())
        t = t.sort_by([("worker", "ascending"), ("class", "ascending"), ("number", "ascending")])
        for i, start, ids, total, k in zip(*(t[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "class"))):
            w.add((i, start, ids, total), k)
        if last:
            w.close(capacity)
        else:
            w.leave()
        return pa.Table.from_batches([w.batch()])

    d = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    made = [materialize(d.mapInArrow(first, KINDS), "packed", compression="zstd")]
    level, workers = 0, None
    while workers != 1:
        level += 1
        left = made[-1].where("sequence_id IS NULL")
        workers = workers or (left.agg(F.max("worker")).first()[0] or 0) + 1
        workers = -(-workers // fan_in)
        rule = functools.partial(later, level=level, last=workers == 1)
        made.append(materialize(left.groupBy((F.col("worker") / fan_in).cast("int")).applyInArrow(_two(rule), KINDS), "packed", compression="zstd"))
    every = functools.reduce(DataFrame.unionByName, [m.where("sequence_id IS NOT NULL") for m in made])
    return every.select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")


def _two(rule):
    """A function of a key and a table, as applyInArrow counts the arguments."""
    return lambda key, t: rule(key, t)


def digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of pieces."""
    return pieces.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op12_packing(spark, sf_dir):
    return digests(pack(encode(table(spark, sf_dir, "documents"))))
