"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are encoded where they are read.  Their ids are dealt to files by
ranges of ``doc_id`` (bounds from a scan of the ids alone), sorted inside a file,
and written as three flat files for each range:

    NNNNNN.ids   the ids of all its documents, little-endian, 16 bits if the
                 vocabulary fits, else 32
    NNNNNN.off   64-bit offsets in ids, one more than it has documents
    NNNNNN.doc   64-bit document ids, ascending

A file is written under a name of its own attempt and renamed when complete, so
a task that runs again leaves the same files.  The bases of the files are prefix
sums over the manifest, one row for each file (at most ``MOST_FILES``).  Readers
map the files into memory (on a store without local files they read ranges).

Defined results: a null text counts as empty and holds the end id alone; null
``doc_id`` come last, in a file of their own; rows that repeat a ``doc_id`` stay
together, in the order of their ids.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _LETTERS, _NUMBERS, _OTHER, _SPACES, byte_letters, slices
from .common import shared_folder, table

#: a file aims at this many bytes of text, or more where there would be over MOST_FILES
FILE_BYTES = 32 << 20
MOST_FILES = 20_000
KEPT_WORDS = 300_000
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
                    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


class ByteTokenizer:
    """The library's byte-level BPE; each pre-split piece is encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.kept: dict[str, bytes] = {}

    def piece(self, mapped: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        kept = self.kept
        for part in self.split.split(text) if self.split and "<" in text else [text]:
            if part in self.special:
                out.append(self.dtype.type(self.special[part]).tobytes())
            elif part and _OTHER.search(part):
                out += [self.piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            elif part:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                for w in _WORDS.findall(part):
                    ids = kept.get(w)
                    if ids is None:
                        ids = kept[w] = self.piece(w.encode().decode("latin-1").translate(self.letters))
                    out.append(ids)
        return b"".join(out)


@functools.lru_cache(2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    store, top = _store(folder)
    own = f"{top}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for p in parts:
            f.write(p)
    store.move(own, f"{top}/{name}")


def _get(folder: str, name: str, dtype) -> np.ndarray:
    from pyarrow import fs

    store, top = _store(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{top}/{name}", dtype, "r") if store.get_file_info(f"{top}/{name}").size else np.empty(0, dtype)
    with store.open_input_file(f"{top}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def encode(docs: DataFrame, bounds: list[int], path: str, end_id: int | None) -> DataFrame:
    """file, doc_id, ids (binary) of each row; ``bounds``: the first ``doc_id`` of each file but the first."""
    out = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, first = tokenizer(path), np.array(bounds, np.int64)
        end = b"" if end_id is None else t.dtype.type(end_id).tobytes()
        for whole in batches:
            for b in slices(whole, "text"):
                ids = b.column("doc_id")
                file = np.searchsorted(first, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "right")
                file = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(first) + 1, file)
                yield pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), ids, pa.array(
                    [t.encode(x or "") + end for x in b.column("text").to_pylist()], pa.binary())], schema=out)

    return docs.mapInArrow(run, "file int, doc_id bigint, ids binary")


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      path: str | None = None, end_id: int | None = 2) -> str:
    """Write the files and their manifest; returns the folder."""
    spark = docs.sparkSession
    path, folder = path or default_path(), folder or shared_folder(spark, "tokens")
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, size = d.agg(F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    files = int(max(1, min(MOST_FILES, -(-(size or 0) // FILE_BYTES), n or 1)))
    at = [i / files for i in range(1, files)]
    bounds = sorted(set(d.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * files))).first()[0] or [])) if at else []
    store, top = _store(folder)
    store.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        now, ids, doc, off = None, [], [], [0]

        def done():
            _put(folder, f"{now:06d}.ids", ids)
            _put(folder, f"{now:06d}.off", [np.array(off, "<i8").tobytes()])
            _put(folder, f"{now:06d}.doc", [np.array(doc, "<i8").tobytes()])
            return pa.RecordBatch.from_pydict({"file": pa.array([now], pa.int32()), "n_docs": [len(doc)], "n_tokens": [off[-1]]})

        for b in batches:
            for file, i, x in zip(*(b.column(c).to_pylist() for c in ("file", "doc_id", "ids"))):
                if file != now:
                    if now is not None:
                        yield done()
                    now, ids, doc, off = file, [], [], [0]
                ids.append(x)
                doc.append(i or 0)
                off.append(off[-1] + len(x) // t.dtype.itemsize)
        if now is not None:
            yield done()

    dealt = encode(d, bounds, path, end_id).repartition(len(bounds) + 2, "file").sortWithinPartitions("file", "doc_id", "ids")
    manifest = dealt.mapInArrow(write, "file int, n_docs bigint, n_tokens bigint")
    manifest.write.parquet(f"{folder}/manifest")
    _put(folder, "nulls", [str(len(bounds) + 1).encode()])
    return folder


def read_token_files(spark: SparkSession, folder: str, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids array<int> of each document in the files."""
    path = path or default_path()
    m = spark.read.schema("file int, n_docs bigint, n_tokens bigint").parquet(f"{folder}/manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    m = m.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                    + [("ids", pa.list_(pa.int32()))] * with_ids)
    nulls = null_file(folder)  # the last number: so many files there are at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokenizer(path).dtype
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                ids, off, doc = (_get(folder, f"{file:06d}.{x}", t) for x, t in (("ids", kind), ("off", "<i8"), ("doc", "<i8")))
                step = max(1, int(len(doc) * 1_000_000 // max(1, len(ids))))
                for k in range(0, len(doc), step):
                    o = np.array(off[k:k + step + 1])
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(o[:-1], o[1:])]
                    cols = [pa.array(doc[k:k + step], mask=np.full(len(crc), file == nulls)), pa.array(o[:-1] + base),
                            pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32)), pa.array(ids[o[0]:o[-1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, schema=out)

    kinds = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return m.repartition(nulls + 1, "file").mapInArrow(read, kinds)


def null_file(folder: str) -> int:
    """The number of the file that holds the rows without a ``doc_id`` (-1: none)."""
    store, top = _store(folder)
    with store.open_input_stream(f"{top}/nulls") as f:
        return int(f.read())


def op5_token_files(spark, sf_dir):
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents")), with_ids=False)
