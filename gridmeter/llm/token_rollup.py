"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer) are additive: an insert adds a document and its
tokens, a delete takes them away, a revision adds the difference.  A batch of changes
is summed up to one signed row for each group and written once under its id; a marker
that names the attempt commits it.  A batch that is committed again, by a rerun or a
second writer, changes nothing, and an attempt that died leaves files that no marker
names.  ``compact`` folds committed batches into one that stands for them.

Defined results: a null text has no tokens but is a document; null source, lang or
tokenizer are groups of their own; groups whose totals are all zero are left out; rows
that repeat a document are changes of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_files
from .bpe import slices
from .common import SPACE, WORD, materialize, shared_folder, table, text_of

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{folder}")))

    def committed(self) -> dict[str, str]:
        """The attempt that counts of each batch that does: the first by name; none of a batch folded into another.

        Folds are taken in their order; one that folds a batch that an earlier one has
        folded (two writers compacted at the same time) stands for nothing.
        """
        own: dict[str, str] = {}
        for batch, attempt in (n.rsplit("@", 1) for n in self._names("commits")):
            own.setdefault(batch, attempt)
        folded: set[str] = set()
        for fold in sorted(b for b in own if b.startswith("compact-")):
            names = set(self._names(f"folds/{fold}"))
            if names & folded:
                folded.add(fold)
            else:
                folded |= names
        return {b: a for b, a in own.items() if b not in folded}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed ``changes`` (KEYS, docs, tokens); False if the batch was committed before.

        Creating the marker is the commit.  Two writers of one batch may both create
        theirs; readers count one of them.
        """
        if "@" in batch or "/" in batch:
            raise ValueError("a batch id has no @ and no /")
        if any(n.rsplit("@", 1)[0] == batch for n in self._names("commits")):
            return False
        self._write(batch, changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        return True

    def _write(self, batch: str, rows: DataFrame) -> None:
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/deltas/{batch}@{attempt}")
        self._fs.createNewFile(self._path(f"{self.folder}/commits/{batch}@{attempt}"))

    def totals(self, batches: dict[str, str] | None = None) -> DataFrame:
        """KEYS, docs, tokens over ``batches`` (all that are committed)."""
        paths = [f"{self.folder}/deltas/{b}@{a}" for b, a in (self.committed() if batches is None else batches).items()]
        d = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return d.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold what is committed into one batch; what it folds is named before its marker is there.

        The list is taken once: a batch that is committed meanwhile is neither named nor summed.
        """
        batches = self.committed()
        folds = sum(n.startswith("compact-") for n in self._names("commits"))
        batch = f"compact-{folds:08d}-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(f"{self.folder}/folds/{batch}"))
        for old in batches:
            self._fs.createNewFile(self._path(f"{self.folder}/folds/{batch}/{old}"))
        self._write(batch, self.totals(batches))


def counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, sha, tokenizer, n, n_clean of each row and tokenizer version.

    ``n`` counts the text as it is, ``n_clean`` with each run of white space as one space.
    Versions: ``words`` (runs without white space) and the file's name (``byte_bpe_50k``).
    """
    path = path or token_files.default_path()
    version = path.rsplit("/", 1)[-1].removesuffix(".json")
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("sha", pa.string()), ("words", pa.int64()),
                     ("n", pa.int64()), ("n_clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_files.tokenizer(path)
        for whole in batches:
            for b in slices(whole, "text"):
                n = [len(t.encode(x)) // t.dtype.itemsize for x in b.column("text").to_pylist()]
                clean = [k if x is None else len(t.encode(x)) // t.dtype.itemsize for k, x in zip(n, b.column("clean").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang", "sha", "words")),
                                                  pa.array(n, pa.int64()), pa.array(clean, pa.int64())], schema=out)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                    F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    clean = F.regexp_replace("text", SPACE, " ")
    d = d.select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha"),
                 F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"), "text", F.when(clean != F.col("text"), clean).alias("clean"))
    d = d.mapInArrow(run, "doc_id bigint, source string, lang string, sha string, words bigint, n bigint, n_clean bigint")
    both = F.explode(F.array(F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("n"), F.col("words").alias("n_clean")),
                             F.struct(F.lit(version).alias("tokenizer"), "n", "n_clean")))
    return d.select("doc_id", "source", "lang", "sha", both.alias("c")).select("doc_id", "source", "lang", "sha", "c.*")


def changes(d: DataFrame, docs, tokens) -> DataFrame:
    return d.select(*KEYS, F.lit(docs).cast("bigint").alias("docs"), tokens.alias("tokens"))


def op9_token_rollup(spark, sf_dir):
    """Totals after four commits over all documents: every document comes in; texts with runs of
    white space are revised to single spaces; copies of an earlier text go; the first batch is
    sent a second time, which changes nothing."""
    c = materialize(counts(table(spark, sf_dir, "documents")), "token-counts")
    least = c.groupBy("sha", "tokenizer").agg(F.min("doc_id").alias("least")).withColumnRenamed("tokenizer", "t")
    copies = c.join(least, (c["sha"] == least["sha"]) & (c["tokenizer"] == least["t"]) & (c["doc_id"] > least["least"])).select(c["*"])
    r = Rollup(spark, shared_folder(spark, "rollup"))
    load = changes(c, 1, F.col("n"))
    r.commit("load", load)
    r.commit("clean", changes(c.where("n <> n_clean"), 0, F.col("n_clean") - F.col("n")))
    r.commit("copies", changes(copies, -1, -F.col("n_clean")))
    r.commit("load", load)
    return r.totals()
