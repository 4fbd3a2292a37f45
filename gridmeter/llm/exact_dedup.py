"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks where its content says so (after a sentence end, once
256 characters have passed; at the latest after 4096).  Its recipe is the
ordered list of 64-bit chunk identifiers.  Identifiers are verified: the chunk
dictionary (identifier, SHA-256 of the chunk) must hold one digest for each
identifier; documents that hold an identifier with two digests are told apart
by the digest of the whole text as well.  Documents are equal when their
recipes are.  Texts are read once and never shuffled: what moves is 8 bytes for
each chunk, and one (identifier, digest) pair for each distinct chunk of a task.

Defined results: a null text counts as empty; empty texts equal each other.
A null ``doc_id`` is never the one that stays unless the whole group has none;
rows that repeat the smallest ``doc_id`` of their group all count as kept
(``one_of_each``, the pipeline's stage, leaves one of them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, one_row, table, text_of

CHUNK = r"(?s).{256,4096}?[.!?;}>]|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, recipe array<bigint>, digests array<string>) of each row."""
    d = docs.select(F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("t"))
    d = d.select("doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"),
                 F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)).alias("c"))
    return d.select("doc_id", "text_sha256",
                    F.transform("c", lambda x: fingerprint(x)).alias("recipe"),
                    F.transform("c", lambda x: F.unhex(F.sha2(x, 256))).alias("digests"))


def group_copies(r: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 from written recipes."""
    entry = r.select(F.explode(F.arrays_zip("recipe", "digests")).alias("e")) \
             .select(F.col("e.recipe").alias("ident"), F.col("e.digests").alias("digest")).distinct()
    unsafe = entry.groupBy("ident").count().where("count > 1").select("ident")
    told = (r.select("text_sha256", F.explode("recipe").alias("ident")).distinct()
             .join(unsafe, "ident", "left_semi").select("text_sha256").distinct()
             .withColumn("apart", F.col("text_sha256")))
    d = (r.select("doc_id", "text_sha256", "recipe").join(told, "text_sha256", "left")
          .withColumn("apart", F.coalesce("apart", F.lit(""))))
    g = d.groupBy("recipe", "apart").agg(F.min("doc_id").alias("keep_id"),
                                         F.count(F.lit(1)).alias("group_size"))
    g = materialize(g, "groups")  # so that the join deals both sides anew and splits the rows of a large group
    return d.join(g, ["recipe", "apart"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: the group of equal texts it belongs to."""
    return group_copies(materialize(recipes(docs, id_col, text_col, fingerprint), "recipes"))


def same_rows(docs: DataFrame, some: DataFrame, id_col: str, text_col: str) -> Column:
    """Whether a row of ``docs`` has id and text of a row of ``some`` (_id, _sha)."""
    return docs[id_col].eqNullSafe(some["_id"]) & (F.sha2(normalised(F.coalesce(docs[text_col].cast("string"), F.lit(""))), 256) == some["_sha"])


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows that are not kept; all columns as they were."""
    gone = exact_dedup(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    return docs.join(gone, same_rows(docs, gone, id_col, text_col), "left_anti")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group; all columns as they were.

    That of the smallest id (null last); of several, the first by a hash of the row.
    """
    copies = materialize(exact_dedup(docs, id_col, text_col).where("group_size > 1")
                         .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "copies")
    gone = copies.where("NOT kept").select("_id", "_sha").distinct()
    twice = materialize(copies.where("kept").groupBy("_id", "_sha").count().where("count > 1").select("_id", "_sha"), "repeated")
    left = docs.join(gone, same_rows(docs, gone, id_col, text_col), "left_anti")
    if twice.isEmpty():
        return left
    several = docs.join(twice, same_rows(docs, twice, id_col, text_col), "left_semi")
    return left.join(twice, same_rows(docs, twice, id_col, text_col), "left_anti").union(one_row(several, F.sha2(normalised(text_of(text_col)), 256)))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n"""
