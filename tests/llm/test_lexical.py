"""Ranked search against the scores of all pairs."""

import collections
import math
import random
import re

import numpy as np
import pytest

from gridmeter.llm import lexical as L

from .test_operators import LOWER, none, odd, texts  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_force(docs, items, k=50):
    """Sorted (item_id, rank, doc_id, score)."""
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in set(b))
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    tfs = [(i, len(b), collections.Counter(b)) for i, b in bags]
    out = []
    for item_id, text in {x for x in items if x[1] is not None}:
        found = []
        for i, n, tf in tfs:
            m = 100 - 50 + 50 * n * n_docs // max(1, n_words)
            score = sum(w[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=order)


def order(r):
    return tuple((x is None, x) for x in r)


def got(docs, items, **kw):
    return sorted((tuple(r) for r in L.search(docs, items, **kw).collect()), key=order)


def random_case(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 30, 200])))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[5][1]) for i in range(n_docs // 3)]        # a third of all rows are copies
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 20])))) for i in range(n_items)]
    items[0] = (0, docs[5][1])
    return docs, items


@pytest.mark.parametrize("k, part, bucket, sample", [(50, 20_000, 2048, 1000), (7, 50, 16, 20), (1, 100, 1, 5)])
def test_all_pairs(spark, monkeypatch, k, part, bucket, sample):
    """Many partitions, buckets and rounds skip no document that ranks."""
    for name, v in (("PART_ROWS", part), ("BUCKET", bucket), ("SAMPLE_ROWS", sample), ("STEP", 2), ("GROUP_PARTS", 3)):
        monkeypatch.setattr(L, name, v)
    docs, items = random_case(k, 900, 40)
    want = by_force(docs, items, k)
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
               spark.createDataFrame(items, "item_id long, text string"), k=k) == want


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BYTES", 600)
    docs, items = random_case(3, 60, 40)
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == by_force(docs, items)


def test_odd_texts(spark, odd, none):  # noqa: F811
    items = [(1, "one two ONE"), (1, "one two ONE"), (1, "three"), (None, "a b"), (2, None), (3, ""), (4, "+-*/ \x00"), (5, "日本語 😀 straße ha"),
             (6, "w" * 40_000), (7, "unheard of"), (8, "É å ΑΣ"), (9, "x" * 50)]
    d = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, terms string")
    assert got(odd, d) == by_force(texts(odd), items)
    assert got(odd, d.limit(0)) == [] and got(none, d) == []


def test_whole_buckets_are_skipped():
    """Items whose threshold no document of a bucket can reach are not looked at."""
    items = L.Items([(1, "a b"), (2, "c d")])
    best = L.Best(2, 1, np.array([10, 1000]), np.array([L.LAST, L.LAST]))
    term, value, size = np.array([0, 2]), np.array([20, 30]), np.array([1, 1])
    live = L.search_bucket(items, best, np.array([4, 5]), np.array([False, False]), np.array([20.0, 30.0]), term, value, size)
    assert live == 1 and best.rows[0][1].tolist() == [4] and not len(best.rows[1][1])
