"""Harmonic packing: every id in one place, sequences gapless and nearly full."""

import collections
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridmeter.llm import bpe, packing as K  # noqa: E402

from .test_operators import SF, none, odd, texts  # noqa: F401


def binary(ids):
    return np.array(ids, "<i4").tobytes()


def padding(rows, capacity):
    """Tokens of padding and tokens held; checks that every sequence is gapless and within the capacity."""
    held = collections.defaultdict(list)
    for seq, at, n in rows:
        held[seq].append((at, n))
    pad = total = 0
    for places in held.values():
        at = 0
        for a, n in sorted(places):
            assert a == at and n > 0
            at += n
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad, total


def check(pieces, docs, capacity):
    """``docs``: (doc_id, ids) of every row."""
    got = pieces.collect()
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.doc_id, r.doc_tokens].append((r.start, tuple(np.frombuffer(r.ids, "<i4").tolist())))
    want = collections.defaultdict(list)
    for i, ids in docs:
        if ids:
            want[i, len(ids)].append(tuple(ids))
    assert parts.keys() == want.keys()
    for k, rows in want.items():      # rows that share id and length: their pieces lie beside each other
        left = sorted(parts[k])
        if len(rows) == 1 or len(set(rows)) == 1:
            n = len(rows)
            assert len(left) % n == 0 or n > 1
            if n == 1:
                assert sum((p for _, p in left), ()) == rows[0] and [s for s, _ in left] == np.cumsum([0] + [len(p) for _, p in left])[:-1].tolist()
        assert sum(len(p) for _, p in left) == sum(map(len, rows))
        assert collections.Counter(x for _, p in left for x in p) == collections.Counter(x for r in rows for x in r)
    return padding([(r.sequence_id, r.offset, len(r.ids) // 4) for r in got], capacity)


def test_cuts_are_of_their_class():
    for capacity in (1, 2, 7, 64, 1000, 4096):
        slack = K.slack_of(capacity)
        for rest in range(1, capacity):
            pieces = K.cuts(rest, capacity, slack)
            assert sum(n for n, _ in pieces) == rest
            assert all(n > 0 and 0 <= capacity - n * k <= slack for n, k in pieces)
            assert len(pieces) <= 6


@pytest.mark.parametrize("capacity, partitions, fan_in", [(4096, 3, 32), (100, 17, 2), (64, 40, 3), (1, 2, 2), (7, 5, 2)])
def test_sequences(spark, capacity, partitions, fan_in):
    rng = random.Random(capacity)
    docs = [(i, [rng.randrange(50_000) for _ in range(rng.choice([0, 1, 2, 5, 40, 300, 3 * capacity]))]) for i in range(400)]
    e = spark.createDataFrame([(i, binary(x), "x", 1) for i, x in docs], "doc_id long, ids binary, class string, worker int").repartition(partitions)
    pad, total = check(K.pack(e, capacity=capacity, fan_in=fan_in), docs, capacity)
    assert total == sum(len(x) for _, x in docs)
    assert pad <= total * K.slack_of(capacity) / max(1, capacity - K.slack_of(capacity))


def test_one_length_for_all(spark):
    """A class that holds all rows."""
    docs = [(i, [i] * 1366) for i in range(3000)]
    pad, total = check(K.pack(spark.createDataFrame([(i, binary(x)) for i, x in docs], "doc_id long, ids binary").repartition(9)), docs, 4096)
    assert pad / (pad + total) < 1 / 64


def test_ids_are_those_of_the_library(spark, odd):  # noqa: F811
    library = Tokenizer.from_file(bpe.default_path())
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts(odd)]
    got = K.encode(odd).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<i4").tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    check(K.pack(K.encode(odd)), want, 4096)


def test_no_end_id_and_empty_table(spark, none):  # noqa: F811
    e = K.encode(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), end_id=None)
    assert [bytes(r.ids) for r in e.collect()] == [b"", b""] and K.pack(e).collect() == []
    assert K.pack(K.encode(none)).collect() == []
    with pytest.raises(ValueError, match="slack"):
        K.pack(e, slack=3)


def test_query(spark):
    library = Tokenizer.from_file(bpe.default_path())
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2]
           for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = K.op12_packing(spark, SF).collect()
    seen = collections.Counter()
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    pad, total = padding([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert pad / (pad + total) < 1 / 64
