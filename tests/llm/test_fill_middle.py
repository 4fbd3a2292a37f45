"""Fill-in-the-middle against a plain version, and the exact round trip."""

import hashlib
import random
import re

import numpy as np
import pytest

from gridmeter.llm import fill_middle as M

from .test_operators import none, odd, texts  # noqa: F401

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_force(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    t = TOKEN.findall(text)
    lo, hi = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    pre, mid, suf = "".join(t[:lo]), "".join(t[lo:hi]), "".join(t[hi:])
    if h[3] % 100 < 20:
        return doc_id, len(t), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(t), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def key(r):
    return tuple((x is not None, x) for x in r)


def check(docs, given, seed=1):
    made = M.restore(M.rearrange(docs, seed=seed)).collect()
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((by_force(i, t, seed) for i, t in given), key=key)
    assert sorted((key((r.doc_id, r.restored)) for r in made)) == sorted(key((i, t or "")) for i, t in given)


def test_odd_texts(spark, odd):  # noqa: F811
    check(odd, texts(odd))


def test_marks_and_bits_of_marks(spark):
    bits = ["<", "<P", "P>", ">", "<P>", "<S>", "<M>", "S>", "<S", "M", "é", "日", "😀", "ab", " ", "\n", "\x00"]
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows)
    assert {r.form for r in M.rearrange(docs).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_seed_and_other_columns(spark):
    rows = [(i, "a b c " * i) for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, h1 int, form string, n int")
    check(docs, rows, seed=7)


def test_empty_table(spark, none):  # noqa: F811
    assert M.restore(M.rearrange(none)).collect() == []


@pytest.mark.parametrize("block", [1, 7, 64])
def test_shifts_in_blocks(monkeypatch, block):
    """The cumulative sum carries over from block to block."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(block)
    given = ["".join(rng.choice("ab <>éX") for _ in range(rng.randrange(40))) for _ in range(60)]
    data = np.frombuffer("".join(given).encode(), np.uint8)
    size = np.array([len(x.encode()) for x in given])
    at = np.concatenate([[0], np.cumsum(size)])
    cuts = [sorted((rng.randrange(len(x) + 1), rng.randrange(len(x) + 1))) for x in given]
    lo = at[:-1] + [len(x[:a].encode()) for x, (a, _) in zip(given, cuts)]
    hi = at[:-1] + [len(x[:b].encode()) for x, (_, b) in zip(given, cuts)]
    form = np.array([rng.randrange(3) for _ in given])
    out, to = M.scatter(data, at, lo, hi, form)
    want = [x if f == 0 else f"<P>{x[:a]}<S>{x[b:]}<M>{x[a:b]}" if f == 1 else f"<S>{x[b:]}<P>{x[:a]}<M>{x[a:b]}"
            for x, (a, b), f in zip(given, cuts, form)]
    assert [out[a:b].tobytes().decode() for a, b in zip(to, to[1:])] == want
    back, ends = M.gather(out, to, form)
    assert [back[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == given


def test_output_without_its_mark_is_an_error():
    with pytest.raises(ValueError, match="lacks"):
        M.gather(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([1]))
