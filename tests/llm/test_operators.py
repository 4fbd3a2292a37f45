"""Each operator against a brute-force version, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridmeter.llm import ann, bpe, exact_dedup, jaccard, mixing, secrets, suffix_dedup, token_files, token_rollup, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, node string, key string, row int, _h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def passage(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    base, shared = passage(rng, 150), passage(rng, 40)
    near = base.split()
    out = [None, "", " ", "\t\n", "one", "one two", "ONE  two", "one two three", "x" * 49, "x" * 50, "x" * 300, "\x00" * 120,
           "a  b\nc", "a b c", "a\tb \r c", base, base, base + " ", " ".join(near[:70] + ["zzz"] + near[71:]), " ".join(near[:-3]),
           "ΑΣ Straße İstanbul é Å 日本語 한국어 नमस्ते 😀", "<|endoftext|>it's 'tis don't<|startoftext|> 3.14 $%^", "aaaaaaaaaaaaa aaaa ha" * 30,
           "日" * 400, "w" * 40_000, passage(rng, 12_000), base.upper()]
    out += [passage(rng, rng.randrange(60)) + " " + shared[:rng.randrange(280)] + str(i) for i in range(30)]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls in any column, ties, repeated rows and clashing names."""
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "b", "a", "ä"][i % 4], None, 1, None, "k", 2, None) for i, t in enumerate(odd_texts())]
    base = rows[15][1]
    rows += [(None, base, None, None, None, None, "n", None, None, 3), (7, "repeat " + base, "en", "b", 1, 1, "n", "k", 1, 1), (7, "repeat " + base, "en", "b", 1, 1, "n", "k", 1, 1)]
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(r):
    return (r[0] is None, r[0] or 0, tuple(str(x) for x in r[1:]))


# ---------------------------------------------------------------- 1
def removed_by_force(rows, n):
    rank = [(10 ** 18 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rank:
        for k in range(len(b) - n + 1):
            first[b[k:k + n]] = min(first.get(b[k:k + n], i), i)
    out = []
    for (i, b), (own, _) in zip(rank, rows):
        g = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k:k + n]] < i:
                g[k:k + n] = b"\1" * n
        kept = bytes(c for c, x in zip(b, g) if not x)
        out.append((own, len(b), sum(g), len(re.findall(rb"\x01+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=order)


@pytest.mark.parametrize("block, bucket, hot, stride", [(16 << 20, 8 << 20, 5000, 1 << 17), (60_000, 20_000, 2, 1000)])
def test_suffix_dedup(odd, monkeypatch, block, bucket, hot, stride):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    got = suffix_dedup.removed(odd, hot=hot, stride=stride)
    assert sorted(map(tuple, got.drop("kept").collect()), key=order) == removed_by_force(texts(odd), 50)


def test_suffix_dedup_by_groups_of_buckets(odd, monkeypatch):
    """Buckets of a group share a row of each block, whatever that does to the last group; rows follow the input, not its square."""
    for name, x in (("BLOCK_BYTES", 60_000), ("BUCKET_BYTES", 8_000), ("GROUPS", 5), ("GROUP_MOST", 4)):
        monkeypatch.setattr(suffix_dedup, name, x)
    got = suffix_dedup.removed(odd, hot=2, stride=1000)
    assert sorted(map(tuple, got.drop("kept").collect()), key=order) == removed_by_force(texts(odd), 50)
    rng = random.Random(14)
    block = suffix_dedup.Block(pa.table({"doc_id": [1, 2, 3], "text": [passage(rng, 9000), passage(rng, 9000), ""]}))
    for buckets, most in ((5, 5), (20, 5), (19, 5), (60, 15)):
        p = suffix_dedup.Pieces(block, 50, 16, buckets)
        p.chosen(np.unique(p.key), np.empty(0, np.uint64))
        told, sent = list(p.told()), list(p.sent())
        assert len(told) == len(sent) == most and {r[0] for r in told} == {r[0] for r in sent}
        assert sum(int(np.frombuffer(r[5], np.int64).sum()) for r in sent) == sum(len(r[1]) for r in sent)
        one = suffix_dedup.Pieces(block, 50, 16, buckets)
        one.group = 1
        one.chosen(np.unique(p.key), np.empty(0, np.uint64))
        apart = [suffix_dedup.answer([r[1:5]], 50)[0] for r in one.sent()]
        together = [np.frombuffer(zlib.decompress(suffix_dedup.answered([r[1:]], 50)[0]), np.int64) for r in sent]
        assert np.array_equal(np.concatenate(apart), np.concatenate(together))


def test_collection_transform_on_small_alphabets(tmp_path):
    rng = random.Random(1)
    for trial in range(20):
        letters = b"ab" if trial % 2 else b"abcdefgh \x00"
        ps = sorted({bytes(rng.choice(letters) for _ in range(rng.randrange(6, 20))) for _ in range(rng.randrange(2, 60))})
        ids = np.array([rng.randrange(100) for _ in ps])
        row = (np.array([len(p) for p in ps], np.uint8).tobytes(), zlib.compress(ids.astype(np.int64).tobytes()), zlib.compress(b"".join(ps)), bytes(len(ps)))
        low = {}
        for p, i in zip(ps, ids):
            for k in range(len(p) - 4):
                low[p[k:k + 5]] = min(low.get(p[k:k + 5], 1000), i)
        assert suffix_dedup.answer([row], 5)[0].tolist() == [low[p[k:k + 5]] for p in ps for k in range(len(p) - 4)]


# ---------------------------------------------------------------- 2
def goal_by_force(size):
    names = sorted([s for s in size if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, goal = 1.5 * sum(size.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * size[s]}
        if not over:
            goal.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            goal[s] = 2.0 * size[s]
        left -= sum(goal[s] for s in over)
        open_ -= over
    return goal


def test_mixing(odd):
    got = mixing.mix(odd).collect()
    size = collections.Counter()
    for r in odd.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    goal = goal_by_force(dict(size))
    assert len(got) == odd.count()
    taken = collections.Counter()
    largest = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - goal[s]) <= largest[s]
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, mixing.mix(odd.repartition(7)).collect()), key=order)


def test_targets_by_force(spark):
    rng = random.Random(5)
    for _ in range(4):
        size = {f"s{i}": rng.choice([0, 1, 5, 100, 1000, 5000]) for i in range(rng.randrange(1, 9))}
        got = mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size bigint")).collect()
        want = goal_by_force(size)
        assert {r.source: r.target for r in got} == {s: pytest.approx(want[s]) for s in size}


def test_mix_repeats_rows(odd):
    m = mixing.mixed(odd)
    assert m.columns == odd.columns
    copies = collections.Counter(r.doc_id for r in m.where("doc_id <> 7").collect())
    assert copies == {r.doc_id: r.copies for r in mixing.mix(odd).where("doc_id <> 7").collect() if r.copies}


@pytest.mark.parametrize("share", [0.01, 1.5])
def test_mix_repeats_rows_with_null_and_repeated_ids(spark, monkeypatch, share):
    """Rows that share id, source and size are documents of their own, also those equal in all columns."""
    monkeypatch.setattr(mixing, "RUN", 2, raising=False)
    rows = [(None, f"a{i} b c", "s", "en") for i in range(500)] + [(None, "x y z", "s", "en")] * 101 + [(4, f"r{i % 30} q", "s", "en") for i in range(60)]
    rows += [(i, "p q r s", "t", "de" if i % 2 else None) for i in range(1000, 1200)] + [(None, "e f", None, None)] * 7
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(4)
    got, want = collections.Counter(), collections.Counter()
    for r in mixing.mixed(df, share=share).collect():
        got[r.source, r.doc_id, r.text] += 1
    for r in mixing.mix(df, share=share).collect():
        want[r.source, r.doc_id, r.size] += r.copies
    per = collections.Counter()
    for (s, i, t), n in got.items():
        per[s, i, len(t.split())] += n
    assert per == +want
    have = collections.Counter((s, i, t) for i, t, s, _ in rows)
    goal = {r.source: r.target / r.source_size for r in mixing.mix(df, share=share).collect()}
    assert all(int(goal[k[0]]) * n <= got[k] <= (int(goal[k[0]]) + 1) * n for k, n in have.items())


# ---------------------------------------------------------------- 3
def test_secrets(spark):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], set()
    for i in range(400):
        s = [f'token = "{hexa(40)}"', f"password={hexa(18)}", f"card 4{rng.randrange(10 ** 14):015d}", f"call 555-{rng.randrange(10 ** 4):04d}0"][i % 4]
        rows.append((i, passage(rng, 20) + " " + s + " " + passage(rng, 10), "x"))
        if i % 4 < 2:
            planted.add((i, re.search(r"[0-9a-f]{18,}", s).group()))
    unsaid = hexa(40)
    rows += [(1000, f"{passage(rng, 5)} {unsaid} {passage(rng, 5)}", None), (1001, None, "x"), (1002, "", "x"), (1003, "k9" * 3000, "x"), (None, rows[0][1], "x"), rows[1], rows[1]]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    found = {(r.doc_id, r.cand) for r in got if r.secret}
    assert planted <= found and not any(i % 4 > 1 for i, _ in found if i is not None and i < 400)
    of = dict((i, t) for i, t, _ in rows)
    assert all(of[r.doc_id][r.start:r.start + r.length] == r.cand for r in got if r.doc_id is not None)
    assert len([r for r in got if r.doc_id == 1]) == len({(r.doc_id, r.n) for r in got if r.doc_id == 1})


def test_secrets_of_any_signs_and_length(spark):
    """Assigned values and passwords of addresses are judged whatever they consist of."""
    rng = random.Random(10)
    word = lambda n, s="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(s) for _ in range(n))
    rows, planted, not_secret = [], set(), set()
    for i in range(360):
        mixed, short, letters = word(6) + "!" + word(4) + "#9", "h" + word(5, "uvwxyz") + "2", word(18, "qWeRtYuIoPaSdFgHjKl")
        before, value, after, is_secret = [
            ('password = "', mixed, '"', 1), ('client_secret: "', letters, '"', 1), ("pwd=", short, "", 1), ("postgres://app:", word(10), "@host/db", 1), ("redis://user1234567:", mixed, "@10.0.0.1", 1),
            ("the secret: ", "always", " be kind", 0), ("password = ", "get_password(user", ")", 0), ("token: ", "null", ",", 0), ("see https://example.org/", "page" + str(10000 + i), "/index", 0)][i % 9]
        rows.append((i, f"{passage(rng, 12)} {before}{value}{after} {passage(rng, 8)}", "x"))
        if is_secret:
            planted.add((i, value))
        elif i % 9 < 8:
            not_secret.add((i, value))
    said = {1000: ('password = "P@ss!w0rd#9x"', "P@ss!w0rd#9x"), 1001: ('password = "correct-horse-battery"', "correct-horse-battery"), 1002: ('client_secret: "qWeRtYuIoPaSdFgHjKl"', "qWeRtYuIoPaSdFgHjKl"),
            1003: ("pwd=hunter2", "hunter2"), 1004: ("postgres://app:Zk39fjQ2xx@host", "Zk39fjQ2xx"), 1005: ('password = "never closed', "never")}
    rows += [(i, t, "x") for i, (t, _) in said.items()] + [(2000 + i, "always be kind and correct the horse battery of the hunter", "x") for i in range(30)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    of = {i: t for i, t, _ in rows}
    assert all(of[r.doc_id][r.start:r.start + r.length] == r.cand for r in got)
    seen, found = {(r.doc_id, r.cand) for r in got}, {(r.doc_id, r.cand) for r in got if r.secret}
    assert planted | not_secret | {(i, v) for i, (_, v) in said.items()} <= seen
    assert planted | {(i, v) for i, (_, v) in said.items() if i < 1005} <= found and not not_secret & found


# ---------------------------------------------------------------- 4, 5
def test_bpe(spark, odd):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = bpe.encode_decode(docs)
    want = collections.Counter()
    for i, t in texts(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == want
    one = bpe.digests(got.where("doc_id = 20")).first()
    ids = lib.encode(odd_texts()[20], add_special_tokens=False).ids
    assert one.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and one.n_tokens == len(ids)


def test_automaton_has_one_path_for_each_word():
    """Against merging in order, on random merges over a small alphabet."""
    rng = random.Random(2)
    for _ in range(20):
        vocab, merges = {"a": 0, "b": 1, "c": 2}, []

        def slow(word, upto):
            w = list(word)
            for u, v in merges[:upto]:
                i = 0
                while i < len(w) - 1:
                    if (w[i], w[i + 1]) == (u, v):
                        w[i:i + 2] = [u + v]
                    i += 1
            return w

        while len(merges) < 25:
            w = slow("".join(rng.choice("abc") for _ in range(12)), None)
            k = rng.randrange(len(w) - 1) if len(w) > 1 else None
            if k is not None and w[k] + w[k + 1] not in vocab:
                merges.append((w[k], w[k + 1]))
                vocab[w[k] + w[k + 1]] = len(vocab)
        a = bpe.Automaton(vocab, merges)
        for _ in range(100):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 20)))
            assert a.decode(a.encode(word)) == slow(word, None)


def test_token_files(spark, odd, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 30_000)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder = token_files.write_token_files(odd)
    got = token_files.read_token_files(spark, folder).collect()
    assert len(got) == odd.count()
    rows = [(i, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts(odd)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    start = 0
    for (i, ids), r in zip(rows, sorted(got, key=lambda r: r.start)):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


# ---------------------------------------------------------------- 6
@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda c: F.length(c).cast("bigint")])
def test_exact_dedup(odd, fingerprint):
    """Also with identifiers that collide all the time."""
    groups = collections.defaultdict(list)
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts(odd)]
    for i, t in rows:
        groups[t].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, exact_dedup.exact_dedup(odd, fingerprint=fingerprint).collect()), key=order) == sorted(want, key=order)
    left = exact_dedup.without_copies(odd)
    assert left.columns == odd.columns and sorted(texts(left), key=order) == sorted([(i, o) for (i, o), (_, t) in zip(texts(odd), rows) if i == keep[t]], key=order)


def test_pipeline_leaves_one_row_of_equal_texts(spark):
    """Also where ids are null or the smallest is repeated."""
    import corpus_pipeline

    rows = [(None, "a b", "x"), (None, "a  b", "y"), (None, "c", "x"), (3, "d e", "x"), (3, "d\te", "y"), (3, "d e", "x"), (5, "d e", "x"), (None, "d e", "z"),
            (3, "f", "x"), (None, "", "x"), (None, None, "x"), (7, "g", "x"), (None, "g", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    left = corpus_pipeline.drop_copies(spark, df, "")
    assert left.columns == df.columns
    got = left.collect()
    assert set(map(tuple, got)) <= set(rows)
    want = [(None, ""), (None, "a b"), (None, "c"), (3, "d e"), (3, "f"), (7, "g")]
    assert sorted((r.doc_id, " ".join((r.text or "").split())) for r in got if r.doc_id) == sorted(x for x in want if x[0])
    assert sorted(" ".join((r.text or "").split()) for r in got if r.doc_id is None) == sorted(t for i, t in want if i is None)


# ---------------------------------------------------------------- 7
def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(600 + i, v[7].tolist()) for i in range(200)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15),
                                                           (904, [float("inf")] * 16), (905, [1.0]), (None, v[3].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 50 = 0 OR vec_id = 7")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, asked, block_rows=300, candidates=150).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = {i: np.array(x) for i, x in rows if i is not None and i < 900}
    hit = 0
    for q in [i for i in ok if i % 50 == 0 or i == 7]:
        want = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i in want} & {i for _, i, _ in mine})
    assert hit >= 0.95 * 10 * len([i for i in ok if i % 50 == 0 or i == 7])
    assert [i for _, i, _ in sorted(got[7])] == list(range(600, 610))
    assert ann.neighbours(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2
    assert ann.neighbours(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_neighbours_of_each_length(spark):
    """One odd vector with the smallest id hides no others; lengths are searched among themselves."""
    rng = np.random.default_rng(6)
    v = {i: rng.normal(size=8 if i % 3 else 5) for i in range(1, 900)} | {0: rng.normal(size=3), -1: rng.normal(size=3)}
    rows = [(i, x.tolist(), "x", 1) for i, x in v.items()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n string, perm int")
    asked = df.where("vec_id % 30 = 0")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, asked, block_rows=200, candidates=60, pivots=32, posted=6, read=12).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    hit = total = 0
    for q in (i for i in v if i % 30 == 0):
        want = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in v if i != q and len(v[i]) == len(v[q]))[:10]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(want) + 1))
        hit += len({i for _, i in want} & {i for _, _, i in got[q]})
        total += len(want)
    assert sorted(got[0]) == [(1, pytest.approx(float(np.sqrt(((v[0] - v[-1]) ** 2).sum()))), -1)] and hit >= 0.9 * total


def test_inverted_files_hold_the_posted_alone():
    rng = np.random.default_rng(1)
    perm = np.array([rng.permutation(16) for _ in range(50)], np.int16)
    b = ann.Block(perm, 3)
    for p in range(16):
        assert b.file(p).tolist() == [i for i in range(50) if p in perm[i, :3]]
    order = perm[7]
    near = [i for i in range(50) if set(perm[i, :3]) & set(order[:2])]
    assert b.best(order, 2, 100).tolist() == near
    apart = {i: sum(abs(list(perm[i]).index(p) - k) for k, p in enumerate(order)) for i in near}
    best = b.best(order, 2, 4)
    assert 7 in best and sorted(apart[i] for i in best) == sorted(apart.values())[:4]


def test_recall_at_two_sizes(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        v = {r.vec_id: np.array(r.embedding, float) for r in d.collect()}
        ids, m = np.array(list(v)), np.array(list(v.values()))
        got = collections.defaultdict(set)
        for r in ann.op7_ann(spark, f"/root/testdata/{sf}").collect():
            got[r.query_id].add(r.vec_id)
        hit = total = 0
        for q in ids[ids % 100 == 0].tolist():
            far = ((m - v[q]) ** 2).sum(1)
            far[ids == q] = np.inf
            hit += len(set(ids[np.argsort(far, kind="stable")[:10]].tolist()) & got[q])
            total += min(10, len(ids) - 1)
        assert total and hit >= 0.9 * total, (sf, hit, total)


# ---------------------------------------------------------------- 8
def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 30 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.limit(500).collect())


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(40)] + [(None, 1, 1), (3, 0, None), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


# ---------------------------------------------------------------- 9
def test_token_rollup(spark, odd, tmp_path):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in odd.collect():
        want[r.source, r.lang, "words", "tokens"] += len(WORD.findall(r.text or ""))
        want[r.source, r.lang, "byte_bpe_50k", "tokens"] += len(lib.encode(r.text or "", add_special_tokens=False).ids)
        for v in ("words", "byte_bpe_50k"):
            want[r.source, r.lang, v, "docs"] += 1
    c = token_rollup.counts(odd).cache()
    roll = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    load = token_rollup.changes(c, 1, F.col("n"))
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in roll.totals().collect()}
    assert total() == {}
    assert roll.commit("load", load) and not roll.commit("load", load)
    full = total()
    assert full == {k[:3]: (want[*k[:3], "docs"], want[*k[:3], "tokens"]) for k in want}
    gone = c.where("doc_id < 9")
    assert roll.commit("gone", token_rollup.changes(gone, -1, -F.col("n")))
    less = total()
    roll.compact()
    assert total() == less and not roll.commit("gone", token_rollup.changes(gone, -1, -F.col("n")))
    assert roll.commit("back", token_rollup.changes(gone, 1, F.col("n"))) and total() == full


def test_rollup_compaction_beside_other_writers(spark, tmp_path, monkeypatch):
    """A batch committed while another writer folds, or two folds at once, count once."""
    row = lambda n: spark.createDataFrame([("s", "l", "t", 1, n)], token_rollup.DELTA)
    roll, other = (token_rollup.Rollup(spark, str(tmp_path / "roll")) for _ in range(2))
    total = lambda: [(r.docs, r.tokens) for r in roll.totals().collect()]
    roll.commit("a", row(10))
    write = token_rollup.Rollup._write

    def meanwhile(self, batch, rows):
        if self is roll and batch.startswith("compact-"):
            monkeypatch.setattr(token_rollup.Rollup, "_write", write)
            other.commit("b", row(5))
            other.compact()
        write(self, batch, rows)

    monkeypatch.setattr(token_rollup.Rollup, "_write", meanwhile)
    roll.compact()
    assert total() == [(2, 15)]
    roll.commit("c", row(1))
    roll.compact()
    assert total() == [(3, 16)] and len(roll.committed()) == 1 and not roll.commit("b", row(5))


@pytest.mark.parametrize("rows", [lambda t: t, lambda t: t.limit(0)])
def test_rollup_query(spark, tmp_path, odd, rows):
    """The query's batches against counts of what is left in the end."""
    docs = rows(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = [(r.doc_id, r.text or "", r.source, r.lang) for r in docs.collect()]
    least = {}
    for i, t, _, _ in given:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    want = collections.defaultdict(lambda: [0, 0])
    for i, t, source, lang in given:
        if i is None or t not in least or i <= least[t]:      # copies of an earlier text go
            clean = re.sub(r"[\x20\x09-\x0D]+", " ", t)
            for version, n in (("words", len(WORD.findall(t))), ("byte_bpe_50k", len(lib.encode(clean, add_special_tokens=False).ids))):
                want[source, lang, version][0] += 1
                want[source, lang, version][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in token_rollup.op9_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v != [0, 0]}


# ---------------------------------------------------------------- 10
def classes_by_force(rows, n, num, den):
    sets, root, inv = [], [], collections.defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(LOWER))
        s = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets.append(s)
        root.append(k)
        near = collections.Counter(j for x in s for j in inv[x])
        for x in s:
            inv[x].append(k)
        for j, c in near.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return sorted([(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)], key=order)


@pytest.mark.parametrize("block, leaders", [(3000, 256), (12, 4)])
def test_jaccard_classes(spark, odd, monkeypatch, block, leaders):
    """Chains of near copies, with blocks so small that large components are cut, too."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rng = random.Random(6)
    now, more = passage(rng, 150).split(), []
    for i in range(90):
        w = list(now)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
        now = w if i % 6 == 0 else now
        more.append((2000 + i, " ".join(w)))
    for q in range(7, 33):
        t = passage(rng, q, "klmnop")
        more += [(3000 + 4 * q, t), (3001 + 4 * q, t + " x"), (3002 + 4 * q, "y " + t), (3003 + 4 * q, t.upper())]
    df = odd.select("doc_id", "text", "node").union(spark.createDataFrame([(i, t, "n") for i, t in more], "doc_id bigint, text string, node string"))
    assert sorted(map(tuple, jaccard.jaccard_classes(df).collect()), key=order) == classes_by_force(texts(df), 3, 90, 100)


def test_jaccard_blocks_hold_one_class(spark, monkeypatch):
    """Where candidates chain unlike documents, only what may be of one class is cut into blocks, whose texts are copied."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    monkeypatch.setattr(jaccard, "LEADERS", 4)
    rng, handed, cut = random.Random(13), [], jaccard.large_classes
    common, copied = passage(rng, 12), passage(rng, 90)
    rows = [(i, f"{common} {passage(rng, 50)}") for i in range(60)] + [(100 + i, f"{copied} x{i}") for i in range(20)]
    rows += [(200, rows[7][1] + " y"), (201, "z " + rows[8][1])]

    def chained(docs, t, n, text_col):
        nodes = jaccard.scanned(docs, t, n, "doc_id", text_col).where("n_shingles > 0").select(F.col("node").alias("u"))
        return nodes.crossJoin(nodes.agg(F.min("u").alias("v")))

    monkeypatch.setattr(jaccard, "stars", chained)
    monkeypatch.setattr(jaccard, "large_classes", lambda large, t, n: handed.append(sorted(r.text for r in large.collect())) or cut(large, t, n))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, jaccard.jaccard_classes(df).collect()), key=order) == classes_by_force(texts(df), 3, 90, 100)
    assert handed == [sorted(t for i, t in rows if 100 <= i < 200)]


@pytest.mark.parametrize("num", [90, 80])
def test_rarest_shingles_keep_every_pair(num):
    """Two sets at the threshold share a key, whatever the counts say, but for places that were counted once."""
    t, rng, met = jaccard.Threshold(num, 100), np.random.default_rng(9), 0
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 37, 64, 129, 311, 700]:
        for _ in range(40):
            a = rng.integers(0, 2 ** 63, size).astype(np.uint64)
            b = np.unique(np.concatenate([a[int(rng.integers(0, size // 5 + 1)):], rng.integers(0, 2 ** 63, int(rng.integers(0, size // 5 + 1))).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both < num * (len(a) + len(b) - both):
                continue
            met += 1
            counts = rng.integers(2, 2 + int(rng.integers(1, 65533)), jaccard.SLOTS).astype(np.uint16)
            x, y, other = (set(k.tolist()) for k in jaccard.rare_keys([a, b, b], t, counts, np.array([5, 5, -6])))
            assert x & y and not x & other
    assert met > 50


@pytest.mark.parametrize("num", [90, 80])
def test_parts_keep_every_pair(num):
    """Two sets at the threshold share a key, whatever their sizes and whatever is left out of both."""
    t = jaccard.Threshold(num, 100)
    rng = np.random.default_rng(8)
    met = 0
    for size in [5, 9, 10, 11, 19, 20, 37, 38, 57, 58, 64, 128, 129, 311, 700]:
        for _ in range(40):
            a = rng.integers(0, 2 ** 63, size).astype(np.uint64)
            lost = int(rng.integers(0, size // 5 + 1))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2 ** 63, int(rng.integers(0, size // 4 + 1))).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both < num * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            met += 1
            for frequent in (np.empty(0, np.uint64), np.sort(a[::2]), np.sort(np.concatenate([a, b]))):
                x, y = (set(k.tolist()) for k in jaccard.part_keys([a, b], t, np.unique(frequent)))
                assert x & y
    assert met > 50


@pytest.mark.parametrize("n", [3, 5])
def test_shingles_of_a_single_short_text(n):
    """A call may hold fewer words than a shingle has; the sets are those of the text beside a long one."""
    long = " ".join(f"w{i}" for i in range(40))
    for words in range(7):
        t = " ".join("abcdefg"[:words])
        alone = jaccard.shingle_sets(pa.array([t]), n)
        assert [len(s) for s in alone] == [1 if 0 < words < n else max(0, words - n + 1)]
        assert np.array_equal(alone[0], jaccard.shingle_sets(pa.array([t, long]), n)[0])


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Only near copies go, whatever shares their id, and one row of each class stays."""
    rng = random.Random(12)
    t = [passage(rng, 60) for _ in range(9)]
    rows = [(3, t[0]), (None, t[0] + " x"), (None, t[1]), (None, t[2]), (7, t[0] + " y"), (7, t[3]),  # near copies of 3 beside clean texts of the same id
            (None, t[4]), (None, t[4] + " x"), (8, t[5]), (8, t[5] + " x"), (9, t[6]), (9, t[6]), (None, t[7]), (None, t[7]),
            (9, t[8]), (2, t[8] + " x"), (None, ""), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    got = collections.Counter(texts(left))
    sure = [(3, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (9, t[6]), (None, t[7]), (2, t[8] + " x"), (None, ""), (None, None), (5, "")]
    assert all(got.pop(x, 0) == 1 for x in sure)
    assert [got.total(), sum(i is None for i, _ in got), sum(i == 8 for i, _ in got)] == [2, 1, 1]
    assert {x[:len(t[4])] if i is None else x[:len(t[5])] for i, x in got} == {t[4], t[5]}


# ---------------------------------------------------------------- all
def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert suffix_dedup.removed(none).count() == 0
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert secrets.scan(none).count() == 0
    assert bpe.encode_decode(none).count() == 0
    assert token_files.read_token_files(spark, token_files.write_token_files(none)).count() == 0
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.without_copies(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert token_rollup.counts(none).count() == 0
    assert jaccard.jaccard_classes(none).count() == jaccard.one_of_each(none).count() == 0


def test_bpe_of_each_code_point():
    """Every code point of the BMP beside letters, and letters whose lower case lies elsewhere, as the library has them."""
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    given = [f"a{chr(i)}b {chr(i)}{chr(i)} 1{chr(i)}" for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    given += ["Əli Ərdoğan ƏKRƏM Ɓauna ƐKƆ İstanbul", "Straße ẞ KÅ"]
    for lo in range(0, len(given), 2000):
        some = given[lo:lo + 2000]
        for x, e in zip(some, library.encode_batch(some, add_special_tokens=False)):
            ids, text = own.run(x)
            assert np.frombuffer(ids, np.int32).tolist() == e.ids, x
            assert text == library.decode(e.ids, skip_special_tokens=False), x


def test_bpe_steps_of_many_words():
    """Words that take their steps together, word by word and in small chunks get the library's ids."""
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    rng = random.Random(9)
    words = {"".join(rng.choice("abcdeéüßñ'’$%1\x00") for _ in range(rng.randrange(1, 30))) for _ in range(6000)}
    words |= {"".join(rng.choice(["th", "ing", "er", "ción", "ee", "aa", "a"]) for _ in range(rng.randrange(1, 7))) for _ in range(6000)}
    words = sorted(words)
    own.plain.clear()
    for x, (ids, text), e in zip(words, own.batch(words), library.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(ids, np.int32).tolist() == e.ids, x
        assert text == library.decode(e.ids, skip_special_tokens=False)
    many, at = own.steps.encode_all([b"", b"a", b"thing", b"z" * bpe.WIDE])
    assert at[1] == 0 and at[2] == 1 and (np.diff(at)[1:] > 0).all()
    n = len(own.automaton.labels)
    arcs = [(rng.randrange(n - 2), rng.randrange(n - 2)) for _ in range(3000)]
    x, y = np.array(arcs).T
    assert own.steps.arc(x, y).tolist() == [own.automaton.arc(a, b) for a, b in arcs] == own.steps.arc(x, y).tolist()


def test_bpe_of_a_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    own, library = bpe.WordTokenizer(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for text in [x or "" for x in odd_texts()[:28]] + ["ab " * 100 + "日本 é " * 30 + "<|endoftext|> x" + "y" * 300]:
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.batch([text, "a"])[0]
        assert np.frombuffer(got[0], np.int32).tolist() == ids and got[1] == library.decode(ids, skip_special_tokens=False)


def test_bpe_without_common_steps(monkeypatch):
    """Words that the steps leave out are walked one by one."""
    monkeypatch.setattr(bpe.Steps, "encode_all", lambda self, words: (np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)))
    own, library = bpe.WordTokenizer(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    text = "whatever words éstas thing's"
    assert np.frombuffer(own.run(text)[0], np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_toxicity_weights_and_words_kept_are_small(monkeypatch):
    import sys

    import numpy as np
    weight = np.linspace(-1, 1, toxicity.BUCKETS).astype(np.float32)
    m = toxicity.Scorer(weight, 0.25)
    assert sys.getsizeof(m.weight) < 5 * toxicity.BUCKETS
    assert m["abc"] == complex(sum(weight.tolist()[i] for i in toxicity.features("abc")), len(toxicity.features("abc")))
    texts, labels = [f"w{i} common x{i * 7} {'bad' if i % 2 else 'good'}" for i in range(60)], [i % 2 for i in range(60)]
    want = toxicity.train(texts, labels)
    monkeypatch.setattr(toxicity, "KEPT_IN_TRAINING", 5)
    got = toxicity.train(texts, labels)
    assert (got[0] == want[0]).all() and got[1] == want[1]
