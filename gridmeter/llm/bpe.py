"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens: a state is
the last token read, an arc x -> y says that y may follow x in a canonical
tokenization.  It starts as the complete automaton over the base symbols; each
merge (u, v) -> w in turn puts in a gadget: w gets the arcs into u and the arcs
out of v as they are by then, and the arc u -> v goes (and u -> w, if u = v, for
runs merge from the left).  49,000 states would hold 2.4 thousand million arcs, so
a gadget is kept as (u, v, order) and an arc is worked out from the gadgets when
it is first asked for, and then kept in the table.

In that automaton one path spells a word, and one path each prefix of it.  The
different new words of a batch take their steps together (``encode_all``): position by
position, the tokens that end there are found in a table of the vocabulary, and the one
whose arc from the state before is in the table of arcs becomes the word's state.  A long
word is walked by itself; there a position that leads nowhere is dropped for good.
Decoding emits the labels of the arcs.  A word is encoded once for each worker and kept,
with a bound on how many are.

Defined results: a null text counts as empty and has no ids; ``doc_id`` and row
order pass through as they are, repeated rows included.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: words kept by a worker; beyond it the table starts anew
KEPT_WORDS = 200_000
#: new words that take their steps together
STEP_WORDS = 20_000
#: bits of a place in the tables of tokens and of arcs
TOKEN_BITS, ARC_BITS = 18, 20
#: bytes of a word that takes its steps with others
WIDE = 24
#: characters of a text that are split at once
CHUNK_CHARS = 1_000_000
#: characters of text for each batch that a worker gives back
BATCH_CHARS = 2_000_000

#: texts with one of these are split by the library's own splitter, others by a plain pattern;
#: among them the letters below U+0250 whose lower case lies beyond it
_AWAY = "".join(chr(i) for i in range(0x250) if any(ord(c) > 0x24F for c in chr(i).lower()))
_OTHER = re.compile(f"[^\x00-ɏ‐-‧€]|[{_AWAY}]")
_SPACES = "\t-\r \x85\xa0"


def _of_category(first: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == first)


_GAP = re.compile("[ \t\n]")
_LETTERS, _NUMBERS = _of_category("L"), _of_category("N")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Automaton:
    """Tokens as states; ``arc(x, y)``: whether y may follow x."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = dict(vocab), suffix
        self.table: dict[tuple[int, int], bool] = {}
        n = max(vocab.values()) + 1
        self.left, self.right, self.order = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[tuple[int, int], int] = {}
        for k, m in enumerate(merges):
            self.gadget(k, *(vocab[x] for x in (m.split(" ") if isinstance(m, str) else m)),
                        vocab["".join(m.split(" ") if isinstance(m, str) else m)])
        # by its first two letters, how long a token can be
        self.reach: dict[str, int] = {}
        for t in vocab:
            t = t.removesuffix(suffix) if suffix else t
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.labels = [""] * n
        for t, i in vocab.items():
            self.labels[i] = t

    def gadget(self, k: int, u: int, v: int, w: int) -> None:
        if max(self.order[u], self.order[v]) >= k or self.order[w] >= 0:
            raise ValueError("merges must come after the merges that make their parts")
        if not self._arc(u, v, k):  # no text leaves u and v side by side: w is never made
            self.vocab = {t: i for t, i in self.vocab.items() if i != w}
            return
        self.left[w], self.right[w], self.order[w] = u, v, k
        self.cut[u, v] = k
        if u == v:
            self.cut[u, w] = k

    def arc(self, x: int, y: int) -> bool:
        known = self.table.get((x, y))
        if known is None:
            known = self.table[x, y] = self._arc(x, y, len(self.order))
        return known

    def _arc(self, x: int, y: int, until: int) -> bool:
        """Whether the gadgets before ``until`` leave an arc x -> y."""
        while True:
            if self.cut.get((x, y), until) < until:
                return False
            a, b = self.order[x], self.order[y]
            if a < 0 and b < 0:
                return True
            until = max(a, b)
            if a >= b:
                x = self.right[x]
            if b >= a:
                y = self.left[y]

    def encode(self, word: str) -> list[int]:
        """The tokens of one pre-split word in byte letters: the one path of the automaton that spells it.

        The longest token with an arc goes first; a position from which no path
        goes on is never tried again, as the path to it is the only one.
        """
        n, vocab, reach, table, out, at, dead = len(word), self.vocab, self.reach, self.table, [], [0], set()
        x, j = -1, 0
        while at[-1] < n:
            i = at[-1]
            j = j or min(n, i + reach.get(word[i:i + 2], 1))
            while j > i:
                if j not in dead:
                    t = vocab.get(word[i:j] if j < n else word[i:] + self.suffix)
                    if t is not None:
                        if x < 0:
                            break
                        ok = table.get((x, t))
                        if ok or ok is None and self.arc(x, t):
                            break
                j -= 1
            if j > i:
                out.append(t)
                at.append(j)
                x, j = t, 0
            elif not out:
                raise ValueError(f"no path spells {word[:40]!r}")
            else:
                dead.add(at.pop())
                out.pop()
                x, j = (out[-1] if out else -1), i - 1
                if j == at[-1]:
                    j = -1
        return out

    def decode(self, ids) -> list[str]:
        """The labels of the arcs that ``ids`` take."""
        return [self.labels[i] for i in ids]


class Steps:
    """The automaton's tables for many words at once: tokens by a hash of their bytes, arcs by their two states."""

    BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.power = np.array([pow(self.BASE, i, 1 << 64) for i in range(WIDE + 1)], np.uint64)
        byte = {c: b for b, c in enumerate(byte_letters())}
        suffix = automaton.suffix
        tokens: tuple[dict, dict] = ({}, {})       # by their bytes: those inside a word, those at its end
        for t, i in automaton.vocab.items():
            end = bool(suffix) and t.endswith(suffix)
            body = t.removesuffix(suffix) if end else t
            if len(body) <= WIDE and body and all(c in byte for c in body):
                tokens[end][bytes(byte[c] for c in body)] = i
        self.longest = max(map(len, [*tokens[0], *tokens[1], b" "]))
        self.inside, self.ending = map(self._table, tokens if suffix else (tokens[0], tokens[0]))
        # an arc lies in one place only; a place holds the arc that was asked for last
        self.arcs, self.allowed = np.full(1 << ARC_BITS, -1, np.int64), np.zeros(1 << ARC_BITS, bool)

    def _table(self, tokens: dict[bytes, int]) -> list[tuple]:
        """Layers of (shift, hashes, tokens): a hash lies in the first layer whose place was free for it."""
        h = self.prefixes(*self.matrix(list(tokens)))
        h, ids = h[np.arange(len(tokens)), [len(t) for t in tokens]], np.array(list(tokens.values()), np.int64)
        if len(np.unique(h)) != len(h):
            raise ValueError("two tokens share a hash")
        layers = []
        while len(h) or not layers:
            if len(layers) > 6:
                raise ValueError("the hashes of the tokens are not spread")
            shift = np.uint64(64 - TOKEN_BITS - len(layers))
            hashes, found = np.zeros(1 << (64 - int(shift)), np.uint64), np.full(1 << (64 - int(shift)), -1, np.int64)
            place, first = np.unique((h * self.SPREAD) >> shift, return_index=True)
            hashes[place], found[place] = h[first], ids[first]
            layers.append((shift, hashes, found))
            left = np.setdiff1d(np.arange(len(h)), first)
            h, ids = h[left], ids[left]
        return layers

    @staticmethod
    def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of words, a row each, and their lengths."""
        size = np.array([len(w) for w in words], np.int64)
        return np.frombuffer(b"".join([w.ljust(WIDE, b"\0") for w in words]), np.uint8).reshape(-1, WIDE), size

    def prefixes(self, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = np.zeros((len(letters), WIDE + 1), np.uint64)
        for j in range(WIDE):
            h[:, j + 1] = h[:, j] * self.power[1] + letters[:, j] + np.uint64(1)
        return h

    def find(self, layers: list[tuple], h: np.ndarray) -> np.ndarray:
        """The token of each hash, -1 for none."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for shift, hashes, ids in layers:
            place = (h[left] * self.SPREAD) >> shift
            hit = (hashes[place] == h[left]) & (ids[place] >= 0)
            out[left[hit]] = ids[place[hit]]
            left = left[~hit & (ids[place] >= 0)]     # a free place: not in any layer
        return out

    def arc(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether y may follow x; an arc that is not in the table is worked out and put there."""
        n = len(self.automaton.labels)
        key = x.astype(np.int64) * n + y
        place = (key.astype(np.uint64) * self.SPREAD) >> np.uint64(64 - ARC_BITS)
        miss = np.flatnonzero(self.arcs[place] != key)
        if not len(miss):
            return self.allowed[place]
        new, which = np.unique(key[miss], return_inverse=True)
        until = len(self.automaton.order)
        made = np.array([self.automaton._arc(k // n, k % n, until) for k in new.tolist()], bool)[which]
        out = self.allowed[place]
        out[miss] = made
        self.arcs[place[miss]], self.allowed[place[miss]] = key[miss], made
        # two of the missing may share a place: the last one written there, arc and answer alike
        clash = miss[self.arcs[place[miss]] == key[miss]]
        self.allowed[place[clash]] = out[clash]
        return out

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words of at most ``WIDE`` bytes, one word after the other, and where each begins.

        A word for which a position has not exactly one state is left without tokens.
        """
        letters, size = self.matrix(words)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        h = self.prefixes(letters[order], size)
        state, back = np.full((len(words), WIDE + 1), -1, np.int32), np.zeros((len(words), WIDE + 1), np.int8)
        good = size > 0
        for j in range(1, int(size.max(initial=0)) + 1):
            n, longer = np.searchsorted(-size, -j, "right"), np.searchsorted(-size, -j, "left")
            states = np.zeros(n, np.int64)
            for i in range(max(0, j - self.longest), j):
                part = h[:n, j] - h[:n, i] * self.power[j - i]
                token = np.concatenate([self.find(self.inside, part[:longer]), self.find(self.ending, part[longer:])])
                at = np.flatnonzero((token >= 0) & ((state[:n, i] >= 0) if i else True))
                if i:
                    at = at[self.arc(state[at, i], token[at])] if len(at) else at
                state[at, j], back[at, j] = token[at], i
                states[at] += 1
            good[:n] &= states == 1
        size = np.where(good, size, 0)
        # from the end of each word backwards
        steps, rows, at = [], np.flatnonzero(good), size[good]
        count = np.zeros(len(words), np.int64)
        while len(rows):
            steps.append((rows, state[rows, at]))
            count[rows] += 1
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        place = np.empty(len(words), np.int64)      # back to the order in which the words came
        place[order] = count
        begin = np.concatenate([[0], np.cumsum(place)])
        ends = begin[1:][order]
        out = np.empty(begin[-1], np.int32)
        for k, (rows, tokens) in enumerate(steps):
            out[ends[rows] - 1 - k] = tokens
        return out, begin


class _Kept(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[key] = made = self.make(key)
        return made


class WordTokenizer:
    """A tokenizer file with word-end BPE, run by the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        names = self.automaton.labels
        names.extend([""] * (max([*self.special.values(), 0]) + 1 - len(names)))
        for t, i in self.special.items():
            names[i] = t
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.steps = Steps(self.automaton)
        self.plain: dict[str, tuple[bytes, str]] = {}
        self.mapped = _Kept(self._word)

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.automaton.encode(word)
        return np.array(ids, np.int32).tobytes(), " ".join(self.automaton.decode(ids))

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not kept yet."""
        new = [w for w in words if w not in self.plain]
        if len(self.plain) + len(new) > KEPT_WORDS:
            self.plain.clear()
            new = list(words)
        label, suffix, kept = self.automaton.labels.__getitem__, self.automaton.suffix, self.plain
        for lo in range(0, len(new), STEP_WORDS):
            some = new[lo:lo + STEP_WORDS]
            raw = [w.encode() for w in some]
            short = [k for k, x in enumerate(raw) if len(x) <= WIDE]
            ids, at = self.steps.encode_all([raw[k] for k in short])
            flat, ids, at = ids.tobytes(), ids.tolist(), at.tolist()
            for k, a, b in zip(short, at, at[1:]):
                w = some[k]
                spelt = w if w.isascii() and w.isprintable() else raw[k].decode("latin-1").translate(self.letters)
                text = " ".join(map(label, ids[a:b]))
                # two strings may share a hash: the labels have to spell the word
                if text.replace(" ", "") == spelt + suffix:
                    kept[w] = flat[4 * a:4 * b], text
            for w, x in zip(some, raw):
                if w not in kept:
                    kept[w] = self._word(x.decode("latin-1").translate(self.letters))

    def segments(self, text: str) -> list:
        """A text as lists of words that are looked up, and pairs that are ready."""
        out: list = []
        for part in self.split.split(text) if self.split and "<" in text else [text]:
            if part in self.special:
                out.append((np.int32(self.special[part]).tobytes(), part))
            elif part and _OTHER.search(part):
                out += [self.mapped[p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
            elif part:
                out.append(_WORDS.findall(part.lower()))
        return out

    def run_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids of each text as 32-bit integers, and the text that they decode to."""
        cut = [self.segments(x) for x in texts]
        new: set[str] = set()
        for segments in cut:
            for s in segments:
                if type(s) is list:
                    new.update(s)
        self.learn(new)
        out = []
        for segments in cut:
            got: list[tuple[bytes, str]] = []
            for s in segments:
                if type(s) is list:
                    got += map(self.plain.__getitem__, s)
                else:
                    got.append(s)
            out.append((b"".join([a for a, _ in got]), " ".join([b for _, b in got])))
        return out

    def run(self, text: str) -> tuple[bytes, str]:
        """The ids of one text, and the text that they decode to.

        A long text is cut at white space (no word or special token holds any), so that its words are never held at once.
        """
        got, at = [], 0
        while at < len(text):
            space = _GAP.search(text, at + CHUNK_CHARS)
            end = space.start() + 1 if space else len(text)
            got += self.run_all([text[at:end]])
            at = end
        return b"".join([a for a, _ in got]), " ".join([b for _, b in got if b])

    def batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        long = [len(x) > CHUNK_CHARS for x in texts]
        short = iter(self.run_all([x for x, l in zip(texts, long) if not l]))
        return [self.run(x) if l else next(short) for x, l in zip(texts, long)]


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def slices(batch: pa.RecordBatch, col: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of one column (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for whole in batches:
            for b in slices(whole, "text", BATCH_CHARS // 2):
                got = t.batch([x or "" for x in b.column("text").to_pylist()])
                ids = np.frombuffer(b"".join([a for a, _ in got]), np.int32)
                at = np.concatenate([[0], np.cumsum([len(a) // 4 for a, _ in got])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)),
                                                  pa.array([d for _, d in got], pa.string())], schema=OUT)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark, sf_dir):
    return digests(encode_decode(table(spark, sf_dir, "documents")))
