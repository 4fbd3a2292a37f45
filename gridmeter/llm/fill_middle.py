"""Fill-in-the-middle by displacement scatter.

Two cuts split a text into prefix, middle and suffix; the output says them in another
order behind sentinels.  A batch of texts is one run of bytes.  A scan finds where its
tokens start (``[A-Za-z]+`` or one other code point) and so where the cuts fall.  Each
segment moves by a displacement of its own: a difference array holds, at the first byte
of each segment, by how much the displacement changes, its cumulative sum is the shift of
every byte, and one scatter puts all bytes of the batch where they belong.  ``restore``
goes the other way: it scans an output for its sentinels, builds the shifts in the same
way, and gathers the text.  The cumulative sum runs in blocks of ``BLOCK`` bytes, so the
shifts of a very long text are never held at once.

The cuts and the form come from the SHA-256 of ``<seed>:<doc_id>``, so reruns and other
partitionings give the same output.

Defined results: a null text counts as empty; an empty text and one that holds a sentinel
stay plain, as they are; a null ``doc_id`` is hashed as the empty string; repeated rows
give repeated rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import table, text_of

PRE, SUF, MID = b"<P>", b"<S>", b"<M>"
#: of 100 texts, how many are rearranged, and how many of those in the order suffix, prefix, middle
RATE, SPM_RATE = 90, 20
#: bytes whose shifts are worked out at once
BLOCK = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of non-null strings, and where each begins (one more than there are rows)."""
    c = column.cast(pa.large_string())
    at = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, 8 * c.offset)
    data = c.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def string_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    c = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    return c.cast(pa.string())


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the tokens of all texts start, ascending."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80          # the first byte of a code point
    start[1:] &= ~(letter[1:] & letter[:-1])
    firsts = at[:-1][at[:-1] < at[1:]]     # a text begins a token, whatever stands before it in the batch
    start[firsts] = True
    return np.flatnonzero(start)


def has_any(data: np.ndarray, at: np.ndarray, marks: tuple[bytes, ...] = (PRE, SUF, MID)) -> np.ndarray:
    """Whether each text holds one of the three-byte marks."""
    hit = np.sort(np.concatenate([positions(data, m) for m in marks]))
    return np.searchsorted(hit, np.maximum(at[1:] - 2, at[:-1])) > np.searchsorted(hit, at[:-1])


def positions(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins in the bytes, across texts too."""
    p = np.flatnonzero(data[:max(0, len(data) - len(mark) + 1)] == mark[0])
    for i in range(1, len(mark)):
        p = p[data[p + i] == mark[i]]
    return p


def move(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, out: np.ndarray, gather: bool) -> None:
    """out[i + shift] = data[i] for every byte i (``gather``: out[i] = data[i + shift]).

    Byte ``starts[k]`` (ascending, the first is 0) and those up to the next start are shifted by ``shifts[k]``.
    """
    change = np.diff(shifts, prepend=0)
    n = len(out) if gather else len(data)
    carried = 0
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, b = np.searchsorted(starts, (lo, hi))
        apart = np.zeros(hi - lo, np.int64)
        np.add.at(apart, starts[a:b] - lo, change[a:b])       # empty segments share a start
        apart[0] += carried
        shift = np.cumsum(apart)
        carried = shift[-1]
        here = np.arange(lo, hi) + shift
        if gather:
            out[lo:hi] = data[here]
        else:
            out[here] = data[lo:hi]


def scatter(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch; lo, hi: the bytes of the cuts; form: 0 plain, 1 psm, 2 spm."""
    made = form > 0
    size = at[1:] - at[:-1] + 9 * made
    to = np.concatenate([[0], np.cumsum(size)])
    base, psm = to[:-1], form == 1
    n_pre, n_mid, n_suf = lo - at[:-1], hi - lo, at[1:] - hi
    pre = base + np.where(psm, 3, 6 + n_suf)
    suf = base + np.where(psm, 6 + n_pre, 3)
    mid = base + 9 + n_pre + n_suf
    out = np.empty(to[-1], np.uint8)
    # segments in the order of the input: prefix, middle, suffix; a plain text is a prefix alone
    starts = np.stack([at[:-1], np.where(made, lo, at[1:]), np.where(made, hi, at[1:])], 1).ravel()
    shifts = np.stack([np.where(made, pre, base) - at[:-1], mid - lo, suf - hi], 1)
    shifts[~made, 1:] = shifts[~made, :1]
    move(data, starts, shifts.ravel(), out, False)
    for mark, place in ((PRE, pre - 3), (SUF, suf - 3), (MID, mid - 3)):
        for i in range(3):
            out[place[made] + i] = mark[i]
    return out, to


def gather(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs stand for, from the outputs and their forms alone."""
    made = np.flatnonzero(form > 0)

    def first(mark: bytes) -> np.ndarray:
        p = positions(data, mark)
        k = np.searchsorted(p, at[made])
        if len(made) and (not len(p) or (k >= len(p)).any() or (p[np.minimum(k, len(p) - 1)] + 3 > at[made + 1]).any()):
            raise ValueError(f"an output lacks its {mark.decode()}")
        return p[k] if len(made) else made

    pre, suf, mid = first(PRE), first(SUF), first(MID)
    psm = form[made] == 1
    n_pre = np.where(psm, suf, mid) - pre - 3
    n_suf = np.where(psm, mid, pre) - suf - 3
    size = at[1:] - at[:-1]
    size[made] -= 9
    to = np.concatenate([[0], np.cumsum(size)])
    starts = np.repeat(to[1:, None], 3, 1)
    starts[:, 0] = to[:-1]
    shifts = np.repeat((at - to)[:-1, None], 3, 1)
    n_mid = size[made] - n_pre - n_suf
    starts[made, 1] = to[made] + n_pre
    starts[made, 2] = to[made] + n_pre + n_mid
    shifts[made, 0] = pre + 3 - starts[made, 0]
    shifts[made, 1] = mid + 3 - starts[made, 1]
    shifts[made, 2] = suf + 3 - starts[made, 2]
    out = np.empty(to[-1], np.uint8)
    move(data, starts.ravel(), shifts.ravel(), out, True)
    return out, to


def code_points(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many code points begin in each run of bytes lo to hi; runs ascend and do not overlap."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(first, hi) - np.searchsorted(first, lo)


FORMS = np.array(["plain", "psm", "spm"])
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                 ("middle_chars", pa.int64()), ("output", pa.string())])


def rearrange_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    data, at = text_bytes(b.column("text"))
    h1, h2, h3, h4 = (b.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5))
    starts = token_starts(data, at)
    base = np.searchsorted(starts, at)
    n = base[1:] - base[:-1]
    c1, c2 = h1 % (n + 1), h2 % (n + 1)
    starts = np.append(starts, len(data))
    cut = lambda c: np.where(c < n, starts[base[:-1] + c], at[1:])
    lo, hi = cut(np.minimum(c1, c2)), cut(np.maximum(c1, c2))
    plain = (n == 0) | (h3 % 100 >= RATE) | has_any(data, at)
    form = np.where(plain, 0, np.where(h4 % 100 < SPM_RATE, 2, 1))
    out, to = scatter(data, at, lo, hi, form)
    return pa.RecordBatch.from_arrays([
        b.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), pa.string()),
        pa.array(code_points(data, at[:-1], lo), pa.int64(), mask=plain), pa.array(code_points(data, lo, hi), pa.int64(), mask=plain),
        string_column(out, to)], schema=OUT)


def _draw(id_col: str, seed: int, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint").alias(f"h{k}")


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n tokens, form, prefix_chars, middle_chars, output of every row."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), *[_draw(id_col, seed, k) for k in range(1, 5)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield rearrange_batch(b)

    return d.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(made: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``made`` with ``restored``: the texts that its outputs and forms stand for."""
    names = made.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, output_col):
                data, at = text_bytes(b.column(output_col))
                form = pc.index_in(b.column(form_col), pa.array(FORMS.tolist())).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns, string_column(*gather(data, at, form))], [*names, "restored"])

    return made.mapInArrow(run, f"{kinds}, restored string")


def op11_fill_middle(spark, sf_dir):
    made = restore(rearrange(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
numbers AS (
    SELECT doc_id, text, t, len(t) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS c2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS r3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS r4
    FROM drawn),
parts AS (
    SELECT doc_id, text, n,
           CASE WHEN n = 0 OR r3 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form,
           coalesce(array_to_string(t[1:least(c1, c2)], ''), '') AS pre,
           coalesce(array_to_string(t[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS mid,
           coalesce(array_to_string(t[greatest(c1, c2) + 1:], ''), '') AS suf
    FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
