"""Runs of repeated words: every maximal periodic stretch of a text.

The words of a block of texts become numbers that are equal only within a text. A
suffix array is made by doubling prefixes, in which only suffixes that still tie are
sorted again; the ranks of each doubling answer how far two places agree, forwards
and backwards.  An LCP interval of depth d holds the suffixes that agree on their
first d words.  The suffixes of all its children but the largest look whether the
place d words behind or before them lies in the interval too, outside their own
child (a look at the inverse array): that is a branching square.  Each square is
rotated to the left as far as the words allow, squares of one stretch merge, and the
least period stays.  Intervals are spans of the LCP array; no tree nodes exist.

A run of at least ``min_length`` words has a branching square of a depth of about a
quarter of that or more (a multiple of its period), so shallower intervals are not looked at.

Defined results: null and empty texts have no words and no run; texts of any length
are read whole, with some 200 bytes of memory a word for the largest text; repeated
rows give equal rows; ties for the longest run: smallest start, then period; null ids
are kept; an empty table gives no rows; columns beside those named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a block of whole texts reaches before it is worked on.
BLOCK_BYTES = 2_000_000

# The bytes between words.
GAPS = b" \t\n\x0b\x0c\r"


# ---- words ---------------------------------------------------------------------


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, ends): a number for each word of all texts, equal where text and
    word are, and the place behind each text's last word."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    gap = np.zeros(256, bool)
    gap[list(GAPS)] = True
    inside = ~gap[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    ends = np.searchsorted(starts, text_ends)
    if not len(starts):
        return np.empty(0, np.int64), ends
    kept = np.cumsum(inside)
    offsets = np.append(kept[starts] - 1, kept[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=0))
    return of * len(coded.dictionary) + number, ends


# ---- suffixes -------------------------------------------------------------------


class Suffixes:
    """The suffix array of texts laid end to end, whose symbols differ from text to
    text, and the ranks of all places by their first 1, 2, 4, … symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """depth: places that share less with every other place get no slot."""
        n = len(symbols)
        self.n = n
        order = np.argsort(symbols, kind="stable")
        slots = np.arange(n, dtype=np.int64)
        head = np.ones(n, bool)
        head[1:] = symbols[order][1:] != symbols[order][:-1]
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1  # behind the last place
        rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
        self.levels = [rank]
        tied = slots[~_single(head)]
        wide, self.kept = 1, None
        while True:
            if wide * 2 > depth and self.kept is None:
                self.kept = tied
            if not len(tied):
                break
            at = order[tied]
            key = rank[at] * (n + 2) + rank[np.minimum(at + wide, n)] + 1
            again = np.argsort(key, kind="stable")
            key, at = key[again], at[again]
            order[tied] = at
            head = np.ones(len(tied), bool)
            head[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
            self.levels.append(rank)
            tied = tied[~_single(head)]
            wide *= 2
        self.sa = order[self.kept]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on (all a != b) agree."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            same = np.flatnonzero(rank[a] == rank[b])
            a[same] += 1 << k
            b[same] += 1 << k
        return a - begun

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before places a and b agree."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, far = self.levels[k], 1 << k
            could = np.flatnonzero((a >= far) & (b >= far))
            same = could[rank[a[could] - far] == rank[b[could] - far]]
            a[same] -= far
            b[same] -= far
        return begun - a


def _single(head: np.ndarray) -> np.ndarray:
    """Whether a group of neighbours has one member, by the flags of first members."""
    return head & np.append(head[1:], True)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of spans, one after the other."""
    return np.arange(int(length.sum()), dtype=np.int64) + np.repeat(start - (np.cumsum(length) - length), length)


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boundaries ``at``: the first and the last boundary next to them with a
    smaller LCP, by minima over spans of 1, 2, 4, … boundaries."""
    minima = [lcp]
    while (wide := 1 << len(minima)) <= len(lcp):
        last = minima[-1]
        minima.append(np.minimum(last[:len(lcp) - wide + 1], last[wide // 2:wide // 2 + len(lcp) - wide + 1]))
    depth = lcp[at]
    left, right = at.copy(), at + 1
    for k in range(len(minima) - 1, -1, -1):
        wide, least = 1 << k, minima[k]
        could = np.flatnonzero(left >= wide)
        left[could[least[left[could] - wide] >= depth[could]]] -= wide
        could = np.flatnonzero(right + wide <= len(lcp))
        right[could[least[right[could]] >= depth[could]]] += wide
    return left - 1, right


def branching_squares(s: Suffixes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all squares that the next word does not continue, of
    periods of at least ``depth``; each occurs once at the end of its run."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(s.sa)
    if m < 2:
        return none
    lcp = np.zeros(m + 1, np.int64)  # lcp[k]: of slots k - 1 and k; 0 at both ends
    lcp[1:m] = s.ahead(s.sa[:-1], s.sa[1:])
    at = np.flatnonzero(lcp >= depth)
    if not len(at):
        return none
    left, right = _bounds(lcp, at)
    order = np.argsort(left * (m + 1) + right, kind="stable")
    at, left, right = at[order], left[order], right[order]
    first = np.ones(len(at), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    last = np.append(first[1:], True)
    # children: one before each boundary, and one behind an interval's last boundary
    begin = np.where(first, left, np.concatenate(([0], at[:-1])))
    interval = np.cumsum(first) - 1
    c_begin, c_end = np.concatenate((begin, at[last])), np.concatenate((at, right[last]))
    c_of = np.concatenate((interval, interval[last]))
    size = c_end - c_begin
    by = np.lexsort((size, c_of))  # the largest child is the last of its interval
    small = by[:-1][c_of[by][1:] == c_of[by][:-1]]
    lo, hi, deep = left[first], right[first], lcp[at[first]]
    slot = _spans(c_begin[small], size[small])
    child = np.repeat(small, size[small])
    inverse = np.full(s.n + 1, -1, np.int64)
    inverse[s.sa] = np.arange(m)
    places, periods = [], []
    for sign in (1, -1):
        d = deep[c_of[child]]
        other = s.sa[slot] + sign * d
        within = (other >= 0) & (other < s.n)
        there = inverse[np.where(within, other, s.n)]
        found = (there >= lo[c_of[child]]) & (there < hi[c_of[child]]) & ((there < c_begin[child]) | (there >= c_end[child]))
        places.append(np.minimum(s.sa[slot], other)[found])
        periods.append(d[found])
    return np.concatenate(places), np.concatenate(periods)


def least_depth(min_length: int) -> int:
    """The least depth at which every run of that length has a branching square: the
    largest multiples of all periods that fit twice."""
    half = max(1, min_length // 2)
    return min(half // q * q for q in range(1, half + 1))


def find_runs(symbols: np.ndarray, min_length: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``min_length`` symbols, by
    start, then period.  Texts laid end to end must have symbols of their own."""
    depth = least_depth(min_length)
    s = Suffixes(symbols, depth)
    place, period = branching_squares(s, depth)
    back = s.behind(place, place + period)
    start, length = place - back, back + 2 * period
    long = length >= min_length
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    for q in range(min(depth, int(period.max(initial=0))) - 1, 0, -1):  # periods too short for an interval of their own
        could = np.flatnonzero((period % q == 0) & (period > q))
        could = could[s.ahead(start[could], start[could] + q) >= length[could] - q]
        period[could] = q
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


# ---- texts ----------------------------------------------------------------------

LONGEST = "n_words long, n_runs long, start long, length long, period long"
WHOLE, DIGESTS = "runs array<struct<start:long,length:long,period:long>>, collapsed string", "runs_sha256 string, collapsed_sha256 string"


def repetition_runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_length: int = 12,
                    rewrite: Callable[[object, bytes], bytes] | None = None, digests: bool = False) -> DataFrame:
    """Of each row: id, n_words, n_runs, (start, length, period) of the longest run,
    all ``runs`` and ``collapsed``: the words that no run repeats, joined by blanks.

    rewrite: what a text becomes before it is read, given id and UTF-8 bytes.
    digests: SHA-256 of the runs (a line ``start,length,period`` each) and of the
    collapsed text, as runs_sha256 and collapsed_sha256, in place of the two.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, {LONGEST}, {DIGESTS if digests else WHOLE}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            begin, held = 0, 0
            for i in range(batch.num_rows):
                held += size[i]
                if held >= BLOCK_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(begin, i + 1 - begin)
                    texts = part.column(1).cast(pa.binary()).to_pylist()
                    if rewrite is not None:
                        texts = [rewrite(key, t) for key, t in zip(part.column(0).to_pylist(), texts)]
                    yield _described(part.column(0), texts, min_length, digests)
                    begin, held = i + 1, 0

    return source.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def _described(ids: pa.Array, texts: list[bytes], min_length: int, digests: bool) -> pa.RecordBatch:
    symbols, ends = word_numbers(texts)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    start, length, period = find_runs(symbols, min_length)
    of = np.searchsorted(ends, start, side="right")
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    turn = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(turn, start + period, 1)
    np.add.at(turn, start + length, -1)
    stays = np.cumsum(turn)[:-1] == 0
    dropped = np.concatenate(([0], np.cumsum(~stays)))[np.concatenate((begins, ends[-1:]))]
    local = start - begins[of]
    best = np.full(len(texts), -1, np.int64)
    order = np.lexsort((period, start, -length, of))
    lead = order[np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))] if len(order) else order
    best[of[lead]] = lead
    runs, collapsed = [], []
    for i, t in enumerate(texts):
        words = t.split()
        if dropped[i + 1] > dropped[i]:
            words = [words[k] for k in np.flatnonzero(stays[begins[i]:ends[i]]).tolist()]
        collapsed.append(b" ".join(words))
        span = slice(cut[i], cut[i + 1])
        runs.append(list(zip(local[span].tolist(), length[span].tolist(), period[span].tolist())))
    longest = [pa.array(np.where(best >= 0, v[best] if len(v) else 0, 0), pa.int64(), mask=best < 0) for v in (local, length, period)]
    if digests:
        tail = [pa.array([hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in r).encode()).hexdigest() for r in runs]), pa.array([hashlib.sha256(t).hexdigest() for t in collapsed])]
    else:
        tail = [pa.array([[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([t.decode() for t in collapsed], pa.string())]
    names = ["id", "n_words", "n_runs", "start", "length", "period", *(("runs_sha256", "collapsed_sha256") if digests else ("runs", "collapsed"))]
    return pa.RecordBatch.from_arrays([ids, pa.array(ends - begins), pa.array(np.diff(cut)), *longest, *tail], names)


# ---- the query --------------------------------------------------------------------


def with_planted_period(doc_id: object, text: bytes) -> bytes:
    """Of one text in ten (by the CRC-32 of the id; a null id is the text '') the words
    from a certain place on repeat with a certain period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10:
        return text
    words = text.split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repetition_runs(docs, min_length=12, rewrite=with_planted_period, digests=True)
    milli = F.expr("1000 * length div period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", milli, "runs_sha256", "collapsed_sha256")
