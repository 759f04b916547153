"""N-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles; two link when
``den * |x & y| >= num * |x | y|``.  Linked sets share one of the first few
shingles under any common order of all shingles (prefix rule), so rows
(shingle, set) route each possible pair to one place.  The order puts shingles
that many documents have last, so that a passage or line in a third of all rows
routes next to nothing.

In each route the sets form a signature tree: nodes hold OR-combined token
bitmaps and size ranges, and a dual traversal drops pairs of nodes whose largest
possible overlap is too small or whose sets hang together already.  Routes carry
bitmaps of a fixed share of the tokens, which shows already that sets with
chance shingles in common do not link.  Sets that bitmaps do not tell apart form
clusters (connected components).  Each set then travels once, to its cluster,
where the same traversal confirms what is left on whole shingle sets.  Of every
pair of linked sets, both lie in one cluster and are confirmed or in one
component already, so no link is lost.  Shingles stand for themselves as 63-bit
hashes and sets as digests of as many bits; only equal hashes of different
shingles or sets, which no input brings about but by chance, could change a
result.

Clusters of any size are cut into blocks.  A few sets stand in all blocks and tie
them; then sets of other components than the cluster's largest go to all of its
blocks.  Equal sets are one node, whatever their number.

Defined results: null, empty and blank texts have 0 shingles and link with
nothing; a text of fewer words than a shingle has one, the whole sequence;
repeated rows (same id) get equal results; a null id is a component of its own
unless it links; an empty table gives no rows.  No text is cut short.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators.cluster import connected_components
from quorumlake.session import discard, shuffle_partitions, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles counted at once; those seen fewer than FREQUENT_LEAST times of so many don't count as frequent.
COUNT_BLOCK, FREQUENT_LEAST = 2_000_000, 4
#: Frequent shingles known everywhere: at most so many (16 bytes each).  It bounds memory, not results: the order may be any.
FREQUENT_MOST = 1 << 19
#: Sets of a route that meet in one task.
ROUTE_BLOCK = 1024
#: Routes of up to so many sets give the pairs themselves.
SMALL_ROUTE = 8
#: Sets of a cluster that are compared in one task; of larger clusters about LEADERS sets stand in every block.
CLUSTER_BLOCK, LEADERS = 1024, 16
FANOUT = 16
#: Of 256 tokens so many stand in the bitmaps of routes; the rest count as shared.  Sets that share little
#: differ by more than links allow on these already.
ROUTE_SHARE = 102
#: Ids that are broadcast to fetch the texts of candidates; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000

#: Bytes of texts that are hashed at once.
HASH_BYTES = 1 << 22
#: Words of more bytes are hashed one by one.
LONG_WORD = 128

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Masks of the first 0 .. 8 bytes of a little-endian number.
_FIRST = np.array([2**(8 * i) - 1 for i in range(9)], np.uint64)


def _scatter(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and how many each has.  A
    word is mixed eight bytes at a time, so that no sum of letters cancels out."""
    data = b"\n" + b"\n".join(texts).translate(LOWER) + b"\n"
    x = np.frombuffer(data, np.uint8)
    blank = _BLANK[x]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    padded = data + bytes(8)
    eight = np.ndarray(len(x), "<u8", padded, strides=(1,))
    size = end - begin
    h = _scatter((eight[begin] & _FIRST[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _STEP)
    rest, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rest):
        h[rest] = _scatter(h[rest] * _STEP ^ (eight[begin[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[begin[i]:end[i]], digest_size=8).digest(), "little")
    upto = np.searchsorted(begin, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) + 1)
    return h, np.diff(np.concatenate(([0], upto)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the k-word shingles of each text."""
    raw, out, held, size = [t.encode() for t in texts], [], [], 0
    for i, t in enumerate(raw):
        held.append(t)
        size += len(t) + 1
        if i + 1 == len(raw) or size + len(raw[i + 1]) >= HASH_BYTES:
            out += _shingles(*word_hashes(held), k)
            held, size = [], 0
    return out


def _shingles(flat: np.ndarray, count: np.ndarray, k: int) -> list[np.ndarray]:
    rolled = np.full(max(0, len(flat) - k + 1), k, np.uint64)
    for i in range(k):
        rolled = _scatter(rolled * _STEP ^ flat[i:len(rolled) + i])
    rolled = _mix(rolled)
    out, at = [], 0
    for n in count.tolist():
        if n >= k:
            s = np.sort(rolled[at:at + n - k + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif n:
            h = np.array([n], np.uint64)
            for i in range(n):
                h = _scatter(h * _STEP ^ flat[at + i:at + i + 1])
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Token bitmap: the least power of two of bits that is 1.25 or more to a token, 64 to 65536."""
    width = min(1 << 16, max(64, 1 << (-(-5 * len(tokens) // 4) - 1).bit_length() if len(tokens) else 64))
    words = np.zeros(width // 64, np.uint64)
    bit = (tokens >> 8) & (width - 1)
    np.bitwise_or.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    return words


def route_bitmap(tokens: np.ndarray) -> bytes:
    """The bitmap that travels along routes: of ROUTE_SHARE of the tokens (by
    their hash), after the number of these."""
    inside = tokens[(tokens & 255) < ROUTE_SHARE]
    return len(inside).to_bytes(8, "little") + bitmap(inside).tobytes()


def set_digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def _texts(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))


def _blocks(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded amount of text."""
    for batch in batches:
        begin, held = 0, 0
        size = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            held += size[i]
            if held >= chars or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin)
                begin, held = i + 1, 0


def frequent_shingles(docs: DataFrame, k: int, *, text: str = "text") -> np.ndarray:
    """Shingles that many documents have, counted over all of them, with their
    counts: two rows, sorted by shingle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= FREQUENT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(t[many]), pa.array(n[many].astype(np.int64))], ["token", "n"])

        for part in _blocks(batches):
            for s in shingle_sets(part.column(0).to_pylist(), k):
                held.append(s)
                size += len(held[-1])
            if size >= COUNT_BLOCK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = _texts(docs, text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 16")
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).toPandas().sort_values("token")
    return np.array([top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)])


def describe(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, set_id, bits, route array<struct<key, place, token>>) of every
    row.  key: where the set goes for a shingle (the shingle, or the shingle and
    a block of its sets); place: the shingle's place in the set's order; token:
    the shingle itself if its sets are cut into blocks, else null."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)  # FREQUENT_MOST entries at most
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for part in _blocks(batches):
            sizes, ids, bits, tokens, goes, cuts, lengths = [], [], [], [], [], [], []
            for s in shingle_sets(part.column(1).to_pylist(), k):
                n = len(s)
                sid = set_digest(s)
                take = n - (num * n + den - 1) // den + 1 if n else 0
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                hot = known[at] == s if len(known) else np.zeros(n, bool)
                head = np.flatnonzero(~hot)[:take]
                head = np.concatenate([head, np.flatnonzero(hot)[:take - len(head)]])
                many = np.where(hot[head], count[at[head]] // ROUTE_BLOCK + 1, 1) if len(known) else np.ones(len(head), np.int64)
                sizes.append(n)
                ids.append(sid)
                bits.append(route_bitmap(s))
                tokens.append(s[head])
                block = _mix((s[head] ^ np.int64(sid)).astype(np.uint64)) % many
                goes.append(np.where(many > 1, _mix(s[head].astype(np.uint64) * np.uint64(3) + block.astype(np.uint64)), s[head]))
                cuts.append(many > 1)
                lengths.append(len(head))
            ends = np.concatenate(([0], np.cumsum(lengths)))
            pos = np.concatenate([np.arange(x) for x in lengths])
            route = pa.StructArray.from_arrays([pa.array(np.concatenate(goes), pa.int64()), pa.array(pos, pa.int32()),
                                                pa.array(np.concatenate(tokens), pa.int64(), mask=~np.concatenate(cuts))], ["key", "place", "token"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), route)], [id_col, "n_shingles", "set_id", "bits", "route"])

    return _texts(docs, text, id_col).mapInArrow(work, f"`{id_col}` {kind}, n_shingles long, set_id long, bits binary, route array<struct<key:long,place:int,token:long>>")


def _needed(nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of two sets of these sizes that link."""
    return -((-num * (nx + ny)) // (num + den))


def _ranges(t: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each place of a sorted array is in."""
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    return np.cumsum(new) - 1


def _paired(group: np.ndarray, n: np.ndarray, p: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a set has a partner in its route (groups sorted, by size n within)
    that sizes and places p allow: the smaller of two linked sets has their first
    common shingle among the first ``n - needed(n, n) + 1``."""
    lead = n - p >= _needed(n, n, num, den)
    at = group << 33
    first, last = np.searchsorted(at + n, at + n), np.searchsorted(at + n, at + n, "right")
    low, high = np.searchsorted(at + n, at - (-num * n // den)), np.searchsorted(at + n, at + den * n // num, "right")
    leads = np.concatenate(([0], np.cumsum(lead)))
    return (leads[last] - leads[low] - lead > 0) | (lead & (high - first > 1))


def _memberships(num: int, den: int):
    """Rows (key, set_id, n, token) of routes where the set has a partner that
    sizes and places allow.  Routes of many sets are cut into blocks here, if they
    were not before."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        t, s, size = (table.column(x).to_numpy() for x in ("key", "set_id", "size"))
        token = table.column("token").combine_chunks()
        c, token = ~token.is_null().to_numpy(zero_copy_only=False), token.fill_null(0).to_numpy()
        n, p = size >> 32, size & (2**32 - 1)
        order = np.lexsort((s, n, t))
        t, s, n, p, c, token = (x[order] for x in (t, s, n, p, c, token))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        for _ in range(2):  # what is left of a route may be small enough for the second test
            t, s, n, p, c, token = (x[new] for x in (t, s, n, p, c, token))
            group = _ranges(t)
            size = np.bincount(group, minlength=1)[group] if len(group) else group
            new = c | _paired(group, n, p, num, den)
        few = (size <= SMALL_ROUTE) & ~c
        keep = new & ~few
        for d in range(1, SMALL_ROUTE):
            x = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]))
            y = x + d
            fits = (1 + np.minimum(n[x] - 1 - p[x], n[y] - 1 - p[y])) >= _needed(n[x], n[y], num, den)
            keep[x[fits]] = keep[y[fits]] = True
        t, s, n, c, token, group = (x[keep] for x in (t, s, n, c, token, group))
        if len(t):
            many = np.where(c, 1, np.bincount(group)[group] // ROUTE_BLOCK + 1)
            block = _mix((t ^ s).astype(np.uint64)) % many
            token, c = np.where(many > 1, t, token), c | (many > 1)
            t = np.where(many > 1, _mix(t.astype(np.uint64) * np.uint64(3) + block.astype(np.uint64)), t)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(s), pa.array(n), pa.array(token, mask=~c)], ["key", "set_id", "n", "token"])

    return work


class Node:
    """A run of sets in a signature tree: OR-combined bitmap, size range, and the
    most tokens that a set of it has beyond its own bits, and outside the bitmap."""

    __slots__ = ("bits", "loose", "out", "low", "high", "kids", "members")

    def __init__(self, bits, loose, out, low, high, kids, members):
        self.bits, self.loose, self.out, self.low, self.high, self.kids, self.members = bits, loose, out, low, high, kids, members


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought to fewer words."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def signature_tree(sizes: list[int], inside: list[int], order: list[int], bits: list[np.ndarray]) -> Node:
    """Tree over sets in the given order (by size); a node's bitmap has the
    least width of its sets'."""
    level = [Node(bits[i], inside[i] - int(np.bitwise_count(bits[i]).sum()), sizes[i] - inside[i], sizes[i], sizes[i], None, [i]) for i in order]
    while len(level) > 1:
        up = []
        for at in range(0, len(level), FANOUT):
            kids = level[at:at + FANOUT]
            words = min(len(k.bits) for k in kids)
            members = [m for k in kids for m in k.members]
            loose = max(k.loose for k in kids) if all(len(k.bits) == words for k in kids) else max(inside[m] - int(np.bitwise_count(_fold(bits[m], words)).sum()) for m in members)
            up.append(Node(np.bitwise_or.reduce([_fold(k.bits, words) for k in kids], axis=0), loose, max(k.out for k in kids), min(k.low for k in kids), max(k.high for k in kids), kids, members))
        level = up
    return level[0]


def _most(x: Node, y: Node) -> int:
    """The largest overlap that sets of two nodes can have."""
    if len(x.bits) > len(y.bits):
        x, y = y, x
    words = len(x.bits)
    loose = min(x.loose, y.loose) if len(y.bits) == words else x.loose
    return min(int(np.bitwise_count(x.bits & _fold(y.bits, words)).sum()) + loose + min(x.out, y.out), x.high, y.high)


def link_sets(sizes: list[int], bits: list[np.ndarray], labels: list[int], num: int, den: int, overlap=None, inside: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that, with sets of equal labels, join all that are linked:
    by ``overlap(i, j)``, or, without it, all that bitmaps do not tell apart.
    inside: how many tokens of a set its bitmap stands for (by default all).

    A dual traversal of the signature tree drops pairs of nodes whose largest
    possible overlap is too small, and nodes whose sets are all in one component
    by then."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], labels[i]))
    parent = list(range(len(sizes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, v in enumerate(labels):
        parent[i] = seen.setdefault(v, i)
    found, top = [], signature_tree(sizes, inside or sizes, order, bits)
    leaf: dict[int, Node] = {}

    def leaves(x: Node) -> None:
        if x.kids is None:
            leaf[x.members[0]] = x
        for k in x.kids or ():
            leaves(k)

    leaves(top)

    def compare(x: Node, y: Node) -> None:
        i, j = x.members[0], y.members[0]
        a, b = root(i), root(j)
        if a == b or num * max(x.low, y.low) > den * min(x.low, y.low):
            return
        need = -((-num * (x.low + y.low)) // (num + den))
        if _most(x, y) >= need and (overlap is None or overlap(i, j) >= need):
            parent[max(a, b)] = min(a, b)
            found.append((i, j))

    # near neighbours first: what they join is not compared again
    for d in (1, 2, 3) if len(order) > 2 else ():
        for i in range(len(order) - d):
            compare(leaf[order[i]], leaf[order[i + d]])
    stack = [(top, top)]
    while stack:
        x, y = stack.pop()
        if x is not y and (num * y.low > den * x.high or num * x.low > den * y.high or _most(x, y) < -((-num * (x.low + y.low)) // (num + den))):
            continue
        if x.kids is None and y.kids is None:
            if x is not y:
                compare(x, y)
            continue
        if len({root(i) for i in x.members} | ({root(i) for i in y.members} if x is not y else set())) == 1:
            continue
        if x is y:
            stack += [(p, q) for i, p in enumerate(x.kids) for q in x.kids[i:]]
        elif x.kids is None or (y.kids is not None and len(y.members) > len(x.members)):
            stack += [(x, q) for q in y.kids]
        else:
            stack += [(p, y) for p in x.kids]
    return found


class _Bitmaps:
    """Bitmaps of rows, as one matrix for each width."""

    def __init__(self, raw: pa.ChunkedArray):
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        self.inside = np.array([int(x[0]) for x in raw], np.int64)
        self.bits = [x[1:] for x in raw]
        self.words = np.array([len(x) for x in self.bits], np.int64)
        self.row, self.of = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.row[at], self.of[w] = np.arange(len(at)), np.stack([self.bits[i] for i in at.tolist()])

    def folded(self, at: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros((len(at), words), np.uint64)
        for w, m in self.of.items():
            own = np.flatnonzero(self.words[at] == w)
            if len(own):
                out[own] = np.bitwise_or.reduce(m[self.row[at[own]]].reshape(len(own), -1, words), axis=1)
        return out

    def most(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The largest overlap that rows x and y can have; n: sizes of the sets."""
        out, m = np.zeros(len(x), np.int64), self.inside
        width = np.minimum(self.words[x], self.words[y])
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            for part in np.array_split(own, len(own) * w // 1_000_000 + 1):
                i, j = x[part], y[part]
                a, b = self.folded(i, w), self.folded(j, w)
                loose = np.minimum(m[i] - np.bitwise_count(a).sum(1), m[j] - np.bitwise_count(b).sum(1))
                out[part] = np.minimum(np.bitwise_count(a & b).sum(1) + loose, np.minimum(m[i], m[j])) + np.minimum(n[i] - m[i], n[j] - m[j])
        return out


def _route_edges(num: int, den: int):
    """Edges that join, in each route, the sets that bitmaps do not tell apart;
    the sets of a route that is cut into blocks hang on a node of the route
    (below zero)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        t, s, n = (table.column(x).to_numpy() for x in ("key", "set_id", "n"))
        token = table.column("token").combine_chunks()
        cut, token = ~token.is_null().to_numpy(zero_copy_only=False), token.fill_null(0).to_numpy()
        maps = _Bitmaps(table.column("bits"))
        edges = [np.unique(np.stack([s[cut], -token[cut] - 1], 1), axis=0)]
        order = np.flatnonzero(~cut)
        order = order[np.lexsort((s[order], t[order]))]
        group = _ranges(t[order])
        count = np.bincount(group, minlength=1)
        few = count[group] <= SMALL_ROUTE if len(group) else np.zeros(0, bool)
        # routes of few sets: their pairs at once
        for d in range(1, SMALL_ROUTE):
            i = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]))
            x, y = order[i], order[i + d]
            fits = num * np.maximum(n[x], n[y]) <= den * np.minimum(n[x], n[y])
            x, y = x[fits], y[fits]
            near = maps.most(x, y, n) >= _needed(n[x], n[y], num, den)
            edges.append(np.stack([s[x[near]], s[y[near]]], 1))
        # others: a signature tree each
        for at in np.split(order, np.cumsum(count)[:-1]) if len(order) else ():
            if len(at) > SMALL_ROUTE:
                at = at.tolist()
                found = link_sets(n[at].tolist(), [maps.bits[k] for k in at], list(range(len(at))), num, den, inside=maps.inside[at].tolist())
                edges.append(np.array([(s[at[x]], s[at[y]]) for x, y in found], np.int64).reshape(-1, 2))
        e = np.unique(np.concatenate(edges), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return work


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _link_groups(num: int, den: int):
    """Links inside each (cluster, block)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        c, b, s, v = (table.column(x).to_numpy() for x in ("cluster", "block", "set_id", "label"))
        raw = table.column("tokens")
        order = np.lexsort((s, b, c))
        begin = np.flatnonzero(np.concatenate(([True], (c[order][1:] != c[order][:-1]) | (b[order][1:] != b[order][:-1]))))
        links = []
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
            at = order[i:j]
            at = at[np.concatenate(([True], s[at][1:] != s[at][:-1]))]
            if len(at) > 1:
                sets = [np.frombuffer(raw[k].as_buffer(), np.int64) for k in at.tolist()]
                found = link_sets([len(x) for x in sets], [bitmap(x) for x in sets], v[at].tolist(), num, den, lambda x, y, sets=sets: common(sets[x], sets[y]))
                links += [(int(s[at[x]]), int(s[at[y]])) for x, y in found]
        if links:
            e = np.array(links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return work


def _linked_within(docs: DataFrame, plan: DataFrame, k: int, num: int, den: int, id_col: str, text: str, parts: int) -> DataFrame:
    """Links (a, b) within the blocks of ``plan`` (set_id, id, cluster, places,
    label): the texts of its ids are fetched, each set goes to its places."""
    if plan.count() <= BROADCAST_IDS:
        plan = F.broadcast(plan)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            sets = shingle_sets(part.column(4).to_pylist(), k)
            batch = pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "cluster", "places", "label", "tokens"])
            # an id may have several texts: only that of the set counts
            own = [set_digest(s) == i for s, i in zip(sets, part.column(0).to_pylist())]
            yield batch if all(own) else batch.filter(pa.array(own))

    rows = docs.join(plan.withColumnRenamed(id_col, "__id"), F.col(f"`{id_col}`") == F.col("__id"))
    sets = _texts(rows, text, "set_id", "cluster", "places", "label").mapInArrow(work, "set_id long, cluster long, places array<int>, label long, tokens binary")
    placed = sets.select("cluster", F.explode("places").alias("block"), "set_id", "label", "tokens")
    return written(placed.repartition(parts, "cluster", "block").mapInArrow(_link_groups(num, den), "a long, b long").distinct(), "links")


def _least(facts: DataFrame, id_col: str) -> DataFrame:
    """(set_id, least id) of sets with shingles; a null id counts as none."""
    return facts.where("n_shingles > 0").groupBy("set_id").agg(F.min(id_col).alias(id_col))


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component is the least
    id reachable by links of ``k``-word shingle sets with a Jaccard similarity
    of at least num / den."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias(text))
    facts = written(describe(base, k, num, den, frequent_shingles(base, k, text=text), id_col=id_col, text=text), "facts")
    routed = facts.select(F.sum(F.size("route"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(routed / 1_000_000))
    size = F.shiftleft("n_shingles", 32) + F.col("r.place")
    rows = facts.select("set_id", "n_shingles", F.explode("route").alias("r")).select("r.key", "set_id", size.alias("size"), "r.token")
    members = rows.repartition(parts, "key").mapInArrow(_memberships(num, den), "key long, set_id long, n long, token long")
    maps = facts.where("n_shingles > 0").groupBy("set_id").agg(F.first("bits").alias("bits"))
    edges = members.join(maps, "set_id").repartition(parts, "key").mapInArrow(_route_edges(num, den), "a long, b long")
    clusters = connected_components(edges, "a", "b").where("node >= 0").select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    near = written(_least(facts, id_col).where(F.col(id_col).isNotNull()).join(clusters, "set_id"), "near")
    discard(clusters)
    sizes = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = written(near.join(sizes, "cluster").select("set_id", id_col, "cluster", F.ceil(F.col("size") / CLUSTER_BLOCK).cast("int").alias("blocks")), "dealt")
    discard(near)

    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    # about LEADERS sets of a cluster of several blocks stand in all of them
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit("leader"), "set_id"), F.col("blocks") * F.lit(CLUSTER_BLOCK // LEADERS)) == 0)
    plan = dealt.select("set_id", id_col, "cluster", F.when(leads, everywhere).otherwise(F.array(own)).alias("places"), F.col("set_id").alias("label"))
    found = _linked_within(base, plan, k, num, den, id_col, text, parts)
    labels = connected_components(found, "a", "b").withColumnRenamed("node", "set_id")
    wide = dealt.where("blocks > 1")
    if not wide.isEmpty():
        named = wide.join(labels, "set_id", "left").withColumn("label", F.coalesce("component", "set_id")).drop("component")
        main = (named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster")
                .agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("cluster", F.col("top.label").alias("main")))
        rest = written(named.join(main, "cluster").select("set_id", id_col, "cluster", F.when(F.col("label") == F.col("main"), F.array(own)).otherwise(everywhere).alias("places"), "label"), "rest")
        if not rest.isEmpty():
            more = _linked_within(base, rest, k, num, den, id_col, text, parts)
            discard(labels)
            labels = connected_components(found.unionByName(more), "a", "b").withColumnRenamed("node", "set_id")
            discard(more)
        discard(rest)
    discard(found, dealt)
    # the least id of each set, then of each component of sets
    named = _least(facts, id_col).withColumnRenamed(id_col, "least").join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(low, "component").select("set_id", "component_id")
    return (facts.select(id_col, "n_shingles", "set_id").join(by_set, "set_id", "left")
            .select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", F.col(id_col))).otherwise(F.col(id_col)).alias("component_id")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, k=4, num=85, den=100)
