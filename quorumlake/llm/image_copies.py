"""Edited and cropped copies of images, from local descriptors.

Corners, as many as the area asks for, are found on a pyramid of quarter octaves and
placed between pixels; each gets an orientation, and binary tests of its
neighbourhood turned by exactly that angle.  Which points the tests compare is
chosen so that the answers are even and tell different things.

Candidates meet in Hamming tables: TABLES keys of KEY_BITS bits of each code.  Images
that share two keys of different corners are compared whole: descriptors that
differ in at most DISTANCE bits match, and matches that agree on one similarity
transform count.  Pairs with CONSENT such matches link, and classes are what links
connect.  A key that more than BUCKET images share first ties each of them to LEADERS of
them, always the same ones for a group of copies, so a group of any size makes no
pairs of all its images.  Then its images that are still of different classes
meet under the key and a second one of another corner: classes are those that all
pairs would make, and images that share one such key by chance make no pair.
Pairs whose ends other links have joined are not compared.  Equal images are one node.

The tables are probabilistic: a link needs two keys without a turned bit.
Tests measure the recall for each kind of edit.

Defined results: null pixels, and pixels that do not fill width x height, have
no descriptors and link with equal ones only (null with none); images below the
size of a patch likewise; images of any size are described whole; repeated ids
keep their rows; an empty table gives no rows; columns other than id, width,
height and pixels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators.cluster import connected_components
from quorumlake.session import discard, written

#: Corners of so much area, radius of a patch, and tests.
CORNERS, CORNER_AREA, RADIUS, BITS = 20, 72 * 72, 9, 128
#: Scales of an octave; matches of one transform differ by so many at most.
LEVELS, LEVEL_SPREAD = 4, 2
#: Hamming tables, and bits of a key.
TABLES, KEY_BITS = 4, 56
#: Images of a key that meet each other; beyond, each meets so many leaders.
BUCKET, LEADERS = 16, 3
#: Pairs across classes that a task holds at a time.
ACROSS = 1 << 18
#: Images of a key of many whose other keys meet in one part; more are dealt into parts. Other keys that a task holds at a time.
SPLIT, HELD = 4096, 1 << 19
#: Bits that matching codes may differ in, and matches that must agree on one transform.
DISTANCE, CONSENT = 14, 5
#: Distance in pixels that a consenting match may lie off.
NEAR = 2
#: Pixels of a cell that counts once.
APART = 5
#: Ids of repeated images that are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Pairs of points that are compared at once.
PAIRS = 4_000_000
#: Spark's setting that deletes shuffle files when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Steps of a full turn that orientations are kept in; matches of one transform differ by TURN_SPREAD of them at most.
TURNS, TURN_SPREAD = 256, 10

_yy, _xx = np.mgrid[-RADIUS:RADIUS + 1, -RADIUS:RADIUS + 1]
_inside = (_yy**2 + _xx**2) <= RADIUS**2
DY, DX = _yy[_inside], _xx[_inside]
WEIGHT = np.exp(-(DY**2 + DX**2) / (2 * (RADIUS / 2) ** 2)).astype(np.float32)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)² pixels, edges repeated."""
    n = 2 * r + 1
    for axis in (1, 2):
        c = np.cumsum(np.pad(x, [(0, 0)] + [(r + 1, r) if a == axis else (0, 0) for a in (1, 2)], mode="edge"), axis=axis, dtype=np.float64)
        first = [slice(None)] * 3
        last = [slice(None)] * 3
        first[axis], last[axis] = slice(0, -n), slice(n, None)
        x = ((c[tuple(last)] - c[tuple(first)]) / n).astype(np.float32)
    return x


def _top_of_three(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where a parabola through three values has its top, half a step off at most."""
    bend = left - 2 * middle + right
    flat = np.abs(bend) < 1e-9
    return np.clip(np.where(flat, 0, (left - right) / (2 * np.where(flat, 1, bend))), -0.5, 0.5)


def corners(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the strongest corners of equally large images, patches
    inside: CORNERS of each CORNER_AREA pixels, CORNERS of smaller images."""
    smooth = _box(img, 1)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    n, h, w = img.shape
    inner = np.zeros((n, h, w), np.float32)
    e = RADIUS + 1
    core = r[:, e:h - e, e:w - e]
    top = np.ones(core.shape, bool)
    for dy in (-2, -1, 0, 1, 2):
        for dx in (-2, -1, 0, 1, 2):
            if dy or dx:
                top &= core >= r[:, e + dy:h - e + dy, e + dx:w - e + dx]
    inner[:, e:h - e, e:w - e] = np.where(top & (core > 1e-3), core, 0)
    flat = inner.reshape(n, -1)
    count = min(max(CORNERS, -(-CORNERS * h * w // CORNER_AREA)), flat.shape[1])
    at = np.argpartition(-flat, count - 1, axis=1)[:, :count]
    i = np.repeat(np.arange(n), count)
    at = at.ravel()
    good = flat[i, at] > 0
    i, y, x = i[good], at[good] // w, at[good] % w
    own = r[i, y, x]
    return i, y + _top_of_three(r[i, y - 1, x], own, r[i, y + 1, x]), x + _top_of_three(r[i, y, x - 1], own, r[i, y, x + 1])


def _shrunk(img: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Images of another, at most two times smaller size (bilinear after a small blur)."""
    soft = (img + _box(img, 1)) / 2
    for axis, n in ((1, size[0]), (2, size[1])):
        old = soft.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        i = np.minimum(at.astype(int), old - 2)
        f = (at - i).astype(np.float32).reshape((-1, 1) if axis == 1 else (1, -1))
        soft = np.take(soft, i, axis) * (1 - f) + np.take(soft, i + 1, axis) * f
    return soft


def _between(img: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pixels of images i at places between pixels (bilinear)."""
    h, w = img.shape[1:]
    y, x = np.clip(y, 0, h - 1.001), np.clip(x, 0, w - 1.001)
    y0, x0 = y.astype(np.int32), x.astype(np.int32)
    f, g = (y - y0).astype(np.float32), (x - x0).astype(np.float32)
    flat, at = img.reshape(-1), (i * h + y0) * w + x0
    return (flat[at] * (1 - g) + flat[at + 1] * g) * (1 - f) + (flat[at + w] * (1 - g) + flat[at + w + 1] * g) * f


def _orientations(soft: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    patch = _between(soft, i[:, None], y[:, None] + DY, x[:, None] + DX)
    patch = (patch - patch.mean(1, keepdims=True)) * WEIGHT
    return np.arctan2((patch * DY).sum(1), (patch * DX).sum(1))


def _answers(soft: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """Whether the first point of each turned test is darker than the second."""
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    one, other = (_between(soft, i[:, None], y[:, None] + s * tests[:, k] + c * tests[:, k + 1], x[:, None] + c * tests[:, k] - s * tests[:, k + 1]) for k in (0, 2))
    return one < other


@lru_cache(1)
def chosen_tests(seed: int = 5, tried: int = 1500, images: int = 40, side: int = 96) -> np.ndarray:
    """The compared points (BITS, 4): of random ones those whose answers, on
    corners of seeded noise with the spectrum of photographs, are most even and
    least correlated."""
    rng = np.random.default_rng(seed)
    wave = np.hypot(np.fft.fftfreq(side)[:, None], np.fft.rfftfreq(side)[None])
    wave[0, 0] = 1
    img = np.fft.irfft2(np.fft.rfft2(rng.normal(size=(images, side, side))) / wave * (wave < 0.25), s=(side, side))
    img = np.clip(128 + 45 * (img - img.mean((1, 2), keepdims=True)) / img.std((1, 2), keepdims=True), 0, 255).astype(np.float32)
    p = rng.uniform(-1, 1, (3 * tried, 4)) * (RADIUS - 1)
    fits = (np.hypot(p[:, 0], p[:, 1]) < RADIUS - 1) & (np.hypot(p[:, 2], p[:, 3]) < RADIUS - 1) & (np.hypot(p[:, 0] - p[:, 2], p[:, 1] - p[:, 3]) > 3)
    p = p[fits][:tried]
    soft = _box(img, 1)
    i, y, x = corners(img)
    bit = _answers(soft, i, y, x, _orientations(soft, i, y, x), p).astype(np.float32)
    even, z = np.abs(bit.mean(0) - 0.5), (bit - bit.mean(0)) / np.maximum(bit.std(0), 1e-3)
    alike = np.abs(z.T @ z / len(z))
    worst, free, taken, most = np.zeros(len(p)), np.ones(len(p), bool), [], 0.2
    while len(taken) < BITS:
        for j in np.argsort(even, kind="stable").tolist():
            if free[j] and worst[j] < most and len(taken) < BITS:
                taken.append(j)
                free[j] = False
                worst = np.maximum(worst, alike[j])
        most += 0.03
    return p[taken]


@lru_cache(1)
def key_bits(seed: int = 6) -> np.ndarray:
    """The bits (TABLES, KEY_BITS) that make the keys of a code: tables share as few as they can."""
    rng = np.random.default_rng(seed)
    deal = np.concatenate([rng.permutation(BITS) for _ in range(-(-TABLES * KEY_BITS // BITS) + 1)])
    out = []
    for _ in range(TABLES):
        _, first = np.unique(deal, return_index=True)
        take = np.sort(first)[:KEY_BITS]
        out.append(np.sort(deal[take]))
        deal = np.delete(deal, take)
    return np.array(out)


def describe(img: np.ndarray) -> dict[str, np.ndarray]:
    """Descriptors of equally large grey images (n, h, w): image, x, y (in pixels
    of the finest level), level (LEVELS an octave), turn (of TURNS) and code (bits)."""
    found = {k: [] for k in ("image", "x", "y", "level", "turn", "code")}
    octave = img.astype(np.float32)
    n = len(img)
    for level in range(256):
        h, w = octave.shape[1:]
        small = 2 ** (level % LEVELS / LEVELS)
        level_img = _shrunk(octave, (round(h / small), round(w / small))) if level % LEVELS else octave
        if min(level_img.shape[1:]) <= 2 * RADIUS + 4:
            break
        i, y, x = corners(level_img)
        # pixels of the finest level; octaves drop an odd last row or column
        down, across = (2 ** (level // LEVELS) * a / b for a, b in zip((h, w), level_img.shape[1:]))
        if len(i):
            soft = _box(level_img, 1)
            angle = _orientations(soft, i, y, x)
            code = _answers(soft, i, y, x, angle, chosen_tests())
            turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            for k, v in (("image", i), ("x", (x + 0.5) * across - 0.5), ("y", (y + 0.5) * down - 0.5), ("level", np.full(len(i), level)), ("turn", turn), ("code", code)):
                found[k].append(v)
        if level % LEVELS < LEVELS - 1:
            continue
        h, w = h // 2 * 2, w // 2 * 2
        octave = octave[:, :h, :w].reshape(n, h // 2, 2, w // 2, 2).mean((2, 4))
    return {k: np.concatenate(v) if v else np.zeros((0, BITS) if k == "code" else 0, np.int64) for k, v in found.items()}


def keys_of(bits: np.ndarray) -> np.ndarray:
    """Keys (descriptor, table) of codes: the table's bits, and its number above them."""
    out = np.zeros((len(bits), TABLES, 8), np.uint8)
    for t, some in enumerate(key_bits()):
        out[:, t, :KEY_BITS // 8], out[:, t, 7] = np.packbits(bits[:, some], axis=1), t
    return out.view("<i8")[:, :, 0]


#: A descriptor as it travels: position (eighths of a pixel), level, turn and code.
POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("level", "u1"), ("turn", "u1"), ("code", "<u8", BITS // 64)])
PIXELS = 4 << 20


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows of at most 256 rows and about ``most`` bytes."""
    begin = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most or i - begin == 255 or i == len(sizes) - 1:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0


def local_descriptors(images: DataFrame) -> DataFrame:
    """(node, points binary, keys array<long>) of images (node, width, height,
    pixels) that have descriptors: an array of POINT, and TABLES keys of each point."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for run in _runs([len(p.as_buffer()) if p.is_valid else 0 for p in whole.column(3)], PIXELS):
                batch = whole.slice(run.start, run.stop - run.start)
                by_size: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
                for i, (w, h, p) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                    if p is not None and w and h and len(p) == w * h:
                        by_size.setdefault((h, w), []).append((i, p))
                at, points, keys = [], [], []
                for (h, w), group in by_size.items():
                    d = describe(np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for _, p in group]))
                    own = np.zeros(len(d["x"]), POINT)
                    own["code"] = np.ascontiguousarray(np.packbits(d["code"].astype(bool), axis=1)).view("<u8")
                    for c in ("level", "turn"):
                        own[c] = d[c]
                    for c in ("x", "y"):
                        own[c] = np.rint(8 * d[c])
                    table = keys_of(d["code"].astype(bool))
                    order = np.argsort(d["image"], kind="stable")
                    for (i, _), part in zip(group, np.split(order, np.searchsorted(d["image"][order], np.arange(1, len(group))))):
                        if len(part):
                            at.append(i)
                            points.append(own[part].tobytes())
                            keys.append(table[part].ravel())
                if at:
                    ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(points, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))], ["node", "points", "keys"])

    return images.select("node", "width", "height", "pixels").mapInArrow(work, "node long, points binary, keys array<long>")


def _under_keys(batches: Iterator[pa.RecordBatch], *more: str) -> list[np.ndarray] | None:
    """Columns key, node, corner and ``more`` of rows dealt by key, in this order, an image once under a key."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    columns = [pa.Table.from_batches(held).column(x).to_numpy() for x in ("key", "node", "corner", *more)]
    order = np.lexsort(columns[2::-1])
    columns = [c[order] for c in columns]
    key, node = columns[:2]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    return [c[new] for c in columns]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of its group, first row of its group, size of its group) of each row of sorted keys."""
    begin = np.ones(len(key), bool)
    begin[1:] = key[1:] != key[:-1]
    group, first = np.cumsum(begin) - 1, np.flatnonzero(begin)
    return group, first[group], np.diff(np.append(first, len(key)))[group]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, i, j) of images a > b that share a key, and their corners under it, of
    rows (key, node, corner) dealt by key."""
    for batch in _meetings_and_many(batches):
        if not batch.column(1).null_count:
            yield batch.select(["a", "b", "i", "j"])


def _meetings_and_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with a column key of nulls, and for each image under a key of more than
    BUCKET (a, i, key) without b and j, in batches of their own."""
    columns = _under_keys(batches)
    if columns is None:
        return
    key, node, corner = columns
    _, first, size = _groups(key)
    names = ["a", "b", "i", "j", "key"]
    many = np.flatnonzero(size > BUCKET)
    for k in range(0, len(many), ACROSS):
        x = many[k:k + ACROSS]
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.nulls(len(x), pa.int64()), pa.array(corner[x]), pa.nulls(len(x), pa.int32()), pa.array(key[x])], names)
    place = np.arange(len(key)) - first
    for d in range(1, BUCKET):  # few images: each with each; of many: with the leaders, those of the least numbers
        x = np.flatnonzero((place >= d) & ((size <= BUCKET) | (d <= LEADERS)))
        y = np.where(size[x] <= BUCKET, x - d, first[x] + d - 1)
        if len(x):
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (node[x], node[y], corner[x], corner[y])), pa.nulls(len(x), pa.int64())], names)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, i, j, hot) of all images a > b that share a key, but not their class so far,
    of rows (key, node, corner, component) dealt by key; hot: more than BUCKET share it."""
    columns = _under_keys(batches, "component")
    if columns is None:
        return
    order = np.lexsort((columns[1], columns[3], columns[0]))
    key, node, corner, component = (c[order] for c in columns)
    _, first, size = _groups(key)
    begin = np.ones(len(key), bool)
    begin[1:] = (key[1:] != key[:-1]) | (component[1:] != component[:-1])
    behind = np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0)) - first  # images of other classes that stand before
    ends = np.cumsum(behind)
    at = 0
    while at < len(key):  # about ACROSS pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ACROSS, "right")))
        n = behind[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        swap = node[x] < node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[x], node[y], corner[x], corner[y], size[x] > BUCKET)], ["a", "b", "i", "j", "hot"])
        at = to


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, nodes, corners) of keys that two images at least share, of rows (key, node, corner) dealt by key."""
    columns = _under_keys(batches)
    if columns is None:
        return
    _, first, size = _groups(columns[0])
    key, node, corner = (c[size > 1] for c in columns)
    begin = np.flatnonzero(np.arange(len(size)) == first)
    ends = np.append(0, np.cumsum(size[begin][size[begin] > 1]))
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ACROSS, "right")) - 1)
        offsets, part = pa.array(ends[at:to + 1] - ends[at], pa.int32()), slice(ends[at], ends[to])
        yield pa.RecordBatch.from_arrays([pa.array(key[ends[at:to]]), *(pa.ListArray.from_arrays(offsets, pa.array(c[part])) for c in (node, corner))], ["key", "nodes", "corners"])
        at = to


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, corner, size) of rows (key, nodes, corners)."""
    for batch in batches:
        size = np.diff(batch.column(1).offsets.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), batch.column(1).flatten(), batch.column(2).flatten(), pa.array(np.repeat(size, size))], ["key", "node", "corner", "size"])


def _meetings_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _flat(batches):
        yield from _meetings([batch])


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, component, ...) dealt by key, of keys under which several components stand."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    key, component = (table.column(c).to_numpy() for c in ("key", "component"))
    order = np.lexsort((component, key))
    _, first, size = _groups(key[order])
    several = component[order][first] != component[order][first + size - 1]
    yield from table.take(pa.array(order[several])).to_batches(ACROSS)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, node, component, others) of rows (key, node, corner, size, component)
    dealt by node: for each key of many (of a size over 0) 32 bits of each key that the
    image has at another corner; parts of larger keys share these out by their bits."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    columns = [table.column(c).to_numpy() for c in ("node", "key", "corner", "size", "component")]
    order = np.argsort(columns[0], kind="stable")
    node, key, corner, size, component = (c[order] for c in columns)
    bits = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")
    _, first, count = _groups(node)
    out, n = [], 0
    for x in np.flatnonzero(size > 0).tolist():
        own = slice(first[x], first[x] + count[x])
        others = bits[own][corner[own] != corner[x]]
        parts = 1 + int(size[x]) // SPLIT
        for part in range(parts):
            some = others if parts == 1 else others[others % parts == part]
            if len(some):
                out.append((x, part, some.tobytes()))
                n += len(some)
        if n >= HELD or x == len(size) - 1:
            yield from _rows_beside(out, key, node, component)
            out, n = [], 0
    yield from _rows_beside(out, key, node, component)


def _rows_beside(out: list[tuple[int, int, bytes]], key: np.ndarray, node: np.ndarray, component: np.ndarray) -> Iterator[pa.RecordBatch]:
    if out:
        x, part, others = zip(*out)
        x = list(x)
        yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(part, pa.int32()), pa.array(node[x]), pa.array(component[x]), pa.array(others, pa.binary())], ["key", "part", "node", "component", "others"])


def _across_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of images a > b of different components that share a key of many and
    one beside it, of the rows of _beside dealt by key and part."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    key, part, node, component = (table.column(c).to_numpy() for c in ("key", "part", "node", "component"))
    order = np.lexsort((part, key))
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(part[order]) != 0)
    group = np.cumsum(new) - 1
    others = table.column("others").take(pa.array(order)).combine_chunks()
    others = others.chunk(0) if isinstance(others, pa.ChunkedArray) else others
    ends = np.append(0, np.cumsum([len(x.as_buffer()) // 4 for x in others]))
    begins = np.append(np.flatnonzero(new), len(key))
    at = 0
    while at < len(begins) - 1:  # whole groups, of about HELD other keys at a time
        to = max(at + 1, int(np.searchsorted(ends[begins], ends[begins[at]] + HELD, "right")) - 1)
        rows = slice(begins[at], begins[to])
        n = np.diff(ends[rows.start:rows.stop + 1])
        bits = np.frombuffer(b"".join(others[rows.start:rows.stop].to_pylist()), "<u4").astype(np.int64)
        both = np.repeat(group[rows] - at, n) << 32 | bits
        x = np.repeat(order[rows], n)
        meet = pa.RecordBatch.from_arrays([pa.array(c) for c in (both, node[x], np.zeros(len(x), np.int32), component[x])], ["key", "node", "corner", "component"])
        for found in _across([meet]):
            yield found.select(["a", "b"])
        at = to


def agreement(i: np.ndarray, j: np.ndarray, enough: int | None = None) -> int:
    """The most matched points i, j of two images that agree on one similarity transform;
    if so many are ``enough``, that many at least.

    Each match proposes its turn and scale; matches of a near turn and the same
    or a neighbouring scale that lie roughly there fit the transform, and count
    if they lie within NEAR of it.
    """
    zi, zj = (i["x"] + 1j * i["y"]) / 8, (j["x"] + 1j * j["y"]) / 8
    turn, step = (j["turn"].astype(int) - i["turn"]) % TURNS, j["level"].astype(int) - i["level"]
    own = 2 ** (step / LEVELS) * np.exp(2j * np.pi * turn / TURNS)
    # a corner stands on several levels: places count, by cells of APART pixels
    point, other = ((k["x"].astype(np.int64) // (8 * APART)) << 32 | (k["y"].astype(np.int64) // (8 * APART)) for k in (i, j))
    best = 0
    few = 0 if enough is None else 8  # most links show in the first proposals
    for k, to in ((0, few), *((k, k + 256) for k in range(few, len(i), 256))):
        if enough is not None and best >= enough:
            break
        part = slice(k, to)
        d = np.abs((turn[part, None] - turn + TURNS // 2) % TURNS - TURNS // 2)
        alike = (d <= TURN_SPREAD) & (np.abs(step[part, None] - step) <= LEVEL_SPREAD)
        di = zi - zi[part, None]
        a = own[part]
        near = alike & (np.abs(zj - zj[part, None] - a[:, None] * di) <= 2 * NEAR + 0.3 * np.abs(a[:, None] * di))
        for _ in range(3):
            n = np.maximum(near.sum(1), 1)
            mi, mj = (near * zi).sum(1) / n, (near * zj).sum(1) / n
            ci, cj = (zi - mi[:, None]) * near, (zj - mj[:, None]) * near
            fit = (np.conj(ci) * cj).sum(1) / np.maximum((np.abs(ci) ** 2).sum(1), 1e-9)
            # a fit far from its proposal rests on points too close together
            a = np.where(np.abs(fit / own[part] - 1) <= 0.5, fit, own[part])
            near = alike & (np.abs(zj - mj[:, None] - a[:, None] * (zi - mi[:, None])) <= NEAR * np.maximum(1, np.abs(a[:, None])))
        for row in np.unique(near[near.sum(1) > best], axis=0):
            best = max(best, min(len(np.unique(point[row])), len(np.unique(other[row]))))
    return best


def consent(p: np.ndarray, q: np.ndarray, enough: int | None = None) -> int:
    """How many matches of the points of two images agree on one transform; if so many
    are ``enough``, that many at least."""
    found = []
    for k in range(0, len(p), step := max(1, PAIRS // max(1, len(q)))):
        i, j = np.nonzero(sum(np.bitwise_count(p["code"][k:k + step, None, w] ^ q["code"][None, :, w]) for w in range(BITS // 64)) <= DISTANCE)
        found.append((i + k, j))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
    if len(i) < CONSENT:
        return 0
    turn, level = (q["turn"][j].astype(int) - p["turn"][i]) % TURNS, q["level"][j].astype(int) - p["level"][i]
    keep = _near_turns(turn, level) >= CONSENT
    return agreement(p[i[keep]], q[j[keep]], enough) if keep.any() else 0


def _near_turns(turn: np.ndarray, level: np.ndarray) -> np.ndarray:
    """How many matches have a turn and scale near to that of each."""
    if len(turn) <= 512:
        off = np.abs((turn[:, None] - turn + TURNS // 2) % TURNS - TURNS // 2)
        return ((off <= TURN_SPREAD) & (np.abs(level[:, None] - level) <= LEVEL_SPREAD)).sum(1)
    cells = np.zeros((TURNS + 2 * TURN_SPREAD + 1, 513 + LEVEL_SPREAD), np.int64)
    np.add.at(cells, (turn + TURN_SPREAD + 1, level + 256), 1)
    cells[:TURN_SPREAD + 1] = cells[TURNS:TURNS + TURN_SPREAD + 1]
    cells[TURNS + TURN_SPREAD + 1:] = cells[TURN_SPREAD + 1:2 * TURN_SPREAD + 1]
    total = np.cumsum(cells, axis=0)
    around = total[2 * TURN_SPREAD + 1:] - total[:-2 * TURN_SPREAD - 1]
    return sum(around[turn, level + 256 + d] for d in range(-LEVEL_SPREAD, LEVEL_SPREAD + 1))


def _confirmed(batches: Iterator[pa.RecordBatch], enough: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [consent(np.frombuffer(p, POINT), np.frombuffer(q, POINT), enough) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int32())], ["a", "b", "matches"])


def _by_key(found: DataFrame) -> DataFrame:
    rows = found.select("node", F.posexplode("keys").alias("at", "key"))
    return rows.select("key", "node", F.floor(F.col("at") / TABLES).cast("int").alias("corner"))


def _two_corners(met: DataFrame) -> DataFrame:
    counts = met.groupBy("a", "b").agg(F.min("i").alias("i"), F.max("i").alias("i2"), F.min("j").alias("j"), F.max("j").alias("j2"))
    return counts.where("i < i2 and j < j2").select("a", "b")


def shared_keys(found: DataFrame) -> DataFrame:
    """(key, nodes, corners) of keys that two images at least share: the only time that all keys are shuffled."""
    return _by_key(found).repartition("key").mapInArrow(_shared, "key long, nodes array<long>, corners array<int>")


def _candidates(shared: DataFrame) -> DataFrame:
    return _two_corners(shared.mapInArrow(_meetings_of_groups, "a long, b long, i int, j int"))


def candidate_pairs(found: DataFrame) -> DataFrame:
    """(a, b) of images that share keys of two different corners of each."""
    return _candidates(shared_keys(found))


def _consenting(pairs: DataFrame, points: DataFrame, enough: int | None = None) -> DataFrame:
    sides = pairs.join(points.toDF("b", "q"), "b").join(points.toDF("a", "p"), "a").select("a", "b", "p", "q")
    return sides.mapInArrow(lambda batches: _confirmed(batches, enough), "a long, b long, matches int").where(F.col("matches") >= CONSENT)


def linked_pairs(found: DataFrame) -> DataFrame:
    """(a, b, matches) of images with consenting matches."""
    return _consenting(candidate_pairs(found), found.select("node", "points"))


def pairs_across(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b), some repeatedly, of images of different components that share a key of
    more than BUCKET images and a second key, of different corners of each.

    Each image of a key of many meets the others under pairs of keys, so rows are those
    of such keys times the shared keys of an image, and not pairs of their images."""
    rows = shared.where(F.size("nodes") > BUCKET).mapInArrow(_flat, "key long, node long, corner int, size int")
    of_image = rows.groupBy("node").agg(F.collect_list(F.struct("key", "corner", "size")).alias("rows")).join(labels, "node", "left")
    rows = of_image.select("node", F.coalesce("component", "node").alias("component"), F.inline("rows")).select("key", "node", "corner", "size", "component")
    hot = rows.repartition("key").mapInArrow(_of_several, rows.schema)
    few = shared.where(F.size("nodes") <= BUCKET).mapInArrow(_flat, "key long, node long, corner int, size int")
    every = hot.unionByName(few.select("key", "node", "corner", F.lit(0).alias("size"), F.lit(0).cast("long").alias("component")))
    beside = every.repartition("node").mapInArrow(_beside, "key long, part int, node long, component long, others binary")
    return beside.repartition("key", "part").mapInArrow(_across_two, "a long, b long")


def links(found: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(a, b) of links that make the classes which all pairs that share two keys would
    make: those of small keys and leaders, then of all pairs under keys of many images
    that these leave in different classes.  points: those of found, if read elsewhere."""
    points = found.select("node", "points") if points is None else points
    shared = _kept(shared_keys(found), "shared")
    tried = _kept(_candidates(shared), "candidates")
    # the classes need no link between images that others join: one pair of each image is compared first
    first = tried.groupBy("a").agg(F.min("b").alias("b"))
    trees = _kept(_consenting(first, points, CONSENT).select("a", "b"), "links")
    labels = connected_components(trees, "a", "b")
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class"))
    rest = tried.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("a_class", "a") != F.coalesce("b_class", "b")).select("a", "b")
    near = trees.unionByName(_kept(_consenting(rest, points, CONSENT).select("a", "b"), "links"))
    labels = connected_components(near, "a", "b")
    apart = _kept(pairs_across(shared, labels).distinct().join(tried, ["a", "b"], "left_anti"), "apart")
    discard(tried, shared)
    far = _kept(_consenting(apart, points, CONSENT).select("a", "b"), "links")
    discard(apart)
    return near.unionByName(far)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``written``; what it has shuffled leaves the disk at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def _keyed(points: DataFrame) -> DataFrame:
    """(node, points, keys) of written (node, points): keys follow from the codes, so they aren't stored."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(p.as_buffer()) // POINT.itemsize for p in batch.column(1)]
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), POINT)["code"]
            bits = np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1).astype(bool)
            ends = TABLES * np.append(0, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys_of(bits).ravel()))], ["node", "points", "keys"])

    return points.mapInArrow(work, "node long, points binary, keys array<long>")


def copy_classes(images: DataFrame, *, id_col: str = "image_id") -> DataFrame:
    """(id, class_id) of every image: the least id of its class of copies."""
    base = images.select(F.col(f"`{id_col}`").alias(id_col), "width", "height", "pixels").withColumn(
        "node", F.when(F.col("pixels").isNotNull(), F.xxhash64("width", "height", F.sha2("pixels", 256))))
    names = written(base.select(id_col, "node"), "names")
    one = names.where("node is not null").groupBy("node").agg(F.min(id_col).alias("least"))
    # images stay where they are: of equal ones only that with the least id is described
    again = names.join(one, "node").where(F.col(id_col) > F.col("least")).select(F.col(id_col).alias("__id"), F.col("node").alias("__node")).distinct()
    if again.count() <= BROADCAST_IDS:
        again = F.broadcast(again)
    first = base.where("node is not null").join(again, (F.col(id_col) == F.col("__id")) & (F.col("node") == F.col("__node")), "left_anti")
    points = _kept(local_descriptors(first).select("node", "points"), "descriptors")
    labels = connected_components(links(_keyed(points), points), "a", "b")
    discard(points)
    named = one.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("least").alias("class_id"))
    by_node = named.join(low, "component").select("node", "class_id")
    return names.join(by_node, "node", "left").select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"))


# ---- the media column of the query --------------------------------------------

SIDE = 72


@lru_cache(8)
def _grid(dims: int, cells: int) -> np.ndarray:
    return np.random.default_rng((dims, cells)).normal(size=((cells + 1) ** 2, dims))


def render(vector: np.ndarray) -> np.ndarray:
    """A grey texture drawn from a vector (two octaves of noise); near vectors give near textures."""
    v = np.asarray(vector, np.float64)
    v = np.where(np.isfinite(v), v, 0)
    v = v / max(np.linalg.norm(v), 1e-12)
    out = np.zeros((SIDE, SIDE))
    for cells, weight in ((12, 0.65), (24, 0.35)):
        grid = (_grid(len(v), cells) @ v).reshape(cells + 1, cells + 1)
        at = np.arange(SIDE) * cells / SIDE
        i = at.astype(int)
        f = at - i
        rows = grid[i] * (1 - f)[:, None] + grid[i + 1] * f[:, None]
        out += weight * (rows[:, i] * (1 - f) + rows[:, i + 1] * f)
    return np.clip(128 + 75 * out, 0, 255).astype(np.uint8)


def warped(img: np.ndarray, degrees: float, scale: float) -> np.ndarray:
    """Turned about the middle and rescaled, cut to what the image covers."""
    h, w = img.shape
    a = np.deg2rad(degrees)
    ratio = 1 / (abs(np.cos(a)) + abs(np.sin(a)))
    n, m = int(h * scale * ratio), int(w * scale * ratio)
    y, x = np.mgrid[:n, :m]
    y, x = (y - (n - 1) / 2) / scale, (x - (m - 1) / 2) / scale
    at = np.zeros(y.shape, int), np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.cos(a) * x + np.sin(a) * y + (w - 1) / 2
    return np.rint(_between(img[None].astype(np.float32), *at)).astype(np.uint8)


def edited(img: np.ndarray, kind: int, seed: int = 0) -> np.ndarray:
    """1: a cropped copy; 2: one with other contrast, and a covered corner; 3: one
    turned by any angle and rescaled by 0.75 to 1.5, with noise."""
    if kind == 1:
        return img[6:66, 9:69]
    if kind == 2:
        out = np.clip(img.astype(np.float64) * 0.8 + 30, 0, 255).astype(np.uint8)
        out[:18, :18] = 255
        return out
    rng = np.random.default_rng(seed)
    out = warped(img, rng.uniform(-20, 20) + 90 * rng.integers(4), rng.uniform(0.75, 1.5))
    return np.clip(out + rng.normal(0, 4, out.shape), 0, 255).astype(np.uint8)


def media(vectors: DataFrame) -> DataFrame:
    """(image_id, width, height, pixels): an image of each vector, ids 4 * vec_id;
    of every tenth also a cropped copy (+ 1), of every tenth an edited one (+ 2),
    of every tenth a turned and rescaled one (+ 3)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                out = []
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    img = render(np.array(v, np.float32)) if v else None
                    for kind in (0, {3: 1, 7: 2, 9: 3}.get(i % 10, 0)) if i % 10 in (3, 7, 9) else (0,):
                        own = img if img is None or not kind else edited(img, kind, i)
                        out.append((4 * i + kind, own.shape[1] if own is not None else 0, own.shape[0] if own is not None else 0, None if own is None else own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["image_id", "width", "height", "pixels"])

    return vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(work, "image_id long, width int, height int, pixels binary")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_classes(media(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
