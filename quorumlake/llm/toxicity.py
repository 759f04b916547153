"""Toxicity from a subsequence string kernel.

Words are compared by the gap-weighted subsequence kernel, normalised, so that insults
with gaps, inserted, doubled or missing characters still come close.  The Nyström rule
maps a word's kernel values with the landmarks, insults and the clean words most like
them, by the inverse root of the landmarks' own Gram matrix, and a linear support
vector machine decides on the mapped word.  It is a machine of many instances: a text
is as toxic as its most toxic word, clean texts give only clean words, and the words
that tell toxic texts are found with the machine, in rounds.  Altered copies of them
(a letter put in, doubled, left out, or others between all) stand beside them in the
fit.  A logistic link makes probabilities.  A word that has not all characters of an
insult in order, or all but one, is no witness.

Landmarks and weights come from a bounded sample of labelled rows; scoring is one pass
over all rows with no shuffle.

Defined results: null and empty texts are scored like a text without words;
ids, language and source are no inputs; repeated rows get equal scores; a null id is
not held out; without labelled rows of both classes every score is 0; an empty table
gives no rows.  Words of any length count (long ones in overlapping windows), texts are
read whole.  Other columns are kept as they are; a column with the name of the score is
replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.mixing import free_name

#: Characters of a common subsequence.
ORDER = 3
#: Kernels: weight of each step that a subsequence spans, and for each number of its characters the shares of a
#: word's own kernel that its values are divided by.  The first likes letters side by side, the others letters
#: apart; with a small share what stands between them does not count against a word.
KERNELS = ((0.6, {3: (1.0,)}), (0.95, {3: (0.3,), 4: (1.0, 0.3)}))
#: Words that are mapped at once, and words whose kernels are summed at once.
ROWS = 2000
BLOCK_WORDS = 64
#: Insults, clean words beside them as landmarks, and cost of a margin's loss.
LANDMARKS, COUNTER, COST = 48, 48, 300.0
#: Margin of a text without a witness.
FLOOR = -2.0
WINDOW, STRIDE = 32, 16
#: Weight of a word's altered copies beside its own.
COPIES = 8.0
#: Share of the toxic texts that have a word, if its altered copies count.
COPY_SHARE = 0.03
#: Weight of clean texts, beside their share, in the logistic link.
STRICT = 0.3
#: A worker's words are forgotten beyond so many.
CACHE_WORDS = 200_000
#: Bounds of the sample that the classifier is fitted on: rows of each class, and bytes of a text in it (96 MB in all).
TRAIN_ROWS, TRAIN_TEXT_BYTES = 3000, 16_000

def plain(word: str) -> str:
    """A lower-case word's letters and digits."""
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def _codes(words: list[str], width: int) -> np.ndarray:
    """Characters of words as a padded array."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width)


def subsequence_kernels(words: np.ndarray, others: np.ndarray, orders: tuple[int, ...], decay: float) -> list[np.ndarray]:
    """Gap-weighted subsequence kernels of padded words with padded other strings, all
    with all, over common subsequences of so many characters each."""
    n, width, m, top = len(words), others.shape[1], len(others), max(orders)
    one = np.float32(decay)
    out = [np.zeros((n, m), np.float32) for _ in orders]
    letters = np.where(others > 0, others, np.uint32(0xFFFFFFFF)).T
    for begin in range(0, n, BLOCK_WORDS):
        part = words[begin:begin + BLOCK_WORDS]
        # sums over subsequences, by their length and the beginning of the other string
        prime = np.zeros((top, width + 1, len(part), m), np.float32)
        prime[0] = 1
        for p in range(part.shape[1]):
            x = part[:, p]
            if not x.any():
                break
            same = (x[None, :, None] == letters[:, None, :]).astype(np.float32) * (one * one)
            for k, order in enumerate(orders):
                out[k][begin:begin + BLOCK_WORDS] += np.einsum("jnm,jnm->nm", same, prime[order - 1, :width])
            for i in range(top - 1, 0, -1):
                step = same * prime[i - 1, :width]
                for j in range(1, width):
                    step[j] += one * step[j - 1]
                prime[i, 1:] *= one
                prime[i, 1:] += step
    return out


def own_kernels(words: np.ndarray, orders: tuple[int, ...], decay: float) -> list[np.ndarray]:
    """The kernels of padded words each with itself."""
    n, width, top = len(words), words.shape[1], max(orders)
    one = np.float32(decay)
    out = [np.zeros(n, np.float32) for _ in orders]
    prime = np.zeros((top, width + 1, n), np.float32)
    prime[0] = 1
    for p in range(width):
        same = ((words[:, p] == words.T) & (words.T > 0)).astype(np.float32) * (one * one)
        for k, order in enumerate(orders):
            out[k] += (same * prime[order - 1, :width]).sum(axis=0)
        for i in range(top - 1, 0, -1):
            step = same * prime[i - 1, :width]
            for j in range(1, width):
                step[j] += one * step[j - 1]
            prime[i, 1:] = one * prime[i, 1:] + step
    return out


def common_in_order(words: np.ndarray, landmark: str) -> np.ndarray:
    """Length of the longest common subsequence, bits in parallel."""
    full = np.uint64(2 ** len(landmark) - 1)
    v = np.full(len(words), full, np.uint64)
    place: dict[int, int] = {}
    for i, c in enumerate(landmark):
        place[ord(c)] = place.get(ord(c), 0) | 1 << i
    for p in range(words.shape[1]):
        x = words[:, p]
        m = np.zeros(len(words), np.uint64)
        for c, bits in place.items():
            m[x == c] = bits
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(landmark) - np.bitwise_count(v)


class Landmarks:
    """The map of words by their kernel values with the landmarks, of which the first
    are insults; words met before are kept."""

    def __init__(self, insults: list[str], clean: list[str] | None = None):
        self.insults = insults
        self.z = [*insults, *(clean or [])]
        self.codes = _codes(self.z, max(map(len, self.z)))
        self.own = [[np.maximum(k, 1e-12) for k in own_kernels(self.codes, tuple(by), decay)] for decay, by in KERNELS]
        self.root = []
        for gram in self.kernel(self.codes):
            values, vectors = np.linalg.eigh((gram + gram.T) / 2)
            keep = values > 1e-6 * values.max()
            self.root.append(vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T)
        self.w, self.bias = np.zeros(sum(r.shape[1] for r in self.root)), FLOOR
        self._forget()

    def _forget(self) -> None:
        #: word: its margin; NaN if it is no witness, -inf if a single character
        self.known: dict[str, float] = {}

    def decide(self, w: np.ndarray, bias: float) -> None:
        """Use these weights from now on."""
        self.w, self.bias = w, bias
        self._forget()

    def kernel(self, codes: np.ndarray) -> list[np.ndarray]:
        """The kernels of padded words with each landmark, scaled so that a landmark's with itself is of the order of 1."""
        out = []
        for (decay, by), mine in zip(KERNELS, self.own):
            raw, own = subsequence_kernels(codes, self.codes, tuple(by), decay), own_kernels(codes, tuple(by), decay)
            for r, o, z, shares in zip(raw, own, mine, by.values()):
                for share in shares:
                    typical = np.exp(np.log(z.astype(np.float64)).mean()) ** (1 - share)
                    out.append(r / (np.maximum(o, 1e-12)[:, None] * z).astype(np.float64) ** (share / 2) / typical)
        return out

    def features(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.w)), np.float32)
        for i in range(0, len(codes), ROWS):
            out[i:i + ROWS] = np.hstack([k @ root for k, root in zip(self.kernel(codes[i:i + ROWS]), self.root)])
        return out

    def likeness(self, words: list[str]) -> np.ndarray:
        """The greatest kernel value of words with an insult, over all kernels."""
        out = np.empty(len(words))
        for i in range(0, len(words), ROWS):
            out[i:i + ROWS] = sum(k[:, :len(self.insults)].max(axis=1) for k in self.kernel(_codes(words[i:i + ROWS], WINDOW)))
        return out

    def witnesses(self, codes: np.ndarray) -> np.ndarray:
        """Which padded words have the characters of an insult in order, all but one at least, and four."""
        bit = np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << (codes % 61).astype(np.uint64), np.uint64(0)), axis=1)
        out = np.zeros(len(codes), bool)
        for z in self.insults:
            need = np.uint64(sum(1 << b for b in {ord(c) % 61 for c in z}))
            at = np.flatnonzero(~out & (np.bitwise_count(need & ~bit) <= 1))
            out[at[common_in_order(codes[at], z) >= min(len(z), max(4, len(z) - 1))]] = True
        return out

    def mapped(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which words, of ORDER to WINDOW characters, are witnesses, the map of those)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        at, maps = [], []
        for low, high in ((ORDER - 1, 6), (6, 9), (9, 12), (12, 18), (18, WINDOW)):
            group = np.flatnonzero((size > low) & (size <= high))
            if not len(group):
                continue
            codes = _codes([words[i] for i in group], high)
            some = np.flatnonzero(self.witnesses(codes))
            if len(some):
                at.append(group[some])
                maps.append(self.features(codes[some]))
        if not at:
            return np.empty(0, np.int64), np.empty((0, len(self.w)), np.float32)
        return np.concatenate(at), np.concatenate(maps)

    def learn(self, raw: list[str]) -> None:
        strings, owner = [], []
        for r in raw:
            w = plain(r)
            if len(w) <= 1:
                self.known[r] = -np.inf if len(r) <= 2 and len(w) == 1 else np.nan
                continue
            self.known[r] = np.nan
            for part in windows(w):
                strings.append(part)
                owner.append(r)
        at, x = self.mapped(strings)
        margin = x @ self.w + self.bias
        for i, m in zip(at.tolist(), margin.tolist()):
            r = owner[i]
            if not self.known[r] >= m:
                self.known[r] = m

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margin of each text: that of its most toxic word."""
        split = [t.lower().split() for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self._forget()
                new = set().union(*split)
            self.learn(sorted(new))
        out = np.full(len(texts), FLOOR)
        find = self.known.__getitem__
        for k, words in enumerate(split):
            at = np.fromiter(map(find, words), np.float64, len(words))
            apart = [p for run in apart_letters(words, at == -np.inf) for p in windows(run)]
            best = np.nanmax(at, initial=FLOOR)
            if apart:
                _, x = self.mapped(apart)
                best = max(best, (x @ self.w + self.bias).max(initial=FLOOR))
            out[k] = best
        return out


def windows(word: str) -> list[str]:
    """A word, or the overlapping windows of a long one."""
    return [word] if len(word) <= WINDOW else [word[i:i + WINDOW] for i in range(0, len(word) - STRIDE, STRIDE)]


def apart_letters(words: list[str], single: np.ndarray) -> list[str]:
    """Runs of ORDER or more single letters, as words."""
    if single.sum() < ORDER:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
    return [plain("".join(words[a:b])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= ORDER]


def altered(word: str, letters: str = "xqzkeaonit") -> set[str]:
    """Copies of a word with a letter put in, doubled, left out or swapped with the
    next, and with one letter, or changing ones, between all."""
    out = set()
    for i in range(len(word) + 1):
        out.add(word[:i] + letters[i % len(letters)] + word[i:])
        if i < len(word):
            out.add(word[:i] + word[i] + word[i:])
            if len(word) > 4:
                out.add(word[:i] + word[i + 1:])
        if 0 < i < len(word):
            out.add(word[:i - 1] + word[i] + word[i - 1] + word[i + 1:])
    for k in range(len(letters)):
        out.add(letters[k].join(word))
        out.add("".join(c + letters[(k + 3 * i) % len(letters)] for i, c in enumerate(word))[:-1])
    return {w for w in out if len(w) <= WINDOW} - {word}


def choose_landmarks(texts: list[str], toxic: np.ndarray, clean_weight: float, limit: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that tell toxic texts, each taken for the texts
    that those before it cover least."""
    def found(text: str) -> set[str]:
        out = set()
        for w in {plain(r) for r in text.lower().split()}:
            if ORDER <= len(w) <= WINDOW:
                out.update(w[:n] for n in range(4, min(8, len(w)) + 1))
                if len(w) <= 12:
                    out.add(w)
        return out

    docs: dict[str, list[int]] = {}
    for k in np.flatnonzero(toxic).tolist():
        for f in found(texts[k]):
            docs.setdefault(f, []).append(k)
    floor = max(2, int(toxic.sum()) // 150)
    docs = {f: at for f, at in docs.items() if len(at) >= floor}
    clean: Counter = Counter()
    for k in np.flatnonzero(toxic == 0).tolist():
        clean.update(found(texts[k]) & docs.keys())
    scored = {}
    for f, at in docs.items():
        p = len(at) / (len(at) + clean_weight * clean[f])
        if p >= 0.5:
            scored[f] = (p, np.array(at))
    weight, chosen = np.ones(len(texts)), []
    while scored and len(chosen) < limit:
        f = max(scored, key=lambda f: (round(scored[f][0] ** 2 * weight[scored[f][1]].sum(), 9), len(f), f))
        p, at = scored.pop(f)
        if p * p * weight[at].sum() < max(1.0, 0.003 * toxic.sum()):
            break
        chosen.append(f)
        scored = {g: v for g, v in scored.items() if not g.startswith(f) and not f.startswith(g)}
        weight[at] *= 0.6
    return chosen


def fit_svm(x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, start: np.ndarray | None = None, rounds: int = 40) -> np.ndarray:
    """Linear support vector machine (squared hinge) of rows ``at`` of x (-1: a row of
    zeros), by Newton steps over blocks of rows until the rows within the margin stay
    the same; the last value is the bias."""
    s, d = np.where(y > 0, 1.0, -1.0), x.shape[1] + 1
    ridge, w = np.eye(d), np.zeros(d) if start is None else start
    ridge[-1, -1] = 1e-6
    before = None
    for k in range(rounds):
        hess, grad, within = ridge.copy(), np.zeros(d), []
        for i in range(0, len(at), ROWS):
            part = np.ones((len(at[i:i + ROWS]), d))
            part[:, :-1] = x[at[i:i + ROWS]]
            part[at[i:i + ROWS] < 0, :-1] = 0
            on = s[i:i + ROWS] * (part @ w) < 1
            part, c = part[on], cost * weight[i:i + ROWS][on]
            hess += (part.T * c) @ part
            grad += (part.T * c) @ s[i:i + ROWS][on]
            within.append(on)
        within = np.concatenate(within)
        if before is not None and (within == before).all():
            break
        before, new = within, np.linalg.solve(hess, grad)
        w = 0.5 * w + 0.5 * new if k > 15 else new
    return w


def fit_link(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic link from margins to probabilities."""
    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * ((a - 2) ** 2 + b * b))

    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        g = np.array([(r * margin).sum() + 1e-3 * (a - 2), r.sum() + 1e-3 * b])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        d, now = np.linalg.solve(hess, g), loss(a, b)
        step = next((t for t in 0.5 ** np.arange(40) if loss(a - t * d[0], b - t * d[1]) <= now), 0.0)
        a, b = a - step * d[0], b - step * d[1]
        if step * abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_TEXT_BYTES) -> dict | None:
    """Fit on at most ``rows`` labelled texts of each class (those of the least
    MD5 of the id, none of the held-out fold, texts of up to ``text_bytes``)."""
    docs = docs.select(F.col(f"`{id_col}`").alias("__own"), F.col(f"`{text}`").alias("__text"))
    known = labels.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(label).alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & (fold(F.col("__id")) != 0))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    picked = [known.where(f"__y = {y}").orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(rows) for y in (1, 0)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most twice ``rows`` ids
    sample = (docs.join(picked, F.col("__own") == F.col("__id")).where(F.octet_length("__text") <= text_bytes)
              .groupBy("__id").agg(F.first("__y").alias("y"), F.min("__text").alias("t")).toPandas().sort_values("__id"))
    return fit(sample["t"].tolist(), sample["y"].to_numpy().astype(int), counts[0] / counts[1])


def fit(texts: list[str], y: np.ndarray, ratio: float) -> dict | None:
    """The machine of labelled texts; ratio: clean texts per toxic one where they come from."""
    if y.min(initial=1) or not y.max(initial=0):
        return None
    clean_weight = ratio / ((y == 0).sum() / y.sum())
    insults = choose_landmarks(texts, y, clean_weight)
    if not insults:
        return None
    bags, shared = [], {}
    for t in texts:
        words = t.lower().split()
        bare = [plain(w) for w in words]
        single = np.fromiter((len(b) == 1 and len(w) <= 2 for b, w in zip(bare, words)), bool, len(words))
        bags.append(sorted({shared.setdefault(p, p) for w in [*bare, *apart_letters(words, single)] for p in windows(w) if len(p) >= ORDER}))
    vocabulary = sorted(set().union(*bags))
    first = Landmarks(insults)
    at, _ = first.mapped(vocabulary)
    able = {vocabulary[i] for i in at.tolist()}
    bags = [[w for w in bag if w in able] for bag in bags]
    clean = Counter(w for bag, one in zip(bags, y) if not one for w in bag)
    # the clean words most like an insult are landmarks too
    near = sorted(clean)
    if near:
        like = first.likeness(near)
        near = [near[i] for i in np.lexsort((np.arange(len(near)), -like))[:COUNTER] if near[i] not in insults]
    marks = Landmarks(insults, near)
    copies = {w: [c for c in sorted(altered(w)) if c not in clean] for w in sorted(able) if any(w.startswith(z) for z in insults)}
    words = sorted(able.union(*copies.values()))
    at, x = marks.mapped(words)
    row = {words[i]: k for k, i in enumerate(at.tolist())}

    def machine(rows: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        seen = Counter(w for k in rows[y[rows] == 0] for w in bags[k])
        told = Counter(w for k in rows[y[rows] > 0] for w in bags[k] if any(w.startswith(z) for z in insults))
        told = {a: n for a, n in told.items() if n > clean_weight * seen.get(a, 0)}
        rest = {a: n for a, n in seen.items() if a not in told}
        if not told:
            return np.zeros(len(marks.w)), FLOOR
        virtual: Counter = Counter()
        for a, n in told.items():
            if n < COPY_SHARE * (y[rows] > 0).sum():
                continue
            known = [c for c in copies.get(a, ()) if c in row]
            for c in known:
                virtual[c] += COPIES * n / len(known)
        names = [*told, *virtual, *rest]
        # a word unlike all landmarks is clean
        target = np.array([1] * (len(told) + len(virtual)) + [0] * (len(rest) + 1))
        weight = np.array([*told.values(), *virtual.values(), *(clean_weight * n for n in rest.values()), clean_weight * (y[rows] == 0).sum()], float)
        at = np.array([row[a] for a in names] + [-1])
        fitted = fit_svm(x, at, target, weight, COST, start)
        return fitted[:-1], float(fitted[-1])

    def margin_of(k: int, w: np.ndarray, bias: float) -> float:
        return max([FLOOR, *(float(x[row[a]] @ w + bias) for a in bags[k])])

    # margins of rows that the machine was not fitted on, for the link
    every, margin = np.arange(len(y)), np.zeros(len(y))
    w, bias = machine(every)
    for k in range(4):
        part, b = machine(every[every % 4 != k], np.append(w, bias))
        for i in every[every % 4 == k].tolist():
            margin[i] = margin_of(i, part, b)
    return {"insults": insults, "clean": near, "w": w, "bias": bias, "link": fit_link(margin, y, np.where(y > 0, 1.0, STRICT * clean_weight))}


_BUILT: dict[tuple, Landmarks] = {}


def score(docs: DataFrame, model: dict | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` (0 to 1) from their whole texts."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(free_name("text", kept)))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (*model["insults"], *model["clean"], *model["w"].tolist(), model["bias"])
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Landmarks(model["insults"], model["clean"])
            _BUILT[key].decide(model["w"], model["bias"])
        marks = _BUILT[key]
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(i, 1000)
                if not part.num_rows:
                    continue
                m = model["link"][0] * marks.margins(part.column(len(kept)).to_pylist()) + model["link"][1]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))))], [*kept, out])

    return source.mapInArrow(work, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
