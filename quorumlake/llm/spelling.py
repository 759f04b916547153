"""Spelling variants: words one edit apart, and the frequent form each stands for.

Two words are near if one inserted, deleted or replaced code point makes one of the
other.  Asymmetric q-chunks find them: the word that is shorter (or first, at equal
length) is cut in two disjoint chunks, of which one edit preserves one; the other word
gives the grams that such a chunk can be, at the chunk's own place from the front or
from the back, so within a shift of one.  Both meet by equality, and what lies outside
the chunk is verified.

A chunk that many words hold is cut on: the part that the edit may lie in is halved
again, and the half that is preserved joins the key.  This goes on until no key is held
by more than HOT_WORDS words or the part is one code point, and loses no pair.  The
edit's first possible place belongs to one part, so a pair is found once.

Defined results: null and empty texts have no words; a null id counts as the text '';
texts of any length are read whole; repeated rows count again; of near words with one
count the least in code-point order is the form; an empty table gives no rows; columns
beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.session import discard, written

#: Bytes of text that a block of whole texts reaches before it is worked on.
BLOCK_BYTES = 4_000_000
#: Chunks that more words hold, of those cut and of those that give grams, are cut on.
HOT_WORDS = 16
#: Times that words are halved at most.
LEVELS = 5

_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


# ---- words and their counts --------------------------------------------------------


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to A-Z, a-z or U+00C0 to U+00FF (C3 and one more)."""
    low = raw | 0x20
    lead = raw == 0xC3
    inside = ((low >= 97) & (low <= 122)) | lead
    inside[1:] |= lead[:-1]
    return inside


def text_words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """(words, number of code points of each, text that each is of): the maximal runs
    of letters of all texts, with A-Z lower-cased."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = _letters(raw)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    kept = np.cumsum(inside)
    data = raw[inside]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    offsets = np.append(kept[starts] - 1, len(data)).astype(np.int64)
    points = np.append(0, np.cumsum(data != 0xC3))[offsets]
    text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    of = np.searchsorted(text_ends, starts, side="right")
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.diff(points), of


def crc32_of(words: pa.LargeBinaryArray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of words behind what seeds are the CRC-32 of, a byte of all words at a time."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    state = ~seed.astype(np.uint32)
    left = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[left], np.arange(65), side="right")  # words of up to k bytes are done after k
    for k in range(min(64, int(size.max(initial=0)))):
        at = left[ends[k]:]
        state[at] = _CRC[(state[at] ^ data[offsets[at] + k]) & 255] ^ (state[at] >> 8)
    out = ~state
    for i in left[ends[64]:].tolist():
        out[i] = zlib.crc32(data[offsets[i]:offsets[i + 1]].tobytes(), int(seed[i]))
    return out


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_points: int = 5, slip: int | None = None) -> DataFrame:
    """(word, n): occurrences of all words of at least ``min_points`` code points.

    slip: where this number divides the CRC-32 of ``<id>:<word>``, the word's code
    point at CRC-32 modulo its length goes missing first.
    """
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            begin, held = 0, 0
            for i in range(batch.num_rows):
                held += size[i]
                if held >= BLOCK_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(begin, i + 1 - begin)
                    yield _counted(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), min_points, slip)
                    begin, held = i + 1, 0

    found = source.mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(ids: list[str], texts: list[bytes], min_points: int, slip: int | None) -> pa.RecordBatch:
    words, points, of = text_words(texts)
    slipped: dict[str, int] = {}
    stays = points >= min_points
    if slip is not None and len(words):
        crc = crc32_of(words, np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[of])
        odd = np.flatnonzero(crc % slip == 0)
        stays[odd] = False
        long = odd[points[odd] > min_points]
        for w, h in zip(words.take(pa.array(long)).to_pylist(), crc[long].tolist()):
            w = w.decode()
            w = w[:h % len(w)] + w[h % len(w) + 1:]
            slipped[w] = slipped.get(w, 0) + 1
    plain = words.filter(pa.array(stays)).dictionary_encode()
    counts = np.bincount(plain.indices.to_numpy(), minlength=len(plain.dictionary))
    names = pa.concat_arrays([plain.dictionary.cast(pa.binary()).cast(pa.string()), pa.array(list(slipped), pa.string())])
    return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate((counts, np.array(list(slipped.values()), np.int64))), pa.int64())], ["word", "n"])


# ---- near words -----------------------------------------------------------------------


def _sides(words: DataFrame) -> DataFrame:
    """(word, n, gram, size, lo, hi): each word as one that is cut (gram false), and as
    one that gives grams, to words of its size and of one less.  The edit lies between
    lo and hi of the cut word; the rest of it is equal."""
    length = F.char_length("word")
    kinds = F.array(*[F.struct(F.lit(gram).alias("gram"), (length - less).cast("int").alias("size")) for gram, less in ((False, 0), (True, 0), (True, 1))])
    return words.select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.gram", "k.size", F.lit(0).alias("lo"), F.col("k.size").alias("hi")).where("size >= 0")


def _halved(rows: DataFrame) -> DataFrame:
    """Both cases of each row: the chunk before, or behind, the middle is preserved."""
    middle = F.expr("(lo + hi) div 2").cast("int")
    cases = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    split = rows.select("word", "n", "gram", "size", F.explode(F.when(F.col("hi") - F.col("lo") > 1, cases).otherwise(F.array(F.struct("lo", "hi")))).alias("c")).select("word", "n", "gram", "size", "c.lo", "c.hi")
    # the chunks: in front, and behind; counted from the end they lie within a shift of one
    return split.select("*", F.expr("concat(substring(word, 1, lo), right(word, size - hi))").alias("chunk"))


KEY = ["size", "lo", "hi", "chunk"]


def _met(rows: DataFrame) -> DataFrame:
    """(a, na, b, nb): verified pairs of the rows that share a key."""
    side = lambda gram, name: rows.where(F.col("gram") == gram).select(*KEY, F.col("word").alias(name), F.col("n").alias(f"n{name}"), F.expr("substring(word, lo + 1, char_length(word) - size + hi - lo)").alias(f"mid_{name}"))
    near = "levenshtein(mid_a, mid_b, 1) = 1 and (hi = size or not startswith(mid_b, mid_a)) and (char_length(mid_a) < char_length(mid_b) or a < b)"
    return side(False, "a").join(side(True, "b"), KEY).where(near).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of near words of (word, n) once."""
    rows, found = _sides(words), []
    for level in range(LEVELS):
        cut = written(_halved(rows), "chunks")
        if level:
            discard(rows)
        hot = cut.groupBy(*KEY).agg(F.sum((~F.col("gram")).cast("int")).alias("cut"), F.sum(F.col("gram").cast("int")).alias("grams"))
        hot = hot.where(f"cut * grams > {HOT_WORDS} * (cut + grams) and hi - lo > 1").select(*KEY, F.lit(True).alias("hot"))
        if level == LEVELS - 1:
            found.append(written(_met(cut), "near"))
            discard(cut)
            break
        marked = written(cut.join(hot, KEY, "left"), "marked")
        discard(cut)
        found.append(written(_met(marked.where("hot is null")), "near"))
        rows = written(marked.where("hot").select("word", "n", "gram", "size", "lo", "hi"), "hot")
        discard(marked)
        if rows.isEmpty():
            discard(rows)
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spelling_forms(words: DataFrame, *, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): near words, the most
    frequent of them if it is ``factor`` times as frequent, and where forms lead."""
    pairs = near_pairs(words)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    near = pairs.select(F.explode(both).alias("p")).select("p.word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("p.m")).alias("m"), F.col("p.other").alias("other")).alias("near"))
    own = words.select("word", "n", F.lit(None).cast(near.schema["near"].dataType).alias("near"))
    best = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    enough = -F.col("near.m") >= factor * F.col("n")
    forms = written(best.select("word", "n", "n_near", F.when(enough, F.col("near.other")).alias("form"), F.when(enough, -F.col("near.m")).alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null").select("word", "form"))
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(edges: DataFrame) -> DataFrame:
    """(word, root): where the forms of words lead; the way doubles in each round.
    Forms are ever more frequent, so no way comes back."""
    ways = written(edges.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "ways")
        discard(ways)
        ways = longer
        if ways.where("went").isEmpty():
            return ways.select("word", "root")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = written(word_counts(docs, min_points=5, slip=97).where("n >= 3"), "words")
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")
