"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut at places that no merge can cross (between two characters that
stand side by side in no piece), the distinct parts of a batch are merged
together in numpy, and the ids of a text are gathered from its parts.  Nothing
is shuffled: the work is one pass over the rows, and a lost executor repeats
its tasks only.

Defined results: null text counts as empty; an empty text has only the begin
and end ids; rows are kept as they are (repeated rows too); no length bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.int32(2**30)
#: A worker's parts are forgotten beyond so many.
CACHE_PARTS = 300_000
#: Words of more symbols are merged one by one, all pairs of the least rank in a round.
LONG = 48
#: Characters of text that are worked on at once.
BLOCK_CHARS = 3_000_000

KINDS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def load_vocabulary(model_path: str) -> dict:
    """Pieces, scores and kinds of a SentencePiece BPE model file (read by the
    library's own parser); small and fixed, so it travels with the tasks."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = m.get_piece_size()
    kind = ["byte" if m.is_byte(i) else "control" if m.is_control(i) else "unknown" if m.is_unknown(i) else "normal" for i in range(n)]
    return {"pieces": [m.id_to_piece(i) for i in range(n)], "scores": [m.get_score(i) for i in range(n)], "kinds": kind,
            "bos": m.bos_id(), "eos": m.eos_id(), "unk": m.unk_id(), "digest": hashlib.sha256(m.serialized_model_proto()).hexdigest()}


class PieceCodec:
    """Merge tables of one vocabulary, and the parts met so far."""

    def __init__(self, vocabulary: dict):
        pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.bos, self.eos, self.unk = vocabulary["bos"], vocabulary["eos"], vocabulary["unk"]
        self.n = len(pieces)
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == "normal"}
        levels = {s: r for r, s in enumerate(sorted({vocabulary["scores"][i] for i in normal.values()}, reverse=True))}
        self.byte_id = np.full(256, self.unk, np.int32)
        for i, p in enumerate(pieces):
            if kinds[i] == "byte":
                self.byte_id[int(p[3:5], 16)] = i
        self.char_id = {p: i for p, i in normal.items() if len(p) == 1}
        keys, merged, rank, beside = [], [], [], set()
        for p, i in normal.items():
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    merged.append(i)
                    rank.append(levels[vocabulary["scores"][i]])
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.rank = np.array(rank, np.int32)[order]
        self.beside = np.array(sorted(beside), np.int64)
        surface = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else " ⁇ ".encode() if k == "unknown" else b""
                   for p, k in zip(pieces, kinds)]
        self.blob = np.frombuffer(b"".join(surface), np.uint8)
        self.blob_len = np.array([len(s) for s in surface], np.int64)
        self.blob_off = np.cumsum(self.blob_len) - self.blob_len
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.is_control = np.array([k == "control" for k in kinds])
        self.opens = np.array([k == "normal" and p.startswith(SPACE) for p, k in zip(pieces, kinds)])
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.flat, self.off, self.len = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    # ---- cutting -------------------------------------------------------
    _general = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")

    def cut(self, text: str) -> list[str]:
        """Parts of a text.  A part that begins with a line feed stands for
        itself, any other for itself after a space mark."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        return [p if p[0] == "\n" else p[1:] for p in self._general.findall(marked)]

    # ---- merging -------------------------------------------------------
    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; symbols below 0 are
        characters without a piece and merge with nothing."""
        key = a.astype(np.int64) * self.n + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NONE).astype(np.int32), np.where(hit, self.merged[at], 0).astype(np.int32)

    def _merge(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end; returns symbols and lengths
        in the given order.  A round takes the least pair rank of each word and
        merges the leftmost pair that has it, in all words at once; words that
        have no pair left are set aside, the rest is compacted."""
        count = len(length)
        done_sym, done_word = [], []
        word = np.arange(count)
        out_len = length.copy()
        last = np.cumsum(length) - 1
        rank = np.full(len(sym), NONE, np.int32)
        to = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._lookup(sym[:-1], sym[1:])
        rank[last] = NONE
        while len(word):
            start = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, start)
            live = least < NONE
            if not live.all():
                spread = np.repeat(live, length)
                done_sym.append(sym[~spread])
                done_word.append(word[~live])
                out_len[word[~live]] = length[~live]
                sym, rank, to = sym[spread], rank[spread], to[spread]
                word, length, least = word[live], length[live], least[live]
                if not len(word):
                    break
                start = np.cumsum(length) - length
            at = np.flatnonzero(rank == np.repeat(least, length))
            owner = np.searchsorted(start, at, "right")
            at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, to = sym[keep], rank[keep], to[keep]
            at = at - np.arange(len(at))
            length = length - 1
            start = np.cumsum(length) - length
            end = start + length - 1
            rank[at], to[at] = NONE, 0
            a = at[at < end]
            rank[a], to[a] = self._lookup(sym[a], sym[a + 1])
            a = at[at > start] - 1
            rank[a], to[a] = self._lookup(sym[a], sym[a + 1])
        if not done_word:
            return np.zeros(0, np.int32), out_len
        words, flat = np.concatenate(done_word), np.concatenate(done_sym)
        size = out_len[words]
        source = np.empty(count, np.int64)
        source[words] = np.cumsum(size) - size
        return flat[_spans(source, out_len)], out_len

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same merges of one long word.  A round merges every pair of the least
        rank, leftmost first where they overlap; only if a merged symbol would make
        a pair of a lesser rank with a neighbour, the leftmost pair alone."""
        rank, to = self._lookup(sym[:-1], sym[1:])
        while len(rank) and (least := rank.min()) < NONE:
            at = np.flatnonzero(rank == least)
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))  # pairs that overlap: every other one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            new, before, after = to[at], at[at > 0], at[at + 2 < len(sym)]
            beside = [self._lookup(sym[before - 1], to[before])[0], self._lookup(to[after], sym[after + 2])[0], self._lookup(new, new)[0]]
            if min((x.min(initial=NONE) for x in beside)) <= least:
                at = at[:1]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym = sym[keep]
            at -= np.arange(len(at))
            # the pair of a merged symbol and its right neighbour stands where the merged pair stood
            rank, to = rank[keep[1:]], to[keep[1:]]
            for a in (at[at < len(sym) - 1], at[at > 0] - 1):
                rank[a], to[a] = self._lookup(sym[a], sym[a + 1])
        return sym

    def _learn(self, new: list[str]) -> None:
        """Encode parts that were not met before."""
        strings = [p if p[:1] == "\n" else SPACE + p for p in new]
        chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        codes, inverse = np.unique(chars, return_inverse=True)
        # a character without a piece is held as minus its code, less one
        ids = np.array([self.char_id.get(chr(c), -int(c) - 1) for c in codes], np.int32)[inverse]
        first = np.zeros(len(chars), bool)
        first[np.cumsum(length) - length] = True
        pair = chars[:-1] << 21 | chars[1:]
        at = np.searchsorted(self.beside, pair)
        at[at == len(self.beside)] = 0
        first[1:] |= self.beside[at] != pair
        begins = np.flatnonzero(first)
        size = np.diff(np.append(begins, len(chars)))
        part = np.repeat(np.arange(len(strings)), length)[begins]
        if (size > LONG).any():
            pieces, sizes = [], size.copy()
            short = size <= LONG
            mask = np.repeat(short, size)
            flat, lens = self._merge(ids[mask], size[short])
            sizes[short] = lens
            at = np.cumsum(lens) - lens
            k = 0
            for w, (b, s) in enumerate(zip(begins.tolist(), size.tolist())):
                if s <= LONG:
                    pieces.append(flat[at[k]:at[k] + lens[k]])
                    k += 1
                else:
                    pieces.append(self._merge_long(ids[b:b + s].copy()))
                    sizes[w] = len(pieces[-1])
            flat, size = np.concatenate(pieces), sizes
        else:
            flat, size = self._merge(ids, size)
        total = np.bincount(part, weights=size, minlength=len(strings)).astype(np.int64)
        if (flat < 0).any():  # characters without a piece become their bytes
            owner = np.repeat(np.arange(len(strings)), total)
            grown, extra = [], np.zeros(len(strings), np.int64)
            begin = 0
            for i in np.flatnonzero(flat < 0).tolist():
                raw = self.byte_id[list(chr(-int(flat[i]) - 1).encode())]
                grown += [flat[begin:i], raw]
                extra[owner[i]] += len(raw) - 1
                begin = i + 1
            flat = np.concatenate([*grown, flat[begin:]])
            total += extra
        k, n = len(self.parts), len(new)
        while k + n > len(self.off):
            self.off, self.len = np.concatenate([self.off, self.off * 0]), np.concatenate([self.len, self.len * 0])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.off[k:k + n] = self.used + np.cumsum(total) - total
        self.len[k:k + n] = total
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.parts.update(zip(new, range(k, k + n)))

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        if len(self.parts) > CACHE_PARTS:
            self._forget()
        cut = [self.cut(t) for t in texts]
        new = list(set().union(*cut).difference(self.parts))
        if new:
            self._learn(new)
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        find = self.parts.__getitem__
        at = np.fromiter((i for c in cut for i in map(find, c)), np.int64, int(count.sum()))
        ids = self.flat[_spans(self.off[at], self.len[at])]
        ends = np.concatenate(([0], np.cumsum(self.len[at])))
        stop = np.cumsum(count)
        total = ends[stop] - ends[stop - count]
        if bos or eos:
            grown = total + bos + eos
            out = np.empty(int(grown.sum()), np.int32)
            begin = np.cumsum(grown) - grown
            out[_spans(begin + bos, total)] = ids
            if bos:
                out[begin] = self.bos
            if eos:
                out[begin + grown - 1] = self.eos
            return out, grown
        return ids, total

    # ---- decoding ------------------------------------------------------
    def decode(self, ids: np.ndarray, total: np.ndarray) -> list[str]:
        """Texts of id lists laid end to end: control ids vanish, the space mark
        that opens a text is dropped, bytes that form no character become U+FFFD."""
        size = self.blob_len[ids]
        raw = self.blob[_spans(self.blob_off[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))
        stop = np.cumsum(total)
        begin = stop - total
        texts = []
        for b, s in zip(begin.tolist(), stop.tolist()):
            first = b
            while first < s and self.is_control[ids[first]]:
                first += 1
            skip = first < s and self.opens[ids[first]]
            part = raw[ends[b] + skip:ends[s]]
            try:
                texts.append(part.decode())
            except UnicodeDecodeError:
                texts.append(self._mend(part))
        return texts

    @staticmethod
    def _mend(part: bytes) -> str:
        out, i = [], 0
        while i < len(part):
            for n in (1, 2, 3, 4):
                try:
                    out.append(part[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of spans, one after the other."""
    total = int(length.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(start - (np.cumsum(length) - length), length)


#: Codecs of a worker, by the digest of the model file.
_CODEC: dict[str, PieceCodec] = {}


def piece_round_trip(docs: DataFrame, model_path: str, *, text: str = "text", keep: list[str] | None = None,
                     emit: tuple[str, ...] = ("n_tokens", "ids", "decoded"), bos: bool = True, eos: bool = True) -> DataFrame:
    """Columns ``keep`` (all by default) and, for each name in ``emit``, what
    encoding ``text`` and decoding the ids again gives: n_tokens, ids, ids_sha256
    (of ids as little-endian unsigned 32-bit integers), decoded, decoded_sha256.

    A column of the input that has the name of an emitted one is replaced.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(model_path))  # as large as the vocabulary file
    kept = [c for c in (docs.columns if keep is None else keep) if c not in emit]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept), *(f"{e} {KINDS[e]}" for e in emit)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = vocabulary.value["digest"]
        codec = _CODEC.get(key)
        if codec is None:
            codec = _CODEC[key] = PieceCodec(vocabulary.value)
        for batch in batches:
            begin, held = 0, 0
            texts = batch.column(len(kept))
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                held += size[i]
                if held >= BLOCK_CHARS or i == batch.num_rows - 1:
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_emit(codec, part.column(len(kept)).to_pylist(), emit, bos, eos)], [*kept, *emit])
                    begin, held = i + 1, 0

    return source.mapInArrow(work, schema)


def _emit(codec: PieceCodec, texts: list[str], emit: tuple[str, ...], bos: bool, eos: bool) -> list[pa.Array]:
    ids, total = codec.encode(texts, bos, eos)
    ends = np.concatenate(([0], np.cumsum(total)))
    out: dict[str, pa.Array] = {"n_tokens": pa.array(total, pa.int64())}
    if "ids" in emit:
        out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
    if "ids_sha256" in emit:
        raw = memoryview(ids.astype("<u4").tobytes())
        out["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    if {"decoded", "decoded_sha256"} & set(emit):
        decoded = codec.decode(ids, total)
        out["decoded"] = pa.array(decoded, pa.string())
        if "decoded_sha256" in emit:
            out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])
    return [out[e] for e in emit]
