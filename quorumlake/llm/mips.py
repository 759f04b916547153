"""Maximum inner product search with score-aware (anisotropic) quantisation.

Directions are told apart by the nearest of some coarse centres, and what is left
is product-quantised to four bits a subspace, in units of its own length, under a
loss that weighs the error parallel to the vector more than the rest, since that
part moves large inner products.  Dense groups get centres of their own, so their
codes are as fine as the group is.  Centres and codebooks are fitted on a bounded
sample, every row is encoded.

Queries meet the codes in blocks; two codes a byte are looked up at once in tables
of eight-bit partial products.  A first scan, over every SAMPLE-th row, says which
estimate about REACH rows of all exceed; the second, over all rows, lets only such
rows leave a task.  The REACH best estimates of a query are reranked by the exact
double-precision product of the original vectors, which travel for these alone.

Each query block reads all codes (16 to 20 times smaller than the vectors): work grows
with queries times rows.  Searches of fewer blocks would need clusters that hold
the nearest rows, which vectors in all directions do not have.

Defined results: vectors that are null, zero, hold null or non-finite components
or have another length than most take no part, neither as queries nor as
candidates; equal scores are ordered by id; with fewer candidates than asked
for, all are returned; an empty table gives no rows; equal vectors are scanned
and reranked once, whatever their number, and their least ids are answers.  Null
ids take no part; an id with several vectors counts by its best one, as a query by
its least one.  Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.session import written

#: Rows of the sample that centres and codebooks are fitted on.
FIT_ROWS = 10_000
#: Candidates and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2048
#: Estimates of a query that are reranked, and the share of rows (one in so many) that the first scan reads.
REACH, SAMPLE = 400, 16
#: Coarse centres; components of a subspace, centres of each (four bits), and the score above which errors matter.
COARSE, SUB, CENTRES, THRESHOLD = 256, 2, 16, 0.5


def sound(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _split(x: np.ndarray) -> np.ndarray:
    """Components in pairs of subspaces, filled up with zeros."""
    pad = -x.shape[1] % (2 * SUB)
    if pad:
        x = np.hstack([x, np.zeros((len(x), pad), x.dtype)])
    return x.reshape(len(x), -1, SUB)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int32), (centres**2).sum(1) / 2
    for i in range(0, len(x), 8192):
        out[i:i + 8192] = (x[i:i + 8192] @ centres.T - half).argmax(1)
    return out


def coarse_centres(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Centres by Lloyd's rounds, from sample rows far from those before them."""
    centres = x[rng.choice(len(x), 1)]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < count and far.sum() > 0:  # a few at a time
        new = x[rng.choice(len(x), min(64, count - len(centres)), p=far / far.sum())]
        centres = np.concatenate([centres, new])
        far = np.minimum(far, np.maximum((x**2).sum(1)[:, None] - 2 * x @ new.T + (new**2).sum(1), 0).min(1))
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        live, first = np.unique(own[order], return_index=True)
        centres[live] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centres


class Codebook:
    """Coarse centres, and centres of each subspace for what they leave, fitted to unit vectors."""

    def __init__(self, coarse: np.ndarray, centres: np.ndarray, eta: float):
        self.coarse, self.centres, self.eta = coarse, centres, eta

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, seed: int = 7) -> Codebook:
        rng = np.random.default_rng(seed)
        book = cls(coarse_centres(x, min(COARSE, len(x) // 16 + 1), rng), np.zeros((0, CENTRES, SUB)), 1.0)
        _, _, s = book.rest(x)
        u = _split(x)
        book.centres = np.stack([s[rng.choice(len(s), CENTRES, replace=len(s) < CENTRES), k] for k in range(s.shape[1])])
        eta = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        for r in range(rounds):
            book.eta = 1.0 if r < 3 else eta  # plain rounds first
            book._update(s, u, book._codes(s, u))
        book.eta = eta
        return book

    def rest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coarse centre of unit vectors, length of what is left, and its direction in subspaces."""
        own = _nearest(x, self.coarse)
        r = x - self.coarse[own]
        size = np.linalg.norm(r, axis=1)
        return own, size, _split(r / np.where(size > 0, size, 1)[:, None])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coarse centre, length of the rest, codes) of unit vectors."""
        own, size, s = self.rest(x)
        return own, size, self._codes(s, _split(x))

    def _codes(self, s: np.ndarray, u: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of s by coordinate descent on the anisotropic loss; u: the vectors' own directions."""
        n, m, _ = s.shape
        code = np.empty((n, m), np.uint8)
        for k in range(m):
            code[:, k] = ((s[:, k, None, :] - self.centres[k]) ** 2).sum(-1).argmin(1)
        if self.eta <= 1:
            return code
        rows = np.arange(n)
        along = self._along(s, u, code)
        total = along.sum(1)
        for _ in range(sweeps):
            for k in range(m):
                r = s[:, k, None, :] - self.centres[k]
                part = (r * u[:, k, None, :]).sum(-1)
                cost = (r**2).sum(-1) + (self.eta - 1) * ((total - along[:, k])[:, None] + part) ** 2
                code[:, k] = cost.argmin(1)
                new = part[rows, code[:, k]]
                total += new - along[:, k]
                along[:, k] = new
        return code

    def _along(self, s: np.ndarray, u: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.stack([((s[:, k] - self.centres[k][code[:, k]]) * u[:, k]).sum(-1) for k in range(s.shape[1])], 1)

    def _update(self, s: np.ndarray, u: np.ndarray, code: np.ndarray) -> None:
        n, m, d = s.shape
        along = self._along(s, u, code)
        rest = along.sum(1, keepdims=True) - along
        for k in range(m):
            v, e = u[:, k], self.eta - 1
            order = np.argsort(code[:, k], kind="stable")
            live, first = np.unique(code[order, k], return_index=True)
            a = np.add.reduceat((np.eye(d) + e * v[:, :, None] * v[:, None, :])[order], first)
            b = np.add.reduceat((s[:, k] + e * v * (rest[:, k, None] + (s[:, k] * v).sum(-1, keepdims=True)))[order], first)
            self.centres[k][live] = np.linalg.solve(a, b[:, :, None])[:, :, 0]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eight-bit partial products (byte place, two codes, query), their unit and
        the sum of their zeros for each query."""
        part = np.einsum("nmd,mcd->mcn", _split(q), self.centres)
        pair = (part[1::2, :, None] + part[::2, None, :]).reshape(len(part) // 2, CENTRES * CENTRES, -1)  # high half byte: the odd subspace
        low = pair.min(1, keepdims=True)
        unit = np.maximum((pair - low).max((0, 1)) / 255, 1e-12)
        return np.rint((pair - low) / unit).astype(np.uint8), unit.astype(np.float32), low.sum((0, 1)).astype(np.float32)

    def estimates(self, q: np.ndarray, own: np.ndarray, norm: np.ndarray, size: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Estimated products (row, query) of coded rows and queries."""
        table, unit, zero = self.tables(q)
        total = np.zeros((len(packed), len(q)), np.uint16)
        for b in range(packed.shape[1]):
            total += table[b][packed[:, b]]
        out = (total * unit + zero) * size[:, None]
        return (out + (self.coarse @ q.T).astype(np.float32)[own]) * norm[:, None]


def pack(code: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    return code[:, ::2] | code[:, 1::2] << 4


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def sound_rows(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(sound(F.col("vector")) & F.col("id").isNotNull())
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (top["d"] if top else 0))


def build_index(rows: DataFrame, k: int = 20) -> tuple[DataFrame, Codebook | None]:
    """(node, ids, vector, centre, norm, rest, code) of every distinct vector of
    sound rows, and the codebook; node: its least id, ids: its k + 1 least ids."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toArrow()
    if not sample.num_rows:
        return rows.select(F.col("id").alias("node"), "vector"), None
    x = _vectors(sample.column("vector"))
    book = Codebook.fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    # k + 1 rows a vector leave a task, so equal vectors do not crowd one
    few = rows.withColumn("i", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("i") <= k + 1)
    one = few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "ids", "vector")
    kind = rows.schema["vector"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(2))
                norm = np.linalg.norm(x, axis=1)
                own, size, code = book.encode(x / norm[:, None])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(norm.astype(np.float32)), pa.array(size.astype(np.float32)), pa.array([c.tobytes() for c in pack(code)], pa.binary())],
                                                 ["node", "ids", "vector", "centre", "norm", "rest", "code"])

    return written(one.mapInArrow(encode, f"node long, ids array<long>, vector {kind}, centre int, norm float, rest float, code binary"), "codes"), book


def _scan(book: Codebook, codes: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(query_id, node, estimate): the ``keep`` best of each block of ``codes`` for
    each of ``queries`` (query_id, query, floor) whose estimate is at least its floor."""
    blocks, fronts = max(1, -(-codes.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    cell = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    here = codes.select("node", "centre", "norm", "rest", "code", cell("node", blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(fronts - 1))).alias("front"))
    ask = queries.select("query_id", "query", "floor", cell("query_id", fronts, 2).alias("front"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def scan(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if q.num_rows and c.num_rows:
            node, own, norm, rest = (c.column(x).to_numpy() for x in ("node", "centre", "norm", "rest"))
            packed = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(len(node), -1)
            ids, x, floor = q.column("query_id").to_numpy(), _vectors(q.column("query")), q.column("floor").to_numpy()
            for i in range(0, len(ids), 128):
                part = slice(i, i + 128)
                e = np.ascontiguousarray(book.estimates(x[part], own, norm, rest, packed).T)
                if keep < e.shape[1]:
                    least = -np.partition(-e, keep - 1, axis=1)[:, keep - 1]
                    row, at = np.nonzero(e >= np.maximum(least, floor[part])[:, None])
                else:
                    row, at = np.nonzero(e >= floor[part][:, None])
                out.append((ids[part][row], node[at], e[row, at]))
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "node", "estimate"), zip(*out))})

    return ask.groupBy("front", "block").cogroup(here.groupBy("front", "block")).applyInArrow(scan, "query_id long, node long, estimate float")


def _best(found: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("estimate"), "node"))
    return found.withColumn("place", place).where(F.col("place") <= keep)


def search(index: DataFrame, book: Codebook | None, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``index`` for each row
    (id, vector) of ``queries``, its own id left out."""
    spark = index.sparkSession
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ask = written(queries.groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("query")), "queries")
    # first scan: the estimate that about REACH of all rows exceed
    need = -(-REACH // SAMPLE)
    some = index.where(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(SAMPLE)) == 0)
    floors = _best(_scan(book, some, ask.withColumn("floor", F.lit(float("-inf")).cast("float")), need), need).where(F.col("place") == need)
    floors = written(floors.select("query_id", F.col("estimate").alias("floor")), "floors")
    ask = ask.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")).cast("float")))
    near = written(_best(_scan(book, index, ask, REACH), REACH).select("query_id", "node"), "near")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("nd,nd->n", _vectors(batch.column(2)), _vectors(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "ids", "score"])

    pairs = near.join(ask.select("query_id", "query"), "query_id").join(index.select("node", "ids", "vector"), "node").select("query_id", "ids", "query", "vector")
    scored = pairs.mapInArrow(exact, "query_id long, ids array<long>, score double").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    one = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sound_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    index, book = build_index(rows, 20)
    return search(index, book, rows.where("id % 20 = 0"), 20)
