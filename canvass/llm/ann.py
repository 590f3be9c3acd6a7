"""Approximate nearest neighbours (operator 7): anisotropic 4-bit product quantisation and exact reranking.

Unit vectors are cut into pairs of components, each quantised to one of 16 centres, so that the
quantised inner product with the vector's own direction is kept best: the residual parallel to
the vector costs more than the rest. Queries scan blocks of codes with tables of partial
products, and the best of each block are ranked again by the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.llm.common import freeing, sent_model, stored, table

#: Bound of the sample that the codebooks are fitted on (vectors, chosen by a hash of the id).
SAMPLE = 8192
CENTRES, WIDTH, ROUNDS = 16, 2, 6
#: Cosine above which the inner product should be kept best; it sets the weight of the parallel residual.
THRESHOLD = 0.2
#: Vectors to a block: as many as give ``BLOCKS`` blocks, from ``BLOCK`` up to what holds ``BLOCK_BYTES`` of vectors; the
#: queries go to every block, so larger blocks mean fewer copies of them. Queries to a block.
BLOCK, BLOCKS, BLOCK_BYTES, QUERIES = 4096, 64, 16 << 20, 256
#: Candidates of each block that are ranked exactly, for each neighbour asked for: the same number however large the block.
RERANK = 48
#: Vectors of different lengths are searched apart; with more lengths than this something is wrong with the table.
MAX_LENGTHS = 64
EVERY = 50


class Quantiser:
    """Codebooks of shape (pairs of components, centres, 2); ``dim`` is the length of the vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        n, self.dim = sample.shape
        self.parts = -(-self.dim // WIDTH)
        self.parts += self.parts % 2  # two codes to a byte
        x = self.cut(sample)
        t2 = THRESHOLD**2
        self.eta = max(1.0, (self.dim - 1) * t2 / (1 - t2))
        rng = np.random.default_rng(seed)
        self.centres = np.stack([x[rng.choice(n, CENTRES, n < CENTRES), m] for m in range(self.parts)])
        codes = self._nearest(x)
        for _ in range(ROUNDS):
            self._refit(x, codes)
            codes = self.encode(sample)

    def cut(self, unit: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(unit), self.parts * WIDTH))
        padded[:, : self.dim] = unit
        return padded.reshape(len(unit), self.parts, WIDTH)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[:, m, None] - self.centres[m]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], axis=1)

    def _parallel(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each part, the inner product of residual and vector."""
        chosen = self.centres[np.arange(self.parts), codes]
        return ((x - chosen) * x).sum(-1)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r.x)^2, starting from the nearest centres."""
        x = self.cut(unit)
        codes = self._nearest(x)
        along = self._parallel(x, codes)
        total = along.sum(1)
        for _ in range(2):
            for m in range(self.parts):
                r = x[:, m, None] - self.centres[m]
                own = (r * x[:, m, None]).sum(-1)
                loss = (r**2).sum(-1) + (self.eta - 1) * (total[:, None] - along[:, m, None] + own) ** 2
                codes[:, m] = loss.argmin(1)
                now = own[np.arange(len(x)), codes[:, m]]
                total += now - along[:, m]
                along[:, m] = now
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre minimises the loss of its vectors, the other parts held fixed."""
        along = self._parallel(x, codes)
        total = along.sum(1)
        for m in range(self.parts):
            own = x[:, m]
            target = total - along[:, m] + (own**2).sum(1)  # the residual along x if the centre were zero
            for c in range(CENTRES):
                of = codes[:, m] == c
                if not of.any():
                    continue
                v = own[of]
                left = of.sum() * np.eye(WIDTH) + (self.eta - 1) * v.T @ v
                right = v.sum(0) + (self.eta - 1) * (v * target[of, None]).sum(0)
                self.centres[m, c] = np.linalg.solve(left, right)
            now = ((x[:, m] - self.centres[m, codes[:, m]]) * x[:, m]).sum(-1)
            total += now - along[:, m]
            along[:, m] = now

    def packed(self, unit: np.ndarray) -> np.ndarray:
        codes = self.encode(unit).astype(np.uint8)
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products, one row per query: a table of 256 sums for each byte of code."""
        q = self.cut(queries).astype(np.float32)
        tables = np.einsum("qmw,mcw->qmc", q, self.centres.astype(np.float32))
        scores = np.zeros((len(q), len(packed)), np.float32)
        for b in range(self.parts // 2):
            both = (tables[:, 2 * b, :, None] + tables[:, 2 * b + 1, None, :]).reshape(len(q), -1)
            scores += np.take(both, packed[:, b], axis=1)
        return scores


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of double): rows whose id is not null and whose vector is finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(rows: DataFrame, n: int, sample: int = SAMPLE) -> Quantiser | None:
    """A quantiser fitted on about ``sample`` of the ``n`` usable vectors of one length; None without any."""
    scale = 1 << 30
    part = min(scale, scale * sample // max(n, 1) + 1)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(scale)) < part).orderBy("vec_id").limit(2 * sample).select("v").collect()
    if not chosen and n:
        chosen = rows.limit(sample).select("v").collect()
    return Quantiser(_unit(np.array([r["v"] for r in chosen]))) if chosen else None


_BLOCKS = pa.schema([("block", pa.string()), ("ids", pa.binary()), ("codes", pa.binary()), ("vectors", pa.binary())])


def _blocks(rows: DataFrame, quantiser: Quantiser, size: int) -> DataFrame:
    """Rows of ``size`` vectors each: ids, codes and original vectors as packed arrays, in the order of ids."""
    sent = sent_model(rows.sparkSession, quantiser)  # codebooks: a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, vectors, own = TaskContext.get().partitionId(), 0, [], [], sent()

        def out(k: int) -> pa.RecordBatch:
            nonlocal ids, vectors, n
            i, v = np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, n = [i[k:]], [v[k:]], n + 1
            order = np.argsort(i[:k], kind="stable")
            i, v = i[:k][order], v[:k][order]
            fields = [f"{task}-{n}", i.tobytes(), own.packed(_unit(v)).tobytes(), v.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(fields, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
                vectors.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            while sum(map(len, ids)) >= size:
                yield out(size)
        if sum(map(len, ids)):
            yield out(size)

    return rows.mapInArrow(freeing(run), "block string, ids binary, codes binary, vectors binary")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row; of equal ones the first."""
    n = scores.shape[1]
    if k >= n:
        return np.tile(np.arange(n), (len(scores), 1))
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    out = np.empty((len(scores), k), np.int64)
    for row, (s, low) in enumerate(zip(scores, least)):
        over = np.flatnonzero(s > low)
        out[row] = np.concatenate([over, np.flatnonzero(s == low)[: k - len(over)]])
    return out


def _spare(v: np.ndarray, k: int) -> np.ndarray:
    """Rows after the first k + 1 equal ones of a block in order of ids: no query can have them among its k nearest."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    return order[place > k]


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by cosine that are found, for each row where ``is_query``.

    Candidates are all rows of the query's length but those with the query's own id. The score is the exact cosine in double
    precision; ties go to the smaller id. Null ids, and vectors that are null, zero or hold null or non-finite
    components, take no part; with fewer candidates there are fewer rows. An id that occurs more than once is one candidate
    and one query, with the nearest of its vectors. ``is_query`` sees ``vec_id`` alone; other columns of
    ``vectors`` are not read, whatever their names; an empty table gives an empty one. Every block of codes is scanned for
    every query, block against block.
    """
    rows = usable(vectors.select("vec_id", "embedding"))
    lengths = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().limit(MAX_LENGTHS + 1).collect()}
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of over {MAX_LENGTHS} lengths")
    found = [_search(rows.where(F.size("v") == dim), n, dim, is_query, k) for dim, n in sorted(lengths.items())]
    return reduce(DataFrame.union, found or [vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")])


def _search(rows: DataFrame, n: int, dim: int, is_query, k: int) -> DataFrame:
    """``search`` over vectors of one length."""
    spark = rows.sparkSession
    quantiser = fit(rows, n)
    size = max(BLOCK, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(dim, 64))))
    data = stored(_blocks(rows, quantiser, size), "blocks")
    asked = stored(_blocks(rows.where(is_query), quantiser, QUERIES), "queries")
    tiles = data.count()  # one for every block
    placed = data.withColumn("tile", F.pmod(F.xxhash64("block"), F.lit(tiles))).hint("shuffle_hash")
    each = asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"))
    pairs = each.join(placed, "tile")
    sent = sent_model(spark, quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in batches:
            for q_ids, q_vectors, ids, codes, v in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vectors", "ids", "codes", "vectors"))):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, v = (np.frombuffer(x, np.float64).reshape(-1, own.dim) for x in (q_vectors, v))
                unit_q, unit_v = _unit(q), _unit(v)
                scores = own.scan(unit_q, np.frombuffer(codes, np.uint8).reshape(len(ids), -1))
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                scores[:, _spare(v, k)] = -np.inf  # a crowd of equal vectors leaves room for others
                scores[:, np.flatnonzero((ids[1:] == ids[:-1]) & (v[1:] == v[:-1]).all(axis=1))] = -np.inf  # repeated rows
                best = _best(scores, RERANK * k)
                some = max(1, (16 << 20) // (8 * own.dim * best.shape[1]))
                exact = np.concatenate([np.einsum("qd,qkd->qk", unit_q[i : i + some], unit_v[best[i : i + some]]) for i in range(0, len(best), some)])
                found = np.where(np.take_along_axis(scores, best, 1) == -np.inf, -np.inf, exact)
                order = np.lexsort((ids[best], -found), axis=1)[:, :k]
                found, of = np.take_along_axis(found, order, 1), ids[np.take_along_axis(best, order, 1)]
                ok = found > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, order.shape[1])[ok.ravel()]), pa.array(of[ok]), pa.array(found[ok])], names=["query_id", "vec_id", "score"]
                )

    found = pairs.mapInArrow(freeing(run), "query_id long, vec_id long, score double").repartition("query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
