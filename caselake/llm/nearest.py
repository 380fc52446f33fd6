"""Approximate nearest neighbours by randomly rotated one-bit codes, reranked exactly where their error bounds ask for it.

A vector o of length |o| is turned by a seeded random rotation into at least
``least_bits`` dimensions (the vector padded with zeros, so that short vectors
get sharp estimates too) and kept as the signs x of its coordinates with two
scalars: ``coef`` = |o| / (sqrt(D) f), where f = <o/|o|, x> / sqrt(D), and
``err`` = |o| sqrt((1 - f^2) / (f^2 (D - 1))). For a rotated query q, coef <q, x> is an
unbiased estimate of <q, o> whose error has about the standard deviation
|q| err (Gao and Long, 2024). Codes and scalars are computed once and stored.

The search holds for each query its best exact scores so far. A row is
reranked, with the double-precision inner product of the original vectors, unless its
estimate plus ``sigmas`` errors lies below the worst of them. Only that bound can lose a
neighbour: about 0.6 % of them at 2.5 sigmas, whatever the number of rows. Nothing is sampled
and no list of candidates is cut.

Scale: queries against rows in cells (``grid``); a row travels once for each
block of 16,384 queries, with its vector, since a candidate fetched on its own
would cost two vectors for each pair: more, below some tens of millions of rows.
Of equal vectors the k + 1 smallest ids are enough for any answer; the others are left out
before the search, by a limit that each partition applies before the exchange,
so a vector that a third of all rows hold costs k + 1 rows.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null vec_id, take no part; rows that repeat both id and vector count once;
a query never finds a row of its own id; vectors of other lengths than the query's aren't candidates;
equal scores: smaller vec_id first; fewer candidates than k: all of them;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, spread, table
from .grid import FINITE, by_length, cells, scan, stripes_for

K, SIGMAS, LEAST_BITS = 20, 2.5, 256
PER_BLOCK, PER_STRIPE, AT_ONCE, QUERIES_AT_ONCE = 1 << 14, 1 << 13, 1 << 12, 1 << 10


@lru_cache(maxsize=4)
def frame(d: int, bits: int, seed: int = 44) -> np.ndarray:
    """(bits, d) with orthonormal columns: a random rotation of vectors padded to ``bits`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng((seed, d, bits)).standard_normal((bits, d)))
    return q * np.sign(np.diag(r))


def width(d: int, least_bits: int = LEAST_BITS) -> int:
    return max(least_bits, -(-d // 64) * 64)


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, coef and err of each row of x (none of them zero)."""
    most = np.abs(x).max(1, keepdims=True)
    small = x / most
    length = np.linalg.norm(small, axis=1)
    o = (small / length[:, None]) @ frame(x.shape[1], bits).T
    f = np.abs(o).sum(1) / math.sqrt(bits)
    length *= most[:, 0]
    return np.packbits(o > 0, axis=1), length / (math.sqrt(bits) * f), length * np.sqrt(np.maximum(1 - f * f, 0) / (f * f * (bits - 1)))


def signs(packed: np.ndarray, bits: int) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1


def index(vectors: DataFrame, k: int = K, least_bits: int = LEAST_BITS) -> DataFrame:
    """The stored codes of (vec_id, embedding): id, raw, code, coef, err; of equal vectors the k + 1 smallest ids."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.selectExpr("CAST(vec_id AS long) AS id", "embedding AS raw" if single else "CAST(embedding AS array<double>) AS raw")
    rows = rows.filter(f"id IS NOT NULL AND coalesce(size(raw) > 0 AND {FINITE.format('raw')} AND exists(raw, x -> x <> 0), false)").dropDuplicates(["id", "raw"])
    nth = F.row_number().over(Window.partitionBy("raw").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("id", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, coef, err = np.empty(batch.num_rows, object), np.empty(batch.num_rows), np.empty(batch.num_rows)
            for d, (at, x) in by_length(pa.chunked_array([batch.column("raw")]), np.float64).items():
                packed, coef[at], err[at] = encode(x, width(d, least_bits))
                code[at] = [p.tobytes() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(code, pa.binary()), pa.array(coef), pa.array(err)], names=["id", "raw", "code", "coef", "err"])

    kind = rows.schema["raw"].dataType.simpleString()
    return cut(spread(few).mapInArrow(run, f"id long, raw {kind}, code binary, coef double, err double"))


class Held:
    """The queries of a cell that have one length, and the best k (score, id) found for each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, least_bits: int):
        self.ids, self.x, self.k, self.bits = ids, x, k, width(x.shape[1], least_bits)
        self.turned = (x @ frame(x.shape[1], self.bits).T).astype(np.float32)
        self.length = np.linalg.norm(x, axis=1)
        self.score, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def exact(self, i: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("ij,ij->i", self.x[i[s : s + 65536]], y[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0)])

    def put(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Bring new (query, score, id) among the best k."""
        if not i.size:
            return
        touched, at = np.unique(i, return_inverse=True)
        who = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.found[touched].ravel(), ids])
        order = np.lexsort((ids, -score, who))
        who = who[order]
        start = np.searchsorted(who, np.arange(len(touched)))
        best = order[start[:, None] + np.arange(self.k)]
        self.score[touched], self.found[touched] = score[best], ids[best]

    def meet(self, ids: np.ndarray, y: np.ndarray, packed: np.ndarray, coef: np.ndarray, err: np.ndarray, sigmas: float) -> None:
        side = signs(packed, self.bits)
        coef, slack = coef.astype(np.float32), (sigmas * err).astype(np.float32) * np.float32(1.0001)
        for at in range(0, len(self.ids), QUERIES_AT_ONCE):
            q = slice(at, at + QUERIES_AT_ONCE)
            guess = (self.turned[q] @ side.T) * coef
            new = np.ones(guess.shape, bool)
            if np.isneginf(self.score[q, -1]).any():  # the best by estimate first: a threshold for the others
                few = min(self.k + 1, len(ids))
                j = np.argpartition(-guess, few - 1, axis=1)[:, :few].ravel()
                i = np.repeat(np.arange(len(guess)), few)
                new[i, j] = False
                self.rank(i + at, j, ids, y)
            least = self.score[q, -1:]
            below = guess + self.length[q, None].astype(np.float32) * slack < (least - 1e-6 * np.abs(least)).astype(np.float32)
            i, j = np.nonzero(new & ~below)
            self.rank(i + at, j, ids, y)

    def rank(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        score = self.exact(i, j, y)
        good = score >= self.score[i, -1]
        self.put(i[good], score[good], ids[j[good]])


def search(queries: DataFrame, stored: DataFrame, k: int = K, sigmas: float = SIGMAS, least_bits: int = LEAST_BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``stored`` (from ``index``) for each query (id, raw)."""
    blocks, stripes = stripes_for(queries, queries.count(), stored.count(), PER_BLOCK, PER_STRIPE)
    asked = queries.select("id", "raw")
    both = cells(asked, stored, "id", "id", blocks, stripes)

    def begin(tab: pa.Table) -> dict[int, Held]:
        ids = tab.column("id").to_numpy()
        return {d: Held(ids[at], x, k, least_bits) for d, (at, x) in by_length(tab.column("raw"), np.float64).items()}

    def take(state: dict[int, Held], tab: pa.Table) -> None:
        ids, coef, err = (tab.column(c).to_numpy() for c in ("id", "coef", "err"))
        codes = tab.column("code").combine_chunks()
        for d, (at, y) in by_length(tab.column("raw"), np.float64).items():
            if d in state:
                packed = np.frombuffer(b"".join(codes.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                state[d].meet(ids[at], y, packed, coef[at], err[at], sigmas)

    def end(state: dict[int, Held]) -> Iterator[pa.RecordBatch]:
        for held in state.values():
            i, j = np.nonzero(np.isfinite(held.score))
            yield pa.RecordBatch.from_arrays([pa.array(held.ids[i]), pa.array(held.found[i, j]), pa.array(held.score[i, j])], names=["query_id", "vec_id", "score"])

    best = scan(both, begin, take, end, "query_id long, vec_id long, score double", AT_ONCE).dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(askers(vectors), index(vectors))


def askers(vectors: DataFrame, every: int = 20) -> DataFrame:
    """The queries (id, raw): rows whose vec_id is divisible by ``every`` and whose vector can be compared."""
    rows = vectors.selectExpr("CAST(vec_id AS long) AS id", "embedding AS raw").filter(f"id % {every} = 0")
    return rows.filter(f"coalesce(size(raw) > 0 AND {FINITE.format('raw')} AND exists(raw, x -> x <> 0), false)").dropDuplicates(["id"])
