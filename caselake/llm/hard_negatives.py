"""Hard-negative mining by a BOND scan: branch and bound on decomposed vectors.

Vectors are stored decomposed: a block of up to ``PER_PIECE`` rows is one record
that holds each dimension as a column, with the column's least and greatest value. For an
anchor the dimensions are read in descending order of the anchor's magnitude. After every few of them the
partial score of a row, plus the least and the greatest sum that the
remaining dimensions can add, bounds its score from both sides; rows that the
bounds rule out leave the candidate bitmap, and the later dimensions are read for
the others only, until all dimensions are read and the scores are exact (de Vries et al., 2002).

The same scan runs twice. First for the positives: the k best rows of the
anchor's label; a row leaves once k others are surely better. Then for the
negatives: rows of other labels whose score lies in a positive's window
[low, high]; a row leaves once it surely lies outside every window of its anchor, or k
others surely lie higher in each window that it can reach. Bounds are integers, so no answer is lost to rounding.

Scale: anchors (one row in a hundred) against blocks in cells (``grid``); a cell
returns at most k rows for each anchor and window, whatever labels, copies or scores
are common, so nothing is dealt out by label and no group is gathered.

Cases: rows with a null label or vector, a null or non-finite component or a null vec_id take no part;
rows that repeat id, label and vector count once; an anchor is never its own positive; of several vectors with one anchor's id
the least is the anchor; equal scores: smaller vec_id first; vectors of other
lengths than the anchor's aren't compared; an anchor without positives, and a positive of negative score (its window is empty), give no
row; components of 2^18 or more in magnitude are an error, since scores must fit 64 bits (up to 1,024 dimensions); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, spread, table
from .grid import FINITE, by_length, cells, scan, stripes_for

K, PER_BLOCK, PER_PIECE, STEP = 5, 1 << 12, 1 << 12, 8
#: Scaled components from here on are refused: 2^26 * 2^26 * 1,024 dimensions stay below 2^63.
LARGEST = 1 << 26
MOST = np.iinfo(np.int64).max
LEAST = -MOST  # so that it can be negated


def whole(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id, label, v: the rows that take part, with integer components and the labels that the contract shifts."""
    rows = vectors.selectExpr("CAST(vec_id AS long) AS id", "CAST(label AS long) AS label", "CAST(embedding AS array<double>) AS raw")
    rows = rows.filter(f"id IS NOT NULL AND label IS NOT NULL AND coalesce({FINITE.format('raw')}, false)")
    fit = f"IF(abs({scale} * x) < {LARGEST}, CAST(floor({scale} * x) AS int), raise_error('a component is too large for integer scores'))"
    return rows.selectExpr("id", "IF(id % 7 = 0, (label + 1) % 10, label) AS label", f"transform(raw, x -> {fit}) AS v").dropDuplicates()


def decomposed(rows: DataFrame, per_piece: int = PER_PIECE) -> DataFrame:
    """The stored blocks of rows (id, label, v): piece, d, ids, labels, columns (one list for each dimension), lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(parts: list) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            n, d = x.shape
            columns = pa.ListArray.from_arrays(pa.array(np.arange(0, (d + 1) * n, n, dtype=np.int32) if n else np.zeros(d + 1, np.int32)), pa.array(np.ascontiguousarray(x.T).ravel()))
            row = {
                "piece": pa.array([int(ids[0])], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "labels": pa.array([labels], pa.list_(pa.int64())),
                "columns": pa.ListArray.from_arrays(pa.array([0, d], pa.int32()), columns),
                "lo": pa.array([x.min(0)], pa.list_(pa.int32())),
                "hi": pa.array([x.max(0)], pa.list_(pa.int32())),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for d, (at, x) in by_length(pa.chunked_array([batch.column("v")]), np.int32).items():
                parts = held.setdefault(d, [])
                parts.append((ids[at], labels[at], x))
                if sum(len(p[0]) for p in parts) >= per_piece:
                    yield block(held.pop(d))
        for parts in held.values():
            yield block(parts)

    return cut(spread(rows).mapInArrow(run, "piece long, ids array<long>, labels array<long>, columns array<array<int>>, lo array<int>, hi array<int>"))


class Anchor:
    """One anchor, its windows and the k best rows found in each."""

    def __init__(self, id_: int, label: int, v: list[int], windows: list[tuple[int, int]] | None, k: int):
        self.id, self.label, self.v, self.same, self.k = id_, label, np.array(v, np.int64), windows is None, k
        self.low, self.high = np.array([(LEAST, MOST)] if windows is None else windows, np.int64).reshape(-1, 2).T
        order = np.argsort(-np.abs(self.v), kind="stable")
        self.order = order[self.v[order] != 0]
        self.score, self.found = np.full((len(self.low), k), LEAST), np.full((len(self.low), k), MOST)

    def meet(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        eligible = (labels == self.label) & (ids != self.id) if self.same else labels != self.label
        rows = np.flatnonzero(eligible)
        a = self.v[self.order]
        ends = np.stack([a * lo[self.order], a * hi[self.order]])
        least = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)  # what dimensions from here on add at least, at most
        most = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
        score = np.zeros(len(rows), np.int64)
        for at in range(0, len(self.order) + 1, STEP):
            stay = self.bitmap(score, least[at], most[at])
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if not rows.size:
                return
            for j in self.order[at : at + STEP]:
                score += self.v[j] * columns[j][rows]
        for w in range(len(self.low)):
            inside = (score >= np.maximum(self.low[w], self.score[w, -1])) & (score <= self.high[w])
            if inside.any():
                s, r = np.concatenate([self.score[w], score[inside]]), np.concatenate([self.found[w], ids[rows[inside]]])
                best = np.lexsort((r, -s))[: self.k]
                self.score[w], self.found[w] = s[best], r[best]

    def bitmap(self, score: np.ndarray, least: int, most: int) -> np.ndarray:
        """The rows that can still be among the k best of some window."""
        stay = np.zeros(len(score), bool)
        for w in range(len(self.low)):
            floor = max(self.low[w], self.score[w, -1])
            sure = score[(score + least >= self.low[w]) & (score + most <= self.high[w])] + least
            if len(sure) >= self.k:
                floor = max(floor, np.partition(sure, len(sure) - self.k)[len(sure) - self.k])
            stay |= (score + most >= floor) & (score + least <= self.high[w])
        return stay


def best_in_windows(anchors: DataFrame, stored: DataFrame, k: int = K) -> DataFrame:
    """(anchor_id, high, id, score, rank): the k best rows in each window of each anchor.

    anchors: id, label, v, windows (arrays of low and high); null windows ask for rows of the
    anchor's own label in one window without ends, others for rows of other labels.
    """
    blocks, stripes = stripes_for(anchors, anchors.count(), stored.count(), PER_BLOCK, 1)
    both = cells(anchors.select("id", "label", "v", "windows"), stored, "id", "piece", blocks, stripes)

    def begin(tab: pa.Table) -> dict[int, list[Anchor]]:
        out: dict[int, list[Anchor]] = {}
        for r in tab.select(["id", "label", "v", "windows"]).to_pylist():
            windows = None if r["windows"] is None else [(w["low"], w["high"]) for w in r["windows"]]
            out.setdefault(len(r["v"]), []).append(Anchor(r["id"], r["label"], r["v"], windows, k))
        return out

    def take(state: dict[int, list[Anchor]], tab: pa.Table) -> None:
        for i in range(tab.num_rows):
            ids, labels, lo, hi = (tab.column(c)[i].values.to_numpy() for c in ("ids", "labels", "lo", "hi"))
            columns = tab.column("columns")[i].values.flatten().to_numpy().reshape(len(lo), len(ids))
            for anchor in state.get(len(lo), ()):
                anchor.meet(ids, labels, columns, lo.astype(np.int64), hi.astype(np.int64))

    def end(state: dict[int, list[Anchor]]) -> Iterator[pa.RecordBatch]:
        out = [(a.id, int(a.high[w]), int(a.found[w, i]), int(a.score[w, i])) for of in state.values() for a in of for w in range(len(a.low)) for i in range(a.k) if a.score[w, i] != LEAST]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["anchor_id", "high", "id", "score"])

    found = scan(both, begin, take, end, "anchor_id long, high long, id long, score long", 1).dropDuplicates()
    order = Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, k: int = K, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    ``low``: a negative scores at least so many hundredths of its positive's score, and at most as much as it.
    """
    rows = cut(whole(vectors))
    stored = decomposed(rows)
    anchors = rows.filter(f"id % {every} = 0").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    none = "CAST(NULL AS array<struct<low: long, high: long>>) AS windows"
    positives = cut(best_in_windows(anchors.selectExpr("*", none), stored, k).selectExpr("anchor_id", "id AS positive_id", "score AS positive_score"))
    # low% of the score, rounded up; equal scores of an anchor share their window
    windows = positives.filter("positive_score >= 0").groupBy("anchor_id").agg(F.expr(f"collect_set(struct(({low} * positive_score + 99) DIV 100 AS low, positive_score AS high)) AS windows"))
    asked = anchors.join(windows, anchors["id"] == windows["anchor_id"]).select("id", "label", "v", "windows")
    negatives = best_in_windows(asked, stored, k).withColumnRenamed("high", "positive_score")
    return positives.join(negatives, ["anchor_id", "positive_score"]).selectExpr("anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """WITH r AS (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
