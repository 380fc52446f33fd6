"""Approximate vector search: bucketed random projections of unit vectors, stored by bucket, read by pruned partitions, reranked exactly.

A table's key is made of ``per_key`` projections cut into cells of one width (MLlib's transformer has one projection a table and
neither combines nor probes them). A search reads the query's bucket of each table and the ``spread`` next ones, in the order of the
query's distance to the walls in between; everything read is ranked by its exact cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.functions.scalar import cosine
from caselake.operators.relational import structural_filter

def directions(dims: int, tables: int, per_key: int, seed: int) -> np.ndarray:
    """(dims, tables, per_key), scaled so that a projection of a unit vector spreads over about 1."""
    return np.random.default_rng((seed, dims)).standard_normal((dims, tables, per_key))


def key_of(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cells (last axis)."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for k in range(cells.shape[-1]):
        out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64) / np.abs(x).max(-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def build_index(emb: DataFrame, path: str, dims: int, tables: int = 10, per_key: int = 5, width: float = 1.2, folders: int = 16, seed: int = 7) -> None:
    """Write emb (section_id, embedding, further columns) under ``path``: each row once a table, in its bucket's folder, sorted by bucket, and the parameters beside.

    Vectors that are null, zero, of another length or hold a null or non-finite component aren't indexed: they have no cosine with a
    query of ``dims``. More rows want more projections a key, each about two bits, so that buckets keep their size, and more ``folders``: a bucket
    lies in the folder of its remainder. One shuffle, in which a folder's rows go to four tasks at least.
    """
    good = f"size(embedding) = {dims} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = emb.filter(f"coalesce({good}, false)")
    lines = directions(dims, tables, per_key, seed)

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            x = unit(np.stack(column.to_numpy())) if len(column) else np.empty((0, dims))
            yield pd.Series(list(key_of(np.floor(np.einsum("nd,dtk->ntk", x, lines, optimize=True) / width))))

    out = rows.select(*emb.columns, F.posexplode(keys("embedding")).alias("tab", "bucket")).withColumn("folder", F.expr(f"CAST(pmod(bucket, {folders}) AS int)"))
    out.repartition("tab", "folder", F.expr("pmod(section_id, 4)")).sortWithinPartitions("tab", "folder", "bucket").write.partitionBy("tab", "folder").parquet(f"{path}/buckets")
    emb.sparkSession.createDataFrame([(dims, tables, per_key, float(width), folders, seed)], "dims int, tables int, per_key int, width double, folders int, seed int").write.parquet(f"{path}/params")


def probed(position: np.ndarray, spread: int) -> np.ndarray:
    """The cells (spread + 1, per_key) around a query's position (in widths): its own, then those across one or two walls, the nearest first."""
    own = np.floor(position)
    off = position - own
    moves = [(float((off[k] if s < 0 else 1 - off[k]) ** 2), ((k, s),)) for k in range(len(own)) for s in (-1, 1)]
    moves += [(a + b, m + n) for (a, m), (b, n) in itertools.combinations(moves, 2) if m[0][0] != n[0][0]]
    out = [own]
    for _, steps in sorted(moves)[:spread]:
        cell = own.copy()
        for k, s in steps:
            cell[k] += s
        out.append(cell)
    return np.stack(out)


def candidates(spark: SparkSession, path: str, qvec: list[float], spread: int = 8) -> DataFrame:
    """Rows of the buckets around qvec, each row once; the folders that hold none of them aren't listed or read."""
    p = spark.read.parquet(f"{path}/params").first()
    if len(qvec) != p["dims"]:
        raise ValueError(f"the index holds vectors of {p['dims']} dimensions")
    q = np.asarray(qvec, np.float64)
    stored = spark.read.parquet(f"{path}/buckets")
    if not np.isfinite(q).all() or not q.any():
        return stored.limit(0).drop("tab", "folder", "bucket")
    at = np.einsum("d,dtk->tk", unit(q), directions(p["dims"], p["tables"], p["per_key"], p["seed"])) / p["width"]
    wanted = F.lit(False)
    for t in range(p["tables"]):
        keys = [int(k) for k in key_of(probed(at[t], spread))]
        wanted = wanted | ((F.col("tab") == t) & F.col("folder").isin(sorted({k % p['folders'] for k in keys})) & F.col("bucket").isin(keys))
    return stored.filter(wanted).drop("tab", "folder", "bucket").dropDuplicates(["section_id"])


def approx_search(spark: SparkSession, path: str, qvec: list[float], k: int = 10, threshold: float = 0.3, spread: int = 8, **filters) -> DataFrame:
    """Top k of the index at ``path`` by cosine, as ``vector_search`` gives them but for neighbours that no probed bucket holds."""
    rows = structural_filter(candidates(spark, path, qvec, spread), **filters)
    rows = rows.withColumn("semantic_score", cosine("embedding", F.array(*[F.lit(float(x)) for x in qvec])))
    return rows.filter(F.col("semantic_score") >= threshold).orderBy(F.col("semantic_score").desc(), "section_id").limit(k)
