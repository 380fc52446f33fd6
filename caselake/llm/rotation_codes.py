"""Embedding near-dedup by randomised-rotation binary codes with correction factors.

A unit vector o is rotated by a seeded random orthogonal matrix and kept as
the signs x of its coordinates together with the correction factor
f = <o, x> / sqrt(d). For a rotated unit vector q, <q, x> / (sqrt(d) f) is an
unbiased estimate of <q, o> with an error of about
sqrt((1 - f^2) / (f^2 (d - 1))) (Gao and Long, 2024). A pair whose upper
confidence bounds reach the threshold is computed exactly in double precision;
no other pair is, and no pair below the threshold is returned.

Candidates are pairs that share the signs of ``bits`` random directions in one of
``tables`` tables. Both follow from the number of vectors: buckets of about a
hundred unrelated vectors, and enough tables that a pair right at the threshold
shares a bucket with probability 0.96 or more (closer pairs: nearer to 1). A
pair is counted in the first table that its vectors share. A bucket larger than
``most`` is dealt out as pairs of blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; equal vectors are compared once
and count each other as links; vectors of different lengths don't link; a null
vec_id takes part in no minimum; single-precision columns stay so, others are read in double precision; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, group_numbers, grouped, spread, table, unions, whole_groups

PER_BUCKET, SURE, SIGMAS = 100, 0.96, 4.0


@lru_cache(maxsize=8)
def rotation(d: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=4)
def directions(d: int, count: int, seed: int = 43) -> np.ndarray:
    return np.random.default_rng((seed, d, count)).standard_normal((d, count)).astype(np.float32)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their packed signs and their correction factors."""
    o = u @ rotation(u.shape[1])
    return o, np.packbits(o > 0, axis=1), np.abs(o).sum(1) / math.sqrt(u.shape[1])


def upper_bounds(o: np.ndarray, packed: np.ndarray, f: np.ndarray, sigmas: float = SIGMAS) -> np.ndarray:
    """For each row of o and each code: the estimated inner product plus its error bound."""
    d = o.shape[1]
    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
    slack = sigmas * np.sqrt(np.maximum(1 - f * f, 0) / (f * f * max(d - 1, 1)))
    return (o.astype(np.float32) @ signs.T) / (math.sqrt(d) * f.astype(np.float32)) + slack.astype(np.float32)


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    bits = min(30, max(1, math.ceil(math.log2(max(n, 2) / PER_BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - SURE) / math.log(1 - same)) if same < 1 else 1


def bucketed(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """reps (node, m, raw) under each of their keys: key, t, node, m, raw, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).reshape(1, 1, bits)
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            lengths = np.array([len(x) for x in raws])
            keys = np.empty((len(raws), tables), np.int64)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                u = unit(np.stack([raws[k] for k in rows]))
                side = (u.astype(np.float32) @ directions(int(d), bits * tables)).reshape(len(rows), tables, bits) > 0
                low = (side * weights).sum(2, dtype=np.uint64)
                keys[rows] = ((low << np.uint64(24)) | np.arange(tables, dtype=np.uint64)[None, :]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("m"), batch.column("raw"), lists], names=["node", "m", "raw", "keys"])

    kind = reps.schema["raw"].dataType.simpleString()
    return spread(reps).mapInArrow(run, f"node long, m long, raw {kind}, keys array<long>").selectExpr("node", "m", "raw", "keys", "posexplode(keys) AS (t, key)")


def bucket_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): vector a has n links, copies counted, that are found first in this bucket; b is linked with it."""

    def pairs(node, raw, keys, t, side) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        lengths = np.array([len(x) for x in raw])
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            u = unit(np.stack([raw[k] for k in own]))
            o, packed, f = codes(u)
            for at in range(0, len(own), 512):
                q = slice(at, at + 512)
                up = upper_bounds(o[q], packed, f)
                i, j = np.nonzero(up >= threshold)
                i += at
                keep = (i < j) if side is None else (side[own[i]] < side[own[j]])
                i, j = i[keep], j[keep]
                first = np.concatenate([(keys[own[i[s : s + 65536]]] == keys[own[j[s : s + 65536]]]).argmax(1) for s in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
                i, j = i[first == t], j[first == t]
                exact = np.concatenate([np.einsum("ij,ij->i", u[i[s : s + 65536]], u[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0)])
                found_a.append(own[i[exact >= threshold]])
                found_b.append(own[j[exact >= threshold]])
        return np.concatenate(found_a), np.concatenate(found_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in whole_groups(batches, "key", 1 << 14):
            key = tab.column("key").to_numpy()
            _, root = group_numbers(key)
            ends = np.append(root[1:], len(key))
            for s, e in zip(root, ends, strict=True):
                if e - s < 2:
                    continue
                part = tab.slice(s, e - s)
                node, m = part.column("node").to_numpy(), part.column("m").to_numpy()
                raw = [np.asarray(x) for x in part.column("raw").to_pylist()]
                keys = np.array(part.column("keys").to_pylist(), np.int64)
                side = part.column("side").to_numpy()
                i, j = pairs(node, raw, keys, int(part.column("t")[0].as_py()), side if side.max() else None)
                if not i.size:
                    continue
                n = np.bincount(i, m[j], len(node)) + np.bincount(j, m[i], len(node))
                label = unions(len(node), i, j)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[label[hit]]), pa.array(n[hit].astype(np.int64))], names=["a", "b", "n"])

    return grouped(rows, "key").mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, most: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    good = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.selectExpr("CAST(vec_id AS long) AS vec_id", "embedding" if single else "CAST(embedding AS array<double>) AS embedding")
    rows = rows.selectExpr("vec_id", f"CASE WHEN coalesce({good}, false) THEN embedding END AS raw")
    reps = cut(rows.filter("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("m")).filter("node IS NOT NULL").select("node", "m", "raw"))
    bits, tables = plan(reps.count(), threshold)
    spots = bucketed(reps, bits, tables)
    hot = cut(spots.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    plain = spots.selectExpr("key", "t", "node", "m", "raw", "keys", "0 AS side")
    if not hot.isEmpty():
        blocks = spots.join(hot, "key").selectExpr("*", f"CAST(ceil(n / {most}) AS int) AS k", "pmod(hash(node), CAST(ceil(n / %d) AS int)) AS c" % most)
        blocks = blocks.selectExpr("*", "explode(sequence(0, k - 1)) AS other")
        blocks = blocks.selectExpr("xxhash64(key, least(c, other), greatest(c, other)) AS key", "t", "node", "m", "raw", "keys", "CASE WHEN c = other THEN 0 WHEN c < other THEN 1 ELSE 2 END AS side")
        plain = plain.join(hot, "key", "left_anti").unionByName(blocks)
    found = cut(bucket_links(plain, threshold))
    roots = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    by_raw = reps.join(counts, "node", "left").join(roots, "node", "left").selectExpr("raw", "coalesce(n, 0) + m - 1 AS links", "coalesce(root, node) AS root")
    out = rows.filter("raw IS NOT NULL").join(by_raw, "raw", "left").selectExpr("vec_id", "coalesce(links, 0L) AS n_links", "coalesce(root, vec_id) AS component_id")
    out = out.unionByName(rows.filter("raw IS NULL").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id"))
    return out.withColumn("kept", F.expr("vec_id = component_id"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
