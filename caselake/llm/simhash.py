"""SimHash near-dedup with BK-trees over fingerprint shards.

A fingerprint has 64 bits. Two fingerprints within ``radius`` 2 agree on at
least two of four 16-bit blocks, so each pair of blocks gives a shard key and
no pair within the radius is lost. A shard's fingerprints form a BK-tree whose
children are keyed by their integer Hamming distance to the parent; a search
follows only the edges within the radius of the distance at hand. Trees of all
shards of a batch are built and searched level by level in numpy.

The trees are built where the shuffle brings a shard together and aren't sent
out by the driver: fingerprints of all documents would pass through it
otherwise. A shard of more than ``most`` fingerprints is dealt again by two of
four 8-bit blocks of the 32 bits that are left. What then shares a key differs
in 16 bits only, so that no tree passes 65,536 nodes, whatever the data.

Cases: a null or wordless text has fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows
share a fingerprint and so a component; a null doc_id takes part in no minimum
and gets the component of its fingerprint; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forget, group_numbers, grouped, linked, many, spread, table, unions, whole_groups

PAIRS = list(combinations(range(4), 2))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of n words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.fromiter((digest(flat[s:e], 42) for s, e in spans), np.uint64, len(words) - n + 1)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fold(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, fp long")


def bk_links(fp: np.ndarray, group: np.ndarray, root: np.ndarray, radius: int, at_once: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), j < i, of one group within the radius.

    Builds one BK-tree for each group (rows of a group are contiguous, the
    first is the root) and searches it with every row.
    """
    n = len(fp)
    parent = np.full(n, -1)
    edge = np.zeros(n, np.int64)
    cur = root[group]
    active = np.flatnonzero(cur != np.arange(n))
    while active.size:
        d = np.bitwise_count(fp[active] ^ fp[cur[active]]).astype(np.int64)
        _, first, inverse = np.unique(cur[active] * 65 + d, return_index=True, return_inverse=True)
        node = active[first]
        parent[node], edge[node] = cur[node], d[first]
        cur[active] = node[inverse]
        stay = np.ones(active.size, bool)
        stay[first] = False
        active = active[stay]
    child = np.flatnonzero(parent >= 0)
    slot = parent[child] * 65 + edge[child]
    order = np.argsort(slot, kind="stable")
    child, slot = child[order], slot[order]
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, n, at_once):
        q = np.arange(at, min(n, at + at_once))
        node = root[group[q]]
        while q.size:
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < q)
            found_a.append(q[hit])
            found_b.append(node[hit])
            lo = np.searchsorted(slot, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(slot, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            total = int(count.sum())
            if not total:
                break
            step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            q, node = np.repeat(q, count), child[np.repeat(lo, count) + step]
    return np.concatenate(found_a), np.concatenate(found_b)


def shard_forest(rows: DataFrame, radius: int, accept=None) -> DataFrame:
    """Links (a, b) that join, shard by shard, what a BK-tree search finds there.

    rows: key, fp, node and whatever ``accept(table, i, j)`` needs to confirm
    pairs. Each shard gives a spanning forest, not all its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key = t.column("key").to_numpy()
            group, root = group_numbers(key)
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            if not several.size:
                continue
            t = t.take(several)
            group, root = group_numbers(key[several])
            fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
            i, j = bk_links(fp, group, root, radius)
            if accept is not None and i.size:
                ok = accept(t, i, j)
                i, j = i[ok], j[ok]
            label = unions(len(node), i, j)
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node)
            least = least[label]
            own = least != node
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(least[own])], names=["a", "b"])

    return grouped(rows, "key").mapInArrow(run, "a long, b long")


def block(col: str, at: int, bits: int) -> str:
    return f"(shiftrightunsigned({col}, {at}) & {(1 << bits) - 1}L)"


def hot_keys(rows: DataFrame, most: int) -> DataFrame | None:
    """Keys with more than ``most`` rows, or None."""
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"))
    return None if hot.isEmpty() else hot


def block_shards(reps: DataFrame, most: int = 4096) -> DataFrame:
    """(key, fp, node): reps (fp, node) under every key of two agreeing blocks; large shards dealt once more."""
    first = [f"named_struct('p', {p}, 'key', xxhash64({p}, {block('fp', 16 * i, 16)}, {block('fp', 16 * j, 16)}))" for p, (i, j) in enumerate(PAIRS)]
    rows = reps.selectExpr("fp", "node", f"inline(array({', '.join(first)}))")
    hot = hot_keys(rows, most)
    if hot is None:
        return rows.select("key", "fp", "node")
    second = []
    for i, j in PAIRS:
        rest = [k for k in range(4) if k not in (i, j)]
        small = [block("fp", 16 * k + 8 * h, 8) for k in rest for h in range(2)]
        second.append(f"array({', '.join(f'xxhash64(key, {s}, {small[a]}, {small[b]})' for s, (a, b) in enumerate(PAIRS))})")
    large = rows.join(hot, "key", "left_semi").selectExpr("fp", "node", f"explode(element_at(array({', '.join(second)}), p + 1)) AS key")
    return rows.join(hot, "key", "left_anti").select("key", "fp", "node").unionByName(large.select("key", "fp", "node"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, fp, component_id): documents linked at two or fewer differing bits.

    Copies meet in one fingerprint before anything is compared; a fingerprint
    is stood for by its smallest doc_id.
    """
    fps = cut(fingerprints(docs, shingle))
    reps = cut(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(shard_forest(block_shards(reps, most), radius=2))
    by_fp = reps.join(roots, "node", "left").selectExpr("fp", "coalesce(root, node) AS component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- documents alike by Jaccard similarity ---------------------------------------------------

BANDS, ROWS, SIGNS = 20, 5, 128
_SEEDS = (np.random.default_rng(7).integers(0, 1 << 31, SIGNS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = np.random.default_rng(8).integers(0, 1 << 32, SIGNS, dtype=np.uint32)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B1


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^32."""
    up, down = (np.cumprod(np.concatenate(([1], np.full(size - 1, x))).astype(np.uint32), dtype=np.uint32) for x in (_BASE, pow(_BASE, -1, 1 << 32)))
    return up, down


def word_hashes(text: str | None, at_once: int = 1 << 18) -> np.ndarray:
    """A 32-bit hash of each word (lower-cased A-Z), a polynomial of its bytes; long texts in pieces that end between words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    every, at, out = np.frombuffer(data, np.uint8), 0, [np.empty(0, np.uint32)]
    while at < len(data):
        stop = min(len(data), at + at_once)
        while stop < len(data) and not _GAP[data[stop]]:
            stop += 1
        raw = every[at:stop]
        at = stop
        gap = _GAP[raw]
        first = np.flatnonzero(gap[:-1] > gap[1:]) + 1
        if not gap[0]:
            first = np.concatenate(([0], first))
        if not first.size:
            continue
        up, down = powers(max(at_once, 1 << (len(raw) - 1).bit_length()))
        value = raw.astype(np.uint32)
        value += np.uint32(257)
        value *= up[: len(raw)]
        value[gap] = 0
        h = np.add.reduceat(value, first, dtype=np.uint32) * down[first]
        h ^= h >> np.uint32(15)
        out.append(h)
    return np.concatenate(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each run of n words (of the whole sequence, where it is shorter), repeats included. words: their hashes."""
    if not len(words):
        return np.empty(0, np.uint32)
    n = min(n, len(words))
    out = words[: len(words) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out *= _MIX
        out += words[k : len(words) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return (out >> np.uint64(32)).astype(np.uint32)


def min_hashes(codes: np.ndarray) -> np.ndarray:
    """SIGNS minima of multiply-shift hashes over a set of shingle hashes."""
    low = np.full(SIGNS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(codes), 1 << 12):
        part = _SEEDS * codes[None, at : at + (1 << 12)]
        part += _SHIFT
        np.minimum(low, part.min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def sketches(docs: DataFrame, shingle: int = 5, sets: bool = False) -> DataFrame:
    """(doc_id, same, keys) of every document: a hash of its words in order and its band keys; with ``sets`` (doc_id, sig, shingles): the minima's last 16 bits, and the set of shingle hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, keys, sigs, found = [], [], [], []
            for t in batch.column(1):
                words = word_hashes(t.as_py())
                codes = shingle_set(words, shingle)
                low = min_hashes(codes)
                if sets:
                    sigs.append((low & np.uint32(0xFFFF)).astype("<u2").tobytes())
                    found.append(np.unique(codes).astype("<u4").tobytes())
                else:
                    same.append(xxhash.xxh3_128_digest(words.tobytes()))
                    keys.append(band_keys(low))
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "sig", "shingles"])
            else:
                flat = np.array(keys, np.uint64).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, BANDS, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), lists], names=["doc_id", "same", "keys"])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, f"doc_id long, {'sig binary, shingles binary' if sets else 'same binary, keys array<long>'}")


def alike(similarity: float, slack: float = 0.15):
    """Confirms pairs whose sets of shingles have the Jaccard similarity.

    Equal minima give an estimate (standard error 0.035 at 0.8); pairs within
    ``slack`` below the similarity or above are computed exactly, the likeliest first,
    but for those that accepted pairs connect already. A pair at 0.8 is estimated
    lower than that in about 3 of 100,000 cases.
    """

    def prepare(t: pa.Table):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, SIGNS)
        column = t.column("shingles")

        def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            estimate = (sig[i] == sig[j]).mean(1)
            ok = np.zeros(len(i), bool)
            near = np.flatnonzero(estimate >= similarity - slack)
            sets, root = {}, {}

            def shingles(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = np.frombuffer(column[k].as_py(), "<u4")
                return sets[k]

            def top(k: int) -> int:
                while root.get(k, k) != k:
                    root[k] = root.get(root[k], root[k])
                    k = root[k]
                return k

            for k in near[np.argsort(-estimate[near], kind="stable")].tolist():
                a, b = int(i[k]), int(j[k])
                ta, tb = top(a), top(b)
                if ta == tb:
                    continue
                x, y = shingles(a), shingles(b)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    ok[k] = True
                    root[max(ta, tb)] = min(ta, tb)
            return ok

        return accept

    return prepare


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 2048, most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, component_id): documents linked by the Jaccard similarity of their word shingles.

    A radius of two bits reaches only copies that hardly differ, and no radius holds
    all documents alike by their sets (a fingerprint counts repeats), so here shards
    come from min-hash bands (20 of 5 minima: a pair at 0.8 shares one with
    probability 0.9996), and the exact similarity of the shingles decides on every pair
    of a shard that the estimate doesn't rule out. Documents of equal words in order are
    one from the start. Keys of a single document, and all but one of the keys that hold the same
    documents, are dropped before any set is made. A shard of over ``most`` documents is compared in blocks (``linked``).
    """
    rows = cut(sketches(docs, shingle))
    reps = cut(rows.filter("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys")))
    light = cut(reps.selectExpr("node", "explode(keys) AS key"))
    shared = light.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    light = cut(light.join(shared, "key"), light)
    members = light.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    light = cut(light.join(members.groupBy("n", "first", "x", "y").agg(F.min("key").alias("key")).select("key"), "key"), light)
    wanted = cut(light.select("node").distinct())
    few = wanted.limit(most_broadcast + 1).count() <= most_broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("node"), "left_semi")
    sets = sketches(own, shingle, sets=True)
    if not rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():  # sets are large: they travel for repeated ids only
        sets = sets.dropDuplicates(["doc_id"])
    sets = cut(sets.withColumnRenamed("doc_id", "node"))
    roots = linked(light.join(sets, "node"), alike(similarity), most)
    forget(light, wanted, sets)
    by_same = reps.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return rows.select("doc_id", "same").join(by_same, "same", "left").select("doc_id", "component_id")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
