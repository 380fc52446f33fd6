"""Line dedup with a log-template tree.

Tokens that hold a digit, an at sign or a slash are variable fields from the start. The
tree branches by token count and by four leading tokens; within a leaf lines whose
tokens agree at ``alike`` of their places or more join one template, together with
all that they are linked with. A leaf with more than ``leaf_rows`` lines is compared
in blocks of lines that agree on a run of places (``position_blocks``), and a large
block piece by piece (``common.linked``), so that no task holds an unbounded leaf and
size doesn't change the result.
Only lines of leaves with several lines have their text compared.

A template that recurs across documents is dropped from all of them but the
one of smallest doc_id, if it has ``least_tokens`` tokens or more. Copies of one
document don't make its lines recur: the documents of one group of the near-dedup
(``simhash.similar_documents``: five-word shingles, Jaccard similarity 0.8, closed)
count once, since all but one of them go there. What it leaves apart counts apart.

Cases: a null text stays null; blank lines are never dropped; lines of a null
doc_id are never dropped but count as one document; rows with equal doc_id are
one document, and its lines are kept or dropped alike; a line
within a single document may repeat; a document that loses all its lines has
the empty text; empty tables give empty results; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, join_counted, linked, spread, table
from .simhash import similar_documents

FIELD = b"<*>"
MARKS = b"0123456789@/"


def masked_tokens(line: bytes) -> list[bytes]:
    """The line's tokens; one that holds a digit, an at sign or a slash is a variable field."""
    tokens = line.split()
    if len(line.translate(None, MARKS)) == len(line):
        return tokens
    return [t if len(t.translate(None, MARKS)) == len(t) else FIELD for t in tokens]


DEPTHS = (4, 8)


def masked_lines(docs: DataFrame, least_tokens: int) -> DataFrame:
    """(doc_id, pos, h, leaf4, masked) of every line of enough tokens: its hash, its leaf by token count and 4 leading tokens, its masked text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, places, hashes, nodes, texts = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for pos, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                        tokens = masked_tokens(line)
                        if len(tokens) < least_tokens:
                            continue
                        flat = b" ".join(tokens)
                        ids.append(doc)
                        places.append(pos)
                        hashes.append(digest(flat))
                        nodes.append(digest(b" ".join(tokens[: DEPTHS[0]]), len(tokens)))
                        texts.append(flat)
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), longs(hashes), longs(nodes), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "pos", "h", "leaf4", "masked"],
                )

    schema = "doc_id long, pos int, h long, leaf4 long, masked string"
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def copy_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class) of documents that the near-dedup puts in one group with another; class is the group's smallest doc_id."""
    groups = similar_documents(docs.select("doc_id", "text"))
    return groups.filter("doc_id <> component_id").groupBy("doc_id").agg(F.min("component_id").alias("class"))


def agreeing(alike: float):
    """Confirms pairs of lines whose tokens agree at ``alike`` of their places or more."""

    def prepare(t: pa.Table):
        rows = [x.split(" ") for x in t.column("masked").to_pylist()]
        count = np.array([len(r) for r in rows])
        start = np.cumsum(count) - count
        vocabulary: dict[str, int] = {}
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for r in rows for w in r], np.int32)

        def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = count[i] == count[j]
            for n in np.unique(count[i[ok]]):
                pick, step = np.flatnonzero(ok & (count[i] == n)), max(1, (1 << 22) // int(n))
                for at in range(0, len(pick), step):
                    part = pick[at : at + step]
                    ok[part] = (ids[start[i[part], None] + np.arange(n)] == ids[start[j[part], None] + np.arange(n)]).mean(1) >= alike
            return ok

        return accept

    return prepare


def position_blocks(lines: DataFrame, alike: float) -> DataFrame:
    """(key, node): lines by leaf and by each of m + 1 runs of the places after the leading ones, m the most places that may differ: lines that are alike agree on one run whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys, nodes = [], []
            for leaf, h, masked in zip(*(batch.column(c).to_pylist() for c in ("leaf", "h", "masked")), strict=True):
                tokens = masked.encode().split(b" ")
                n, rest = len(tokens), tokens[DEPTHS[0] :]
                m = sum((n - k) / n >= alike for k in range(1, n + 1))
                runs = [rest[k * len(rest) // (m + 1) : (k + 1) * len(rest) // (m + 1)] for k in range(m + 1)] if m < len(rest) else [[]]
                keys += [digest(b"%d %d " % (leaf, k) + b" ".join(r)) for k, r in enumerate(runs)]
                nodes += [h] * len(runs)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(nodes, pa.int64())], names=["key", "node"])

    return lines.select("leaf", "h", "masked").mapInArrow(run, "key long, node long")


def template_links(lines: DataFrame, alike: float, leaf_rows: int = 4000) -> DataFrame:
    """(h, template) of each line that is joined with one of smaller hash, its leaf's smallest that it is linked with. lines: leaf, h, masked; distinct by h.

    A leaf of over ``leaf_rows`` lines is compared within its blocks of agreeing
    places, which no pair that is alike escapes; the result is the same.
    """
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > leaf_rows).select("leaf"))
    texts = lines.select(F.col("h").alias("node"), "masked")
    keyed = lines.selectExpr("leaf AS key", "h AS node", "masked")
    if not large.isEmpty():
        keyed = lines.join(large, "leaf", "left_anti").selectExpr("leaf AS key", "h AS node", "masked")
        blocks = cut(position_blocks(lines.join(large, "leaf", "left_semi"), alike).distinct())
        several = blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        keyed = keyed.unionByName(blocks.join(several, "key").join(texts, "node").select("key", "node", "masked"))
    return linked(keyed, agreeing(alike), leaf_rows).filter("node <> root").selectExpr("node AS h", "root AS template")


def leaves(lines: DataFrame, leaf_rows: int) -> DataFrame:
    """(leaf, h, masked): lines in the leaves of a deeper tree, which parts lines that are alike and so isn't used by op9; full leaves branch by more leading tokens. lines: h, leaf4, leaf8, masked."""
    rows, picked, over = lines, F.col("leaf4"), F.lit(True)
    for depth, nxt in zip(DEPTHS, ("leaf8", "h"), strict=True):
        full = cut(rows.groupBy(f"leaf{depth}").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows).select(F.col(f"leaf{depth}").alias("full")))
        if full.isEmpty():
            break
        rows = rows.join(full, rows[f"leaf{depth}"] == full["full"], "left").withColumn(f"over{depth}", F.col("full").isNotNull()).drop("full")
        over = over & F.col(f"over{depth}")
        picked = F.when(over, F.col(nxt)).otherwise(picked)
    return rows.select(picked.alias("leaf"), "h", "masked")


def recurring_lines(docs: DataFrame, least_documents: int = 2, least_tokens: int = 4, alike: float = 0.8, leaf_rows: int = 4000, most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, pos) of each line to drop; pos counts a text's lines from 0.

    Leaves with several lines are broadcast up to ``most_broadcast`` of them (8 bytes each) and joined by key beyond.
    """
    lines = cut(masked_lines(docs, least_tokens))
    spots = lines.select("doc_id", "pos", "h")
    several = cut(lines.groupBy("leaf4").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("leaf4"))
    few = several.limit(most_broadcast + 1).count() <= most_broadcast
    distinct = cut(lines.join(F.broadcast(several) if few else several, "leaf4", "left_semi").groupBy("h").agg(*[F.min(c).alias(c) for c in ("leaf4", "masked")]))
    joined = cut(template_links(distinct.withColumnRenamed("leaf4", "leaf"), alike, leaf_rows))
    placed = cut(spots.join(joined, "h", "left").selectExpr("doc_id", "pos", "coalesce(template, h) AS t"))
    total = placed.count()
    forget(lines, several, distinct, joined)
    often = placed.groupBy("t").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("none"), F.count("*").alias("n"))
    often = cut(often.filter("low < high OR none").select("t", "low", "n"))
    hits = cut(join_counted(placed, often, "t", total), placed)
    classes = cut(copy_classes(docs))
    classed = hits.select("t", "doc_id").distinct().join(classes, "doc_id", "left").selectExpr("t", "coalesce(class, doc_id, -9223372036854775808L) AS class").distinct()
    recurs = classed.groupBy("t").agg(F.count("*").alias("c")).filter(F.col("c") >= least_documents).select("t")
    recurs = cut(recurs.join(often.select("t", "n"), "t"))
    out = cut(join_counted(hits, recurs, "t", total).filter("doc_id <> low").select("doc_id", "pos").distinct())
    forget(often, hits, classes, recurs)
    return out


def dropped_lines(docs: DataFrame, **how) -> DataFrame:
    """(_doc, dropped): the places of the lines to drop, in order, of each document that has any."""
    return recurring_lines(docs, **how).groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list("pos")).alias("dropped"))


def without(text: str) -> F.Column:
    """The text without the lines at the places in ``dropped``."""
    kept = "transform(array_except(sequence(0, size(parts) - 1), dropped), i -> parts[i])"
    return F.expr(f"transform(array(split(CAST({text} AS string), '\\n')), parts -> array_join({kept}, '\\n'))[0]")


def without_recurring_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with their recurring lines cut out of text, and ``dropped``, the places of those lines."""
    gone = dropped_lines(docs, **how)
    out = docs.drop("dropped").join(gone, docs["doc_id"].cast("long") == gone["_doc"], "left").drop("_doc")
    return out.withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(without("text")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "CAST(coalesce(size(dropped), 0) AS int) AS n_dropped", "array_join(CAST(dropped AS array<string>), ',') AS dropped_lines", "sha2(text, 256) AS text_sha256", "CAST(octet_length(text) AS long) AS text_bytes")
