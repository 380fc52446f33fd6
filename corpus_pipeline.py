"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Filtering stages keep every row that they don't name a reason against, and all
but the last return the columns of ``documents``. A stage works on everything that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from caselake.llm.common import components, cut, forget, ship, table


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns beside the whole row in ``_row``, so that no other column's name can clash with an operator's."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject, by the threshold of their language.

    It learns from all labelled rows of ``documents``; a null text isn't rejected.
    """
    labels = table(spark, sf_dir, "labels")
    net = toxicity.train_filters(table(spark, sf_dir, "documents"), labels, "true")
    outputs = cut(toxicity.logits(packed(docs), net, "_row.text"))  # the texts go through the classifier once
    rated = toxicity.rate(outputs, net, labels, "true", "_row.doc_id", "_row.lang")
    out = rated.filter(~F.coalesce("flagged", F.lit(False)) | F.col("_row.text").isNull()).select("_row.*")
    out._read = [outputs]
    return out


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents; n_chars follows the text.

    The list of dropped lines grows with the documents, so they meet by shuffle at any size: Spark's own choice would broadcast a small list.
    """
    gone = line_dedup.dropped_lines(docs).hint("merge")
    out = packed(docs).join(gone, F.col("_row.doc_id").cast("long") == gone["_doc"], "left")
    text = line_dedup.without("_row.text")
    changed = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("dropped").isNull(), F.col("_row")).otherwise(changed).alias("_row")).select("_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id; a null doc_id is kept.

    Documents are linked by fingerprints that differ in two bits or fewer, sought in BK-trees over shards (as in op1), and
    by the Jaccard similarity of their shingles, which no radius covers; groups are closed over links of both kinds.
    """
    near, alike = simhash.near_duplicates(docs), simhash.similar_documents(docs)
    links = near.select("doc_id", "component_id").unionByName(alike).filter("doc_id <> component_id").selectExpr("doc_id AS a", "component_id AS b")
    gone = components(links).select(F.col("node").alias("_doc"))
    return docs.join(gone, docs["doc_id"] == gone["_doc"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(packed(docs, "doc_id", "source", "text")).filter("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("_row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the whole text, their number, and whether they decode to the text."""
    path = byte_bpe.default_path()
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text")), path, offsets=False, decoded=True)
    return coded.selectExpr("doc_id", "lang", "source", "ids", "size(ids) AS n_tokens", "decoded = CAST(coalesce(text, '') AS binary) AS exact")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written to the shared folder as Parquet and read back, and the rows of the one before are deleted then."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = cut(out, docs)
        forget(*getattr(out, "_read", []))  # what the stage had stored for its rows
    return docs


#: SQL can't express a trained classifier, fingerprint groups or merges by rank; tests/llm holds brute-force versions.
ORACLE_SQL = None
