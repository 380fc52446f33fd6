"""Grouped summaries and ranked lists; every group is pre-aggregated before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from caselake.operators.graph import kept


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def best_name(ext: DataFrame, kind: str, key: str, least: float = 0.65, roles: set[str] | None = None) -> DataFrame:
    """Most mentioned name of a type for each key, then of the highest mean confidence, then the first by name."""
    rows = ext.filter((F.col("extraction_type") == kind) & (F.col("confidence") >= least))
    if roles:
        rows = rows.filter(F.get_json_object("properties", "$.role_in_document").isin(sorted(roles)))
    named = rows.groupBy(key, "entity_name").agg(F.count("*").alias("mentions"), F.avg("confidence").alias("mean"))
    return named.groupBy(key).agg(F.expr("min_by(struct(entity_name, mentions, round(mean, 4) AS mean), struct(-mentions, -round(mean, 9), entity_name)) AS b")).select(key, "b.*")


def mode_with_count(df: DataFrame, key: str, value: str) -> DataFrame:
    """Commonest value of each key (the smaller on ties) with its support."""
    return df.groupBy(key, value).agg(F.count("*").alias("support")).groupBy(key).agg(F.expr(f"min_by(struct({value}, support), struct(-support, {value})) AS b")).select(key, "b.*")


def session_rollup(responses: DataFrame) -> DataFrame:
    first = F.expr("min_by(substring(text, 1, 80), turn)")
    return responses.groupBy("session_id").agg(F.count("*").alias("messages"), first.alias("first_query"), F.max("turn").alias("last_turn"))


def run_metrics(results: DataFrame, key: str) -> DataFrame:
    done = F.col("status") == "completed"
    return results.groupBy(key).agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("value") > 80).alias("flagged"), F.round(F.avg(F.when(done, F.col("value"))), 9).alias("mean_value"),
        F.when(F.count_if(F.col("status") == "failed") > 0, "partial").otherwise("complete").alias("outcome"),
    )


def eligible_children(docs: DataFrame, sections: DataFrame, least: int = 2000) -> DataFrame:
    """Child documents whose sections hold at least ``least`` characters."""
    chars = sections.groupBy("document_id").agg(F.sum(F.length("section_text")).alias("chars"))
    return docs.filter("parent_document_id IS NOT NULL").select("document_id").join(chars, "document_id").filter(F.col("chars") >= least)


def embedding_coverage(sections: DataFrame, embedded: DataFrame) -> DataFrame:
    e = embedded.select("section_id", F.lit(1).alias("_e"))
    return sections.join(e, "section_id", "left").groupBy("file_name").agg(F.count("*").alias("sections"), F.count("_e").alias("embedded"))


def case_dashboard(docs: DataFrame, extractions: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, waiting: DataFrame | None = None) -> DataFrame:
    """One row per case: each table is reduced to its documents, then to cases, before it is joined.

    edges (src, dst) count for the case of their source node; waiting (document_id) are the documents that aren't processed yet.
    """
    own = docs.filter("case_id IS NOT NULL").select("document_id", "case_id", "document_type")
    kind = lambda k: F.count_if(F.col("document_type").startswith(k))
    d = own.groupBy("case_id").agg(F.count("*").alias("documents"), kind("Pleading").alias("pleadings"), kind("Contract").alias("contracts"))
    x = extractions.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.count_if(F.col("confidence") < 0.7).alias("low"))
    x = own.join(x, "document_id").groupBy("case_id").agg(F.sum("n").alias("extractions"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_confidence"), F.sum("low").alias("low_confidence"))
    n = nodes.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("node_type") == "claim").alias("c"))
    n = own.join(n, "document_id").groupBy("case_id").agg(F.sum("n").alias("nodes"), F.sum("c").alias("claims"))
    out = d.join(x, "case_id", "left").join(n, "case_id", "left")
    filled = ["extractions", "low_confidence", "nodes", "claims"]
    if edges is not None:
        e = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n")).join(nodes.select("node_id", "document_id"), "node_id")
        e = e.groupBy("document_id").agg(F.sum("n").alias("n"))
        out = out.join(own.join(e, "document_id").groupBy("case_id").agg(F.sum("n").alias("edges")), "case_id", "left")
        filled.append("edges")
    if waiting is not None:
        w = own.join(waiting.select("document_id"), "document_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("pending"))
        out = out.join(w, "case_id", "left")
        filled.append("pending")
    return out.na.fill(0, filled)


def paged(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """One page of rows in order, each with the number of all rows, which is observed while the page is made: df runs once."""
    seen = Observation()
    page = kept(df.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order).offset(offset).limit(n))
    return page.orderBy(*order).withColumn("total", F.lit(seen.get["total"]).cast("bigint"))


def vocab_sketches(df: DataFrame, by: list[str], column: str, lg_k: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct values of ``column`` for each group, to be stored; new days or cases are added as rows. Standard error about 1.04 / 2^(lg_k / 2)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(lg_k)).alias("sketch"))


def vocab_total(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values over stored sketches, of any groups of them together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def tree_stats(sections: DataFrame) -> DataFrame:
    return sections.groupBy("document_id").agg(F.count_if(F.col("level") == 0).alias("roots"), F.max("level").alias("max_depth"))


def collect_aliases(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("canonical_id").agg(F.array_join(F.array_sort(F.collect_set("node_label")), "|").alias("aliases"))


def merge_aliases(nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """(canonical_id, aliases): the distinct labels that other nodes give their canonical one, and those it has already, sorted.

    nodes: node_id, canonical_id, node_label; existing: canonical_id, aliases (an array, null for none). Canonical nodes with neither have no row.
    """
    new = nodes.filter("node_id <> canonical_id AND node_label IS NOT NULL").select("canonical_id", F.col("node_label").alias("alias"))
    old = existing.select("canonical_id", F.explode("aliases").alias("alias")).filter("alias IS NOT NULL")
    return new.unionByName(old).groupBy("canonical_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def slowest_step(steps: DataFrame) -> DataFrame:
    return steps.groupBy("document_id").agg(F.round(F.sum("seconds"), 4).alias("total"), F.expr("max_by(step, struct(seconds, step))").alias("slowest"))


def confidence_histogram(ext: DataFrame, buckets: int = 5) -> DataFrame:
    return ext.groupBy("extraction_type", F.expr(f"width_bucket(confidence, 0, 1, {buckets})").alias("bucket")).agg(F.count("*").alias("n"))


def case_summary_text(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """One text block per case: its documents in order of arrival, the first marked."""
    line = F.concat(F.lpad(F.col("document_id").cast("string"), 12, "0"), F.lit(":"), F.col("document_type"))
    rows = docs.filter("case_id IS NOT NULL").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("created_at", line.alias("line")))).alias("l"))
    text = F.expr("array_join(transform(l, (x, i) -> concat(CASE WHEN i = 0 THEN '* ' ELSE '- ' END, x.line)), '\\n')")
    return cases.join(rows, "case_id").select("case_id", F.concat(F.col("case_name"), F.lit("\n"), text).alias("summary"))


def ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank: a distributed top-k, then a window over n rows."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
