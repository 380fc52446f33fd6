"""Hybrid search over embedded sections, evidence linking, provenance and review."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType
from pyspark.sql.types import DataType

from caselake.functions.scalar import bound, cited_exhibits, cosine, set_similarity, trigrams
from caselake.operators.graph import components, kept
from caselake.operators.relational import evidence_gaps, structural_filter


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_search(emb: DataFrame, qvec: list[float], k: int = 10, threshold: float = 0.3, **filters) -> DataFrame:
    """Top k sections by cosine; the query is a literal, so that no join is needed. Structural filters reach the scan."""
    rows = structural_filter(emb, **filters).withColumn("semantic_score", cosine("embedding", _literal(qvec)))
    return rows.filter(F.col("semantic_score") >= threshold).orderBy(F.col("semantic_score").desc(), "section_id").limit(k)


def hybrid_search(emb: DataFrame, qvec: list[float], qtext: str, limit: int = 10, weight: float = 0.7, threshold: float = 0.3, mode: str = "semantic", **filters) -> DataFrame:
    """Semantic hits (top 3 x limit), their keyword score by trigrams, ranked by weight * semantic + (1 - weight) * keyword.

    mode 'union' also lets keyword hits in that are no semantic ones.
    """
    rows = structural_filter(emb, **filters)
    sem = vector_search(rows, qvec, 3 * limit, threshold).select("section_id", "semantic_score")
    q = trigrams(F.lit(qtext))
    # scored and filtered inside one generator, so that no row's trigrams are made twice
    scored = F.array(bound(lambda t: set_similarity(t, q), trigrams("search_text")))
    kw = rows.select("section_id", F.explode(F.filter(scored, lambda x: x >= 0.3)).alias("keyword_score"))
    kw = kw.orderBy(F.col("keyword_score").desc(), "section_id").limit(3 * limit).select("section_id", "keyword_score")
    hits = sem.join(kw, "section_id", "full" if mode == "union" else "left")
    score = weight * F.coalesce("semantic_score", F.lit(0.0)) + (1 - weight) * F.coalesce("keyword_score", F.lit(0.0))
    hits = hits.select("section_id", F.round(F.coalesce("semantic_score", F.lit(0.0)), 4).alias("semantic_score"), F.round(F.coalesce("keyword_score", F.lit(0.0)), 4).alias("keyword_score"), F.round(score, 4).alias("score"))
    order = [F.col("score").desc(), F.col("section_id")]
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def batch_search(emb: DataFrame, queries: DataFrame, k: int = 3, most_queries: int = 10_000) -> DataFrame:
    """Top k sections of each query's case. queries: query_id, case_id, qvec.

    A stated set of queries is matched against the rows of its case; it is
    broadcast up to ``most_queries`` and joined by case beyond. Each task keeps its own best k.
    """
    small = queries.limit(most_queries + 1).count() <= most_queries
    pairs = emb.join(F.broadcast(queries) if small else queries, "case_id").withColumn("s", cosine("embedding", "qvec"))
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "section_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "section_id", F.round("s", 4).alias("score"), "rank")


def enrich_hits(hits: DataFrame, sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with title, file name and provenance."""
    s = sections.select("section_id", "document_id", "section_title", "start_page")
    out = hits.join(s, "section_id", "left").join(docs.select("document_id", "file_name"), "document_id", "left")
    return out.withColumn("provenance", F.to_json(F.struct("document_id", "file_name", "start_page")))


def query_extractions(ext: DataFrame, docs: DataFrame, kind: str | None = None, name: str | None = None, doc_type: str | None = None, limit: int = 50) -> DataFrame:
    from caselake.operators.aggregates import ranked
    from caselake.operators.relational import ilike_contains

    rows = ext.filter(F.col("extraction_type") == kind) if kind else ext
    rows = rows.filter(ilike_contains("entity_name", name)) if name else rows
    d = docs.filter(F.col("document_type") == doc_type) if doc_type else docs
    rows = rows.join(d.select("document_id", "document_type", "file_name"), "document_id")
    return ranked(rows, [F.col("confidence").desc(), F.col("extraction_id"), F.col("entity_name")], limit)


def find_sections(sections: DataFrame, text: str | None = None, label: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    from caselake.operators.relational import ilike_contains

    if text:
        sections = sections.filter(ilike_contains("section_text", text))
    if label:
        sections = sections.filter(F.col("semantic_label") == label)
    return sections.filter(F.col("start_page").between(*pages)) if pages else sections


def near_duplicates(sections: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(document_id, duplicate_of): documents whose first sections are alike, closed over chains; duplicate_of is the smallest id of the group.

    sections: document_id, section_text (one row per document). Alike: sets of word shingles (the whole text where it has fewer words) with that Jaccard similarity.
    Exact, by prefix filtering: of a text's n shingles in order of rarity, a partner holds one of the first
    n - ceil(similarity x n) + 1. Equal sets are one row from the start. Shared prefixes give links to their first text first; only texts that
    this leaves in several groups are compared pair by pair.
    """
    own = sections.filter("section_text IS NOT NULL").select("document_id", F.filter(F.split(F.lower("section_text"), r"\s+"), lambda w: w != "").alias("w")).filter("size(w) > 0")
    runs = F.expr(f"CASE WHEN size(w) <= {words} THEN array(xxhash64(array_join(w, ' '))) ELSE array_distinct(transform(sequence(1, size(w) - {words - 1}), i -> xxhash64(array_join(slice(w, i, {words}), ' ')))) END")
    own = own.select("document_id", F.array_sort(runs).alias("s"))
    reps = kept(own.groupBy("s").agg(F.min("document_id").alias("d")))
    grams = reps.select("d", F.size("s").alias("n"), F.explode("s").alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("df"))
    ranked = grams.join(often, "g").withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("df", "g")))
    prefix = kept(ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.round(F.col("n") * similarity, 9)) + 1).filter("df > 1").select("g", "d", "n"))
    sets = reps.select("d", "s")

    def confirmed(pairs: DataFrame) -> DataFrame:
        fit = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
        pairs = pairs.filter(fit).select("a", "b").distinct().join(sets.select(F.col("d").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return kept(pairs.filter(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))

    first = prefix.groupBy("g").agg(F.min(F.struct(F.col("d").alias("b"), F.col("n").alias("m"))).alias("f")).select("g", "f.*")
    links = confirmed(prefix.join(first, "g").filter("d <> b").select(F.col("d").alias("a"), "b", "n", "m"))
    roots = components(links)
    left = kept(prefix.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d")))
    apart = left.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("g")
    open_ = left.join(apart, "g", "left_semi")
    other = open_.select("g", F.col("d").alias("b"), F.col("n").alias("m"), F.col("root").alias("_r"))
    links = links.unionByName(confirmed(open_.join(other, "g").filter("root <> _r AND d > b").select(F.col("d").alias("a"), "b", "n", "m")))
    roots = components(links).select(F.col("node").alias("d"), "root")
    found = reps.join(roots, "d", "left").select("s", F.coalesce("root", "d").alias("duplicate_of"))
    return own.join(found, "s").select("document_id", "duplicate_of")


# -- models ----------------------------------------------------------------------------------


def with_model(df: DataFrame, text: str, model: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], returns: DataType, to: str) -> DataFrame:
    """df with what a model says of a column: a function from an iterator of series to one, so that it is loaded once per task and sees Arrow batches."""
    return df.withColumn(to, F.pandas_udf(model, returns, PandasUDFType.SCALAR_ITER)(F.col(text)))


# -- evidence --------------------------------------------------------------------------------


def explicit_links(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Cited labels to documents of the case: by exhibit label, else by file name; 0.95, or 0 without a document. items: item_id, case_id, ref.

    A case's distinct labels meet its distinct file names, each name standing for its smallest document, through the trigram they must share; labels of one or two characters through the name's own pieces of that length.
    """
    pieces = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))))))
    d = docs.groupBy("case_id", F.lower("file_name").alias("_f")).agg(F.min("document_id").alias("document_id"))
    refs = items.select("case_id", F.lower("ref").alias("_r")).distinct().filter("_r <> ''").withColumn("g", F.substring("_r", 1, 3))
    pairs = refs.join(d.select("case_id", "_f", "document_id", pieces("_f").alias("g")), ["case_id", "g"]).filter(F.col("_f").contains(F.col("_r")))
    rule = F.when(F.col("_f").endswith(F.concat(F.lit("exhibit_"), F.col("_r"))), 1).otherwise(2)
    found = pairs.groupBy("case_id", "_r").agg(F.min(F.struct(rule.alias("rule"), "document_id")).alias("m"))
    rows = items.withColumn("_r", F.lower("ref")).join(found, ["case_id", "_r"], "left")
    return rows.select("item_id", "ref", "m.document_id", F.when(F.col("m").isNull(), 0.0).otherwise(0.95).alias("confidence"))


def implicit_links(items: DataFrame, emb: DataFrame, explicit: DataFrame, k: int = 2, least: float = 0.3) -> DataFrame:
    """Top k documents by similarity that an item doesn't cite already. items: query_id, case_id, qvec."""
    hits = batch_search(emb, items, 4 * k).filter(F.col("score") >= least).join(emb.select("section_id", "document_id"), "section_id")
    docs = hits.groupBy(F.col("query_id").alias("item_id"), "document_id").agg(F.max("score").alias("score"))
    new = docs.join(explicit.select("item_id", "document_id").distinct(), ["item_id", "document_id"], "left_anti")
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "document_id")
    return new.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def link_stats(links: DataFrame, by: str = "kind") -> DataFrame:
    return links.groupBy(by).agg(F.count("*").alias("links"), F.count_if(F.col("document_id").isNotNull()).alias("resolved"), F.countDistinct("item_id").alias("items"))


def provenance(answers: DataFrame, hits: DataFrame, least: float = 0.65) -> DataFrame:
    """Sources of each answer: distinct by file and title, named in the answer or of a high score."""
    rows = answers.join(hits, "answer_id").filter(((F.length("title") > 4) & F.contains(F.lower("answer"), F.lower("title"))) | (F.col("score") >= least))
    w = Window.partitionBy("answer_id", "file_name", "title").orderBy(F.col("score").desc(), "section_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("answer_id", "file_name", "title", "section_id", F.substring("text", 1, 200).alias("snippet"))


def review_outcomes(responses: DataFrame, reviews: DataFrame) -> DataFrame:
    return responses.join(reviews, "response_id", "left").groupBy("case_id").pivot("outcome", ["approved", "corrected", "rejected"]).count().na.fill(0)


def parse_hits(texts: DataFrame) -> DataFrame:
    """Rows of a formatted search text: '[1] file - title (score 0.71)' and the lines below it. texts: answer_id, text."""
    pattern = r"^\[(\d+)\] (.+?) - (.+) \(score ([\d.]+)\)$"
    lines = texts.select("answer_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("answer_id").orderBy("pos")
    rows = lines.withColumn("block", F.sum(F.col("line").rlike(pattern).cast("int")).over(w))
    heads = rows.filter(F.col("line").rlike(pattern)).select("answer_id", "block", F.regexp_extract("line", pattern, 2).alias("file_name"), F.regexp_extract("line", pattern, 3).alias("title"), F.regexp_extract("line", pattern, 4).cast("double").alias("score"))
    body = rows.filter(~F.col("line").rlike(pattern) & (F.col("block") > 0)).groupBy("answer_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("answer_id", "block", F.expr("array_join(transform(l, x -> x.line), '\\n')").alias("text"))
    return heads.join(body, ["answer_id", "block"], "left")


def tool_log(messages: DataFrame) -> DataFrame:
    """Calls with the result that answers them, in order, as one list per session. messages: session_id, turn, role, call_id, text."""
    calls = messages.filter("role = 'user'").select("session_id", "call_id", "turn", F.col("text").alias("call"))
    results = messages.filter("role = 'assistant'").select("session_id", "call_id", F.substring("text", 1, 300).alias("summary"))
    rows = calls.join(results, ["session_id", "call_id"], "left")
    step = F.concat_ws(" => ", F.substring("call", 1, 40), F.substring("summary", 1, 40))
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("step")))).alias("l")).select("session_id", F.expr("array_join(transform(l, x -> x.step), '\\n')").alias("steps"))


def response_rows(answers: DataFrame, messages: DataFrame, longest: int = 2000) -> DataFrame:
    """Answers as they are stored, each with the calls made for it, in order, and the first 300 characters of their results.

    answers: case_id, session_id, query, agent_name, answer, confidence, needs_review; messages: session_id, turn, kind ('call' or 'result'), call_id, tool_name, args, text.
    Answers without a case or a text aren't stored. A null session is 'unknown' and has no calls; queries are cut at ``longest`` characters.
    """
    rows = answers.filter("case_id IS NOT NULL AND answer <> ''")
    calls = messages.filter("kind = 'call'").select("session_id", "call_id", "turn", "tool_name", "args")
    results = messages.filter("kind = 'result'").groupBy("session_id", "call_id").agg(F.max(F.struct("turn", F.substring("text", 1, 300).alias("text")))["text"].alias("result_summary"))
    steps = calls.join(results, ["session_id", "call_id"], "left").withColumn("result_summary", F.coalesce("result_summary", F.lit("")))
    made = F.transform(F.array_sort(F.collect_list(F.struct("turn", "call_id", "tool_name", "args", "result_summary"))), lambda c: F.struct(c["tool_name"].alias("tool_name"), c["args"].alias("args"), c["result_summary"].alias("result_summary")))
    steps = steps.groupBy("session_id").agg(made.alias("tool_calls_made"))
    out = rows.join(steps, "session_id", "left")
    none = F.array().cast(steps.schema["tool_calls_made"].dataType)
    return out.select("case_id", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.substring("query", 1, longest).alias("query"), "agent_name", "answer", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "needs_review", F.coalesce("tool_calls_made", none).alias("tool_calls_made"))


# -- tools -----------------------------------------------------------------------------------


def query_kg(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, edge_type: str | None = None, label: str | None = None) -> DataFrame:
    """(src_label, edge_type, dst_label, confidence): edges that leave the nodes asked for, equal ones once with their greatest confidence.

    nodes: node_id, node_type, node_label, those of the case; a target that isn't among the nodes asked for is named by the first 8 characters of its id.
    """
    found = nodes.select("node_id", "node_type", "node_label")
    if node_type:
        found = found.filter(F.col("node_type") == node_type)
    if label:
        found = found.filter(F.contains(F.lower("node_label"), F.lit(label.lower())))
    e = edges.filter(F.col("edge_type") == edge_type) if edge_type else edges
    src = found.select(F.col("node_id").alias("src"), F.col("node_label").alias("src_label"))
    dst = found.select(F.col("node_id").alias("dst"), F.col("node_label").alias("_dst"))
    rows = e.join(src, "src").join(dst, "dst", "left")
    return rows.groupBy("src_label", "edge_type", F.coalesce("_dst", F.substring("dst", 1, 8)).alias("dst_label")).agg(F.max("confidence").alias("confidence"))


def match_evidence(items: DataFrame, docs: DataFrame, emb: DataFrame, k: int = 2, least: float = 0.4) -> DataFrame:
    """Evidence for texts: documents they cite (0.95), then the ``k`` most alike that they don't cite.

    items: item_id, case_id, text, qvec (null where there is none). One row per link: item_id, document_id, link_type, reference, confidence.
    Cited labels that no document of the case bears give no row; texts of 20 characters or fewer aren't compared.
    """
    refs = items.select("item_id", "case_id", F.explode(cited_exhibits("text")).alias("ref"))
    cited = explicit_links(refs, docs).filter("document_id IS NOT NULL")
    explicit = cited.select("item_id", "document_id", F.lit("explicit_citation").alias("link_type"), F.col("ref").alias("reference"), "confidence").distinct()
    alike = implicit_links(items.filter("length(text) > 20 AND qvec IS NOT NULL").select(F.col("item_id").alias("query_id"), "case_id", "qvec"), emb, cited, k, least)
    return explicit.unionByName(alike.select("item_id", "document_id", F.lit("agent_discovered").alias("link_type"), F.lit(None).cast("string").alias("reference"), F.col("score").alias("confidence")))


def link_evidence(items: DataFrame, docs: DataFrame, emb: DataFrame, links: DataFrame, k: int = 2, least: float = 0.4) -> DataFrame:
    """``match_evidence`` for all items that no link with a document names yet (links: item_id, document_id)."""
    return match_evidence(evidence_gaps(items, links, "item_id"), docs, emb, k, least)
