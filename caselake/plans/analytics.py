"""Queries over aggregates, sorts and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import aggregates as A
from caselake.operators import windows as W
from caselake.plans.registry import query


@query("count_by_type", "SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM v_nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM v_edges GROUP BY 2 UNION ALL SELECT 'extraction', extraction_type, count(*) FROM v_extractions GROUP BY 2")
def _(v):
    parts = [A.count_by(v(t), c).select(F.lit(k).alias("kind"), F.col(c).alias("type"), "n") for k, t, c in (("node", "v_nodes", "node_type"), ("edge", "v_edges", "edge_type"), ("extraction", "v_extractions", "extraction_type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("best_name", "SELECT document_id, entity_name, mentions, mean FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY mentions DESC, round(mean, 9) DESC, entity_name) AS rn FROM (SELECT document_id, entity_name, count(*) AS mentions, round(avg(confidence), 4) AS mean FROM v_extractions WHERE extraction_type = 'party' AND confidence >= 0.65 AND json_extract_string(properties, '$.role_in_document') IN ('plaintiff', 'defendant') GROUP BY 1, 2)) WHERE rn = 1")
def _(v):
    e = v("v_extractions").withColumn("confidence", F.round("confidence", 6))
    return A.best_name(e, "party", "document_id", roles={"plaintiff", "defendant"})


@query("mode_offset", "SELECT document_id, value, support FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY support DESC, value) AS rn FROM (SELECT document_id, length(section_text) % 7 AS value, count(*) AS support FROM v_sections GROUP BY 1, 2)) WHERE rn = 1")
def _(v):
    return A.mode_with_count(v("v_sections").withColumn("value", F.length("section_text") % 7), "document_id", "value")


@query("session_rollup", "SELECT session_id, count(*) AS messages, arg_min(substring(text, 1, 80), turn) AS first_query, max(turn) AS last_turn FROM v_responses GROUP BY 1")
def _(v):
    return A.session_rollup(v("v_responses"))


@query("run_metrics", "SELECT job_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (value > 80) AS flagged, round(avg(value) FILTER (status = 'completed'), 9) AS mean_value, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'complete' END AS outcome FROM v_intake GROUP BY 1")
def _(v):
    return A.run_metrics(v("v_intake"), "job_id")


@query("batch_summary", "SELECT firm_id, count(*) AS items, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (process_priority = 'overnight') AS overnight FROM v_intake GROUP BY 1")
def _(v):
    return v("v_intake").groupBy("firm_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("process_priority") == "overnight").alias("overnight"))


@query("having_min_chars", "SELECT d.document_id, CAST(sum(length(s.section_text)) AS BIGINT) AS chars FROM v_docs d JOIN v_sections s USING (document_id) WHERE d.parent_document_id IS NOT NULL GROUP BY 1 HAVING sum(length(s.section_text)) >= 2000")
def _(v):
    return A.eligible_children(v("v_docs"), v("v_sections"))


@query("embedding_coverage", "SELECT d.file_name, count(*) AS sections, count(*) FILTER (s.pos % 3 = 0) AS embedded FROM v_sections s JOIN v_docs d USING (document_id) GROUP BY 1")
def _(v):
    s = v("v_sections").join(v("v_docs").select("document_id", "file_name"), "document_id")
    return A.embedding_coverage(s, v("v_sections").filter("pos % 3 = 0"))


@query(
    "case_dashboard",
    """WITH own AS (SELECT document_id, case_id, document_type FROM v_docs WHERE case_id IS NOT NULL),
 d AS (SELECT case_id, count(*) AS documents, count(*) FILTER (starts_with(document_type, 'Pleading')) AS pleadings, count(*) FILTER (starts_with(document_type, 'Contract')) AS contracts FROM own GROUP BY 1),
 x AS (SELECT case_id, count(*) AS extractions, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (confidence < 0.7) AS low_confidence FROM own JOIN v_extractions USING (document_id) GROUP BY 1),
 n AS (SELECT case_id, count(*) AS nodes, count(*) FILTER (node_type = 'claim') AS claims FROM own JOIN v_nodes USING (document_id) GROUP BY 1),
 e AS (SELECT case_id, count(*) AS edges FROM own JOIN v_nodes USING (document_id) JOIN v_edges ON src = node_id GROUP BY 1),
 w AS (SELECT case_id, count(*) AS pending FROM own WHERE document_id IN (SELECT intake_id FROM v_intake WHERE status IN ('pending', 'processing')) GROUP BY 1)
 SELECT case_id, documents, pleadings, contracts, coalesce(extractions, 0) AS extractions, mean_confidence, coalesce(low_confidence, 0) AS low_confidence, coalesce(nodes, 0) AS nodes, coalesce(claims, 0) AS claims, coalesce(edges, 0) AS edges, coalesce(pending, 0) AS pending FROM d LEFT JOIN x USING (case_id) LEFT JOIN n USING (case_id) LEFT JOIN e USING (case_id) LEFT JOIN w USING (case_id)""",
)
def _(v):
    waiting = v("v_intake").filter("status IN ('pending', 'processing')").select(F.col("intake_id").alias("document_id"))
    return A.case_dashboard(v("v_docs"), v("v_extractions"), v("v_nodes"), v("v_edges"), waiting)


@query("vocab_union")
def _(v):
    """Distinct labels of all cases from the stored sketches of each: tested against the exact count."""
    return A.vocab_total(A.vocab_sketches(v("v_nodes"), ["document_id", "node_type"], "node_label"), ["node_type"])


@query("paged_total", "SELECT intake_id, status, (SELECT count(*) FROM v_intake) AS total, row_number() OVER (ORDER BY created_at DESC, intake_id DESC) AS rank FROM (SELECT * FROM v_intake ORDER BY created_at DESC, intake_id DESC LIMIT 25 OFFSET 50)")
def _(v):
    order = [F.col("created_at").desc(), F.col("intake_id").desc()]
    return A.ranked(A.paged(v("v_intake"), order, 50, 25), order, 25).select("intake_id", "status", "total", "rank")


@query("tree_stats", "SELECT document_id, count(*) FILTER (level = 0) AS roots, max(level) AS max_depth FROM v_sections GROUP BY 1")
def _(v):
    return A.tree_stats(v("v_sections"))


@query("alias_sets", "SELECT canonical_id, array_to_string(list_sort(list(DISTINCT node_label)), '|') AS aliases FROM (SELECT node_type || '-' || CAST(document_id AS VARCHAR) AS canonical_id, node_label FROM v_nodes) GROUP BY 1")
def _(v):
    return A.collect_aliases(v("v_nodes").withColumn("canonical_id", F.expr("node_type || '-' || CAST(document_id AS string)")))


_CANON = "SELECT node_id, node_label, document_id, min(node_id) OVER (PARTITION BY node_type, document_id) AS canonical_id FROM v_nodes"


@query("alias_merge", f"WITH n AS ({_CANON}), a AS (SELECT canonical_id, node_label AS alias FROM n WHERE node_id <> canonical_id UNION SELECT canonical_id, unnest(['Known as', node_label]) FROM n WHERE node_id = canonical_id AND document_id % 3 = 0) SELECT canonical_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM a GROUP BY 1")
def _(v):
    v("v_nodes").createOrReplaceTempView("v_nodes")
    n = v.spark.sql(_CANON)
    known = n.filter("node_id = canonical_id").selectExpr("canonical_id", "CASE WHEN document_id % 3 = 0 THEN array('Known as', node_label, NULL) END AS aliases")
    return A.merge_aliases(n, known).select("canonical_id", F.array_join("aliases", "|").alias("aliases"))


@query("slowest_step", "SELECT job_id AS document_id, round(sum(value), 4) AS total, arg_max(status, row(value, status)) AS slowest FROM v_intake GROUP BY 1")
def _(v):
    return A.slowest_step(v("v_intake").select(F.col("job_id").alias("document_id"), F.col("status").alias("step"), F.col("value").alias("seconds")))


@query("confidence_hist", "SELECT extraction_type, CAST(CASE WHEN c < 0 THEN 0 WHEN c >= 1 THEN 6 ELSE floor(c * 5) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM (SELECT extraction_type, CAST(intake AS DOUBLE) / 97 AS c FROM (SELECT extraction_type, extraction_id % 101 AS intake FROM v_extractions)) GROUP BY 1, 2")
def _(v):
    e = v("v_extractions").select("extraction_type", (F.col("extraction_id") % 101 / 97).alias("confidence"))
    return A.confidence_histogram(e)


@query("approx_vocab")
def _(v):
    return v("v_nodes").groupBy("node_type").agg(F.approx_count_distinct("node_label", 0.02).alias("labels"))


@query("case_summary_text", "SELECT c.case_id, c.case_name || chr(10) || string_agg(CASE WHEN rn = 1 THEN '* ' ELSE '- ' END || line, chr(10) ORDER BY rn) AS summary FROM v_cases c JOIN (SELECT case_id, lpad(CAST(document_id AS VARCHAR), 12, '0') || ':' || document_type AS line, row_number() OVER (PARTITION BY case_id ORDER BY created_at, document_id) AS rn FROM v_docs) d USING (case_id) GROUP BY c.case_id, c.case_name")
def _(v):
    return A.case_summary_text(v("v_cases"), v("v_docs"))


@query("document_order", "SELECT section_id, row_number() OVER (PARTITION BY document_id ORDER BY start_page ASC NULLS LAST, level, section_id) AS rank FROM v_sections")
def _(v):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy(F.col("start_page").asc_nulls_last(), "level", "section_id")
    return v("v_sections").select("section_id", F.row_number().over(w).alias("rank"))


@query("rank_order", "SELECT intake_id, row_number() OVER (PARTITION BY firm_id ORDER BY CASE process_priority WHEN 'immediate' THEN 0 WHEN 'soon' THEN 1 WHEN 'overnight' THEN 2 ELSE 3 END, created_at, intake_id) AS rank FROM v_intake")
def _(v):
    from pyspark.sql import Window

    rank = F.expr("CASE process_priority WHEN 'immediate' THEN 0 WHEN 'soon' THEN 1 WHEN 'overnight' THEN 2 ELSE 3 END")
    return v("v_intake").select("intake_id", F.row_number().over(Window.partitionBy("firm_id").orderBy(rank, "created_at", "intake_id")).alias("rank"))


@query("review_queue", "SELECT session_id, turn, confidence, row_number() OVER (ORDER BY confidence, session_id, turn) AS rank FROM (SELECT * FROM v_responses WHERE role = 'assistant' AND confidence < 0.5 ORDER BY confidence, session_id, turn LIMIT 20)")
def _(v):
    rows = v("v_responses").filter("role = 'assistant' AND confidence < 0.5").withColumn("confidence", F.col("confidence").cast("double"))
    return A.ranked(rows, [F.col("confidence"), F.col("session_id"), F.col("turn")], 20).select("session_id", "turn", "confidence", "rank")


@query("recent_sessions", "SELECT session_id, case_id, row_number() OVER (ORDER BY last_turn DESC, session_id) AS rank FROM (SELECT session_id, case_id, max(turn) AS last_turn FROM v_responses GROUP BY 1, 2) QUALIFY rank <= 20")
def _(v):
    s = v("v_responses").groupBy("session_id", "case_id").agg(F.max("turn").alias("last_turn"))
    return A.ranked(s, [F.col("last_turn").desc(), F.col("session_id")], 20).select("session_id", "case_id", "rank")


@query("active_cases", "SELECT case_id, last_at, row_number() OVER (ORDER BY last_at DESC, case_id) AS rank FROM (SELECT case_id, CAST(date_trunc('second', max(created_at)) AS VARCHAR) AS last_at FROM v_docs JOIN v_cases USING (case_id) WHERE deleted_at IS NULL GROUP BY 1) QUALIFY rank <= 10")
def _(v):
    live = v("v_cases").filter("deleted_at IS NULL").select("case_id")
    rows = v("v_docs").join(live, "case_id").groupBy("case_id").agg(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))
    return A.ranked(rows, [F.col("last_at").desc(), F.col("case_id")], 10).select("case_id", "last_at", "rank")


@query("notifications", "SELECT intake_id, firm_id, kind, row_number() OVER (PARTITION BY firm_id ORDER BY created_at DESC, intake_id DESC) AS rank FROM (SELECT *, CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'done' ELSE 'needs_answer' END AS kind FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY created_at, intake_id) AS before FROM v_intake)) WHERE status IN ('failed', 'completed', 'pending') AND before IS DISTINCT FROM status QUALIFY rank <= 20")
def _(v):
    return W.notifications(v("v_intake"), 20).select("intake_id", "firm_id", "kind", "rank")
