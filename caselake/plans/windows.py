"""Queries over ordered work."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import windows as W
from caselake.plans.registry import query


@query("slice_lead", "SELECT section_id, coalesce(lead(pos) OVER (PARTITION BY document_id ORDER BY pos), pos + 1) AS stop FROM v_sections WHERE level <= 1")
def _(v):
    return W.next_boundary(v("v_sections").filter("level <= 1"), "document_id", "pos", F.col("pos") + 1).select("section_id", "stop")


@query("end_pages", "WITH s AS (SELECT section_id, document_id, pos, level, CAST(floor(pos / 3) AS BIGINT) + 1 AS page FROM v_sections) SELECT a.section_id, CASE WHEN count(b.pos) = 0 THEN greatest(any_value(a.page), 50) ELSE greatest(any_value(a.page), arg_min(b.page, b.pos) - 1) END AS end_page FROM s a LEFT JOIN s b ON b.document_id = a.document_id AND b.pos > a.pos AND b.level <= a.level GROUP BY a.section_id")
def _(v):
    s = v("v_sections").withColumn("page", F.floor(F.col("pos") / 3) + 1)
    return W.assign_end_pages(s, F.lit(50)).select("section_id", "end_page")


@query("build_parents", "WITH s AS (SELECT section_id, document_id, pos, level FROM v_sections) SELECT a.section_id, arg_max(b.section_id, b.pos) AS parent_section_id FROM s a LEFT JOIN s b ON b.document_id = a.document_id AND b.pos < a.pos AND b.level < a.level GROUP BY 1")
def _(v):
    return W.build_parents(v("v_sections")).select("section_id", "parent_section_id")


@query("page_fill", "SELECT document_id, pos, last_value(CASE WHEN pos % 20 = 0 THEN pos / 20 + 1 END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos) AS page FROM v_lines")
def _(v):
    from caselake.functions.scalar import page_number

    lines = v("v_lines").withColumn("line", F.expr("CASE WHEN pos % 20 = 0 THEN '## Page ' || CAST(pos DIV 20 + 1 AS string) ELSE line END"))
    return W.fill_forward(lines.withColumn("n", page_number("line")), "document_id", "pos", "n", "page").select("document_id", "pos", F.col("page").cast("double").alias("page"))


@query("boundary_context", "WITH l AS (SELECT document_id, pos, CASE WHEN pos % 4 = 2 THEN ' ' ELSE line END AS line FROM v_lines) SELECT a.document_id, a.pos, a.pos - max(b.pos) FILTER (b.pos % 20 = 0) AS since_marker, a.pos - 1 - coalesce(max(b.pos) FILTER (b.pos < a.pos AND trim(b.line) <> ''), -1) AS blanks_before FROM l a JOIN l b ON b.document_id = a.document_id AND b.pos <= a.pos GROUP BY 1, 2")
def _(v):
    lines = v("v_lines").withColumn("line", F.expr("CASE WHEN pos % 4 = 2 THEN ' ' ELSE line END"))
    return W.boundary_context(lines, F.col("pos") % 20 == 0).select("document_id", "pos", "since_marker", "blanks_before")


@query("latest_job", "SELECT job_id, intake_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, intake_id DESC) AS rn FROM v_intake) WHERE rn = 1")
def _(v):
    return W.first_seen(v("v_intake"), ["job_id"], F.col("created_at").desc(), F.col("intake_id").desc()).select("job_id", "intake_id", "status")


@query("first_seen", "SELECT document_id, semantic_label, min(pos) AS pos FROM v_sections WHERE semantic_label IS NOT NULL GROUP BY 1, 2")
def _(v):
    return W.first_seen(v("v_sections").filter("semantic_label IS NOT NULL"), ["document_id", "semantic_label"], F.col("pos")).select("document_id", "semantic_label", "pos")


@query("suffix_duplicates", "SELECT section_id, CASE WHEN n > 1 THEN label || '_' || CAST(n AS VARCHAR) ELSE label END AS unique_label FROM (SELECT section_id, 'Exhibit ' || CAST(level AS VARCHAR) AS label, row_number() OVER (PARTITION BY document_id, level ORDER BY pos) AS n FROM v_sections)")
def _(v):
    s = v("v_sections").withColumn("label", F.expr("'Exhibit ' || CAST(level AS string)"))
    return W.suffix_duplicates(s, "document_id", "label", F.col("pos")).select("section_id", "unique_label")


@query("largest_block", "WITH p AS (SELECT DISTINCT document_id, pos AS page FROM v_sections WHERE length(section_text) > 120), i AS (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS g FROM p), r AS (SELECT document_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM i GROUP BY document_id, g) SELECT document_id, first_page, last_page, n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first_page) AS rn FROM r) WHERE rn = 1")
def _(v):
    pages = v("v_sections").filter("length(section_text) > 120").select("document_id", F.col("pos").alias("page")).distinct()
    return W.largest_block(pages)


@query("margin_numbers", "WITH c AS (SELECT document_id, pos, CASE WHEN pos % 9 = 8 THEN 500 ELSE pos + 1 END AS number FROM v_lines), k AS (SELECT document_id, number - lag(number) OVER (PARTITION BY document_id ORDER BY pos) AS s FROM c WHERE number BETWEEN 1 AND 400), a AS (SELECT document_id, count(*) AS candidates, count(*) FILTER (s = 1) AS steps FROM k GROUP BY 1) SELECT *, candidates >= 8 AND steps >= greatest(4.0, 0.35 * candidates) AS has_margin FROM a")
def _(v):
    lines = v("v_lines").withColumn("number", F.expr("CASE WHEN pos % 9 = 8 THEN 500 ELSE pos + 1 END"))
    return W.margin_numbers(lines)


@query("densest_window", "WITH d AS (SELECT document_id, pos, round(avg(CAST(length(line) < 60 AS INTEGER)) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS density FROM v_lines) SELECT document_id, pos AS start_pos, density FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY density DESC, pos) AS rn FROM d WHERE pos % 3 = 0 AND density >= 0.1) WHERE rn = 1")
def _(v):
    return W.densest_window(v("v_lines"), F.length("line") < 60, 10, 3)


@query("primary_filing", "SELECT document_id, string_split(document_type, ' - ')[1] AS category, case_id IS NOT NULL AND row_number() OVER (PARTITION BY case_id, string_split(document_type, ' - ')[1] ORDER BY created_at, document_id) = 1 AS is_primary FROM v_docs")
def _(v):
    return W.primary_filing(v("v_docs")).select("document_id", "category", "is_primary")


@query("stage_history", "WITH r AS (SELECT case_id, document_id, created_at, CASE WHEN starts_with(document_type, 'Pleading - Complaint') THEN 1 WHEN starts_with(document_type, 'Pleading - Answer') THEN 2 WHEN starts_with(document_type, 'Discovery') THEN 3 WHEN starts_with(document_type, 'Pleading - Motion') THEN 4 WHEN starts_with(document_type, 'Court - Order') THEN 5 ELSE 0 END AS r FROM v_docs WHERE case_id IS NOT NULL), w AS (SELECT *, max(r) OVER (PARTITION BY case_id ORDER BY created_at, document_id ROWS UNBOUNDED PRECEDING) AS stage, coalesce(max(r) OVER (PARTITION BY case_id ORDER BY created_at, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT case_id, document_id, before, stage FROM w WHERE stage > before")
def _(v):
    return W.stage_history(v("v_docs"))


@query("topk_per_group", "SELECT case_id, document_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, document_id) AS rank FROM v_docs) WHERE rank <= 3")
def _(v):
    return W.top_k_per(v("v_docs"), ["case_id"], 3, F.col("n_chars").desc(), F.col("document_id")).select("case_id", "document_id", "n_chars", "rank")


@query("best_match", "SELECT src, dst, round(confidence, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS rn FROM (SELECT src, dst, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM v_edges) WHERE confidence >= 0.93) WHERE rn = 1")
def _(v):
    # repeats of an edge tie in all that is returned, so one sort by src takes the place of the exchanges and hash tables that would drop them
    e = v("v_edge_rows").withColumn("confidence", F.round(F.col("confidence").cast("double"), 4)).filter("confidence >= 0.93")
    return W.top_k_per(e, ["src"], 1, F.col("confidence").desc(), F.col("dst")).select("src", "dst", "confidence")


@query("queue_rank", "SELECT intake_id, firm_id, row_number() OVER (PARTITION BY firm_id ORDER BY CASE process_priority WHEN 'immediate' THEN 0 WHEN 'soon' THEN 1 WHEN 'overnight' THEN 2 ELSE 3 END, created_at, intake_id) AS rank FROM v_intake WHERE status IN ('pending', 'failed')")
def _(v):
    return W.queue_rank(v("v_intake")).select("intake_id", "firm_id", "rank")


@query("history_split", "SELECT session_id, turn, CASE WHEN count(*) OVER (PARTITION BY session_id) <= 6 OR row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3 THEN 'keep' ELSE 'summarise' END AS part FROM v_responses")
def _(v):
    return W.history_split(v("v_responses"), 6, 2).select("session_id", "turn", "part")


@query("idle_sessions", "WITH g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS s FROM v_intake WINDOW w AS (PARTITION BY job_id ORDER BY created_at, intake_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY job_id ORDER BY created_at, intake_id ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT job_id, burst, count(*) AS n, min(intake_id) AS first_id FROM b GROUP BY 1, 2")
def _(v):
    return W.idle_sessions(v("v_intake"), "job_id", "created_at", 1800)


@query("tumbling_summary", "SELECT firm_id, CAST(time_bucket(INTERVAL 1 DAY, created_at) AS VARCHAR) AS day, count(*) AS items, count(*) FILTER (status = 'failed') AS failed FROM v_intake GROUP BY 1, 2")
def _(v):
    from caselake.streaming.operators import nightly_summary

    return nightly_summary(v("v_intake")).select("firm_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "items", "failed")


@query("sliding_activity", "WITH b AS (SELECT firm_id, time_bucket(INTERVAL 15 MINUTE, created_at) - to_minutes(15 * k) AS s FROM v_intake, (SELECT unnest(range(0, 4)) AS k)) SELECT firm_id, CAST(s AS VARCHAR) AS start, count(*) AS n FROM b GROUP BY 1, 2")
def _(v):
    from caselake.streaming.operators import sliding_activity

    return sliding_activity(v("v_intake")).select("firm_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("job_state", "SELECT job_id, arg_max(status, row(created_at, intake_id)) AS last_status, count(*) FILTER (status = 'failed') AS failures, CASE WHEN arg_max(status, row(created_at, intake_id)) = 'failed' AND count(*) FILTER (status = 'failed') <= 3 THEN 'retry' WHEN arg_max(status, row(created_at, intake_id)) = 'failed' THEN 'dead' ELSE 'ok' END AS state FROM v_intake GROUP BY 1")
def _(v):
    from caselake.streaming.operators import job_state

    return job_state(v("v_intake"))


@query("step_status", "SELECT job_id, status, CAST(min(created_at) AS VARCHAR) AS started, CAST(max(created_at) AS VARCHAR) AS ended, arg_max(intake_id, row(created_at, intake_id)) AS last_id FROM (SELECT job_id, status, date_trunc('second', created_at) AS created_at, intake_id FROM v_intake) GROUP BY 1, 2")
def _(v):
    from caselake.streaming.operators import step_status

    i = v("v_intake").withColumn("created_at", F.date_trunc("second", "created_at"))
    return step_status(i).select("job_id", "status", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "last_id")
