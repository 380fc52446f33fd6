"""Queries over sources, sinks, predicates, joins, sets and tenancy."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from caselake.operators import relational as R
from caselake.plans.registry import query

MARK = "2024-01-15 00:00:00"
NOW = "2024-01-31 00:00:00"


@query("scan_case_sections", "SELECT s.section_id, s.document_id, d.file_name, d.document_type FROM v_sections s JOIN v_docs d USING (document_id) WHERE d.case_id = 3")
def _(v):
    return R.read_case_sections(v("v_sections"), v("v_docs"), 3).select("section_id", "document_id", "file_name", "document_type")


@query("incremental_since", f"SELECT intake_id, firm_id, status FROM v_intake WHERE created_at > TIMESTAMP '{MARK}'")
def _(v):
    return R.incremental(v("v_intake"), "created_at", MARK).select("intake_id", "firm_id", "status")


@query("listing_new_only", "SELECT intake_id, firm_id, file_hash FROM v_intake i WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM v_intake k WHERE k.status = 'completed' AND k.file_hash = i.file_hash AND k.firm_id = i.firm_id)")
def _(v):
    i = v("v_intake")
    return R.new_only(i.filter("status = 'pending'"), i.filter("status = 'completed'"), ["file_hash", "firm_id"]).select("intake_id", "firm_id", "file_hash")


@query("upsert_latest", "SELECT job_id, intake_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, intake_id DESC) AS rn FROM v_intake) WHERE rn = 1")
def _(v):
    i = v("v_intake")
    return R.upsert(i.filter("intake_id % 2 = 0"), i.filter("intake_id % 2 = 1"), ["job_id"], F.col("created_at").desc(), F.col("intake_id").desc()).select("job_id", "intake_id", "status")


@query("replace_by_document", "SELECT section_id, document_id, section_title FROM v_sections WHERE document_id % 4 <> 0 UNION ALL SELECT section_id, document_id, '* ' || section_title FROM v_sections WHERE document_id % 4 = 0 AND pos < 2 UNION ALL SELECT section_id, document_id, section_title FROM v_sections s WHERE document_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM v_sections t WHERE t.document_id = s.document_id AND t.pos < 2)")
def _(v):
    s = v("v_sections").select("section_id", "document_id", "section_title", "pos")
    fresh = s.filter("document_id % 4 = 0 AND pos < 2").withColumn("section_title", F.concat(F.lit("* "), "section_title"))
    return R.replace_by_key(s, fresh, "document_id").drop("pos")


@query("cascade_delete", "SELECT 'sections' AS tbl, count(*) AS n FROM v_sections WHERE document_id NOT IN (SELECT document_id FROM v_docs WHERE case_id = 2) UNION ALL SELECT 'extractions', count(*) FROM v_extractions WHERE document_id NOT IN (SELECT document_id FROM v_docs WHERE case_id = 2)")
def _(v):
    left = R.cascade_delete({"sections": (v("v_sections"), "document_id"), "extractions": (v("v_extractions"), "document_id")}, v("v_docs").filter("case_id = 2"), "document_id")
    a, b = (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("tbl"), "n") for k, df in left.items())
    return a.unionByName(b)


@query("keyed_update", "SELECT s.section_id, coalesce(p.new_label, s.semantic_label) AS semantic_label FROM v_sections s LEFT JOIN (SELECT section_id, 'patched' AS new_label FROM v_sections WHERE pos % 7 = 3) p USING (section_id)")
def _(v):
    s = v("v_sections").select("section_id", "semantic_label")
    patch = v("v_sections").filter("pos % 7 = 3").select("section_id", F.lit("patched").alias("semantic_label"))
    return R.update_from(s, patch, "section_id", "semantic_label")


@query("insert_if_absent", "SELECT firm_id, file_hash, min(intake_id) AS intake_id FROM v_intake WHERE status = 'completed' GROUP BY 1, 2 UNION ALL SELECT firm_id, file_hash, min(intake_id) FROM v_intake i WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM v_intake k WHERE k.status = 'completed' AND k.firm_id = i.firm_id AND k.file_hash = i.file_hash) GROUP BY 1, 2")
def _(v):
    first = lambda s: v("v_intake").filter(F.col("status") == s).groupBy("firm_id", "file_hash").agg(F.min("intake_id").alias("intake_id"))
    return R.insert_if_absent(first("completed"), first("pending"), ["firm_id", "file_hash"])


@query("retention_purge", f"SELECT case_id, case_name FROM v_cases WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY")
def _(v):
    return R.purge(v("v_cases"), NOW, 20).select("case_id", "case_name")


@query("trash_view", f"SELECT case_id, case_name, CAST(date_diff('day', CAST(deleted_at AS DATE), DATE '2024-01-31') AS INTEGER) AS age_days FROM v_cases WHERE deleted_at IS NOT NULL")
def _(v):
    return R.trash(v("v_cases"), NOW).select("case_id", "case_name", "age_days")


@query("exhibit_children", "SELECT c.document_id, c.parent_document_id, p.case_id, p.corpus_id, p.file_name || '#' || c.file_name AS file_name FROM v_docs c JOIN v_docs p ON p.document_id = c.parent_document_id")
def _(v):
    d = v("v_docs")
    exhibits = d.filter("parent_document_id IS NOT NULL").select("document_id", "parent_document_id", F.col("file_name").alias("label"), "text")
    return R.exhibits_to_documents(exhibits, d)[0]


@query("backfill_tenant", "SELECT coalesce(c.firm_id, k.firm_id) AS firm_id, count(*) AS n, count(*) FILTER (d.case_id IS NULL) AS no_case FROM v_docs d LEFT JOIN v_cases c USING (case_id) LEFT JOIN v_corpora k USING (corpus_id) GROUP BY 1")
def _(v):
    return R.backfill_tenant(v("v_docs"), v("v_cases"), v("v_corpora")).groupBy("firm_id").agg(F.count("*").alias("n"), F.count_if(F.col("case_id").isNull()).alias("no_case"))


@query("backfill_checks", "SELECT count(*) AS rows, count(*) FILTER (coalesce(c.firm_id, k.firm_id) IS NULL) AS no_firm, count(*) FILTER ((d.case_id IS NOT NULL AND c.case_id IS NULL) OR (d.corpus_id IS NOT NULL AND k.corpus_id IS NULL)) AS lost, count(*) FILTER (c.firm_id <> k.firm_id) AS torn FROM v_docs d LEFT JOIN (SELECT * FROM v_cases WHERE case_id % 7 <> 0) c ON c.case_id = d.case_id LEFT JOIN (SELECT * FROM v_corpora WHERE corpus_id % 10 <> 0) k ON k.corpus_id = d.corpus_id")
def _(v):
    """The counts that the backfill observes while it is written; a case in seven and a corpus in five are missing, so that they aren't zero."""
    checks = Observation()
    out = R.backfill_tenant(v("v_docs"), v("v_cases").filter("case_id % 7 <> 0"), v("v_corpora").filter("corpus_id % 10 <> 0"), checks)
    out.select("document_id", "firm_id").write.format("noop").mode("overwrite").save()
    return v.spark.createDataFrame([tuple(checks.get[k] for k in ("rows", "no_firm", "lost", "torn"))], "rows long, no_firm long, lost long, torn long")


@query("structural_filter", "SELECT section_id, document_id, semantic_label FROM v_embeddings WHERE document_type IN ('Contract - NDA', 'Evidence - Exhibit') AND level BETWEEN 1 AND 2 AND case_id = 4")
def _(v):
    return R.structural_filter(v("v_embeddings"), document_types=["Contract - NDA", "Evidence - Exhibit"], levels=(1, 2), case_id=4).select("section_id", "document_id", "semantic_label")


@query("ilike_filter", "SELECT node_id, node_label FROM v_nodes WHERE node_label ILIKE '%RING%' OR node_label ILIKE '%brand#2%'")
def _(v):
    return v("v_nodes").filter(R.ilike_contains("node_label", "RING") | R.ilike_contains("node_label", "brand#2")).select("node_id", "node_label")


@query("or_ilike", "SELECT node_id, node_label FROM v_nodes WHERE node_label ILIKE '%brand#1%' OR node_label ILIKE '%urgent%' OR node_label ILIKE '%nation_7%'")
def _(v):
    return v("v_nodes").filter(R.any_ilike("node_label", ["brand#1", "urgent", "nation_7"])).select("node_id", "node_label")


@query("null_filters", "SELECT document_id, case_id, corpus_id FROM v_docs WHERE case_id IS NULL OR corpus_id IS NOT NULL")
def _(v):
    return v("v_docs").filter("case_id IS NULL OR corpus_id IS NOT NULL").select("document_id", "case_id", "corpus_id")


@query("in_list_semi", "SELECT extraction_id, document_id FROM v_extractions WHERE document_id IN (SELECT document_id FROM v_docs WHERE lang = 'de')")
def _(v):
    return R.visible_via(v("v_extractions"), v("v_docs").filter("lang = 'de'"), "document_id").select("extraction_id", "document_id")


@query("not_in_status", "SELECT intake_id, status FROM v_intake WHERE status NOT IN ('completed', 'failed') AND process_priority <> 'manual'")
def _(v):
    return v("v_intake").filter(~F.col("status").isin("completed", "failed") & (F.col("process_priority") != "manual")).select("intake_id", "status")


_PURPOSE = "CASE document_id % 5 WHEN 0 THEN 'Motion' WHEN 1 THEN 'historical_context' WHEN 2 THEN 'evidence' END"


@query("doc_gate", f"SELECT document_id, document_type FROM (SELECT *, {_PURPOSE} AS purpose FROM v_docs) WHERE starts_with(document_type, 'Pleading') OR purpose = 'Motion' OR (purpose = 'historical_context' AND regexp_matches(document_type, 'Complaint|Motion|Answer|Brief|Appeal'))")
def _(v):
    return v("v_docs").withColumn("purpose", F.expr(_PURPOSE)).filter(R.qualifies_for_structure(purpose="purpose")).select("document_id", "document_type")


_EXISTING = "SELECT section_id, CASE WHEN pos % 6 = 1 THEN 'old' ELSE semantic_label END AS semantic_label, CASE WHEN pos % 8 = 2 THEN 'x' ELSE section_text END AS t FROM v_sections WHERE pos % 3 <> 0"


@query(
    "embed_status",
    f"""SELECT s.section_id, CASE WHEN length(trim(s.section_text)) < 20 THEN 'skip_empty' WHEN s.semantic_label IN ('signature_block') THEN 'skip_label'
 WHEN e.section_id IS NULL THEN 'new' WHEN s.semantic_label IS DISTINCT FROM e.semantic_label OR s.section_text IS DISTINCT FROM e.t THEN 'metadata_changed' ELSE 'up_to_date' END AS status
 FROM v_sections s LEFT JOIN ({_EXISTING}) e USING (section_id)""",
)
def embed_status(v):
    s = v("v_sections")
    old = s.filter("pos % 3 <> 0").select("section_id", F.expr("CASE WHEN pos % 6 = 1 THEN 'old' ELSE semantic_label END AS semantic_label"), F.expr("sha2(CASE WHEN pos % 8 = 2 THEN 'x' ELSE section_text END, 256) AS text_hash"))
    return R.embedding_status(s, old).select("section_id", "status")


@query("embed_summary", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN length(trim(s.section_text)) < 20 THEN 'skip_empty' WHEN s.semantic_label IN ('signature_block') THEN 'skip_label' WHEN e.section_id IS NULL THEN 'new' WHEN s.semantic_label IS DISTINCT FROM e.semantic_label OR s.section_text IS DISTINCT FROM e.t THEN 'metadata_changed' ELSE 'up_to_date' END AS status FROM v_sections s LEFT JOIN ({_EXISTING}) e USING (section_id)) GROUP BY 1")
def _(v):
    return embed_status(v).groupBy("status").agg(F.count("*").alias("n"))


@query("skip_reason", "SELECT section_id, CASE WHEN length(trim(section_text)) < 50 THEN 'short' WHEN semantic_label = 'signature_block' THEN 'label' WHEN length(section_text) < 200 AND level > 0 THEN 'micro_section' END AS reason FROM v_sections")
def _(v):
    return v("v_sections").select("section_id", R.extraction_skip_reason().alias("reason"))


@query("review_flag", "SELECT extraction_id, extraction_type, confidence < 0.7 AS needs_review FROM v_extractions WHERE confidence >= 0.5 AND trim(entity_name) <> ''")
def _(v):
    return v("v_extractions").filter("confidence >= 0.5 AND trim(entity_name) <> ''").select("extraction_id", "extraction_type", F.expr("confidence < 0.7 AS needs_review"))


@query("enum_clamp", "SELECT intake_id, CASE WHEN lower(trim(status)) IN ('pending', 'completed') THEN lower(trim(status)) ELSE 'other' END AS status, greatest(0.0, least(1.0, CAST(value AS DOUBLE) / 100)) AS conf FROM v_intake")
def _(v):
    return v("v_intake").select("intake_id", R.clamp("status", ["pending", "completed"], "other").alias("status"), R.clamp_unit("value / 100").alias("conf"))


@query("safe_casts", "SELECT conv_id, turn, TRY_CAST(substring(text, 1, 3) AS DOUBLE) AS f, CAST(floor(TRY_CAST(CAST(turn AS VARCHAR) || '.7' AS DOUBLE)) AS BIGINT) AS i, CASE WHEN lower(role) IN ('user', 'y') THEN NULL WHEN lower(role) = 'no' THEN false END AS b FROM conversations")
def _(v):
    c = v("conversations").withColumn("head", F.substring("text", 1, 3)).withColumn("num", F.expr("CAST(turn AS string) || '.7'"))
    return c.select("conv_id", "turn", R.safe_float("head").alias("f"), R.safe_int("num").alias("i"), R.safe_bool("role").alias("b"))


@query("truncate_label", "SELECT section_id, CASE WHEN length(section_text) > 120 THEN substring(section_text, 1, 117) || '…' ELSE section_text END AS label FROM v_sections")
def _(v):
    return v("v_sections").select("section_id", R.truncate("section_text", 120, 117).alias("label"))


@query("refine_candidates", "SELECT section_id, length(section_text) AS n FROM v_sections WHERE length(section_text) >= 600")
def _(v):
    return R.refine_candidates(v("v_sections"), 600).select("section_id", F.length("section_text").cast("bigint").alias("n"))


@query("structure_targets", "SELECT section_id FROM v_sections WHERE coalesce(semantic_label, '') = 'factual_allegations' OR starts_with(coalesce(semantic_label, ''), 'causes') OR starts_with(lower(section_title), 'count ')")
def _(v):
    return R.structure_targets(v("v_sections")).select("section_id")


@query("message_rows", "SELECT session_id, turn, role, CASE WHEN role = 'assistant' THEN substring(text, 1, 20) END AS tool_text, CASE WHEN confidence < 0.3 THEN 'pending_review' ELSE 'ok' END AS status FROM v_responses")
def _(v):
    return v("v_responses").select("session_id", "turn", "role", F.expr("CASE WHEN role = 'assistant' THEN substring(text, 1, 20) END AS tool_text"), F.expr("CASE WHEN confidence < 0.3 THEN 'pending_review' ELSE 'ok' END AS status"))


@query("validate_uploads", "SELECT document_id, lang AS bucket, lang IN ('en', 'fr') AS accepted FROM v_docs")
def _(v):
    files = v("v_docs").select("document_id", F.col("lang").alias("bucket"))
    allowed = v("v_docs").select(F.col("lang").alias("bucket")).filter("bucket IN ('en', 'fr')").distinct()
    ok, no = R.validate_uploads(files, allowed)
    return ok.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False)))


@query("validate_labels", "SELECT document_id, CASE WHEN document_type IN ('Contract - NDA', 'Court - Order') THEN document_type ELSE 'Unknown' END AS label, CASE WHEN document_type IN ('Contract - NDA', 'Court - Order') THEN 0.9 ELSE 0.4 END AS conf FROM v_docs")
def _(v):
    allowed = v("v_docs").select("document_type").filter("document_type IN ('Contract - NDA', 'Court - Order')").distinct().withColumn("ok", F.lit(True))
    return v("v_docs").join(allowed, "document_type", "left").select("document_id", F.expr("CASE WHEN ok THEN document_type ELSE 'Unknown' END AS label"), F.expr("CASE WHEN ok THEN 0.9D ELSE 0.4D END AS conf"))


@query("join_section_doc", "SELECT s.section_id, d.case_id, d.file_name, d.lang FROM v_sections s JOIN v_docs d USING (document_id)")
def _(v):
    return R.with_document(v("v_sections"), v("v_docs")).select("section_id", "case_id", "file_name", "lang")


@query("parent_context", "SELECT s.section_id, CASE WHEN p.section_id IS NULL THEN NULL ELSE coalesce(nullif(trim(p.section_title), ''), substring(p.section_text, 1, 80)) END AS parent_context FROM v_sections s LEFT JOIN v_sections p ON p.section_id = CASE WHEN s.pos > 0 THEN s.section_id - 1 END")
def _(v):
    s = v("v_sections").withColumn("parent_section_id", F.expr("CASE WHEN pos > 0 THEN section_id - 1 END"))
    return R.with_parent_context(s).select("section_id", "parent_context")


@query("broadcast_names", "SELECT e.extraction_id, d.file_name FROM v_extractions e LEFT JOIN v_docs d USING (document_id)")
def _(v):
    return R.with_file_name(v("v_extractions").select("extraction_id", "document_id"), v("v_docs")).select("extraction_id", "file_name")


@query("evidence_gaps", "SELECT node_id, node_type FROM v_nodes n WHERE node_type = 'claim' AND NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.src = n.node_id AND e.edge_type = 'supported_by' AND e.confidence >= 0.95)")
def _(v):
    links = v("v_edges").filter("edge_type = 'supported_by' AND confidence >= 0.95").select(F.col("src").alias("node_id"), F.col("dst").alias("document_id"))
    return R.evidence_gaps(v("v_nodes").filter("node_type = 'claim'"), links, "node_id").select("node_id", "node_type")


_VIS = "(k.firm_id = 1 OR {shared} (d.corpus_id IS NULL AND c.firm_id = 1))"
_FROM = "FROM v_docs d LEFT JOIN v_corpora k USING (corpus_id) LEFT JOIN v_cases c USING (case_id)"


@query("tenant_visible_docs", f"SELECT d.document_id {_FROM} WHERE {_VIS.format(shared='k.is_shared OR')}")
def _(v):
    return R.visible_documents(v("v_docs"), v("v_corpora"), v("v_cases"), 1).select("document_id")


@query("tenant_writable_docs", f"SELECT d.document_id {_FROM} WHERE {_VIS.format(shared='')}")
def _(v):
    return R.visible_documents(v("v_docs"), v("v_corpora"), v("v_cases"), 1, shared=False).select("document_id")


@query("tenant_visible_sections", f"SELECT section_id FROM v_sections WHERE document_id IN (SELECT d.document_id {_FROM} WHERE {_VIS.format(shared='k.is_shared OR')})")
def _(v):
    return R.visible_via(v("v_sections"), R.visible_documents(v("v_docs"), v("v_corpora"), v("v_cases"), 1), "document_id").select("section_id")


@query("claims_counts", "SELECT n.node_id, count(e.dst) AS n_links FROM v_nodes n LEFT JOIN v_edges e ON e.src = n.node_id WHERE n.node_type = 'claim' GROUP BY 1")
def _(v):
    e = v("v_edges").select(F.col("src").alias("node_id"), "dst")
    return v("v_nodes").filter("node_type = 'claim'").join(e, "node_id", "left").groupBy("node_id").agg(F.count("dst").alias("n_links"))


@query("page_range_join", "SELECT s.section_id, p.page FROM (SELECT section_id, document_id, start_page, start_page + level AS end_page FROM v_sections WHERE start_page IS NOT NULL) s JOIN (SELECT DISTINCT document_id, start_page AS page FROM v_sections WHERE start_page IS NOT NULL) p ON p.document_id = s.document_id AND p.page BETWEEN s.start_page AND s.end_page")
def _(v):
    s = v("v_sections").filter("start_page IS NOT NULL")
    spans = s.select("section_id", "document_id", "start_page", (F.col("start_page") + F.col("level")).alias("end_page"))
    return R.section_pages(spans, s.select("document_id", F.col("start_page").alias("page")).distinct()).select("section_id", "page")


@query("trim_parent", "SELECT s.section_id FROM v_sections s LEFT JOIN (SELECT document_id, min(start_page) AS f FROM v_sections WHERE pos % 11 = 10 GROUP BY 1) x USING (document_id) WHERE x.f IS NULL OR s.start_page IS NULL OR s.start_page < x.f")
def _(v):
    s = v("v_sections")
    return R.trim_parent(s, s.filter("pos % 11 = 10")).select("section_id")


@query("match_evidence_ref", "WITH ev AS (SELECT document_id, node_id, lower(trim(node_label)) AS l FROM v_nodes WHERE node_type = 'evidence'), rf AS (SELECT node_id AS ref_id, document_id, substring(node_label, 1, 17) AS r FROM v_nodes WHERE node_type IN ('evidence', 'obligation')) SELECT ref_id, document_id, r AS ref, min(ev.node_id) AS evidence_id FROM rf JOIN ev USING (document_id) WHERE starts_with(l, lower(trim(r))) OR starts_with(lower(trim(r)), l) GROUP BY 1, 2, 3")
def _(v):
    n = v("v_nodes")
    refs = n.filter("node_type IN ('evidence', 'obligation')").select(F.col("node_id").alias("ref_id"), "document_id", F.substring("node_label", 1, 17).alias("ref"))
    return R.match_evidence_ref(refs, n.filter("node_type = 'evidence'"))


@query("resolve_case", "WITH f AS (SELECT case_name AS folder, trim(regexp_replace(lower(case_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM v_cases WHERE case_id < 8 UNION ALL SELECT upper(replace(case_name, ' v. ', '_v_')), trim(regexp_replace(lower(replace(case_name, ' v. ', '_v_')), '[^a-z0-9]+', ' ', 'g')) FROM v_cases WHERE case_id BETWEEN 8 AND 15 UNION ALL SELECT 'matter ' || case_name, trim(regexp_replace(lower('matter ' || case_name), '[^a-z0-9]+', ' ', 'g')) FROM v_cases WHERE case_id > 15), c AS (SELECT case_id, case_name, trim(regexp_replace(lower(case_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM v_cases), m AS (SELECT folder, case_id, CASE WHEN folder = case_name THEN 1 WHEN f.n = c.n THEN 2 ELSE 3 END AS rule FROM f JOIN c ON folder = case_name OR f.n = c.n OR contains(c.n, f.n) OR contains(f.n, c.n)) SELECT folder, case_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY rule, case_id) AS rn FROM m) WHERE rn = 1")
def _(v):
    c = v("v_cases")
    folders = c.filter("case_id < 8").select(F.col("case_name").alias("folder")).unionByName(c.filter("case_id BETWEEN 8 AND 15").select(F.expr("upper(replace(case_name, ' v. ', '_v_')) AS folder"))).unionByName(c.filter("case_id > 15").select(F.expr("'matter ' || case_name AS folder")))
    return R.resolve_case(folders, c)


@query("join_case_ctx", "SELECT d.document_id, c.case_name, c.party_role FROM v_docs d LEFT JOIN v_cases c USING (case_id)")
def _(v):
    return v("v_docs").join(v("v_cases"), "case_id", "left").select("document_id", "case_name", "party_role")


@query("as_of_state", f"SELECT job_id, intake_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, intake_id) AS rn FROM v_intake WHERE created_at <= TIMESTAMP '{MARK}') WHERE rn = 1")
def _(v):
    return R.as_of(v("v_intake"), ["job_id"], "created_at", MARK, F.col("intake_id")).select("job_id", "intake_id", "status")


@query("set_except", "SELECT node_id FROM v_nodes WHERE node_type = 'claim' EXCEPT SELECT src FROM v_edges")
def _(v):
    return v("v_nodes").filter("node_type = 'claim'").select("node_id").subtract(v("v_edges").select("src"))


@query("set_intersect", "SELECT src AS node_id FROM v_edges INTERSECT SELECT dst FROM v_edges")
def _(v):
    return v("v_edges").select(F.col("src").alias("node_id")).intersect(v("v_edges").select("dst"))


@query("union_edges", "SELECT src, dst, edge_type, max(confidence) AS confidence FROM v_edges GROUP BY 1, 2, 3")
def _(v):
    e = v("v_edges").withColumn("confidence", F.col("confidence").cast("double"))
    return R.union_edges(e, e.withColumn("confidence", F.lit(0.1)))


@query("json_get", "SELECT extraction_id, json_extract_string(properties, '$.role_in_document') AS role FROM v_extractions")
def _(v):
    return v("v_extractions").select("extraction_id", R.json_get("properties", "$.role_in_document").alias("role"))


@query("array_any", "SELECT document_id, list_contains(string_split(file_name, '_'), 'exhibit') AS hit FROM v_docs")
def _(v):
    return v("v_docs").select("document_id", F.array_contains(F.split("file_name", "_"), "exhibit").alias("hit"))
