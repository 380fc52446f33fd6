"""Queries over intake and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import intake as Q
from caselake.plans.registry import query
from caselake.sources.views import CASES

_CASES = "SELECT case_id, firm_id, case_name, '24-CV-' || CAST(10000 + case_id AS STRING) AS docket FROM v_cases"
_ITEMS = f"SELECT intake_id AS item_id, firm_id, CASE intake_id % 4 WHEN 0 THEN CAST(intake_id % {CASES} AS STRING) WHEN 1 THEN 'nation_1' WHEN 2 THEN 'nation_7' ELSE '' END AS hint, CASE intake_id % 3 WHEN 0 THEN 'filing_24-cv_' || CAST(10000 + intake_id % {CASES} AS STRING) || '.pdf' WHEN 1 THEN 'letter supplier nation.pdf' ELSE 'scan.pdf' END AS file_name FROM v_intake"


def _inputs(v):
    for n in ("v_cases", "v_intake", "supplier"):
        v(n).createOrReplaceTempView(n)
    return v.spark.sql(_ITEMS), v.spark.sql(_CASES)


_HINT = f"WITH c AS ({_CASES}), i AS ({_ITEMS}), a AS (SELECT i.item_id, c.case_id, 0.99 AS confidence, 'hint_id' AS stage, CAST(NULL AS VARCHAR) AS candidates FROM i JOIN c ON c.firm_id = i.firm_id AND i.hint = CAST(c.case_id AS VARCHAR)), b AS (SELECT i.item_id, CASE WHEN count(*) = 1 THEN min(c.case_id) END AS case_id, CASE WHEN count(*) = 1 THEN 0.95 ELSE 0.5 END AS confidence, 'hint_name' AS stage, CASE WHEN count(*) > 1 THEN array_to_string(list_slice(list_sort(list(c.case_id)), 1, 5), ',') END AS candidates FROM i JOIN c ON c.firm_id = i.firm_id AND length(i.hint) > 2 AND contains(lower(c.case_name), lower(i.hint)) GROUP BY 1), h AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE item_id NOT IN (SELECT item_id FROM a))"
_NAME = ", d AS (SELECT i.item_id, min(c.case_id) AS case_id, 0.88 AS confidence, 'docket' AS stage, CAST(NULL AS VARCHAR) AS candidates FROM i JOIN c ON c.firm_id = i.firm_id AND c.docket = upper(replace(regexp_extract(i.file_name, '24-cv_\\d+'), '_', '-')) GROUP BY 1 HAVING count(*) = 1), iw AS (SELECT DISTINCT item_id, firm_id, unnest(string_split(regexp_replace(lower(file_name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM i), cw AS (SELECT DISTINCT case_id, firm_id, unnest(string_split(regexp_replace(lower(case_name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM c), m AS (SELECT item_id, case_id, count(*) AS n FROM iw JOIN cw USING (firm_id, w) WHERE length(w) > 3 GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT item_id, case_id, 0.75 AS confidence, 'words' AS stage, CAST(NULL AS VARCHAR) AS candidates FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, case_id) = 1), f AS (SELECT * FROM d UNION ALL SELECT * FROM w WHERE item_id NOT IN (SELECT item_id FROM d))"


@query("route_hint", f"{_HINT} SELECT * FROM h")
def _(v):
    return Q.route_by_hint(*_inputs(v))


@query("route_filename", f"{_HINT}{_NAME} SELECT item_id, case_id, confidence, stage FROM f")
def _(v):
    return Q.route_by_name(*_inputs(v)).select("item_id", "case_id", "confidence", "stage")


@query("route_cascade", f"{_HINT}{_NAME}, u AS (SELECT *, 0 AS o FROM h UNION ALL SELECT *, 1 FROM f), r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN confidence >= 0.85 THEN 0 ELSE 1 END, CASE WHEN confidence >= 0.85 THEN o ELSE 99 END, confidence DESC, o) = 1) SELECT i.item_id, r.case_id, r.stage, CASE WHEN coalesce(r.confidence, 0) >= 0.85 THEN 'confirmed' ELSE 'awaiting_confirmation' END AS status FROM i LEFT JOIN r USING (item_id)")
def _(v):
    return Q.route(*_inputs(v)).select("item_id", "case_id", "stage", "status")


@query("admit_uploads", "WITH k AS (SELECT firm_id, file_hash, min(intake_id) AS e FROM v_intake WHERE intake_id % 2 = 0 GROUP BY 1, 2) SELECT u.intake_id, k.e AS existing_id, CASE WHEN k.e IS NOT NULL THEN 'duplicate' WHEN u.intake_id % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS decision FROM v_intake u LEFT JOIN k USING (firm_id, file_hash) WHERE u.intake_id % 2 = 1")
def _(v):
    i = v("v_intake")
    up = i.filter("intake_id % 2 = 1").selectExpr("intake_id", "firm_id", "file_hash", "CASE WHEN intake_id % 3 = 0 THEN 1 END AS case_id")
    return Q.admit(up, i.filter("intake_id % 2 = 0")).select("intake_id", "existing_id", "decision")


@query("fine_route", "SELECT document_id, CASE WHEN starts_with(document_type, 'Pleading') THEN 'pleadings' WHEN starts_with(document_type, 'Contract') THEN 'contracts' WHEN starts_with(document_type, 'Court') THEN 'orders' ELSE 'discovery' END AS parent, CASE WHEN case_id IS NOT NULL AND (starts_with(document_type, 'Pleading') AND lang IN ('en', 'de') OR starts_with(document_type, 'Contract') AND lang = 'fr') THEN lang END AS sub FROM v_docs")
def _(v):
    folders = v("v_cases").select("case_id", F.lit('{"pleadings": ["en", "de"], "contracts": ["fr"]}').alias("folder_json"))
    return Q.fine_route(v("v_docs").select("document_id", "case_id", "document_type", F.col("lang").alias("suggestion")), folders).select("document_id", "parent", "sub")


@query("ready_items", "SELECT intake_id, process_priority, row_number() OVER (ORDER BY CASE process_priority WHEN 'immediate' THEN 0 ELSE 1 END, created_at, intake_id) AS rank FROM v_intake WHERE status = 'confirmed' AND process_priority IN ('immediate', 'soon') QUALIFY rank <= 40")
def _(v):
    return Q.ready_items(v("v_intake"), ("immediate", "soon"), 40).select("intake_id", "process_priority", "rank")


@query("apply_decisions", "WITH d AS (SELECT intake_id - intake_id % 4 AS intake_id, firm_id + 100 AS c FROM v_intake WHERE intake_id % 4 IN (1, 2) QUALIFY row_number() OVER (PARTITION BY intake_id - intake_id % 4 ORDER BY created_at DESC, v_intake.intake_id DESC) = 1) SELECT q.intake_id, coalesce(d.c, q.job_id) AS case_id, d.c IS NOT NULL AS decided FROM v_intake q LEFT JOIN d USING (intake_id)")
def _(v):
    i = v("v_intake")
    dec = i.filter("intake_id % 4 IN (1, 2)").selectExpr("intake_id - intake_id % 4 AS intake_id", "firm_id + 100 AS case_id", "created_at AS decided_at", "intake_id AS decision_id")
    return Q.apply_decisions(i.selectExpr("intake_id", "job_id AS case_id"), dec).select("intake_id", "case_id", "decided")


@query("routing_lookup", "SELECT document_id, CASE WHEN document_type IN ('Contract - NDA', 'Court - Order') THEN 'deals' WHEN document_type = 'Pleading - Motion' THEN 'court' ELSE 'inbox' END AS bucket, CASE WHEN document_type IN ('Contract - NDA', 'Court - Order') THEN 'overnight' WHEN document_type = 'Pleading - Motion' THEN 'immediate' ELSE 'soon' END AS mode FROM v_docs")
def _(v):
    rules = v.spark.createDataFrame([(["Contract - NDA", "Court - Order"], "deals", "overnight"), (["Pleading - Motion"], "court", "immediate")], "document_types array<string>, bucket string, mode string")
    return Q.apply_routing(v("v_docs").select("document_id", "document_type"), rules).select("document_id", "bucket", "mode")


@query("propose_folders", "SELECT case_id, CASE WHEN party_role = 'plaintiff' THEN 'a=A;b=B' ELSE 'g=General' END AS folders FROM v_cases")
def _(v):
    catalog = v.spark.createDataFrame([("plaintiff", "a", "A", 1), ("plaintiff", "b", "B", 2), ("general", "g", "General", 1)], "matter_type string, folder string, label string, ord int")
    return Q.propose_folders(v("v_cases").select("case_id", F.col("party_role").alias("matter_type")), catalog)


@query("scan_files_mime")
def _(v):
    """The tables' own files as a listing."""
    from caselake.sources.files import read_files

    return read_files(v.spark, v.sf_dir, ("parquet",)).select("name", "ext", "mime", "length")
