"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.functions import scalar as S
from caselake.plans.registry import query

_A, _B = S._FROM, S._TO


@query("slugify", f"SELECT section_id, trim(regexp_replace(lower(translate(section_title, '{_A}', '{_B}')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM v_sections")
def _(v):
    return v("v_sections").select("section_id", S.slugify("section_title").alias("slug"))


@query("norm_party", f"SELECT node_id, trim(regexp_replace(regexp_replace(lower(trim(l)), '{S.SUFFIXES}', ''), '\\s+', ' ', 'g')) AS name FROM (SELECT node_id, node_label || CASE WHEN section_id % 3 = 0 THEN ', Inc.' WHEN section_id % 3 = 1 THEN ' Company' ELSE '' END AS l FROM v_nodes WHERE node_type = 'party')")
def _(v):
    n = v("v_nodes").filter("node_type = 'party'").withColumn("l", F.expr("node_label || CASE WHEN section_id % 3 = 0 THEN ', Inc.' WHEN section_id % 3 = 1 THEN ' Company' ELSE '' END"))
    return n.select("node_id", S.norm_party("l").alias("name"))


@query("norm_authority", "SELECT node_id, lower(node_label) || ' v. state' AS name FROM v_nodes WHERE node_type = 'legal_authority'")
def _(v):
    n = v("v_nodes").filter("node_type = 'legal_authority'").withColumn("l", F.expr("node_label || ' v. State, ' || CAST(section_id + 10 AS string) || ' F.3d ' || CAST(section_id + 100 AS string)"))
    return n.select("node_id", S.norm_authority("l").alias("name"))


@query("is_substring", "SELECT section_id, length(trim(section_title)) >= 3 AND length(trim(w)) >= 3 AND (contains(lower(trim(section_title)), lower(trim(w))) OR contains(lower(trim(w)), lower(trim(section_title)))) AS hit FROM (SELECT *, substring(section_text, 5, 6) AS w FROM v_sections)")
def _(v):
    return v("v_sections").withColumn("w", F.substring("section_text", 5, 6)).select("section_id", S.is_substring("section_title", "w").alias("hit"))


TRGM = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("trgm_similarity", f"SELECT section_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 4) AS sim FROM (SELECT section_id, {TRGM.format(x='section_title')} AS a, {TRGM.format(x='substring(section_text, 10, 40)')} AS b FROM v_sections)")
def _(v):
    return v("v_sections").select("section_id", F.round(S.trgm_similarity("section_title", F.substring("section_text", 10, 40)), 4).alias("sim"))


@query("cosine_pairs", "SELECT a.section_id AS a, b.section_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS sim FROM v_embeddings a JOIN v_embeddings b ON b.section_id = a.section_id + 1")
def _(v):
    e = v("v_embeddings")
    a, b = e.select(F.col("section_id").alias("a"), (F.col("section_id") + 1).alias("b"), F.col("embedding").alias("x")), e.select(F.col("section_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(S.cosine("x", "y"), 4).alias("sim"))


@query("clean_md", "SELECT document_id, regexp_replace(translate(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '“”‘’', '\"\"'''''), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM (SELECT document_id, '“' || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(10)) || '’' AS t FROM v_docs)")
def _(v):
    return v("v_docs").withColumn("t", F.concat(F.lit("“"), F.replace("text", F.lit("\n"), F.lit("\r\n\n\n")), F.lit("’"))).select("document_id", S.clean_md("t").alias("text"))


@query("clean_line", "SELECT document_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(line || '  ---- x', '[–—]', '-', 'g'), '-{3,}', '--', 'g'), '[ \\t]+', ' ', 'g')) AS line FROM v_lines")
def _(v):
    return v("v_lines").select("document_id", "pos", S.clean_line(F.concat("line", F.lit("  ---- x"))).alias("line"))


@query("exhibit_refs", "SELECT section_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\\bex(?:hibit|\\.)\\s+([a-z]{1,2}|\\d{1,3})\\b', 1), lambda x: upper(x)))), ',') AS refs FROM (SELECT section_id, 'See Exhibit ' || chr(65 + CAST(level AS INTEGER)) || ', ex. ' || CAST(pos % 9 AS VARCHAR) || ' and EXHIBIT b ' || section_text AS t FROM v_sections)")
def _(v):
    s = v("v_sections").withColumn("t", F.expr("'See Exhibit ' || char(65 + level) || ', ex. ' || CAST(pos % 9 AS string) || ' and EXHIBIT b ' || section_text"))
    return s.select("section_id", F.array_join(S.exhibit_refs("t"), ",").alias("refs"))


@query("docket_number", "SELECT document_id, CASE WHEN document_id % 2 = 0 THEN '24-CV-' || CAST(10000 + document_id AS VARCHAR) END AS docket FROM v_docs")
def _(v):
    d = v("v_docs").withColumn("f", F.expr("CASE WHEN document_id % 2 = 0 THEN 'motion_24-cv_' || CAST(10000 + document_id AS string) || '.pdf' ELSE file_name END"))
    return d.select("document_id", S.docket_number("f").alias("docket"))


@query("doc_category", "SELECT document_id, CASE document_type WHEN 'Pleading - Complaint' THEN 'complaint' WHEN 'Pleading - Answer' THEN 'answer' WHEN 'Pleading - Motion' THEN 'motion' WHEN 'Contract - NDA' THEN 'contract' WHEN 'Court - Order' THEN 'court_order' ELSE 'discovery' END AS category FROM v_docs")
def _(v):
    return v("v_docs").select("document_id", S.doc_category("document_type").alias("category"))


@query("form_signals", "SELECT document_id, round(len(list_filter(l, lambda x: length(x) < 40)) / nullif(len(l), 0), 6) AS short_share FROM (SELECT document_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM v_docs)")
def _(v):
    return v("v_docs").select("document_id", S.short_line_share("text").alias("short_share"))


@query("is_garbled", "SELECT document_id, pos, coalesce((length(regexp_replace(line, '[^A-Za-z]', '', 'g')) / nullif(length(line), 0) < 0.3 AND length(regexp_replace(line, '[^0-9]', '', 'g')) / nullif(length(line), 0) < 0.3), true) AS garbled FROM v_lines")
def _(v):
    return v("v_lines").select("document_id", "pos", S.is_garbled("line").alias("garbled"))


@query("is_bad_text", "SELECT document_id, starts_with(lower(text), 'error') OR length(regexp_replace(text, '[\\s#*|_-]', '', 'g')) < 300 AS bad FROM v_docs")
def _(v):
    return v("v_docs").select("document_id", S.is_bad_text("text").alias("bad"))


@query("split_parties", "SELECT s_suppkey AS case_id, s_name AS plaintiff, n_name AS defendant FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(v):
    return v("v_cases").select("case_id", S.split_parties("case_name", 1).alias("plaintiff"), S.split_parties("case_name", 2).alias("defendant"))


@query("content_hash", "SELECT document_id, sha256(text) AS hash FROM v_docs")
def _(v):
    return v("v_docs").select("document_id", F.sha2("text", 256).alias("hash"))


@query("standalone_exhibit", "SELECT document_id, contains(file_name, 'exhibit') AND len(string_split(text, ' ')) < 400 AS standalone FROM v_docs")
def _(v):
    return v("v_docs").select("document_id", (F.col("file_name").rlike("(?i)exhibit") & (F.size(F.split("text", " ")) < 400)).alias("standalone"))


@query("adaptive_snippet", "SELECT section_id, substring(section_text, 1, CASE WHEN length(trim(section_title)) >= 25 THEN 200 WHEN length(trim(section_title)) >= 10 THEN 400 ELSE 800 END) AS snip FROM v_sections")
def _(v):
    return v("v_sections").select("section_id", S.snippet("section_title", "section_text").alias("snip"))


@query("embedding_input", "SELECT s.section_id, substring('[' || d.document_type || ']' || coalesce(' [' || s.semantic_label || ']', '') || ' ' || s.section_title || chr(10) || chr(10) || s.section_text, 1, 28000) AS input FROM v_sections s JOIN v_docs d USING (document_id)")
def _(v):
    s = v("v_sections").join(v("v_docs").select("document_id", "document_type"), "document_id")
    return s.select("section_id", S.embedding_input("document_type", "semantic_label", "section_title", "section_text").alias("input"))


@query("date_sort_key", "SELECT node_id, CASE WHEN regexp_matches(date_value, '^\\d{4}-\\d{2}-\\d{2}') THEN substring(date_value, 1, 10) WHEN regexp_matches(date_value, '^\\d{4}$') THEN date_value || '-00-00' WHEN regexp_matches(date_value, '\\b(1[89]\\d\\d|20\\d\\d)\\b') THEN regexp_extract(date_value, '\\b(1[89]\\d\\d|20\\d\\d)\\b', 1) || '-00-00' ELSE '9999-99-99' END AS k FROM v_nodes")
def _(v):
    return v("v_nodes").select("node_id", F.coalesce(S.date_sort_key("date_value"), F.lit("9999-99-99")).alias("k"))


@query("event_type", f"SELECT extraction_id, CASE WHEN trim(coalesce(entity_name, '')) = '' OR lower(trim(entity_name)) IN {S.DATE_NAMES} OR regexp_matches(trim(entity_name), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR k IN {S.NOISE_DATES} THEN NULL WHEN k IN {S.PROCEDURAL_DATES} THEN 'procedural_event' ELSE 'event' END AS kind FROM (SELECT *, lower(CASE WHEN extraction_type = 'date' THEN json_extract_string(properties, '$.date_type') ELSE '' END) AS k FROM v_found)")
def _(v):
    e = v("v_found").withColumn("k", F.expr("CASE WHEN extraction_type = 'date' THEN get_json_object(properties, '$.date_type') ELSE '' END"))
    return e.select("extraction_id", S.event_type("entity_name", "k").alias("kind"))


@query("estimate_pages", "SELECT section_id, CAST(round_even(1 + 4 * pos / nullif(n, 0), 0) AS BIGINT) AS page FROM (SELECT section_id, CAST(pos AS DOUBLE) AS pos, count(*) OVER (PARTITION BY document_id) AS n FROM v_sections)")
def _(v):
    from pyspark.sql import Window

    s = v("v_sections").withColumn("n", F.count("*").over(Window.partitionBy("document_id"))).withColumn("a", F.lit(1.0)).withColumn("b", F.lit(5.0))
    return s.select("section_id", S.estimate_pages("pos", "n", "a", "b").alias("page"))


@query("answer_confidence", "SELECT session_id, turn, round_even(greatest(0.0, least(1.0, 0.5 + least(0.05 * (turn % 8), 0.25) + CASE WHEN confidence >= 0.75 THEN 0.10 ELSE 0.0 END + CASE WHEN turn % 2 = 0 THEN 0.10 ELSE 0.0 END - CASE WHEN session_id % 3 = 0 THEN 0.05 ELSE 0.0 END)), 2) AS conf FROM v_responses")
def _(v):
    r = v("v_responses").selectExpr("session_id", "turn", "turn % 8 AS links", "confidence AS top", "turn % 2 = 0 AS graph", "session_id % 3 = 0 AS synthetic")
    return r.select("session_id", "turn", S.answer_confidence("links", "top", "graph", "synthetic").cast("double").alias("conf"))


@query("parse_path", "SELECT document_id, lang AS bucket, CASE WHEN case_id IS NULL THEN 'root' ELSE CAST(case_id AS VARCHAR) END AS folder, file_name AS name FROM v_docs")
def _(v):
    d = v("v_docs").withColumn("p", F.expr("'/' || lang || '/' || CASE WHEN case_id IS NULL THEN 'root' ELSE CAST(case_id AS string) END || '/' || file_name"))
    return d.select("document_id", S.path_part("p", 1).alias("bucket"), S.path_part("p", 2).alias("folder"), S.path_part("p", -1).alias("name"))


@query("container_kind", "SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'native_mail' WHEN 1 THEN CASE WHEN lang = 'en' THEN 'structured_mail_table' ELSE 'data_table' END WHEN 2 THEN 'html' ELSE 'unknown' END AS kind FROM v_docs")
def _(v):
    d = v("v_docs").selectExpr("document_id", "file_name || CASE document_id % 4 WHEN 0 THEN '.EML' WHEN 1 THEN '.csv' WHEN 2 THEN '.html' ELSE '.zip' END AS f", "CASE WHEN lang = 'en' THEN array('From', 'Subject') ELSE array('a', 'b') END AS h")
    return d.select("document_id", S.container_kind("f", "h").alias("kind"))


@query("search_text", "SELECT section_id, CASE WHEN trim(section_title) = '' THEN section_text ELSE trim(section_title) || chr(10) || section_text END AS search_text FROM v_sections")
def _(v):
    return v("v_sections").select("section_id", S.search_text("section_title", "section_text").alias("search_text"))


@query("document_kinds", "SELECT document_id, CASE document_id % 6 WHEN 0 THEN 'complaint' WHEN 1 THEN 'contract' WHEN 2 THEN 'appeal' WHEN 3 THEN 'court_order' WHEN 4 THEN 'discovery' ELSE 'complaint' END AS gate, CASE document_id % 6 WHEN 1 THEN 'contract' WHEN 3 THEN 'court_order' WHEN 4 THEN 'other' ELSE 'complaint' END AS graph, CASE document_id % 6 WHEN 2 THEN 'motions' WHEN 4 THEN 'discovery' ELSE 'filing' END AS stage, CASE document_id % 6 WHEN 1 THEN 'contracts' WHEN 3 THEN 'court-orders' WHEN 4 THEN 'discovery' ELSE 'pleadings' END AS folder FROM v_docs")
def _(v):
    return v("v_docs").select("document_id", S.gate_kind("document_type").alias("gate"), S.graph_kind("document_type").alias("graph"), S.case_stage("document_type").alias("stage"), S.folder_of("document_type").alias("folder"))


@query("exhibit_kinds", "SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'Declaration' WHEN document_id % 3 = 1 THEN 'Deposition' ELSE 'Subpoena' END AS kind, CASE WHEN document_id % 3 = 0 THEN 'declaration' WHEN document_id % 3 = 1 THEN 'deposition' ELSE 'document' END AS evidence FROM v_docs")
def _(v):
    d = v("v_docs").selectExpr("document_id", "CASE document_id % 3 WHEN 0 THEN 'Affidavit, I declare' WHEN 1 THEN 'Deposition of A' ELSE 'Subpoena' END AS title")
    return d.select("document_id", S.exhibit_kind("title", "''").alias("kind"), S.evidence_kind("title").alias("evidence"))


_CITING = "SELECT document_id, CASE document_id % 5 WHEN 0 THEN 'see Exhibits A, B and C-1; ' WHEN 1 THEN 'Exh. 12 & Ex. D, [Exhibit B-2 attached] ' WHEN 2 THEN 'exhibit A – 3, Exhibit  A' WHEN 3 THEN '' ELSE 'exhibits 7 & 8' END || chr(10) || text AS text FROM v_docs"
_FOUND = ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in S.CITED_EXHIBITS)


@query("cited_exhibits", f"SELECT document_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(flatten([{_FOUND}]), lambda m: string_split_regex(m, '\\s*[,&]\\s*|\\s+and\\s+'))), lambda p: trim(p)), lambda p: p <> ''))), '|') AS labels FROM ({_CITING})")
def _(v):
    v("v_docs").createOrReplaceTempView("v_docs")
    return v.spark.sql(_CITING).select("document_id", F.array_join(S.cited_exhibits("text"), "|").alias("labels"))


@query("exhibit_labels", "SELECT node_id, CASE substring(node_id, length(node_id), 1) WHEN '1' THEN 'B-7' WHEN '2' THEN 'AB' WHEN '3' THEN 'C' WHEN '4' THEN '9' END AS label FROM v_nodes")
def _(v):
    made = F.expr("CASE substring(node_id, length(node_id), 1) WHEN '1' THEN ' Exhibit b-7, letter' WHEN '2' THEN 'SCHEDULE Ab ' WHEN '3' THEN 'Appendix C- d' WHEN '4' THEN 'attachment 9 of 10' WHEN '5' THEN 'See Exhibit A' WHEN '6' THEN 'Exhibit' ELSE node_label END")
    return v("v_nodes").select("node_id", S.exhibit_label(made).alias("label"))


#: Lines as they come, and as they are to be; a line of letters only stays but for its blanks. A sign or blank before a telephone number belongs to it.
_BODY = (
    ("##  Head — of it", "##  Head — of it"), ("|  a — b |", "|  a — b |"), ("[Page 4]  x", "[Page 4]  x"), (" Feedback ", None), ("@ ™", None), (" >", None), ("•••", None), ("•  of note", "• of note"),
    ("“a”  ‘b’", "\"a\" ''b''"), ("1999–2001 — end", "1999--2001 - end"), ("> quoted  text", "quoted text"), ("call (1 555.123 4567)", "call (1-555-123-4567)"), ("no 5551234567 it is", "no555-123-4567 it is"),
    ("(5551234567)", "(5551234567)"), ("555.123.4567, 555-1234567", "555-123-4567,555-123-4567"), ("id 12345678901", "id 1-234-567-8901"), ("   ", ""),
)
_IN = " ".join(f"WHEN {k} THEN '{x[0]}'" for k, x in enumerate(_BODY))
_OUT = " ".join(f"WHEN {k} THEN " + ("NULL" if x[1] is None else f"'{x[1]}'") for k, x in enumerate(_BODY))


@query("body_lines", f"SELECT document_id, pos, CASE pos % 20 {_OUT} ELSE 'ab ' || trim(regexp_replace(regexp_replace(line, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) END AS line FROM v_lines WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 0")
def _(v):
    lines = v("v_lines").filter("length(regexp_replace(line, '[^A-Za-z]', '')) > 0")
    return lines.select("document_id", "pos", S.body_line(F.expr(f"CASE pos % 20 {_IN} ELSE 'ab  ' || regexp_replace(line, '[^A-Za-z ]', '') || ' ' END")).alias("line"))
