"""Queries over search and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caselake.operators import retrieval as R
from caselake.plans.registry import query
from caselake.plans.text import TRGM

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"
QTEXT = "the and attion to thanedble"


def _vector(v, vec_id: int = 0):
    """The one query vector."""
    return v("embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query("topk_cosine", f"SELECT section_id, round({_COS}, 4) AS score, row_number() OVER (ORDER BY {_COS} DESC, section_id) AS rank FROM v_embeddings e WHERE {_COS} >= 0.1 AND document_type <> 'Contract - NDA' QUALIFY rank <= 10")
def _(v):
    hits = R.vector_search(v("v_embeddings"), _vector(v), 10, 0.1, document_types=["Pleading - Complaint", "Evidence - Exhibit"])
    w = Window.orderBy(F.col("semantic_score").desc(), "section_id")
    return hits.select("section_id", F.round("semantic_score", 4).alias("score"), F.row_number().over(w).alias("rank"))


_T, _Q = TRGM.format(x="search_text"), TRGM.format(x=f"'{QTEXT}'")
_HYBRID = f"""WITH sem AS (SELECT section_id, {_COS} AS s FROM v_embeddings e WHERE {_COS} >= 0.05 ORDER BY s DESC, section_id LIMIT 30),
 kw AS (SELECT section_id, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) AS k FROM (SELECT section_id, {_T} AS t, {_Q} AS q FROM v_embeddings) WHERE k >= 0.3 ORDER BY k DESC, section_id LIMIT 30)
 SELECT section_id, round(s, 4) AS semantic_score, round(coalesce(k, 0.0), 4) AS keyword_score, round(0.7 * s + 0.3 * coalesce(k, 0.0), 4) AS score, row_number() OVER (ORDER BY round(0.7 * s + 0.3 * coalesce(k, 0.0), 4) DESC, section_id) AS rank FROM sem LEFT JOIN kw USING (section_id) QUALIFY rank <= 10"""


@query("hybrid_search", _HYBRID)
def _(v):
    return R.hybrid_search(v("v_embeddings"), _vector(v), QTEXT, threshold=0.05)


@query("batch_search", "WITH q AS (SELECT section_id AS query_id, case_id, embedding AS qvec FROM v_embeddings WHERE section_id % 20 = 0), p AS (SELECT query_id, section_id, list_cosine_similarity(e.embedding::DOUBLE[], qvec::DOUBLE[]) AS s FROM v_embeddings e JOIN q USING (case_id)) SELECT query_id, section_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, section_id) AS rank FROM p QUALIFY rank <= 3")
def _(v):
    e = v("v_embeddings")
    q = e.filter("section_id % 20 = 0").select(F.col("section_id").alias("query_id"), "case_id", F.col("embedding").alias("qvec"))
    return R.batch_search(e.select("section_id", "case_id", "embedding"), q)


@query("enrich_hits", "SELECT e.section_id, s.section_title, d.file_name, s.start_page FROM (SELECT section_id, document_id * 100000 AS target FROM v_embeddings) e LEFT JOIN v_sections s ON s.section_id = e.target LEFT JOIN v_docs d ON d.document_id = s.document_id")
def _(v):
    hits = v("v_embeddings").select(F.col("section_id").alias("hit"), (F.col("document_id") * 100000).alias("section_id"))
    return R.enrich_hits(hits, v("v_sections"), v("v_docs")).select(F.col("hit").alias("section_id"), "section_title", "file_name", "start_page")


@query("query_extractions", "SELECT extraction_id, entity_name, confidence, row_number() OVER (ORDER BY confidence DESC, extraction_id, entity_name) AS rank FROM v_extractions JOIN v_docs USING (document_id) WHERE extraction_type = 'party' AND entity_name ILIKE '%widget%' AND document_type = 'Contract - NDA' QUALIFY rank <= 50")
def _(v):
    return R.query_extractions(v("v_extractions"), v("v_docs"), "party", "widget", "Contract - NDA").select("extraction_id", "entity_name", "confidence", "rank")


@query("find_sections", "SELECT section_id FROM v_sections WHERE section_text ILIKE '%license%' AND start_page BETWEEN 1 AND 4")
def _(v):
    return R.find_sections(v("v_sections"), "license", pages=(1, 4)).select("section_id")


_SHINGLES = "WITH RECURSIVE w AS (SELECT document_id, list_filter(string_split_regex(lower(section_text), '\\s+'), lambda x: x <> '') AS w FROM v_sections WHERE pos = 0), s AS (SELECT document_id, CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w WHERE len(w) > 0), g AS (SELECT document_id, len(s) AS n, unnest(s) AS g FROM s), e AS (SELECT a.document_id AS a, b.document_id AS b FROM g a JOIN g b ON a.g = b.g GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9), r(node, root) AS (SELECT document_id, document_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)"


@query("near_duplicates", f"{_SHINGLES} SELECT node AS document_id, min(root) AS duplicate_of FROM r GROUP BY 1")
def _(v):
    return R.near_duplicates(v("v_sections").filter("pos = 0").select("document_id", "section_text"))


@query("model_labels", "SELECT section_id, CASE WHEN contains(section_text, '!') THEN 'loud' ELSE 'calm' END AS label FROM v_sections")
def _(v):
    def model(batches):
        for texts in batches:
            yield texts.str.contains("!", regex=False).map({True: "loud", False: "calm"})

    return R.with_model(v("v_sections"), "section_text", model, StringType(), "label").select("section_id", "label")


_ITEMS = "SELECT document_id AS item_id, case_id, CASE WHEN document_id % 3 = 0 THEN 'A' WHEN document_id % 3 = 1 THEN lang ELSE 'zzz' END AS ref FROM v_docs WHERE case_id IS NOT NULL"
_EXPL = f"WITH i AS ({_ITEMS}), m AS (SELECT i.item_id, i.ref, min(row(CASE WHEN ends_with(lower(d.file_name), 'exhibit_' || lower(i.ref)) THEN 1 ELSE 2 END, d.document_id)) AS m FROM i JOIN v_docs d USING (case_id) WHERE contains(lower(d.file_name), lower(i.ref)) GROUP BY 1, 2), x AS (SELECT i.item_id, i.ref, struct_extract_at(m.m, 2) AS document_id, CASE WHEN m.m IS NULL THEN 0.0 ELSE 0.95 END AS confidence FROM i LEFT JOIN m USING (item_id, ref))"


def _items(v):
    v("v_docs").createOrReplaceTempView("v_docs")
    return v.spark.sql(_ITEMS)


@query("explicit_links", f"{_EXPL} SELECT * FROM x")
def _(v):
    return R.explicit_links(_items(v), v("v_docs"))


@query("link_stats", f"{_EXPL} SELECT ref AS kind, count(*) AS links, count(document_id) AS resolved, count(DISTINCT item_id) AS items FROM x GROUP BY 1")
def _(v):
    return R.link_stats(R.explicit_links(_items(v), v("v_docs")).withColumnRenamed("ref", "kind"))


@query("implicit_links", "WITH q AS (SELECT section_id AS item_id, case_id, document_id AS own, embedding AS qvec FROM v_embeddings WHERE section_id % 20 = 0), p AS (SELECT item_id, section_id, document_id, own, round(s, 4) AS s FROM (SELECT item_id, section_id, document_id, own, list_cosine_similarity(e.embedding::DOUBLE[], qvec::DOUBLE[]) AS s FROM v_embeddings e JOIN q USING (case_id)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, section_id) <= 8), d AS (SELECT item_id, document_id, max(s) AS score FROM p WHERE s >= 0.05 AND document_id <> own GROUP BY 1, 2) SELECT item_id, document_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id) AS rank FROM d QUALIFY rank <= 2")
def _(v):
    e = v("v_embeddings")
    q = e.filter("section_id % 20 = 0").select(F.col("section_id").alias("query_id"), "case_id", F.col("embedding").alias("qvec"))
    own = e.filter("section_id % 20 = 0").select(F.col("section_id").alias("item_id"), "document_id")
    return R.implicit_links(q, e.select("section_id", "case_id", "embedding", "document_id"), own, 2, 0.05).select("item_id", "document_id", "score", "rank")


@query("provenance_links", "WITH a AS (SELECT document_id AS answer_id, text AS answer FROM v_docs), h AS (SELECT s.document_id AS answer_id, d.file_name, trim(substring(s.section_text, 1, 12)) AS title, ((s.pos * 37) % 100) / 100.0 AS score, s.section_id, s.section_text AS text FROM v_sections s JOIN v_docs d USING (document_id)) SELECT answer_id, file_name, title, section_id, substring(text, 1, 200) AS snippet FROM a JOIN h USING (answer_id) WHERE (length(title) > 4 AND contains(lower(answer), lower(title))) OR score >= 0.65 QUALIFY row_number() OVER (PARTITION BY answer_id, file_name, title ORDER BY score DESC, section_id) = 1")
def _(v):
    a = v("v_docs").select(F.col("document_id").alias("answer_id"), F.col("text").alias("answer"))
    h = v("v_sections").join(v("v_docs").select("document_id", "file_name"), "document_id")
    h = h.select(F.col("document_id").alias("answer_id"), "file_name", F.trim(F.substring("section_text", 1, 12)).alias("title"), ((F.col("pos") * 37) % 100 / 100).alias("score"), "section_id", F.col("section_text").alias("text"))
    return R.provenance(a, h)


@query("review_pivot", "SELECT case_id, count(*) FILTER (o = 'approved') AS approved, count(*) FILTER (o = 'corrected') AS corrected, count(*) FILTER (o = 'rejected') AS rejected FROM (SELECT case_id, CASE (session_id + turn) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rejected' END AS o FROM v_responses) GROUP BY 1")
def _(v):
    r = v("v_responses").withColumn("response_id", F.expr("session_id * 10000 + turn"))
    reviews = r.selectExpr("response_id", "CASE (session_id + turn) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rejected' END AS outcome").filter("outcome IS NOT NULL").distinct()
    return R.review_outcomes(r.select("response_id", "case_id"), reviews)


@query("tool_log", "WITH c AS (SELECT conv_id, turn, text, turn - turn % 2 AS call_id, role FROM conversations), r AS (SELECT conv_id, call_id, substring(text, 1, 300) AS s FROM c WHERE role = 'assistant') SELECT c.conv_id AS session_id, string_agg(concat_ws(' => ', substring(c.text, 1, 40), substring(r.s, 1, 40)), chr(10) ORDER BY c.turn, concat_ws(' => ', substring(c.text, 1, 40), substring(r.s, 1, 40))) AS steps FROM c LEFT JOIN r USING (conv_id, call_id) WHERE c.role = 'user' GROUP BY 1")
def _(v):
    m = v("conversations").selectExpr("conv_id AS session_id", "turn", "role", "turn - turn % 2 AS call_id", "text")
    return R.tool_log(m)


_CALLED = "SELECT conv_id, turn, 'search' AS tool_name, substring(text, 1, 20) AS args, turn - turn % 2 AS call_id, role, text FROM conversations"


@query("response_rows", f"WITH c AS ({_CALLED}), r AS (SELECT conv_id, call_id, max(row(turn, substring(text, 1, 300))) AS m FROM c WHERE role = 'assistant' GROUP BY 1, 2), s AS (SELECT conv_id AS session_id, string_agg(tool_name || '(' || args || '): ' || coalesce(struct_extract_at(m, 2), ''), chr(10) ORDER BY turn, call_id, args, coalesce(struct_extract_at(m, 2), '')) AS calls FROM c LEFT JOIN r USING (conv_id, call_id) WHERE role = 'user' GROUP BY 1), a AS (SELECT case_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE session_id END AS session_id, repeat('why ', 600) AS query, text AS answer, confidence, turn FROM v_responses WHERE role = 'assistant') SELECT case_id, coalesce(a.session_id::VARCHAR, 'unknown') AS session_id, substring(query, 1, 2000) AS query, 'analyst' AS agent_name, answer, round(confidence, 4) AS confidence, turn % 2 = 0 AS needs_review, coalesce(calls, '') AS tool_calls_made FROM a LEFT JOIN s ON s.session_id = a.session_id WHERE case_id IS NOT NULL AND answer <> ''")
def _(v):
    m = v("conversations").selectExpr("CAST(conv_id AS string) AS session_id", "turn", "CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' END AS kind", "turn - turn % 2 AS call_id", "'search' AS tool_name", "substring(text, 1, 20) AS args", "text")
    a = v("v_responses").filter("role = 'assistant'").selectExpr("case_id", "CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(session_id AS string) END AS session_id", "repeat('why ', 600) AS query", "'analyst' AS agent_name", "text AS answer", "confidence", "turn % 2 = 0 AS needs_review")
    calls = F.expr("array_join(transform(tool_calls_made, c -> c.tool_name || '(' || c.args || '): ' || c.result_summary), '\n')")
    return R.response_rows(a, m).withColumn("tool_calls_made", calls)


@query("query_kg", "WITH n AS (SELECT node_id, node_label FROM v_nodes WHERE node_type = 'obligation' AND contains(lower(node_label), 'item 1')) SELECT n.node_label AS src_label, edge_type, coalesce(t.node_label, substring(dst, 1, 8)) AS dst_label, max(confidence) AS confidence FROM v_edges JOIN n ON n.node_id = src LEFT JOIN n t ON t.node_id = dst WHERE edge_type = 'breached_by' GROUP BY 1, 2, 3")
def _(v):
    return R.query_kg(v("v_nodes"), v("v_edges"), "obligation", "breached_by", "ITEM 1")


_LINKED = """WITH i AS (SELECT section_id AS item_id, case_id, embedding AS qvec, CASE section_id % 60 WHEN 0 THEN 'See Exhibits A and ZZ9 of the complaint' WHEN 20 THEN 'a short one' ELSE 'a text of more than twenty characters' END AS text FROM v_embeddings WHERE section_id % 20 = 0 AND section_id % 7 <> 0),
 f AS (SELECT item_id, case_id, unnest(['A', 'ZZ9']) AS ref FROM i WHERE item_id % 60 = 0),
 m AS (SELECT item_id, ref, min(row(CASE WHEN ends_with(lower(d.file_name), 'exhibit_' || lower(ref)) THEN 1 ELSE 2 END, d.document_id)) AS m FROM f JOIN v_docs d USING (case_id) WHERE contains(lower(d.file_name), lower(ref)) GROUP BY 1, 2),
 x AS (SELECT item_id, struct_extract_at(m, 2) AS document_id, ref FROM m),
 p AS (SELECT item_id, e.document_id, round(list_cosine_similarity(e.embedding::DOUBLE[], qvec::DOUBLE[]), 4) AS s FROM v_embeddings e JOIN i USING (case_id) WHERE length(text) > 20 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], qvec::DOUBLE[]) DESC, section_id) <= 8),
 d AS (SELECT item_id, document_id, max(s) AS score FROM p WHERE s >= 0.05 AND NOT EXISTS (SELECT 1 FROM x WHERE x.item_id = p.item_id AND x.document_id = p.document_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY max(s) DESC, document_id) <= 2)
 SELECT item_id, document_id, 'explicit_citation' AS link_type, ref AS reference, 0.95 AS confidence FROM x UNION ALL SELECT item_id, document_id, 'agent_discovered', NULL, score FROM d"""


@query("link_evidence", _LINKED)
def _(v):
    e = v("v_embeddings")
    text = "CASE section_id % 60 WHEN 0 THEN 'See Exhibits A and ZZ9 of the complaint' WHEN 20 THEN 'a short one' ELSE 'a text of more than twenty characters' END AS text"
    items = e.filter("section_id % 20 = 0").selectExpr("section_id AS item_id", "case_id", text, "embedding AS qvec")
    links = e.filter("section_id % 20 = 0 AND section_id % 7 = 0").selectExpr("section_id AS item_id", "document_id")
    return R.link_evidence(items, v("v_docs"), e.select("section_id", "case_id", "embedding", "document_id"), links, 2, 0.05)


@query("hybrid_search_sql", _HYBRID)
def _(v):
    """The search called from SQL, as a table function."""
    from caselake.operators.search_function import register_search

    v("v_embeddings").createOrReplaceTempView("v_embeddings")
    register_search(v.spark, "v_embeddings")
    vector = ", ".join(f"{float(x)!r}D" for x in _vector(v))
    return v.spark.sql(f"SELECT * FROM hybrid_search(array({vector}), '{QTEXT}', threshold => 0.05D)")


@query("approx_topk")
def _(v):
    """Nearest sections by the stored buckets of an index that is built first; recall is measured in the tests."""
    import uuid

    from caselake.operators import vector_index
    from caselake.operators.graph import shared_folder

    path = f"{shared_folder(v.spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build_index(v("v_embeddings").select("section_id", "document_type", "embedding"), path, 64)
    q = v("embeddings").filter("vec_id = 0").first()["embedding"]
    hits = vector_index.approx_search(v.spark, path, q, 10, 0.1, document_types=["Contract - NDA"])
    return hits.select("section_id", F.round("semantic_score", 4).alias("score"))
