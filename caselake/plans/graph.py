"""Queries over entities and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.functions.scalar import DATE_NAMES, NOISE_DATES, PROCEDURAL_DATES, SUFFIXES
from caselake.operators import graph as G
from caselake.operators import nodes as N
from caselake.operators import relational as R
from caselake.plans.registry import query


@query("kg_triples", "SELECT a.node_id AS src, e.edge_type, b.node_id AS dst, row_number() OVER (ORDER BY a.node_id, b.node_id, e.edge_type) AS rank FROM v_edges e JOIN v_nodes a ON a.node_id = e.src JOIN v_nodes b ON b.node_id = e.dst WHERE a.node_type = 'claim' AND b.node_label ILIKE '%supplier%' QUALIFY rank <= 50")
def _(v):
    from caselake.operators.aggregates import ranked
    from caselake.operators.relational import ilike_contains

    a = v("v_nodes").filter("node_type = 'claim'").select(F.col("node_id").alias("src"))
    b = v("v_nodes").filter(ilike_contains("node_label", "supplier")).select(F.col("node_id").alias("dst"))
    rows = v("v_edges").join(a, "src").join(b, "dst").select("src", "edge_type", "dst")
    return ranked(rows, [F.col("src"), F.col("dst"), F.col("edge_type")], 50)


_CO = "SELECT DISTINCT s.node_id AS src, t.node_id AS dst, '{e}' AS edge_type, {c} AS confidence FROM v_nodes s JOIN v_nodes t ON t.document_id = s.document_id AND t.section_id = s.section_id AND s.node_type = '{a}' AND t.node_type = '{b}'"


@query("colocated_edges", _CO.format(e="relies_on", c=0.7, a="claim", b="legal_authority"))
def _(v):
    return G.colocated(v("v_nodes"), "claim", "legal_authority", "relies_on", 0.7)


@query("intra_edges", " UNION ALL ".join(_CO.format(e=e, c=c, a=a, b=b) for a, b, e, c in (("claim", "legal_authority", "relies_on", 0.7), ("obligation", "party", "obligated_to", 0.7), ("party", "event", "involved_in", 0.6), ("claim", "evidence", "supported_by", 0.65))))
def _(v):
    return G.intra_edges(v("v_nodes"))


@query("same_label_pairs", "SELECT node_id AS b, first_id AS a FROM (SELECT node_id, document_id, first_value(node_id) OVER w AS first_id, first_value(document_id) OVER w AS first_doc FROM v_nodes WINDOW w AS (PARTITION BY node_type, lower(trim(node_label)) ORDER BY document_id, node_id)) WHERE first_doc < document_id")
def _(v):
    return G.same_label_pairs(v("v_nodes"))


@query("resolve_evidence", "WITH e AS (SELECT * FROM v_nodes WHERE node_type = 'event') SELECT a.node_id, min(b.node_id) AS canonical_id FROM e a JOIN e b ON lower(trim(a.node_label)) = lower(trim(b.node_label)) GROUP BY 1")
def _(v):
    e = v("v_nodes").filter("node_type = 'event'")
    first = e.groupBy(F.lower(F.trim("node_label")).alias("norm")).agg(F.min("node_id").alias("a"))
    links = e.select(F.col("node_id").alias("b"), F.lower(F.trim("node_label")).alias("norm")).join(first, "norm").filter("a <> b").select("a", "b")
    return G.elect_canonical(e, G.components(links))


def _case_parties(v):
    return v("v_nodes").filter("node_type = 'party'").join(v("v_docs").select("document_id", "case_id"), "document_id")


@query("similar_pairs")
def _(v):
    from caselake.functions.scalar import norm_party

    return G.similar_pairs(_case_parties(v).withColumn("norm", norm_party("node_label")))


@query("resolve_entities")
def _(v):
    return G.resolve_entities(v("v_nodes").join(v("v_docs").select("document_id", "case_id"), "document_id"))


@query("fuzzy_dedup")
def _(v):
    return G.fuzzy_dedup(v("v_nodes"))


_EXACT = "WITH e AS (SELECT n.node_id, d.case_id, lower(trim(n.node_label)) AS l FROM v_nodes n JOIN v_docs d USING (document_id) WHERE node_type IN ('evidence', 'amount') AND d.case_id IS NOT NULL)"


@query("merge_log", f"{_EXACT}, f AS (SELECT node_id, first_value(node_id) OVER (PARTITION BY case_id, l ORDER BY node_id) AS a FROM e) SELECT a, node_id AS b, 'exact' AS method FROM f WHERE a <> node_id")
def _(v):
    """Exact merges of two kinds over cases; the fuzzy ones are tested against brute force."""
    n = v("v_nodes").filter("node_type IN ('evidence', 'amount')").join(v("v_docs").select("document_id", "case_id"), "document_id")
    return G.merge_log(n, "case_id", {"evidence": 1.0, "amount": 1.0}).select("a", "b", "method")


@query("match_party")
def _(v):
    p = v("v_nodes").filter("node_type = 'party'")
    names = p.select(F.col("node_id").alias("name_id"), "document_id", F.concat(F.col("node_label"), F.lit(", Inc.")).alias("name"))
    return G.match_party(names, p)


@query("components", "WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM v_edges WHERE edge_type = 'breached_by' UNION SELECT dst, src FROM v_edges WHERE edge_type = 'breached_by'), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1")
def _(v):
    return G.components(v("v_edges").filter("edge_type = 'breached_by'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("same_as_edges", "WITH k AS (SELECT DISTINCT node_id, node_type || CAST(section_id AS VARCHAR) AS g FROM v_nodes WHERE node_type = 'party'), c AS (SELECT g, min(node_id) AS canon FROM k GROUP BY 1) SELECT node_id AS src, canon AS dst, 'same_as' AS edge_type, 0.8 AS confidence FROM k JOIN c USING (g) WHERE node_id <> canon")
def _(v):
    k = v("v_nodes").filter("node_type = 'party'").select("node_id", F.expr("node_type || CAST(section_id AS string)").alias("g")).distinct()
    c = k.groupBy("g").agg(F.min("node_id").alias("canon"))
    return k.join(c, "g").filter("node_id <> canon").select(F.col("node_id").alias("src"), F.col("canon").alias("dst"), F.lit("same_as").alias("edge_type"), F.lit(0.8).alias("confidence"))


#: Chains of customers up and down, popular roots, roots without a pointer of their own, cycles of three and tails that lead into them.
_POINTERS = "SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 30 = 3 THEN c_custkey + 2 WHEN c_custkey % 30 IN (4, 5) THEN c_custkey - 1 WHEN c_custkey % 30 = 6 THEN c_custkey - 2 WHEN c_custkey % 30 = 7 THEN c_custkey - 1 WHEN c_custkey % 10 = 8 THEN c_custkey WHEN c_custkey % 7 = 0 THEN 88 WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey + 2 END AS target FROM customer"


@query("follow_canonical", f"WITH RECURSIVE p AS (SELECT * FROM ({_POINTERS}) WHERE target IS NOT NULL), r(node, cur, path, stop) AS (SELECT node, target, [node], target = node FROM p UNION ALL SELECT r.node, p.target, list_append(path, cur), list_contains(list_append(path, cur), p.target) FROM r JOIN p ON p.node = r.cur WHERE NOT stop) SELECT node, cur AS root FROM r WHERE stop OR NOT EXISTS (SELECT 1 FROM p WHERE p.node = r.cur)")
def _(v):
    v("customer").createOrReplaceTempView("customer")
    return G.follow_canonical(v.spark.sql(_POINTERS))


@query("challenges_edges", "SELECT a.document_id AS src, b.document_id AS dst, 'challenges' AS edge_type FROM v_docs a JOIN v_docs b ON a.case_id = b.case_id AND a.document_type = 'Pleading - Motion' AND b.document_type = 'Pleading - Complaint' WHERE EXISTS (SELECT 1 FROM v_nodes x JOIN v_nodes y ON x.node_type = 'party' AND y.node_type = 'party' AND x.document_id = a.document_id AND y.document_id = b.document_id AND regexp_extract(x.node_label, '\\S+$') = regexp_extract(y.node_label, '\\S+$'))")
def _(v):
    canonical = v("v_nodes").filter("node_type = 'party'").select("node_id", F.regexp_extract("node_label", r"\S+$", 0).alias("canonical_id"))
    d = v("v_docs").select("document_id", "case_id", "document_type")
    return G.shared_party_edges(v("v_nodes"), d.filter("document_type = 'Pleading - Motion'").drop("document_type"), d.filter("document_type = 'Pleading - Complaint'").drop("document_type"), canonical, "challenges")


@query("exhibit_edges", "WITH c AS (SELECT document_id, parent_document_id FROM v_docs WHERE parent_document_id IS NOT NULL AND contains(file_name, 'exhibit')), p AS (SELECT e.node_id AS src, t.node_id AS dst, row_number() OVER (PARTITION BY e.node_id ORDER BY t.node_type <> 'party', t.node_id) AS n FROM v_nodes e JOIN c USING (document_id) JOIN v_nodes t ON t.document_id = c.parent_document_id WHERE e.node_type = 'obligation') SELECT src, dst, 'exhibit_of' AS edge_type, 0.85 AS confidence FROM p WHERE n <= 10")
def _(v):
    return G.exhibit_edges(v("v_nodes"), v("v_docs"), kind="obligation")


def found(v):
    """The extractions as a table, as a pipeline would have them: inlined, the view's long expressions would be repeated in each of the operator's."""
    return G.kept(v("v_found"))


_NORM = "CASE node_type WHEN 'party' THEN trim(regexp_replace(regexp_replace(lower(node_label), '" + SUFFIXES + "', ''), '\\s+', ' ', 'g')) ELSE regexp_replace(lower(node_label), '\\s+', ' ', 'g') END"
_TYPED_SQL = f"""WITH x AS (SELECT *, try_cast(properties AS JSON) AS p FROM v_found),
y AS (SELECT *, lower(coalesce(p->>'$.date_type', '')) AS dt, trim(coalesce(entity_name, '')) AS n0 FROM x),
z AS (SELECT *, CASE WHEN n0 = '' AND extraction_type = 'case_citation' THEN trim(coalesce(nullif(p->>'$.case_name', ''), p->>'$.citation', '')) ELSE n0 END AS n FROM y),
t AS (SELECT *, CASE WHEN extraction_type = 'date' THEN
  CASE WHEN lower(n) IN {DATE_NAMES} OR regexp_matches(n, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR dt IN {NOISE_DATES} THEN NULL WHEN dt IN {PROCEDURAL_DATES} THEN 'procedural_event' ELSE 'event' END
  WHEN extraction_type IN ('party', 'claim', 'obligation', 'amount', 'condition') THEN extraction_type WHEN extraction_type = 'cause_of_action' THEN 'claim'
  WHEN extraction_type = 'evidence_ref' THEN 'evidence' WHEN extraction_type = 'case_citation' THEN 'legal_authority' END AS node_type FROM z WHERE n <> ''),
l AS (SELECT *, CASE WHEN node_type IN ('claim', 'obligation') AND length(n) > 120 THEN substring(n, 1, 117) || '…' ELSE n END AS node_label FROM t WHERE node_type IS NOT NULL),
k AS (SELECT *, row_number() OVER w AS nth, count(DISTINCT extraction_id) OVER (PARTITION BY document_id, node_type, {_NORM}) AS n_sources FROM l WINDOW w AS (PARTITION BY document_id, node_type, {_NORM} ORDER BY extraction_id, node_label))"""
#: The properties that the comparison looks at: a column each, null for the types that don't have it.
_ASKED = ("role", "entity_type", "jurisdiction", "claim_type", "plaintiff", "defendant", "action", "obligated_party", "amount", "date_value", "date_type", "is_relative", "reference_label", "citation", "court", "year", "currency", "payer", "payee", "is_calculated", "condition_type", "trigger_event")
_FROM_VALUE = {"entity_type": "party", "claim_type": "claim", "action": "obligation", "date_value": "event", "value": "amount", "condition_type": "condition"}
_OF = {"role": "party", "jurisdiction": "party", "plaintiff": "claim", "defendant": "claim", "obligated_party": "obligation", "amount": "obligation", "court": "legal_authority", "year": "legal_authority", "payer": "amount", "payee": "amount", "trigger_event": "condition"}


def _asked_sql(key: str) -> str:
    if key in _FROM_VALUE:
        kind = _FROM_VALUE[key]
        return f"CASE WHEN node_type IN ('{kind}', '{'procedural_event' if kind == 'event' else kind}') THEN entity_value END AS {key}"
    own = f"p->>'$.{key}'"
    by_type = {
        "date_type": "CASE WHEN node_type IN ('event', 'procedural_event') THEN dt END", "is_relative": f"CASE WHEN node_type IN ('event', 'procedural_event') THEN coalesce({own}, 'false') END",
        "reference_label": "CASE WHEN node_type = 'evidence' THEN n END", "citation": f"CASE WHEN node_type = 'legal_authority' THEN coalesce(nullif({own}, ''), entity_value) END",
        "currency": f"CASE WHEN node_type = 'amount' THEN coalesce({own}, 'USD') END", "is_calculated": f"CASE WHEN node_type = 'amount' THEN coalesce({own}, 'false') END",
    }
    return f"{by_type.get(key) or f"CASE WHEN node_type = '{_OF[key]}' THEN {own} END"} AS {key}"


@query("build_nodes", f"{_TYPED_SQL} SELECT k.document_id, d.case_id, node_type, node_label, k.section_id, extraction_id, n_sources, {', '.join(map(_asked_sql, _ASKED))}, CASE WHEN node_type = 'claim' THEN coalesce(array_to_string(CAST(p->'$.evidence_references' AS VARCHAR[]), ';'), '') END AS refs, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.8 ELSE confidence END AS sure, coalesce(s.semantic_label, '') AS semantic_label, coalesce(d.document_type, '') AS document_type FROM k LEFT JOIN v_docs d ON d.document_id = k.document_id LEFT JOIN v_sections s ON s.section_id = k.section_id WHERE nth = 1")
def _(v):
    nodes = N.build_nodes(v("v_found"), v("v_docs"), v("v_sections"))
    get = lambda k, kind="string": F.try_variant_get("properties", f"$.{k}", kind)
    refs = F.array_join(get("evidence_references", "array<string>"), ";").alias("refs")
    more = [get(k).alias(k) for k in _ASKED]
    about = [get("confidence", "double").alias("sure"), get("source_semantic_label").alias("semantic_label"), get("source_document_type").alias("document_type")]
    return nodes.select("document_id", "case_id", "node_type", "node_label", F.col("source_section_id").alias("section_id"), F.col("source_extraction_id").alias("extraction_id"), F.size("source_extraction_ids").cast("bigint").alias("n_sources"), *more, refs, *about)


@query("extraction_nodes", f"{_TYPED_SQL} SELECT extraction_id, first_value(extraction_id) OVER (PARTITION BY document_id, node_type, {_NORM} ORDER BY extraction_id) AS node_of FROM k")
def _(v):
    """Which node each extraction became, shown by the node's first extraction."""
    rows = G.kept(N.extraction_nodes(found(v)).select("extraction_id", "node_id"))
    return rows.join(R.shuffled(rows.groupBy("node_id").agg(F.min("extraction_id").alias("node_of"))), "node_id").select("extraction_id", "node_of")


@query("extracted_edges")
def _(v):
    """Extractions to typed nodes to the edges that follow from a document's own nodes; in pytest against hand-made rows."""
    nodes = G.kept(N.edge_columns(N.build_nodes(v("v_found"), v("v_docs"))))
    return G.document_edges(nodes, v("v_docs"))


@query("dedup_nodes", "SELECT document_id, node_type, lower(trim(node_label)) AS norm, min(node_id) AS node_id, count(*) AS merged, array_to_string(list_sort(list(DISTINCT CAST(section_id AS VARCHAR))), ',') AS sections FROM v_nodes GROUP BY 1, 2, 3")
def _(v):
    return G.dedup_nodes(v("v_nodes"))


@query("flatten_entities", "SELECT o_orderkey AS section_id, k AS kind, CASE k WHEN 'parties' THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS name, c AS confidence, c < 0.7 AS needs_review FROM (SELECT o_orderkey, o_custkey, o_orderpriority, 'parties' AS k, 0.6 AS c FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, 'dates', 0.9 FROM orders WHERE o_orderkey % 3 = 0)")
def _(v):
    json = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("name"), F.lit(0.6).alias("confidence"))).alias("parties"), F.array(F.struct(F.col("o_orderpriority").alias("name"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 0.9D ELSE 0.4D END").alias("confidence"))).alias("dates")))
    rows = v("orders").select(F.col("o_orderkey").alias("section_id"), json.alias("json"))
    return G.flatten_entities(rows).select("section_id", "kind", "name", "confidence", "needs_review")


def _nested(v):
    count = lambda n: F.struct(F.lit(n).alias("number"), F.concat(F.lit(f"Count {n} "), F.col("o_orderpriority")).alias("label"), F.array(F.struct(F.lit(1).alias("number"), F.col("o_custkey").cast("string").alias("text"))).alias("elements"), F.array(F.struct(F.col("o_orderstatus").alias("text"), F.lit(n).alias("element"), F.array(F.lit("Exhibit A"), F.lit("Exhibit B")).alias("evidence"))).alias("allegations"))
    claims = F.array(F.struct(F.col("o_orderpriority").alias("label"), F.array(count(1), count(2)).alias("counts")))
    theories = F.array(F.struct(F.lit("T").alias("name"), F.lit(2).alias("count_number")))
    return v("orders").select(F.col("o_orderkey").alias("document_id"), F.to_json(F.struct(claims.alias("claims"), theories.alias("theories"))).alias("json"))


@query("flatten_structure", "SELECT o_orderkey AS document_id, CAST(o_orderkey AS VARCHAR) || '/0/' || CAST(n - 1 AS VARCHAR) AS count_id, 'Count ' || CAST(n AS VARCHAR) || ' ' || o_orderpriority AS label, CAST(2 AS BIGINT) AS n_evidence, CASE n WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '/0/0#1' END AS element_id, n = 2 AS has_theory FROM orders, (SELECT unnest([1, 2]) AS n)")
def _(v):
    t = G.flatten_structure(_nested(v))
    a = G.link_elements(t["allegations"], t["elements"]).join(t["evidence_links"].groupBy("allegation_id").agg(F.count("*").alias("n_evidence")), "allegation_id")
    theory = G.link_theories(t["theories"], t["counts"]).select("count_id", F.lit(True).alias("th"))
    return t["counts"].join(a, "count_id").join(theory, "count_id", "left").select("document_id", "count_id", "label", "n_evidence", "element_id", F.coalesce("th", F.lit(False)).alias("has_theory"))


@query("link_elements", "SELECT CAST(o_orderkey AS VARCHAR) || '/0/' || CAST(n - 1 AS VARCHAR) || '/0' AS allegation_id, CASE n WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '/0/0#1' END AS element_id FROM orders, (SELECT unnest([1, 2]) AS n)")
def _(v):
    t = G.flatten_structure(_nested(v))
    return G.link_elements(t["allegations"], t["elements"]).select("allegation_id", "element_id")


@query("fill_schema", "WITH s(claim_type, ord, element) AS (VALUES ('F', 1, 'duty'), ('F', 2, 'breach'), ('O', 1, 'offer'), ('O', 2, 'acceptance'), ('P', 1, 'intent')), m AS (SELECT o_orderkey AS count_id, ord, element FROM orders JOIN s ON claim_type = o_orderstatus WHERE NOT (o_orderkey % 2 = 0 AND element IN ('duty', 'offer'))) SELECT count_id, row_number() OVER (PARTITION BY count_id ORDER BY ord) AS number, element, 0.6 AS confidence FROM m")
def _(v):
    schema = v.spark.createDataFrame([("F", 1, "duty"), ("F", 2, "breach"), ("O", 1, "offer"), ("O", 2, "acceptance"), ("P", 1, "intent")], "claim_type string, ord int, element string")
    counts = v("orders").select(F.col("o_orderkey").alias("count_id"), F.col("o_orderstatus").alias("claim_type"))
    present = counts.filter("count_id % 2 = 0").select("count_id", F.explode(F.array(F.lit("duty"), F.lit("offer"))).alias("element"))
    return G.fill_schema(counts, present, schema)


@query("demote_factual", "SELECT section_id, section_title AS label, semantic_label = 'factual_allegations' AS demoted FROM v_sections WHERE semantic_label IS NOT NULL")
def _(v):
    s = v("v_sections").filter("semantic_label IS NOT NULL")
    stay, gone = G.demote_factual(s.select("section_id", F.col("section_title").alias("label")), s.filter("semantic_label = 'factual_allegations'").select("section_id"))
    return stay.withColumn("demoted", F.lit(False)).unionByName(gone.select("section_id", F.col("allegation").alias("label"), F.lit(True).alias("demoted")))


@query("promote_case", "SELECT case_id, coalesce(nullif(trim(our_client), ''), CASE WHEN party_role = 'plaintiff' THEN 'P' || CAST(case_id AS VARCHAR) ELSE 'D' || CAST(case_id AS VARCHAR) END) AS our_client, coalesce(nullif(trim(opposing_party), ''), CASE WHEN party_role = 'plaintiff' THEN 'D' || CAST(case_id AS VARCHAR) ELSE 'P' || CAST(case_id AS VARCHAR) END) AS opposing_party FROM v_cases")
def _(v):
    names = v("v_cases").select("case_id", F.expr("'P' || CAST(case_id AS string) AS plaintiff"), F.expr("'D' || CAST(case_id AS string) AS defendant"))
    return G.promote_case(v("v_cases"), names).select("case_id", "our_client", "opposing_party")


@query("filing_context", "SELECT document_id, CASE WHEN contains(file_name, 'exhibit') THEN 'evidence' WHEN document_type = 'Pleading - Complaint' AND row_number() OVER (PARTITION BY case_id, document_type, contains(file_name, 'exhibit') ORDER BY created_at, document_id) = 1 THEN 'primary' ELSE 'supporting' END AS purpose FROM v_docs WHERE case_id IS NOT NULL")
def _(v):
    from pyspark.sql import Window

    d = v("v_docs").filter("case_id IS NOT NULL").withColumn("ex", F.contains("file_name", F.lit("exhibit")))
    n = F.row_number().over(Window.partitionBy("case_id", "document_type", "ex").orderBy("created_at", "document_id"))
    return d.withColumn("n", n).select("document_id", F.expr("CASE WHEN ex THEN 'evidence' WHEN document_type = 'Pleading - Complaint' AND n = 1 THEN 'primary' ELSE 'supporting' END AS purpose"))


@query("timeline", "SELECT n.node_id, n.node_type, CASE n.kind WHEN 0 THEN date_value WHEN 1 THEN date_value || '-00-00' WHEN 2 THEN substring(date_value, 8, 4) || '-00-00' ELSE '9999-99-99' END AS date_key, p.parties FROM (SELECT *, CAST(substring(node_id, 2) AS BIGINT) % 4 AS kind FROM v_nodes WHERE node_type IN ('event', 'procedural_event')) n LEFT JOIN (SELECT e.dst, array_to_string(list_sort(list(DISTINCT p.node_label)), '|') AS parties FROM v_edges e JOIN v_nodes p ON p.node_id = e.src AND p.node_type = 'party' WHERE e.edge_type = 'involved_in' GROUP BY 1) p ON p.dst = n.node_id")
def _(v):
    return G.timeline(v("v_nodes"), v("v_edges")).select("node_id", "node_type", "date_key", "parties")


_PATHS = """WITH RECURSIVE st AS (SELECT src AS u, dst AS v, CAST(confidence AS DOUBLE) AS c FROM v_edges WHERE edge_type IN ('supported_by', 'references', 'breached_by') AND confidence >= {least} UNION ALL SELECT dst, src, CAST(confidence AS DOUBLE) FROM v_edges WHERE edge_type IN ('supported_by', 'references', 'breached_by') AND confidence >= {least}),
 p(claim, u, t, path, confidence, hops) AS (SELECT node_id, node_id, node_type, [node_id], CAST(1.0 AS DOUBLE), 0 FROM v_nodes WHERE node_type = 'claim'
 UNION ALL SELECT p.claim, st.v, n.node_type, list_append(p.path, st.v), least(p.confidence, st.c), p.hops + 1 FROM p JOIN st ON st.u = p.u JOIN v_nodes n ON n.node_id = st.v WHERE p.hops < {hops} AND p.t NOT IN ('evidence', 'legal_authority') AND NOT list_contains(p.path, st.v))"""


@query("evidence_paths", _PATHS.format(least=0.9, hops=3) + " SELECT claim, u AS target, array_to_string(path, '>') AS path, round(confidence, 4) AS confidence, hops FROM p WHERE t IN ('evidence', 'legal_authority')")
def _(v):
    return G.evidence_paths(v("v_nodes"), v("v_edges"), 3, 0.9, ("supported_by", "references", "breached_by")).withColumn("confidence", F.round("confidence", 4))


@query("unsupported_claims", _PATHS.format(least=0.94, hops=2) + ", k AS (SELECT claim, count(*) AS paths, round(max(confidence), 4) AS best FROM p WHERE t IN ('evidence', 'legal_authority') GROUP BY 1) SELECT n.node_id, coalesce(k.paths, 0) AS paths, k.best, coalesce(k.paths, 0) = 0 AS unsupported FROM v_nodes n LEFT JOIN k ON k.claim = n.node_id WHERE n.node_type = 'claim'")
def _(v):
    paths = G.evidence_paths(v("v_nodes"), v("v_edges"), 2, 0.94, ("supported_by", "references", "breached_by"))
    return G.claim_bundles(v("v_nodes"), paths)


@query("topo_levels", "WITH RECURSIVE d AS (SELECT p_partkey AS task, p_partkey - p_partkey % 7 AS needs FROM part WHERE p_partkey % 7 IN (1, 2) UNION ALL SELECT p_partkey, p_partkey - 2 FROM part WHERE p_partkey % 7 IN (3, 4, 5, 6)), k AS (SELECT d.* FROM d JOIN part a ON a.p_partkey = d.task JOIN part b ON b.p_partkey = d.needs), r(task, level) AS (SELECT p_partkey, 0 FROM part UNION SELECT k.task, r.level + 1 FROM r JOIN k ON k.needs = r.task) SELECT task, max(level) AS level FROM r GROUP BY 1")
def _(v):
    t = v("part").select(F.col("p_partkey").cast("bigint").alias("task"))
    d = t.filter("task % 7 IN (1, 2)").selectExpr("task", "task - task % 7 AS needs").unionByName(t.filter("task % 7 >= 3").selectExpr("task", "task - 2 AS needs"))
    return G.topo_levels(t, d)


@query("detect_addons", "SELECT DISTINCT case_id, template FROM v_docs JOIN (VALUES ('motion', 'motion_pack'), ('contract', 'contract_review'), ('complaint', 'complaint_pack')) r(keyword, template) ON contains(lower(document_type), keyword) WHERE case_id IS NOT NULL")
def _(v):
    rules = v.spark.createDataFrame([("motion", "motion_pack", True), ("contract", "contract_review", True), ("complaint", "complaint_pack", True), ("order", "order_pack", False)], "keyword string, template string, built boolean")
    return G.detect_addons(v("v_docs"), rules)


@query("task_context", "SELECT t.task, string_agg(CAST(r.intake_id AS VARCHAR) || ': ' || CASE WHEN r.status = 'failed' THEN '(failed)' ELSE substring(r.file_hash, 1, 10) END, chr(10) ORDER BY r.intake_id) AS context FROM (SELECT DISTINCT job_id AS task FROM v_intake) t LEFT JOIN v_intake r ON r.job_id = t.task GROUP BY 1")
def _(v):
    i = v("v_intake")
    tasks = i.select(F.col("job_id").alias("task")).distinct()
    deps = i.select(F.col("job_id").alias("task"), F.col("intake_id").alias("needs"))
    results = i.select(F.col("intake_id").alias("task"), "status", F.col("file_hash").alias("answer"))
    return G.task_context(tasks, deps, results, 10)


@query("breached_by", "WITH d AS (SELECT document_id, case_id, document_type FROM v_docs WHERE case_id IS NOT NULL), o AS (SELECT n.node_id AS src, case_id, CAST(floor(n.section_id / 10) AS BIGINT) AS party FROM v_nodes n JOIN d USING (document_id) WHERE node_type = 'obligation' AND starts_with(document_type, 'Contract')), c AS (SELECT n.node_id AS dst, case_id, CAST(floor(n.section_id / 10) AS BIGINT) AS party FROM v_nodes n JOIN d USING (document_id) WHERE node_type = 'claim' AND document_type = 'Pleading - Complaint' AND contains(node_label, 'URGENT')) SELECT DISTINCT src, dst, 'breached_by' AS edge_type, 0.7 AS confidence FROM o JOIN c USING (case_id, party)")
def _(v):
    d = v("v_docs").filter("case_id IS NOT NULL").select("document_id", "case_id", "document_type")
    n = v("v_nodes").join(d, "document_id").withColumn("party", F.floor(F.col("section_id") / 10))
    text = F.when(F.col("node_label").contains("URGENT"), F.concat(F.lit("Breach of "), "node_label")).otherwise(F.col("node_label"))
    return G.breached_by(n.filter("node_type = 'obligation' AND document_type LIKE 'Contract%'"), n.filter("node_type = 'claim' AND document_type = 'Pleading - Complaint'").withColumn("claim_text", text))


_KIND = "CASE WHEN starts_with(document_type, 'Contract') THEN 'contract' WHEN contains(document_type, 'Subpoena') THEN 'discovery' ELSE 'suit' END"
_DE = f"""WITH n AS (SELECT v.*, {_KIND} AS kind FROM v_nodes v JOIN v_docs USING (document_id)),
 pn AS (SELECT document_id, lower(node_label) AS norm, min(node_id) AS pid FROM n WHERE node_type = 'party' GROUP BY 1, 2),
 nm AS (SELECT document_id, lower(min(node_label)) AS p, lower(max(node_label)) AS q FROM n WHERE node_type = 'party' GROUP BY 1),
 pq AS (SELECT nm.document_id, a.pid AS p, b.pid AS q FROM nm JOIN pn a ON a.document_id = nm.document_id AND a.norm = nm.p JOIN pn b ON b.document_id = nm.document_id AND b.norm = nm.q),
 ev AS (SELECT document_id, min(node_id) AS e FROM n WHERE node_type = 'evidence' AND node_label = (SELECT min(m.node_label) FROM n m WHERE m.document_id = n.document_id AND m.node_type = 'evidence') GROUP BY 1)
SELECT p AS src, node_id AS dst, 'alleged_by' AS edge_type, 0.8 AS confidence FROM n JOIN pq USING (document_id) WHERE node_type = 'claim' AND kind = 'suit'
UNION ALL SELECT node_id, q, 'alleged_against', 0.8 FROM n JOIN pq USING (document_id) WHERE node_type = 'claim' AND kind = 'suit'
UNION ALL SELECT p, node_id, 'obligated_to', 0.8 FROM n JOIN pq USING (document_id) WHERE node_type = 'obligation' AND kind = 'contract'
UNION ALL SELECT q, node_id, 'beneficiary_of', 0.8 FROM n JOIN pq USING (document_id) WHERE node_type = 'obligation' AND kind = 'contract'
UNION ALL SELECT node_id, p, 'damages_sought_by', 0.8 FROM n JOIN pq USING (document_id) WHERE node_type = 'amount' AND kind = 'suit'
UNION ALL SELECT node_id, q, 'damages_from', 0.8 FROM n JOIN pq USING (document_id) WHERE node_type = 'amount' AND kind = 'suit'
UNION ALL SELECT node_id, e, 'supported_by', 0.75 FROM n JOIN ev USING (document_id) WHERE node_type = 'claim'
UNION ALL SELECT a.node_id, b.node_id, 'relies_on', 0.75 FROM n a JOIN n b USING (document_id, section_id) WHERE a.node_type = 'claim' AND b.node_type = 'legal_authority'
UNION ALL SELECT b.node_id, a.node_id, 'conditioned_on', 0.75 FROM n a JOIN n b USING (document_id, section_id) WHERE a.node_type = 'condition' AND b.node_type = 'obligation' AND a.kind = 'contract'
UNION ALL SELECT b.node_id, a.node_id, 'involved_in', 0.7 FROM n a JOIN n b USING (document_id, section_id) WHERE a.node_type IN ('event', 'procedural_event') AND b.node_type = 'party'
UNION ALL SELECT a.node_id, b.node_id, 'quantifies', 0.75 FROM n a JOIN n b USING (document_id, section_id) WHERE a.node_type = 'amount' AND b.node_type = 'claim'"""


@query("document_edges", _DE)
def _(v):
    n = v("v_nodes")
    two = n.filter("node_type = 'party'").groupBy("document_id").agg(F.min("node_label").alias("_p"), F.max("node_label").alias("_q"))
    refs = n.filter("node_type = 'evidence'").groupBy("document_id").agg(F.array(F.min("node_label")).alias("evidence_references"))
    names = {"plaintiff": ("claim", "_p"), "defendant": ("claim", "_q"), "obligated_party": ("obligation", "_p"), "beneficiary_party": ("obligation", "_q"), "payee": ("amount", "_p"), "payer": ("amount", "_q")}
    n = n.join(two, "document_id", "left").join(refs, "document_id", "left").withColumn("confidence", F.lit(0.8))
    for name, (kind, source) in names.items():
        n = n.withColumn(name, F.when(F.col("node_type") == kind, F.col(source)))
    return G.document_edges(n, v("v_docs"))


_CE = """WITH d AS (SELECT document_id, case_id, replace(document_type, 'Pleading - ', '') AS t FROM v_docs WHERE case_id IS NOT NULL),
 n AS (SELECT v.*, case_id, t, CAST(floor(section_id / 10) AS BIGINT) AS party, CASE section_id % 4 WHEN 0 THEN 'argument' WHEN 1 THEN 'holding' WHEN 2 THEN 'admissions_denials' END AS lab, regexp_extract(node_label, '\\S+$') AS canon FROM v_nodes v JOIN d USING (document_id)),
 p AS (SELECT DISTINCT document_id, section_id, canon FROM n WHERE node_type = 'party')
SELECT DISTINCT o.node_id AS src, c.node_id AS dst, 'breached_by' AS edge_type, 0.7 AS confidence FROM n o JOIN n c USING (case_id, party) WHERE o.node_type = 'obligation' AND starts_with(o.t, 'Contract') AND c.node_type = 'claim' AND c.t = 'Complaint' AND contains(c.node_label, 'URGENT')
UNION ALL SELECT DISTINCT a.node_id, h.node_id, 'challenges', 0.7 FROM n a JOIN p x USING (document_id, section_id) JOIN p y ON x.canon = y.canon JOIN n h ON h.document_id = y.document_id AND h.section_id = y.section_id AND h.case_id = a.case_id WHERE a.node_type = 'claim' AND a.t = 'Motion' AND a.lab = 'argument' AND h.node_type = 'claim' AND h.t = 'Court - Order' AND h.lab = 'holding'
UNION ALL SELECT DISTINCT a.node_id, c.node_id, 'responds_to', 0.7 FROM n a JOIN n c USING (case_id, party) WHERE a.node_type = 'claim' AND a.t = 'Answer' AND a.lab = 'admissions_denials' AND c.node_type = 'claim' AND c.t = 'Complaint'"""


@query("cross_edges", _CE)
def _(v):
    n = v("v_nodes").withColumn("party", F.expr("CAST(CAST(floor(section_id / 10) AS bigint) AS string)")).withColumn("opponent", F.lit(None).cast("string")).withColumn("canonical_id", F.regexp_extract("node_label", r"\S+$", 0))
    n = n.withColumn("node_label", F.expr("CASE WHEN node_type = 'claim' AND contains(node_label, 'URGENT') THEN 'Breach ' || node_label ELSE node_label END"))
    docs = v("v_docs").select("document_id", "case_id", F.expr("replace(document_type, 'Pleading - ', '')").alias("document_type"))
    labels = n.select("section_id").distinct().withColumn("semantic_label", F.expr("CASE section_id % 4 WHEN 0 THEN 'argument' WHEN 1 THEN 'holding' WHEN 2 THEN 'admissions_denials' END"))
    return G.cross_edges(n, docs, labels)


@query("exhibit_links", "WITH d AS (SELECT document_id, case_id, file_name FROM v_docs), x AS (SELECT case_id, min(document_id) AS x FROM d WHERE contains(file_name, '_exhibit_') AND case_id IS NOT NULL GROUP BY 1), e AS (SELECT n.node_id, d.case_id FROM v_nodes n JOIN v_docs d USING (document_id) WHERE node_type = 'evidence' AND starts_with(d.document_type, 'Pleading') OR node_type = 'evidence' AND contains(d.document_type, 'Subpoena')), t AS (SELECT document_id, node_id AS dst FROM v_nodes WHERE node_type IN ('party', 'obligation') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY node_type <> 'party', node_id) <= 10) SELECT e.node_id AS src, t.dst, 'exhibit_of' AS edge_type, 0.85 AS confidence FROM e JOIN x USING (case_id) JOIN t ON t.document_id = x.x")
def _(v):
    n = v("v_nodes").withColumn("node_label", F.expr("CASE WHEN node_type = 'evidence' THEN 'Exhibit A' ELSE node_label END"))
    return G.exhibit_links(n, v("v_docs"))


@query("task_order", "SELECT p_partkey AS task, row_number() OVER (ORDER BY CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 3 END, p_partkey % 2, p_partkey % 3, p_partkey) AS rank FROM part")
def _(v):
    t = v("part").selectExpr("CAST(p_partkey AS bigint) AS task", "p_partkey % 2 AS tier", "p_partkey % 3 AS layer", "p_partkey AS position")
    d = t.filter("task % 7 IN (1, 2)").selectExpr("task", "task - task % 7 AS needs").unionByName(t.filter("task % 7 >= 3").selectExpr("task", "task - 2 AS needs"))
    return G.task_order(t, G.topo_levels(t.select("task"), d)).select("task", "rank")


@query("detect_claim_addons", "SELECT DISTINCT d.case_id, template FROM v_nodes n JOIN v_docs d USING (document_id) JOIN (VALUES ('urgent', 'emergency_pack'), ('low', 'routine_pack')) r(keyword, template) ON contains(lower(n.node_label), keyword) WHERE n.node_type = 'claim' AND case_id IS NOT NULL")
def _(v):
    rules = v.spark.createDataFrame([("urgent", "emergency_pack", True), ("low", "routine_pack", True)], "keyword string, template string, built boolean")
    claims = v("v_nodes").filter("node_type = 'claim'").join(v("v_docs").select("document_id", "case_id"), "document_id").select("case_id", F.col("node_label").alias("label"))
    return G.detect_addons(v("v_docs").withColumn("document_type", F.lit("")), rules, claims)
