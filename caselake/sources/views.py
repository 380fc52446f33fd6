"""Document-collection views over the test tables, as one SQL text for both engines.

``Views`` gives a Spark DataFrame for a view or a table; ``with_views`` puts
the views that a comparison query names in front of it as CTEs, so that the
two engines can't drift apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"

#: How many cases and documents there are: foreign keys are made from all rows, so that groups stay as large as they are when tables grow.
CASES, DOCS = "(SELECT count(*) FROM supplier)", "(SELECT max(doc_id) + 1 FROM documents)"

VIEWS: dict[str, str] = {
    "v_cases": """
SELECT s_suppkey AS case_id, CAST(floor(s_suppkey / 4) AS BIGINT) AS firm_id, s_name || ' v. ' || n_name AS case_name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'plaintiff' ELSE 'defendant' END AS party_role,
       CASE WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE s_name END AS our_client,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS opposing_party,
       CASE WHEN s_suppkey % 7 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE CAST(NULL AS TIMESTAMP) END AS deleted_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_corpora": """
SELECT s_suppkey AS corpus_id, CAST(floor(s_suppkey / 4) AS BIGINT) AS firm_id, (s_suppkey % 6 = 0) AS is_shared
FROM supplier WHERE s_suppkey % 2 = 0""",
    "v_docs": f"""
SELECT d.doc_id AS document_id,
       CASE WHEN d.doc_id % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(d.doc_id / 6) AS BIGINT) % {CASES} END AS case_id,
       CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % {CASES} - d.doc_id % {CASES} % 2 ELSE CAST(NULL AS BIGINT) END AS corpus_id,
       CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 9 ELSE CAST(NULL AS BIGINT) END AS parent_document_id,
       d.source || '_' || d.lang || CASE WHEN d.doc_id % 10 = 9 THEN '_exhibit_A' ELSE '' END AS file_name,
       CASE d.doc_id % 6 WHEN 0 THEN 'Pleading - Complaint' WHEN 1 THEN 'Contract - NDA'
            WHEN 2 THEN 'Pleading - Motion' WHEN 3 THEN 'Court - Order'
            WHEN 4 THEN 'Discovery - Subpoena' ELSE 'Pleading - Answer' END AS document_type,
       d.lang, d.text, d.n_chars, e.ts AS created_at
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "v_sections": """
SELECT document_id * 100000 + pos AS section_id, document_id, pos, (pos * 7 + document_id) % 4 AS level,
       substring(line, 1, 40) AS section_title, line AS section_text,
       CASE WHEN pos % 13 = 12 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(pos / 5) AS BIGINT) + 1 END AS start_page,
       CASE pos % 5 WHEN 0 THEN 'causes_of_action' WHEN 1 THEN 'factual_allegations'
            WHEN 2 THEN 'obligation.payment' WHEN 3 THEN 'signature_block' ELSE CAST(NULL AS STRING) END AS semantic_label
FROM v_lines""",
    "v_embeddings": f"""
SELECT v.vec_id AS section_id, v.document_id, CAST(floor(v.document_id / 6) AS BIGINT) % {CASES} AS case_id,
       v.embedding, 'L' || CAST(v.label AS STRING) AS semantic_label, v.label % 4 AS level,
       CASE v.vec_id % 3 WHEN 0 THEN 'Contract - NDA' WHEN 1 THEN 'Pleading - Complaint' ELSE 'Evidence - Exhibit' END AS document_type,
       d.text AS search_text
FROM (SELECT vec_id, embedding, label, vec_id % {DOCS} AS document_id FROM embeddings) v JOIN documents d ON d.doc_id = v.document_id""",
    "v_extractions": f"""
SELECT l_orderkey * 10 + l_linenumber AS extraction_id, l_orderkey % {DOCS} AS document_id,
       l_orderkey % {DOCS} * 100000 + l_linenumber AS section_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'court' WHEN 1 THEN 'party' WHEN 2 THEN 'judge' ELSE 'date' END AS extraction_type,
       p_name AS entity_name, p_type AS entity_value, l_discount * 10 AS confidence,
       '{{"role_in_document":"' || CASE l_returnflag WHEN 'A' THEN 'plaintiff' WHEN 'R' THEN 'defendant' ELSE 'mentioned' END || '"}}' AS properties
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "v_found": f"""
SELECT extraction_id, document_id, section_id, extraction_type, entity_value, confidence,
       CASE WHEN extraction_type = 'case_citation' AND extraction_id % 5 < 3 THEN CASE WHEN extraction_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE ' ' END
            WHEN extraction_type = 'date' AND extraction_id % 4 = 0 THEN '2020-01-01' WHEN extraction_type = 'date' AND extraction_id % 9 = 0 THEN 'Filing Date'
            WHEN extraction_type IN ('claim', 'condition') AND extraction_id % 3 = 0 THEN repeat(name || ' ', 6)
            WHEN extraction_type = 'party' THEN 'Supplier ' || CAST(supp % 20 AS STRING) || CASE extraction_id % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN '  L.P.' WHEN 2 THEN ' ' ELSE ' Company' END
            ELSE name END AS entity_name,
       CASE extraction_type
            WHEN 'party' THEN '{{"role":"' || flag || '","jurisdiction":null}}'
            WHEN 'claim' THEN '{{"plaintiff":"Supplier ' || CAST(supp % 20 AS STRING) || '","defendant":"Supplier ' || CAST(supp % 7 AS STRING) || '","evidence_references":["Exhibit A","' || mode || '"]}}'
            WHEN 'obligation' THEN '{{"obligated_party":"Supplier ' || CAST(supp % 20 AS STRING) || '","amount":12.5}}'
            WHEN 'date' THEN '{{"date_type":"' || CASE extraction_id % 7 WHEN 0 THEN 'Filing' WHEN 1 THEN 'publication_date' WHEN 2 THEN 'hearing' WHEN 3 THEN 'order of magnitude' ELSE 'meeting' END || '","is_relative":true}}'
            WHEN 'case_citation' THEN CASE extraction_id % 3 WHEN 0 THEN '{{"case_name":"' || mode || ' v. ' || flag || '","year":1998}}' WHEN 1 THEN '{{"citation":"12 F.3d ' || CAST(supp AS STRING) || '"}}' ELSE '{{"court":"High"}}' END
            WHEN 'amount' THEN CASE WHEN extraction_id % 2 = 0 THEN '{{"currency":"EUR","payer":"Supplier 3"}}' ELSE '{{"payee":"Supplier 4"}}' END
            WHEN 'condition' THEN '{{"trigger_event":"' || mode || '"}}'
            WHEN 'evidence_ref' THEN 'not json' ELSE '{{}}' END AS properties
FROM (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS extraction_id, l_orderkey % {DOCS} AS document_id, l_orderkey % {DOCS} * 100000 + l_linenumber AS section_id,
             CASE (l_orderkey * 10 + l_linenumber) % 12 WHEN 0 THEN 'court' WHEN 1 THEN 'party' WHEN 2 THEN 'judge' WHEN 3 THEN 'date' WHEN 4 THEN 'claim' WHEN 5 THEN 'cause_of_action'
                  WHEN 6 THEN 'obligation' WHEN 7 THEN 'evidence_ref' WHEN 8 THEN 'case_citation' WHEN 9 THEN 'amount' WHEN 10 THEN 'condition' ELSE 'date' END AS extraction_type,
             p_name AS name, p_type AS entity_value, min(l_discount) * 10 AS confidence, min(l_suppkey) AS supp, min(l_returnflag) AS flag, p_brand AS mode
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber, l_partkey, p_name, p_type, p_brand) AS raw""",
    "v_nodes": f"""
SELECT 'p' || CAST(p_partkey AS STRING) AS node_id, 'party' AS node_type, p_name || ' ' || p_brand AS node_label,
       p_partkey % {DOCS} AS document_id, p_partkey % 50 AS section_id, CAST(NULL AS STRING) AS date_value FROM part
UNION ALL
SELECT 'c' || CAST(o_orderkey AS STRING), 'claim', o_orderpriority || ' ' || o_orderstatus,
       o_orderkey % {DOCS}, o_orderkey % 50, CAST(NULL AS STRING) FROM orders
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), 'evidence', s_name, s_suppkey % {DOCS}, s_suppkey % 50, CAST(NULL AS STRING) FROM supplier
UNION ALL
SELECT 'o' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING), CASE WHEN max(l_returnflag) = 'R' THEN 'obligation' WHEN max(l_returnflag) = 'A' THEN 'amount' ELSE 'condition' END,
       'Item ' || CAST(min(l_partkey) AS STRING), l_orderkey % {DOCS}, l_orderkey % 50, CAST(NULL AS STRING) FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'legal_authority', n_name,
       CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) % 50, CAST(NULL AS STRING) FROM nation
UNION ALL
SELECT 'e' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 'procedural_event' ELSE 'event' END, o_orderpriority,
       o_orderkey % {DOCS}, o_orderkey % 50,
       CASE o_orderkey % 4 WHEN 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10)
            WHEN 1 THEN substring(CAST(o_orderdate AS STRING), 1, 4)
            WHEN 2 THEN 'around ' || substring(CAST(o_orderdate AS STRING), 1, 4) ELSE 'soon after' END
FROM orders""",
    "v_edges": """
SELECT DISTINCT 'c' || CAST(l_orderkey AS STRING) AS src, 's' || CAST(l_suppkey AS STRING) AS dst,
       'supported_by' AS edge_type, 1.0 - l_discount AS confidence FROM lineitem
UNION ALL
SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING), 'c' || CAST(l_orderkey AS STRING), 'breached_by', 0.95 FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING), 'n' || CAST(s_nationkey AS STRING), 'references', 0.95 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'
UNION ALL
SELECT DISTINCT 'p' || CAST(l_partkey AS STRING), 'e' || CAST(l_orderkey AS STRING), 'involved_in', 0.7 FROM lineitem""",
    "v_intake": f"""
SELECT event_id AS intake_id, CAST(floor(user_id % {CASES} / 4) AS BIGINT) AS firm_id, md5(event_type || CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS file_hash,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'processing'
            WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
       CASE event_id % 4 WHEN 0 THEN 'immediate' WHEN 1 THEN 'soon' WHEN 2 THEN 'overnight' ELSE 'manual' END AS process_priority,
       user_id AS job_id, ts AS created_at, value, props
FROM events""",
    "v_responses": f"""
SELECT conv_id AS session_id, conv_id % {CASES} AS case_id, turn, role, text, ((conv_id * 7 + turn * 13) % 101) / 100.0 AS confidence
FROM conversations""",
}

LINES_SPARK = "SELECT doc_id AS document_id, CAST(pos AS BIGINT) AS pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line"
LINES_DUCKDB = "SELECT doc_id AS document_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)"

#: The rows of v_edges before repeats are taken out, for work that gives the same with them.
VIEWS["v_edge_rows"] = VIEWS["v_edges"].replace("SELECT DISTINCT", "SELECT")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(r"\bv_\w+\b")
_TABLE = re.compile(r"\b(?:from|join)\s+(\w+)", re.I)


class Views:
    """DataFrames of the tables in ``sf_dir`` and of the views over them: ``v("v_docs")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = LINES_SPARK if name == "v_lines" else VIEWS[name]
                for used in {*_NAME.findall(sql), *(t for t in _TABLE.findall(sql) if t in TABLES)}:
                    self(used).createOrReplaceTempView(used)
                self.made[name] = self.spark.sql(sql)
        return self.made[name]


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names as CTEs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name not in order:
                body = LINES_DUCKDB if name == "v_lines" else VIEWS[name]
                need(body)
                order.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({(LINES_DUCKDB if n == 'v_lines' else VIEWS[n]).strip()})" for n in order)
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        rest = body[m.end() :]
        return f"WITH {m[1] or ''}{ctes + ', ' if ctes else ''}{rest}"
    return f"WITH {ctes} {body}" if ctes else body
