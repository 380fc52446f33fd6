"""Search as a table function of SQL: ``SELECT * FROM hybrid_search(array(...), 'words')``.

The function's body is SQL over a table of embedded sections, so that a call is planned as a part of its query: no Python, and filters
on its rows meet the rest of the plan. Its rows are those of ``retrieval.hybrid_search``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_TRIGRAMS = """array_distinct(flatten(transform(filter(split(regexp_replace(lower({s}), '[^a-z0-9]+', ' '), ' '), w -> w <> ''),
 w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"""

_DOT = "aggregate(zip_with({a}, {b}, (s, t) -> s * t), CAST(0 AS DOUBLE), (acc, v) -> acc + v)"


def register_search(spark: SparkSession, table: str, name: str = "hybrid_search") -> None:
    """Make ``name(qvec, qtext, hits, weight, threshold)`` a temporary function of the session over ``table`` (section_id, embedding, search_text).

    It returns section_id, semantic_score, keyword_score, score and rank: the best 3 x hits sections by cosine, from ``threshold`` on, and their
    keyword score by trigrams where it is among the best 3 x hits keyword scores of 0.3 or more; weight * semantic + (1 - weight) * keyword ranks them, ties by section_id.
    A null or zero vector finds nothing, an empty text has no keyword scores.
    """
    x, q = "CAST(embedding AS ARRAY<DOUBLE>)", f"{name}.qvec"
    cosine = f"{_DOT.format(a=x, b=q)} / nullif(sqrt({_DOT.format(a=x, b=x)}) * sqrt({_DOT.format(a=q, b=q)}), CAST(0 AS DOUBLE))"
    alike = "transform(array(struct({a} AS a, {b} AS b)), p -> transform(array(size(array_intersect(p.a, p.b))), n -> CASE WHEN size(p.a) + size(p.b) = 0 THEN 0D ELSE n / (size(p.a) + size(p.b) - n) END)[0])"
    alike = alike.format(a=_TRIGRAMS.format(s="search_text"), b=_TRIGRAMS.format(s=f"{name}.qtext"))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(qvec ARRAY<DOUBLE>, qtext STRING, hits INT DEFAULT 10, weight DOUBLE DEFAULT 0.7, threshold DOUBLE DEFAULT 0.3)
RETURNS TABLE (section_id BIGINT, semantic_score DOUBLE, keyword_score DOUBLE, score DOUBLE, rank INT)
RETURN WITH sem AS (SELECT section_id, s, row_number() OVER (ORDER BY s DESC, section_id) AS n FROM (SELECT section_id, {cosine} AS s FROM {table}) WHERE s >= {name}.threshold),
 kw AS (SELECT section_id, k, row_number() OVER (ORDER BY k DESC, section_id) AS n FROM (SELECT section_id, explode(filter({alike}, v -> v >= 0.3)) AS k FROM {table})),
 hit AS (SELECT sem.section_id, round(s, 4) AS semantic_score, round(coalesce(k, 0D), 4) AS keyword_score, round({name}.weight * s + (1 - {name}.weight) * coalesce(k, 0D), 4) AS score
  FROM (SELECT * FROM sem WHERE n <= 3 * {name}.hits) sem LEFT JOIN (SELECT * FROM kw WHERE n <= 3 * {name}.hits) kw ON sem.section_id = kw.section_id)
 SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, section_id) AS rank FROM hit) WHERE rank <= {name}.hits""")
