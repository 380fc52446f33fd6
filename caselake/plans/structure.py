"""Queries over document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import bodies as B
from caselake.operators import graph as G
from caselake.operators import structure as D
from caselake.plans.registry import query

_PAGED = "SELECT document_id, pos, CASE WHEN pos % 6 = 0 THEN '## Page ' || CAST(CAST(floor(pos / 6) AS BIGINT) + 1 AS STRING) WHEN pos % 6 = 1 THEN 'Case No. ' || CAST(document_id AS STRING) || ' page ' || CAST(CAST(floor(pos / 6) AS BIGINT) + 1 AS STRING) WHEN pos % 6 = 5 THEN '- ' || CAST(CAST(floor(pos / 6) AS BIGINT) + 1 AS STRING) || ' -' WHEN pos % 18 = 3 THEN 'EXHIBIT ' || chr(65 + CAST(document_id % 5 AS INT)) ELSE line END AS line FROM v_lines"
_PL = f"SELECT document_id, pos, CAST(floor(pos / 6) AS BIGINT) + 1 AS page, pos % 6 - 1 AS line_no, line FROM ({_PAGED}) WHERE pos % 6 <> 0"


def paged(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return v.spark.sql(_PAGED)


def page_lines(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return v.spark.sql(_PL)


@query("split_pages", f"SELECT document_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({_PL}) GROUP BY 1, 2")
def _(v):
    return D.split_pages(paged(v)).withColumn("page", F.col("page").cast("bigint"))


_NORM = "regexp_replace(lower(trim(line)), '\\d+', '#', 'g')"
_REP = f"WITH pl AS ({_PL}), tot AS (SELECT document_id, count(DISTINCT page) AS total FROM pl GROUP BY 1 HAVING count(DISTINCT page) >= 3), fr AS (SELECT document_id, {_NORM} AS norm, count(DISTINCT page) AS pages FROM pl WHERE length(line) <= 150 AND trim(line) <> '' GROUP BY 1, 2), rep AS (SELECT document_id, norm, pages FROM fr JOIN tot USING (document_id) WHERE pages >= ceil(total * 0.8))"


@query("repeated_lines", f"{_REP} SELECT * FROM rep")
def _(v):
    return D.repeated_lines(page_lines(v))


def _without(lines: str) -> str:
    """SQL: lines without what repeats by text, then by place."""
    rep = _REP.replace(_PL, lines)
    one = f"SELECT document_id, pos, page, line FROM pl WHERE NOT regexp_matches(trim(line), '^-?\\s*\\d{{1,4}}\\s*-?$') AND NOT EXISTS (SELECT 1 FROM rep r WHERE r.document_id = pl.document_id AND r.norm = {_NORM})"
    first = "SELECT *, min(CASE WHEN line <> '' THEN pos END) OVER (PARTITION BY document_id, page) AS first FROM one"
    return f"{rep}, one AS ({one}), two AS (SELECT *, sum(CASE WHEN pos >= first THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY pos) AS k, trim(line) AS t FROM ({first})), pages AS (SELECT document_id, count(DISTINCT page) AS total FROM pl GROUP BY 1), often AS (SELECT document_id, k, t FROM two JOIN pages USING (document_id) WHERE k IN (1, 2) AND t <> '' GROUP BY 1, 2, 3, total HAVING count(DISTINCT page) >= greatest(3, ceil(total * 0.8))) SELECT document_id, pos, page, line FROM two WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.document_id = two.document_id AND o.k = two.k AND o.t = two.t)"


@query("remove_repeated", _without(_PL))
def _(v):
    return D.remove_repeated_lines(page_lines(v)).select("document_id", "pos", "page", "line")


#: Pages with a head too long to be sought by its text, and a second line that stands on most pages of some documents; a page in five starts with an empty line.
_HEADED = "SELECT document_id, pos, CAST(floor(pos / 5) AS BIGINT) AS page, CASE WHEN pos % 5 = 0 AND floor(pos / 5) % 5 = 4 THEN '' WHEN pos % 5 = 0 OR pos % 5 = 1 AND floor(pos / 5) % 5 = 4 THEN repeat('Running title of ' || CAST(document_id AS STRING) || ', ', 9) WHEN pos % 5 = 1 AND (document_id % 2 = 0 OR floor(pos / 5) % 2 = 0) THEN repeat(' Confidential ', 12) ELSE line END AS line FROM v_lines"


@query("remove_by_place", _without(_HEADED))
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return D.remove_repeated_lines(v.spark.sql(_HEADED)).select("document_id", "pos", "page", "line")


#: Texts behind outlines of four kinds, or behind none.
_TOC = "SELECT document_id, CASE document_id % 6 WHEN 0 THEN '## Table of  Contents' || chr(10) WHEN 1 THEN repeat('Chapter of it ..... 12' || chr(10), 4) WHEN 2 THEN repeat('Chapter of it      12' || chr(10), 5) WHEN 3 THEN repeat('Section 1.1 Scope of it 6' || chr(10), 4) WHEN 4 THEN repeat('Chapter of it ..... 12' || chr(10), 3) || repeat('Total sum of $     12' || chr(10), 9) || repeat('IV. Of the scope 7' || chr(10), 3) ELSE '' END || text AS text FROM v_docs WHERE text IS NOT NULL"


@query("detect_toc", f"WITH t AS ({_TOC}), l AS (SELECT document_id, count(*) FILTER (regexp_matches(line, '^.{{5,100}}?\\s{{3,}}\\d{{1,4}}\\s*$') AND NOT regexp_matches(line, '^\\s*[\\d.]+\\s*$') AND NOT regexp_matches(line, '[$%]')) AS spaced FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY 1), s AS (SELECT document_id, regexp_matches(text, '(?im)^#{{0,4}}\\s*(table\\s+of\\s+contents|contents|index)\\s*$') AS header, len(regexp_extract_all(text, '(?m)^.{{5,120}}?(?:\\.{{3,}})\\s*\\d{{1,4}}\\s*$')) AS leaders, len(regexp_extract_all(text, '(?im)^(?:article|section|clause|exhibit|\\d+\\.\\d+|[IVX]+\\.?)\\s+.{{5,100}}?\\s+\\d{{1,4}}\\s*$')) AS numbered FROM t) SELECT document_id, header, leaders, spaced, numbered, header OR leaders >= 4 OR spaced >= 5 OR numbered >= 4 AS has_toc FROM s JOIN l USING (document_id)")
def _(v):
    v("v_docs").createOrReplaceTempView("v_docs")
    return D.detect_toc(v.spark.sql(_TOC))


_FORMS = f"SELECT document_id, page, CASE WHEN document_id % 7 = 0 AND page = 2 AND line_no = 3 THEN '  ' || chr(9746) || ' yes' WHEN document_id % 7 = 1 AND page = 11 THEN chr(9744) WHEN document_id % 3 = 0 AND line_no > 0 THEN '' ELSE line END AS line FROM ({_PL})"


@query("form_pages", f"SELECT document_id, has_boxes, coalesce(short / nullif(n, 0), 0.0) AS short_share, coalesce(short / nullif(n, 0), 0.0) >= 0.55 AS form_like FROM (SELECT document_id, bool_or(contains(line, chr(9746)) OR contains(line, chr(9744))) AS has_boxes, count(*) FILTER (l <> '') AS n, count(*) FILTER (l <> '' AND length(l) < 40) AS short FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS l FROM ({_FORMS})) WHERE page <= 10 GROUP BY 1)")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return D.form_signals(v.spark.sql(_FORMS.replace("chr(9746)", "'\u2612'").replace("chr(9744)", "'\u2610'")))


@query("parse_toc", "SELECT document_id, pos, CAST(0 AS INTEGER) AS part, CAST(pos % 3 AS INTEGER) AS level, trim(line) AS title, CAST(pos + 1 AS INTEGER) AS page FROM v_lines WHERE NOT contains(line, '..') AND trim(line) <> '' UNION ALL SELECT document_id, pos, 1, 0, 'Next', 9 FROM v_lines WHERE pos % 4 = 0 AND NOT contains(line, '..') AND trim(line) <> ''")
def _(v):
    lines = v("v_lines").filter("NOT contains(line, '..') AND trim(line) <> ''").withColumn("line", F.expr("repeat('  ', CAST(pos % 3 AS int)) || trim(line) || ' ...... ' || CAST(pos + 1 AS string) || CASE WHEN pos % 4 = 0 THEN ' - Next .... 9' ELSE '' END"))
    return D.parse_toc(lines)


@query("renumber_pages", f"SELECT document_id, page - document_id % 3 AS page, text FROM (SELECT document_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({_PL}) GROUP BY 1, 2) WHERE page - document_id % 3 >= 1")
def _(v):
    pages = D.split_pages(paged(v)).withColumn("page", F.col("page").cast("bigint"))
    return D.renumber(pages, v("v_lines").select("document_id").distinct().withColumn("page_offset", F.col("document_id") % 3))


@query("calibrate_offset")
def _(v):
    pl = page_lines(v)
    entries = pl.filter("line_no = 2 AND length(line) > 10").select("document_id", "pos", F.col("line").alias("title"), (F.col("page") - F.col("document_id") % 3).alias("page"))
    outlines = pl.filter("document_id % 5 = 0").select("document_id").distinct().withColumn("last_page", F.lit(2))
    return D.calibrate_offset(entries, pl, outlines)


_HEADS = "SELECT document_id, pos, CASE pos % 9 WHEN 0 THEN 'ARTICLE IV' WHEN 2 THEN 'A. Facts' WHEN 4 THEN '1.2 Terms' WHEN 6 THEN '(a) item' ELSE 'x ' || line END AS line FROM v_lines"


@query("heading_scan", "SELECT document_id, pos, CAST(CASE pos % 9 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS INTEGER) AS level, CASE pos % 9 WHEN 0 THEN 'ARTICLE IV' WHEN 2 THEN 'A. Facts' WHEN 4 THEN '1.2 Terms' ELSE '(a) item' END AS title FROM v_lines WHERE pos % 9 IN (0, 2, 4, 6)")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return D.scan_headings(v.spark.sql(_HEADS))


@query("build_sections", f"WITH l AS ({_HEADS.replace('pos % 9 WHEN 0', '(pos + 8) % 9 WHEN 0')}), h AS (SELECT document_id, pos AS start, line AS title, CASE (pos + 8) % 9 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS level FROM l WHERE (pos + 8) % 9 IN (0, 2, 4, 6)), b AS (SELECT l.document_id, coalesce((SELECT max(start) FROM h WHERE h.document_id = l.document_id AND h.start <= l.pos), -1) AS start, pos, line FROM l WHERE (pos + 8) % 9 NOT IN (0, 2, 4, 6)), t AS (SELECT document_id, start, string_agg(line, chr(10) ORDER BY pos) AS section_text FROM b GROUP BY 1, 2) SELECT h.document_id, h.start, h.title, h.level, t.section_text FROM h LEFT JOIN t USING (document_id, start) UNION ALL SELECT document_id, start, 'Title Page', 0, section_text FROM t WHERE start = -1")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    lines = v.spark.sql(_HEADS.replace("pos % 9 WHEN 0", "(pos + 8) % 9 WHEN 0"))
    return D.build_sections(D.scan_headings(lines), lines)


@query("skeleton", "WITH n AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM v_lines) SELECT document_id, string_agg(line, chr(10) ORDER BY pos) AS skeleton FROM n WHERE length(line) <= 60 OR ((pos < n / 4 OR pos >= 3 * n / 4) AND pos % 4 = 0) GROUP BY 1")
def _(v):
    return D.skeleton(v("v_lines"))


_EX = "SELECT document_id, pos, CASE WHEN document_id % 3 = 0 AND pos % 7 = 3 THEN '## Exhibit ' || chr(65 + CAST(pos % 20 AS INT)) WHEN document_id % 3 = 1 AND pos % 7 = 3 THEN 'Exhibit ' || chr(65 + CAST(pos % 20 AS INT)) || ' follows' ELSE line END AS line FROM v_lines"


@query("exhibits_by_heading", f"WITH l AS ({_EX}), n AS (SELECT document_id, max(pos) + 1 AS n FROM l GROUP BY 1) SELECT document_id, chr(65 + CAST(pos % 20 AS INT)) AS label, pos AS start, coalesce(lead(pos) OVER (PARTITION BY document_id ORDER BY pos), n) AS stop FROM l JOIN n USING (document_id) WHERE document_id % 3 = 0 AND pos % 7 = 3")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return D.exhibits_by_heading(v.spark.sql(_EX))


@query("exhibits_by_label", f"WITH l AS ({_EX}), n AS (SELECT document_id, max(pos) + 1 AS n FROM l GROUP BY 1), h AS (SELECT document_id, chr(65 + CAST(pos % 20 AS INT)) AS label, min(pos) AS start FROM l WHERE document_id % 3 < 2 AND pos % 7 = 3 AND pos % 20 IN (3, 17) GROUP BY 1, 2) SELECT document_id, label, start, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start), n) AS stop FROM h JOIN n USING (document_id)")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    lines = v.spark.sql(_EX)
    labels = lines.select("document_id").distinct().withColumn("label", F.explode(F.array(F.lit("D"), F.lit("R"))))
    return D.exhibits_by_label(lines, labels)


@query("exhibit_cascade", f"WITH l AS ({_EX}), n AS (SELECT document_id, max(pos) + 1 AS n FROM l GROUP BY 1) SELECT document_id, chr(65 + CAST(pos % 20 AS INT)) AS label, pos AS start, coalesce(lead(pos) OVER (PARTITION BY document_id ORDER BY pos), n) AS stop, CAST(document_id % 3 AS INTEGER) AS way FROM l JOIN n USING (document_id) WHERE (document_id % 3 = 0 AND pos % 7 = 3) OR (document_id % 3 = 1 AND pos = 3)")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    lines = v.spark.sql(_EX)
    return D.split_exhibits(lines, lines.select("document_id").distinct().withColumn("label", F.lit("D")))


_SCAN = "SELECT document_id, pos, CASE WHEN pos % 10 = 0 THEN '[Page ' || CAST(CAST(floor(pos / 10) AS BIGINT) + 1 AS STRING) || ']' WHEN document_id % 2 = 0 AND pos % 10 = 2 THEN 'Exhibit ' || chr(65 + CAST(floor(pos / 10) AS INT) % 26) WHEN document_id % 2 = 1 AND pos % 10 = 6 THEN 'Exhibit Z' ELSE 'x ' || line END AS line FROM v_lines"


@query("exhibits_by_scan", f"WITH l AS ({_SCAN}), n AS (SELECT document_id, max(pos) + 1 AS n FROM l GROUP BY 1), h AS (SELECT document_id, chr(65 + CAST(floor(pos / 10) AS INT) % 26) AS label, min(pos) AS start FROM l WHERE document_id % 2 = 0 AND pos % 10 = 2 GROUP BY 1, 2) SELECT document_id, label, start, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start), n) AS stop FROM h JOIN n USING (document_id)")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return D.exhibits_by_scan(v.spark.sql(_SCAN))


#: Pages with an exhibit's start on every third, a list of schedules on the fourth of some documents, and sections of which the last one runs to the end.
_XP = f"SELECT document_id, pos, page, line_no, CASE WHEN page = 4 AND document_id % 4 = 1 THEN 'Schedule ' || CAST(pos AS STRING) ELSE line END AS line FROM ({_PL})"
_XS = f"""SELECT document_id, pos, CASE pos WHEN 2 THEN 'TOC' ELSE repeat('@', 20) END AS section_title, CASE WHEN pos < 2 THEN 'as it was' WHEN document_id % 2 = 0 THEN 'Intro, Exhibit A' ELSE 'Intro' END AS section_text,
 CASE pos WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN least(CAST(2 AS BIGINT), total) END AS start_page, CASE pos WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN total END AS end_page
 FROM (SELECT document_id, max(page) AS total FROM ({_XP}) GROUP BY document_id) JOIN (VALUES (0), (1), (2)) p(pos) ON true"""
_XT = f"""WITH pl AS ({_XP}), t AS (SELECT document_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM pl GROUP BY 1, 2), tot AS (SELECT document_id, max(page) AS total FROM pl GROUP BY 1),
 st AS (SELECT t.document_id, min(page) AS exhibit_page FROM t JOIN tot USING (document_id) WHERE len(regexp_extract_all(text, '(?im)^(?:exhibit|attachment|schedule|appendix)\\s*[A-Z0-9]')) BETWEEN 1 AND 2 AND page >= CASE WHEN document_id % 2 = 0 THEN 1 ELSE greatest(1, total // 2) END GROUP BY 1),
 x AS (SELECT document_id, exhibit_page, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page), '\\A\\s+|\\s+\\z', '', 'g') AS exhibit_text FROM t JOIN st USING (document_id) WHERE page >= exhibit_page GROUP BY 1, 2)"""


def _exhibit_pages(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return v.spark.sql(_XS), v.spark.sql(_XP)


@query("exhibit_start", f"{_XT} SELECT * FROM st")
def _(v):
    sections, lines = _exhibit_pages(v)
    return D.exhibit_start(lines, sections)


@query("exhibit_pages", f"{_XT} SELECT * FROM x WHERE exhibit_text <> ''")
def _(v):
    return B.split_off_exhibits(*_exhibit_pages(v))[1]


@query("trim_last_section", f"""{_XT}, s AS ({_XS}), c AS (SELECT s.*, exhibit_page, coalesce(s.pos = 1 AND end_page >= exhibit_page, false) AS cut FROM s LEFT JOIN x USING (document_id)),
 b AS (SELECT c.document_id, regexp_replace(string_agg(line, chr(10) ORDER BY pl.page, line_no), '\\A\\s+|\\s+\\z', '', 'g') AS body FROM c JOIN pl ON pl.document_id = c.document_id AND pl.page BETWEEN c.start_page AND exhibit_page - 1 WHERE cut GROUP BY 1)
 SELECT document_id, pos, section_title, CASE WHEN cut THEN coalesce(body, '') ELSE section_text END AS section_text, start_page, CASE WHEN cut THEN exhibit_page - 1 ELSE end_page END AS end_page FROM c LEFT JOIN b USING (document_id) WHERE NOT cut OR start_page < exhibit_page""")
def _(v):
    return B.split_off_exhibits(*_exhibit_pages(v))[0]


@query("render_document", "SELECT document_id, string_agg(repeat('  ', CAST(level AS INTEGER)) || section_title || ': ' || substring(section_text, 1, 30), chr(10) ORDER BY pos) AS rendered FROM v_sections GROUP BY 1")
def _(v):
    return D.render(v("v_sections"))


@query("heading_hints", "SELECT document_id, array_to_string(list_slice(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[A-Z][A-Z !]{4,60}$') OR regexp_matches(trim(x), '^\\d+\\. ')), 1, 30), '|') AS hints FROM v_docs")
def _(v):
    hints = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x).rlike("^[A-Z][A-Z !]{4,60}$") | F.trim(x).rlike(r"^\d+\. ")), 1, 30)
    return v("v_docs").select("document_id", F.array_join(hints, "|").alias("hints"))


@query("label_sections", "WITH r(place, pattern, label, rank) AS (VALUES ('title', 'the and', 'boiler', 1), ('title', 'licensed', 'license', 2), ('body', 'that', 'facts', 1), ('body', 'der', 'german', 2)), m AS (SELECT s.section_id, min(row(place <> 'title', rank, label)) AS m FROM v_sections s JOIN r ON contains(CASE WHEN place = 'title' THEN lower(section_title) ELSE lower(substring(section_text, 1, 500)) END, pattern) GROUP BY 1) SELECT s.section_id, coalesce(struct_extract_at(m.m, 3), 'unrecognized') AS label, CASE WHEN m.m IS NULL THEN 0.0 WHEN struct_extract_at(m.m, 1) THEN 0.9 ELSE 1.0 END AS label_confidence FROM v_sections s LEFT JOIN m USING (section_id)")
def _(v):
    rules = v.spark.createDataFrame([("title", "the and", "boiler", 1), ("title", "licensed", "license", 2), ("body", "that", "facts", 1), ("body", "der", "german", 2)], "place string, pattern string, label string, rank int")
    return D.label_sections(v("v_sections"), rules)


@query("merge_lines")
def _(v):
    return D.merge_lines(v("v_lines"))


@query("drop_subtrees")
def _(v):
    e = v("v_sections").select("document_id", "pos", "level", F.expr("CASE WHEN pos % 5 = 1 THEN 'Exhibit ' || section_title ELSE section_title END AS title"))
    return D.drop_subtrees(e)


_ANCHORS = "SELECT document_id AS section_id, n AS ord, 'Part ' || CAST(n AS STRING) AS title, CASE n % 4 WHEN 0 THEN substring(text, CAST(floor(length(text) * n / 20) AS INT) + 1, 90) WHEN 1 THEN substring(text, CAST(floor(length(text) * n / 20) AS INT) + 1, 42) || '#####' WHEN 2 THEN 'an anchor that stands nowhere' ELSE substring(text, CAST(floor(length(text) * n / 20) AS INT) + 1, 12) END AS anchor FROM v_docs JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17)) k(n) ON true WHERE text IS NOT NULL"
_STRIP = "regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"
_PREFIX = _STRIP.format(x="substring(anchor, 1, n)")
_CUT = f"""WITH RECURSIVE a AS ({_ANCHORS}), d AS (SELECT document_id AS section_id, text FROM v_docs WHERE text IS NOT NULL),
 r(section_id, ord, cut) AS (SELECT section_id, -1, -1 FROM d UNION ALL
  SELECT r.section_id, a.ord, CAST(coalesce(CASE WHEN anchor <> '' THEN nullif(strpos(substring(text, cut + 2), anchor), 0) + cut END,
   CASE WHEN length(anchor) >= 20 THEN list_filter(list_transform(range(least(length(anchor), 70), 19, -5), lambda n: CASE WHEN {_PREFIX} <> '' THEN strpos(substring(text, cut + 2), {_PREFIX}) ELSE 0 END), lambda p: p > 0)[1] + cut END, cut + 1) AS INTEGER)
  FROM r JOIN a ON a.section_id = r.section_id AND a.ord = r.ord + 1 JOIN d ON d.section_id = r.section_id WHERE a.ord < 15),
 c AS (SELECT section_id, ord, cut AS start, coalesce(lead(cut) OVER (PARTITION BY section_id ORDER BY ord), length(text)) AS stop, text FROM r JOIN d USING (section_id) WHERE ord >= 0),
 s AS (SELECT section_id, ord, start, stop, length(text) AS n, {_STRIP.format(x="substring(text, start + 1, greatest(stop - start, 0))")} AS piece FROM c),
 p AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY ord) - 1 AS part FROM s WHERE length(piece) >= 300),
 q AS (SELECT section_id, part, 'Part ' || CAST(ord AS VARCHAR) AS title, start, stop, CAST(round_even(1 + start / n * 8 + part * 0.01::DOUBLE, 0) AS INTEGER) AS start_page, CAST(round_even(1 + stop / n * 8 + part * 0.01::DOUBLE, 0) AS INTEGER) AS end_page, piece FROM p)"""


def _anchored(v):
    v("v_docs").createOrReplaceTempView("v_docs")
    sections = v("v_docs").selectExpr("document_id", "document_id AS section_id", "'Whole' AS section_title", "text AS section_text", "0 AS level", "1 AS start_page", "9 AS end_page")
    return sections, v.spark.sql(_ANCHORS)


@query("split_at_anchors", f"{_CUT} SELECT section_id, part, title, 1 AS level, start, stop, start_page, end_page, piece AS text FROM q")
def _(v):
    return D.split_at_anchors(*_anchored(v))


@query("refine_sections", f"{_CUT}, n AS (SELECT section_id, count(*) AS pieces FROM q GROUP BY 1) SELECT document_id, document_id AS section_id, 'Whole' AS section_title, CASE WHEN pieces IS NULL THEN text ELSE '[Split into ' || CAST(pieces AS VARCHAR) || ' sub-sections]' END AS section_text, 0 AS level, 1 AS start_page, 9 AS end_page, NULL::INTEGER AS part FROM v_docs LEFT JOIN n ON section_id = document_id UNION ALL SELECT section_id, section_id, title, piece, 1, start_page, end_page, part FROM q")
def _(v):
    return B.refine_sections(*_anchored(v))


#: Lines of all styles, each with its level by three lists of styles.
_STYLES = (("I.", "A.", "1."), ("(a)", "(i)", "1.1", "1.1.1", "Section", "Part", "Article", "Chapter"), ("1)", "a)", "A)", "(A)", "a.", "A.", "(i)", "unknown"))
_STYLED = (
    ("II. Facts", 1, None, None), ("I. Facts", 1, None, 2), ("12. Terms", 1, None, None), ("b. more", None, None, 3), ("3) next", None, None, 2), ("b) next", None, None, 3),
    ("B) Next", None, None, 2), ("(i) next", None, 3, 3), ("(iv) next", None, 3, 3), ("(B) next", None, None, 2), ("1.2 Terms", None, 2, None), ("1.2.3 Terms", None, 2, None),
    ("Section 4 Terms", None, 1, None), ("Section 4.2 Terms", None, None, None), ("Part IV", None, 1, None), ("Article 2", None, 1, None), ("Chapter X", None, 1, None), ("A. Facts", 2, None, 2),
)
_LEVELS = " ".join(f"WHEN {k * 3 + j} THEN {x[j + 1]}" for k, x in enumerate(_STYLED) for j in range(3) if x[j + 1] is not None)
_TITLES = " ".join(f"WHEN {k} THEN '{x[0]}'" for k, x in enumerate(_STYLED))


@query("heading_styles", f"SELECT document_id, pos, CAST(CASE (pos % 20) * 3 + document_id % 3 {_LEVELS} END AS INTEGER) AS level, CASE pos % 20 {_TITLES} END AS title FROM v_lines WHERE CASE (pos % 20) * 3 + document_id % 3 {_LEVELS} END IS NOT NULL")
def _(v):
    lines = v("v_lines").withColumn("line", F.expr(f"CASE pos % 20 {_TITLES} ELSE 'x ' || line END"))
    lists = F.array(*[F.array(*map(F.lit, s)) for s in _STYLES])
    return D.scan_headings(lines, lines.select("document_id").distinct().withColumn("styles", F.get(lists, (F.col("document_id") % 3).cast("int"))))


@query("scan_pages", "SELECT page_id, url, length(html) AS n FROM pages WHERE contains(html, '<h1')")
def _(v):
    return v("pages").filter(F.contains("html", F.lit("<h1"))).select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("html_text")
def _(v):
    return D.html_text(G.kept(D.html_elements(v("pages"))))


@query("html_headings")
def _(v):
    return D.html_outline(G.kept(D.html_elements(v("pages"))))


@query("html_sections")
def _(v):
    return D.html_sections(G.kept(D.html_elements(v("pages"))))


@query("html_tables", "WITH c AS (SELECT page_id, k, unnest(range(1, 4)) AS row_no FROM (SELECT page_id, length(html) AS k FROM pages)) SELECT page_id, 1::BIGINT AS table_no, row_no, CASE row_no WHEN 1 THEN 'name|size' WHEN 2 THEN 'page ' || CAST(page_id AS VARCHAR) || '||' || CAST(k AS VARCHAR) ELSE 'a b' END AS line FROM c")
def _(v):
    """A table of each page beside what the page holds: heads, a row with an empty cell, and a cell of two blocks."""
    made = F.concat(F.lit("<table><thead><tr><th>name<th>size</tr></thead><tr><td>page "), F.col("page_id").cast("string"), F.lit("</td><td></td><td>"), F.length("html").cast("string"), F.lit("</td></tr><tr><td><p>a<p>b</table>"))
    pages = v("pages").select("page_id", F.concat(made, F.regexp_replace("html", "(?i)<(/?)(table|td|th|tr)\\b", "<$1div")).alias("html"))
    return D.html_tables(D.html_elements(pages)).select("page_id", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", "|").alias("line"))


#: Lines with an outline at the front of two documents in three: a heading, a column's name, entries among blanks and other lines.
_OUTLINED = "SELECT document_id, pos, CASE WHEN pos = 1 AND document_id % 3 <> 0 THEN '  Table of Contents ' WHEN pos = 2 THEN 'Page' WHEN pos BETWEEN 3 AND 40 AND (pos * 7 + document_id) % 11 < 4 THEN substring(line, 1, 20) || CASE WHEN pos % 2 = 0 THEN ' .... ' ELSE '    ' END || CAST(pos AS STRING) WHEN pos BETWEEN 3 AND 40 AND (pos * 5 + document_id) % 23 <> 0 THEN CASE WHEN pos % 3 = 0 THEN '  ' ELSE '' END ELSE line END AS line FROM v_lines"


@query("toc_region", f"WITH l AS (SELECT document_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t, regexp_matches(line, '{D.OUTLINE_HEAD}') AS h FROM ({_OUTLINED})), e AS (SELECT *, regexp_matches(t, '{D.OUTLINE_LINE}') AS e, min(CASE WHEN h THEN pos END) OVER (PARTITION BY document_id) AS head FROM l), f AS (SELECT *, min(CASE WHEN e AND pos > head THEN pos END) OVER (PARTITION BY document_id) AS first FROM e WHERE pos >= head), s AS (SELECT a.document_id, min(a.pos) AS stop FROM f a WHERE a.pos > a.first AND NOT a.e AND (a.t <> '' OR a.pos - (SELECT max(b.pos) FROM f b WHERE b.document_id = a.document_id AND b.e AND b.pos < a.pos) > 3) GROUP BY 1) SELECT document_id, string_agg(t, chr(10) ORDER BY pos) AS region FROM f LEFT JOIN s USING (document_id) WHERE first IS NOT NULL AND (pos = head OR pos < first AND t <> '' OR e AND pos >= first AND (stop IS NULL OR pos < stop)) GROUP BY 1")
def _(v):
    v("v_lines").createOrReplaceTempView("v_lines")
    return D.toc_region(v.spark.sql(_OUTLINED))


@query("section_text")
def _(v):
    """Bodies of entries titled by the third line of every other page; compared by brute force in the tests."""
    pl = page_lines(v)
    entries = pl.filter("line_no = 2 AND page % 2 = 1 AND trim(line) <> ''").select("document_id", "pos", F.col("line").alias("title"), F.col("page").alias("start_page"), (F.col("page") + 1).alias("end_page"))
    return B.section_text(entries, pl)


@query("section_text_by_pos", "WITH t AS (SELECT document_id, string_agg(CASE WHEN pos % 4 = 0 THEN 'Part ' || CAST(pos AS VARCHAR) || '.' ELSE line END, chr(10) ORDER BY pos) AS text FROM v_lines GROUP BY 1), e AS (SELECT document_id, pos, 'PART ' || CAST(pos AS VARCHAR) || '.' AS title FROM v_lines WHERE pos % 4 = 0), a AS (SELECT document_id, pos, text, strpos(lower(text), lower(title)) AS place FROM e JOIN t USING (document_id)), n AS (SELECT *, lead(place) OVER (PARTITION BY document_id ORDER BY pos) AS stop FROM a) SELECT document_id, pos, regexp_replace(CASE WHEN stop IS NULL THEN substring(text, place) ELSE substring(text, place, stop - place) END, '^\\s+|\\s+$', '', 'g') AS section_text FROM n")
def _(v):
    docs = D.ordered_text(v("v_lines").withColumn("line", F.expr("CASE WHEN pos % 4 = 0 THEN 'Part ' || CAST(pos AS string) || '.' ELSE line END")), ["document_id"], "pos", "line", "text")
    entries = v("v_lines").filter("pos % 4 = 0").select("document_id", "pos", F.expr("'PART ' || CAST(pos AS string) || '.'").alias("title"))
    return B.section_text_by_pos(entries, docs)


@query("clean_sections", "WITH s AS (SELECT document_id, pos, row_number() OVER (PARTITION BY document_id ORDER BY pos DESC) AS back, regexp_replace(replace(section_text, chr(10), ' '), '\\s+', ' ', 'g') AS body FROM v_sections WHERE trim(section_text) <> '') SELECT document_id, pos, 'word word' || chr(10) || trim(body) || '.' || chr(10) || 'Item 2.' || CASE WHEN back > 1 THEN chr(10) || 'Exhibit B.' || repeat('x', 600) ELSE '' END AS section_text FROM s")
def _(v):
    s = v("v_sections").filter("trim(section_text) <> ''").withColumn("body", F.trim(F.regexp_replace("section_text", r"\s+", " ")))
    s = s.select("document_id", "pos", F.concat(F.lit("Title of part "), F.col("pos").cast("string")).alias("title"), F.concat(F.lit("TITLE of part "), F.col("pos").cast("string"), F.lit("\nword   word\n  "), F.lit("\n"), "body", F.lit(".\nItem 2.\nExhibit B."), F.lit("x" * 600)).alias("section_text"))
    out = B.clean_sections(s)
    return out.select("document_id", "pos", F.regexp_replace("section_text", r"\n\s+\n", "\n").alias("section_text"))


@query("exhibits_by_bookmark", f"WITH p AS (SELECT document_id, CAST(floor(pos / 6) AS BIGINT) + 1 AS page, string_agg(line, chr(10) ORDER BY pos) AS body FROM ({_PAGED}) GROUP BY 1, 2), t AS (SELECT b.document_id, b.page, string_agg(p.body, chr(10) ORDER BY p.page) AS text FROM p b JOIN p ON p.document_id = b.document_id AND p.page IN (b.page, b.page + 1) WHERE b.page % 2 = 0 GROUP BY 1, 2) SELECT document_id, CAST(page AS VARCHAR) AS label, page AS start_page, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_chars FROM t WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100")
def _(v):
    lines = paged(v)
    pages = lines.filter("pos % 6 = 0").select("document_id", F.expr("CAST(pos DIV 6 AS int) + 1").alias("page")).filter("page % 2 = 0")
    marks = pages.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), "page").withColumn("title", F.concat(F.when(F.col("ord") == 1, "Exhibit ").otherwise("Later "), F.col("page").cast("string")))
    return B.exhibits_by_bookmark(lines, marks, D.page_number("line")).select("document_id", "label", F.col("start_page").cast("bigint").alias("start_page"), F.length("text").cast("bigint").alias("n_chars"))
