"""Bodies of outline entries: by pages, by place in the text, cleaned; and exhibits by bookmarks.

A document's lines are read once; titles are compared with lines only where their lengths can fit,
and texts aren't repeated per entry before they are cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caselake.operators.graph import kept
from caselake.operators.relational import section_pages
from caselake.operators.structure import exhibit_start, ordered_text, ratio, split_at_anchors, with_ratio
from caselake.operators.windows import first_seen


def section_text(entries: DataFrame, page_lines: DataFrame, least: float = 0.65) -> DataFrame:
    """(document_id, pos, section_text): the lines of an entry's pages after its title's line and before the next entry's.

    entries: document_id, pos, title, start_page, end_page; page_lines: document_id, page, line_no, line. A line that resembles
    the title (ratio ``least``) is its header, the first one counts; without one the body begins with the page.
    Entries whose pages hold nothing are left out.
    """
    own = entries.withColumn("next_title", F.lead("title").over(Window.partitionBy("document_id").orderBy("pos")))
    rows = section_pages(own.select("document_id", "pos", "title", "next_title", "start_page", "end_page"), page_lines.select("document_id", "page", "line_no", "line"))
    key = ["document_id", "pos"]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("page", "line_no")))
    same = lambda title: F.min(F.when((F.lower(F.trim("line")) == F.lower(F.trim(title))) & (F.trim("line") != ""), F.col("n"))).over(Window.partitionBy(*key))
    rows = kept(rows.withColumn("_same", same("title")))
    # a line equal to the title resembles it, so that only lines before it can be the first one that does
    head = matching_lines(rows.filter("_same IS NULL OR n <= _same"), "title", least).groupBy(*key).agg(F.min("n").alias("_from"))
    rows = kept(rows.join(head, key, "left").filter("n > coalesce(_from, 0)"))
    after = matching_lines(rows.filter("next_title IS NOT NULL"), "next_title", least).groupBy(*key).agg(F.min("n").alias("_to"))
    inside = rows.join(after, key, "left").filter("_to IS NULL OR n < _to")
    text = ordered_text(inside, key, "n", "line", "section_text")
    return text.withColumn("section_text", strip("section_text"))


def strip(column: str) -> Column:
    return F.regexp_replace(column, r"\A\s+|\s+\z", "")


def matching_lines(rows: DataFrame, title: str, least: float) -> DataFrame:
    """The rows whose line resembles their title."""
    pairs = rows.withColumn("_a", F.lower(F.trim("line"))).withColumn("_b", F.lower(F.trim(title)))
    return with_ratio(pairs, "_a", "_b", least).filter(F.col("ratio") >= least).drop("_a", "_b", "ratio")


def section_text_by_pos(entries: DataFrame, docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(document_id, pos, section_text): from where an entry's title first occurs up to where the next entry's does, else to the end.

    A title that doesn't occur is sought among the lines by ratio. Entries found neither way have the empty text.
    """
    listed = entries.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("e"))
    texts = docs.select("document_id", "text").join(listed, "document_id")
    exact = texts.withColumn("_low", F.lower("text")).select("document_id", F.explode(F.expr("transform(e, x -> struct(x.pos AS pos, x.title AS title, locate(lower(trim(x.title)), _low) AS at))")).alias("x")).select("document_id", "x.*")
    exact = exact.withColumn("at", F.when(F.trim("title") != "", F.col("at")).otherwise(0))
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    missing = exact.filter("at = 0 AND trim(title) <> ''").select("document_id", "pos", "title")
    lines = docs.join(missing.select("document_id").distinct(), "document_id", "left_semi").select("document_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("begin", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)) + 1)
    fuzzy = matching_lines(missing.join(lines, "document_id").filter("trim(line) <> ''"), "title", least).groupBy("document_id", "pos").agg(F.min("begin").alias("found"))
    places = exact.join(fuzzy, ["document_id", "pos"], "left").withColumn("at", F.when(F.col("at") > 0, F.col("at")).otherwise(F.coalesce("found", F.lit(0))))
    places = places.withColumn("stop", F.lead("at").over(Window.partitionBy("document_id").orderBy("pos")))
    cuts = places.groupBy("document_id").agg(F.collect_list(F.struct("pos", F.col("at").cast("int").alias("at"), F.col("stop").cast("int").alias("stop"))).alias("c"))
    part = "CASE WHEN x.at = 0 THEN '' WHEN coalesce(x.stop, 0) = 0 THEN substring(text, x.at) ELSE substring(text, x.at, greatest(0, x.stop - x.at)) END"
    out = docs.select("document_id", "text").join(cuts, "document_id").select("document_id", F.explode(F.expr(f"transform(c, x -> struct(x.pos AS pos, {part} AS section_text))")).alias("x"))
    return out.select("document_id", "x.pos", strip("x.section_text").alias("section_text"))


@F.pandas_udf(StringType())
def join_gapped(texts: pd.Series) -> pd.Series:
    """Each line that goes on is joined with the next one, pair by pair; blank lines, ends of sentences and indented next lines stand alone."""

    def joined(text: str) -> str:
        lines, out, k = text.split("\n"), [], 0
        while k < len(lines):
            line, follows = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
            alone = not line.strip() or not follows.strip() or follows.startswith("\t") or follows[:2].isspace() and len(follows) > 1 or line.rstrip()[-1:] in ".:;"
            out.append(line if alone else f"{line.rstrip()} {follows.lstrip()}")
            k += 1 if alone else 2
        return "\n".join(out)

    return texts.map(joined, na_action="ignore")


EXHIBIT_LINE = r"(?im)^exhibit\b"


def clean_sections(sections: DataFrame, least: float = 0.8, overflow: int = 500) -> DataFrame:
    """sections (document_id, pos, title, section_text) with clean bodies.

    A first line that repeats the title goes, gapped lines are joined, runs of blanks within a line squeezed, and what follows
    an exhibit line in a document's last section is cut off if it is longer than ``overflow``.
    """
    rows = sections.withColumn("_a", F.lower(F.trim("title"))).withColumn("_b", F.lower(F.trim(F.substring_index("section_text", "\n", 1))))
    rows = with_ratio(rows, "_a", "_b", least).withColumn("section_text", F.when(F.col("ratio") >= least, F.ltrim(F.regexp_replace("section_text", r"\A[^\n]*\n?\s*", ""))).otherwise(F.col("section_text")))
    rows = rows.withColumn("section_text", F.regexp_replace(join_gapped("section_text"), r"(?<=\w)[ \t]{2,}(?=\w)", " "))
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("pos").desc())) == 1
    at = F.regexp_instr("section_text", F.lit(EXHIBIT_LINE))
    cut = last & (at > 0) & (F.length("section_text") - at + 1 > overflow)
    rows = rows.withColumn("_cut", cut).withColumn("_at", at)
    return rows.withColumn("section_text", F.when(F.col("_cut"), F.expr("trim(BOTH ' \n\t' FROM substring(section_text, 1, _at - 1))")).otherwise(F.col("section_text"))).drop("_a", "_b", "ratio", "_cut", "_at")


def exhibits_by_bookmark(lines: DataFrame, bookmarks: DataFrame, marker: Column, least: int = 100) -> DataFrame:
    """(document_id, label, title, start_page, end_page, start, stop, text): exhibits at the pages that bookmarks name.

    lines: document_id, pos, line; marker: a line's page number where it begins a page, else null; bookmarks: document_id, ord, title, page.
    The first bookmark of a page counts, pages without a marker don't, texts under ``least`` characters are dropped. The label is the number at the title's end, else the title with other signs replaced.
    """
    pages = lines.withColumn("page", marker).filter("page IS NOT NULL").groupBy("document_id", "page").agg(F.min("pos").alias("start"))
    marks = first_seen(bookmarks.filter("page IS NOT NULL"), ["document_id", "page"], F.col("ord")).join(pages, ["document_id", "page"])
    total = lines.groupBy("document_id").agg((F.max("pos") + 1).alias("_end")).join(pages.groupBy("document_id").agg(F.max("page").alias("_last")), "document_id")
    w = Window.partitionBy("document_id").orderBy("page")
    marks = marks.join(total, "document_id").withColumn("stop", F.coalesce(F.lead("start").over(w), F.col("_end"))).withColumn("end_page", F.coalesce(F.lead("page").over(w) - 1, F.col("_last")))
    number = F.regexp_extract(F.trim("title"), r"(\d+)$", 1)
    marks = marks.withColumn("label", F.when(number != "", number).otherwise(F.regexp_replace("title", r"[^\w\-]", "_"))).withColumnRenamed("page", "start_page")
    inside = lines.join(marks.select("document_id", F.col("start").alias("pos"), F.col("start").alias("_s")), ["document_id", "pos"], "left")
    inside = inside.withColumn("start", F.last("_s", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).filter("start IS NOT NULL")
    text = ordered_text(inside, ["document_id", "start"], "pos", "line", "text").withColumn("text", strip("text"))
    return marks.join(text, ["document_id", "start"]).filter(F.length("text") >= least).select("document_id", "label", "title", "start_page", "end_page", "start", "stop", "text")


def refine_sections(sections: DataFrame, anchors: DataFrame, least: int = 300, most: int = 15) -> DataFrame:
    """sections with the pieces of those that were split, which keep a note instead of their text: all columns of sections, and ``part`` (null for sections that were there).

    Pieces have the section's id, their title, level, pages and text, and null in further columns but document_id. Splitting again finds nothing, as the note holds no anchor.
    """
    pieces = kept(split_at_anchors(sections, anchors, least, most))
    split = pieces.groupBy("section_id").agg(F.count("*").alias("_pieces"))
    note = F.format_string("[Split into %d sub-sections]", "_pieces")
    old = sections.join(split, "section_id", "left").withColumn("section_text", F.when(F.col("_pieces").isNotNull(), note).otherwise(F.col("section_text")))
    old = old.select(*sections.columns, F.lit(None).cast("int").alias("part"))
    new = pieces.withColumnsRenamed({"title": "section_title", "text": "section_text"}).join(sections.select("section_id", "document_id"), "section_id")
    return old.unionByName(new.select("part", *[c for c in new.columns if c in sections.columns]), allowMissingColumns=True)


def split_off_exhibits(sections: DataFrame, page_lines: DataFrame, many: int = 3) -> tuple[DataFrame, DataFrame]:
    """sections ending before the exhibits of their document, and (document_id, exhibit_page, exhibit_text).

    sections: document_id, pos, section_title, section_text, start_page, end_page and others. The last section that has a first page is cut
    to the pages before the exhibits, or goes where it begins with them; a text that is cut is made from its pages again.
    """
    starts = kept(exhibit_start(page_lines, sections.select("document_id", "section_title", "section_text"), many))
    late = page_lines.join(starts, "document_id").filter("page >= exhibit_page")
    pages = ordered_text(late, ["document_id", "exhibit_page", "page"], "line_no", "line", "text")
    texts = ordered_text(pages, ["document_id", "exhibit_page"], "page", "text", "exhibit_text", "\\n\\n")
    texts = kept(texts.withColumn("exhibit_text", strip("exhibit_text")).filter("exhibit_text <> ''"))
    last = F.max(F.when(F.col("start_page").isNotNull(), F.col("pos"))).over(Window.partitionBy("document_id"))
    rows = sections.withColumn("_last", F.col("pos") == last).join(texts.select("document_id", "exhibit_page"), "document_id", "left")
    cut = F.coalesce(F.col("_last") & (F.col("end_page") >= F.col("exhibit_page")), F.lit(False))
    rows = rows.withColumn("_cut", cut).filter("NOT _cut OR start_page < exhibit_page")
    rows = rows.withColumn("end_page", F.when(F.col("_cut"), F.col("exhibit_page") - 1).otherwise(F.col("end_page")).cast(sections.schema["end_page"].dataType))
    again = section_text(rows.filter("_cut").select("document_id", "pos", F.col("section_title").alias("title"), "start_page", "end_page"), page_lines)
    rows = rows.join(again.withColumnRenamed("section_text", "_text"), ["document_id", "pos"], "left")
    text = F.when(F.col("_cut"), F.coalesce("_text", F.lit(""))).otherwise(F.col("section_text"))
    return rows.withColumn("section_text", text).select(*sections.columns), texts
