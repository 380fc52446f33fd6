"""From document text to pages, outlines, sections and exhibits; every operator works on a whole corpus at once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from caselake.functions.scalar import CHECK_BOX, heading_level, heading_level_by, page_number
from caselake.operators.labels import first_rules
from caselake.operators.windows import fill_forward, first_seen, largest_block, levels_of


def lines_of(docs: DataFrame, text: str = "text", key: str = "document_id") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def ordered_text(rows: DataFrame, keys: list[str], pos: str, line: str, to: str, sep: str = "\n") -> DataFrame:
    """Lines of each key put together again in order."""
    packed = F.array_sort(F.collect_list(F.struct(pos, line)))
    return rows.groupBy(*keys).agg(packed.alias("_l")).select(*keys, F.expr(f"array_join(transform(_l, x -> x.{line}), '{sep}')").alias(to))


def split_pages(lines: DataFrame) -> DataFrame:
    """document_id, page, text: pages by marker lines; a document without markers is page 1."""
    rows = fill_forward(lines.withColumn("_m", page_number("line")), "document_id", "pos", "_m", "page")
    rows = rows.filter("_m IS NULL").withColumn("page", F.coalesce("page", F.lit(1)))
    return ordered_text(rows, ["document_id", "page"], "pos", "line", "text")


def normal_line(line: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(line)), r"\d+", "#")


def repeated_lines(page_lines: DataFrame, share: float = 0.8, most: int = 150, least_pages: int = 3) -> DataFrame:
    """(document_id, norm, pages): normalised lines on ``share`` of their document's pages or more."""
    total = page_lines.groupBy("document_id").agg(F.countDistinct("page").alias("total")).filter(F.col("total") >= least_pages)
    rows = page_lines.filter((F.length("line") <= most) & (F.trim("line") != "")).select("document_id", "page", normal_line("line").alias("norm"))
    on = rows.groupBy("document_id", "norm").agg(F.countDistinct("page").alias("pages"))
    return on.join(total, "document_id").filter(F.col("pages") >= F.ceil(F.col("total") * share)).select("document_id", "norm", "pages")


def remove_repeated_lines(page_lines: DataFrame, **how) -> DataFrame:
    """page_lines (document_id, page, pos, line) without running headers, footers and bare page numbers: by what the lines say, then by where they stand."""
    rep = repeated_lines(page_lines, **how).select("document_id", "norm")
    rows = page_lines.withColumn("norm", normal_line("line")).filter(~F.trim("line").rlike(r"^-?\s*\d{1,4}\s*-?$"))
    return remove_by_place(rows.join(rep, ["document_id", "norm"], "left_anti").drop("norm"), page_lines)


def remove_by_place(rows: DataFrame, page_lines: DataFrame, share: float = 0.8, least: int = 3, places: int = 2) -> DataFrame:
    """rows without lines of any length that stand at the same one of the first ``places`` of their pages on ``share`` of the document's pages, ``least`` at least.

    Places count from a page's first line that isn't empty. Pages are those of ``page_lines``, also where no row is left of them.
    """
    total = page_lines.groupBy("document_id").agg(F.countDistinct("page").alias("_total"))
    page = Window.partitionBy("document_id", "page")
    rows = rows.withColumn("_first", F.min(F.when(F.col("line") != "", F.col("pos"))).over(page))
    rows = rows.withColumn("_k", F.sum(F.when(F.col("pos") >= F.col("_first"), 1).otherwise(0)).over(page.orderBy("pos"))).withColumn("_t", F.trim("line"))
    seen = rows.filter((F.col("_k").between(1, places)) & (F.col("_t") != "")).groupBy("document_id", "_k", "_t").agg(F.countDistinct("page").alias("_pages"))
    often = seen.join(total, "document_id").filter(F.col("_pages") >= F.greatest(F.lit(least), F.ceil(F.col("_total") * share))).select("document_id", "_k", "_t")
    return rows.join(often, ["document_id", "_k", "_t"], "left_anti").drop("_first", "_k", "_t")


DOT_LEADER, SPACED_NUMBER = r"(?m)\.{4,}\s*\d+\s*$", r"(?m)\S {4,}\d{1,3}\s*$"


#: An outline's heading, and lines of outlines by dots, by blanks (not of tables of amounts) and by legal numbering.
TOC_HEADING = r"(?imd)^#{0,4}\s*(table\s+of\s+contents|contents|index)\s*$"
DOTTED_ENTRY = r"(?md)^.{5,120}?(?:\.{3,})\s*\d{1,4}\s*$"
SPACED_ENTRY = r"(?md)^(?!\s*[\d\.]+\s*$)(?!.*[$%]).{5,100}?\s{3,}\d{1,4}\s*$"
LEGAL_ENTRY = r"(?imd)^(?:article|section|clause|exhibit|\d+\.\d+|[IVX]+\.?)\s+.{5,100}?\s+\d{1,4}\s*$"


def detect_toc(docs: DataFrame) -> DataFrame:
    """(document_id, header, leaders, spaced, numbered, has_toc): signals of an outline and whether they suffice: its heading alone, or 4 entries by dots, 5 by blanks or 4 by legal numbering. A null text has none."""
    n = lambda p: F.regexp_count("_t", F.lit(p))
    rows = docs.select("document_id", F.coalesce("text", F.lit("")).alias("_t"))
    out = rows.select("document_id", F.col("_t").rlike(TOC_HEADING).alias("header"), n(DOTTED_ENTRY).alias("leaders"), n(SPACED_ENTRY).alias("spaced"), n(LEGAL_ENTRY).alias("numbered"))
    return out.withColumn("has_toc", F.col("header") | (F.col("leaders") >= 4) | (F.col("spaced") >= 5) | (F.col("numbered") >= 4))


def form_signals(page_lines: DataFrame, pages: int = 10, share: float = 0.55) -> DataFrame:
    """(document_id, has_boxes, short_share, form_like) of each document's first pages: whether they hold a check box, and whether most lines have under 40 characters. page_lines: document_id, page, line.

    The first pages are the feature: a form shows on them. Empty lines don't count; without any line the share is 0.
    """
    line = F.regexp_replace("line", r"\A\s+|\s+\z", "")
    rows = page_lines.filter(F.col("page") <= pages).select("document_id", line.alias("_l"))
    full = F.count_if(F.col("_l") != "")
    short = F.count_if((F.col("_l") != "") & (F.length("_l") < 40))
    out = rows.groupBy("document_id").agg(F.coalesce(F.max(F.col("_l").rlike(CHECK_BOX)), F.lit(False)).alias("has_boxes"), F.coalesce(short / F.nullif(full, F.lit(0)), F.lit(0.0)).alias("short_share"))
    return out.withColumn("form_like", F.col("short_share") >= share)


def toc_pages(pages: DataFrame, least: int = 3) -> DataFrame:
    """The longest run of pages with outline signals."""
    hits = pages.filter(F.regexp_count("text", F.lit(DOT_LEADER)) + F.regexp_count("text", F.lit(SPACED_NUMBER)) >= least).select("document_id", "page").distinct()
    return largest_block(hits)


ENTRY = r"^(\s*)(.*?)\s*\.{2,}\s*(\d+)\s*$"


#: A line that heads an outline, and lines that are entries of one: dot leaders, or a number after blanks.
OUTLINE_HEAD = r"(?i)^\s*(table\s+of\s+contents?|contents?|index)\s*$"
OUTLINE_LINE = r"(\.{3,}\s*|\s{3,})\d+\s*$"


def toc_region(lines: DataFrame, blanks: int = 3) -> DataFrame:
    """(document_id, region): the outline of a document without page markers: its heading, what stands before the first entry, and entries until they stop.

    Entries stop at a line that is neither blank nor an entry, or at more than ``blanks`` blank lines since the last entry. Documents without a
    heading, or without an entry after it, have no row. lines: document_id, pos, line. One window by document, sums and minima only.
    """
    doc = Window.partitionBy("document_id")
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = lines.select("document_id", "pos", t.alias("_t"), F.col("line").rlike(OUTLINE_HEAD).alias("_h"), t.rlike(OUTLINE_LINE).alias("_e"))
    rows = rows.withColumn("_head", F.min(F.when(F.col("_h"), F.col("pos"))).over(doc)).filter("pos >= _head")
    rows = rows.withColumn("_first", F.min(F.when(F.col("_e") & (F.col("pos") > F.col("_head")), F.col("pos"))).over(doc)).filter("_first IS NOT NULL")
    rows = rows.withColumn("_blank", F.sum(F.when(F.col("_t") == "", 1).otherwise(0)).over(upto))
    # the number of blank lines doesn't fall, so its greatest value at an entry is that at the last one
    since = F.col("_blank") - F.max(F.when(F.col("_e"), F.col("_blank"))).over(upto)
    ends = (F.col("pos") > F.col("_first")) & ~F.col("_e") & ((F.col("_t") != "") | (since > blanks))
    rows = rows.withColumn("_ends", ends).withColumn("_stop", F.min(F.when(F.col("_ends"), F.col("pos"))).over(doc))
    before = (F.col("pos") < F.col("_first")) & (F.col("_t") != "")
    entry = F.col("_e") & (F.col("pos") >= F.col("_first")) & (F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    return ordered_text(rows.filter((F.col("pos") == F.col("_head")) | before | entry), ["document_id"], "pos", "_t", "region")


def parse_toc(lines: DataFrame) -> DataFrame:
    """Level (two spaces each), title and page of outline lines; entries merged into one line are parted."""
    parts = F.split(F.regexp_replace("line", r"(\.{2,}\s*\d+)\s+-\s+(?=\S)", "$1\u0001"), "\u0001")
    rows = lines.select("document_id", "pos", F.posexplode(parts).alias("part", "entry")).filter(F.col("entry").rlike(ENTRY))
    level = F.least(F.lit(8), F.floor(F.length(F.regexp_extract("entry", ENTRY, 1)) / 2)).cast("int")
    return rows.select("document_id", "pos", "part", level.alias("level"), F.trim(F.regexp_extract("entry", ENTRY, 2)).alias("title"), F.regexp_extract("entry", ENTRY, 3).cast("int").alias("page"))


def places(text: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def common(text: str, at: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence with the text of ``size`` characters whose ``places`` are given; matching blocks add up to no more."""
    every = (1 << size) - 1
    free = every
    for c in text:
        if u := free & at.get(c, 0):
            free = (free + u | free - u) & every
    return size - free.bit_count()


#: Characters, with a hundred more a pair, of the pairs whose ratio a task keeps.
PAIRS_HELD = 4_000_000


def ratio(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio of two strings; which comes first matters. Below ``least`` it is 0, found by cheaper bounds."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m, last, seen, at, held = SequenceMatcher(None, "", "", autojunk=False), None, {}, {}, 0
        for x, y in batches:
            out = []
            for p, q in zip(x, y, strict=True):
                if p is None or q is None:
                    out.append(None)
                    continue
                r = seen.get((p, q))  # of this task: names recur from scope to scope
                if r is None:
                    if p == q:
                        r = 1.0
                    elif 2.0 * min(len(p), len(q)) < least * (len(p) + len(q)):
                        r = 0.0
                    else:
                        if q != last:
                            at, last = places(q), q
                        r = 0.0
                        if 2.0 * common(p, at, len(q)) / (len(p) + len(q)) >= least:
                            m.set_seqs(p, q)
                            r = m.ratio()
                    r = r if r >= least else 0.0
                    held += len(p) + len(q) + 100
                    if held > PAIRS_HELD:  # what is kept stays small whatever the size of a partition
                        seen, held = {}, len(p) + len(q) + 100
                    seen[p, q] = r
                out.append(r)
            yield pd.Series(out, dtype="float64")

    return run(a, b)


def with_ratio(rows: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """rows with ``ratio`` of two columns, 0 below ``least``; only unlike pairs of fitting length go to Python, and rows stay where they are."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    open_ = (F.col(a) != F.col(b)) & (low / high >= least / (2 - least))
    same = (F.col(a) == F.col(b)) & (high > 0)
    return rows.withColumn("ratio", F.coalesce(F.when(same, 1.0), ratio(F.when(open_, F.col(a)), F.when(open_, F.col(b)), least), F.lit(0.0)))


def calibrate_offset(entries: DataFrame, page_lines: DataFrame, outlines: DataFrame | None = None, least: float = 0.72, titles: int = 5, top: int = 20, support: int = 2) -> DataFrame:
    """(document_id, page_offset, support): by how much printed pages differ from counted ones, one row for each document of ``page_lines``.

    Each of the first titles of four characters or more votes by the first line that resembles it near the top of a page behind the outline.
    The offset with most votes counts, on ties that of the earlier title; with fewer than ``support`` of them it is the outline's last page
    (outlines: document_id, last_page), or 0 without one, and the row's support is 0.
    Only lines of fitting length are compared, within their document.
    """
    docs = page_lines.select("document_id").distinct()
    docs = docs.withColumn("last_page", F.lit(0)) if outlines is None else docs.join(outlines.groupBy("document_id").agg(F.max("last_page").alias("last_page")), "document_id", "left").na.fill(0, ["last_page"])
    e = entries.filter("length(trim(title)) >= 4 AND page IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("document_id").orderBy("pos"))).filter(F.col("_k") <= titles)
    e = e.select("document_id", "_k", F.substring(F.lower(F.trim("title")), 1, 60).alias("title"), F.col("page").alias("printed"))
    p = page_lines.filter((F.col("line_no") < top) & (F.trim("line") != "")).select("document_id", F.col("page").alias("counted"), "line_no", F.substring(F.lower(F.trim("line")), 1, 80).alias("line"))
    p = p.join(docs, "document_id").filter("counted > last_page").drop("last_page")
    fit = F.least(F.length("title"), F.length("line")) / F.greatest(F.length("title"), F.length("line")) >= least / (2 - least)
    pairs = e.join(p, "document_id").filter(fit).withColumn("r", ratio("title", "line", least)).filter(F.col("r") >= least)
    seen = first_seen(pairs, ["document_id", "_k"], F.col("counted"), F.col("line_no"))
    votes = seen.groupBy("document_id", (F.col("counted") - F.col("printed")).alias("page_offset")).agg(F.count("*").alias("support"), F.min("_k").alias("_k")).filter(F.col("support") >= support)
    won = first_seen(votes, ["document_id"], F.col("support").desc(), F.col("_k"))
    rows = docs.join(won, "document_id", "left")
    return rows.select("document_id", F.coalesce("page_offset", "last_page").alias("page_offset"), F.coalesce("support", F.lit(0)).alias("support"))


def renumber(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pages by their printed number; pages before printed page 1 go."""
    return pages.join(offsets.select("document_id", "page_offset"), "document_id").withColumn("page", F.col("page") - F.col("page_offset")).filter("page >= 1").drop("page_offset")


def scan_headings(lines: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Heading lines with their level: by the usual styles, or by those given for each document, of which the first that fits counts (styles: document_id, styles, an array of names)."""
    if styles is None:
        level = heading_level("line")
    else:
        lines, level = lines.join(styles.select("document_id", F.col("styles").alias("_s")), "document_id"), heading_level_by("line", "_s")
    return lines.withColumn("level", level).filter("level IS NOT NULL").select("document_id", "pos", "level", F.trim("line").alias("title"))


def build_sections(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """One section per heading with the text up to the next; what lies before the first is the title page; documents without headings are one section."""
    h = headings.select("document_id", "pos", F.col("pos").alias("start"), "title", "level")
    rows = lines.join(h, ["document_id", "pos"], "left")
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.coalesce(F.last("start", ignorenulls=True).over(w), F.lit(-1)))
    body = ordered_text(rows.filter("title IS NULL"), ["document_id", "start"], "pos", "line", "section_text")
    named = h.select("document_id", "start", "title", "level")
    first = lines.select("document_id").distinct().join(body.filter("start = -1"), "document_id").select("document_id", F.lit(-1).cast("int").alias("start"), F.lit("Title Page").alias("title"), F.lit(0).alias("level"))
    return named.unionByName(first).join(body, ["document_id", "start"], "left")


def skeleton(lines: DataFrame, most: int = 60, every: int = 4) -> DataFrame:
    """Short lines, and sampled prose from a document's first and last quarter, in order."""
    w = Window.partitionBy("document_id")
    n = F.count("*").over(w)
    rows = lines.withColumn("_n", n).filter((F.length("line") <= most) | (((F.col("pos") < F.col("_n") / 4) | (F.col("pos") >= 3 * F.col("_n") / 4)) & (F.col("pos") % every == 0)))
    return ordered_text(rows, ["document_id"], "pos", "line", "skeleton")


EXHIBIT_START = r"(?i)^\s*#*\s*exhibit\s+([a-z]{1,2}|\d{1,3})\b"


def exhibits_by_heading(lines: DataFrame) -> DataFrame:
    """(document_id, label, start, stop): exhibits that begin with a '## ' heading."""
    hits = lines.filter(F.col("line").startswith("## ") & F.col("line").rlike(EXHIBIT_START)).select("document_id", F.col("pos").alias("start"), F.upper(F.regexp_extract("line", EXHIBIT_START, 1)).alias("label"))
    return with_stops(hits, lines)


def with_stops(hits: DataFrame, lines: DataFrame) -> DataFrame:
    total = lines.groupBy("document_id").agg((F.max("pos") + 1).alias("_n"))
    nxt = F.lead("start").over(Window.partitionBy("document_id").orderBy("start"))
    return hits.join(total, "document_id").withColumn("stop", F.coalesce(nxt, F.col("_n"))).select("document_id", "label", "start", "stop")


def exhibits_by_label(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """First line that begins with each known label. labels: document_id, label."""
    hits = lines.withColumn("label", F.upper(F.regexp_extract("line", EXHIBIT_START, 1))).filter("label <> ''").join(labels, ["document_id", "label"], "left_semi")
    first = hits.groupBy("document_id", "label").agg(F.min("pos").alias("start"))
    return with_stops(first, lines)


def exhibits_by_scan(lines: DataFrame) -> DataFrame:
    """Exhibit starts within three lines of a page marker or after two blank lines."""
    from caselake.operators.windows import boundary_context

    rows = boundary_context(lines, page_number("line").isNotNull())
    hits = rows.filter(F.col("line").rlike(EXHIBIT_START) & (F.coalesce(F.col("since_marker") <= 3, F.lit(False)) | (F.col("blanks_before") >= 2)))
    first = hits.withColumn("label", F.upper(F.regexp_extract("line", EXHIBIT_START, 1))).groupBy("document_id", "label").agg(F.min("pos").alias("start"))
    return with_stops(first, lines)


def split_exhibits(lines: DataFrame, labels: DataFrame, bookmarked: DataFrame | None = None, blob: int = 50_000) -> DataFrame:
    """Exhibits of each document by the first way that finds any: bookmarks (-1; document_id, label, start, stop), headings (0), known labels (1), scan (2).

    A single exhibit of over ``blob`` characters counts as not split, if a later way finds any.
    """
    ways = [exhibits_by_heading(lines), exhibits_by_label(lines, labels), exhibits_by_scan(lines)]
    rows = ways[0].withColumn("way", F.lit(0)).unionByName(ways[1].withColumn("way", F.lit(1))).unionByName(ways[2].withColumn("way", F.lit(2)))
    if bookmarked is not None:
        rows = rows.unionByName(bookmarked.select("document_id", "label", "start", "stop").withColumn("way", F.lit(-1)))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("document_id").orderBy("pos"))
    sizes = lines.select("document_id", (F.col("pos") + 1).alias("stop"), upto.alias("_upto"))
    one = F.count("*").over(Window.partitionBy("document_id", "way")) == 1
    rows = rows.withColumn("_one", one).join(sizes, ["document_id", "stop"], "left").join(sizes.select("document_id", F.col("stop").alias("start"), F.col("_upto").alias("_before")), ["document_id", "start"], "left")
    whole = F.col("_one") & (F.col("_upto") - F.coalesce("_before", F.lit(0)) - 1 > blob) & (F.col("way") >= 0)
    rows = rows.withColumn("_rank", F.when(whole, F.col("way") + 10).otherwise(F.col("way")))
    best = F.min("_rank").over(Window.partitionBy("document_id"))
    return rows.withColumn("_b", best).filter("_rank = _b").select("document_id", "label", "start", "stop", "way")


#: What begins an exhibit on a page, and what names one in an outline.
EXHIBIT_HEAD = r"(?imd)^(?:exhibit|attachment|schedule|appendix)\s*[A-Z0-9]"
EXHIBIT_NAMED = r"(?i)\b(?:exhibit|ex\s*[-]?\s*\d+|ex\d+)\b"


def exhibit_start(page_lines: DataFrame, outline: DataFrame | None = None, many: int = 3) -> DataFrame:
    """(document_id, exhibit_page): first page on which exhibits start; pages with ``many`` starts or more are lists of exhibits.

    outline: document_id, section_title, section_text. Where a title names an exhibit, or the text of the entry "TOC" does, all pages are
    scanned; else those from the middle of the document on. Without an outline all pages of all documents are.
    """
    total = page_lines.groupBy("document_id").agg(F.max("page").alias("_total"))
    first = F.lit(1)
    if outline is not None:
        says = F.col("section_title").rlike(EXHIBIT_NAMED) | ((F.col("section_title") == "TOC") & F.col("section_text").rlike(EXHIBIT_NAMED))
        total = total.join(outline.filter(says).select("document_id").distinct().withColumn("_named", F.lit(True)), "document_id", "left")
        first = F.when(F.col("_named"), 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("_total") / 2)))
    texts = ordered_text(page_lines, ["document_id", "page"], "line_no", "line", "text")
    starts = texts.withColumn("n", F.regexp_count("text", F.lit(EXHIBIT_HEAD))).filter((F.col("n") > 0) & (F.col("n") < many)).join(total, "document_id").filter(F.col("page") >= first)
    return starts.groupBy("document_id").agg(F.min("page").alias("exhibit_page"))


def render(sections: DataFrame) -> DataFrame:
    """Section titles and texts as one indented text per document."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level").cast("int")), F.col("section_title"), F.lit(": "), F.substring("section_text", 1, 30))
    return ordered_text(sections.withColumn("line", line), ["document_id"], "pos", "line", "rendered")


def merge_lines(lines: DataFrame) -> DataFrame:
    """Wrapped lines joined: a line goes on unless it ends a sentence or the next begins with a capital; a hyphen at the end is dropped."""
    w = Window.partitionBy("document_id").orderBy("pos")
    before = F.lag("line").over(w)
    new = before.isNull() | F.trim(before).rlike(r"[.:;!?]$") | (F.trim(before) == "") | ~F.trim("line").rlike(r"^[a-z]")
    rows = lines.withColumn("_g", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    glued = ordered_text(rows, ["document_id", "_g"], "pos", "line", "_t")
    return glued.select("document_id", F.col("_g").alias("para"), F.regexp_replace(F.regexp_replace("_t", r"-\n", ""), r"\n", " ").alias("text"))


def label_sections(sections: DataFrame, rules: DataFrame, few: int = 64) -> DataFrame:
    """Label by the first title rule (1.0), else the first body rule within 500 characters (0.9), else unrecognised.

    rules: place ('title' or 'body'), pattern, label, rank, any number of them. Up to ``few`` become one array that every row is tested
    against in generated code; more become an automaton that finds all patterns of a text in one pass. Neither needs a join.
    """
    s = sections.select("section_id", F.lower("section_title").alias("_t"), F.lower(F.substring("section_text", 1, 500)).alias("_b"))
    if rules.limit(few + 1).count() <= few:
        table = rule_array(rules.select((F.col("place") != "title").alias("late"), "rank", "label", "pattern").orderBy("late", "rank", "label"), few)
        hit = F.filter(table, lambda r: F.when(r["late"], F.col("_b")).otherwise(F.col("_t")).contains(r["pattern"]))
        s = s.withColumn("m", F.get(hit, F.lit(0)))
    else:
        s = first_rules(s, rules)
    return s.select("section_id", F.coalesce("m.label", F.lit("unrecognized")).alias("label"), F.when(F.col("m.late").isNull(), 0.0).when(F.col("m.late"), 0.9).otherwise(1.0).alias("label_confidence"))


def rule_array(rules: DataFrame, most: int = 5000) -> Column:
    """A table of rules as one array literal, in its order; one of over ``most`` rows isn't a table of rules and is refused."""
    rows = rules.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), ArrayType(rules.schema))


def drop_subtrees(entries: DataFrame, pattern: str = "(?i)^exhibit") -> DataFrame:
    """Outline entries without those that match and what lies under them: an entry goes if its nearest match before it is of a smaller level and nothing as shallow has come since."""
    w = Window.partitionBy("document_id").orderBy("pos")
    hit = F.col("title").rlike(pattern)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.withColumn("_hit", hit)
    inside = F.lit(False)
    for k in levels_of(entries):
        at = F.max(F.when(F.col("_hit") & (F.col("level") == k), F.col("pos"))).over(upto)
        closed = F.max(F.when(~F.col("_hit") & (F.col("level") <= k), F.col("pos"))).over(upto)
        inside = inside | (at.isNotNull() & (closed.isNull() | (at > closed)) & (F.col("level") > k))
    return rows.withColumn("_in", inside).filter(~F.col("_in") & ~F.col("_hit")).drop("_in", "_hit")


def find_from(text: str, anchor: Column, at: Column) -> Column:
    """Place (from 0) of an anchor in a text from ``at`` on: whole, else by its first 70 characters or fewer, five fewer each time down to 20; null if it isn't there."""
    place = lambda what: F.nullif(F.position(what, F.col(text), (at + 1).cast("int")), F.lit(0)) - 1
    strip = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    sizes = F.sequence(F.greatest(F.least(F.length(anchor), F.lit(70)), F.lit(20)), F.lit(20), F.lit(-5))
    parts = F.transform(sizes, lambda n: F.nullif(strip(F.substring(anchor, F.lit(1), n)), F.lit("")))
    begun = F.when(F.length(anchor) >= 20, F.get(F.filter(F.transform(parts, place), lambda p: p.isNotNull()), F.lit(0)))
    return F.when(anchor != "", F.coalesce(place(anchor), begun))


def split_at_anchors(sections: DataFrame, anchors: DataFrame, least: int = 300, most: int = 15) -> DataFrame:
    """Pieces of sections cut at their anchors, in order: (section_id, part, title, level, start, stop, start_page, end_page, text).

    sections: section_id, level, section_text, and start_page and end_page if pages are to be estimated; anchors: section_id, ord, anchor, and
    title if pieces are to have one, of which the first ``most`` of a section count. An anchor is sought behind the one before it and stands
    where that search began if it isn't found. Pages are estimated by the share of the text, a hundredth further for each piece. Pieces of under ``least`` characters are left out; ``part`` counts those that stay.
    """
    title = F.col("title") if "title" in anchors.columns else F.lit(None).cast("string")
    packed = anchors.groupBy("section_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("anchor", F.lit("")).alias("anchor"), title.alias("title")))), 1, most).alias("_a"))
    paged = {"start_page", "end_page"} <= set(sections.columns)
    pages = [F.col(c) if paged else F.lit(None).cast("int").alias(c) for c in ("start_page", "end_page")]
    rows = sections.filter("section_text IS NOT NULL").select("section_id", "level", "section_text", *pages).join(packed, "section_id")
    none = F.lit(None).cast("array<int>")
    cuts = F.aggregate("_a", F.coalesce(none, F.array().cast("array<int>")), lambda done, a: F.concat(done, F.array(one_cut(done, a))))
    rows = rows.withColumn("_cuts", cuts).withColumn("_n", F.length("section_text"))
    stops = F.concat(F.slice("_cuts", F.lit(2), F.size("_cuts")), F.array("_n"))
    rows = rows.select("*", F.posexplode(F.arrays_zip(F.col("_cuts").alias("start"), stops.alias("stop"), F.col("_a.title").alias("title"))).alias("_i", "_c"))
    text = F.regexp_replace(F.substring("section_text", F.col("_c.start") + 1, F.greatest(F.col("_c.stop") - F.col("_c.start"), F.lit(0))), r"\A\s+|\s+\z", "")
    rows = rows.select("section_id", "_i", F.col("_c.title").alias("title"), (F.col("level") + 1).alias("level"), F.col("_c.start").alias("start"), F.col("_c.stop").alias("stop"), "_n", "start_page", "end_page", text.alias("text"))
    rows = rows.filter(F.length("text") >= least).withColumn("part", F.row_number().over(Window.partitionBy("section_id").orderBy("_i")) - 1)
    page = lambda c: F.bround(F.col("start_page") + F.col(c) / F.col("_n") * (F.col("end_page") - F.col("start_page")) + F.col("part") * 0.01, 0).cast("int")
    known = F.col("start_page").isNotNull() & F.col("end_page").isNotNull()
    one = F.col("start_page") == F.col("end_page")
    first = F.when(known & ~one, page("start")).otherwise(F.col("start_page"))
    last = F.when(known & ~one, page("stop")).otherwise(F.col("end_page"))
    return rows.select("section_id", "part", "title", "level", "start", "stop", first.cast("int").alias("start_page"), last.cast("int").alias("end_page"), "text")


def one_cut(done: Column, anchor: Column) -> Column:
    at = F.coalesce(F.try_element_at(done, F.lit(-1)) + 1, F.lit(0))
    return F.coalesce(find_from("section_text", anchor["anchor"], at), at).cast("int")


# -- HTML ------------------------------------------------------------------------------------

SKIPPED = {"script", "style", "meta", "noscript", "svg", "head"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "table", "section", "article", "nav", "title"}


#: Words in the attributes of a page's own outline.
OUTLINE_WORDS = ("toc", "table-of-contents", "tableofcontents", "contents", "index", "navigation", "outline")


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str | None, str | None, str, int, int | None, int | None, int | None]] = []
        self.tables: list[list[int]] = []  # the open tables, innermost last: number on the page, row, cell (both from 1, 0 before the first)
        self.n_tables = 0
        self.tag, self.id, self.href, self.skip, self.text = "", None, None, [], []
        self.inside: dict[int, tuple[str, int]] = {}  # the open outline container of each kind: its tag, and how many of that tag are open
        self.met: set[int] = set()

    def container(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """The first nav element, and the first other block, whose attributes speak of an outline."""
        for kind, (own, depth) in self.inside.items():
            self.inside[kind] = (own, depth + (own == tag))
        told = " ".join(v or "" for k, v in attrs if tag == "nav" or k in ("id", "class")).lower()
        kind = 1 if tag == "nav" else 2
        if tag in ("nav", "div", "section", "aside") and kind not in self.met and any(w in told for w in OUTLINE_WORDS):
            self.met.add(kind)
            self.inside[kind] = (tag, 1)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            where = self.tables[-1] if self.tables and self.tables[-1][2] else (None, None, None)
            self.rows.append((self.tag, self.id, self.href, text, min(self.inside, default=0), *where))
        self.text = []

    def grid(self, tag: str) -> None:
        """Where a cell stands: a stack of open tables, so that a table within a cell has rows of its own."""
        if tag == "table":
            self.n_tables += 1
            self.tables.append([self.n_tables, 0, 0])
        elif self.tables and tag == "tr":
            self.tables[-1][1:] = [self.tables[-1][1] + 1, 0]
        elif self.tables and tag in ("td", "th"):
            self.tables[-1][1] = max(1, self.tables[-1][1])
            self.tables[-1][2] += 1

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            if tag not in VOID:
                self.flush()
                self.skip.append(tag)
            return
        if tag in BLOCKS or tag in ("a", "aside"):
            self.flush()
            self.container(tag, attrs)
            self.grid(tag)
            got = dict(attrs)
            self.tag, self.id, self.href = tag, got.get("id") or got.get("name"), got.get("href")

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif tag in BLOCKS or tag in ("a", "aside"):
            self.flush()
            if tag == "table" and self.tables:
                self.tables.pop()
            self.inside = {k: (own, depth - (own == tag)) for k, (own, depth) in self.inside.items() if own != tag or depth > 1}
            self.tag, self.id, self.href = "", None, None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, element_id, href, text, container, table_no, row_no, cell_no): the visible text of each block, scripts and styles skipped.

    container is 1 within the page's outline nav, 2 within another outline block. A block in a table's cell has the numbers of the innermost
    open table (in the order in which tables open), its row and its cell, all from 1.
    """

    text, number = pa.string(), pa.int32()
    schema = pa.schema([("page_id", pa.int64()), ("pos", number), ("tag", text), ("element_id", text), ("href", text), ("text", text), ("container", number), ("table_no", number), ("row_no", number), ("cell_no", number)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, html in zip(batch.column(0), batch.column(1), strict=True):  # a page at a time: what a worker holds is one page and its elements
                p = _Elements()
                p.feed(html.as_py() or "")
                p.flush()
                if p.rows:
                    columns = [[pid.as_py()] * len(p.rows), range(len(p.rows)), *zip(*p.rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, pos int, tag string, element_id string, href string, text string, container int, table_no int, row_no int, cell_no int")


def html_tables(elements: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, pos, cells): the rows of each table, their cells in order; cells without text between others are empty."""
    cells = elements.filter("cell_no IS NOT NULL").groupBy("page_id", "table_no", "row_no", "cell_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    cells = cells.select("page_id", "table_no", "row_no", "cell_no", F.col("_t")[0]["pos"].alias("pos"), F.expr("array_join(transform(_t, x -> x.text), ' ')").alias("text"))
    rows = cells.groupBy("page_id", "table_no", "row_no").agg(F.min("pos").alias("pos"), F.map_from_entries(F.collect_list(F.struct("cell_no", "text"))).alias("_c"))
    return rows.select("page_id", "table_no", "row_no", "pos", F.expr("transform(sequence(1, array_max(map_keys(_c))), k -> coalesce(_c[k], ''))").alias("cells"))


def html_lines(elements: DataFrame) -> DataFrame:
    """(page_id, pos, line): the page's lines, a table's row as one line of cells between bars at the place of its first cell."""
    rows = html_tables(elements).select("page_id", "pos", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")).alias("line"))
    return elements.filter("cell_no IS NULL").select("page_id", "pos", F.col("text").alias("line")).unionByName(rows)


def html_text(elements: DataFrame) -> DataFrame:
    return ordered_text(html_lines(elements), ["page_id"], "pos", "line", "text")


def html_outline(elements: DataFrame, least: float = 0.55) -> DataFrame:
    """(page_id, pos, title, level, way, element_id): outline of each page by the first way with two entries or more.

    0: links of an outline container; 1: links to anchors, each anchor once; 2: headings; 3: lines that look like outline entries.
    An entry without an anchor gets the element with an id whose first text resembles its title most, by ratio from ``least`` on.
    """
    ids = elements.filter("element_id IS NOT NULL").select("page_id", "element_id", F.col("pos").alias("_at"), F.col("text").alias("_text"))
    links = elements.filter(F.col("href").startswith("#")).select("page_id", "pos", F.expr("substring(href, 2)").alias("element_id"), F.col("text").alias("title"), F.lit(1).alias("level"), "container")
    kind = F.min(F.when(F.col("container") > 0, F.col("container"))).over(Window.partitionBy("page_id"))
    listed = links.withColumn("_kind", kind).filter("container = _kind").drop("container", "_kind").withColumn("way", F.lit(0))
    anchored = first_seen(links.drop("container").join(ids.select("page_id", "element_id").distinct(), ["page_id", "element_id"]), ["page_id", "element_id"], F.col("pos")).withColumn("way", F.lit(1))
    heads = elements.filter(F.col("tag").rlike("^h[1-6]$")).select("page_id", "pos", "element_id", F.col("text").alias("title"), F.substring("tag", 2, 1).cast("int").alias("level"), F.lit(2).alias("way"))
    scanned = elements.filter(F.col("text").rlike(ENTRY)).select("page_id", "pos", F.lit(None).cast("string").alias("element_id"), F.trim(F.regexp_extract("text", ENTRY, 2)).alias("title"), F.lit(1).alias("level"), F.lit(3).alias("way"))
    rows = listed.unionByName(anchored).unionByName(heads).unionByName(scanned)
    n = F.count("*").over(Window.partitionBy("page_id", "way"))
    rows = rows.withColumn("_n", n).withColumn("_use", F.min(F.when(F.col("_n") >= 2, F.col("way"))).over(Window.partitionBy("page_id")))
    rows = rows.filter("way = coalesce(_use, 2)").drop("_n", "_use")
    open_ = rows.filter("element_id IS NULL AND way = 3").select("page_id", "pos", F.lower("title").alias("_a"))
    near = open_.join(ids, "page_id").withColumn("_b", F.lower(F.expr("substring(_text, 1, length(_a) + 30)")))
    best = first_seen(with_ratio(near, "_a", "_b", least).filter(F.col("ratio") >= least), ["page_id", "pos"], F.col("ratio").desc(), F.col("_at")).select("page_id", "pos", F.lit(3).alias("way"), F.col("element_id").alias("_found"))
    return rows.join(best, ["page_id", "pos", "way"], "left").withColumn("element_id", F.coalesce("element_id", "_found")).select("page_id", "pos", "title", "level", "way", "element_id")


def html_sections(elements: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, title, level, start, section_text): text from each outline entry's anchor up to the next entry's.

    outline: as ``html_outline`` gives it (the default). Entries are ordered by where their anchors stand, not by where the outline
    lists them; of entries that share an anchor the last listed has the text, the others an empty one, like an entry whose anchor isn't on the page.
    A heading with an anchor of its own opens its section.
    """
    entries = html_outline(elements) if outline is None else outline
    ids = elements.filter("element_id IS NOT NULL").groupBy("page_id", "element_id").agg(F.max("pos").alias("_at"))
    # an outline of headings points at the headings themselves
    at = F.when(F.col("way") == 2, F.col("pos")).otherwise(F.col("_at"))
    placed = entries.join(ids, ["page_id", "element_id"], "left").withColumn("start", at).drop("_at")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = placed.filter("start IS NOT NULL").select("page_id", F.col("start").alias("pos")).distinct().withColumn("_start", F.col("pos"))
    lines = elements.select("page_id", "pos", "cell_no", "table_no", "row_no", "text").join(starts, ["page_id", "pos"], "left").withColumn("start", F.last("_start", ignorenulls=True).over(w)).filter("start IS NOT NULL")
    body = ordered_text(lines, ["page_id", "start"], "pos", "text", "section_text")
    last = F.max("pos").over(Window.partitionBy("page_id", "start"))
    placed = placed.withColumn("_last", F.col("start").isNotNull() & (F.col("pos") == last))
    return placed.join(body, ["page_id", "start"], "left").select("page_id", "pos", "title", "level", "start", F.when(F.col("_last"), F.col("section_text")).otherwise("").alias("section_text"))
