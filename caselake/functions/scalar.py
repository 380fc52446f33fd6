"""Column functions over text: built-in expressions only, so that they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column, *pairs: tuple[str, str]) -> Column:
    """The column with each pattern replaced in turn."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, col(c))


_FROM = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def slugify(c: str | Column) -> Column:
    """Lower-case runs of letters and digits joined by dashes, accents dropped."""
    return clean(F.lower(F.translate(col(c), _FROM, _TO)), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))


#: Company endings that don't tell parties apart.
SUFFIXES = r",?\s+(inc\.|llc|corp\.|ltd\.|l\.p\.|llp|p\.c\.|n\.a\.|co\.|corporation|incorporated|limited)\.?$"


def norm_party(c: str | Column) -> Column:
    return F.trim(clean(F.regexp_replace(F.lower(F.trim(col(c))), SUFFIXES, ""), (r"\s+", " ")))


def norm_authority(c: str | Column) -> Column:
    """The name of an authority without the reporter citation at its end."""
    return F.trim(clean(F.lower(col(c)), (r",?\s+\d+\s+\S+\s+\d+.*$", ""), (r"\s+", " ")))


def is_substring(a: str, b: str, least: int = 3) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (F.length(x) >= least) & (F.length(y) >= least) & (x.contains(y) | y.contains(x))


def trigrams(c: str | Column) -> Column:
    """Distinct trigrams of lower-case alphanumeric words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def set_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def bound(f, *args: Column) -> Column:
    """f of the arguments, each evaluated once however often f uses it."""
    return F.transform(F.array(F.struct(*[x.alias(f"x{k}") for k, x in enumerate(args)])), lambda t: f(*[t[f"x{k}"] for k in range(len(args))]))[0]


def trgm_similarity(a: str | Column, b: str | Column) -> Column:
    return bound(set_similarity, trigrams(a), trigrams(b))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    x, y = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def clean_md(c: str | Column) -> Column:
    return clean(F.translate(F.regexp_replace(col(c), "\r\n?", "\n"), "“”‘’�", "\"\"''"), ("\n{3,}", "\n\n"))


def clean_line(c: str | Column) -> Column:
    """Control characters dropped, runs of dashes and of blanks squeezed."""
    return F.trim(clean(c, (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"[–—]", "-"), (r"-{3,}", "--"), (r"[ \t]+", " ")))


#: Lines that stay as they are, lines of a screen's controls, characters without a sign, telephone numbers, and check boxes.
KEPT_LINE = r"^\s*(#{1,6}\s|\[(Context|Page)\b|(---|\*\*\*)\s*$|\|.*\|\s*$)"
SCREEN_LABEL = r"(?i)^@?\s*(Feedback|Downloads|Forums|App Store Connect|Customer Support|©|®|™)\s*$"
NO_SIGN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\u200b\u200c\u200d\ufeff]"
PHONE = r"(?<!\d)(?:(1)[.\-\s]?|(?!\d{10})[.\-\s]?)(\d{3})[.\-\s]?(\d{3})[.\-\s]?(\d{4})(?!\d)"
CHECK_BOX = r"[\u2610\u2611\u2612\u2713\u2714\u2717\u2718]"


def body_line(c: str | Column) -> Column:
    """A line of text with plain quotes and dashes, single blanks and telephone numbers in one form; null for a line that holds a screen's label or an icon only.

    Headings, page marks, rules and table rows stay as they are, but for characters without a sign; a null line is the empty one.
    """
    whole = F.regexp_replace(F.coalesce(col(c), F.lit("")), NO_SIGN, "")
    line = F.regexp_replace(whole, r"\A\s+|\s+\z", "")
    icon = (line != "") & (line.isin("|", ">") | ((F.length(line) <= 3) & ~line.rlike("[A-Za-z0-9]")))
    plain = F.translate(line, "“”‘’", "\"\"''")
    plain = clean(plain, (r"(?<=\S)[\u2013\u2014](?=\S)", "--"), (r"[\u2013\u2014]", "-"), (r"^[|>]\s+(?=[A-Za-z])", ""), (r"[ \t]+", " "), (r"\A\s+|\s+\z", ""))
    # a mark, which no line holds any more, parts the leading 1 from the rest
    plain = clean(plain, (PHONE, "$1\x01$2-$3-$4"), ("1\x01", "1-"), ("\x01", ""))
    return F.when(whole.rlike(KEPT_LINE), whole).when(~(line.rlike(SCREEN_LABEL) | icon), plain)


#: Where quoted mail begins, in the order in which they are tried.
QUOTES = (r"(?m)^-+ ?Original Message ?-+", r"(?m)^On .{1,200} wrote:", r"(?m)^_{10,}", r"(?m)^From: ")


def strip_quoted(c: str | Column) -> Column:
    """The text up to the first quotation pattern that occurs in it."""
    out = col(c)
    for p in reversed(QUOTES):
        out = F.when(col(c).rlike(p), F.regexp_replace(F.regexp_replace(col(c), p + r"[\s\S]*$", ""), r"\s+$", "")).otherwise(out)
    return out


#: How texts cite exhibits, and how an evidence node names one.
CITED_EXHIBITS = (
    r"[Ee]xhibit\s+([A-Z0-9]+(?:\s*[-–]\s*[A-Z0-9]+)?)",
    r"[Ee]xh?\.?\s+([A-Z0-9]+)",
    r"[Ee]xhibits?\s+([A-Z0-9]+(?:\s*,\s*[A-Z0-9]+)*(?:\s*(?:and|&)\s*[A-Z0-9]+)?)",
)
EXHIBIT_LABEL = r"(?i)^(?:exhibit|appendix|attachment|schedule)\s+([A-Z0-9](?:[-\u2013]?[A-Z0-9])*)"


def cited_exhibits(c: str | Column) -> Column:
    """Sorted distinct labels that a text cites, lists of them taken apart: A of "Ex. A", A and B-1 of "Exhibits A and B-1"; a null text cites none."""
    found = F.flatten(F.array(*[F.regexp_extract_all(col(c), F.lit(p), 1) for p in CITED_EXHIBITS]))
    parts = F.flatten(F.transform(found, lambda m: F.split(m, r"\s*[,&]\s*|\s+and\s+")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))), F.array().cast("array<string>"))


def exhibit_label(c: str | Column) -> Column:
    """Label of an evidence node: A of "Exhibit A - letter", in upper case; null where it names no exhibit."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(col(c)), EXHIBIT_LABEL, 1)), F.lit(""))


def exhibit_refs(c: str | Column) -> Column:
    """Sorted distinct labels that a text cites: Exhibit A, Ex. 12."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?i)\bex(?:hibit|\.)\s+([a-z]{1,2}|\d{1,3})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def docket_number(c: str | Column) -> Column:
    hit = F.regexp_extract(col(c), r"(?i)(\d{1,2}[-_:]\d{0,2}-?cv[-_]\d{3,6}|\d{2,4}-[a-z]{2}-\d{3,6})", 1)
    return F.when(hit == "", None).otherwise(F.upper(F.regexp_replace(hit, "_", "-")))


def plus_address(c: str | Column, part: int) -> Column:
    """Tenant (1) or hint (2) of inbox+tenant.hint@host."""
    hit = F.regexp_extract(F.lower(col(c)), r"\+([a-z0-9-]+)(?:\.([a-z0-9_-]+))?@", part)
    return F.when(hit == "", None).otherwise(hit)


def by_rules(c: str | Column, rules: list[tuple[str, str]], default: str | None, how: str = "prefix") -> Column:
    """The value of the first rule whose key begins, or lies in, the lower-cased column."""
    low = F.lower(col(c))
    test = (lambda k: low.startswith(k)) if how == "prefix" else (lambda k: low.contains(k))
    return reduce(lambda out, r: F.when(test(r[0]), r[1]).otherwise(out), reversed(rules), F.lit(default))


#: Document type to graph category.
CATEGORIES = [("pleading - complaint", "complaint"), ("pleading - answer", "answer"), ("pleading - motion", "motion"), ("pleading", "pleading"), ("contract", "contract"), ("court", "court_order"), ("discovery", "discovery")]


def doc_category(c: str | Column) -> Column:
    return by_rules(c, CATEGORIES, "other")


def mail_field(c: str | Column, name: str) -> Column:
    hit = F.trim(F.regexp_extract(col(c), rf"(?im)^{name}:[ \t]*(.*)$", 1))
    return F.when(hit == "", None).otherwise(hit)


def mail_body(c: str | Column) -> Column:
    """What follows the header block."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\A(?:[A-Za-z-]+:[^\n]*\n)+\s*", ""), r"\s+$", "")


def short_line_share(c: str | Column, most: int = 40) -> Column:
    lines = F.filter(F.split(col(c), "\n"), lambda x: F.trim(x) != "")
    return F.round(F.size(F.filter(lines, lambda x: F.length(x) < most)) / F.nullif(F.size(lines), F.lit(0)), 6)


def char_share(c: str | Column, chars: str) -> Column:
    return F.length(F.regexp_replace(col(c), f"[^{chars}]", "")) / F.nullif(F.length(col(c)), F.lit(0))


def is_garbled(c: str | Column) -> Column:
    control = F.length(col(c)) - F.length(F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.coalesce(((char_share(c, "A-Za-z") < 0.3) & (char_share(c, "0-9") < 0.3)) | (control > 5), F.lit(True))


def is_bad_text(c: str | Column, least: int = 300) -> Column:
    return F.lower(col(c)).rlike("^#? ?error") | (F.length(F.regexp_replace(col(c), r"[\s#*|_-]", "")) < least)


def split_parties(c: str | Column, part: int) -> Column:
    hit = F.trim(F.regexp_extract(col(c), r"^(.*?)\s+vs?\.\s+(.*)$", part))
    return F.when(hit == "", None).otherwise(hit)


def page_number(c: str | Column) -> Column:
    """Number of a page marker line in any of three spellings, else null."""
    hit = F.regexp_extract(col(c), r"(?i)^\s*(?:#+\s*page\s+(\d+)|\[page\s+(\d+)\]|-+\s*page\s+(\d+)\s*-+)\s*$", 0)
    return F.regexp_extract(hit, r"(\d+)", 1).try_cast("int")


def date_sort_key(c: str | Column) -> Column:
    """ISO date, year, or year within the text as a sortable string; 9999-99-99 for anything else."""
    t = F.trim(col(c))
    year = F.regexp_extract(t, r"\b(1[89]\d\d|20\d\d)\b", 1)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
        .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-00-00")))
        .when(year != "", F.concat(year, F.lit("-00-00")))
        .otherwise("9999-99-99")
    )


#: Names of dates that only describe the file; types of dates that are noise; types that make an event procedural.
DATE_NAMES = ("date", "filing date", "effective date", "execution date", "contract date", "agreement date", "document date", "signing date", "service date")
NOISE_DATES = ("publication_date", "access_date", "data_period", "citation_date")
PROCEDURAL_DATES = ("filing", "hearing", "ruling", "motion", "order", "deadline", "service")


def event_type(name: str | Column, kind: str | Column) -> Column:
    """Procedural or plain event; null for dates that only describe the file, bare ISO dates, nameless dates and those of noise types."""
    n, k = F.trim(F.coalesce(col(name), F.lit(""))), F.lower(F.coalesce(col(kind), F.lit("")))
    none = (n == "") | F.lower(n).isin(*DATE_NAMES) | n.rlike(r"^\d{4}-\d{2}-\d{2}$") | k.isin(*NOISE_DATES)
    return F.when(none, None).when(k.isin(*PROCEDURAL_DATES), "procedural_event").otherwise("event")


def estimate_pages(position: str, length: str, first: str, last: str) -> Column:
    """Page at a share of a section's text, rounded half to even."""
    return F.bround(F.col(first) + (F.col(last) - F.col(first)) * F.col(position) / F.nullif(F.col(length), F.lit(0)), 0).cast("bigint")


def answer_confidence(links: str, top: str, graph: str, synthetic: str) -> Column:
    raw = 0.5 + F.least(0.05 * F.col(links), F.lit(0.25)) + F.when(F.col(top) >= 0.75, 0.10).otherwise(0.0) + F.when(F.col(graph), 0.10).otherwise(0.0) - F.when(F.col(synthetic), 0.05).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 2)


def path_part(c: str | Column, k: int, default: str | None = None) -> Column:
    """k-th part of bucket/folder/.../name; the default where a path has fewer than three."""
    parts = F.split(F.regexp_replace(col(c), "^/+|/+$", ""), "/")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(k))).otherwise(default)


def heading_level(c: str | Column) -> Column:
    """Level of a heading line by its style, null for other lines."""
    t = F.trim(col(c))
    styles = [(r"^(ARTICLE|CHAPTER|PART) [IVXLC\d]+", 0), (r"^(COUNT|CAUSE) [IVXLC\d]+", 0), (r"^[IVXLC]+\. \S", 0), (r"^[A-Z]\. \S", 1), (r"^\d+\. \S", 1), (r"^\d+\.\d+ \S", 2), (r"^\([a-z]\) \S", 3), (r"^[A-Z][A-Z ]{4,60}$", 0)]
    return reduce(lambda out, s: F.when(t.rlike(s[0]), s[1]).otherwise(out), reversed(styles), F.lit(None).cast("int"))


#: Styles of headings by name, each with its pattern and level.
HEADING_STYLES = {
    "I.": (r"^[IVX]+\.\s+[A-Z]", 1),
    "1.": (r"^\d{1,3}\.\s+[A-Z]", 1),
    "A.": (r"^[A-Z]\.\s+[A-Z]", 2),
    "a.": (r"^[a-z]\.\s+[A-Za-z]", 3),
    "1)": (r"^\d+\)\s+[A-Za-z]", 2),
    "a)": (r"^[a-z]\)\s+[A-Za-z]", 3),
    "A)": (r"^[A-Z]\)\s+[A-Za-z]", 2),
    "(a)": (r"^\([a-z]\)\s+[A-Za-z]", 3),
    "(A)": (r"^\([A-Z]\)\s+[A-Za-z]", 2),
    "(i)": (r"^\([ivx]+\)\s+[A-Za-z]", 3),
    "1.1": (r"^\d+\.\d+[\s\.\:]", 2),
    "1.1.1": (r"^\d+\.\d+\.\d+[\s\.\:]", 3),
    "Article": (r"^Article\s+[IVX\d]", 1),
    "Chapter": (r"^Chapter\s+[IVX\d]", 1),
    "Section": (r"^Section\s+\d+(?!\.\d)", 1),
    "Part": (r"^Part\s+[IVX\d]", 1),
}


def heading_level_by(c: str | Column, styles: str | Column) -> Column:
    """Level of a line by the first of its document's styles (an array of names) that it has; unknown names fit nothing."""
    t = F.regexp_replace(col(c), r"\A\s+|\s+\z", "")
    level = lambda name: reduce(lambda out, s: F.when((name == s[0]) & t.rlike(s[1][0]), s[1][1]).otherwise(out), HEADING_STYLES.items(), F.lit(None).cast("int"))
    return F.get(F.filter(F.transform(styles, level), lambda x: x.isNotNull()), F.lit(0))


def search_text(title: str, text: str) -> Column:
    """What keyword search reads of a section: its title and its text."""
    return F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.col(text))


def by_words(c: str | Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first value one of whose words lies in the lower-cased column."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return reduce(lambda out, r: F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in r[1])), r[0]).otherwise(out), reversed(rules), F.lit(default))


# Words of a document type, or of an exhibit's title and first text, that decide its kind, in the order in which they are tried.
GRAPH_KINDS = [
    ("contract", ("contract", "agreement", "nda", "license", "lease", "purchase")),
    ("complaint", ("complaint", "pleading", "petition", "counterclaim")),
    ("brief", ("appeal", "brief", "motion", "opposition", "reply brief")),
    ("court_order", ("order", "opinion", "judgment", "ruling", "decision")),
    ("answer", ("answer", "response", "admission", "denial")),
]
EXHIBIT_KINDS = [
    ("Declaration", ("declaration of", "i declare", "under penalty of perjury")),
    ("Order", ("order", "it is hereby ordered", "it is so ordered")),
    ("Contract", ("agreement", "contract", "license", "term sheet")),
    ("Subpoena", ("subpoena",)),
    ("Deposition", ("deposition", "transcript", "q.")),
    ("Motion", ("motion", "memorandum", "brief", "reply")),
    ("Complaint", ("complaint", "petition")),
    ("Correspondence", ("letter", "correspondence", "email", "dear")),
    ("Discovery", ("privilege log",)),
]
EVIDENCE_KINDS = [("exhibit", ("exhibit",)), ("declaration", ("decl",)), ("deposition", ("dep",)), ("declaration", ("affidavit",))]
STAGE_PREFIXES = [("discovery", "discovery"), ("pleading - appeal", "appeal"), ("pleading - motion", "motions"), ("court - trial", "trial"), ("court - scheduling", "motions"), ("pleading - complaint", "filing"), ("pleading - amended", "filing")]
FOLDERS = [("pleading", "pleadings"), ("exhibit", "evidence"), ("discovery", "discovery"), ("contract", "contracts"), ("communication", "correspondence"), ("financial", "evidence"), ("corporate", "administrative"), ("evidence", "evidence"), ("regulatory", "administrative"), ("court", "court-orders"), ("administrative", "administrative")]
GATE_KINDS = [
    ("appeal", ("appeal", "brief", "motion", "memorandum", "opposition", "petition")),
    ("complaint", ("pleading", "complaint", "answer", "counterclaim")),
    ("court_order", ("opinion", "order", "judgment", "ruling", "decision", "decree")),
    ("discovery", ("interrogator", "request for production", "subpoena", "deposition", "discovery")),
    ("exhibit", ("exhibit", "attachment", "schedule", "appendix")),
]


def graph_kind(c: str | Column) -> Column:
    """Kind of a document for edges between documents."""
    return by_words(c, GRAPH_KINDS, "other")


def gate_kind(c: str | Column) -> Column:
    """Kind of a document for the rules within it."""
    return F.when(F.lower(F.ltrim(col(c))).startswith("contract"), "contract").otherwise(by_words(c, GATE_KINDS, "other"))


def exhibit_kind(title: str, text: str) -> Column:
    return by_words(F.expr(f"concat({title}, ' ', substring({text}, 1, 500))"), EXHIBIT_KINDS, "Exhibit")


def evidence_kind(c: str | Column) -> Column:
    return by_words(c, EVIDENCE_KINDS, "document")


def case_stage(c: str | Column) -> Column:
    return by_rules(c, STAGE_PREFIXES, "filing")


def folder_of(c: str | Column) -> Column:
    """Folder by the part of the type before the dash."""
    head = F.trim(F.lower(F.split(col(c), " - ")[0]))
    return F.coalesce(reduce(lambda out, r: F.when(head == r[0], r[1]).otherwise(out), reversed(FOLDERS), F.lit("administrative")), F.lit("administrative"))


def snippet(title: str, text: str) -> Column:
    """Fewer characters of the text the more its title says."""
    words = f"length(trim(coalesce({title}, '')))"
    return F.expr(f"substring({text}, 1, CASE WHEN {words} >= 25 THEN 200 WHEN {words} >= 10 THEN 400 ELSE 800 END)")


def embedding_input(doc_type: str, label: str, title: str, text: str, most: int = 28_000) -> Column:
    head = F.concat_ws(" ", F.concat(F.lit("["), F.col(doc_type), F.lit("]")), F.concat(F.lit("["), F.col(label), F.lit("]")), F.col(title))
    return F.substring(F.concat(head, F.lit("\n\n"), F.coalesce(text, F.lit(""))), 1, most)


#: File extension to container.
CONTAINERS = [("eml", "native_mail"), ("msg", "native_mail"), ("html", "html"), ("htm", "html"), ("txt", "text"), ("md", "text"), ("png", "image"), ("jpg", "image"), ("jpeg", "image")]


def container_kind(name: str, header: str) -> Column:
    """Kind of a file by its extension and, for tables, by the names in its header."""
    ext = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    low = F.transform(F.coalesce(header, F.array()), F.lower)
    table = F.when(F.array_contains(low, "from") & F.array_contains(low, "subject"), "structured_mail_table").when(F.array_contains(low, "raw") | F.array_contains(low, "message"), "raw_mail_table").otherwise("data_table")
    out = reduce(lambda o, r: F.when(ext == r[0], r[1]).otherwise(o), reversed(CONTAINERS), F.lit("unknown"))
    return F.when(ext.isin("csv", "xlsx", "json"), table).otherwise(out)
