"""Filters, joins, set operations, upserts, retention and tenancy over document tables.

Every function takes and returns DataFrames and stays lazy; filters reach the
scan and only small dimensions are hinted for broadcast by Spark's own size check.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# -- sources and sinks -----------------------------------------------------------------------


def read_case_sections(sections: DataFrame, docs: DataFrame, case_id: int, document_id: int | None = None) -> DataFrame:
    """Sections of one case with their document's metadata."""
    own = docs.filter(F.col("case_id") == case_id)
    if document_id is not None:
        own = own.filter(F.col("document_id") == document_id)
    return sections.join(own.select("document_id", "case_id", "file_name", "document_type"), "document_id")


def incremental(df: DataFrame, ts: str, mark: str) -> DataFrame:
    """Rows changed after the last sync mark."""
    return df.filter(F.col(ts) > F.lit(mark).cast(df.schema[ts].dataType))


def new_only(listing: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return listing.join(known.select(*keys).distinct(), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of both, the last writer of each key winning."""
    return latest(target.unionByName(updates, allowMissingColumns=True), keys, *order)


def replace_by_key(target: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """target with all rows of the keys in ``fresh`` replaced by its rows."""
    return target.join(fresh.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(fresh)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], parent_ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose parent goes."""
    gone = parent_ids.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(gone, df[fk] == gone["_gone"], "left_anti") for name, (df, fk) in tables.items()}


def update_from(target: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """target with ``column`` taken from the patch where it has the key."""
    return target.join(patch.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(target.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(new_only(rows, target, key).select(target.columns))


def visible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def trash(df: DataFrame, now: str) -> DataFrame:
    return df.filter(F.col("deleted_at").isNotNull()).withColumn("age_days", F.datediff(F.lit(now).cast("timestamp"), "deleted_at"))


def purge(df: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Rows that stay when deleted ones are kept for ``days``."""
    return df.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))


def exhibits_to_documents(exhibits: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Child documents, which inherit their parent's case, and one section of level 0 for each."""
    p = parents.select(F.col("document_id").alias("parent_document_id"), "case_id", "corpus_id", F.col("file_name").alias("parent_name"))
    rows = exhibits.join(p, "parent_document_id")
    children = rows.select("document_id", "parent_document_id", "case_id", "corpus_id", F.concat_ws("#", "parent_name", "label").alias("file_name"))
    sections = rows.select("document_id", F.lit(0).alias("level"), F.col("label").alias("section_title"), F.col("text").alias("section_text"), F.lit(True).alias("is_synthetic"))
    return children, sections


def backfill_tenant(docs: DataFrame, cases: DataFrame, corpora: DataFrame, checks: Observation | None = None) -> DataFrame:
    """docs with firm_id filled from the case, else from the corpus.

    checks: an observation that holds, once the result has been written, what a validation would count in a second pass: rows, those without a firm,
    those whose case or corpus doesn't exist, and those whose case and corpus belong to different firms.
    """
    c = cases.select("case_id", F.col("firm_id").alias("_case_firm"), F.lit(True).alias("_case"))
    k = corpora.select("corpus_id", F.col("firm_id").alias("_corpus_firm"), F.lit(True).alias("_corpus"))
    out = docs.join(c, "case_id", "left").join(k, "corpus_id", "left").withColumn("firm_id", F.coalesce("_case_firm", "_corpus_firm"))
    if checks is not None:
        lost = (F.col("case_id").isNotNull() & F.col("_case").isNull()) | (F.col("corpus_id").isNotNull() & F.col("_corpus").isNull())
        torn = F.col("_case_firm") != F.col("_corpus_firm")
        out = out.observe(checks, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("firm_id").isNull()).alias("no_firm"), F.count_if(lost).alias("lost"), F.count_if(F.coalesce(torn, F.lit(False))).alias("torn"))
    return out.drop("_case", "_corpus")


# -- predicates ------------------------------------------------------------------------------


def structural_filter(df: DataFrame, document_types=None, labels=None, case_id=None, levels=None, document_ids=None) -> DataFrame:
    """Only the filters that are given apply."""
    if case_id is not None:
        df = df.filter(F.col("case_id") == case_id)
    if document_types:
        df = df.filter(F.col("document_type").isin(list(document_types)))
    if labels:
        df = df.filter(F.col("semantic_label").isin(list(labels)))
    if document_ids:
        df = df.filter(F.col("document_id").isin(list(document_ids)))
    if levels:
        df = df.filter(F.col("level").between(*levels))
    return df


def ilike_contains(column: str | Column, part: str) -> Column:
    """Case-insensitive substring; wildcards in the part stand for themselves."""
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{escaped}%")


def any_ilike(column: str, parts: list[str]) -> Column:
    return reduce(or_, (ilike_contains(column, p) for p in parts))


#: Beginnings of document types, and filing purposes, that qualify a document for structure extraction.
STRUCTURE_PREFIXES = ("complaint", "brief", "motion", "appeal", "answer", "counterclaim", "pleading")
STRUCTURE_PURPOSES = ("operative_pleading", "motion", "brief")


def qualifies_for_structure(document_type: str = "document_type", purpose: str | None = None) -> Column:
    """By the type's beginning or the purpose; a historical document also by a qualifying word anywhere in its type."""
    low = F.lower(F.coalesce(F.col(document_type), F.lit("")))
    out = reduce(or_, (low.startswith(p) for p in STRUCTURE_PREFIXES))
    if purpose:
        use = F.lower(F.coalesce(F.col(purpose), F.lit("")))
        out = out | use.isin(*STRUCTURE_PURPOSES) | ((use == "historical_context") & reduce(or_, (low.contains(p) for p in STRUCTURE_PREFIXES)))
    return out


def embedding_status(sections: DataFrame, existing: DataFrame, force: bool = False, skip_labels: tuple[str, ...] = ("signature_block",), least: int = 20) -> DataFrame:
    """sections with the reason why each is or isn't embedded, the first that holds."""
    e = existing.select("section_id", F.col("semantic_label").alias("_label"), F.col("text_hash").alias("_hash"), F.lit(True).alias("_there"))
    rows = sections.join(e, "section_id", "left")
    text = F.trim(F.coalesce("section_text", F.lit("")))
    status = (
        F.when(F.length(text) < least, "skip_empty")
        .when(F.col("semantic_label").isin(list(skip_labels)), "skip_label")
        .when(F.lit(force), "force")
        .when(F.col("_there").isNull(), "new")
        .when(~F.col("semantic_label").eqNullSafe(F.col("_label")) | ~F.sha2("section_text", 256).eqNullSafe(F.col("_hash")), "metadata_changed")
        .otherwise("up_to_date")
    )
    return rows.withColumn("status", status).drop("_label", "_hash", "_there")


def extraction_skip_reason(least: int = 50, micro: int = 200) -> Column:
    return (
        F.when(F.length(F.trim("section_text")) < least, "short")
        .when(F.lower("section_title").rlike("^(table of contents|certificate of service|signature)"), "boilerplate_title")
        .when(F.col("semantic_label") == "signature_block", "label")
        .when((F.length("section_text") < micro) & (F.col("level") > 0), "micro_section")
    )


def clamp(column: str, allowed: list[str], default: str) -> Column:
    return F.when(F.lower(F.trim(column)).isin(allowed), F.lower(F.trim(column))).otherwise(default)


def clamp_unit(column: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr(f"try_cast({column} AS double)")))


def safe_float(column: str) -> Column:
    return F.nanvl(F.expr(f"try_cast({column} AS double)"), F.lit(None).cast("double"))


def safe_int(column: str) -> Column:
    return F.floor(safe_float(column)).cast("bigint")


def safe_bool(column: str) -> Column:
    low = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)


def truncate(column: str | Column, n: int, keep: int, mark: str = "…") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep), F.lit(mark))).otherwise(c)


def compact_json(*columns: str) -> Column:
    """The record as JSON without its null attributes."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def json_get(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def json_merge(old: str, new: str) -> Column:
    """Both records' attributes, the new one's winning."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(parse(old), lambda k, v: ~F.array_contains(F.map_keys(parse(new)), k)), parse(new)))


def refine_candidates(sections: DataFrame, least: int = 6000) -> DataFrame:
    """Long sections that aren't split yet and don't bear a structural title."""
    return sections.filter((F.length("section_text") >= least) & ~F.lower(F.coalesce("section_title", F.lit(""))).rlike("^(table of contents|index|exhibits?$)"))


def structure_targets(sections: DataFrame) -> DataFrame:
    label = F.coalesce("semantic_label", F.lit(""))
    return sections.filter(label.isin("factual_allegations") | label.startswith("causes") | F.lower("section_title").rlike("^count "))


# -- joins -----------------------------------------------------------------------------------


def with_document(sections: DataFrame, docs: DataFrame) -> DataFrame:
    return sections.join(docs.select("document_id", "case_id", "file_name", "document_type", "lang"), "document_id")


def with_parent_context(sections: DataFrame) -> DataFrame:
    """sections with parent_context: the parent's title, else its first 80 characters."""
    p = sections.select(F.col("section_id").alias("parent_section_id"), F.coalesce(F.nullif(F.trim("section_title"), F.lit("")), F.substring("section_text", 1, 80)).alias("parent_context"))
    return sections.join(p, "parent_section_id", "left")


def with_file_name(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.join(docs.select("document_id", "file_name"), "document_id", "left")


def visible_documents(docs: DataFrame, corpora: DataFrame, cases: DataFrame, firm_id: int | None, shared: bool = True) -> DataFrame:
    """Documents a tenant sees: in its own corpora, in shared ones, or without corpus in its own cases. No tenant sees none."""
    if firm_id is None:
        return docs.limit(0)
    k = corpora.select("corpus_id", F.col("firm_id").alias("_kf"), F.col("is_shared").alias("_ks"))
    c = cases.select("case_id", F.col("firm_id").alias("_cf"))
    own = F.coalesce(F.col("_kf") == firm_id, F.lit(False))
    common = F.coalesce(F.col("_ks"), F.lit(False)) if shared else F.lit(False)
    loose = F.col("corpus_id").isNull() & F.coalesce(F.col("_cf") == firm_id, F.lit(False))
    return docs.join(k, "corpus_id", "left").join(c, "case_id", "left").filter(own | common | loose).select(docs.columns)


def visible_via(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Rows whose parent is visible."""
    ids = parent.select(F.col(pk or fk).alias("_pk")).distinct()
    return child.join(ids, child[fk] == ids["_pk"], "left_semi")


def validate_uploads(files: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files in an allowed bucket, and the rest."""
    return files.join(allowed, ["bucket"], "left_semi"), files.join(allowed, ["bucket"], "left_anti")


def as_of(df: DataFrame, keys: list[str], ts: str, when: str, *ties: Column) -> DataFrame:
    """The last row of each key at time ``when``."""
    return latest(df.filter(F.col(ts) <= F.lit(when).cast(df.schema[ts].dataType)), keys, F.col(ts).desc(), *ties)


def evidence_gaps(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Items without a link to a document."""
    return items.join(links.filter(F.col("document_id").isNotNull()).select(key), key, "left_anti")


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages between a section's first and last page, as an equi-join on the exploded range."""
    spans = sections.filter("start_page <= end_page").withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    return spans.join(pages, ["document_id", "page"])


def trim_parent(sections: DataFrame, exhibits: DataFrame) -> DataFrame:
    """Sections before the first exhibit page of their document."""
    first = exhibits.groupBy("document_id").agg(F.min("start_page").alias("_first"))
    return sections.join(first, "document_id", "left").filter(F.col("_first").isNull() | F.col("start_page").isNull() | (F.col("start_page") < F.col("_first"))).drop("_first")


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by shuffle: Spark sizes a side by its files, which are far smaller than rows in memory and don't count what explode adds, and would send it whole through the driver."""
    return df.hint("merge")


def match_evidence_ref(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """First evidence node of the document whose label equals the reference or either begins with the other.

    Both ways are equi-joins: the shorter text with each beginning of the longer one.
    """
    e = evidence.select("document_id", F.col("node_id").alias("evidence_id"), F.lower(F.trim("node_label")).alias("_label"))
    r = refs.withColumn("_ref", F.lower(F.trim("ref")))
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))
    longer = e.select("document_id", "evidence_id", starts("_label").alias("_ref")).groupBy("document_id", "_ref").agg(F.min("evidence_id").alias("evidence_id"))
    by_ref = r.join(shuffled(longer), ["document_id", "_ref"])
    shorter = r.select("document_id", "_ref").distinct().select("document_id", "_ref", starts("_ref").alias("_label")).join(shuffled(e), ["document_id", "_label"]).groupBy("document_id", "_ref").agg(F.min("evidence_id").alias("evidence_id"))
    by_label = r.join(shuffled(shorter), ["document_id", "_ref"])
    cols = ["ref_id", "document_id", "ref", "evidence_id"]
    return latest(by_ref.select(cols).unionByName(by_label.select(cols)), ["ref_id"], F.col("evidence_id")).select(cols)


def text_keys(c: str) -> Column:
    """Of a text of words: all that a text within another can be sought by, whole words (w) and substrings of one to three characters (g)."""
    words = F.transform(F.split(c, " "), lambda w: F.concat(F.lit("w"), w))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.concat(F.lit("g"), F.substring(F.col(c), i, F.lit(n))))
    return F.array_distinct(F.concat(words, *[F.when(F.length(c) >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))


def texts_within(short: DataFrame, long_: DataFrame) -> DataFrame:
    """(s, l): each text s that lies in a text l. An empty text lies in none.

    All words of s but its first and last are words of l, and all its trigrams are in l: s is sought by the one that the fewest l have.
    """
    words = F.split("s", " ")
    inner = F.transform(F.slice(words, F.lit(2), F.size(words) - 2), lambda w: F.concat(F.lit("w"), w))
    n = F.least(F.length("s"), F.lit(3))
    grams = F.transform(F.sequence(F.lit(0), F.length("s") - n), lambda i: F.concat(F.lit("g"), F.substring(F.col("s"), i + 1, n)))
    keys = short.filter("s <> ''").distinct().select("s", F.explode(F.array_distinct(F.when(F.size(words) > 2, inner).otherwise(grams))).alias("key"))
    held = long_.filter("l <> ''").distinct().select("l", F.explode(text_keys("l")).alias("key")).join(shuffled(keys.select("key").distinct()), "key", "left_semi")
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    rarest = keys.join(shuffled(often), "key", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).filter("k.n > 0")
    return rarest.select("s", "k.key").join(shuffled(held), "key").filter(F.col("l").contains(F.col("s"))).select("s", "l")


def resolve_case(folders: DataFrame, cases: DataFrame) -> DataFrame:
    """Case of each folder by the best rule: exact name, normalised name, containment; of several cases the smallest."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    c = cases.groupBy("case_name", norm("case_name").alias("_n")).agg(F.min("case_id").alias("case_id"))
    by_norm = c.groupBy("_n").agg(F.min("case_id").alias("case_id"))
    f = folders.select("folder", norm("folder").alias("_f")).distinct()
    exact = f.join(c, f["folder"] == c["case_name"]).withColumn("rule", F.lit(1))
    normal = f.join(by_norm, f["_f"] == by_norm["_n"]).withColumn("rule", F.lit(2))
    fs, ns = f.select(F.col("_f").alias("s")), by_norm.select(F.col("_n").alias("s"))
    pairs = texts_within(fs, ns.withColumnRenamed("s", "l")).toDF("_f", "_n").unionByName(texts_within(ns, fs.withColumnRenamed("s", "l")).toDF("_n", "_f"))
    least = pairs.join(by_norm, "_n").groupBy("_f").agg(F.min("case_id").alias("case_id"))
    inside = f.join(least, "_f").withColumn("rule", F.lit(3))
    cols = ["folder", "case_id", "rule"]
    return latest(exact.select(cols).unionByName(normal.select(cols)).unionByName(inside.select(cols)), ["folder"], F.col("rule"), F.col("case_id"))


def union_edges(*edges: DataFrame) -> DataFrame:
    """All edges, each (src, dst, type) by the first rule that made it."""
    ranked = [e.withColumn("_rule", F.lit(k)) for k, e in enumerate(edges)]
    return latest(reduce(lambda a, b: a.unionByName(b), ranked), ["src", "dst", "edge_type"], F.col("_rule"), F.col("confidence").desc()).drop("_rule")
