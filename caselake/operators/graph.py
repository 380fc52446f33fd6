"""Entities and the knowledge graph: flattening, de-duplication, resolution, edges, paths, timelines."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caselake.functions.scalar import date_sort_key, gate_kind, graph_kind, norm_authority, norm_party
from caselake.operators.relational import match_evidence_ref, shuffled, union_edges
from caselake.operators.structure import ratio, rule_array
from caselake.operators.windows import first_seen


#: Fixed value: the setting by which Spark deletes an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read back, so that loops don't grow a lineage or estimates: in the cluster's shared checkpoint folder.

    The write's shuffle files go when it ends, not when the driver's memory is next cleaned: nothing reads them again.
    """
    path, conf = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from ``kept`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_kept_path", None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where driver and executors are one process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-kept-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# -- flattening ------------------------------------------------------------------------------

ENTITY_KINDS = ("parties", "dates", "amounts", "authorities", "obligations", "conditions", "courts")
_ENTITY = "array<struct<name: string, value: string, confidence: double, role: string>>"
ENTITY_SCHEMA = ", ".join(f"{k} {_ENTITY}" for k in ENTITY_KINDS)


def flatten_entities(results: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per entity of a nested extraction result. results: section_id, json; broken JSON gives nothing."""
    parsed = results.select("section_id", F.from_json("json", ENTITY_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    tag = lambda kind: lambda e: F.struct(F.lit(kind).alias("kind"), e["name"].alias("name"), e["value"].alias("value"), e["confidence"].alias("confidence"), e["role"].alias("role"))
    tagged = F.flatten(F.array(*[F.coalesce(F.transform(f"r.{k}", tag(k)), F.array()) for k in ENTITY_KINDS]))
    rows = parsed.select("section_id", F.explode(tagged).alias("e")).select("section_id", "e.*")
    return rows.filter((F.col("confidence") >= least) & (F.trim("name") != "")).withColumn("needs_review", F.col("confidence") < 0.7)


STRUCTURE_SCHEMA = """claims array<struct<label: string, counts: array<struct<number: int, label: string,
 elements: array<struct<number: int, text: string>>, defenses: array<struct<number: int, label: string>>, allegations: array<struct<text: string, element: int, evidence: array<string>>>>>>>,
 theories array<struct<name: string, count_number: int, count_label: string>>"""


def flatten_structure(results: DataFrame) -> dict[str, DataFrame]:
    """Claims, counts, elements, defences, allegations, evidence links and theories of nested results (document_id, json), with ids made from places."""
    r = kept(results.select("document_id", F.from_json("json", STRUCTURE_SCHEMA).alias("r")))  # parsed once for all tables
    ident = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    claims = r.select("document_id", F.posexplode("r.claims").alias("i", "c")).withColumn("claim_id", ident("document_id", "i"))
    counts = claims.select("document_id", "claim_id", F.posexplode("c.counts").alias("j", "n")).withColumn("count_id", ident("claim_id", "j"))
    elements = counts.select("count_id", F.explode("n.elements").alias("e")).select("count_id", F.col("e.number").alias("number"), F.col("e.text").alias("text"), F.concat_ws("#", "count_id", F.col("e.number").cast("string")).alias("element_id"))
    allegations = counts.select("count_id", F.posexplode("n.allegations").alias("k", "a")).withColumn("allegation_id", ident("count_id", "k"))
    defenses = counts.select("count_id", F.explode("n.defenses").alias("d")).select("count_id", F.col("d.number").alias("number"), F.col("d.label").alias("label"))
    links = allegations.select("allegation_id", F.explode("a.evidence").alias("ref"))
    theories = r.select("document_id", F.posexplode("r.theories").alias("t", "x")).select("document_id", ident("document_id", "t").alias("theory_id"), "x.*")
    return {
        "claims": claims.select("document_id", "claim_id", F.col("c.label").alias("label")),
        "counts": counts.select("document_id", "claim_id", "count_id", F.col("n.number").alias("number"), F.col("n.label").alias("label")),
        "elements": elements,
        "defenses": defenses,
        "allegations": allegations.select("count_id", "allegation_id", F.col("a.text").alias("text"), F.col("a.element").alias("element")),
        "evidence_links": links,
        "theories": theories,
    }


def link_theories(theories: DataFrame, counts: DataFrame) -> DataFrame:
    """Theories to counts by number, else by label."""
    by_number = theories.join(counts, (theories["document_id"] == counts["document_id"]) & (theories["count_number"] == counts["number"])).select("theory_id", "count_id")
    by_label = theories.join(counts, (theories["document_id"] == counts["document_id"]) & (F.lower("count_label") == F.lower("label"))).select("theory_id", "count_id")
    return by_number.unionByName(by_label.join(by_number.select("theory_id").distinct(), "theory_id", "left_anti")).distinct()


def link_elements(allegations: DataFrame, elements: DataFrame) -> DataFrame:
    e = elements.select("count_id", F.col("number").alias("element"), "element_id")
    return allegations.join(e, ["count_id", "element"], "left")


def fill_schema(counts: DataFrame, present: DataFrame, schema: DataFrame, confidence: float = 0.6) -> DataFrame:
    """Elements that a count's claim type asks for and that it lacks, numbered. schema: claim_type, ord, element."""
    wanted = counts.join(schema, "claim_type")
    missing = wanted.join(present.select("count_id", "element").distinct(), ["count_id", "element"], "left_anti")
    n = F.row_number().over(Window.partitionBy("count_id").orderBy("ord"))
    return missing.select("count_id", n.alias("number"), "element", F.lit(confidence).alias("confidence"))


def demote_factual(claims: DataFrame, factual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims that stay, and those of factual sections, which become allegations."""
    return claims.join(factual, "section_id", "left_anti"), claims.join(factual, "section_id", "left_semi").withColumnRenamed("label", "allegation")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One node per document, type and normalised label: the first by id, with how many it stands for."""
    return nodes.groupBy("document_id", "node_type", F.lower(F.trim("node_label")).alias("norm")).agg(F.min("node_id").alias("node_id"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set(F.col("section_id").cast("string"))), ",").alias("sections"))


# -- similarity ------------------------------------------------------------------------------


def bigrams(c: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, 2)))


def similar_pairs(labels: DataFrame, threshold: float = 0.85, scope: tuple[str, ...] = ("case_id", "node_type")) -> DataFrame:
    """(scope, a, b, score, method): pairs of distinct normalised labels of a scope whose ratio reaches the threshold (similarity), or one of which (3 characters or more) lies in the other (substring, without a score).

    labels: scope columns and norm. Let U = 2 n (1 - t) / t, which bounds the
    unmatched characters of a label of n characters and any partner. They and the
    gaps between matching blocks spoil at most 2 U of its bigrams, so that a pair
    must share one of the label's first 2 U + 1 in any fixed order; the rarest come
    first. (For t of 0.8 or more, labels of 6 characters in all always share one.)
    """
    rows = kept(labels.select(*scope, "norm").distinct().withColumn("n", F.length("norm")).filter("n > 0"))
    # labels' bigrams and trigrams are many times the labels: both sides of their joins are shuffled
    grams = rows.select(*scope, "norm", "n", F.explode(bigrams("norm")).alias("g"))
    often = grams.groupBy(*scope, "g").agg(F.count("*").alias("df"))
    ranked = grams.join(shuffled(often), [*scope, "g"]).withColumn("k", F.row_number().over(Window.partitionBy(*scope, "norm").orderBy("df", "g")))
    prefix = ranked.filter(F.col("k") <= 2 * F.ceil(2 * F.col("n") * (1 - threshold) / threshold) + 2)
    a = prefix.select(*scope, "g", F.col("norm").alias("a"), F.col("n").alias("na"))
    b = grams.select(*scope, "g", F.col("norm").alias("b"), F.col("n").alias("nb"))
    fit = F.least("na", "nb") / F.greatest("na", "nb") >= threshold / (2 - threshold)
    near = a.join(shuffled(b), [*scope, "g"]).filter((F.col("a") != F.col("b")) & fit).select(*scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = kept(near.withColumn("score", ratio("a", "b", threshold)).filter(F.col("score") >= threshold).withColumn("method", F.lit("similarity")))
    short = rows.filter("n >= 3").select(*scope, F.col("norm").alias("s"), F.substring("norm", 1, 3).alias("g3"))
    long_ = rows.filter("n > 3").select(*scope, F.col("norm").alias("l"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.substring("norm", i, 3)))).alias("g3"))
    inside = short.join(shuffled(long_), [*scope, "g3"]).filter((F.length("l") > F.length("s")) & F.col("l").contains(F.col("s"))).select(*scope, F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"))
    inside = inside.distinct().join(shuffled(near.select(*scope, "a", "b")), [*scope, "a", "b"], "left_anti")
    return near.unionByName(inside.withColumn("score", F.lit(None).cast("double")).withColumn("method", F.lit("substring")))


def same_label_pairs(nodes: DataFrame) -> DataFrame:
    """Each node with the first of its label in a smaller document: links enough to join a whole label, one per node."""
    w = Window.partitionBy("node_type", "norm").orderBy("document_id", "node_id")
    rows = nodes.withColumn("norm", F.lower(F.trim("node_label"))).withColumn("first_id", F.first("node_id").over(w)).withColumn("first_doc", F.first("document_id").over(w))
    return rows.filter("first_doc < document_id").select(F.col("node_id").alias("b"), F.col("first_id").alias("a"))


def match_party(names: DataFrame, parties: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Best party node of the same document for each name: equal (1.0), by ratio, or one within the other (the threshold). names: name_id, document_id, name.

    Equal names meet by an equi-join; a document's other names meet its parties by ``similar_to``. Each pair of texts of a document is scored once.
    """
    p = kept(parties.groupBy("document_id", norm_party("node_label").alias("y")).agg(F.min("node_id").alias("node_id")))
    own = p.select("document_id", F.col("y").alias("x"), "node_id")
    n = kept(names.select("name_id", "document_id", norm_party("name").alias("x")).join(shuffled(own), ["document_id", "x"], "left"))
    exact = n.filter("node_id IS NOT NULL").select("name_id", "node_id", F.lit(1.0).alias("score"))
    left = n.filter("node_id IS NULL").drop("node_id")
    pairs = similar_to(left.select("document_id", "x"), p.select("document_id", "y"), threshold, ("document_id",))
    inside = F.when((F.length("x") >= 3) & (F.length("y") >= 3) & (F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x"))), threshold).otherwise(0.0)
    near = pairs.withColumn("score", F.greatest(ratio("x", "y", threshold), inside)).filter(F.col("score") >= threshold)
    best = first_seen(near.join(shuffled(p), ["document_id", "y"]), ["document_id", "x"], F.col("score").desc(), F.col("node_id")).select("document_id", "x", "node_id", "score")
    scored = exact.unionByName(left.join(shuffled(best), ["document_id", "x"]).select("name_id", "node_id", "score"))
    return first_seen(scored, ["name_id"], F.col("score").desc(), F.col("node_id")).select("name_id", "node_id", "score")


def similar_to(own: DataFrame, others: DataFrame, threshold: float, scope: tuple[str, ...]) -> DataFrame:
    """(scope, x, y): the pairs of a text x of own and an unequal y of others in a scope that may reach the threshold by ratio, or one of which (3 characters or more) lies in the other.

    The blocking of ``similar_pairs`` from one side: x is sought by its first bigrams, the fewer of the others have one the earlier it comes. Others
    of scopes without own texts are left out first, and no pair within a side is made.
    """
    x = kept(own.select(*scope, "x").distinct().withColumn("n", F.length("x")).filter("n > 0"))
    y = kept(others.select(*scope, "y").distinct().withColumn("n", F.length("y")).filter("n > 0").join(shuffled(x.select(*scope).distinct()), [*scope], "left_semi"))
    grams = y.select(*scope, "y", F.col("n").alias("ny"), F.explode(bigrams("y")).alias("g"))
    often = grams.groupBy(*scope, "g").agg(F.count("*").alias("df"))
    ranked = x.select(*scope, "x", "n", F.explode(bigrams("x")).alias("g")).join(shuffled(often), [*scope, "g"], "left").withColumn("k", F.row_number().over(Window.partitionBy(*scope, "x").orderBy(F.coalesce("df", F.lit(0)), "g")))
    prefix = ranked.filter((F.col("k") <= 2 * F.ceil(2 * F.col("n") * (1 - threshold) / threshold) + 2) & F.col("df").isNotNull())
    fit = F.least("n", "ny") / F.greatest("n", "ny") >= threshold / (2 - threshold)
    alike = prefix.join(shuffled(grams), [*scope, "g"]).filter(fit)
    first = lambda c: F.substring(c, 1, 3).alias("g3")
    each = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.substring(c, i, 3)))).alias("g3")
    x3, y3 = x.filter("n >= 3"), y.filter("n >= 3")
    within = x3.select(*scope, "x", first("x")).join(shuffled(y3.select(*scope, "y", each("y"))), [*scope, "g3"]).filter(F.contains("y", "x"))
    around = y3.select(*scope, "y", first("y")).join(shuffled(x3.select(*scope, "x", each("x"))), [*scope, "g3"]).filter(F.contains("x", "y"))
    pairs = reduce(DataFrame.unionByName, [t.select(*scope, "x", "y") for t in (alike, within, around)])
    return pairs.filter("x <> y").distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): smallest node reachable over the undirected links (a, b), by min-label rounds with pointer jumping."""
    edges = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        moved = labels.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("_r2"))
        nxt = kept(moved.join(jump, "root", "left").select("node", F.least("root", F.coalesce("_r2", "root")).alias("root")))
        changed = nxt.join(labels.withColumnRenamed("root", "_was"), "node").filter("root <> _was").limit(1).count()
        forget(labels)
        labels = nxt
        if not changed:
            forget(edges)
            return labels
    raise RuntimeError("links did not settle")


def elect_canonical(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Canonical node of each node: the longest label of its component, then the smallest id."""
    rows = nodes.join(shuffled(comp.withColumnRenamed("node", "node_id")), "node_id", "left").withColumn("root", F.coalesce("root", "node_id"))
    best = rows.groupBy("root").agg(F.expr("min_by(node_id, struct(-length(node_label), node_id))").alias("canonical_id"))
    return rows.join(shuffled(best), "root").select("node_id", "canonical_id")


#: Similarity at which labels of a kind are one, within a document and across documents; 1 stands for equality.
WITHIN = {"party": 0.85, "legal_authority": 0.80}
ACROSS = {"party": 0.85, "legal_authority": 0.85, "evidence": 1.0}


def fuzzy_dedup(nodes: DataFrame, thresholds: dict[str, float] = WITHIN) -> DataFrame:
    """Near-duplicate nodes inside a document: (node_id, canonical_id)."""
    return elect_canonical(nodes, components(merge_log(nodes, "document_id", thresholds).select("a", "b")))


def resolve_entities(nodes: DataFrame, thresholds: dict[str, float] = ACROSS) -> DataFrame:
    """Nodes of a case's documents resolved to one node: (node_id, canonical_id)."""
    return elect_canonical(nodes, components(merge_log(nodes, "case_id", thresholds).select("a", "b")))


def normal_label(kind: str) -> Column:
    return {"party": norm_party, "legal_authority": norm_authority}.get(kind, lambda c: F.lower(F.trim(c)))("node_label")


def merge_log(nodes: DataFrame, scope: str, thresholds: dict[str, float]) -> DataFrame:
    """(a, b, node_type, score, method): the merges that join the nodes of a scope, enough of them to join all that belong together; nodes without a scope stay apart.

    Equal labels (exact) are joined with their first node; labels alike by ratio, or a party's within another's where the roles don't contradict, first node with first node. With a column ``role``, nodes of one label and several roles count by role.
    """
    rows = nodes if "role" in nodes.columns else nodes.withColumn("role", F.lit(None).cast("string"))
    logs = []
    for kind, threshold in thresholds.items():
        own = kept(rows.filter(F.col("node_type") == kind).filter(F.col(scope).isNotNull()).select("node_id", scope, "role", normal_label(kind).alias("norm")))
        first = own.groupBy(scope, "norm").agg(F.min("node_id").alias("first"), F.array_distinct(F.collect_set(F.coalesce("role", F.lit("")))).alias("roles"))
        log = own.join(shuffled(first), [scope, "norm"]).filter("node_id <> first").select(F.col("first").alias("a"), F.col("node_id").alias("b"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
        if threshold < 1:
            pairs = similar_pairs(own, threshold, (scope,))
            fa, fb = (first.select(scope, F.col("norm").alias(c), F.col("first").alias("i" + c), F.col("roles").alias("r" + c)) for c in "ab")
            both = pairs.join(shuffled(fa), [scope, "a"]).join(shuffled(fb), [scope, "b"])
            agree = F.array_contains("ra", "") | F.array_contains("rb", "") | F.arrays_overlap("ra", "rb")
            fuzzy = both.filter((F.col("method") == "similarity") | (agree & F.lit(kind == "party")))
            log = log.unionByName(fuzzy.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "score", "method"))
        logs.append(log.withColumn("node_type", F.lit(kind)))
    return reduce(DataFrame.unionByName, logs)


def chase(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root, ended) after following pointers (node, at; one per node) by doubling, and the nodes on cycles.

    Each round doubles the steps taken, so a chain takes the logarithm of its length. A node of some distance to its end implies
    nodes of all smaller distances, so rounds stop when none ended in the last one: what is open then leads
    into a cycle. From there on doubling shrinks the set of places reached to just the cycles.
    """
    cur, before = kept(pointers.selectExpr("node", "at", "node = at AS ended")), None
    while True:
        ahead = cur.selectExpr("node AS at", "at AS _at", "ended AS _ended")
        now = kept(cur.join(ahead, "at", "left").selectExpr("node", "coalesce(_at, at) AS at", "ended OR _at IS NULL OR _ended AS ended"))
        forget(cur)
        left = now.filter("NOT ended").count()
        cur = now
        if not left or left == before:
            break
        before = left
    if not left:
        return cur, cur.limit(0).select("node")
    open_, places = kept(cur.filter("NOT ended").select("node", "at")), None
    while True:
        reached = open_.select("at").distinct().count()
        if reached == places:
            return cur, open_.selectExpr("at AS node").distinct()
        places = reached
        now = kept(open_.join(open_.selectExpr("node AS at", "at AS _at"), "at").selectExpr("node", "_at AS at"))
        forget(open_)
        open_ = now


def follow_canonical(pointers: DataFrame) -> DataFrame:
    """(node, root): each node's pointer (node, target) followed to its end, a node that has no pointer or points at itself.

    A node on a cycle is its own root, one that leads into a cycle has the cycle's first node that it meets. Of several pointers of a node the smallest
    target counts; null nodes and targets are no pointers. A target that many nodes point at is one row on the joins' other side, so a
    popular root splits like any skewed join key.
    """
    one = kept(pointers.filter("node IS NOT NULL AND target IS NOT NULL").groupBy("node").agg(F.min("target").alias("at")))
    found, cycles = chase(one)
    if cycles.isEmpty():
        forget(one)
        return found.selectExpr("node", "at AS root")
    stops = kept(cycles)
    again = one.join(found.filter("NOT ended").select("node"), "node", "left_semi").join(stops.withColumn("_on", F.lit(True)), "node", "left").selectExpr("node", "IF(_on, node, at) AS at")
    into, _ = chase(again)
    forget(one)
    return found.filter("ended").selectExpr("node", "at AS root").unionByName(into.selectExpr("node", "at AS root"))


# -- edges -----------------------------------------------------------------------------------


def colocated(nodes: DataFrame, source: str, target: str, edge_type: str, confidence: float) -> DataFrame:
    """Edges between nodes of two types that share a section of a document."""
    s = nodes.filter(F.col("node_type") == source).select("document_id", "section_id", F.col("node_id").alias("src"))
    t = nodes.filter(F.col("node_type") == target).select("document_id", "section_id", F.col("node_id").alias("dst"))
    return s.join(t, ["document_id", "section_id"]).select("src", "dst", F.lit(edge_type).alias("edge_type"), F.lit(confidence).alias("confidence"))


def intra_edges(nodes: DataFrame) -> DataFrame:
    """Edges that follow from nodes sharing a section."""
    rules = [("claim", "legal_authority", "relies_on", 0.7), ("obligation", "party", "obligated_to", 0.7), ("party", "event", "involved_in", 0.6), ("claim", "evidence", "supported_by", 0.65)]
    out = None
    for rule in rules:
        e = colocated(nodes, *rule)
        out = e if out is None else out.unionByName(e)
    return out.distinct()


#: Kinds of documents in which rules about suits, and about contracts, apply.
SUITS, CONTRACTS = ("complaint", "appeal", "court_order"), ("contract", "exhibit")


def document_edges(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """All edges that follow from a document's own nodes: (src, dst, edge_type, confidence), each by the first rule that makes it.

    nodes: node_id, node_type, node_label, document_id, section_id, confidence, the names plaintiff, defendant, obligated_party,
    beneficiary_party, payer and payee, and evidence_references (array). Named parties are sought by ``match_party``, an inexact match costs 0.1;
    nodes that share a section are joined on it.
    """
    rows = kept(nodes.join(docs.select("document_id", gate_kind("document_type").alias("_kind")), "document_id").withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.8))))
    of = lambda *kinds: rows.filter(F.col("node_type").isin(*kinds))
    named = [
        (of("claim").filter(F.col("_kind").isin(*SUITS)), (("plaintiff", "alleged_by", False), ("defendant", "alleged_against", True))),
        (of("obligation").filter(F.col("_kind").isin(*CONTRACTS)), (("obligated_party", "obligated_to", False), ("beneficiary_party", "beneficiary_of", False))),
        (of("amount").filter(F.col("_kind").isin(*SUITS)), (("payee", "damages_sought_by", True), ("payer", "damages_from", True))),
    ]
    wanted = reduce(DataFrame.unionByName, [n.select("node_id", "document_id", "confidence", F.col(c).alias("name"), F.lit(t).alias("edge_type"), F.lit(out).alias("_out")) for n, cols in named for c, t, out in cols])
    wanted = kept(wanted.filter("trim(name) <> ''").withColumn("name_id", F.concat_ws("|", "node_id", "edge_type")))
    found = match_party(wanted.select("name_id", "document_id", "name"), of("party")).withColumnRenamed("node_id", "_party")
    by_name = wanted.join(shuffled(found), "name_id").select(F.when(F.col("_out"), F.col("node_id")).otherwise(F.col("_party")).alias("src"), F.when(F.col("_out"), F.col("_party")).otherwise(F.col("node_id")).alias("dst"), "edge_type", (F.col("confidence") - F.when(F.col("score") < 1, 0.1).otherwise(0.0)).alias("confidence"))
    refs = of("claim").select("node_id", "document_id", "confidence", F.posexplode("evidence_references").alias("k", "ref")).withColumn("ref_id", F.concat_ws("|", "node_id", F.col("k").cast("string")))
    cited = match_evidence_ref(refs.select("ref_id", "document_id", "ref"), of("evidence")).select("ref_id", "evidence_id")
    by_ref = refs.join(shuffled(cited), "ref_id").select(F.col("node_id").alias("src"), F.col("evidence_id").alias("dst"), F.lit("supported_by").alias("edge_type"), (F.col("confidence") - 0.05).alias("confidence"))
    # kind that gives the confidence, kind beside it, edge type, from the first to the second, penalty
    beside = [(("claim",), "legal_authority", "relies_on", True, 0.05), (("condition",), "obligation", "conditioned_on", False, 0.05), (("event", "procedural_event"), "party", "involved_in", False, 0.1), (("amount",), "claim", "quantifies", True, 0.05)]
    near = []
    for kinds, other, edge_type, out, penalty in beside:
        own = of(*kinds) if edge_type != "conditioned_on" else of(*kinds).filter(F.col("_kind").isin(*CONTRACTS))
        pairs = own.select("document_id", "section_id", F.col("node_id").alias("x"), "confidence").join(shuffled(of(other).select("document_id", "section_id", F.col("node_id").alias("y"))), ["document_id", "section_id"])
        near.append(pairs.select(F.col("x" if out else "y").alias("src"), F.col("y" if out else "x").alias("dst"), F.lit(edge_type).alias("edge_type"), (F.col("confidence") - penalty).alias("confidence")))
    out = union_edges(by_name, by_ref, *near)
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.0), "confidence"), 3))


def cross_edges(nodes: DataFrame, docs: DataFrame, labels: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Edges between a case's documents: (src, dst, edge_type, confidence).

    nodes: node_id, node_type, node_label, document_id, section_id, party and opponent (canonical ids of the obligated party or the defendant, and of the plaintiff), canonical_id of party nodes;
    docs: document_id, case_id, document_type; labels: section_id, semantic_label. breached_by: a contract's obligation to a claim that tells of a breach by the party obligated;
    challenges: a brief's argument to a holding whose section names a common party; responds_to: an admission or denial to a claim against the same party.
    """
    rows = nodes.join(docs.select("document_id", "case_id", graph_kind("document_type").alias("_kind")), "document_id").filter("case_id IS NOT NULL")
    rows = kept(rows.join(labels.select("section_id", F.coalesce("semantic_label", F.lit("")).alias("_label")), "section_id", "left").fillna("", ["_label"]))
    of = lambda node_type, kind: rows.filter((F.col("node_type") == node_type) & (F.col("_kind") == kind))
    edge = lambda df, name: df.select("src", "dst").distinct().withColumn("edge_type", F.lit(name)).withColumn("confidence", F.lit(confidence))
    claims = of("claim", "complaint")
    breach = breached_by(of("obligation", "contract"), claims.withColumn("claim_text", F.col("node_label")), confidence)
    present = rows.filter("node_type = 'party'").select("document_id", "section_id", "canonical_id").distinct()
    argued = of("claim", "brief").filter(F.col("_label").contains("argument")).join(present.select("document_id", "section_id", F.col("canonical_id").alias("_c")), ["document_id", "section_id"])
    held = of("claim", "court_order").filter(F.col("_label").rlike("holding|order|ruling|finding")).join(present.select("document_id", "section_id", F.col("canonical_id").alias("_c")), ["document_id", "section_id"])
    challenge = argued.select("case_id", "_c", F.col("node_id").alias("src")).join(held.select("case_id", "_c", F.col("node_id").alias("dst")), ["case_id", "_c"])
    against = F.coalesce("party", "opponent").alias("_c")
    reply = of("claim", "answer").filter(F.col("_label").rlike("admission|denial")).select("case_id", against, F.col("node_id").alias("src")).join(claims.select("case_id", against, F.col("node_id").alias("dst")), ["case_id", "_c"])
    return breach.select("src", "dst", "edge_type", "confidence").unionByName(edge(challenge, "challenges")).unionByName(edge(reply, "responds_to"))


EXHIBIT_LABEL = r"(?i)^\s*(?:exhibit|appendix|attachment|schedule)\s+([A-Z0-9](?:[-\u2013]?[A-Z0-9])*)"


def exhibit_links(nodes: DataFrame, docs: DataFrame, k: int = 10, least: float = 0.6) -> DataFrame:
    """Evidence of a case's pleadings to the first ``k`` nodes, parties first, of the exhibit that it names.

    The exhibit is the smallest document of the case whose file name carries the label (0.85), else the one whose type resembles
    the evidence's label most (ratio ``least``, 0.65); a case's distinct labels meet its distinct types.
    docs: document_id, case_id, file_name, document_type.
    """
    exhibits = docs.filter(F.lower("file_name").contains("_exhibit_")).select("case_id", F.col("document_id").alias("_exhibit"), F.regexp_extract(F.lower("file_name"), r"_exhibit_(.*)$", 1).alias("_tail"), norm_party("document_type").alias("_type"))
    kinds = docs.select("document_id", "case_id", graph_kind("document_type").alias("_kind")).filter(F.col("_kind").isin("complaint", "brief", "other"))
    own = nodes.filter("node_type = 'evidence'").join(kinds, "document_id").select("node_id", "case_id", "node_label", F.lower(F.regexp_extract("node_label", EXHIBIT_LABEL, 1)).alias("_label"))
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("_tail")), lambda n: F.substring("_tail", F.lit(1), n)))
    by_label = own.filter("_label <> ''").join(exhibits.filter("_tail <> ''").select("case_id", "_exhibit", ends.alias("_label")), ["case_id", "_label"]).groupBy("node_id").agg(F.min("_exhibit").alias("_exhibit")).withColumn("confidence", F.lit(0.85))
    rest = own.join(by_label.select("node_id"), "node_id", "left_anti").withColumn("_norm", norm_party("node_label"))
    types = exhibits.groupBy("case_id", "_type").agg(F.min("_exhibit").alias("_exhibit"))
    pairs = rest.select("case_id", "_norm").distinct().join(types, "case_id").withColumn("r", ratio("_norm", "_type", least)).filter(F.col("r") >= least)
    best = first_seen(pairs, ["case_id", "_norm"], F.col("r").desc(), F.col("_exhibit")).select("case_id", "_norm", "_exhibit")
    by_type = rest.join(best, ["case_id", "_norm"]).select("node_id", "_exhibit", F.lit(0.65).alias("confidence"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("node_type") != "party", "node_id"))
    targets = nodes.filter("node_type IN ('party', 'obligation')").withColumn("n", n).filter(F.col("n") <= k).select(F.col("document_id").alias("_exhibit"), F.col("node_id").alias("dst"))
    return by_label.unionByName(by_type).join(targets, "_exhibit").select(F.col("node_id").alias("src"), "dst", F.lit("exhibit_of").alias("edge_type"), "confidence")


def exhibit_edges(nodes: DataFrame, docs: DataFrame, k: int = 10, kind: str = "evidence") -> DataFrame:
    """Evidence to the parent document's nodes when its exhibit's file name carries the label: parties first, ``k`` each."""
    children = docs.filter("parent_document_id IS NOT NULL AND file_name LIKE '%exhibit%'").select("document_id", "parent_document_id")
    e = nodes.filter(F.col("node_type") == kind).join(children, "document_id").select(F.col("node_id").alias("src"), "parent_document_id")
    parents = nodes.join(children.select(F.col("parent_document_id").alias("document_id")).distinct(), "document_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("node_type") != "party", "node_id"))
    t = parents.withColumn("n", n).filter(F.col("n") <= k).select(F.col("document_id").alias("parent_document_id"), F.col("node_id").alias("dst"))
    return e.join(t, "parent_document_id").select("src", "dst", F.lit("exhibit_of").alias("edge_type"), F.lit(0.85).alias("confidence"))


def shared_party_edges(nodes: DataFrame, source_docs: DataFrame, target_docs: DataFrame, canonical: DataFrame, edge_type: str) -> DataFrame:
    """Documents of one kind to documents of another of the same case through a canonical party that both name."""
    p = nodes.filter("node_type = 'party'").join(canonical, "node_id").select("document_id", "canonical_id").distinct()
    s = source_docs.join(p, "document_id").select(F.col("document_id").alias("src"), "case_id", "canonical_id")
    t = target_docs.join(p, "document_id").select(F.col("document_id").alias("dst"), "case_id", "canonical_id")
    return s.join(t, ["case_id", "canonical_id"]).select("src", "dst").distinct().withColumn("edge_type", F.lit(edge_type))


#: Words in a claim that tell of a breach.
BREACH_WORDS = ("breach", "violat", "fail to perform", "non-performance", "default")


def breached_by(obligations: DataFrame, claims: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Contract obligations to complaint claims that tell of a breach by the party obligated.

    obligations: node_id, case_id, party (canonical, obligated); claims: node_id, case_id, claim_text, party (canonical, defendant).
    """
    words = F.lower("claim_text")
    told = claims.filter(F.col("party").isNotNull()).filter(words.rlike("|".join(BREACH_WORDS))).select("case_id", "party", F.col("node_id").alias("dst"))
    o = obligations.filter(F.col("party").isNotNull()).select("case_id", "party", F.col("node_id").alias("src"))
    return o.join(told, ["case_id", "party"]).select("src", "dst").distinct().withColumn("edge_type", F.lit("breached_by")).withColumn("confidence", F.lit(confidence))


def promote_case(cases: DataFrame, names: DataFrame) -> DataFrame:
    """Empty case fields filled from extracted names. names: case_id, plaintiff, defendant."""
    rows = cases.join(names, "case_id", "left")
    side = lambda own: F.when(F.col("party_role") == "plaintiff", F.col("plaintiff" if own else "defendant")).otherwise(F.col("defendant" if own else "plaintiff"))
    filled = lambda c, own: F.coalesce(F.nullif(F.trim(c), F.lit("")), side(own))
    return rows.withColumn("our_client", filled("our_client", True)).withColumn("opposing_party", filled("opposing_party", False)).select(cases.columns)


# -- analytics -------------------------------------------------------------------------------


def timeline(nodes: DataFrame, edges: DataFrame, procedural: bool = True) -> DataFrame:
    """Event nodes in order of date with the parties involved in them."""
    kinds = ["event", "procedural_event"] if procedural else ["event"]
    ev = nodes.filter(F.col("node_type").isin(kinds)).select("node_id", "node_type", "document_id", F.coalesce(date_sort_key("date_value"), F.lit("9999-99-99")).alias("date_key"))
    p = nodes.filter("node_type = 'party'").select(F.col("node_id").alias("src"), "node_label")
    who = edges.filter("edge_type = 'involved_in'").join(p, "src").groupBy(F.col("dst").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("node_label")), "|").alias("parties"))
    return ev.join(who, "node_id", "left")


TERMINALS = ("evidence", "legal_authority")


def evidence_paths(nodes: DataFrame, edges: DataFrame, max_hops: int = 3, least: float = 0.0, types: tuple[str, ...] = ("supported_by", "references", "relies_on", "exhibit_of", "quantifies")) -> DataFrame:
    """Simple paths from claims to evidence or authority over the listed edges, both ways, at most ``max_hops`` long.

    A path ends at the first terminal node, so no step leaves one against its edge. Edges are stored once, steps too with whether they end a path, and so is what each hop
    reaches: a hop is one equi-join on the frontier's last node, and the result reads stored rows but for the last hop's. Hops stop when no path is open.
    """
    allowed = edges.filter(F.col("edge_type").isin(list(types)) & (F.col("confidence") >= least) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    allowed = kept(allowed.select("src", "dst", F.col("confidence").cast("double").alias("c")))  # what made the edges is gone from disk before they are joined
    end = F.col("node_type").isin(list(TERMINALS))
    kinds, onward = nodes.filter("node_type IS NOT NULL").select("node_id", end.alias("end")), nodes.filter(~end).select(F.col("node_id").alias("dst"))
    ahead = allowed.join(kinds, F.col("dst") == F.col("node_id")).select(F.col("src").alias("u"), F.col("dst").alias("v"), "c", "end")
    back = allowed.join(onward, "dst", "left_semi").join(kinds, F.col("src") == F.col("node_id")).select(F.col("dst").alias("u"), F.col("src").alias("v"), "c", "end")
    step = kept(ahead.unionByName(back))
    forget(allowed)
    front = nodes.filter("node_type = 'claim'").select(F.array("node_id").alias("path"), F.lit(1.0).alias("confidence"))
    found = []
    for hop in range(1, max_hops + 1):
        nxt = front.withColumn("u", F.element_at("path", -1)).join(step, "u").filter(~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path"), F.least("confidence", "c").alias("confidence"), "end")
        if hop < max_hops:
            nxt = kept(nxt)
        found.append(nxt.filter("end").select(F.col("path")[0].alias("claim"), F.element_at("path", -1).alias("target"), F.array_join("path", ">").alias("path"), "confidence", F.lit(hop).alias("hops")))
        front = nxt.filter("NOT end").drop("end")
        if hop < max_hops and front.isEmpty():
            forget(step)
            break
    return reduce(DataFrame.unionByName, found)


def claim_bundles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    sums = paths.groupBy(F.col("claim").alias("node_id")).agg(F.count("*").alias("paths"), F.round(F.max("confidence"), 4).alias("best"))
    return nodes.filter("node_type = 'claim'").select("node_id").join(sums, "node_id", "left").withColumn("paths", F.coalesce("paths", F.lit(0))).withColumn("unsupported", F.col("paths") == 0)


def topo_levels(tasks: DataFrame, deps: DataFrame, most: int = 100_000) -> DataFrame:
    """Level of each task: 0 without prerequisites, else one more than the deepest of them; members of cycles, and what needs them, get -1. deps: task, needs.

    Tasks that hang together and have at most ``most`` links are settled in one task of Spark, such groups side by side; larger groups by rounds
    over the cluster, one a level. Links to unknown or null tasks count nothing, a null task has level 0.
    """
    own = tasks.select("task").distinct()
    waits = kept(deps.select("task", "needs").distinct().join(own.withColumnRenamed("task", "needs"), "needs", "left_semi").join(own, "task", "left_semi").select("task", "needs"))
    groups = components(waits.select(F.col("task").alias("a"), F.col("needs").alias("b"))).withColumnRenamed("node", "task")
    links = waits.join(groups, "task")
    large = kept(links.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("root"))
    schema = StructType([StructField("task", waits.schema["task"].dataType), StructField("level", IntegerType())])
    done = links.join(large, "root", "left_anti").groupBy("root").applyInPandas(levels_within, schema)
    if not large.isEmpty():
        done = done.unionByName(levels_by_rounds(links.join(large, "root", "left_semi").select("task", "needs")))
    return tasks.join(done, "task", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def levels_within(links: pd.DataFrame) -> pd.DataFrame:
    """Levels of the tasks of one group of links (task, needs): those that nothing holds back are settled and release what waits for them."""
    codes, names = pd.factorize(pd.concat([links["task"], links["needs"]], ignore_index=True))
    after, before = codes[: len(links)], codes[len(links) :]
    waiting = np.bincount(after, minlength=len(names))
    order = np.argsort(before, kind="stable")
    first = np.searchsorted(before[order], np.arange(len(names) + 1))
    level = np.full(len(names), -1, dtype=np.int32)
    ready = np.flatnonzero(waiting == 0)
    for depth in count():
        if not len(ready):
            break
        level[ready] = depth
        freed = np.concatenate([after[order[first[k] : first[k + 1]]] for k in ready])
        np.subtract.at(waiting, freed, 1)
        freed = np.unique(freed)
        ready = freed[waiting[freed] == 0]
    return pd.DataFrame({"task": names, "level": level})


def levels_by_rounds(waits: DataFrame) -> DataFrame:
    """(task, level) of all tasks of the links (task, needs): a round settles one level and hands on only what still waits; each is written to the shared folder."""
    spark = waits.sparkSession
    everyone = kept(waits.select("task").unionByName(waits.select(F.col("needs").alias("task"))).distinct())
    open_, waits = everyone, kept(waits)
    folder = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    for level in count():
        ready = open_.join(waits.select("task").distinct(), "task", "left_anti")
        ready.write.parquet(f"{folder}/level={level}")
        ready = spark.read.schema(open_.schema).parquet(f"{folder}/level={level}")
        if ready.isEmpty():
            break
        before = (open_, waits)
        open_ = kept(open_.join(ready, "task", "left_anti"))
        waits = kept(waits.join(ready.withColumnRenamed("task", "needs"), "needs", "left_anti"))
        forget(*(t for t in before if t is not everyone))
    done = spark.read.schema(StructType([*everyone.schema, StructField("level", IntegerType())])).parquet(folder)
    return everyone.join(done, "task", "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def numbered(df: DataFrame, *order: Column | str, to: str = "rank") -> DataFrame:
    """df with each row's number in a total order: ranges of the order are numbered side by side, each from the counts of those before it."""
    parts = kept(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_own", own).join(starts, "_p").withColumn(to, F.col("_before") + F.col("_own")).select(*df.columns, to)


def task_order(tasks: DataFrame, levels: DataFrame) -> DataFrame:
    """tasks (task, tier, layer, position) with rank: by level, then tier, layer and position, ties by task; members of cycles last."""
    rows = tasks.join(levels.select("task", "level"), "task").withColumn("_cycle", F.col("level") < 0)
    return numbered(rows, "_cycle", "level", "tier", "layer", "position", "task").drop("_cycle")


def detect_addons(docs: DataFrame, rules: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Templates that a case's document types call for, or its claims. rules: template, keyword, built, claims: case_id, label, where given."""
    table = rule_array(rules.filter("built").select("template", "keyword"))
    d = docs.filter("case_id IS NOT NULL").select("case_id", F.lower("document_type").alias("t"))
    if claims is not None:
        d = d.unionByName(claims.filter("case_id IS NOT NULL").select("case_id", F.lower("label").alias("t")))
    hits = F.filter(table, lambda r: F.col("t").contains(r["keyword"]))
    return d.distinct().select("case_id", F.explode(F.transform(hits, lambda r: r["template"])).alias("template")).distinct()


def task_context(tasks: DataFrame, deps: DataFrame, results: DataFrame, most: int = 2000) -> DataFrame:
    """One text of the finished prerequisites of each task, in order of their ids."""
    answer = F.when(F.col("status") == "failed", F.lit("(failed)")).otherwise(F.substring("answer", 1, most))
    r = results.select(F.col("task").alias("needs"), F.concat(F.col("task").cast("string"), F.lit(": "), answer).alias("line"))
    text = deps.join(r, "needs").groupBy("task").agg(F.array_sort(F.collect_list(F.struct("needs", "line"))).alias("l")).select("task", F.expr("array_join(transform(l, x -> x.line), '\\n')").alias("context"))
    return tasks.join(text, "task", "left")
