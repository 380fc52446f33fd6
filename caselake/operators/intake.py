"""Routing of incoming files to cases, admission and folders; the same functions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.scalar import docket_number
from caselake.operators.windows import first_seen

STAGE = ("item_id", "case_id", "confidence", "stage", "candidates")


def route_by_hint(items: DataFrame, cases: DataFrame, most: int = 5) -> DataFrame:
    """Case by hint: its id (0.99), its only name match (0.95), or several (0.5, with up to ``most`` candidates).

    Distinct hints meet the names that hold their rarest trigram; the exact test follows.
    """
    c = cases.select("firm_id", F.col("case_id").alias("c_id"), F.lower("case_name").alias("c_name"))
    by_id = items.join(c, (items["firm_id"] == c["firm_id"]) & (F.col("hint") == F.col("c_id").cast("string"))).select("item_id", F.col("c_id").alias("case_id"), F.lit(0.99).alias("confidence"), F.lit("hint_id").alias("stage"), F.lit(None).cast("string").alias("candidates"))
    grams = lambda x: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, 3)))).alias("g")
    known = c.filter(F.length("c_name") > 2).select("firm_id", "c_id", "c_name", grams("c_name"))
    often = known.groupBy("firm_id", "g").agg(F.count("*").alias("df"))
    hints = items.filter(F.length("hint") > 2).select("firm_id", F.lower("hint").alias("hint")).distinct()
    rarest = hints.select("firm_id", "hint", grams("hint")).join(often, ["firm_id", "g"]).groupBy("firm_id", "hint").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    named = rarest.join(known, ["firm_id", "g"]).filter(F.contains("c_name", "hint")).select("firm_id", "hint", "c_id")
    hits = items.withColumn("hint", F.lower("hint")).join(named, ["firm_id", "hint"]).groupBy("item_id").agg(F.count("*").alias("n"), F.min("c_id").alias("first"), F.slice(F.array_sort(F.collect_list("c_id")), 1, most).alias("ids"))
    by_name = hits.select("item_id", F.when(F.col("n") == 1, F.col("first")).alias("case_id"), F.when(F.col("n") == 1, 0.95).otherwise(0.5).alias("confidence"), F.lit("hint_name").alias("stage"), F.when(F.col("n") > 1, F.array_join(F.col("ids").cast("array<string>"), ",")).alias("candidates"))
    return by_id.unionByName(by_name.join(by_id.select("item_id"), "item_id", "left_anti"))


def route_by_name(items: DataFrame, cases: DataFrame) -> DataFrame:
    """Case by file name: its docket number when unique (0.88), else two common words of four letters or more (0.75)."""
    c = cases.select("firm_id", F.col("case_id").alias("c_id"), "case_name", docket_number("docket").alias("docket"))
    i = items.withColumn("docket", docket_number("file_name"))
    dockets = i.filter("docket IS NOT NULL").join(c, ["firm_id", "docket"]).groupBy("item_id").agg(F.count("*").alias("n"), F.min("c_id").alias("case_id")).filter("n = 1").select("item_id", "case_id", F.lit(0.88).alias("confidence"), F.lit("docket").alias("stage"), F.lit(None).cast("string").alias("candidates"))
    words = lambda x: F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 3)))
    common = i.select("item_id", "firm_id", words("file_name").alias("w")).join(c.select("firm_id", "c_id", words("case_name").alias("w")), ["firm_id", "w"]).groupBy("item_id", "c_id").agg(F.count("*").alias("n")).filter("n >= 2")
    best = first_seen(common, ["item_id"], F.col("n").desc(), F.col("c_id")).select("item_id", F.col("c_id").alias("case_id"), F.lit(0.75).alias("confidence"), F.lit("words").alias("stage"), F.lit(None).cast("string").alias("candidates"))
    return dockets.unionByName(best.join(dockets.select("item_id"), "item_id", "left_anti"))


def route(items: DataFrame, cases: DataFrame, extra: DataFrame | None = None, confirm: float = 0.85) -> DataFrame:
    """All items with their best route: confirmed from ``confirm`` on, else waiting."""
    stages = route_by_hint(items, cases).withColumn("_o", F.lit(0)).unionByName(route_by_name(items, cases).withColumn("_o", F.lit(1)))
    if extra is not None:
        stages = stages.unionByName(extra.select(*STAGE).withColumn("_o", F.lit(2)))
    sure = F.col("confidence") >= confirm
    best = first_seen(stages, ["item_id"], (~sure).cast("int"), F.when(sure, F.col("_o")).otherwise(99), F.col("confidence").desc(), F.col("_o")).drop("_o")
    return items.select("item_id").join(best, "item_id", "left").withColumn("status", F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) >= confirm, "confirmed").otherwise("awaiting_confirmation"))


def admit(uploads: DataFrame, queue: DataFrame) -> DataFrame:
    """Uploads with the queue's row of the same tenant and content, if any; those for a named case are confirmed at once."""
    known = queue.groupBy("firm_id", "file_hash").agg(F.min("intake_id").alias("existing_id"))
    rows = uploads.join(known, ["firm_id", "file_hash"], "left")
    return rows.withColumn("decision", F.when(F.col("existing_id").isNotNull(), "duplicate").when(F.col("case_id").isNotNull(), "confirmed").otherwise("pending")).withColumn("priority", F.when(F.col("decision") == "confirmed", "immediate").otherwise("soon"))


def fine_route(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """Parent folder by type; the suggested sub-folder only where the case has it. folders: case_id, folder_json."""
    from caselake.functions.scalar import by_rules

    parent = by_rules("document_type", [("pleading", "pleadings"), ("contract", "contracts"), ("court", "orders"), ("discovery", "discovery")], "other")
    conf = F.from_json("folder_json", "map<string,array<string>>")
    rows = docs.withColumn("parent", parent).join(folders, "case_id", "left")
    return rows.withColumn("sub", F.when(F.coalesce(F.array_contains(F.try_element_at(conf, F.col("parent")), F.col("suggestion")), F.lit(False)), F.col("suggestion"))).drop("folder_json")


def ready_items(queue: DataFrame, modes: tuple[str, ...], n: int) -> DataFrame:
    """The next n confirmed items of the given modes by priority and age."""
    from caselake.operators.aggregates import ranked

    order = F.expr("CASE process_priority WHEN 'immediate' THEN 0 WHEN 'soon' THEN 1 WHEN 'overnight' THEN 2 ELSE 3 END")
    return ranked(queue.filter((F.col("status") == "confirmed") & F.col("process_priority").isin(list(modes))), [order, F.col("created_at"), F.col("intake_id")], n)


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue with the user's last decision in place of the suggestion."""
    last = first_seen(decisions, ["intake_id"], F.col("decided_at").desc(), F.col("decision_id").desc()).select("intake_id", F.col("case_id").alias("_case"))
    return queue.join(last, "intake_id", "left").withColumn("case_id", F.coalesce("_case", "case_id")).withColumn("decided", F.col("_case").isNotNull()).drop("_case")


def apply_routing(files: DataFrame, rules: DataFrame, default_bucket: str = "inbox", default_mode: str = "soon") -> DataFrame:
    """Bucket and mode by the rule whose list holds the file's type. rules: document_types, bucket, mode."""
    r = rules.select(F.explode("document_types").alias("document_type"), "bucket", "mode")
    return files.join(r, "document_type", "left").withColumn("bucket", F.coalesce("bucket", F.lit(default_bucket))).withColumn("mode", F.coalesce("mode", F.lit(default_mode)))


def propose_folders(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sub-folders of each case's matter type, or of the general one. catalog: matter_type, folder, label, ord."""
    c = catalog
    own = cases.join(c, "matter_type")
    rest = cases.join(catalog.select("matter_type").distinct(), "matter_type", "left_anti").withColumn("matter_type", F.lit("general")).join(c, "matter_type")
    rows = own.unionByName(rest)
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "folder", "label"))).alias("l")).select("case_id", F.expr("array_join(transform(l, x -> concat(x.folder, '=', x.label)), ';')").alias("folders"))


def valid_channels(keys: DataFrame, channels: DataFrame, now: str) -> DataFrame:
    """Channels that an active key of the same tenant opens at time ``now``."""
    live = keys.filter(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    return live.join(channels.filter("enabled"), ["channel_id", "firm_id"]).select("key_hash", "channel_id", "firm_id")


def explode_attachments(payloads: DataFrame, types: tuple[str, ...] = ("application/pdf", "text/plain", "text/html")) -> DataFrame:
    """One row per attachment of an accepted type. payloads: payload_id, json."""
    schema = "sender string, attachments array<struct<name: string, mime: string, size: bigint>>"
    rows = payloads.select("payload_id", F.from_json("json", schema).alias("p")).select("payload_id", "p.sender", F.posexplode("p.attachments").alias("pos", "a"))
    return rows.select("payload_id", "sender", "pos", "a.*").filter(F.lower("mime").isin(list(types)))
