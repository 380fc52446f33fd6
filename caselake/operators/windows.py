"""Ordered work within a document, a case, a job or a conversation: one shuffle by that key, then window frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels_of(df: DataFrame, column: str = "level") -> list[int]:
    """The distinct levels of an outline, however deep; one column of few values comes to the driver."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def next_boundary(df: DataFrame, key: str, pos: str, last: Column) -> DataFrame:
    """df with ``stop``: where the next boundary of the key begins, else ``last``."""
    return df.withColumn("stop", F.coalesce(F.lead(pos).over(Window.partitionBy(key).orderBy(pos)), last))


def assign_end_pages(entries: DataFrame, total: Column) -> DataFrame:
    """End page of an outline entry: the page before the next entry of its level or above, at least its own start, else ``total``."""
    after = Window.partitionBy("document_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nxt = reduce(lambda c, k: F.when(F.col("level") == k, F.first(F.when(F.col("level") <= k, F.col("page")), ignorenulls=True).over(after)).otherwise(c), levels_of(entries), F.lit(None))
    return entries.withColumn("_next", nxt).withColumn("end_page", F.when(F.col("_next").isNull(), F.greatest("page", total)).otherwise(F.greatest("page", F.col("_next") - 1))).drop("_next")


def build_parents(sections: DataFrame, order: str = "pos") -> DataFrame:
    """Parent: the nearest section before of a strictly smaller level."""
    before = Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = reduce(lambda c, k: F.when(F.col("level") == k, F.last(F.when(F.col("level") < k, F.col("section_id")), ignorenulls=True).over(before)).otherwise(c), levels_of(sections), F.lit(None))
    return sections.withColumn("parent_section_id", parent)


def fill_forward(df: DataFrame, key: str, pos: str, value: str, to: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def boundary_context(lines: DataFrame, marker: Column) -> DataFrame:
    """Lines since the last page marker, and blank lines just before."""
    upto = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    since = F.col("pos") - F.max(F.when(marker, F.col("pos"))).over(upto)
    filled = F.coalesce(F.max(F.when(F.trim("line") != "", F.col("pos"))).over(before), F.lit(-1))
    return lines.withColumn("since_marker", since).withColumn("blanks_before", F.col("pos") - 1 - filled)


def first_seen(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def suffix_duplicates(df: DataFrame, key: str, label: str, *order: Column) -> DataFrame:
    """Repeated labels become A, A_2, A_3."""
    n = F.row_number().over(Window.partitionBy(key, label).orderBy(*order))
    return df.withColumn("unique_label", F.when(n > 1, F.concat(F.col(label), F.lit("_"), n.cast("string"))).otherwise(F.col(label)))


def largest_block(pages: DataFrame) -> DataFrame:
    """Longest run of consecutive pages of each document, the first on ties. pages: document_id, page (distinct)."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("document_id").orderBy("page"))
    runs = pages.withColumn("_i", island).groupBy("document_id", "_i").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n"))
    return first_seen(runs, ["document_id"], F.col("n").desc(), F.col("first_page")).drop("_i")


def margin_numbers(lines: DataFrame, least: int = 8, share: float = 0.35) -> DataFrame:
    """Documents whose lines begin with running margin numbers. lines: document_id, pos, number (null without one)."""
    c = lines.filter("number BETWEEN 1 AND 400")
    step = F.col("number") - F.lag("number").over(Window.partitionBy("document_id").orderBy("pos"))
    sums = c.withColumn("_s", step).groupBy("document_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("_s") == 1).alias("steps"))
    return sums.withColumn("has_margin", (F.col("candidates") >= least) & (F.col("steps") >= F.greatest(F.lit(4.0), share * F.col("candidates"))))


def densest_window(lines: DataFrame, hit: Column, size: int = 80, step: int = 15, least: float = 0.1) -> DataFrame:
    """Window of lines with the highest share of hits, among windows that begin at multiples of ``step``."""
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(0, size - 1)
    rows = lines.withColumn("density", F.round(F.avg(hit.cast("int")).over(w), 6)).filter((F.col("pos") % step == 0) & (F.col("density") >= least))
    return first_seen(rows, ["document_id"], F.col("density").desc(), F.col("pos")).select("document_id", F.col("pos").alias("start_pos"), "density")


def primary_filing(docs: DataFrame) -> DataFrame:
    """docs with is_primary: the first of each case and top category."""
    rows = docs.withColumn("category", F.split("document_type", " - ")[0])
    n = F.row_number().over(Window.partitionBy("case_id", "category").orderBy("created_at", "document_id"))
    return rows.withColumn("is_primary", F.col("case_id").isNotNull() & (n == 1))


#: How far a case has come when a document of the type arrives.
STAGES = (("Pleading - Complaint", 1), ("Pleading - Answer", 2), ("Discovery", 3), ("Pleading - Motion", 4), ("Court - Order", 5))


def stage_rank(column: str = "document_type") -> Column:
    return reduce(lambda c, s: F.when(F.col(column).startswith(s[0]), s[1]).otherwise(c), reversed(STAGES), F.lit(0))


def stage_history(docs: DataFrame) -> DataFrame:
    """Events at which a case's stage advances; it never goes back."""
    w = Window.partitionBy("case_id").orderBy("created_at", "document_id")
    rows = docs.filter("case_id IS NOT NULL").withColumn("_r", stage_rank())
    rows = rows.withColumn("stage", F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.filter("stage > before").select("case_id", "document_id", "before", "stage")


def top_k_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def queue_rank(jobs: DataFrame) -> DataFrame:
    order = F.expr("CASE process_priority WHEN 'immediate' THEN 0 WHEN 'soon' THEN 1 WHEN 'overnight' THEN 2 ELSE 3 END")
    return jobs.filter(F.col("status").isin("pending", "failed")).withColumn("rank", F.row_number().over(Window.partitionBy("firm_id").orderBy(order, "created_at", "intake_id")))


def history_split(messages: DataFrame, threshold: int = 20, keep: int = 4) -> DataFrame:
    """Long conversations: the last ``keep`` messages and the current one stay, older ones are to be summarised."""
    w = Window.partitionBy("session_id")
    n = F.count("*").over(w)
    back = F.row_number().over(w.orderBy(F.col("turn").desc()))
    return messages.withColumn("part", F.when(n <= threshold, "keep").when(back <= keep + 1, "keep").otherwise("summarise"))


def idle_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, most: int | None = None) -> DataFrame:
    """Bursts of a key's events with no gap as long as ``gap_seconds``; with ``most``, a burst also ends after so many."""
    w = Window.partitionBy(key).orderBy(ts, "intake_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    rows = events.withColumn("_new", F.coalesce((gap >= gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if most:
        n = F.row_number().over(Window.partitionBy(key, "burst").orderBy(ts, "intake_id"))
        rows = rows.withColumn("part", F.floor((n - 1) / most))
        return rows.groupBy(key, "burst", "part").agg(F.count("*").alias("n"))
    return rows.groupBy(key, "burst").agg(F.count("*").alias("n"), F.min("intake_id").alias("first_id"))


def notified(status: Column) -> Column:
    """What a status is told as: changes that end a job or ask for an answer; null for others."""
    return F.when(status == "failed", "error").when(status == "completed", "done").when(status == "pending", "needs_answer")


def status_changes(events: DataFrame) -> DataFrame:
    """Events that change their job's status to one that is told, with ``kind``: the batch twin of ``notification_stream``."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("created_at", "intake_id"))
    rows = events.withColumn("_before", before).withColumn("kind", notified(F.col("status")))
    return rows.filter(F.col("kind").isNotNull() & ~F.col("_before").eqNullSafe(F.col("status"))).drop("_before")


def notifications(events: DataFrame, n: int = 50) -> DataFrame:
    """What a tenant is told of: the last ``n`` changes of each tenant."""
    return top_k_per(status_changes(events), ["firm_id"], n, F.col("created_at").desc(), F.col("intake_id").desc())
