"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a token target. Among all document rates between 0 and 2 that
meet it, the ones closest to 1 in relative entropy have the form
min(2, exp(lambda * size / mean size)), with one lambda for each source: the minimum of a
convex dual, found by Newton steps that are kept inside a shrinking bracket.
A step is one aggregate over (source, size, count), to which documents are
reduced first. Repeated rows are one row with a count, weighed by it. Rates become whole copies: a document gets the integral part of
its rate and one more copy if its hash, less the fraction, lies under a
source's cut; three passes over 1,024 bins each place the cut where the
taken words come nearest to the target, and up to four documents a source are
taken once more or less where that comes nearer still. Nothing is random, so reruns agree.

The driver sees one number (the common level of the targets) and whether the
steps have settled. The table of sources is broadcast up to ``most_sources``
rows and joined by key beyond.

Cases: a null text has size 0 and is taken 0 times over its words; a null
source is a source, the last; repeated rows have the same hash and are taken alike; a
source without words has target 0; an empty table gives an empty result;
further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, forget, table

BINS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """docs with mix_size (words) and mix_u (a number in [0, 1) from the id and the size)."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("mix_size", size).withColumn("mix_u", F.expr("(xxhash64(doc_id, mix_size, 'mix') & 4503599627370495L) / 4503599627370496D"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: shares by weight of ``total`` times all words, none above ``cap`` times its source.

    sources: source, source_size, mean_size; one row each. Windows without a
    partition see this table only.
    """
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n + 1)
    rows = sources.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    rows = cut(rows.withColumn("level", (F.lit(total) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)))
    level = rows.filter("most >= level * w").agg(F.min_by("level", F.col("most") / F.col("w")).alias("level")).first()["level"]
    share = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("w"))
    return rows.select("source", "source_size", "mean_size", share.alias("target"))


def few(sources: DataFrame, most_sources: int = 20_000) -> bool:
    """Whether a table of sources, and so each that has a row of some of them, may be broadcast."""
    return sources.limit(most_sources + 1).count() <= most_sources


def with_source(rows: DataFrame, state: DataFrame, few_sources: bool) -> DataFrame:
    """rows joined with the table of sources, null being a source like any other; few_sources: whether ``few`` says so."""
    own = state.withColumnRenamed("source", "mix_source")
    return rows.join(F.broadcast(own) if few_sources else own, rows["source"].eqNullSafe(own["mix_source"]), "inner").drop("mix_source")


RATE = "CASE WHEN target >= 2 * source_size THEN 2D ELSE least(2D, exp(least(lam * size / mean_size, 700D))) END"


def tilts(counts: DataFrame, goals: DataFrame, rounds: int = 400) -> DataFrame:
    """goals with lam, the exponent's factor that meets each target. counts: source, size, n.

    A bracket that halves settles in far fewer rounds than ``rounds``; one that hasn't is an error.
    """
    state = cut(goals.selectExpr("*", "0D AS lam", "-1e6D AS low", "1e6D AS high", "target <= 0 OR target >= 2 * source_size AS done"))
    few_sources = few(state)
    for _ in range(rounds):
        if state.filter("NOT done").isEmpty():
            break
        rated = with_source(counts.filter("size > 0"), state.filter("NOT done"), few_sources).selectExpr("source", "size", "n", "mean_size", f"{RATE} AS rate")
        sums = rated.groupBy("source").agg(F.expr("sum(n * size * rate) AS mass"), F.expr("sum(CASE WHEN rate < 2 THEN n * size * rate * size / mean_size ELSE 0 END) AS slope"))
        sums = sums.withColumnRenamed("source", "mix_source")
        moved = state.join(sums, state["source"].eqNullSafe(sums["mix_source"]), "left").drop("mix_source")
        moved = moved.selectExpr("source", "source_size", "mean_size", "target", "lam", "mass", "slope", "CASE WHEN mass < target THEN lam ELSE low END AS low", "CASE WHEN mass >= target THEN lam ELSE high END AS high", "done OR abs(mass - target) <= 1e-9 * target AS done")
        step = "lam + (target - mass) / slope"
        halfway = "CASE WHEN high = 1e6D THEN 2 * greatest(lam, 0.5D) WHEN low = -1e6D THEN 2 * least(lam, -0.5D) ELSE (low + high) / 2 END"
        moved = moved.selectExpr("source", "source_size", "mean_size", "target", f"CASE WHEN done OR mass IS NULL THEN lam WHEN slope > 0 AND {step} > low AND {step} < high THEN {step} ELSE {halfway} END AS lam", "low", "high", "done OR high - low < 1e-12 * abs(high) AS done")
        state = cut(moved, state)
    else:
        raise RuntimeError("the dual did not settle")
    return state.select("source", "source_size", "mean_size", "target", "lam")


def rated(rows: DataFrame, state: DataFrame, few_sources: bool) -> DataFrame:
    """rows with mix_base (copies for certain) and mix_v (the place at which one more is decided; null: never)."""
    out = with_source(rows, state, few_sources).withColumn("mix_rate", F.expr(RATE.replace("lam * size", "lam * mix_size")))
    out = out.withColumn("mix_base", F.expr("CASE WHEN mix_size = 0 THEN 1 ELSE CAST(floor(mix_rate) AS int) END"))
    return out.withColumn("mix_v", F.expr("CASE WHEN mix_size > 0 AND mix_rate < 2 AND mix_rate > 0 THEN mix_u - (mix_rate - mix_base) END"))


def cuts(small: DataFrame, state: DataFrame, few_sources: bool) -> DataFrame:
    """state with ``edge``: documents with mix_v below it get one more copy."""
    rows = rated(small, state, few_sources).select("source", "mix_size", "mix_base", "n")
    sure = rows.groupBy("source").agg(F.sum(F.col("mix_base") * F.col("mix_size") * F.col("n")).alias("sure")).withColumnRenamed("source", "mix_source")
    state = state.join(sure, state["source"].eqNullSafe(sure["mix_source"]), "left").drop("mix_source")
    state = cut(state.selectExpr("source", "source_size", "mean_size", "target", "lam", "-1D AS edge", "2D AS wide", "target - sure AS want"))
    for turn in range(3):
        near = rated(small, state, few_sources).filter(f"mix_v >= edge AND mix_v < edge + wide").selectExpr("source", "mix_size * n AS words", f"least({BINS - 1}, CAST(floor((mix_v - edge) / wide * {BINS}) AS int)) AS bin")
        sums = near.groupBy("source", "bin").agg(F.sum("words").alias("s"))
        upto = Window.partitionBy("source").orderBy("bin")
        sums = sums.withColumn("through", F.sum("s").over(upto)).withColumnRenamed("source", "mix_source")
        found = with_source(sums.withColumnRenamed("mix_source", "source"), state.select("source", "want"), few_sources)
        found = found.filter("through >= want").groupBy("source").agg(F.min_by(F.struct("bin", "s", "through"), "bin").alias("hit")).withColumnRenamed("source", "mix_source")
        last = turn == 2
        state = state.join(found, state["source"].eqNullSafe(found["mix_source"]), "left").drop("mix_source")
        stop = "wide" if last else "0D"
        over = f"hit IS NOT NULL AND want > 0 AND hit.through - want < want - (hit.through - hit.s)" if last else "false"
        state = cut(state.selectExpr("source", "source_size", "mean_size", "target", "lam", f"CASE WHEN want <= 0 THEN edge WHEN hit IS NULL THEN edge + wide WHEN {over} THEN edge + (hit.bin + 1) * wide / {BINS} ELSE edge + hit.bin * wide / {BINS} END AS edge", f"CASE WHEN want <= 0 OR hit IS NULL THEN 0D ELSE wide / {BINS} END AS wide", "CASE WHEN hit IS NULL THEN 0D ELSE want - (hit.through - hit.s) END AS want"))
    return state


COPIES = "(mix_base + CASE WHEN mix_v < edge THEN 1 ELSE 0 END + coalesce(aggregate(filter(flips, f -> f.u = mix_u AND f.size = mix_size), 0, (a, f) -> a + f.delta), 0))"


def flips(small: DataFrame, state: DataFrame, few_sources: bool, rounds: int = 4) -> DataFrame:
    """state with ``flips``: in each round the one document per source, all its repeats with it, that, taken once more or once less, brings its source nearest to the target."""
    state = state.withColumn("flips", F.expr("CAST(array() AS array<struct<u: double, size: bigint, delta: int>>)"))
    for _ in range(rounds):
        rows = rated(small, state, few_sources).selectExpr("source", "target", "mix_size", "mix_u", "n", f"{COPIES} AS c")
        taken = rows.groupBy("source").agg(F.expr("first(target) - sum(c * mix_size * n) AS want"))
        options = with_source(rows.filter("mix_size > 0").selectExpr("source", "mix_u", "mix_size", "n", "explode(filter(array(1, -1), d -> c + d BETWEEN 0 AND 2)) AS delta"), taken, few_sources)
        best = options.groupBy("source").agg(F.expr("min(struct(abs(want - delta * mix_size * n) AS off, mix_u AS u, mix_size AS size, delta, abs(want) AS was)) AS b")).filter("b.off < b.was").withColumnRenamed("source", "mix_source")
        joined = state.join(best, state["source"].eqNullSafe(best["mix_source"]), "left").drop("mix_source")
        state = cut(joined.withColumn("flips", F.expr("CASE WHEN b IS NULL THEN flips ELSE concat(flips, array(named_struct('u', b.u, 'size', b.size, 'delta', b.delta))) END")).drop("b"))
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5) -> DataFrame:
    """docs with mix_size, source_size, target and copies (0, 1 or 2)."""
    small = cut(sized(docs).groupBy("source", "mix_size", "mix_u").agg(F.count("*").alias("n")))
    counts = cut(small.groupBy("source", F.col("mix_size").alias("size")).agg(F.sum("n").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.expr("coalesce(sum(size * n) / sum(CASE WHEN size > 0 THEN n END), 1D) AS mean_size"))
    state = tilts(counts, targets(sources, weights, total))
    few_sources = few(state)  # their number stays from here on
    state = flips(small, cuts(small, state, few_sources), few_sources)
    forget(small, counts)
    out = rated(sized(docs.drop("source_size", "target", "mean_size", "lam", "edge", "wide", "want", "flips", "copies", "mix_source")), state, few_sources)
    return out.withColumn("copies", F.expr(COPIES)).drop("mean_size", "lam", "edge", "wide", "want", "flips", "mix_u", "mix_v", "mix_base", "mix_rate")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.selectExpr("doc_id", "mix_size AS size", "source_size", "target", "copies * mix_size AS taken", "copies")
