"""Many patterns sought in one pass over each text: an automaton of all rules, sent to the tasks while it is small enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns and labels that go into one automaton; larger tables of rules are sought group by group.
GROUP_BYTES = 16 << 20


def groups_of(rules: DataFrame, most: int) -> Iterator[list[tuple[bool, int, str, str]]]:
    """The distinct rules (late, rank, label, pattern) in groups of about ``most`` bytes; only one group at a time is on the driver."""
    rules = rules.select((F.col("place") != "title").alias("late"), F.col("rank").cast("int").alias("rank"), "label", "pattern").filter("late IS NOT NULL AND pattern IS NOT NULL").distinct()
    size = rules.agg(F.sum(F.octet_length("pattern") + F.octet_length(F.coalesce("label", F.lit("")))).alias("n")).first()["n"] or 0
    n = -(-size // most) or 1
    for g in range(n):
        own = rules.filter(f"pmod(xxhash64(pattern), {n}) = {g}")
        yield [(r["late"], r["rank"], r["label"], r["pattern"]) for r in own.collect()]


def automata(rules: list[tuple[bool, int, str, str]]):
    """For titles and for bodies: an automaton whose words carry their first rule (rank, label), and the first rule that matches every text."""
    import ahocorasick

    out = []
    for late in (False, True):
        best: dict[str, tuple[int, str]] = {}
        for _, rank, label, pattern in (r for r in rules if r[0] == late):
            best[pattern] = min(best.get(pattern, (rank, label)), (rank, label))
        always = best.pop("", None)
        machine = ahocorasick.Automaton()
        for pattern, rule in best.items():
            machine.add_word(pattern, rule)
        machine.make_automaton()
        out.append((machine if best else None, always))
    return out


def matcher(sent):
    """A function of title and body that gives the first rule which the broadcast automata find."""

    @F.pandas_udf("struct<late: boolean, rank: int, label: string>")
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pair in parts:
            rows = []
            for title, body in zip(*pair, strict=True):
                found = (None, None, None)
                for late, ((machine, always), text) in enumerate(zip(sent.value, (title, body), strict=True)):
                    if text is None:
                        continue
                    hits = [always] if always else []
                    if machine is not None:
                        hits += [rule for _, rule in machine.iter(text)]
                    if hits:
                        found = (bool(late), *min(hits))
                        break
                rows.append(found)
            yield pd.DataFrame(rows, columns=["late", "rank", "label"]).astype({"late": object, "rank": "Int64", "label": object})

    return match


def first_rules(texts: DataFrame, rules: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """texts (key columns, _t, _b) with m: the first rule (late, rank, label) whose pattern lies in the title _t, else in the body _b; null without one.

    rules: place ('title' or 'body'), pattern, label, rank. One pass over each text for each group of rules, whatever their number.
    """
    out, found = texts, []
    for group in groups_of(rules, group_bytes):
        if group:
            sent = texts.sparkSession.sparkContext.broadcast(automata(group))  # bounded by group_bytes
            found.append(f"_n{len(found)}")
            out = out.withColumn(found[-1], matcher(sent)("_t", "_b"))
    if not found:
        return out.withColumn("m", F.lit(None).cast("struct<late: boolean, rank: int, label: string>"))
    return out.withColumn("m", F.array_min(F.filter(F.array(*found), lambda x: x["late"].isNotNull()))).drop(*found)
