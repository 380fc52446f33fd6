"""What the two classifiers share: bounded labelled samples, Adam, score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def fold(column: str, of: int) -> str:
    """SQL: crc32 of an id's decimal text, modulo ``of``."""
    return f"crc32(CAST({column} AS string)) % {of}"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, used: str, per_class: int, chars_per_class: int, more: str = "CAST(NULL AS string)") -> tuple[list[tuple[str, int, str | None]], dict[int, float]]:
    """At most ``per_class`` labelled rows of each class, whole texts of any length, and the weight of each class.

    Rows are drawn in the order of a hash of their id, from those for which the
    SQL condition ``used`` holds. What the driver holds is bounded by ``chars_per_class``: of the drawn rows
    those are kept, in the same order, whose texts fit into what is left of it; where none fits, the shortest.
    The weights undo the equal shares of the sample.
    """
    rated = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(used).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {int(r["y"]): int(r["count"]) for r in rated.groupBy("y").count().collect()}
    drawn = {y: [r["doc_id"] for r in rated.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()] for y in (0, 1)}
    if not any(drawn.values()):
        return [], {}
    rows = docs.filter(F.col("doc_id").isin(drawn[0] + drawn[1])).filter(F.col("text").isNotNull()).selectExpr("doc_id", "CAST(text AS string) AS text", f"{more} AS more")
    rows = cut(rows.groupBy("doc_id").agg(F.min(F.struct("text", "more")).alias("r")).select("doc_id", "r.*"))  # one row per id
    size = {r["doc_id"]: r["n"] for r in rows.select("doc_id", F.length("text").alias("n")).collect()}
    kept: dict[int, int] = {}
    for y, ids in drawn.items():
        left, there = chars_per_class, [i for i in ids if i in size]
        for i in there:
            if size[i] <= left:
                kept[i] = y
                left -= size[i]
        if there and left == chars_per_class and y not in kept.values():
            kept[min(there, key=size.get)] = y
    got = [(r["text"], kept[r["doc_id"]], r["more"]) for r in rows.filter(F.col("doc_id").isin(list(kept))).orderBy("doc_id").collect()]
    forget(rows)
    share = {y: sum(g[1] == y for g in got) for y in (0, 1)}
    total = sum(counts.values())
    return got, {y: counts[y] / total * len(got) / share[y] for y in (0, 1) if share[y]}


class Adam:
    def __init__(self, *arrays: np.ndarray, rate: float = 0.01):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in arrays], [np.zeros_like(x) for x in arrays]

    def down(self, *gradients: np.ndarray) -> None:
        self.step += 1
        for x, m, v, g in zip(self.arrays, self.m, self.v, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset that make sigmoid(slope * logit + offset) fit y; Newton steps with a small ridge."""
    if not len(y):
        return 1.0, 0.0
    scale = max(1e-6, float(np.abs(logit).mean()))
    x = np.stack([logit / scale, np.ones(len(y))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(40):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + 0.05 * (w - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(w[0]), 0.05) / scale, float(w[1])


def calibrate_rows(rows: DataFrame) -> tuple[float, float]:
    """``calibrate`` over a table (logit, y, n rows alike): each Newton step is one sum over the cluster, until it moves no further. Rounded, as the order of sums isn't fixed."""
    scale = max(1e-6, float(rows.select(F.sum(F.abs("logit") * F.col("n")) / F.sum("n")).first()[0] or 0.0))
    w = np.array([1.0, 0.0])
    for _ in range(40):
        x = F.col("logit") / scale
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x * float(w[0]) + float(w[1])))))
        d, v = (p - F.col("y")) * F.col("n"), p * (1 - p) * F.col("n")
        gx, g1, hxx, hx, h1 = (float(s or 0.0) for s in rows.select(*[F.sum(c) for c in (x * d, d, x * x * v, x * v, v)]).first())
        g = np.array([gx, g1]) + 0.05 * (w - [1.0, 0.0])
        step = np.clip(np.linalg.solve(np.array([[hxx, hx], [hx, h1]]) + 0.05 * np.eye(2), g), -2, 2)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return float(f"{max(float(w[0]), 0.05) / scale:.9g}"), float(f"{w[1]:.9g}")
