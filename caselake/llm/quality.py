"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's weights see binned features of
the line itself and of the lines before and after it; transition weights tie
neighbours together. Forward-backward gives each line's marginal probability of being
good; the marginals' mean, weighted by the lines' lengths, becomes the score
after calibration. Labels exist for documents, so each line of a labelled
document takes its label in training.

The sample that the driver trains on is bounded by ``per_class`` rows and
``chars_per_class`` characters in all, whatever the length of a text; everything else covers all rows.

Cases: a null text or one without a non-blank line has the mean 0.5 before
calibration; a null doc_id isn't held out; blank lines aren't lines; a very long text is one chain of
linear cost; repeated rows get equal scores; without labels of both classes
every score is the share of label 1 (0.5 without any); empty tables give
empty results; further columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, spread, table
from .learning import Adam, calibrate, fold, labelled_sample, sigmoid

BINS = 10
_UPPER = bytes(range(65, 91))
_SIGNS = b"!|#$%&*"
_DIGITS = b"0123456789"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
NAMES = ("words", "bytes", "word length", "upper case", "signs", "bangs", "bars", "odd signs", "digits", "distinct words", "repeats", "commonest", "capital start", "full stop", "as before")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for each line, and the lines' lengths."""
    rows, sizes, before = [], [], None
    for raw in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = raw.split()
        if not words:
            continue
        n, size = len(words), len(raw)
        marks = size - len(raw.translate(None, _MARKS))
        few = set(words)
        rows.append(
            (
                np.log1p(n), np.log1p(size), size / n, (size - len(raw.translate(None, _UPPER))) / size, marks / n,
                raw.count(b"!") / n, raw.count(b"|") / n, (size - len(raw.translate(None, _SIGNS))) / n, (size - len(raw.translate(None, _DIGITS))) / n,
                len(few) / n, sum(map(bytes.__eq__, words, words[1:])) / n, (max(Counter(words).values()) if len(few) < n else 1) / n,
                raw[:1].isupper() or raw[:1] > b"\x7f", raw.rstrip()[-1:] == b".", raw == before,
            )
        )
        sizes.append(size)
        before = raw
    return np.array(rows, np.float32).reshape(-1, len(NAMES)), np.array(sizes, np.float64)


#: Lines of a chain in training.
PER_CHAIN = 512


class Chain:
    def __init__(self) -> None:
        self.edges = np.zeros((len(NAMES), BINS - 1), np.float32)
        self.weights = np.zeros(3 * len(NAMES) * (BINS + 1))
        self.ties = np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0
        self.constant: float | None = None

    def indicators(self, features: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which weight each of a line's own, previous and next features picks; bin BINS stands for no neighbour."""
        k = len(NAMES)
        own = np.stack([np.searchsorted(self.edges[f], features[:, f], side="right") for f in range(k)], 1) if len(features) else np.zeros((0, k), int)
        none = np.full((1, k), BINS)
        prev, nxt = np.concatenate((none, own[:-1]))[: len(own)], np.concatenate((own[1:], none))[: len(own)]
        prev[first], nxt[last] = BINS, BINS
        at = np.arange(k) * (BINS + 1)
        return np.concatenate((own + at, prev + at + k * (BINS + 1), nxt + at + 2 * k * (BINS + 1)), 1)

    def marginals(self, score: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the sum over neighbours of their joint marginals (2 x 2)."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n, wide = len(score), int(lengths[0]) if len(lengths) else 0
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        node = np.stack((np.zeros(n), score), 1)
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(wide + 1)]  # chains longer than t
        fwd[starts[: active[0]]] = node[starts[: active[0]]]
        for t in range(1, wide):
            at = starts[: active[t]] + t
            a = fwd[at - 1][:, :, None] + self.ties[None]
            fwd[at] = np.logaddexp(a[:, 0], a[:, 1]) + node[at]
        for t in range(wide - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            b = (bwd[at + 1] + node[at + 1])[:, None, :] + self.ties[None]
            bwd[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
        both = fwd + bwd
        good = sigmoid(both[:, 1] - both[:, 0])
        joint = np.zeros((2, 2))
        inner = np.ones(n, bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        if at.size:
            z = np.logaddexp(both[at, 0], both[at, 1])
            pair = fwd[at - 1][:, :, None] + self.ties[None] + (bwd[at] + node[at])[:, None, :] - z[:, None, None]
            joint = np.exp(pair).sum(0)
        return good, joint

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the marginals of each text, as log odds."""
        parts = [line_features(t) for t in texts]
        lengths = np.array([len(p[1]) for p in parts], np.int64)
        out = np.zeros(len(texts))
        if lengths.sum():
            starts = np.cumsum(lengths) - lengths
            there = np.flatnonzero(lengths)
            x = self.indicators(np.concatenate([p[0] for p in parts]), starts[there], (starts + lengths - 1)[there])
            good, _ = self.marginals(self.weights[x].sum(1), starts[there], lengths[there])
            size = np.concatenate([p[1] for p in parts])
            mean = np.add.reduceat(good * size, starts[there]) / np.add.reduceat(size, starts[there])
            mean = np.clip(mean, 1e-9, 1 - 1e-9)
            out[there] = np.log(mean / (1 - mean))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.slope * self.means(texts) + self.shift)

    def train(self, texts: list[str], y: np.ndarray, rounds: int = 120, ridge: float = 3.0) -> None:
        """Every line counts; chains of over ``PER_CHAIN`` lines are trained in pieces, since a step costs as much as the longest chain."""
        whole = [line_features(t) for t in texts]
        cuts = [(k, at) for k, p in enumerate(whole) for at in range(0, len(p[1]), PER_CHAIN)]
        keep = [k for k, _ in cuts]
        parts = [whole[k][0][at : at + PER_CHAIN] for k, at in cuts]
        lengths = np.array([len(p) for p in parts], np.int64)
        features = np.concatenate(parts)
        for f in range(len(NAMES)):
            self.edges[f] = np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1])
        starts = np.cumsum(lengths) - lengths
        x = self.indicators(features, starts, starts + lengths - 1)
        label = np.repeat(y[keep], lengths)
        per_line = np.repeat([1 / np.sqrt(len(whole[k][1])) for k in keep], lengths)  # long documents don't outweigh the rest
        seen = np.zeros((2, 2))
        inner = np.ones(len(label), bool)
        inner[starts] = False
        np.add.at(seen, (label[np.flatnonzero(inner) - 1].astype(int), label[inner].astype(int)), 1)
        adam = Adam(self.weights, self.ties, rate=0.08)
        for _ in range(rounds):
            good, joint = self.marginals(self.weights[x].sum(1), starts, lengths)
            g = np.bincount(x.reshape(-1), np.repeat((good - label) * per_line, x.shape[1]), len(self.weights)) + ridge * self.weights
            adam.down(g, (joint - seen) * 0.2 + 5 * ridge * self.ties)


def train(docs: DataFrame, labels: DataFrame, used: str, per_class: int = 900, chars_per_class: int = 4_000_000) -> Chain:
    """Train on a bounded sample of the labelled rows for which ``used`` holds; a third of it calibrates."""
    sample, share = labelled_sample(docs, labels, "quality", used, per_class, chars_per_class)
    chain = Chain()
    y = np.array([s[1] for s in sample], float)
    apart = np.random.default_rng(4).permutation(len(sample)) % 3 == 0
    if len(set(y[~apart].tolist())) < 2 or not any(s[0].strip() for s in sample):
        chain.constant = float(np.average(y, weights=[share[int(v)] for v in y])) if len(y) else 0.5
        return chain
    chain.train([sample[k][0] for k in np.flatnonzero(~apart)], y[~apart])
    mean = chain.means([s[0] for s in sample])
    weight = np.array([share[int(v)] for v in y])
    chain.slope, chain.shift = calibrate(mean[apart], y[apart], weight[apart])
    return chain


def score(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """df with ``score`` double, from the whole text."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # fixed size: some hundred weights
    df = df.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(field(part, text).to_pylist()))], names=[*part.schema.names, "score"])

    return spread(df).mapInArrow(run, f"{fields}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 5) + " = 0"
    chain = train(docs, labels, f"NOT ({held})")
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), chain)
    return scored.select("doc_id", F.expr(f"coalesce({held}, false)").alias("held_out"), "score", F.expr("CAST(score >= 0.3 AS int)").alias("predicted"))
