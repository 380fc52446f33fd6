"""Toxicity: a convolutional text classifier trained in numpy.

Words are lower-cased runs between ASCII signs and white space. A word's
embedding is the scaled sum of hashed embeddings of the word and of its 3- to
5-byte pieces, so that unseen forms of a word share most of it. Filters of
widths 1, 2 and 3 run over the whole sequence of words; the maximum of each
filter goes into a logistic output, which is calibrated on all labelled rows
that training didn't see. Every language gets its own threshold for
``flagged``, the best one over all of its labelled rows; the score itself sees
nothing but the text.

The sample that the driver trains the filters on is bounded by ``per_class`` rows and
``chars_per_class`` characters in all, whatever the length of a text; everything else covers all rows:
calibration and thresholds are sums over the cluster, and the driver sees two numbers for each.

Cases: a null doc_id isn't held out; a null, empty or wordless text gets the score of a text whose filters
all stay silent; a very long text is pooled over overlapping windows, whole;
repeated rows get equal scores, since sums
have one order whatever else is in the batch; without labels of both classes every score is
the share of label 1 (0.5 without any); an unknown or null language uses the
threshold of all languages; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, field, forget, many, spread, table
from .learning import Adam, calibrate_rows, fold, labelled_sample, sigmoid

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
SHORTEST, LONGEST = 3, 5
WINDOW = 1 << 16
SIGNS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SIGNS).split()


#: Words whose pieces, or embeddings, are computed at once.
WORDS_AT_ONCE = 4096
#: Words of a training step.
BATCH_WORDS = 1 << 15


def pieces_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces of each word, one after the other, and where each word's begin."""
    parts, begins, n = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    for at in range(0, len(words), WORDS_AT_ONCE):
        buckets, starts = some_pieces(words[at : at + WORDS_AT_ONCE])
        parts.append(buckets.astype(np.int32))
        begins.append(starts + n)
        n += len(buckets)
    return np.concatenate(parts), np.concatenate(begins)


def some_pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    stop = end[owner]
    place = np.arange(len(flat))
    mul = np.uint64(0x9E3779B97F4A7C15)
    all_b, all_o = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, LONGEST + 1):
        nxt = np.zeros(len(flat), np.uint64)
        nxt[: len(flat) - n + 1] = flat[n - 1 :]
        h = (h ^ (nxt + np.uint64(1))) * mul
        if n >= SHORTEST:
            ok = place + n <= stop
            all_b.append(((h[ok] ^ (h[ok] >> np.uint64(29))) * mul >> np.uint64(49)) & np.uint64(BUCKETS - 1))
            all_o.append(owner[ok])
    # the whole word: a sum that depends on the place of each byte
    within = (place - (end - size)[owner]).astype(np.uint64)
    mixed = (flat + np.uint64(257)) * (within * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(31)
    whole = np.add.reduceat(mixed * mul, end - size)
    all_b.append((whole * mul >> np.uint64(49)) & np.uint64(BUCKETS - 1))
    all_o.append(np.arange(len(words)))
    owner = np.concatenate(all_o)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(all_b).astype(np.int64)[order], np.searchsorted(owner[order], np.arange(len(words)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b with each element's sum in one fixed order, so that a row's result doesn't depend on the rows beside it."""
    out = a[:, :1] * b[0]
    for k in range(1, len(b)):
        out += a[:, k : k + 1] * b[k]
    return out


def score_of(logit: np.ndarray, slope: float, shift: float, constant: float | None) -> np.ndarray:
    return sigmoid(slope * logit + shift) if constant is None else np.full(len(logit), constant)


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS, DIMS)) * 0.3).astype(np.float32)
        self.filters = [(rng.standard_normal((w, DIMS, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self.fitted: list[int] = []  # the rows that training saw
        self.constant: float | None = None

    def embed(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(buckets))
        out = np.empty((len(starts), DIMS), np.float32)
        for at in range(0, len(starts), WORDS_AT_ONCE):
            s, e = starts[at : at + WORDS_AT_ONCE], ends[at : at + WORDS_AT_ONCE]
            out[at : at + len(s)] = np.add.reduceat(self.table[buckets[s[0] : e[-1]]], s - s[0]) / np.sqrt(e - s)[:, None].astype(np.float32)
        return out

    def responses(self, vectors: np.ndarray, seq: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
        """Each width's filters at every place of seq (word numbers); words of another part don't count."""
        n = len(seq)
        for w, f in zip(WIDTHS, self.filters, strict=True):
            sums = product(vectors, f[0])[seq]
            for k in range(1, w):
                ok = part[k:] == part[: n - k]
                sums[: n - k][ok] += product(vectors, f[k])[seq[k:][ok]]
            yield sums

    def pooled(self, docs: list[list[int]], vectors: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each whole document (-1 where it has no words)."""
        wide, step = max(WIDTHS) - 1, WINDOW
        out = np.full((len(docs), len(WIDTHS) * FILTERS), -1, np.float32)
        held, owner, rows = [], [], 0

        def flush() -> None:
            seq = np.concatenate([np.asarray(x[0], np.int64) for x in held])
            size = np.array([len(x[0]) for x in held])
            use = np.array([x[1] for x in held])
            part = np.repeat(np.arange(len(held)), size)
            keep = np.arange(len(seq)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(use, size)
            starts = np.cumsum(use) - use
            for k, sums in enumerate(self.responses(vectors, seq, part)):
                low = np.maximum.reduceat(sums[keep], starts)
                np.maximum.at(out[:, k * FILTERS : (k + 1) * FILTERS], np.array(owner), low)

        for d, ids in enumerate(docs):
            for at in range(0, len(ids), step):
                cut_ = ids[at : at + step + wide]
                held.append((cut_, min(len(cut_), step)))
                owner.append(d)
                rows += len(cut_)
                if rows >= 2 * WINDOW:
                    flush()
                    held, owner, rows = [], [], 0
        if held:
            flush()
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return product(np.maximum(pooled + self.bias, 0), self.out[:, None])[:, 0] + self.offset[0]

    def outputs(self, texts: list[str | None]) -> np.ndarray:
        """The logits before calibration."""
        if self.constant is not None:
            return np.zeros(len(texts))
        index: dict[bytes, int] = {}
        docs = [[index.setdefault(w, len(index)) for w in words_of(t)] for t in texts]
        vectors = self.embed(*pieces_of(list(index))) if index else np.zeros((1, DIMS), np.float32)
        return self.logits(self.pooled(docs, vectors)).astype(np.float64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return score_of(self.outputs(texts), self.slope, self.shift, self.constant)

    def train(self, docs: list[list[int]], y: np.ndarray, weight: np.ndarray, buckets: np.ndarray, starts: np.ndarray, epochs: int = 6, size: int = 32, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        heads = [*self.filters, self.bias, self.out, self.offset]
        adam = Adam(*heads, rate=0.01)
        squares = np.full(BUCKETS, 1e-8, np.float32)
        ends = np.append(starts[1:], len(buckets))
        full = [np.asarray(d, np.int64) for d in docs]
        for _ in range(epochs):
            for batch in batches_of(rng.permutation(len(docs)), [len(d) for d in full], size):
                seq = np.concatenate([full[d] for d in batch])
                if not len(seq):
                    continue
                lens = np.array([len(full[d]) for d in batch])
                own, seq = np.unique(seq, return_inverse=True)
                count = ends[own] - starts[own]
                place = np.repeat(starts[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
                used = buckets[place]
                begin = np.cumsum(count) - count
                vectors = np.add.reduceat(self.table[used], begin) / np.sqrt(count)[:, None].astype(np.float32)
                part = np.repeat(np.arange(len(batch)), lens)
                there = np.flatnonzero(lens)
                first = (np.cumsum(lens) - lens)[there]
                pooled = np.full((len(batch), len(WIDTHS) * FILTERS), -1, np.float32)
                best = np.zeros((len(batch), len(WIDTHS) * FILTERS), np.int64)
                for k, sums in enumerate(self.responses(vectors, seq, part)):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    pooled[there, cols] = np.maximum.reduceat(sums, first)
                    for r in there:
                        a = (np.cumsum(lens) - lens)[r] if r else 0
                        best[r, cols] = a + sums[a : a + lens[r]].argmax(0)
                hidden = np.maximum(pooled + self.bias, 0)
                p = sigmoid((hidden @ self.out + self.offset[0]).astype(np.float64))
                d = (weight[batch] * (p - y[batch]) / size).astype(np.float32)
                dh = d[:, None] * self.out * (hidden > 0)
                dv = np.zeros_like(vectors)
                df = []
                rows = np.arange(len(batch))[:, None]
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    g, t = dh[:, cols], best[:, cols]
                    gf = np.zeros_like(f)
                    for j in range(w):
                        at_ = np.minimum(t + j, len(seq) - 1)
                        ok = (t + j < len(seq)) & (part[at_] == rows) & (lens[:, None] > 0)
                        gj = g * ok
                        gf[j] = np.einsum("bf,bfd->df", gj, vectors[seq[at_]])
                        np.add.at(dv, seq[at_].reshape(-1), (gj[:, :, None] * f[j].T[None]).reshape(-1, DIMS))
                    df.append(gf + 1e-5 * f)
                adam.down(*df, dh.sum(0), hidden.T @ d + 1e-4 * self.out, d.sum(keepdims=True))
                hot = np.flatnonzero(np.abs(dv).sum(1))
                if hot.size:
                    c = count[hot]
                    place = np.repeat(begin[hot] - np.cumsum(c) + c, c) + np.arange(c.sum())
                    ge = np.repeat(dv[hot] / np.sqrt(c)[:, None].astype(np.float32), c, axis=0)
                    b = used[place]
                    touched, inverse = np.unique(b, return_inverse=True)
                    acc = np.zeros((len(touched), DIMS), np.float32)
                    np.add.at(acc, inverse, ge)
                    squares[touched] += (acc * acc).mean(1)
                    self.table[touched] -= 0.05 * acc / np.sqrt(squares[touched])[:, None]


def batches_of(order: np.ndarray, words: list[int], size: int) -> Iterator[np.ndarray]:
    """The documents in their order, in batches of at most ``size`` documents and, but for a single long one, ``BATCH_WORDS`` words."""
    start, held = 0, 0
    for at, d in enumerate(order):
        if at > start and (at - start == size or held + words[d] > BATCH_WORDS):
            yield order[start:at]
            start, held = at, 0
        held += words[d]
    if start < len(order):
        yield order[start:]


def best_thresholds(rated: DataFrame) -> DataFrame:
    """(lang, threshold): of every language with labels of both classes, and under the null language of all rows, the threshold of highest F1.

    rated: lang, score, y. A threshold lies in the middle of the gap to the next lower score; of equal ones the highest counts.
    Sums run over ranges of the scores, one task each; the sums of the ranges before are added then.
    """
    both = rated.select("lang", "score", "y").filter("lang <> ''").unionByName(rated.select(F.lit(None).cast("string").alias("lang"), "score", "y"))
    steps = both.groupBy("lang", "score").agg(F.sum("y").alias("hit"), F.count("*").alias("n"))
    steps = cut(steps.repartitionByRange(many(rated), F.col("score").desc()).withColumn("part", F.spark_partition_id()))
    parts = steps.groupBy("lang", "part").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"), F.max("score").alias("top"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "lang", "part", F.coalesce(F.sum("hit").over(before), F.lit(0)).alias("hit_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.lead("top").over(Window.partitionBy("lang").orderBy("part")).alias("below"), F.sum("hit").over(Window.partitionBy("lang")).alias("hits"), F.sum("n").over(Window.partitionBy("lang")).alias("all"),
    )
    within = Window.partitionBy("lang", "part").orderBy(F.col("score").desc())
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumns({"tp": F.sum("hit").over(upto), "upto": F.sum("n").over(upto), "next": F.lead("score").over(within)})
    rows = rows.withColumnsRenamed({"lang": "_lang", "part": "_part"}).join(parts.filter("hits > 0 AND hits < all"), F.col("_lang").eqNullSafe(F.col("lang")) & (F.col("_part") == F.col("part")))
    f1 = 2.0 * (F.col("tp") + F.col("hit_before")) / (F.col("upto") + F.col("n_before") + F.col("hits"))
    middle = (F.col("score") + F.coalesce("next", "below", F.lit(0.0))) / 2
    out = cut(rows.groupBy("lang").agg(F.max_by(middle, F.struct(f1.alias("f1"), "score")).alias("threshold")))
    forget(steps)
    return out


def train(docs: DataFrame, labels: DataFrame, used: str, per_class: int = 700, chars_per_class: int = 2_000_000) -> Net:
    """A net whose filters come from a bounded sample of the labelled rows for which ``used`` holds, and whose calibration from all others of them."""
    net = train_filters(docs, labels, used, per_class, chars_per_class)
    if net.constant is None:
        out = cut(logits(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), net).select("doc_id", "logit"))
        calibrate_net(net, rated_rows(out, labels, used))
        forget(out)
    return net


def train_filters(docs: DataFrame, labels: DataFrame, used: str, per_class: int = 700, chars_per_class: int = 2_000_000) -> Net:
    """The net without calibration; a fifth of the sample isn't trained on, so that few labelled rows leave some to calibrate by."""
    sample, _ = labelled_sample(docs, labels, "toxic", used, per_class, chars_per_class, "CAST(doc_id AS string)")
    net = Net()
    y = np.array([s[1] for s in sample], float)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    index: dict[bytes, int] = {}
    seqs = [[index.setdefault(w, len(index)) for w in words_of(s[0])] for s in sample]
    buckets, starts = pieces_of(list(index))
    apart = np.random.default_rng(9).permutation(len(sample)) % 5 == 0
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        fit = np.arange(len(sample))
    else:
        fit = np.flatnonzero(~apart)
    net.train([seqs[k] for k in fit], y[fit], np.ones(len(fit)), buckets, starts, epochs=max(6, min(30, 6400 // len(fit))))
    net.fitted = [int(sample[k][2]) for k in fit]
    return net


def rated_rows(outputs: DataFrame, labels: DataFrame, used: str) -> DataFrame:
    """The labelled rows of ``outputs`` (doc_id, logit and others) for which ``used`` holds, with their label ``y``."""
    rated = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(used).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    return outputs.join(rated, "doc_id")


def calibrate_net(net: Net, rated: DataFrame) -> None:
    """Fit the net's slope and shift on the rated rows (logit, y) that training didn't see; on all, where those lack a class."""
    unseen = rated.filter(~F.col("doc_id").isin(net.fitted))
    if unseen.select("y").distinct().count() < 2:
        unseen = rated
    rows = cut(unseen.groupBy("logit", "y").agg(F.count("*").alias("n")))
    net.slope, net.shift = calibrate_rows(rows)
    forget(rows)


def logits(df: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """df with ``logit`` double, from the whole text, before calibration."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # fixed size: the table of embeddings and the filters
    df = df.drop("logit")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.outputs(field(part, text).to_pylist()))], names=[*part.schema.names, "logit"])

    return spread(df).mapInArrow(run, f"{fields}, logit double")


def scored(df: DataFrame, net: Net) -> DataFrame:
    """df with ``score`` instead of ``logit``."""
    how = net.slope, net.shift, net.constant

    @F.pandas_udf("double")
    def run(logit: pd.Series) -> pd.Series:
        return pd.Series(score_of(logit.to_numpy(), *how))

    return df.withColumn("score", run("logit")).drop("logit")


def score(df: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """df with ``score`` double, from the whole text."""
    return scored(logits(df.drop("score"), net, text), net)


def rate(out: DataFrame, net: Net, labels: DataFrame, used: str, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """out (a stored table with ``logit``) with ``score`` instead and ``flagged``, whether the score reaches the threshold of the row's language.

    Calibration and thresholds come from all labelled rows of out for which ``used`` holds.
    """
    if net.constant is not None:
        return scored(out, net).withColumn("flagged", F.col("score") >= 0.5)
    rated = rated_rows(out.select(F.expr(f"CAST({doc_id} AS long)").alias("doc_id"), F.expr(f"CAST({lang} AS string)").alias("lang"), "logit"), labels, used)
    calibrate_net(net, rated)
    limits = best_thresholds(scored(rated, net))
    every = limits.filter("lang IS NULL").first()
    limits = limits.filter("lang IS NOT NULL").select(F.col("lang").alias("_limit_lang"), "threshold")
    rows = scored(out, net).join(limits, F.expr(f"CAST({lang} AS string)") == F.col("_limit_lang"), "left")
    return rows.withColumn("flagged", F.col("score") >= F.coalesce("threshold", F.lit(every["threshold"] if every else 0.5))).drop("_limit_lang", "threshold")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) + " = 1"
    net = train_filters(docs, labels, f"NOT ({held})")
    outputs = cut(logits(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")), net).select("doc_id", "lang", "logit"))
    rows = rate(outputs, net, labels, f"NOT ({held})")
    return rows.select("doc_id", F.expr(f"coalesce({held}, false)").alias("held_out"), "score", F.expr("CAST(score >= 0.7 AS int)").alias("predicted"), "flagged")
