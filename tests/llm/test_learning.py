"""Training on texts of any length, and the quality score against a slow version."""

import random

import numpy as np
import pytest

from caselake.llm import learning, quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def long_texts(n, chars):
    """Half of them of good, toxic-free lines, half of junk with a toxic word here and there; all longer than ``chars``."""
    rng = random.Random(4)
    out = []
    for i in range(n):
        bad = i % 2
        lines, size = [], 0
        while size <= chars + 1:
            line = " ".join(rng.choice(("$$", "buy", "now", "!!!", "vile")) for _ in range(6)) if bad and rng.random() < 0.7 else " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(8, 14))) + "."
            lines.append(line)
            size += len(line) + 1
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_long_texts_train_and_separate(spark, module, label):
    texts = long_texts(60, 20_000)
    assert min(len(t) for _, t in texts) > 20_000
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    model = module.train(docs_of(spark, texts), labels, "true")
    assert model.constant is None
    fresh = [(100 + i, t[:5000]) for i, t in texts]
    got = {r["doc_id"]: r["score"] for r in module.score(docs_of(spark, fresh), model).collect()}
    good = [got[100 + i] for i, _ in texts if (i % 2 == 0) == (label == "quality")]
    assert min(good) > max(s for i, s in got.items() if s not in good)


def test_sample_is_bounded_in_rows_and_characters(spark):
    rows = [(i, "x" * 10 * (i + 1)) for i in range(40)] + [(100, None)] + [(3, "y" * 500)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, (i or 0) % 2, 0) for i in [*range(40), 100, 777, None]] + [(5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    got, share = learning.labelled_sample(docs, labels, "quality", "true", 15, 1500)
    for y in (0, 1):
        own = [t for t, c, _ in got if c == y]
        assert 0 < len(own) <= 15 and sum(map(len, own)) <= 1500
    assert set(share) == {0, 1}
    got, _ = learning.labelled_sample(docs, labels, "quality", "true", 100, 10**6)
    assert len(got) == 40 and max(len(t) for t, _, _ in got) == 400
    got, _ = learning.labelled_sample(docs, labels, "quality", "true", 100, 3)  # nothing fits: the shortest of each class
    assert sorted(len(t) for t, _, _ in got) == [10, 20]
    assert learning.labelled_sample(docs, labels.limit(0), "quality", "true", 5, 5) == ([], {})


def test_batches_bound_their_words():
    words = [3, 5, 40_000, 1, 2, 30_000, 9_000, 0, 7]
    got = [b.tolist() for b in toxicity.batches_of(np.arange(len(words)), words, 3)]
    assert sum(got, []) == list(range(len(words)))
    assert all(len(b) == 1 or (len(b) <= 3 and sum(words[d] for d in b) <= toxicity.BATCH_WORDS) for b in got)


def test_null_id_is_not_held_out(spark, tmp_path):
    rows = [(i, f"some text {i}\nand a line") for i in range(40)] + [(None, "text without an id")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (quality.op3_quality, toxicity.op6_toxicity):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 41 and [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_quality_score_equals_a_slow_version(spark):
    texts = long_texts(12, 600)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    chain = quality.train(docs_of(spark, texts), labels, "true")
    asked = [*texts, (50, ""), (51, None), (52, "\n \n"), (53, "one line"), (54, "a\n\nb c d\n$$$"), (55, "word1 word2.\n" * 40)]
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(spark, asked), chain).collect()}
    k, bins = len(quality.NAMES), quality.BINS
    for i, text in asked:
        features, size = quality.line_features(text)
        own = [[sum(v >= e for e in chain.edges[f]) for f, v in enumerate(row)] for row in features]
        n = len(own)
        score = []
        for j in range(n):
            beside = [own[j], own[j - 1] if j else [bins] * k, own[j + 1] if j + 1 < n else [bins] * k]
            score.append(sum(chain.weights[s * k * (bins + 1) + f * (bins + 1) + b] for s, row in enumerate(beside) for f, b in enumerate(row)))
        mean = 0.5
        if n:
            a, b = [(0.0, score[0])], [(0.0, 0.0)]
            for j in range(1, n):
                a.append(tuple(np.logaddexp(a[-1][0] + chain.ties[0][y], a[-1][1] + chain.ties[1][y]) + score[j] * y for y in (0, 1)))
            for j in range(n - 2, -1, -1):
                b.insert(0, tuple(np.logaddexp(chain.ties[y][0] + b[0][0], chain.ties[y][1] + score[j + 1] + b[0][1]) for y in (0, 1)))
            good = [1 / (1 + np.exp(x[0] + z[0] - x[1] - z[1])) for x, z in zip(a, b, strict=True)]
            mean = float(np.clip(sum(g * s for g, s in zip(good, size, strict=True)) / sum(size), 1e-9, 1 - 1e-9))
        want = learning.sigmoid(np.array(chain.slope * np.log(mean / (1 - mean)) + chain.shift))
        assert abs(got[i] - want) < 1e-6, i


def test_thresholds_and_calibration_come_from_all_rated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ("en", "fr", None)[i % 3], float(rng.normal() + (2 if i % 4 == 0 else 0) + (3 if i % 3 == 1 else 0))) for i in range(3000)]
    outputs = spark.createDataFrame(rows, "doc_id long, lang string, logit double").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(3000)], "doc_id long, toxic int")
    net = toxicity.Net()
    net.fitted = [0, 1]
    got = toxicity.rate(outputs, net, labels, "true").toPandas().set_index("doc_id")
    x, y = np.array([r[2] for r in rows[2:]]), np.array([i % 4 == 0 for i in range(2, 3000)], float)
    assert np.allclose((net.slope, net.shift), learning.calibrate(x, y, np.ones(len(y))), rtol=1e-6)

    def f1(flag, y):
        return 2 * (flag & y).sum() / (flag.sum() + y.sum())

    hit, s = np.arange(3000) % 4 == 0, got.score.sort_index().to_numpy()
    flag = got.flagged.sort_index().to_numpy()
    for k in (0, 1):
        own = np.arange(3000) % 3 == k
        assert f1(flag[own], hit[own]) == max(f1(s[own] >= t, hit[own]) for t in s[own])
    best = max(s, key=lambda t: f1(s >= t, hit))
    own = np.arange(3000) % 3 == 2
    assert (flag[own] == (s[own] >= best)).all()
