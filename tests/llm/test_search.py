"""Operators 11 to 13 against brute force and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from caselake.llm import hard_negatives, lexical, nearest

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"
CLASH = ", id long, raw string, score double, rank int, cell int, v string, windows int, piece int"


def vectors_of(spark, rows, clash=False):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows] if clash else rows, VEC + (CLASH if clash else ""))


def random_rows(n, d=16, seed=0, labels=10):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return [(i, [float(v) for v in x[i] / np.linalg.norm(x[i])], int(i * 7919 % labels)) for i in range(n)]


ODD = [
    (14020, None, 1), (14040, [0.0] * 16, 1), (14060, [float("nan")] * 16, 1), (14080, [None] + [0.5] * 15, 1), (14100, [float("inf")] + [0.5] * 15, 1), (14120, [], 1),
    (None, [0.25] * 16, 1), (14140, [1.0, 0.5], 1), (14141, [0.5, 0.5], 2), (14200, [0.5] * 16, None),
]


# -- op13 ------------------------------------------------------------------------------------


def usable(row):
    v = row[1]
    return row[0] is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def nearest_brute(rows, k=20):
    rows = list({(r[0], tuple(r[1])): r for r in rows if usable(r)}.values())
    out = {}
    for q in rows:
        if q[0] % 20 == 0:
            scored = [(-float(np.dot(np.float64(np.float32(q[1])), np.float64(np.float32(r[1])))), r[0]) for r in rows if r[0] != q[0] and len(r[1]) == len(q[1])]
            out[q[0]] = sorted(scored)[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((-r["score"], r["vec_id"]))
    return out


def test_op13_recall_over_the_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = answers(nearest.op13_nearest_neighbours(spark, SF))
    want = nearest_brute([(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()])
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.98
    exact = dict(((q, i), s) for q in want for s, i in want[q])
    assert all(abs(s - exact[q, i]) < 1e-12 for q in got for s, i in got[q] if (q, i) in exact)


def test_op13_recall_among_many_unrelated_vectors(spark):
    rows = random_rows(6000, 64, seed=3)
    got = answers(nearest.search(nearest.askers(vectors_of(spark, rows)), nearest.index(vectors_of(spark, rows))))
    x = np.array([r[1] for r in rows])
    hit = 0
    for q in got:
        s = x @ x[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:20].tolist()) & {i for _, i in got[q]})
    assert hit / (20 * len(got)) >= 0.97


def test_op13_codes_estimate_without_bias_and_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((4000, 32)) * rng.uniform(0.1, 9, (4000, 1)), rng.standard_normal(32)
    bits = nearest.width(32)
    packed, coef, err = nearest.encode(x, bits)
    guess = (nearest.signs(packed, bits) @ (nearest.frame(32, bits) @ q)) * coef
    off = (guess - x @ q) / (err * np.linalg.norm(q))
    assert abs(off.mean()) < 0.1 and 0.7 < off.std() < 1.3
    assert (np.abs(off) < nearest.SIGMAS).mean() > 0.97


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 13, 1 << 12, 1 << 10), (4, 16, 8, 3)])
def test_op13_copies_ties_and_odd_rows(spark, monkeypatch, sizes):
    for name, value in zip(("PER_BLOCK", "PER_STRIPE", "AT_ONCE", "QUERIES_AT_ONCE"), sizes, strict=True):
        monkeypatch.setattr(nearest, name, value)
    base = random_rows(150, seed=1)
    copies = [(1000 + i, base[0][1], 3) for i in range(100)]  # a third of all rows hold one vector
    rows = base + copies + ODD + [base[5], base[40]]
    got = answers(nearest.search(nearest.askers(vectors_of(spark, rows, clash=True)), nearest.index(vectors_of(spark, rows, clash=True)), sigmas=9))
    want = nearest_brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    assert [i for _, i in got[14140]] == [14141]


def test_op13_empty(spark):
    none = vectors_of(spark, [])
    assert nearest.search(nearest.askers(none), nearest.index(none)).count() == 0
    one = vectors_of(spark, [(0, [1.0, 2.0], 1)])
    assert nearest.search(nearest.askers(one), nearest.index(one)).count() == 0


# -- op11 ------------------------------------------------------------------------------------


def mined_brute(rows, every=100, k=5):
    part = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in {r[0]: r for r in sorted(part, reverse=True) if r[0] % every == 0}.values():
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in part if len(r[2]) == len(a[2])))
        for p, pid, _ in [s for s in scored if s[2] == a[1] and s[1] != a[0]][:k]:
            fit = [(s, i) for s, i, label in scored if label != a[1] and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a[0], pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("sizes", [(1 << 12, 1 << 12, 8), (3, 16, 1)])
def test_op11_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("PER_BLOCK", "PER_PIECE", "STEP"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    base = random_rows(400, seed=2, labels=3)
    copies = [(2000 + i, base[0][1], i % 3) for i in range(200)] + [(3000 + i, base[100][1], 1) for i in range(100)]
    rows = base + copies + ODD + [base[3], base[100]]
    got = mined(hard_negatives.mine(vectors_of(spark, rows, clash=True)))
    assert got and got == mined_brute(rows)


def test_op11_many_anchors_and_lengths(spark):
    rows = random_rows(120, 8, seed=4, labels=2) + [(1000 + r[0], r[1], r[2]) for r in random_rows(100, 5, seed=5, labels=2)]
    got = mined(hard_negatives.mine(vectors_of(spark, rows), every=4, k=3, low=80))
    assert got and got == mined_brute(rows, every=4, k=3)


def test_op11_prunes_before_the_last_dimension():
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 40, (2000, 64)).astype(np.int64) * np.repeat([1, 0], 32)  # the anchor's large dimensions decide
    anchor = hard_negatives.Anchor(-1, 1, [100] * 8 + [1] * 56, None, 5)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            out = np.asarray(self).__getitem__(key)
            if isinstance(key, np.ndarray):
                read.append(len(key))
            return out

    columns = [c.view(Watched) for c in np.ascontiguousarray(x.T)]
    anchor.meet(np.arange(2000), np.ones(2000, int), columns, x.min(0), x.max(0))
    want = np.lexsort((np.arange(2000), -(x @ anchor.v)))[:5]
    assert anchor.found[0].tolist() == want.tolist()
    assert sum(read[-8:]) < sum(read[:8]) / 20


def test_op11_empty_and_too_large(spark):
    assert hard_negatives.mine(vectors_of(spark, [])).count() == 0
    assert hard_negatives.mine(vectors_of(spark, [(0, [1.0], 1)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(vectors_of(spark, [(0, [1e9], 1), (1, [1.0], 1)])).count()


# -- op12 ------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_brute(docs, items, k=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = [(i, Counter(TERM.findall((t or "").translate(lower)))) for i, t in docs]
    n, length = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item in {i for i, _ in items}:
        places = []
        for text in {t for i, t in items if i == item and t is not None}:
            terms = set(TERM.findall(text.translate(lower)))
            scored = []
            for i, c in split:
                m = 100 - 90 + (90 * sum(c.values()) * n) // max(length, 1)
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
            places += sorted(scored)[:k]
        out += [(item, r + 1, p[3], -p[0]) for r, p in enumerate(sorted(places)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(spark, rows, key):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"{key} long, text string, n long, terms string, item int, nth int, gain int")


@pytest.mark.parametrize("per_shard, per_postings, summaries, vocabulary", [(8192, 64, 8 << 20, 32 << 20), (50, 4, 100, 200)])
def test_op12_equals_brute_force(spark, monkeypatch, per_shard, per_postings, summaries, vocabulary):
    monkeypatch.setattr(lexical, "PER_POSTINGS", per_postings)
    monkeypatch.setattr(lexical, "SUMMARIES", summaries)
    rng = random.Random(7)
    words = ["a", "The", "é", "日本", "x1", "ZEBRA", "ünï"] + [f"w{i}" for i in range(300)]
    skew = [1 / (i + 1) for i in range(len(words))]
    draw = lambda n: rng.choice([" ", "\n", "-", "\x00", "\u0085"]).join(rng.choices(words, skew, k=n))
    docs = [(i, draw(rng.randint(0, 60))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(None, docs[3][1]), (3, docs[3][1]), (1, None), (2, ""), (4, " .,;! "), (5, "w5 " * 30_000)]
    items = [(i, draw(12)) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (23, "nowhere"), (None, "w1 w2"), (3, "w7 w9"), (0, docs[7][1]), (24, docs[3][1])]
    got = ranked(lexical.rank(texts(spark, docs, "doc_id"), texts(spark, items + items[:2], "item_id"), per_shard=per_shard, vocabulary=vocabulary))
    assert got == ranked_brute(docs, items)


def test_op12_empty(spark):
    none, some = texts(spark, [], "doc_id"), texts(spark, [(1, "a b"), (2, None)], "doc_id")
    items = texts(spark, [(1, "a")], "item_id")
    assert lexical.rank(none, items).count() == 0
    assert lexical.rank(texts(spark, [(1, None)], "doc_id"), items).count() == 0
    assert lexical.rank(some, texts(spark, [], "item_id")).count() == 0
    assert lexical.rank(some, items).count() == 1


def test_op12_skips_blocks():
    rng = np.random.default_rng(8)
    n, v = 4000, 50
    start = np.arange(0, 4 * n + 1, 4)
    far = rng.random(n) < 0.5  # these hold one of the asked terms, weakly, among others
    term = np.where(far[:, None], [0, 40, 41, 42], [0, 1, 2, 3])
    gain = np.where(far[:, None] & (term == 0), rng.integers(1, 50, (n, 4)), rng.integers(500, 1000, (n, 4)))
    shard = lexical.Shard(np.arange(n), start, term.ravel(), gain.ravel(), np.full(v, 7))
    scored = []
    entries = shard.entries
    shard.entries = lambda docs: scored.append(docs) or entries(docs)
    got = shard.search(np.array([0, 1, 2, 3]), 10)
    scores = 7 * np.where(term < 4, gain, 0).sum(1)
    want = np.lexsort((np.arange(n), -scores))[:10]
    assert got == [(int(i), int(scores[i])) for i in want]
    opened = shard.opened.keys()
    assert sum(far[docs].sum() for docs in scored[len(opened) :]) < far.sum() / 2
