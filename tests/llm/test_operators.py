"""The ten operators against brute force, libraries and edge cases."""

import hashlib
import io
import itertools
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselake.llm import audio, byte_bpe, common, learning, licenses, line_dedup, mixing, quality, queries, rotation_codes, simhash, toxicity, warc_zip

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "fp long, key long, score double, ids string, dropped string, copies int, target string, tensor string, component_id string, class string, t int, h int, size int"


def docs_of(spark, rows, clash=False):
    """Documents from (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    schema = DOC
    if clash:
        full, schema = [(*r, *[None] * 13) for r in full], f"{DOC}, {CLASH}"
    return spark.createDataFrame(full, schema)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "same text here ok\nsecond line is long enough"), (6, "same text here ok\nsecond line is long enough"), (6, "same text here ok\nsecond line is long enough"), (None, "a null id text"), (7, "x" * 50_000 + " y" * 30_000), (8, "ünï çödé 日本語 😀'll we're\r\n\tend ")]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# -- op1 -------------------------------------------------------------------------------------


def brute_components(ids, fps, radius):
    f = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    label = common.unions(len(f), a, b)
    return {i: min(j for j, lab in zip(ids, label, strict=True) if lab == label[k]) for k, i in enumerate(ids)}


def test_op1_equals_brute_force(spark):
    rows = queries.QUERIES["op1_simhash_neardup"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    fps = {i: simhash.fold(simhash.shingle_hashes(t, 3)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    want = brute_components(list(fps), list(fps.values()), 2)
    assert {r.doc_id: r.component_id for r in rows.itertuples()} == want
    assert {r.doc_id: r.fingerprint for r in rows.itertuples()} == {i: f"{f:016x}" for i, f in fps.items()}


def test_op1_forest_links_all_within_radius_in_hot_shards(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)})
    signed = [(int(np.uint64(f).astype(np.int64)), k) for k, f in enumerate(fps)]
    reps = spark.createDataFrame(signed, "fp long, node long")
    roots = common.components(simhash.shard_forest(simhash.block_shards(reps, most=16), 2)).collect()
    got = {k: k for k in range(len(fps))} | {r["node"]: r["root"] for r in roots}
    assert got == brute_components(list(range(len(fps))), fps, 2)


def test_op1_odd_rows(spark):
    got = simhash.near_duplicates(docs_of(spark, ODD, clash=True)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == by[6]["component_id"] == 5
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_similar_documents_finds_what_jaccard_says(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    rows, pairs = [], []
    for d in range(0, 60, 2):
        a = rng.choices(words, k=400)
        b = list(a)
        for k in rng.sample(range(400), 3):
            b[k] = rng.choice(words)
        rows += [(d, " ".join(a)), (d + 1, " ".join(b))]
        pairs.append((d, d + 1))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of(spark, rows + [(100, None), (101, "")])).collect()}
    assert all(got[b] == a for a, b in pairs)
    assert got[100] == got[101] == 100 and len(set(got.values())) == 31


def jaccard(a, b):
    x, y = set(simhash.shingle_hashes(a, 5)), set(simhash.shingle_hashes(b, 5))
    return len(x & y) / len(x | y)


def test_similar_documents_with_repeated_lines(spark):
    rng = random.Random(3)
    rows = []
    for d in range(0, 40, 2):
        text, line = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(k)) for k in (300, 10))
        rows += [(d, f"{text}\n{line}"), (d + 1, "\n".join([text] + [line] * 60))]
    assert all(jaccard(rows[d][1], rows[d + 1][1]) > 0.9 for d in range(0, 40, 2))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {d: d - d % 2 for d in range(40)}


def test_similar_documents_at_the_threshold_in_hot_shards(spark):
    rng = random.Random(4)
    keys = lambda t: set(simhash.band_keys(simhash.min_hashes(simhash.shingle_set(simhash.word_hashes(t), 5))))
    texts = []
    while len(texts) < 4:  # pairs just above 0.8 with a single band in common
        a = [f"u{rng.randrange(10**6)}" for _ in range(200)]
        b = a[:178] + [f"u{rng.randrange(10**6)}" for _ in range(20)]
        if jaccard(" ".join(a), " ".join(b)) >= 0.8 and len(keys(" ".join(a)) & keys(" ".join(b))) == 1:
            texts += [" ".join(a), " ".join(b)]
    chain = [f"t{k}" for k in range(240)]  # a chain whose far ends aren't alike, and copies at 0.8 to 0.85 of one text
    texts += [" ".join(chain[k * 5 : k * 5 + 150]) for k in range(10)]
    base = [f"s{k}" for k in range(300)]
    texts += [" ".join(base[: 300 - rng.randrange(30)] + [f"r{d}_{k}" for k in range(rng.randrange(22, 30))]) for d in range(30)]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    label = common.unions(len(texts), *np.array(near).T)
    for most in (1, 2048):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of(spark, list(enumerate(texts))), most=most).collect()}
        assert [got[k] for k in range(len(texts))] == label.tolist(), most


# -- op2 -------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    fixed, want = {}, total * sum(sizes.values())
    while True:
        rest = {s: (want - sum(fixed.values())) * w[s] / sum(w[x] for x in order if x not in fixed) for s in order if s not in fixed}
        over = {s: cap * sizes[s] for s, t in rest.items() if t > cap * sizes[s]}
        if not over:
            return fixed | rest
        fixed |= over


def test_op2_targets_and_words_taken(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(600)] + [(900, None, "a"), (901, "", "b")]
    got = mixing.mix(docs_of(spark, rows).drop("n_chars")).toPandas()
    own = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in ("a", "b", "c", None)}
    want = brute_targets(own)
    for s, t in want.items():
        part = got[got.source.isna()] if s is None else got[got.source == s]
        assert part.target.iloc[0] == pytest.approx(t) and part.source_size.iloc[0] == own[s]
        assert (part.copies * part.mix_size).sum() == pytest.approx(t, abs=30)
    assert set(got.copies) <= {0, 1, 2}
    again = mixing.mix(docs_of(spark, rows[::-1]).drop("n_chars")).toPandas()
    assert dict(zip(got.doc_id, got.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))


def test_op2_tilts_equal_bisection(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(1, 80)), rng.choice("abbbc")) for k in range(400)]
    sizes = {s: np.array([len(r[1].split()) for r in rows if r[2] == s], float) for s in "abc"}
    counts = spark.createDataFrame([(s, int(n), int((v == n).sum())) for s, v in sizes.items() for n in np.unique(v)], "source string, size long, n long")
    goals = spark.createDataFrame([(s, float(v.sum()), float(v.mean()), float(v.sum() * f)) for (s, v), f in zip(sizes.items(), (0.4, 1.1, 1.9), strict=True)], "source string, source_size double, mean_size double, target double")
    for r in mixing.tilts(counts, goals).collect():
        v, low, high = sizes[r["source"]], -100.0, 100.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (v * np.minimum(2, np.exp(np.minimum(mid * v / v.mean(), 700)))).sum() < r["target"] else (low, mid)
        assert r["lam"] == pytest.approx(low, rel=1e-5, abs=1e-7)


def test_op2_repeated_rows_are_weighed_by_their_count(spark):
    rows = [(1, "w " * 7, "a")] * 50 + [(k, "w " * (k % 5 + 1), "a") for k in range(2, 200)] + [(k, "w w w", "b") for k in range(300, 500)]
    got = mixing.mix(docs_of(spark, rows).drop("n_chars")).toPandas()
    for _, part in got.groupby("source"):
        assert abs((part.copies * part.mix_size).sum() - part.target.iloc[0]) <= 3


def test_op2_odd_rows(spark):
    assert mixing.mix(docs_of(spark, ODD, clash=True)).count() == len(ODD)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None), (2, "")])).count() == 2


# -- op3, op6 --------------------------------------------------------------------------------


def held_out(spark, name, label):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = rows.merge(truth, on="doc_id")
    m = m[m.held_out]
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert set(rows[rows.held_out].doc_id) == {i for i in rows.doc_id if zlib.crc32(str(i).encode()) % (5 if label == "quality" else 3) == (0 if label == "quality" else 1)}
    return m


def test_op3_held_out_accuracy(spark):
    m = held_out(spark, "op3_quality", "quality")
    assert (m.predicted == m.quality).mean() >= 0.95


def test_op6_held_out_accuracy(spark):
    m = held_out(spark, "op6_toxicity", "toxic")
    assert (m.predicted == m.toxic).mean() >= 0.85


def test_classifiers_odd_rows(spark):
    odd = docs_of(spark, ODD, clash=True)
    few = labels_of(spark, [(4, 1, 0), (5, 0, 1), (6, 0, 1), (8, 1, 0), (99, 1, 1)])
    for module, scored in ((quality, lambda df, m: quality.score(df, m)), (toxicity, lambda df, m: toxicity.score(df, m))):
        for labels in (few, few.limit(0)):
            model = module.train(odd, labels, "true")
            got = scored(odd.select("doc_id", "lang", "text"), model).collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
            same = [r["score"] for r in got if r["doc_id"] in (5, 6)]
            assert len(set(same)) == 1
        assert scored(odd.limit(0).select("text"), module.train(odd.limit(0), few, "true")).count() == 0


def test_crf_marginals_equal_enumeration():
    chain, rng = quality.Chain(), np.random.default_rng(5)
    chain.ties = rng.normal(size=(2, 2))
    lengths = np.array([1, 4, 3])
    score = rng.normal(size=8)
    starts = np.cumsum(lengths) - lengths
    good, joint = chain.marginals(score, starts, lengths)
    want, want_joint = np.zeros(8), np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        ways = {y: np.exp(sum(score[s + k] * y[k] for k in range(n)) + sum(chain.ties[y[k], y[k + 1]] for k in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(ways.values())
        for y, p in ways.items():
            want[s : s + n] += np.array(y) * p / z
            for k in range(n - 1):
                want_joint[y[k], y[k + 1]] += p / z
    assert np.allclose(good, want) and np.allclose(joint, want_joint)


def test_cnn_pooling_over_windows_is_whole(monkeypatch):
    net = toxicity.Net()
    words = [f"w{k % 97}" for k in range(500)]
    whole = net.scores([" ".join(words), "", None, "one"])
    monkeypatch.setattr(toxicity, "WINDOW", 7)
    assert np.allclose(whole, net.scores([" ".join(words), "", None, "one"]), atol=1e-5)


def test_op3_commonest_word_of_a_long_line():
    words = ["again"] * 60 + [f"w{k}" for k in range(60)]
    row = quality.line_features(" ".join(words))[0][0]
    assert abs(row[quality.NAMES.index("commonest")] - 0.5) < 1e-6


def test_op6_scores_equal_slow_convolution():
    net, rng = toxicity.Net(), random.Random(8)
    texts = [" ".join(rng.choice(["Ab", "ünï", "w7", "longer-word", "x"]) for _ in range(n)) for n in (1, 2, 3, 40)]
    for text, got in zip(texts, net.scores(texts), strict=True):
        words = toxicity.words_of(text)
        buckets, starts = toxicity.pieces_of(words)
        v = [net.table[b].sum(0) / np.sqrt(len(b)) for b in np.split(buckets, starts[1:])]
        pooled = [max(sum(v[p + k] @ f[k][:, c] for k in range(w) if p + k < len(v)) for p in range(len(v))) for w, f in zip(toxicity.WIDTHS, net.filters, strict=True) for c in range(toxicity.FILTERS)]
        want = learning.sigmoid(np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.offset[0])
        assert abs(got - want) < 1e-5
        assert net.scores([text])[0] == got


def test_calibration_is_monotone():
    x = np.linspace(-2, 2, 50)
    slope, shift = learning.calibrate(x, (x > 0.3).astype(float), np.ones(50))
    assert slope > 0 and learning.sigmoid(slope * np.array([2.0]) + shift)[0] > 0.9


# -- op4 -------------------------------------------------------------------------------------


def test_op4_equals_brute_force(spark):
    rows = [(1, "intro words\nLicensed under the Apache License, version 2.0\nmore"), (2, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software"), (3, "all rights reserved"), (4, licenses.TEMPLATES[5][1].replace("free", "gratis"))] + [(k + 10, t) for k, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, rows, clash=True)).collect()}
    sets = [licenses.bigrams(licenses.normal_words(t)) for _, t in licenses.TEMPLATES]

    def dice(words):
        own = licenses.bigrams(words) if words else set()
        return [2 * len(own & s) / (len(own) + len(s)) for s in sets] if own else [0.0] * len(sets)

    for i, text in rows:
        units = [licenses.normal_words(x) for x in (text or "").split("\n")] + [licenses.normal_words(text or "")]
        best = max(((d, -k) for u in units for k, d in enumerate(dice(u)) if d >= licenses.THRESHOLD), default=None)
        assert got[i]["license"] == (licenses.TEMPLATES[-best[1]][0] if best else None)
        assert got[i]["score"] == pytest.approx(best[0] if best else 0.0)
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def test_op4_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.SQL["op4_license_scan"]).df().sort_values("doc_id")[["doc_id", "license", "score", "n_lines"]]
    got = queries.QUERIES["op4_license_scan"](spark, SF).toPandas().sort_values("doc_id")[["doc_id", "license", "score", "n_lines"]]
    assert [tuple(map(str, r)) for r in got.fillna("").values] == [tuple(map(str, r)) for r in want.fillna("").values]


def test_op4_spans_across_and_inside_lines():
    rng = random.Random(31)
    filler = lambda n: [rng.choice(["the", "of", "license", "this", "software", "rights", "and", "under", "word", "all"]) for _ in range(n)]
    scanner = licenses.Scanner()
    sets = [licenses.bigrams(licenses.normal_words(t)) for _, t in licenses.TEMPLATES]
    gpl = licenses.TEMPLATES[8][1].split()
    wrapped = "\n".join(" ".join(gpl[k : k + 10]) for k in range(0, len(gpl), 10))
    long = f"a program of ours\n\n{wrapped}\n" + "\n".join("nothing more to say here" for _ in range(90))
    assert scanner.scan(long) == ("GPL-3.0", 1.0, list(range(2, 2 + wrapped.count("\n") + 1)))
    inside = " ".join(["one"] * 20 + "Released under the MIT License.".split() + ["two"] * 20)
    assert scanner.scan(f"first\n{inside}\nlast") == ("MIT", 1.0, [1])
    assert scanner.scan("all rights reserved " * 5000)[:2] == ("All-rights-reserved", 1.0)
    for _ in range(25):
        words = [*filler(rng.randrange(12)), *rng.choice(licenses.TEMPLATES)[1].split()[: rng.randrange(4, 30)], *filler(rng.randrange(12))]
        for k in rng.sample(range(len(words)), 2):
            words[k] = rng.choice(["the", "license", "x"])
        text = " ".join(w + rng.choice(["", "", "\n"]) for w in words)
        flat = licenses.normal_words(text)
        best = max(((2 * len(g & s) / (len(g) + len(s)), -k) for a, b in itertools.combinations(range(len(flat) + 1), 2) for g in [licenses.bigrams(flat[a:b])] for k, s in enumerate(sets)), default=(0, 0))
        got = scanner.scan(text)
        assert got[:2] == ((licenses.TEMPLATES[-best[1]][0], best[0]) if best[0] >= licenses.THRESHOLD else (None, 0.0))


# -- op5 -------------------------------------------------------------------------------------


def test_op5_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "hello"), (3, "http://a/2", "hello"), (9, None, None), (10, "u\r\nv", ""), (11, "http://b", "é" * 1000), (3, "http://a/2", "hello"), (None, "n", "hello")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    raw = pages.selectExpr("page_id", "url", "CAST(coalesce(html, '') AS binary) AS payload")
    written = common.cut(warc_zip.write_archives(warc_zip.with_revisits(raw), str(tmp_path / "arch"), roll=600))
    got = warc_zip.read_archives(written).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        html = next(x[2] or "" for x in rows if x[0] == r["page_id"]).encode()
        first = min(x[0] for x in rows if x[0] is not None and (x[2] or "").encode() == html)
        assert r["payload_digest"] == warc_zip.sha1_base32(html) and r["payload_bytes"] == len(html)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
        assert r["payload"] == (bytearray(html) if r["page_id"] == first else None)
    for uri in [r["uri"] for r in written.collect()]:
        assert zipfile.ZipFile(uri).testzip() is None
    joined = warc_zip.with_revisits(raw, most_broadcast=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, warc_zip.with_revisits(raw).collect()))
    empty = common.cut(warc_zip.write_archives(warc_zip.with_revisits(raw.limit(0)), str(tmp_path / "none")))
    assert warc_zip.read_archives(empty).count() == 0


def test_op5_zip64_and_broken_archives(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    w = warc_zip.Writer(out)
    records = [warc_zip.record_bytes(k, f"http://{k}", b"x" * k, None, "2024-01-01T00:00:00Z") for k in range(50)]
    for r in records:
        w.add(r)
    w.close()
    f = warc_zip.Range(out.getvalue())
    assert struct.unpack("<H", out.getvalue()[-12:-10])[0] in (2, 0xFFFF)
    assert [f.read(a, n) for a, n in warc_zip.record_ranges(f)] == records
    with pytest.raises(ValueError):
        list(warc_zip.record_ranges(warc_zip.Range(out.getvalue()[:-40])))
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:  # two members and no index, as others may write them
        z.writestr("archive/a.warc", b"".join(records[:20]))
        z.writestr("archive/b.warc", b"".join(records[20:]))
    f = warc_zip.Range(other.getvalue())
    assert [f.read(a, n) for a, n in warc_zip.record_ranges(f)] == records
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w", zipfile.ZIP_STORED) as z:
        z.writestr("readme.txt", "nothing")
    for broken in (lambda: list(warc_zip.record_ranges(warc_zip.Range(bare.getvalue()))), lambda: warc_zip.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")):
        with pytest.raises(ValueError):
            broken()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.WARC_MEMBER, "x" * 100)
        z.writestr(warc_zip.INDEX_MEMBER, "")
    with pytest.raises(ValueError):
        list(warc_zip.record_ranges(warc_zip.Range(packed.getvalue())))


# -- op7 -------------------------------------------------------------------------------------


def test_op7_recall_and_exactness(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(400, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.88, 0.99, 400)[:, None]
    x = np.concatenate((base, cos * base + np.sqrt(1 - cos**2) * side, base[:5])).astype(np.float32)
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(9000 + k, b, 1) for k, b in enumerate(bad)]
    got = {r["vec_id"]: r for r in rotation_codes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int"), most=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    links = np.array([got[k]["n_links"] for k in range(len(u))])
    assert (links <= true.sum(1)).all() and links.sum() >= 0.9 * true.sum()
    assert all(got[800 + k]["component_id"] == k and not got[800 + k]["kept"] for k in range(5))
    assert all(got[9000 + k]["n_links"] == 0 and got[9000 + k]["kept"] for k in range(7))
    assert rotation_codes.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op7_recall_just_above_the_threshold_among_many(spark):
    rng = np.random.default_rng(16)
    base = rng.normal(size=(8000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9005, 0.92, 8000)[:, None]
    x = np.concatenate((base, cos * base + np.sqrt(1 - cos**2) * side))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = rotation_codes.near_duplicates(rows).filter("vec_id >= 8000 AND component_id = vec_id - 8000 AND n_links = 1").count()
    assert found >= 0.9 * 8000


def test_op7_bounds_hold():
    rng = np.random.default_rng(7)
    u = rotation_codes.unit(rng.normal(size=(300, 64)))
    o, packed, f = rotation_codes.codes(u)
    up = rotation_codes.upper_bounds(o, packed, f)
    assert (up >= u @ u.T - 1e-5).mean() > 0.999


# -- op8 -------------------------------------------------------------------------------------


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.vocabulary(byte_bpe.default_path())[0], special_tokens={})


def test_op8_equals_tiktoken():
    tk, coder, rng = tiktoken_encoding(), byte_bpe.Encoder(byte_bpe.default_path(), most=500), random.Random(8)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "1", "23", "a", "Z", "é", "日", "!", "#", " ", "　", "\x85", "\x00", "٣", "²", "😀", "́", "''", "\x1c", "​", "\r\n", "'S", "word"]
    for _ in range(3000):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(rng.choice((1, 2, 5)))]
        assert [x.tolist() for x in coder.encode(texts)] == [tk.encode_ordinary(t) for t in texts]
    long = "a" * 5000 + "bc" * 3000
    assert coder.encode([long])[0].tolist() == tk.encode_ordinary(long)


def test_op8_round_trip_and_offsets(spark):
    path, tk = byte_bpe.default_path(), tiktoken_encoding()
    coded = byte_bpe.encode(docs_of(spark, ODD, clash=True), path)
    for r in byte_bpe.decode(coded, path).collect():
        raw = (r["text"] or "").encode()
        assert r["ids"] == tk.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == raw
        assert (r["ends"][-1] if r["ids"] else 0) == len(raw)
    got = byte_bpe.digests(docs_of(spark, [(1, "hello world")]), path).first()
    ids = tk.encode_ordinary("hello world")
    assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert byte_bpe.digests(docs_of(spark, []), path).count() == 0


# -- op9 -------------------------------------------------------------------------------------


def test_op9_drops_what_recurs(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(n))
    passage = prose(60)
    rows = [(k, "\n".join([prose(80), f"Printed on 2024-01-{k:02d} by user{k} for the archive" if k < 4 else prose(7), passage if k in (1, 5, 9) else prose(60), "Yes.", prose(30)])) for k in range(1, 12)]
    copy = rows[10][1]
    rows += [(50, copy), (51, copy + "\none more line of its own"), (60, None), (61, ""), (None, passage)]
    out = {r["doc_id"]: r for r in line_dedup.without_recurring_lines(docs_of(spark, rows, clash=True)).collect()}
    assert out[1]["dropped"] is None and out[5]["dropped"] == [2] and out[9]["dropped"] == [2]
    assert out[2]["dropped"] == [1] and out[3]["dropped"] == [1]
    assert passage not in out[5]["text"] and "Yes." in out[5]["text"]
    assert out[11]["dropped"] is None and out[50]["dropped"] is None and out[51]["dropped"] is None
    assert out[60]["text"] is None and out[61]["text"] == "" and out[None]["dropped"] is None
    assert line_dedup.without_recurring_lines(docs_of(spark, [])).count() == 0


def test_op9_counts_apart_what_near_dedup_leaves_apart(spark):
    rng = random.Random(19)
    line, common = "the same notice stands in all of these texts", ["".join(rng.choices("abcdefghij", k=8)) for _ in range(40)]
    rows = []
    for d in range(1, 9):  # the same words in another order: word sets alike, shingles not
        rng.shuffle(common)
        rows.append((d, " ".join(common) + "\n" + line))
    out = {r["doc_id"]: r["dropped"] for r in line_dedup.without_recurring_lines(docs_of(spark, rows)).collect()}
    assert out == {1: None, **{d: [1] for d in range(2, 9)}}


def test_op9_template_generalises_fields(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota".split()
    lines = [" ".join([*words, w]) for w in ("red", "green", "blue")] + ["alpha beta other words that differ in most of these places"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "leaf long, h long, masked string")
    got = {r["h"]: r["template"] for r in line_dedup.template_links(rows, 0.8).collect()}
    assert got == {1: 0, 2: 0}
    same = [F.lit(1).cast("long").alias(f"leaf{k}") for k in line_dedup.DEPTHS]
    assert len({r["leaf"] for r in line_dedup.leaves(rows.select("h", "masked", *same), leaf_rows=1).collect()}) == 4
    assert len({r["leaf"] for r in line_dedup.leaves(rows.select("h", "masked", *same), leaf_rows=4).collect()}) == 1
    assert line_dedup.masked_tokens(b" a  b1 c@d e/f\tg ") == [b"a", b"<*>", b"<*>", b"<*>", b"g"]


def test_op9_large_leaves_give_what_small_ones_give(spark):
    rng = random.Random(29)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(12)]
    lines = []
    for _ in range(40):
        line = list(base)
        for k in rng.sample(range(4, 12), rng.choice((1, 2, 3, 4, 5))):
            line[k] = word() if rng.random() < 0.7 else "other"
        lines.append(" ".join(line))
    lines += [" ".join([*base[:4], word()]) for _ in range(5)]  # a free word in the fifth of five places
    docs = docs_of(spark, list(enumerate(lines)))
    rows = [x.split() for x in lines]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(rows[i]) == len(rows[j]) and sum(map(str.__eq__, rows[i], rows[j])) >= 0.8 * len(rows[i])]
    label = common.unions(len(rows), *np.array(pairs).T).tolist()
    want = {k for k, root in enumerate(label) if root != k}
    for leaf_rows in (4, 4000):
        got = {r["doc_id"] for r in line_dedup.recurring_lines(docs, leaf_rows=leaf_rows).collect()}
        assert got == want and 0 < len(want) < len(rows) - 2, leaf_rows


def slow_line_dedup(rows, least_tokens=4, alike=0.8):
    """(doc_id, pos) to drop, with every pair of lines of a leaf and every pair of documents compared."""
    lines = [(d, p, tuple(line_dedup.masked_tokens(x))) for d, t in rows for p, x in enumerate((t or "").encode().split(b"\n"))]
    lines = [x for x in lines if len(x[2]) >= least_tokens]
    kinds = sorted({x[2] for x in lines})
    leaf = {}
    for k, t in enumerate(kinds):
        leaf.setdefault((len(t), t[:4]), []).append(k)
    pairs = [(i, j) for own in leaf.values() for i, j in itertools.combinations(own, 2) if np.mean([a == b for a, b in zip(kinds[i], kinds[j], strict=True)]) >= alike]
    template = dict(zip(kinds, common.unions(len(kinds), *np.array(pairs or np.empty((0, 2), int)).T.astype(int)).tolist(), strict=True))
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w)} if len(w) <= 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = dict(zip([d for d, _ in rows], common.unions(len(rows), *np.array(near or np.empty((0, 2), int)).T.astype(int)).tolist(), strict=True))
    where = {}
    for d, _, t in lines:
        where.setdefault(template[t], set()).add(d)
    return {(d, p) for d, p, t in lines if len({group[x] for x in where[template[t]]}) >= 2 and d != min(where[template[t]])}


def test_op9_equals_brute_force(spark):
    rng = random.Random(12)
    words = [f"k{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(5, 60))) for _ in range(12)]
    rows = []
    for d in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randrange(2, 30))) for _ in range(6)]
        for _ in range(rng.randrange(3)):
            w = rng.choice(passages).split()
            if rng.random() < 0.5:
                w[-1] = rng.choice(["7", "x@y", "other"])
            parts.insert(rng.randrange(len(parts)), " ".join(w))
        rows.append((d, "\n".join(parts)))
    rows += [(60 + k, rows[k][1]) for k in range(6)] + [(70 + k, rows[k][1] + " one more") for k in range(6)]
    want = slow_line_dedup(rows)
    assert len(want) > 20
    for how in ({}, {"most_broadcast": 0, "leaf_rows": 2}):
        assert {tuple(r) for r in line_dedup.recurring_lines(docs_of(spark, rows), **how).collect()} == want


def test_similar_documents_without_broadcast(spark):
    rows = [(k, " ".join(f"a{j}" for j in range(k // 3, 200 + k // 3 * 50))) for k in range(30)]
    both = [sorted(tuple(r) for r in simhash.similar_documents(docs_of(spark, rows), most_broadcast=m).collect()) for m in (0, 1000)]
    assert both[0] == both[1] and both[0][1] == (1, 0)


# -- op10 ------------------------------------------------------------------------------------


def slow_windows(text):
    """Log-mel windows of a text's stored bytes, sample by sample and frame by frame."""
    raw = (text or "").encode()
    x = (np.frombuffer(raw + b"\0" * (-len(raw) % 64 if raw else 64), np.uint8) - 128.0) / 128
    taps = np.zeros(81)
    n = np.arange(-40, 41)
    taps[:] = np.sinc(n / 4) * np.kaiser(81, 6.0) / 4 * 3
    wide = np.zeros(len(x) * 3)
    wide[::3] = x
    y = np.convolve(wide, taps)[40 : 40 + len(wide)][::4]
    frames = [y[k * audio.HOP : k * audio.HOP + audio.FRAME] for k in range(1 + max(0, -(-(len(y) - audio.FRAME) // audio.HOP)))]
    mels = [np.log(np.abs(np.fft.rfft(np.pad(f, (0, audio.FRAME - len(f))) * np.hanning(audio.FRAME + 1)[:-1])) ** 2 @ audio.mel_bank(6000) + 1e-8) for f in frames]
    return np.array(mels)


def test_op10_payload_and_features(spark, monkeypatch):
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    got = audio.audio_columns(docs_of(spark, ODD, clash=True).selectExpr("*", f"{audio.padded()} AS payload"), "payload").collect()
    assert len(got) == len(ODD)
    for r in got:
        raw = (r["text"] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert bytes(r["samples"]) == want and bytes(r["media"]) == audio.to_wav(want)
        stored = audio.windows_of(bytes(r["tensors"]))
        assert stored.schema.field("window").type == audio.TENSOR and stored.num_rows == r["n_windows"]
        tensor = stored.column("window").combine_chunks().to_numpy_ndarray()
        slow = slow_windows(r["text"])
        assert np.abs(tensor.reshape(-1, audio.MELS)[: len(slow)] - slow).max() < 0.011 and not tensor.reshape(-1, audio.MELS)[len(slow) :].any()
        assert stored.column("start")[0].as_py() == 0 and abs(stored.column("stop")[-1].as_py() - len(want) / 8000) < 1e-3
    five, six = ([r for r in got if r["doc_id"] == k][0] for k in (5, 6))
    assert five["tensors"] == six["tensors"] and five["voiced"] == six["voiced"]
    nothing = audio.audio_columns(spark.createDataFrame([(None,), (bytearray(audio.to_wav(b"")),)], "media binary")).collect()
    assert nothing[0]["tensors"] is None and nothing[1]["n_windows"] == 0 and nothing[1]["voiced"] == []


def test_op10_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = audio.resample(np.sin(2 * np.pi * 500 * t), 8000, 6000)
    want = np.sin(2 * np.pi * 500 * np.arange(6000) / 6000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 0.01
    assert np.allclose(y[1234:2345], audio.resample(np.sin(2 * np.pi * 500 * t), 8000, 6000, 1234, 2345))


def test_op10_hysteresis():
    level = np.array([-50, -15, -10, -15, -16, -50, -15, -50, -5, -5], float)
    spans = audio.segments(level, 6000)
    assert [round(a * 6000 / audio.HOP) for a, _ in spans] == [2, 8]


# -- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs_of(spark, [(10**6 + (r[0] or 0), *r[1:]) if r[0] else r for r in ODD], clash=True)
    for name, stage in P.STAGES:
        for given in (odd, odd.limit(0)):
            got = stage(spark, given, SF)
            if name != "byte_bpe":
                assert got.columns == given.columns
            got.collect()
    seen = docs
    for name, stage in P.STAGES:
        before, seen = seen, common.cut(stage(spark, seen, SF))
        if name == "simhash_near_dedup":
            texts = [r["text"] for r in seen.select("text").collect()]
            assert len(texts) == len(set(texts)) < before.count()
    assert seen.filter("NOT exact").count() == 0 and seen.count() > 0


def test_pipeline_near_dedup_goes_by_fingerprints_and_by_sets(spark):
    import corpus_pipeline as P

    base = " ".join(f"b{k}" for k in range(11))
    by_print = [(10 + k, " ".join([base] * 60 + [f"t{k}x{j}" for j in range(40)])) for k in range(2)]  # repeats outweigh unlike ends
    words = [f"w{j}" for j in range(300)]
    by_set = [(20, " ".join(words)), (21, " ".join(words[:255]))]
    apart = [(30 + k, " ".join(f"q{k}y{j}" for j in range(50))) for k in range(2)]
    docs = docs_of(spark, by_print + by_set + apart)
    assert len({r["component_id"] for r in simhash.similar_documents(docs).collect()}) == 5
    assert len({r["component_id"] for r in simhash.near_duplicates(docs).collect()}) == 5
    left = P.near_dedup_stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in left.collect()) == [10, 20, 30, 31]


def test_pipeline_moves_the_same_at_any_size(spark, monkeypatch):
    """Documents meet their dropped lines by shuffle however few these are; sets of shingles move for repeated ids only, with equal groups."""
    import corpus_pipeline as P

    docs = common.table(spark, SF, "documents")
    plan = P.line_dedup_stage(spark, docs, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    cuts = []
    monkeypatch.setattr(simhash, "cut", lambda df, *a, cut=simhash.cut: cuts.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or cut(df, *a))
    once = docs.limit(100).selectExpr("doc_id", "text")
    groups = [sorted({tuple(r) for r in simhash.similar_documents(d).collect()}) for d in (once, once.unionAll(once))]
    assert groups[0] == groups[1] and any(a != b for a, b in groups[0])
    moved = [plan.count("Exchange hashpartitioning") for columns, plan in cuts if "shingles" in columns]
    assert moved == [0, 1]


def test_components_plans_stay_small(spark, monkeypatch):
    """The driver's memory goes with plans: a round is one exchange and a window unless a node has too many links for a task."""
    cut, plans = common.cut, []
    monkeypatch.setattr(common, "cut", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *more))
    chain = [(k, k + 1) for k in range(300, 340)]
    for hub, joined in ((60, False), (2000, True)):
        links = [(7, k + 1000) for k in range(hub)] + [(1000 + hub + k, 1000 + k) for k in range(hub)] + chain
        got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
        assert got == {k + 1000: 7 for k in range(2 * hub)} | {k: 300 for k in range(301, 341)}
        assert any("Join" in p for p in plans) == joined
        plans.clear()


def test_join_counted_with_and_without_frequent_keys(spark):
    for most in (5, 3000):
        rows = spark.createDataFrame([(k % 7, k) for k in range(200)] + [(1, k) for k in range(most)], "t long, x long")
        counted = common.cut(rows.filter("t < 5").groupBy("t").agg(F.min("x").alias("low"), F.count("*").alias("n")))
        got = common.join_counted(rows, counted, "t", 200 + most)
        assert ("Union" in got._jdf.queryExecution().analyzed().toString()) == (most == 3000)
        want = rows.join(counted.drop("n"), "t")
        assert sorted(map(tuple, got.select("t", "x", "low").collect())) == sorted(map(tuple, want.select("t", "x", "low").collect()))
