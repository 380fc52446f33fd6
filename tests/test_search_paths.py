"""Label rules by automaton, the vector index, HTML tables and sections, outline regions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselake.operators import labels as A
from caselake.operators import structure as D
from caselake.operators import vector_index as V
from caselake.operators.retrieval import vector_search


def rule_rows(spark, rules):
    return spark.createDataFrame(rules, "place string, pattern string, label string, rank int")


def labelled(df):
    return {r["section_id"]: (r["label"], r["label_confidence"]) for r in df.collect()}


def test_rules_by_automaton_equal_the_array(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)] + ["straße", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    sections = spark.createDataFrame([(k, text(6).title(), text(200)) for k in range(300)] + [(400, None, "w1 w2"), (401, "W3 w4", None), (402, None, None), (403, "", "")], "section_id int, section_title string, section_text string")
    rules = [(rng.choice(("title", "body")), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), f"L{rng.randrange(9)}", rng.randrange(5)) for _ in range(60)]
    for more in ([], [("body", "", "any", 9)], [("title", "", "t", 9)]):
        table = rule_rows(spark, rules[: 64 - len(more)] + more)
        want = labelled(D.label_sections(sections, table))
        assert want == labelled(D.label_sections(sections, table, few=0)) and len({x for x, _ in want.values()}) > 1
        texts = sections.select("section_id", F.lower("section_title").alias("_t"), F.lower(F.substring("section_text", 1, 500)).alias("_b"))
        apart = {r["section_id"]: r["m"] and tuple(r["m"]) for r in A.first_rules(texts, table, group_bytes=60).collect()}
        assert {k: (m[2] if m and m[0] is not None else "unrecognized") for k, m in apart.items()} == {k: x for k, (x, _) in want.items()}


def test_fifty_thousand_rules(spark):
    rng = random.Random(2)
    rules = [("title" if k % 2 else "body", f"{rng.randrange(10**7):07d}", f"L{k}", k) for k in range(50_000)]
    first = {}
    for place, pattern, label, rank in reversed(rules):
        first[place, pattern] = label
    picked = [rng.choice(rules) for _ in range(200)]
    rows = [(k, f"x{p[1]}y" if p[0] == "title" else "none", f"a{p[1]}b" if p[0] == "body" else "") for k, p in enumerate(picked)]
    got = labelled(D.label_sections(spark.createDataFrame(rows, "section_id int, section_title string, section_text string"), rule_rows(spark, rules)))
    assert got == {k: (first[p[0], p[1]], 1.0 if p[0] == "title" else 0.9) for k, p in enumerate(picked)}


def test_vector_index_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    x = np.concatenate([c + 0.5 * rng.standard_normal((50, 64)) for c in centres])
    rows = [(k, [float(v) for v in v_], "Contract" if k % 2 else "Pleading") for k, v_ in enumerate(x)]
    odd = [(9000, None, "Contract"), (9001, [0.0] * 64, "Contract"), (9002, [1.0] * 3, "Contract"), (9003, [float("nan")] * 64, "Contract"), (9004, [None] + [1.0] * 63, "Contract")]
    emb = spark.createDataFrame(rows + odd, "section_id long, embedding array<double>, document_type string")
    path = f"{tmp_path}/index"
    V.build_index(emb, path, 64, folders=4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = read = 0
    for q in range(0, 3000, 500):
        got = [r["section_id"] for r in V.approx_search(spark, path, list(x[q]), 10, 0.3).collect()]
        hit += len(set(got) & set(np.argsort(-(u @ u[q]), kind="stable")[:10].tolist()))
        read += V.candidates(spark, path, list(x[q])).count()
    assert hit / 60 >= 0.9 and read / 6 < 0.4 * len(x)
    exact = [(r["section_id"], r["semantic_score"]) for r in vector_search(emb.filter("section_id < 9000"), list(x[7]), 5, 0.3, document_types=["Contract"]).collect()]
    assert [(r["section_id"], r["semantic_score"]) for r in V.approx_search(spark, path, list(x[7]), 5, 0.3, spread=40, document_types=["Contract"]).collect()] == exact
    plan = V.candidates(spark, path, list(x[0]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "tab" in plan.split("PartitionFilters: [")[1][:400]
    assert V.approx_search(spark, path, [0.0] * 64).count() == 0
    with pytest.raises(ValueError):
        V.candidates(spark, path, [1.0])
    V.build_index(emb.limit(0), f"{path}-none", 64, folders=2)


def test_probes_come_in_the_order_of_distance():
    position = np.array([0.1, 2.5, -0.95])
    got = V.probed(position, 30)
    assert got[0].tolist() == [0, 2, -1]
    gap = lambda c: sum(max(0, lo - p, p - lo - 1) ** 2 for lo, p in zip(c, position, strict=True))
    assert [round(gap(c), 9) for c in got] == sorted(round(gap(c), 9) for c in got) and len({tuple(c) for c in got}) == len(got)


def pages_of(spark, *html):
    return D.html_elements(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))


def test_html_tables_are_rows(spark):
    html = "<p>before</p><table><tr><th>Name</th><th>Sum</th></tr><tr><td>A</td><td><p>1</p><p>2</p></td></tr><tr><td></td><td>x<table><tr><td>inner</td><td>y</td></tr></table></td><td>z</td></tr></table><p>after</p>"
    el = pages_of(spark, html, None, "<table><td>loose<td>cells", "</table><td>stray</td>")
    rows = {(r["page_id"], r["table_no"], r["row_no"]): r["cells"] for r in D.html_tables(el).collect()}
    assert rows == {(0, 1, 1): ["Name", "Sum"], (0, 1, 2): ["A", "1 2"], (0, 1, 3): ["", "x", "z"], (0, 2, 1): ["inner", "y"], (2, 1, 1): ["loose", "cells"]}
    text = {r["page_id"]: r["text"] for r in D.html_text(el).collect()}
    assert text == {0: "before\n| Name | Sum |\n| A | 1 2 |\n|  | x | z |\n| inner | y |\nafter", 2: "| loose | cells |", 3: "stray"}


def test_html_sections_follow_the_outline(spark):
    rng = random.Random(5)
    pages = []
    for _ in range(30):
        n = rng.randrange(2, 6)
        blocks = [(f"id{k}" if rng.random() < 0.7 else None, f"block {k}") for k in range(12)]
        entries = [(f"Entry {k}", rng.choice([b[0] for b in blocks if b[0]] + ["lost"])) for k in range(n)]
        pages.append((blocks, entries))
    html = ["<nav class='toc'>" + "".join(f"<a href='#{a}'>{t}</a>" for t, a in e) + "</nav>" + "".join(f"<p{f" id='{i}'" if i else ''}>{t}</p>" for i, t in b) for b, e in pages]
    got = {(r["page_id"], r["title"]): r["section_text"] for r in D.html_sections(pages_of(spark, *html)).collect()}
    for page, (blocks, entries) in enumerate(pages):
        place = {i: k for k, (i, _) in enumerate(blocks) if i}
        order = sorted(entries, key=lambda e: place.get(e[1], -1))
        for k, (title, anchor) in enumerate(order):
            at = place.get(anchor, -1)
            stop = place.get(order[k + 1][1], -1) if k + 1 < len(order) else len(blocks)
            assert got[page, title] == ("" if at < 0 else "\n".join(t for _, t in blocks[at:stop])), (page, title)


def region_of(text):
    """A slow version, line by line."""
    lines = [x.strip() for x in text.split("\n")]
    head = next((k for k, x in enumerate(lines) if re.fullmatch(r"(?i)(table\s+of\s+contents?|contents?|index)", x)), None)
    if head is None:
        return None
    out, blanks, found = [lines[head]], 0, False
    for x in lines[head + 1 :]:
        if re.search(D.OUTLINE_LINE, x):
            out.append(x)
            blanks, found = 0, True
        elif not x:
            blanks += 1
            if found and blanks > 3:
                break
        elif found:
            break
        else:
            out.append(x)
    return "\n".join(out) if found else None


def test_outline_regions_equal_a_slow_version(spark):
    rng = random.Random(6)
    pool = ["", "", "  ", "One ..... 3", "Two      14 ", "a line", "Contents", " TABLE OF  CONTENTS ", "x...7", "index of things"]
    docs = [(k, "\n".join(rng.choices(pool, [4, 3, 2, 6, 5, 1, 1, 1, 2, 1], k=rng.randrange(1, 40)))) for k in range(200)] + [(300, ""), (301, None)]
    got = {r["document_id"]: r["region"] for r in D.toc_region(D.lines_of(spark.createDataFrame(docs, "document_id int, text string"))).collect()}
    want = {k: region_of(t) for k, t in docs if t is not None}
    assert got == {k: r for k, r in want.items() if r is not None} and len(got) > 50
