"""Splitting, offsets, exhibits' pages, task levels, tools: against slow versions."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from caselake import api
from caselake.functions import scalar as S
from caselake.operators import aggregates as A
from caselake.operators import bodies as B
from caselake.operators import graph as G
from caselake.operators import retrieval as R
from caselake.operators import structure as D
from caselake.operators.search_function import register_search


def place_of(text, anchor, at):
    """Where an anchor stands, found by trying ever shorter beginnings of it."""
    tries = [anchor] + [anchor[:n].strip() for n in range(min(len(anchor), 70), 19, -5)] if anchor else []
    return next((p for t in tries if t and (p := text.find(t, at)) >= 0), -1)


def pieces_of(text, anchors, least):
    cuts = []
    for a in anchors[:15]:
        at = cuts[-1] + 1 if cuts else 0
        p = place_of(text, a, at)
        cuts.append(at if p < 0 else p)
    spans = [(s, e, text[s:e].strip()) for s, e in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    return [x for x in spans if len(x[2]) >= least]


def test_splitting_equals_a_slow_version(spark):
    rng = random.Random(5)
    rows, anchors, want = [], [], {}
    for sid in range(60):
        words = [rng.choice(["alpha", "beta", "ga mma", "\n", "délta", "😀", "ep"]) for _ in range(rng.choice([0, 3, 200, 400]))]
        text = " ".join(words)
        own = []
        for n in range(rng.choice([1, 4, 20])):
            at = int(len(text) * n / 20)
            own.append(rng.choice([text[at : at + rng.choice([5, 30, 90])], text[at : at + 38] + "####", "nowhere in the whole of this text", "", text[at : at + 75] + "##"]))
        rows.append((sid, 1, 2, text, 3, 7))
        anchors += [(sid, n, a, f"T{n}") for n, a in enumerate(own)]
        want[sid] = pieces_of(text, own, 50)
    rows += [(100, 1, 2, None, 1, 1), (101, 1, 2, "x" * 400, None, 4)]
    anchors += [(100, 0, "a", "t"), (101, 0, "xx", "t"), (102, 0, "of no section", "t"), (101, 1, None, None)]
    s = spark.createDataFrame(rows, "section_id long, document_id long, level int, section_text string, start_page int, end_page int").withColumn("section_title", F.lit("old")).withColumn("part_of", F.lit("kept"))
    a = spark.createDataFrame(anchors, "section_id long, ord int, anchor string, title string")
    got = {}
    for r in D.split_at_anchors(s, a, least=50).orderBy("section_id", "part").collect():
        got.setdefault(r["section_id"], []).append(r)
    for sid, spans in want.items():
        mine = got.get(sid, [])
        assert [(r["start"], r["stop"], r["text"]) for r in mine] == spans
        n = len(rows[sid][3])
        assert [(r["start_page"], r["end_page"], r["level"], r["part"]) for r in mine] == [(round(3 + b / n * 4 + k * 0.01), round(3 + e / n * 4 + k * 0.01), 3, k) for k, (b, e, _) in enumerate(spans)]
    assert 100 not in got and 102 not in got and [(r["start_page"], r["end_page"]) for r in got[101]] == [(None, 4)]
    out = B.refine_sections(s, a, least=50).collect()
    assert {r["section_id"]: r["section_text"] for r in out if r["part"] is None} == {r[0]: f"[Split into {len(got[r[0]])} sub-sections]" if r[0] in got else r[3] for r in rows}
    assert len(out) == len(rows) + sum(map(len, got.values())) and {r["document_id"] for r in out} == {1}
    assert D.split_at_anchors(s.limit(0), a).count() == 0 and B.refine_sections(s, a.limit(0)).count() == len(rows)


def offset_of(entries, pages, last):
    """Votes counted one by one."""
    votes = []
    for title, printed in [(t, p) for t, p in entries if len(t.strip()) >= 4][:5]:
        low = title.strip().lower()[:60]
        near = (n - printed for n, lines in sorted(pages.items()) if n > last for x in lines[:20] if x.strip() and SequenceMatcher(None, low, x.strip().lower()[:80]).ratio() >= 0.72)
        votes += [v for v in [next(near, None)] if v is not None]
    best = max(dict.fromkeys(votes), key=votes.count, default=None)
    return (best, votes.count(best)) if best is not None and votes.count(best) >= 2 else (last, 0)


def test_offsets_equal_a_slow_version(spark):
    rng = random.Random(11)
    heads = ["Chapter on subject alpha", "Chapter on subject beta", "Of damages", "Relief sought by all", "abc", "Parties and venue", "Standing " * 12]
    entries, lines, outlines, want = [], [], [], {}
    for d in range(40):
        titles = [(rng.choice(heads), rng.randrange(1, 9)) for _ in range(rng.randrange(0, 8))]
        last = rng.choice([0, 0, 2])
        shift = rng.randrange(3)
        pages = {n: [] for n in range(1, 12)}
        for t, p in titles:
            near = t.upper() if rng.random() < 0.5 else t.replace("a", "o", 1)
            pages[min(11, p + last + (shift if rng.random() < 0.8 else rng.randrange(3)))].append(near)
        for n in pages:
            pages[n] = (["", "filler of no kind"] if n % 2 else []) + pages[n]
        pages[11] += ["y"] * 25 + [heads[0]]
        entries += [(d, k, t, p) for k, (t, p) in enumerate(titles)]
        lines += [(d, n, k, x) for n, xs in pages.items() for k, x in enumerate(xs)]
        if last:
            outlines.append((d, last))
        want[d] = offset_of(titles, pages, last)
    e = spark.createDataFrame(entries, "document_id int, pos int, title string, page int")
    got = D.calibrate_offset(e, spark.createDataFrame(lines, "document_id int, page int, line_no int, line string"), spark.createDataFrame(outlines, "document_id int, last_page int"))
    assert {r["document_id"]: (r["page_offset"], r["support"]) for r in got.collect()} == want
    assert sum(x[1] >= 2 for x in want.values()) > 5 and sum(x == (2, 0) for x in want.values()) > 1


def test_exhibits_begin_in_the_second_half_unless_the_outline_names_them(spark):
    pages = {1: ["Exhibit A of the list"], 2: ["Exhibit A", "Schedule 2", "appendix c"], 3: ["text"], 4: ["  Exhibit B indented"], 5: ["Attachment", "7 follows"], 6: ["end"]}
    lines = spark.createDataFrame([(d, n, k, x) for d in (1, 2, 3) for n, xs in pages.items() for k, x in enumerate(xs)], "document_id int, page int, line_no int, line string")
    rows = [(1, 0, "Body", "b", 1, 6), (1, 1, "TOC", "nothing", None, None), (2, 0, "Body", "b", 1, 4), (2, 1, "TOC", "see Ex. 4 and ex4", None, None), (3, 0, "A", "a", 1, 1), (3, 1, "B", "b", 5, 6), (4, 0, "no pages at all", "x", 1, 2)]
    s = spark.createDataFrame(rows, "document_id int, pos int, section_title string, section_text string, start_page int, end_page int")
    left, texts = B.split_off_exhibits(s, lines)
    assert {r["document_id"]: (r["exhibit_page"], r["exhibit_text"][:10]) for r in texts.collect()} == {1: (5, "Attachment"), 2: (1, "Exhibit A "), 3: (5, "Attachment")}
    got = {(r["document_id"], r["pos"]): (r["end_page"], r["section_text"]) for r in left.collect()}
    assert got[1, 0] == (4, "Exhibit A of the list\nExhibit A\nSchedule 2\nappendix c\ntext\n  Exhibit B indented")
    assert (2, 0) not in got and (3, 1) not in got and got[3, 0] == (1, "a") and got[4, 0] == (2, "x") and got[1, 1] == (None, "nothing")


@pytest.mark.parametrize("most", [100_000, 3])
def test_levels_by_group_and_by_rounds(spark, most):
    rng = random.Random(3)
    deps = {(a, b) for _ in range(25) for g in [rng.randrange(8) * 10] for a, b in [(g + rng.randrange(10), g + rng.randrange(10))] if a > b} | {(91, 92), (92, 91), (93, 91), (95, 95), (2, 999), (None, 1), (3, None)}
    need = {k: {b for a, b in deps if a == k and b is not None and b < 100} for k in range(100)}
    want = {k: -1 for k in need}
    for level in range(100):
        ready = [k for k, n in need.items() if want[k] < 0 and all(0 <= want[x] < level for x in n)]
        want |= {k: level for k in ready}
    tasks = spark.createDataFrame([(k,) for k in range(100)] + [(None,)], "task int")
    got = {r["task"]: r["level"] for r in G.topo_levels(tasks, spark.createDataFrame(sorted(deps, key=str), "task int, needs int"), most).collect()}
    assert got == want | {None: 0}


def test_a_chain_of_two_thousand_tasks(spark):
    chain = spark.range(2000).selectExpr("CAST(id AS string) AS task")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "levels of a chain")
    got = G.topo_levels(chain, spark.range(1, 2000).selectExpr("CAST(id AS string) AS task", "CAST(id - 1 AS string) AS needs")).collect()
    assert {r["task"]: r["level"] for r in got} == {str(k): k for k in range(2000)}
    assert len(jobs.getJobIdsForGroup("chain")) < 500
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_of_a_total_order(spark):
    df = spark.range(5000).selectExpr("id", "hash(id) % 50 AS k")
    want = sorted(((r["k"], -r["id"]) for r in df.collect()), key=lambda x: x)
    got = G.numbered(df, F.col("k"), F.col("id").desc()).collect()
    assert [(r["k"], -r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert G.numbered(df.limit(0), "id").collect() == []


def test_aliases_answers_and_tools(spark):
    nodes = spark.createDataFrame([("a", "a", "Acme Inc"), ("b", "a", "Acme"), ("c", "a", "Acme"), ("d", "d", "Dee"), ("e", "d", None), ("f", "f", "Eff")], "node_id string, canonical_id string, node_label string")
    known = spark.createDataFrame([("a", ["ACME", "Acme"]), ("f", None), ("g", ["Gee", None])], "canonical_id string, aliases array<string>")
    assert {r[0]: r[1] for r in A.merge_aliases(nodes, known).collect()} == {"a": ["ACME", "Acme"], "g": ["Gee"]}
    answers = spark.createDataFrame([(1, "s", "q" * 3000, "x", "yes", 0.123456, True), (None, "s", "q", "x", "yes", 0.1, True), (1, None, None, None, "alone", None, None), (1, "s", "q", "x", "", 0.1, False)], "case_id int, session_id string, query string, agent_name string, answer string, confidence double, needs_review boolean")
    messages = spark.createDataFrame([("s", 2, "call", "k2", "find", "{}", None), ("s", 1, "call", "k1", "list", "{}", None), ("s", 3, "result", "k1", None, None, "r" * 500), ("t", 1, "call", "k1", "no", "", None)], "session_id string, turn int, kind string, call_id string, tool_name string, args string, text string")
    got = {r["session_id"]: r for r in R.response_rows(answers, messages).collect()}
    assert len(got["s"]["query"]) == 2000 and got["s"]["confidence"] == 0.1235 and [(c["tool_name"], len(c["result_summary"])) for c in got["s"]["tool_calls_made"]] == [("list", 300), ("find", 0)]
    assert got["unknown"]["tool_calls_made"] == [] and len(got) == 2
    cited = spark.createDataFrame([("Exhibits A, B and C-1 (see Ex. 4, Exh. D)",), (None,), ("none",)], "t string").select(S.cited_exhibits("t")).collect()
    assert [r[0] for r in cited] == [["4", "A", "B", "C", "D"], [], []]
    assert {"query_kg", "match_evidence", "link_evidence_batch"} <= set(api.__all__) and all(hasattr(api, n) for n in api.__all__)


def test_search_from_sql_equals_the_function(spark):
    rng = random.Random(9)
    texts = ["breach of the lease by the tenant", "lease breach", "payment of rent due", "", None, "tenant breach of lease and rent"]
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)] if k != 5 else [0.0] * 6, texts[k % len(texts)]) for k in range(80)] + [(90, None, "lease")]
    emb = spark.createDataFrame(rows, "section_id long, embedding array<float>, search_text string")
    emb.createOrReplaceTempView("tested_sections")
    register_search(spark, "tested_sections", "find_sections_like")
    q = [float(x) for x in rows[3][1]]
    order = ["section_id", "semantic_score", "keyword_score", "score", "rank"]
    want = [tuple(r[c] for c in order) for r in R.hybrid_search(emb, q, "breach of lease", 7, 0.6, 0.1).collect()]
    call = f"find_sections_like(array({', '.join(f'{x!r}D' for x in q)}), 'breach of lease', 7, 0.6D, 0.1D)"
    got = spark.sql(f"SELECT * FROM {call} ORDER BY rank").collect()
    assert [tuple(r[c] for c in order) for r in got] == want and len(got) == 7 and any(r["keyword_score"] > 0 for r in got)
    assert spark.sql(f"SELECT count(*) FROM {call} WHERE score > 0.5").first()[0] == sum(r[3] > 0.5 for r in want)
    assert spark.sql("SELECT * FROM find_sections_like(NULL, 'x')").count() == 0


def test_telephone_numbers_equal_a_slow_version(spark):
    rng = random.Random(2)
    number = re.compile(r"(?<!\d)(1)?[.\-\s]?(\d{3})[.\-\s]?(\d{3})[.\-\s]?(\d{4})(?!\d)")

    def told(m):
        digits = re.sub(r"\D", "", m[0])
        if len(digits) == 11:
            return f"1-{m[2]}-{m[3]}-{m[4]}"
        return f"{m[2]}-{m[3]}-{m[4]}" if digits != m[0] else m[0]

    lines = ["x" + "".join(rng.choice(["1", "5", "55", "555", "5555", "-", ".", " ", "555 123 4567", "1-555.1234567", "a"]) for _ in range(rng.randrange(1, 9))) + "x" for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(lines)), "n int, line string").orderBy("n").select(S.body_line("line")).collect()]
    assert got == [number.sub(told, re.sub(r"[ \t]+", " ", x)) for x in lines] and sum(a != b for a, b in zip(got, lines, strict=True)) > 300
    odd = spark.createDataFrame([(None,), ("",), ("  ",), ("y" * 100_000,)], "line string").select(S.body_line("line")).collect()
    assert [r[0] for r in odd] == ["", "", "", "y" * 100_000]


def test_forms_and_outlines_of_odd_documents(spark):
    lines = spark.createDataFrame([(1, 1, ""), (1, 2, None), (2, 11, "☐"), (3, 1, "☑ yes"), (3, 1, "z" * 40)], "document_id int, page int, line string")
    assert {tuple(r) for r in D.form_signals(lines).collect()} == {(1, False, 0.0, False), (3, True, 0.5, False)}
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n# Contents\nb"), (4, "the contents are here")], "document_id int, text string")
    assert {r["document_id"]: r["has_toc"] for r in D.detect_toc(docs).collect()} == {1: False, 2: False, 3: True, 4: False}
