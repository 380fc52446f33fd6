"""Hand-written rows for what the comparison queries don't reach."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from caselake.functions import scalar as S
from caselake.operators import bodies as B
from caselake.operators import graph as G
from caselake.operators import intake as Q
from caselake.operators import nodes as N
from caselake.operators import relational as R
from caselake.operators import retrieval as L
from caselake.operators import structure as D
from caselake.operators import windows as W
from caselake.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def test_slugs(spark):
    assert one(spark, "Smith & Co. — Exposé", S.slugify) == "smith-co-expose"
    assert one(spark, "  --A  B-- ", S.slugify) == "a-b"
    assert one(spark, "", S.slugify) == ""


@pytest.mark.parametrize(("name", "want"), [("Apple Inc.", "apple"), ("Apple, Inc.", "apple"), ("Apple", "apple"), ("Acme  Holdings LLC", "acme holdings"), ("Inc", "inc"), ("Acme L.P.", "acme"), ("First Bank, N.A.", "first bank"), ("Doe P.C.", "doe"), ("Acme Company", "acme company"), ("Acme plc", "acme plc"), ("Acme Inc", "acme inc")])
def test_party_names(spark, name, want):
    assert one(spark, name, S.norm_party) == want


def test_quoted_mail(spark):
    assert one(spark, "Hi\n\nOn Monday, A wrote:\n> old", S.strip_quoted) == "Hi"
    assert one(spark, "Hi\n-----Original Message-----\nFrom: x", S.strip_quoted) == "Hi"
    assert one(spark, "no quotes", S.strip_quoted) == "no quotes"


def test_mail_table(spark):
    raw = "From: a@x\nTo: b@y\nSubject: Hello\nDate: Mon\n\nThe body\nOn Monday, A wrote:\n> old"
    got = files.mail_table(spark.createDataFrame([("1", raw), ("2", raw)], "id string, message string")).first()
    assert (got.sender, got.recipient, got.subject, got.sent, got.body) == ("a@x", "b@y", "Hello", "Mon", "The body")
    assert files.mail_table(spark.createDataFrame([("1", "x")], "id string, t string")).count() == 0


def test_plus_address(spark):
    df = spark.createDataFrame([("in+acme.case7@h.com",), ("in+acme@h.com",), ("in@h.com",)], "x string")
    assert [tuple(r) for r in df.select(S.plus_address("x", 1), S.plus_address("x", 2)).collect()] == [("acme", "case7"), ("acme", None), (None, None)]


def test_page_markers(spark):
    df = spark.createDataFrame([("## Page 7",), ("[Page 12]",), ("--- page 3 ---",), ("page 3 of it",)], "x string")
    assert [r[0] for r in df.select(S.page_number("x")).collect()] == [7, 12, 3, None]


def test_json_records(spark):
    df = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3","c":"4"}'), (None, '{"x":"1"}')], "o string, n string")
    got = [json.loads(r[0]) for r in df.select(S.F.col("o"), R.json_merge("o", "n").alias("m")).select("m").collect()]
    assert got == [{"a": "1", "b": "3", "c": "4"}, {"x": "1"}]
    assert json.loads(spark.range(1).select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")).select(R.compact_json("a", "b")).first()[0]) == {"a": 1}


def tenancy(spark):
    corpora = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 2, False), (4, 2, False), (5, 1, True)], "corpus_id int, firm_id int, is_shared boolean")
    cases = spark.createDataFrame([(10, 1), (20, 2)], "case_id int, firm_id int")
    docs = spark.createDataFrame([(100, 1, 10), (101, None, 10), (102, 3, 20), (103, None, 20), (104, 5, None), (105, None, None)], "document_id int, corpus_id int, case_id int")
    return docs, corpora, cases


@pytest.mark.parametrize(("firm", "seen", "writable"), [(1, {100, 101, 104}, {100, 101, 104}), (2, {102, 103, 104}, {102, 103}), (None, set(), set()), (3, {104}, set())])
def test_tenants_see_their_own(spark, firm, seen, writable):
    docs, corpora, cases = tenancy(spark)
    ids = lambda df: {r["document_id"] for r in df.collect()}
    assert ids(R.visible_documents(docs, corpora, cases, firm)) == seen
    assert ids(R.visible_documents(docs, corpora, cases, firm, shared=False)) == writable
    sections = docs.select((F.col("document_id") * 10).alias("section_id"), "document_id")
    assert ids(R.visible_via(sections, R.visible_documents(docs, corpora, cases, firm), "document_id")) == seen


def test_parents_and_end_pages_equal_a_stack(spark):
    rng = random.Random(4)
    rows = [(d, p, d * 1000 + p, rng.randint(0, 4), p // 3 + 1) for d in range(5) for p in range(60)]
    df = spark.createDataFrame(rows, "document_id int, pos int, section_id int, level int, page int")
    parents, ends = {}, {}
    for d, own in itertools.groupby(rows, key=lambda r: r[0]):
        own, stack = list(own), []
        for _, _p, sid, level, _page in own:
            while stack and stack[-1][1] >= level:
                stack.pop()
            parents[sid] = stack[-1][0] if stack else None
            stack.append((sid, level))
        for k, (_, _p, sid, level, page) in enumerate(own):
            nxt = next((r[4] for r in own[k + 1 :] if r[3] <= level), None)
            ends[sid] = max(page, 99) if nxt is None else max(page, nxt - 1)
    assert {r["section_id"]: r["parent_section_id"] for r in W.build_parents(df).collect()} == parents
    assert {r["section_id"]: r["end_page"] for r in W.assign_end_pages(df, F.lit(99)).collect()} == ends


def test_subtrees_equal_a_state_machine(spark):
    rng = random.Random(5)
    rows = [(1, p, rng.randint(0, 3), "Exhibit A" if rng.random() < 0.15 else f"t{p}") for p in range(200)]
    kept, skip = [], None
    for _, p, level, title in rows:
        if skip is not None and level > skip:
            continue
        skip = level if title.startswith("Exhibit") else None
        if skip is None:
            kept.append(p)
    got = D.drop_subtrees(spark.createDataFrame(rows, "document_id int, pos int, level int, title string"))
    assert sorted(r["pos"] for r in got.collect()) == kept


def test_similar_pairs_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    base = ["".join(rng.choices("abcde ", k=rng.randint(4, 24))).strip() or "abc" for _ in range(40)]
    names = set(base)
    for b in base:
        c = list(b)
        c[rng.randrange(len(c))] = rng.choice("abcde")
        names |= {"".join(c).strip() or "q", b + " extra", b[:-1] or "z"}
    names = sorted(names)
    want = set()
    for a, b in itertools.combinations(names, 2):
        if SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85 and len(a) + len(b) >= 4 or min(len(a), len(b)) >= 3 and (a in b or b in a):
            want.add((a, b))
    got = G.similar_pairs(spark.createDataFrame([(1, "party", n) for n in names], "case_id int, node_type string, norm string"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_sent_through_the_driver(spark):
    labels = spark.createDataFrame([(1, "party", "alpha"), (1, "party", "alpha beta")], "case_id int, node_type string, norm string")
    assert "Broadcast" not in plan_of(G.similar_pairs(labels))
    names = spark.createDataFrame([("x", 1, "Alpha")], "name_id string, document_id int, name string")
    parties = spark.createDataFrame([("p", 1, "Alpha Beta")], "node_id string, document_id int, node_label string")
    assert "Broadcast" not in plan_of(G.match_party(names, parties))
    refs = spark.createDataFrame([("r", 1, "Exhibit A")], "ref_id string, document_id int, ref string")
    assert "Broadcast" not in plan_of(R.match_evidence_ref(refs, parties))
    nodes = parties.selectExpr("*", "'party' AS node_type", "1 AS case_id")
    assert "Broadcast" not in plan_of(G.merge_log(nodes, "case_id", {"party": 0.85}))


def test_resolve_case_equals_all_pairs(spark):
    rng = random.Random(4)
    words = ["a", "ab", "abc", "v", "supplier", "007", "1007", "upp", "lier"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)})
    folders = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)} | {"supplier 1", "pplie", "b", "ab"})
    cases = [(k, n) for k, n in enumerate(names)] + [(k + 100, n) for k, n in enumerate(names[:9])]
    want = {}
    for f in folders:
        found = [(1 if f == n else 3, k) for k, n in cases if n in f or f in n]
        if found:
            want[f] = min(found)
    got = R.resolve_case(spark.createDataFrame([(f,) for f in folders], "folder string"), spark.createDataFrame(cases, "case_id int, case_name string"))
    assert {r["folder"]: (r["rule"], r["case_id"]) for r in got.collect()} == want


def test_extractions_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, 1, 1, "date", "Hearing", "x", 0.5, '{"date_type":"hearing"}')], "extraction_id long, document_id long, section_id long, extraction_type string, entity_name string, entity_value string, confidence double, properties string")
    plan = N.extraction_nodes(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") <= 1 and N.extraction_nodes(rows).first()["node_type"] == "procedural_event"


def test_components_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", "q")], "a string, b string")
    assert {r["node"]: r["root"] for r in G.components(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "q": "q"}


def test_task_levels_with_a_cycle(spark):
    tasks = spark.createDataFrame([(k,) for k in range(6)], "task long")
    deps = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (4, 5), (5, 4), (3, 99)], "task long, needs long")
    assert {r["task"]: r["level"] for r in G.topo_levels(tasks, deps).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: -1, 5: -1}


def test_paths_stop_at_terminals_and_avoid_cycles(spark):
    nodes = spark.createDataFrame([("c", "claim"), ("e1", "evidence"), ("o", "obligation"), ("l", "legal_authority"), ("u", "claim"), ("e2", "evidence")], "node_id string, node_type string")
    edges = spark.createDataFrame([("c", "e1", "supported_by", 0.9), ("c", "o", "references", 0.8), ("o", "l", "references", 0.7), ("l", "e2", "references", 0.9), ("o", "c", "references", 0.5)], "src string, dst string, edge_type string, confidence double")
    paths = G.evidence_paths(nodes, edges)
    assert {(r["path"], r["hops"]) for r in paths.filter("claim = 'c' AND confidence >= 0.7").collect()} == {("c>e1", 1), ("c>o>l", 2)}
    assert {r["node_id"]: r["unsupported"] for r in G.claim_bundles(nodes, paths).collect()} == {"c": False, "u": True}


def test_html(spark):
    html = "<html><head><title>T</title><script>x</script></head><body><nav><a href='#a'>First</a><a href='#b'>Second</a></nav><h1 id='a'>First</h1><p>one<p>two &amp; three<style>p{}</style><h2 id='b'>Second</h2><div>end"
    el = D.html_elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert [r["text"] for r in el.orderBy("pos").collect()] == ["First", "Second", "First", "one", "two & three", "Second", "end"]
    assert [(r["title"], r["level"]) for r in D.html_outline(el).orderBy("pos").collect()] == [("First", 1), ("Second", 1)]
    assert {r["title"]: r["section_text"] for r in D.html_sections(el).collect()} == {"First": "First\none\ntwo & three", "Second": "Second\nend"}


def test_html_outline_ways(spark):
    pages = [
        (1, "<a href='#z'>out</a><div class='my-toc'><a href='#a'>One</a><div><a href='#b'>Two</a></div></div><a href='#c'>Three</a><h1 id='a'>x</h1><h1 id='c'>y</h1><h1 id='z'>w</h1>"),
        (2, "<h1>Only</h1><p>text</p><h3>Two</h3>"),
        (3, "<p>First chapter ..... 3</p><p>Second chapter .... 9</p><p id='s2'>Second Chapter begins here</p><p id='q'>nothing alike at all</p>"),
        (4, "<p>nothing</p>"),
        (5, "<nav id='navigation'><a href='#a'>N1</a><a href='#b'>N2</a></nav><div id='toc'><a href='#c'>D</a></div>"),
    ]
    got = D.html_outline(D.html_elements(spark.createDataFrame(pages, "page_id long, html string"))).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["way"], r["title"], r["element_id"]) for r in got] == [
        (1, 0, "One", "a"), (1, 0, "Two", "b"), (2, 2, "Only", None), (2, 2, "Two", None), (3, 3, "First chapter", None), (3, 3, "Second chapter", "s2"), (5, 0, "N1", "a"), (5, 0, "N2", "b"),
    ]


def test_parse_hits(spark):
    text = "[1] a.pdf - Title - one (score 0.71)\nline one\nline two\n[2] b.pdf - T2 (score 0.5)"
    got = L.parse_hits(spark.createDataFrame([(1, text)], "answer_id int, text string")).orderBy("block").collect()
    assert [(r["file_name"], r["score"], r["text"]) for r in got] == [("a.pdf", 0.71, "line one\nline two"), ("b.pdf", 0.5, None)]


def test_channels_and_attachments(spark):
    keys = spark.createDataFrame([("k1", 1, 1, True, None), ("k2", 1, 1, True, "2020-01-01"), ("k3", 2, 1, False, None)], "key_hash string, channel_id int, firm_id int, active boolean, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    channels = spark.createDataFrame([(1, 1, True), (2, 1, True)], "channel_id int, firm_id int, enabled boolean")
    assert [r["key_hash"] for r in Q.valid_channels(keys, channels, "2024-01-31").collect()] == ["k1"]
    p = spark.createDataFrame([(1, '{"sender":"a","attachments":[{"name":"x.pdf","mime":"application/PDF","size":3},{"name":"y.exe","mime":"app/x"}]}'), (2, "broken")], "payload_id int, json string")
    assert [r["name"] for r in Q.explode_attachments(p).collect()] == ["x.pdf"]


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"1")
    (tmp_path / "in/b.exe").write_bytes(b"2")
    (tmp_path / "in/c.csv").write_bytes("h1,h2\né,2\n".encode("latin-1"))
    assert {(r["name"], r["mime"]) for r in files.read_files(spark, str(tmp_path / "in")).collect()} == {("a.PDF", "application/pdf"), ("c.csv", "text/csv")}
    assert files.read_csv_container(spark, str(tmp_path / "in/c.csv")).first()["h1"] == "é"
    files.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"), "R")
    assert "| 1 |  |" in [r["value"] for r in spark.read.text(str(tmp_path / "out/md/rows")).collect()]


def ratio_of(a, b):
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_section_bodies_by_pages(spark):
    rng = random.Random(4)
    lines, entries, want = [], [], {}
    for doc in range(6):
        flat = []
        for page in range(1, 6):
            for k in range(rng.randrange(1, 6)):
                flat.append((page, k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3))))
        titles = [(p, rng.choice([x for x in flat if x[0] == p])[2]) for p in (1, 3, 4)]
        titles[1] = (3, titles[1][1].upper() + "!")
        lines += [(doc, *x) for x in flat]
        for n, (page, title) in enumerate(titles):
            stop = titles[n + 1][0] if n < 2 else 5
            entries.append((doc, n, title, page, stop))
            block = [x[2] for x in flat if page <= x[0] <= stop]
            head = next((i for i, x in enumerate(block) if ratio_of(x.lower(), title.lower()) >= 0.65), -1)
            end = len(block)
            if n < 2:
                end = next((i for i in range(head + 1, len(block)) if ratio_of(block[i].lower(), titles[n + 1][1].lower()) >= 0.65), end)
            want[doc, n] = "\n".join(block[head + 1 : end]).strip()
    got = B.section_text(spark.createDataFrame(entries, "document_id int, pos int, title string, start_page int, end_page int"), spark.createDataFrame(lines, "document_id int, page int, line_no int, line string"))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_section_bodies_by_place(spark):
    docs = spark.createDataFrame([(1, "intro\nFirst Part\nbody one\nSecnd  Part of it\nbody two\nLast\nend")], "document_id int, text string")
    entries = spark.createDataFrame([(1, 0, "first part"), (1, 1, "Second Part of it"), (1, 2, "Nowhere at all"), (1, 3, "Last")], "document_id int, pos int, title string")
    got = {r["pos"]: r["section_text"] for r in B.section_text_by_pos(entries, docs).collect()}
    assert got == {0: "First Part\nbody one", 1: "Secnd  Part of it\nbody two\nLast\nend", 2: "", 3: "Last\nend"}


def test_clean_bodies(spark):
    rows = [(1, 0, "The Title", "the title!\n\ngoes\non here\nstops.\n  deep\nlast  word"), (1, 1, "Other", "kept\n\nExhibit A\n" + "y" * 600), (2, 0, "T", "ab\nExhibit\n" + "y" * 10)]
    got = {(r[0], r[1]): r["section_text"] for r in B.clean_sections(spark.createDataFrame(rows, "document_id int, pos int, title string, section_text string")).collect()}
    assert got[1, 0] == "goes on here\nstops.\n  deep last word"
    assert got[1, 1] == "kept" and got[2, 0].startswith("ab Exhibit")


def test_deep_outlines(spark):
    levels = list(range(12)) + [3, 11, 0, 9]
    rows = spark.createDataFrame([(1, k, x, k, k + 1) for k, x in enumerate(levels)], "document_id int, pos int, level int, section_id int, page int")
    parents = {r["section_id"]: r["parent_section_id"] for r in W.build_parents(rows).collect()}
    assert parents == {k: max((j for j in range(k) if levels[j] < x), default=None) for k, x in enumerate(levels)}
    ends = {r["section_id"]: r["end_page"] for r in W.assign_end_pages(rows, F.lit(50)).collect()}
    assert ends == {k: next((max(k + 1, j) for j in range(k + 1, len(levels)) if levels[j] <= x), 50) for k, x in enumerate(levels)}


def test_deep_tasks(spark):
    tasks = spark.createDataFrame([(k,) for k in range(68)], "task int")
    deps = spark.createDataFrame([(k, k - 1) for k in range(1, 60)] + [(60, 61), (61, 60), (62, 60), (63, 99)], "task int, needs int")
    got = {r["task"]: r["level"] for r in G.topo_levels(tasks, deps).collect()}
    assert got == {k: k for k in range(60)} | {60: -1, 61: -1, 62: -1} | {k: 0 for k in range(63, 68)}
    ordered = G.task_order(tasks.selectExpr("task", "1 AS tier", "-task AS layer", "0 AS position"), G.topo_levels(tasks, deps)).orderBy("rank").collect()
    assert [r["task"] for r in ordered][:6] == [67, 66, 65, 64, 63, 0] and {r["task"] for r in ordered[-3:]} == {60, 61, 62}


NAMES = ["Acme Holdings", "Acme Holding", "acme holdings, inc", "Zenith Corp", "Zenith Corporation Group", "Zenit Corp", "Blue River LLC", "Blue Rivers", "Green", "Greenfield Partners", "Orion Labs", "Orion Lab", "Orlon Labs"]


def test_merges_equal_brute_force(spark):
    from caselake.operators.graph import components  # noqa: F401

    nodes = [(f"n{k:02d}", "party", n, k % 2, ("plaintiff", "defendant", None)[k % 3]) for k, n in enumerate(NAMES)] + [(f"a{k}", "legal_authority", n, 0, None) for k, n in enumerate(["Roe v. Wade", "Roe v Wade", "Doe v. Bolton"])]
    df = spark.createDataFrame(nodes, "node_id string, node_type string, node_label string, case_id int, role string")
    norms = {r["node_id"]: r["x"] for r in df.select("node_id", F.when(F.col("node_type") == "party", S.norm_party("node_label")).otherwise(S.norm_authority("node_label")).alias("x")).collect()}
    want = set()
    for a, b in itertools.combinations(nodes, 2):
        if (a[1], a[3]) != (b[1], b[3]):
            continue
        x, y = norms[a[0]], norms[b[0]]
        alike = ratio_of(min(x, y), max(x, y)) >= (0.85 if a[1] == "party" else 0.8)
        inside = a[1] == "party" and min(len(x), len(y)) >= 3 and (x in y or y in x) and (None in (a[4], b[4]) or a[4] == b[4])
        if alike or inside:
            want.add(frozenset((a[0], b[0])))
    group = {n[0]: n[0] for n in nodes}
    for _ in nodes:
        for x, y in map(sorted, want):
            group = {k: min(group[x], group[y]) if v in (group[x], group[y]) else v for k, v in group.items()}
    got = {r["node_id"]: r["canonical_id"] for r in G.resolve_entities(df, G.WITHIN).collect()}
    labels = {n[0]: n[2] for n in nodes}
    longest = {root: min((k for k, v in group.items() if v == root), key=lambda k: (-len(labels[k]), k)) for root in set(group.values())}
    assert got == {k: longest[v] for k, v in group.items()}
    log = G.merge_log(df, "case_id", G.WITHIN).collect()
    assert {r["method"] for r in log} <= {"exact", "similarity", "substring"} and all(r["score"] is None or r["score"] >= 0.8 for r in log)


def test_match_party_equals_brute_force(spark):
    parties = [(f"p{k:02d}", k % 2, n) for k, n in enumerate(NAMES)]
    names = [(f"x{k}", d, n) for k, n in enumerate([*NAMES, "Acme", "Zenith", "Unknown Person", "Greenfeld Partners"]) for d in (0, 1)]
    pdf = spark.createDataFrame(parties, "node_id string, document_id int, node_label string")
    ndf = spark.createDataFrame([(f"{a}-{d}", d, n) for a, d, n in names], "name_id string, document_id int, name string")
    norm = {n: one(spark, n, S.norm_party) for n in {x[2] for x in names} | set(NAMES)}
    want = {}
    for a, d, n in names:
        best = []
        for i, dd, m in parties:
            if d == dd:
                x, y = norm[n], norm[m]
                inside = min(len(x), len(y)) >= 3 and (x in y or y in x)
                score = 1.0 if x == y else max(ratio_of(x, y), 0.8 if inside else 0)
                if score >= 0.8:
                    best.append((-score, i))
        if best:
            want[f"{a}-{d}"] = min(best)[1]
    assert {r["name_id"]: r["node_id"] for r in G.match_party(ndf, pdf).collect()} == want


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    texts = ["", "one two", "One  two", "one two three"] + [" ".join(base)] * 3
    for k in range(40):
        cut = rng.randrange(40, 61)
        texts.append(" ".join(base[:cut] + [f"x{k}_{j}" for j in range(rng.randrange(0, 8))]))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w)} if len(w) <= 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(1, len(texts)), 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[i] = group[j] = min(group[i], group[j])
    got = {r[0]: r[1] for r in L.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "document_id int, section_text string")).collect()}
    assert got == {k: group[k] for k in range(1, len(texts))}


def test_exhibits_a_large_blob_is_split_again(spark):
    lines = [(1, 0, "## Exhibit A"), (1, 1, "z" * 60), (1, 2, "Exhibit B follows"), (1, 3, "more"), (2, 0, "## Exhibit A"), (2, 1, "short")]
    df = spark.createDataFrame(lines, "document_id int, pos int, line string")
    labels = spark.createDataFrame([(1, "A"), (1, "B")], "document_id int, label string")
    got = sorted(tuple(r) for r in D.split_exhibits(df, labels, blob=50).collect())
    assert got == [(1, "A", 0, 2, 1), (1, "B", 2, 4, 1), (2, "A", 0, 2, 0)]
    marks = spark.createDataFrame([(2, "7", 0, 2)], "document_id int, label string, start int, stop int")
    assert sorted(tuple(r) for r in D.split_exhibits(df, labels, marks, blob=50).collect())[-1] == (2, "7", 0, 2, -1)


def test_wrapped_lines_are_merged(spark):
    lines = [(1, k, x) for k, x in enumerate(["The quick", "brown fox.", "Next one", "goes hy-", "phenated on", "", "new start"])]
    got = [r["text"] for r in D.merge_lines(spark.createDataFrame(lines, "document_id int, pos int, line string")).orderBy("para").collect()]
    assert got[0] == "The quick brown fox." and got[1].startswith("Next one goes hyphenated on")


@pytest.mark.parametrize("names,want", [(("Chapter on subject alpha", "Of damages sought", "Relief and standing"), (2, 3)), (("Chapter on subject alpha", "Chapter on subject beta", "Chapter on subject gamma"), (0, 0))])
def test_offset_of_printed_pages(spark, names, want):
    """A title votes by the first line that resembles it, so that titles alike among each other all vote by the first of them and don't agree."""
    at = list(zip(names, (1, 4, 7), strict=True))
    entries = spark.createDataFrame([(1, k, t, p) for k, (t, p) in enumerate(at)], "document_id int, pos int, title string, page int")
    lines = spark.createDataFrame([(1, p + 2, 0, t) for t, p in at] + [(1, 3, 1, "nothing like it")], "document_id int, page int, line_no int, line string")
    assert [(r["document_id"], r["page_offset"], r["support"]) for r in D.calibrate_offset(entries, lines).collect()] == [(1, *want)]


def test_theories_by_number_then_label(spark):
    theories = spark.createDataFrame([("t1", 1, 2, "x"), ("t2", 1, None, "COUNT one"), ("t3", 1, 9, "none")], "theory_id string, document_id int, count_number int, count_label string")
    counts = spark.createDataFrame([("c1", 1, 1, "Count One"), ("c2", 1, 2, "Count Two")], "count_id string, document_id int, number int, label string")
    assert {(r[0], r[1]) for r in G.link_theories(theories, counts).collect()} == {("t1", "c2"), ("t2", "c1")}


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        D.rule_array(spark.range(30).selectExpr("CAST(id AS string) AS pattern"), most=20)


def end_of(node, to):
    """The end of a chain of pointers; on a cycle the first place met again."""
    seen = set()
    while node in to and node not in seen:
        seen.add(node)
        node = to[node]
    return node


def test_canonical_pointers(spark):
    rng = random.Random(11)
    to = {7: 1, 1: 5, 5: 5, 20: 21, 21: 22, 22: 20, 23: 22, 24: 23, 30: 31, 40: 40}
    to |= {k: k - 1 for k in range(101, 400)} | {k: rng.randrange(1000, 1300) for k in range(1000, 1250)} | {k: 7 for k in range(2000, 2400)}
    rows = [*to.items(), (50, None), (None, 5), (7, 3000)]
    got = {r["node"]: r["root"] for r in G.follow_canonical(spark.createDataFrame(rows, "node long, target long")).collect()}
    assert got == {k: end_of(k, to) for k in to}
    assert got[7] == got[1] == 5 and got[24] == 22 and got[30] == 31 and got[399] == 100
    assert G.follow_canonical(spark.createDataFrame([], "node string, target string")).count() == 0


FOUND = "extraction_id long, document_id long, section_id long, extraction_type string, entity_name string, entity_value string, confidence double, properties string"


def test_nodes_and_edges_from_extractions(spark):
    rows = [
        (1, 1, 10, "party", "Acme, Inc.", "company", 0.9, '{"role": "plaintiff", "jurisdiction": null}'),
        (2, 1, 11, "party", " acme  inc. ", "person", 0.7, '{"role": "defendant"}'),
        (3, 1, 10, "party", "Zenith LLC", None, None, None),
        (4, 1, 10, "claim", "Fraud " + "x" * 200, "fraud", 0.0, '{"plaintiff": "Acme", "defendant": "Zenith", "evidence_references": ["Exhibit A"], "other": 1}'),
        (5, 1, 10, "cause_of_action", "Breach", "contract", 0.8, "[1, 2]"),
        (6, 1, 10, "evidence_ref", "Exhibit A", "x", 0.8, '{"description": "Letter"}'),
        (7, 1, 10, "case_citation", None, "1 U.S. 1", 0.8, '{"case_name": "Roe v. Wade", "year": 1973, "court": ""}'),
        (8, 1, 10, "case_citation", " ", None, 0.8, '{"citation": "2 F.3d 4"}'),
        (9, 1, 10, "case_citation", "", None, 0.8, "{}"),
        (10, 1, 10, "date", "2020-01-01", "2020-01-01", 0.8, '{"date_type": "filing"}'),
        (11, 1, 10, "date", "Effective Date", "2020", 0.8, "{}"),
        (12, 1, 10, "date", "Trial opens", "2021-02-03", 0.8, '{"date_type": "HEARING"}'),
        (13, 1, 10, "date", "Meeting", "2021", 0.8, "{}"),
        (14, 1, 10, "date", "Report", "2021", 0.8, '{"date_type": "access_date"}'),
        (15, 1, 10, "judge", "Judge Judy", None, 0.8, "{}"),
        (16, 1, 10, "court", "High Court", None, 0.8, "{}"),
        (17, 1, 10, "amount", "Damages", "1000", 0.8, '{"payee": "Acme"}'),
        (18, 1, 10, "condition", "Notice", "precedent", 0.8, '{"consequence": "none"}'),
        (19, 2, 12, "party", "Acme", None, 0.8, "{}"),
        (None, None, None, None, None, None, None, None),
    ]
    found = spark.createDataFrame(rows, FOUND)
    docs = spark.createDataFrame([(1, 5, "Pleading - Complaint"), (2, None, None)], "document_id long, case_id long, document_type string")
    nodes = N.build_nodes(found, docs, spark.createDataFrame([(10, "facts")], "section_id long, semantic_label string"))
    got = {(r["document_id"], r["node_type"], r["node_label"]): (json.loads(r["p"]), r["source_extraction_ids"]) for r in nodes.withColumn("p", F.to_json("properties")).collect()}
    common = {"source_document_type": "Pleading - Complaint", "source_semantic_label": "facts", "confidence": 0.8}
    assert set(got) == {
        (1, "party", "Acme, Inc."), (1, "party", "Zenith LLC"), (1, "claim", "Fraud " + "x" * 111 + "\u2026"), (1, "claim", "Breach"), (1, "evidence", "Exhibit A"), (1, "legal_authority", "Roe v. Wade"), (1, "legal_authority", "2 F.3d 4"),
        (1, "procedural_event", "Trial opens"), (1, "event", "Meeting"), (1, "amount", "Damages"), (1, "condition", "Notice"), (2, "party", "Acme"),
    }
    assert got[1, "party", "Acme, Inc."] == ({"role": "plaintiff", "entity_type": "company", "source_extraction_ids": [1, 2]} | common | {"confidence": 0.9}, [1, 2])
    assert got[1, "party", "Zenith LLC"][0] == {"source_extraction_ids": [3]} | common
    assert got[1, "claim", "Breach"][0] == {"claim_type": "contract", "alleged_facts": [], "evidence_references": [], "source_extraction_ids": [5]} | common
    assert got[1, "claim", "Fraud " + "x" * 111 + "\u2026"][0] == {"claim_type": "fraud", "plaintiff": "Acme", "defendant": "Zenith", "alleged_facts": [], "evidence_references": ["Exhibit A"], "source_extraction_ids": [4]} | common
    assert got[1, "legal_authority", "Roe v. Wade"][0] == {"citation": "1 U.S. 1", "year": 1973, "court": "", "source_extraction_ids": [7]} | common
    assert got[1, "legal_authority", "2 F.3d 4"][0] == {"citation": "2 F.3d 4", "source_extraction_ids": [8]} | common
    assert got[1, "procedural_event", "Trial opens"][0] == {"date_value": "2021-02-03", "date_type": "hearing", "is_relative": False, "source_extraction_ids": [12]} | common
    assert got[1, "event", "Meeting"][0]["date_type"] == ""
    assert got[1, "amount", "Damages"][0] == {"value": "1000", "currency": "USD", "payee": "Acme", "is_calculated": False, "source_extraction_ids": [17]} | common
    assert got[2, "party", "Acme"][0]["source_document_type"] == ""
    flat = N.edge_columns(nodes)
    labels = {r["node_id"]: r["node_label"][:6].strip() for r in flat.collect()}
    edges = {(labels[r["src"]], labels[r["dst"]], r["edge_type"], r["confidence"]) for r in G.document_edges(flat, docs).collect()}
    assert {("Acme,", "Fraud", "alleged_by", 0.8), ("Fraud", "Zenith", "alleged_against", 0.8), ("Fraud", "Exhibi", "supported_by", 0.75), ("Damage", "Acme,", "damages_sought_by", 0.8)} <= edges
    assert N.build_nodes(spark.createDataFrame([], FOUND)).count() == 0


def test_extractions_meet_before_their_properties_are_made(spark):
    """Ids and typed properties are made for one row a node, not for each extraction; only dates and nameless citations are parsed before."""
    rows = [(k, 1, 10, "claim", "Fraud", "x", 0.5, '{"plaintiff": "A"}') for k in range(9, 0, -1)] + [(20, 1, 10, "claim", "fraud", "y", 0.5, "broken")]
    nodes = N.build_nodes(spark.createDataFrame(rows, FOUND))
    below = nodes._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [", 1)[1].lower()
    assert "sha2" not in below and "to_json" not in below and "structstojson" not in below
    (node,) = nodes.withColumn("p", F.to_json("properties")).collect()
    assert (node["node_label"], node["source_extraction_id"], node["source_extraction_ids"]) == ("Fraud", 1, [*range(1, 10), 20])
    assert json.loads(node["p"])["plaintiff"] == "A" and json.loads(node["p"])["claim_type"] == "x"
    assert node["node_id"] == N.extraction_nodes(spark.createDataFrame(rows[-1:], FOUND)).first()["node_id"]


def test_match_party_compares_across_sides_once(spark, monkeypatch):
    """A document's parties aren't compared with one another, nor its names; a pair of texts is scored in one Python pass, however many names have it."""
    made = []
    monkeypatch.setattr(G, "ratio", lambda *a, ratio=G.ratio: made.append(a) or ratio(*a))
    names = spark.createDataFrame([(k, 1, "Acme Holdngs") for k in range(3)] + [(3, 1, "acme"), (4, 1, "Zenith"), (5, 2, "Acme Holding")], "name_id int, document_id int, name string")
    parties = spark.createDataFrame([("p1", 1, "Acme Holdings"), ("p2", 1, "Acme Holding"), ("p3", 1, "Acme Holdin"), ("p4", 3, "Acme Holding")], "node_id string, document_id int, node_label string")
    got = {r["name_id"]: (r["node_id"], round(r["score"], 2)) for r in G.match_party(names, parties).collect()}
    assert got == {0: ("p1", 0.96), 1: ("p1", 0.96), 2: ("p1", 0.96), 3: ("p1", 0.8)} and len(made) == 1
    pairs = G.similar_to(names.selectExpr("document_id", "lower(name) AS x"), parties.selectExpr("document_id", "lower(node_label) AS y"), 0.8, ("document_id",))
    assert {r["x"] for r in pairs.collect()} == {"acme holdngs", "acme"} and pairs.count() == 6


def test_ratio_over_batches(spark):
    """Pairs recur over many batches of Arrow, nulls among them."""
    words = ["acme", "acme inc", "zenith", "", None, "acne"]
    rows = [(k, words[k % 6], words[k // 6 % 6]) for k in range(5000)]
    got = {r["k"]: r["r"] for r in spark.createDataFrame(rows, "k int, a string, b string").withColumn("r", D.ratio("a", "b", 0.5)).collect()}
    want = {k: None if a is None or b is None else ratio_of(a, b) for k, a, b in rows}
    assert all(got[k] == (w if w is None or w >= 0.5 else 0.0) for k, w in want.items())


def test_steps_of_paths_are_stored_once(spark, monkeypatch):
    """Steps and what hops reach are stored, no step leaves a terminal node against its edge, and the result joins nothing again when no path is open."""
    stored = []
    monkeypatch.setattr(G, "kept", lambda df, kept=G.kept: stored.append(kept(df)) or stored[-1])
    nodes = spark.createDataFrame([("c", "claim"), ("d", "claim"), ("e", "evidence"), ("o", "obligation"), ("o", "obligation"), ("l", "legal_authority"), ("x", None)], "node_id string, node_type string")
    edges = spark.createDataFrame([("c", "e", "references", 0.9), ("d", "e", "references", 0.8), ("o", "c", "references", 0.7), ("o", "l", "references", 0.6), ("c", "x", "references", 1.0), ("c", "gone", "references", 1.0), (None, "c", "references", 1.0)], "src string, dst string, edge_type string, confidence double")
    monkeypatch.setattr(G, "forget", lambda *tables: None)
    paths = G.evidence_paths(nodes, edges, 4)
    assert sorted((r["claim"], r["target"], r["path"], r["confidence"], r["hops"]) for r in paths.collect()) == [("c", "e", "c>e", 0.9, 1), ("c", "l", "c>o>l", 0.6, 2), ("c", "l", "c>o>l", 0.6, 2), ("d", "e", "d>e", 0.8, 1)]
    assert sorted((r["u"], r["v"]) for r in stored[1].collect()) == [("c", "e"), ("c", "o"), ("c", "o"), ("d", "e"), ("o", "c"), ("o", "l")]
    assert len(stored) == 4 and "Join" not in paths._jdf.queryExecution().optimizedPlan().toString()


def test_stored_results_leave_no_shuffle_files(spark):
    """A stored table's shuffles are deleted when it has been written, and the session's setting is as before."""
    before = spark.conf.get(G.SHUFFLE_CLEANUP)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    n = held()
    t = G.kept(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    assert held() <= n and t.count() == 7 and spark.conf.get(G.SHUFFLE_CLEANUP) == before


def test_running_heads_go_by_place(spark):
    long_ = "Head " * 32
    pages = {k: [long_, f"text {k}", long_] for k in range(1, 6)} | {6: ["", "", long_, "other"], 7: ["x y"], 8: [long_]}
    rows = [(1, p, 100 * p + n, t) for p, lines in pages.items() for n, t in enumerate(lines)] + [(2, p, 100 * p, long_) for p in (1, 2)] + [(3, p, 100 * p + n, t) for p in (1, 2, 3) for n, t in enumerate(["a" + "b" * p, "second " * 30])]
    got = {(r["document_id"], r["pos"]) for r in D.remove_repeated_lines(spark.createDataFrame(rows, "document_id int, page int, pos int, line string")).collect()}
    gone = {(1, 100 * p) for p in (1, 2, 3, 4, 5, 8)} | {(1, 602)} | {(3, 100 * p + 1) for p in (1, 2, 3)}
    assert got == {(d, pos) for d, _, pos, _ in rows} - gone


def test_common_subsequence_bounds_the_ratio():
    import random
    from difflib import SequenceMatcher

    from caselake.operators.structure import common, places

    rng = random.Random(4)
    assert common("abcde", places("xaxcxe"), 6) == 3 and common("", places("a"), 1) == 0 and common("a", {}, 0) == 0
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        table = [0] * (len(b) + 1)
        for c in a:
            before = table
            table = [0]
            for j, d in enumerate(b):
                table.append(before[j] + 1 if c == d else max(before[j + 1], table[j]))
        assert sum(m.size for m in blocks) <= common(a, places(b), len(b)) == table[-1]


def test_ratio_of_rows_needs_no_shuffle(spark):
    from caselake.operators.structure import with_ratio

    rows = spark.createDataFrame([("abc", "abc"), ("abcd", "abcx"), ("abc", "zzz"), ("", ""), (None, "a"), ("a", "a" * 50)], "a string, b string")
    out = with_ratio(rows, "a", "b", 0.6)
    assert [r["ratio"] for r in out.collect()] == [1.0, 0.75, 0.0, 0.0, 0.0, 0.0]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_batches_are_bounded_in_bytes(spark):
    """What a Python worker gets at once doesn't depend on how long texts are."""
    from caselake import catalog

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for name in ("html_text", "model_labels"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_stored_once(spark, monkeypatch):
    """Parsed results are stored, not parsed again for each table."""
    made = []
    monkeypatch.setattr(G, "kept", lambda df, kept=G.kept: made.append(df.columns) or kept(df))
    t = G.flatten_structure(spark.createDataFrame([(1, '{"claims": [{"label": "x", "counts": [{"number": 1, "label": "n"}]}]}')], "document_id long, json string"))
    assert t["counts"].count() == 1 and made == [["document_id", "r"]]


def test_best_match_sorts_once(spark, tmp_path):
    """Edges meet by src alone: no exchange and no hash table to take out repeats, which change nothing."""
    from caselake import catalog

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_returnflag string"
    rows = [(1, 1, 9, 1, 0.05, "N"), (1, 1, 10, 2, 0.05, "N"), (1, 1, 3, 3, 0.07, "N"), (2, 1, 9, 1, 0.08, "N"), (3, 2, 9, 1, 0.02, "R"), (3, 2, 9, 1, 0.02, "R"), (3, 2, 9, 1, 0.06, "R")]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(9, 4)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    out = catalog.QUERIES["best_match"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("c1", "s10", 0.95), ("c3", "s9", 0.98), ("o3-1", "c3", 0.95)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan
    executed = out._jdf.queryExecution().toString().split("== Initial Plan ==")[-1]
    assert executed.count("Exchange hashpartitioning") == 1
