"""Changes of tables, application of suggestions, views, extension points, streams."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import markup as M
from quillgraph.operators import extend, store, views
from quillgraph.operators import graph as G
from quillgraph.operators import quality as Q
from quillgraph.streaming import progress


def test_markup(spark):
    bare = {"token y_l and (m_s), x^2.": "token $y_l$ and ($m_s$), $x^2$.", "snake_case $a_b$ \\alpha": "snake_case $a_b$ $\\alpha$", "y_{i,t} \\(x_1\\) 5_x": "$y_{i,t}$ \\(x_1\\) 5_x", "a \\$ b_c $": "a \\$ $b_c$ $", "$$ a_1 $ b_2": "$$ a_1 $ $b_2$", "(\\beta^{2}) {x_i} a{b} a{b_c}!": "($\\beta^{2}$) {$x_i$} a{b} $a{b_c}$!", "\\[ open_x": "\\[ open_x"}
    got = spark.createDataFrame([(k,) for k in bare], "t string").select("t", M.wrap_bare_math("t").alias("w")).collect()
    assert {r["t"]: r["w"] for r in got} == bare
    round_ = {"$x$ and $$y$$ \\$5": "\\(x\\) and $$y$$ \\$5", "lone $ here": "lone $ here", "$a\\$b$": "\\(a\\$b\\)", "costs $5\nand $6": "costs $5\nand $6", "$a$$b$": "\\(a$$b\\)", "$$x": "$$x", "$$a\\$$$ $y$": "$$a\\$$$ \\(y\\)"}
    got = spark.createDataFrame([(k,) for k in round_], "t string").select("t", M.latex_delimiters("t").alias("w"), M.math_source(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["w"] for r in got} == round_
    one = spark.createDataFrame([("$x$", "<p>a <b>b</b> <math><mi>x</mi><annotation encoding=\"application/x-tex\">x_1</annotation></math></p>", '<img src="a/b.png"><img src=\'https://x/y.png\'><a src="/api/papers/1/c.png">', "<feed><title>F</title><entry>\n<title>An\n  entry</title></entry></feed>", "Error 503")], "m string, h string, a string, x string, e string")
    r = one.select(M.math_source(F.col("m"), True).alias("m"), M.plain_text(F.col("h")).alias("h"), M.asset_paths(F.col("a"), F.lit("http://s/api/papers/1/assets")).alias("a"), M.atom_title(F.col("x")).alias("x"), M.worth_retrying(F.col("e")).alias("e"), M.relation_label(F.lit("depends_on")).alias("r"), M.plural_label(F.lit("quantity")).alias("p")).first()
    assert (r["m"], r["h"], r["x"], r["e"], r["r"], r["p"]) == ("\\[x\\]", "a b $x_1$", "An entry", True, "Depends on", "Quantities")
    assert r["a"] == '<img src="http://s/api/papers/1/assets/b.png"><img src=\'https://x/y.png\'><a src="/api/papers/1/c.png">'


def test_application_is_all_or_nothing_for_each_page(spark):
    pages = spark.createDataFrame([(1, "<p data-id='n'>tau and mu</p>"), (2, "<p data-id='n'>tau</p>")], "paper_id long, html string")
    sug = spark.createDataFrame([(1, "t", "Tau", "about tau", 0), (1, "m", "Mu", "about mu", 1), (1, "z", "Zeta", "none", 2), (2, "t", "Tau", "x", 0)], "paper_id long, entity_id string, label string, content string, place int")
    schema = "paper_id long, entity_id string, stable_id string, dom_node_id string, start int, end int, text string"
    asked = spark.createDataFrame([(1, "t", "o1", "n", 0, 3, "tau")], schema)
    known = spark.createDataFrame([(1, "t", "o9", "n", 4, 7, "and"), (1, "m", "o2", "n", 8, 10, "mu"), (1, "m", "o1", "n", 0, 3, "tau"), (2, "t", "o3", "n", 0, 3, "tau")], schema)
    notes = spark.createDataFrame([(1, "m"), (2, None)], "paper_id long, entity_id string")
    html, made, report = store.applied(pages, sug, asked, known, notes)
    got = {r["paper_id"]: r["html"] for r in html.collect()}
    assert got[1].count("kg-entity") == 2 and "o9" not in got[1] and got[2].count("kg-entity") == 1
    assert sorted((r["paper_id"], r["entity_id"]) for r in made.collect()) == [(1, "t"), (1, "z"), (2, "t")]
    assert {r["paper_id"]: (r["ok"], r["injected"], r["without"]) for r in report.collect()} == {1: (True, 2, ["Zeta"]), 2: (True, 1, None)}


def test_documents_in_storage(spark, tmp_path):
    s = spark.createDataFrame([(1, None), (2, '{"schema_version": "2.0"}'), (3, '{"schema_version": "3.0"}'), (4, '{"schema_version": "3.0", "observations": [], "objects": []}'), (5, "no json")], "paper_id int, document string")
    assert [r["status"] for r in store.stored_state(s).orderBy("paper_id").collect()] == ["none", "rebuild", "malformed", "ready", "rebuild"]
    path = str(tmp_path / "docs")
    store.overwrite_papers(spark.createDataFrame([(1, "a"), (2, "b")], "paper_id int, v string"), path)
    store.overwrite_papers(spark.createDataFrame([(2, "c")], "paper_id int, v string"), path)
    assert sorted((r["paper_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    p = store.payload(spark.createDataFrame([(1, "é", None)], "paper_id int, b string, a string"), ["b", "a"]).first()
    assert (p["json"], p["bytes"]) == ('{"a":null,"b":"é"}', 19)
    folder = tmp_path / "fix"
    folder.mkdir()
    (folder / "one.json").write_text('{"domain": "ml", "document": {"k": 1}}')
    (folder / "many.json").write_text('{"papers": [{"domain": "x", "document": {"k": 2}}, {"domain": "y", "document": {"k": 3}}]}')
    (folder / "bare.json").write_text('{"k": 4}')
    got = store.read_fixtures(spark, str(folder), "k int").collect()
    assert sorted((r["domain"] or "", r["document"]["k"]) for r in got) == [("", 4), ("ml", 1), ("x", 2), ("y", 3)]
    sec = spark.createDataFrame([("p", "s", i, "text") for i in range(3)], "paper_id string, section_id string, section_pos int, text string")
    assert store.first_sections(sec, 2).count() == 2 and store.first_sections(sec).count() == 3
    obs = spark.createDataFrame([("p", "a", "s", " ext "), ("p", "b", "s", "no"), ("p", "c", "s", " "), ("p", "d", "q", "ext")], "paper_id string, id string, section_id string, quote string")
    kept, errors = store.supported(obs, sec.where("section_pos = 0"))
    assert [r["id"] for r in kept.collect()] == ["a"] and {r["id"]: r["error"] for r in errors.collect()} == {"b": "quote not in section", "c": "blank quote", "d": "quote not in section"}


def test_suggestions_and_menus(spark):
    with pytest.raises(ValueError):
        store.suggestion_candidates(None, ["topic", "gadget"])
    rows = spark.createDataFrame([("p", "Symbol", True), ("p", "zeta", True), ("p", "Theorem", True), ("p", "x", False)], "paper_id string, entity_type string, is_ai_generated boolean")
    assert [(r["top"], r["type"], r["place"]) for r in store.suggestion_menu(rows).orderBy("top_place", "place").collect()] == [("manual", "x", 1), ("ai", "theorem", 1), ("ai", "symbol", 2), ("ai", "zeta", 3)]
    assert store.by_hand(rows).where("entity_id like 'manual_%'").count() == 4
    t = spark.createDataFrame([("formula", "F", "s", "x=1", None, None, None), ("symbol", "a", None, None, None, None, ""), ("definition", "D", "s", None, "whole", None, None), ("theorem", "T", "s", None, None, "y" * 300, None), ("other", "l", None, None, None, None, None)], "kind string, label string, summary string, latex string, definition string, statement string, context string")
    got = [r["t"] for r in t.select(store.tooltip_text(*[F.col(c) for c in t.columns]).alias("t")).collect()]
    assert got == ["F: s\n\nFormula: x=1", "Mathematical symbol: a", "s\n\nFull definition: whole", "T: s", "l"]


def test_extension_points(spark):
    sec = spark.createDataFrame([("p", "s1", "a b"), ("p", "s2", "boom")], "paper_id string, section_id string, text string")

    def words(paper, section, text):
        if text == "boom":
            raise RuntimeError("no")
        return [(w,) for w in text.split()]

    rows, errors = extend.extracted(sec, words, "word string")
    assert sorted(r["word"] for r in rows.collect()) == ["a", "b"] and errors.first()["error"] == "RuntimeError: no"
    assert [r["x"] for r in sec.select(extend.resolved(F.col("text"), {"boom": "bang"}.get).alias("x")).collect()] == [None, "bang"]
    notes = spark.createDataFrame([("p", "n", datetime.datetime(2024, 1, 1)), ("p", "n", datetime.datetime(2024, 1, 2))], "paper_id string, dom_node_id string, created_at timestamp")
    assert [extend.grouped(notes, g).count() for g in ("flat", "day", "node")] == [1, 2, 1]
    with pytest.raises(ValueError):
        extend.grouped(notes, "mood")
    eq = spark.createDataFrame([("p", "E", "x")], "paper_id string, equation_id string, latex string")
    assert extend.analysed(eq, lambda b: b.assign(summary="s")[["equation_id", "summary"]], "equation_id string, summary string").first()["summary"] == "s"


def test_builds_are_single_and_end_when_cancelled(spark):
    b = progress.Builds(spark)
    heard = []
    with b.only("p"):
        with pytest.raises(progress.Busy), b.only("p"):
            pass
        steps = b.steps("p", [lambda: 1, lambda: b.cancel("p"), lambda: 3], lambda k, n: heard.append(k))
        assert next(steps) == 1
        with pytest.raises(InterruptedError):
            next(steps)
    assert heard == [1, 2] and not b.running("p")


def test_builds_of_two_drivers_see_each_other(spark, tmp_path):
    one, two = progress.Builds(spark, f"file://{tmp_path}/builds"), progress.Builds(spark.newSession(), f"file://{tmp_path}/builds")
    with one.only("p/1"):
        assert two.running("p/1") and not two.running("p/2")
        with pytest.raises(progress.Busy), two.only("p/1"):
            pass
        with two.only("p/2"):
            assert one.running("p/2")
        steps = one.steps("p/1", [lambda: 1, lambda: 2, lambda: 3])
        assert next(steps) == 1
        two.cancel("p/1")
        with pytest.raises(InterruptedError):
            next(steps)
    # the claim is free again, and an old wish to cancel is forgotten
    with two.only("p/1"):
        assert list(two.steps("p/1", [lambda: 1, lambda: 2])) == [1, 2]
    # a claim that its driver left behind
    late = progress.Builds(spark, f"file://{tmp_path}/builds", stale_s=0.0)
    left = one.only("dead")
    left.__enter__()
    with pytest.raises(progress.Busy), two.only("dead"):
        pass
    with late.only("dead"):
        pass


def test_heartbeats_repeat_the_last_state(spark, tmp_path):
    schema = "paper_id long, event_id long, ts timestamp, stage string, value double"
    at = datetime.datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, at, "a", 1.0), (2, 2, at, "complete", None)], schema).coalesce(1).write.parquet(source)
    q = progress.stream_changes(spark.readStream.schema(schema).parquet(source), 5_000, 1_500).writeStream.outputMode("append").format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(120):
            found = [tuple(r) for r in spark.table("beats").collect()]
            if any(r[3] == "timeout" for r in found):
                break
            time.sleep(0.5)
        assert [r for r in found if r[0] == 2] == [(2, "complete", None, "change")]
        own = [r for r in found if r[0] == 1]
        assert own[0] == (1, "a", 1.0, "change") and own[-1] == (1, "error", None, "timeout") and len(own) >= 4 and set(own[1:-1]) == {(1, "a", 1.0, "heartbeat")}
    finally:
        q.stop()


def test_streamed_changes(spark, tmp_path):
    schema = "paper_id long, event_id long, ts timestamp, stage string, value double"
    at = lambda k: datetime.datetime(2024, 1, 1, 0, 0, k)
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([(1, 2, at(2), "a", 1.0), (1, 1, at(1), "a", 1.0), (1, 3, at(3), "b", None), (2, 4, at(1), "a", 0.0)])
    put([(1, 5, at(4), "b", None), (1, 6, at(5), "error", None), (1, 7, at(6), "c", 9.0)])
    q = progress.stream_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 12_000).writeStream.outputMode("append").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    # with timeouts there is always another batch to come: wait for rows, not for the end of input
    def rows(n):
        for _ in range(80):
            found = [tuple(r) for r in spark.table("changes").collect()]
            if len(found) >= n:
                return found
            time.sleep(0.5)
        return found

    try:
        want = {(1, "a", 1.0, "change"), (1, "b", None, "change"), (1, "error", None, "change"), (2, "a", 0.0, "change"), (2, "error", None, "timeout")}
        assert sorted(rows(5), key=repr) == sorted(want, key=repr)
    finally:
        q.stop()


def test_nearest_rank_and_profiles(spark):
    rows = [("s", float(i % 97) ** 2, i) for i in range(1000)] + [("t", 5.0, 1)] * 3 + [("u", None, 1)]
    df = spark.createDataFrame(rows, "stage string, value double, event_id long").repartition(3)
    ordered = sorted(v for s, v, _ in rows if s == "s")
    for p in (0.0, 0.5, 0.95, 1.0):
        want = {"s": ordered[min(999, int(1000 * p))], "t": 5.0}
        assert {r["stage"]: r["value"] for r in progress.nearest_rank(df, p).collect()} == want


def test_views(spark):
    o = spark.createDataFrame([(1, f"n{i}", "topic" if i % 2 else "claim", f"L{i}", i / 10, 0.5, 0.5, 0.5, 0.9 if i < 3 else 0.0) for i in range(10)], "paper_id int, id string, kind string, label string, contribution double, prominence double, recurrence double, confidence double, familiarity double")
    r = spark.createDataFrame([(1, f"e{i}", "uses", f"n{i}", f"n{(i + 1) % 10}", 0.5, 1) for i in range(10)], "paper_id int, id string, type string, source_id string, target_id string, confidence double, evidence long")
    nodes, edges, totals = views.overview(o, r, expertise="expert", limit=3)
    assert nodes.count() == 3 and {x["id"] for x in nodes.collect()}.isdisjoint({"n0", "n1", "n2"})
    t = totals.first()
    assert (t["total_objects"], t["total_relations"], t["omitted_relations"], t["truncated"]) == (10, 10, 10 - edges.count(), True)
    shown, kept, totals = views.focus(o, r, spark.createDataFrame([(1, "n5"), (1, "none")], "paper_id int, id string"), nodes=2, edges=0)
    assert [x["id"] for x in shown.collect()] == ["n5", "n6"] and kept.count() == 0 and totals.first()["truncated"]
    sec = spark.createDataFrame([(1, "title-1", None, 0, "The  Paper"), (1, "b", "title-1", 2, "B"), (1, "a", "title-1", 1, "A"), (1, "c", "b", 3, "C"), (2, "x", "gone", 0, "X"), (2, "y", None, 1, "Y")], "paper_id int, id string, parent_id string, pos int, title string")
    flat = views.flattened(sec)
    assert [(r["paper_id"], r["id"], r["depth"]) for r in flat.orderBy("paper_id", "place").collect()] == [(1, "title-1", 0), (1, "a", 1), (1, "b", 1), (1, "c", 2), (2, "x", 0), (2, "y", 0)]
    cut = views.without_title_root(flat, sec, spark.createDataFrame([(1, "the paper")], "paper_id int, title string"))
    assert [(r["id"], r["depth"], r["place"]) for r in cut.orderBy("paper_id", "place").collect()] == [("a", 0, 1), ("b", 0, 2), ("c", 1, 3), ("x", 0, 1), ("y", 0, 2)]
    g = spark.createDataFrame([(1, "s", "symbol", "tau", ["x"]), (1, "d", "definition", "y", ["a TAU"]), (1, "t", "theorem", "Tau", []), (1, "z", "other", "q", ["w"])], "paper_id int, id string, type string, label string, texts array<string>")
    assert [r["id"] for r in views.graph_search(g, "tau").orderBy("place").collect()] == ["t", "s", "d"]


def test_quality(spark):
    objects, relations = Q.synthetic_graph(spark, 10, 20, ["topic", "claim"])
    c = Q.connectivity(objects, relations).first()
    pairs = {tuple(sorted((i % 10, (7 * i + 1) % 10))) for i in range(20) if i % 10 != (7 * i + 1) % 10}
    assert (c["nodes"], c["density"]) == (10, round(len(pairs) / 45, 9)) and c["ordinary"] + c["hubs"] == 10
    nodes = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    edges = spark.createDataFrame([("e1", "seen"), ("e2", " "), ("e3", None)], "id string, evidence string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    dup = spark.createDataFrame([("g", "1"), ("g", "2"), ("g", "2"), ("h", "3"), ("h", "4")], "group string, id string")
    q = Q.flat_quality(nodes, edges, dup, ids("1", "1", "5"), ids("e1", "e2"), ids("1", "2", "3", "zz")).first()
    assert (q["duplicates"], q["duplicate_rate"], q["unsupported"], q["required"], q["bare"], q["evidence_rate"], q["stable_rate"]) == (2, 0.2, 2, 2, 1, 0.5, 0.3)
    o = spark.createDataFrame([("p", "a", "topic", "state space", ["SSM"]), ("p", "b", "artifact", "model", []), ("p", "c", "claim", "long claim", []), ("p", "d", "topic", "modelling", ["models"])], "paper_id string, stable_id string, kind string, label string, aliases array<string>")
    n = spark.createDataFrame([("p", "n1", "State space and state-space; SSMs, a model, models and modeling, SSM.")], "paper_id string, node string, text string")
    totals, missed = Q.occurrence_coverage(o, n)
    t = totals.first()
    assert (t["subjects"], t["exact"], t["inflection"], t["orthographic"], t["ambiguous"]) == (3, 4, 1, 1, 0)
    assert sorted((r["text"], r["category"]) for r in missed.collect()) == [("SSMs", "inflection"), ("state-space", "orthographic")]


def test_merged_projections(spark):
    n = lambda *ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], "paper_id int, id string, place int")
    e = spark.createDataFrame([(1, "e1", "a", "b"), (1, "e2", "b", "z")], "paper_id int, id string, source_id string, target_id string")
    nodes, edges = views.merged((n("a", "b"), e), (n("z", "y", "b"), e), most=3)
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b", "z"] and edges.count() == 2
    assert G.degree(edges).count() == 3


def test_tooltips_by_facets(spark):
    schema = "kind string, label string, facets array<struct<kind: string, text: string, summary: string, latex: string, roles: array<string>>>"
    f = lambda kind, text=None, summary=None, latex=None, roles=None: (kind, text, summary, latex, roles)
    cases = [
        (("formula", "Loss", [f("formula", None, "old", "a"), f("formula", None, "sum", "b")]), "Loss: sum\n\nFormula: b"), (("formula", None, [f("formula", None, "", "b")]), "b"), (("formula", None, [f("topic", "t")]), "Formula"),
        (("symbol", "x", [f("symbol_scope", roles=["in", "out"])]), "in; out"), (("symbol", "x", [f("symbol_scope", roles=[])]), "Mathematical symbol: x"), (("topic", "T", [f("topic", ""), f("topic", "first"), f("topic", "second")]), "first"),
        (("topic", "T", [f("topic", None)]), None), (("topic", "T", []), None), (("topic", "T", None), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema).coalesce(1)
    assert [r["t"] for r in df.select(store.facet_text(*[F.col(c) for c in df.columns]).alias("t")).collect()] == [want for _, want in cases]


def test_prompts_keep_to_their_budgets(spark):
    rows = [("p", "formula", 99 - i, f"f{99 - i}") for i in range(100)] + [("p", "theorem", 1, "t"), ("p", "other", 0, "o"), ("q", "symbol", 1, None)] + [("q", "symbol", i, f"s{i}") for i in range(2, 60)]
    got = {r["paper_id"]: r for r in store.prompt_lists(spark.createDataFrame(rows, "paper_id string, type string, pos int, line string")).collect()}
    assert got["p"]["formula"].split("\n") == [f"- f{i}" for i in range(30)] and got["p"]["theorem"] == "- t" and got["p"]["definition"] == "None found"
    assert len(got["q"]["symbol"].split("\n")) == 49 and got["q"]["formula"] == "None found"
    s = spark.createDataFrame([("p", "s", "x" * 20_000)], "paper_id string, section_id string, text string")
    assert [len(store.prompt_parts(s, n).first()["text"]) for n in store.PROMPT_CHARS.values()] == [8000, 12000, 1500]
