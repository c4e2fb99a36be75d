"""Operators that SQL does not express, and rules of the ones that it does, on hand-made inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import canonical as C
from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.sources import dom

OBS = "paper_id string, id string, section_id long, pos int, kind string, label string, alias string, confidence double"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("word,want", [("policy", "policies"), ("losses", "loss"), ("box", "boxes"), ("model", "models"), ("analysis", "analysises"), ("days", "day"), ("ELBO", "ELBOs"), ("a", None), ("reward model.", "reward models."), ("bus", "buses")])
def test_plural_variants(spark, word, want):
    assert one(spark, T.plural_variant(F.lit(word))) == want


def test_normal_forms(spark):
    d = spark.createDataFrame([("  Straße—Test  ", r"$\left( x_{t} \right)$"), ("ELBO", "$X$"), (None, None)], "a string, b string")
    got = [tuple(r) for r in d.select(T.normalize_text("a"), T.normalize_math("b")).collect()]
    assert got == [("strasse test", "(x_t)"), ("elbo", "x"), ("", "")]


def test_small_functions(spark):
    assert one(spark, T.arxiv_id(F.lit("https://arxiv.org/pdf/2401.00001"))) == "2401.00001"
    assert one(spark, T.arxiv_id(F.lit(" 2401.1 "))) == "2401.1"
    assert one(spark, T.arxiv_id(F.lit("x"))) is None
    assert one(spark, T.archive_kind(F.lit("A.TAR.GZ"))) == "tar" and one(spark, T.archive_kind(F.lit("a.tex"))) is None
    assert one(spark, T.bare_body(F.lit("<html><BODY a=1>x\ny</BODY></html>"))) == "x\ny"
    assert one(spark, T.orthographic_variants(F.lit("a b"))) == ["a-b"]
    assert one(spark, T.snippet(F.lit("x" * 100), F.lit(50), F.lit(51))) == "..." + "x" * 81 + "..."
    assert one(spark, T.safe_rate(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, T.math_signatures(F.lit(r"a $X_{1}$ b \(y\) $x_1$"))) == ["x_1", "y"]
    assert one(spark, T.retrieval_tokens(F.lit("What is the Loss of the loss?"))) == ["loss", "loss"]


def test_entities_are_greedy(spark):
    rows = [("p", "1", 0, 0, "topic", "a", None, 1.0), ("p", "2", 0, 0, "topic", "b", None, 1.0), ("p", "3", 0, 0, "topic", "a", "b", 1.0), ("p", "4", 0, 0, "claim", "A", None, 1.0)]
    for order in itertools.permutations(rows):
        got = {r["observation_id"]: r["entity_id"] for r in C.entities(spark.createDataFrame(list(order), OBS)).collect()}
        assert got == {"1": "1", "2": "2", "3": "1", "4": "4"}
        break


def test_entities_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [("p", f"{i:03d}", 0, 0, "topic", rnd.choice("abcdefghij"), rnd.choice([None, *"abcdefghij"]), 1.0) for i in range(60)]
    groups = []
    for r in rows:
        names = {x for x in (r[5], r[6]) if x}
        g = next((g for g in groups if g[1] & names), None)
        if g is None:
            groups.append(([r[1]], names))
        else:
            g[0].append(r[1])
            g[1].update(names)
    want = {x: g[0][0] for g in groups for x in g[0]}
    assert {r["observation_id"]: r["entity_id"] for r in C.entities(spark.createDataFrame(rows, OBS)).collect()} == want


@pytest.mark.parametrize("text,surfaces,want", [
    ("SUPG stabilizes transport. SUPG uses tau.", ["supg"], [(0, 4), (27, 31)]),
    ("Reward models are evaluated by one LLM.", ["reward models", "llm"], [(0, 13), (35, 38)]),
    ("The models differ.", ["model"], []),
    ("gradient descent converges", ["gradient", "gradient descent"], [(0, 16)]),
    ("a++ b ++ c ++", ["++", " "], [(6, 8), (11, 13)]),
    ("C++ and c+ +x, x_1 x", ["c++", "+x", "X", "c+ +x, x_1"], [(0, 3), (8, 18), (19, 20)]),
    ("New York and new  york", ["new york", "york and", "york"], [(0, 8), (18, 22)]),
])
def test_occurrences(spark, text, surfaces, want):
    nodes = spark.createDataFrame([("p", 1, text)], "paper_id string, node long, text string")
    surf = spark.createDataFrame([("p", s, s, False) for s in surfaces], "paper_id string, subject string, surface string, generated boolean")
    assert sorted((r["start"], r["end"]) for r in C.occurrences(nodes, surf).collect()) == want


def small_graph(spark, n=40, relations=None):
    objects = [(1, f"e{i:02d}", "topic", f"Entity {i}", i / (n - 1), 1 - i / (2 * n), (i % 5) / 5, 0.8, 1.0 if i >= n - 2 else 0.1) for i in range(n)]
    relations = [(0, i) for i in range(1, 12)] if relations is None else relations
    rel = [(1, f"r{a:02d}-{b:02d}", "depends_on", f"e{a:02d}", f"e{b:02d}", 0.8, 1) for a, b in relations]
    o = spark.createDataFrame(objects, "paper_id int, id string, kind string, label string, contribution double, prominence double, recurrence double, confidence double, familiarity double")
    return o, spark.createDataFrame(rel, "paper_id int, id string, type string, source_id string, target_id string, confidence double, evidence int")


def plain_overview(objects, relations, limit):
    """The selection by its definition, from ranked rows: (id, label, contribution, rank) and pairs of ids."""
    order = sorted(objects, key=lambda o: (-o[3], o[1].lower(), o[0]))
    near = {o[0]: set() for o in objects}
    for a, b in relations:
        if a != b and a in near and b in near:
            near[a].add(b), near[b].add(a)
    chosen = [o[0] for o in order if o[2] >= 0.8][: max(1, round(limit * 0.25))] or [order[0][0]]
    while len(chosen) < min(limit, len(order)):
        left = [o[0] for o in order if o[0] not in chosen]
        ties = {x: len(near[x] & set(chosen)) for x in left}
        chosen.append(max(left, key=lambda x: (ties[x], -left.index(x))))
    return [o[0] for o in order if o[0] in chosen]


@pytest.mark.parametrize("limit", [1, 7, 30])
def test_overview_is_the_one_of_its_definition(spark, limit):
    import random

    r = random.Random(limit)
    objects, edges = [], []
    for paper in ("p", "q", None, "lone"):
        n = 1 if paper == "lone" else 60
        objects += [(paper, f"e{i}", "topic", r.choice(["Same", "same", f"L{i}"]), r.choice([0.1, 0.5, 0.9]) if paper != "q" else 0.2, 0.5, r.choice([0.0, 0.3]), 0.8, 0.1) for i in range(n)]
        edges += [(paper, f"r{i}", "uses", f"e{r.randrange(n)}", f"e{r.randrange(n + 3)}", 0.5, 1) for i in range(n)]
    o = spark.createDataFrame(objects, "paper_id string, id string, kind string, label string, contribution double, prominence double, recurrence double, confidence double, familiarity double").where("paper_id is not null")
    e = spark.createDataFrame(edges, "paper_id string, id string, type string, source_id string, target_id string, confidence double, evidence int")
    ranks = G.ranked(o, e).collect()
    got: dict = {}
    for x in G.overview(o, e, limit).orderBy("place").collect():
        got.setdefault(x["paper_id"], []).append(x["id"])
    for paper in ("p", "q", "lone"):
        own = [(x["id"], x["label"], x["contribution"], x["rank"]) for x in ranks if x["paper_id"] == paper]
        assert got[paper] == plain_overview(own, [(x[3], x[4]) for x in edges if x[0] == paper], limit)


def test_overview_and_search_of_other_keys(spark):
    o = spark.createDataFrame([(7, 10 + i, "topic", f"Thing {i}", ["Alias  ONE"] if i == 2 else None, 0.9 - i / 10, 0.5, 0.0, 0.8, 0.0) for i in range(5)], "paper_id long, id long, kind string, label string, aliases array<string>, contribution double, prominence double, recurrence double, confidence double, familiarity double")
    e = spark.createDataFrame([(7, 100 + i, "uses", 10, 11 + i, 0.5, 1) for i in range(3)], "paper_id long, id long, type string, source_id long, target_id long, confidence double, evidence int")
    nodes = G.overview(o, e, 4)
    assert [x["id"] for x in nodes.orderBy("place").collect()] == [10, 11, 12, 13]
    assert sorted(x["id"] for x in G.backbone(o, e, nodes).collect()) == [100, 101, 102]
    facets = spark.createDataFrame([(7, 14, "said of ALIAS here"), (7, 12, "alias")], "paper_id long, id long, text string")
    found = [(x["id"], round(x["score"] - 0.2 * r, 1)) for x, r in ((x, {y["id"]: y["rank"] for y in G.ranked(o, e).collect()}[x["id"]]) for x in G.search(o, e, "alias", facets=facets).orderBy("place").collect())]
    assert found == [(12, 0.8), (14, 0.4)] and [x["id"] for x in G.search(o, e, " alias one ").collect()] == [12] and G.search(o, e, "thing", kinds=["claim"]).count() == 0


def test_overview(spark):
    o, r = small_graph(spark)
    got = [x["id"] for x in G.overview(o, r, 100).orderBy("place").collect()]
    assert len(got) == 30 and "e39" in got
    assert len(G.overview(o, r, 10).collect()) == 10


def test_backbone_is_a_spanning_forest(spark):
    o, r = small_graph(spark, 8, list(itertools.combinations(range(8), 2)))
    nodes = G.overview(o, r, 30)
    assert nodes.count() == 8
    assert G.backbone(o, r, nodes).count() == 7


def test_focus_budgets_and_search(spark):
    o, r = small_graph(spark)
    seeds = spark.createDataFrame([(1, "e00")], "paper_id int, id string")
    nodes = G.focus_nodes(o, r, seeds, 5)
    assert nodes.count() == 5 and nodes.where("role = 'seed'").count() == 1
    assert G.induced(r, nodes, 3).count() == 3
    assert [x["id"] for x in G.search(o, r, "Entity 17", 5).collect()] == ["e17"]
    assert {x["omitted"] for x in G.omitted(r, nodes, G.induced(r, nodes, 3)).where("id = 'e00'").collect()} == {8}


def test_components_and_closure(spark):
    o, r = small_graph(spark, 10, [(0, 1), (1, 2), (2, 0), (5, 6)])
    got = {x["id"]: x["component"] for x in G.components(o, r).collect()}
    assert [got[f"e{i:02d}"] for i in (0, 1, 2, 3, 5, 6)] == ["e00", "e00", "e00", "e03", "e05", "e05"]
    start = spark.createDataFrame([(1, "e00")], "paper_id int, id string")
    assert sorted((x["id"], x["depth"]) for x in G.closure(r, start).collect()) == [("e00", 0), ("e01", 1), ("e02", 2)]


def test_violations(spark):
    o, r = small_graph(spark, 3, [(0, 0), (0, 9)])
    got = sorted((x["rule"], x["key"]) for x in C.violations(o.union(o.limit(1)), r).collect())
    assert ("loop", "r00-00") in got and ("unknown target", "r00-09") in got and any(k == "repeated object id" for k, _ in got)


def test_evaluate(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "question_id int, id string")
    expected = spark.createDataFrame([(1, "a"), (3, "z")], "question_id int, id string")
    got = {r["question_id"]: (r["recall"], r["faithfulness"]) for r in R.evaluate(found, expected).collect()}
    assert got == {1: (1.0, 0.5), 2: (1.0, 0.0), 3: (0.0, 1.0)}


def test_dom(spark):
    html = "<html><body><h1>T</h1><p>a<br>b <b>c<p>d</p></b></p><script>x</script><h2>U</h2><h3>V</h3><h2>W</h2></body>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    nodes = dom.page_nodes(pages)
    got = [(r["tag"], r["text"]) for r in nodes.where("page_id = 1").orderBy("pos").collect()]
    assert got == [("h1", "T"), ("p", "ab c"), ("p", "d"), ("h2", "U"), ("h3", "V"), ("h2", "W")]
    parents = {r["title"]: r["parent_pos"] for r in dom.page_sections(nodes).collect()}
    assert parents == {"T": None, "U": 0, "V": 3, "W": 0}
    texts = {r["page_id"]: r["text"] for r in dom.page_text(pages).collect()}
    assert texts == {1: "T a b c d U V W", 2: ""}


def test_links_of_labels_inside_of_tokens(spark):
    q = spark.createDataFrame([(1, "the partial rewards of policies"), (2, None), (3, "of the")], "question_id int, question string")
    labels = spark.createDataFrame([("art", "art"), ("two", "al reward"), ("alias", "nothing"), ("alias", "Reward"), ("gap", "partial policies"), ("blank", "the"), ("none", None)], "id string, label string")
    got = {(x["question_id"], x["id"]): x["score"] for x in R.entity_link(q, labels, k=10).collect()}
    assert got == {(1, "art"): 2.0, (1, "two"): 2.0, (1, "alias"): 2.0, (1, "gap"): 1.0}
