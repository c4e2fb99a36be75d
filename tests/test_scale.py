"""What keeps work in proportion to the tables: each text is read once, and what is collected for one is bounded."""

import os
import random
import re
import time

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillgraph.operators import document as D
from quillgraph.operators import graph as G
from quillgraph.operators import quality as Q
from quillgraph.operators import retrieval as R
from quillgraph.plans import registry
from quillgraph.sources import adapters, dom

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def document(spark):
    return registry.document(spark, DATA)


@pytest.mark.parametrize("part", ["observations", "objects", "object_evidence", "facets", "relations", "equations", "notation", "notation_evidence", "explanations", "occurrences"])
def test_parts_of_documents_do_not_read_the_texts_again(document, part):
    assert not [f for f in getattr(document, part).inputFiles() if "documents.parquet" in f]


def test_equations_that_define_nothing_stay_and_an_object_has_one_at_most(document):
    assert document.equations.where("defined_object_id is null").count() > 0
    assert document.equations.where("defined_object_id is not null").groupBy("paper_id", "defined_object_id").count().where("count > 1").count() == 0


def forms_by_patterns(text, forms):
    """What places_of_forms must give, form by form."""
    own = {x: (e, o) for x, e, o in forms}
    places = [(not e, m.start(), m.start() - m.end(), o or x, x) for x, (e, o) in own.items() for m in re.finditer(rf"(?<!\w){re.escape(x)}(?!\w)", text, re.IGNORECASE)]
    out = []
    for rest, start, length, _, x in sorted(places):
        if not any(start < b and start - length > a for a, b, *_ in out):
            out.append((start, start - length, x, not rest, own[x][1]))
    return out


def test_one_walk_finds_what_patterns_find():
    r = random.Random(7)
    parts = ["a", "b", "ab", "A", "-", " ", "_", "s", "ſ", "k", "K", "é", "É", ".", "1", "ß", "i", "İ"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 25)))
        forms = {x: (x, e := r.random() < 0.5, f"o{r.randint(0, 3)}" if e else None) for _ in range(r.randint(0, 6)) if len(x := "".join(r.choices(parts, k=r.randint(1, 5))).lower().strip()) > 1}
        assert Q.places_of_forms(text, list(forms.values())) == forms_by_patterns(text, list(forms.values()))


def test_forms_of_a_long_text_take_one_walk(spark):
    """30,000 words with a form each: before, every form went through the text."""
    words = [f"w{i}" for i in range(30_000)]
    nodes = spark.createDataFrame([("p", 1, " ".join(words))], "paper_id string, node long, text string")
    forms = spark.createDataFrame([("p", w, f"o{i}", w, "exact") for i, w in enumerate(words)], "paper_id string, form string, subject_id string, surface string, category string")
    began = time.time()
    assert Q.found_forms(nodes, forms).agg({"n": "sum"}).first()[0] == 30_000
    assert time.time() - began < 60


def test_few_pages_are_python_objects_at_a_time():
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": ["<p>x</p>"] * 1000})
    parts = list(dom.slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == dom.SLICE
    assert pa.Table.from_batches(parts).column("page_id").to_pylist() == list(range(1000))


def test_ids_of_blocks_over_several_slices(spark):
    pages = spark.range(3 * dom.SLICE + 1).selectExpr("id AS page_id", "'<p>x</p>' AS html").coalesce(1)
    assert dom.page_nodes(pages).selectExpr("count(DISTINCT node_id)", "count(DISTINCT page_id)").first() == (3 * dom.SLICE + 1,) * 2


def test_surfaces_do_not_read_the_texts_again(spark):
    assert not [f for f in registry.surfaces(spark, DATA).inputFiles() if "documents.parquet" in f]


def test_words_of_a_document_are_no_rows(spark):
    plan = adapters.observations(spark, DATA)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_words_of_documents_that_share_an_id_are_counted_together(spark, tmp_path):
    rows = [("s", 7, "beta beta beta alpha an"), ("s", 7, "Alpha alpha alpha the gamma"), (None, 8, "delta"), ("t", 7, "beta beta omega abc"), ("t", 9, None), ("t", 10, "")]
    spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["section_id"], r["pos"], r["paper_id"], r["label"], r["confidence"]) for r in adapters.observations(spark, str(tmp_path)).collect())
    assert got == [(7, 1, "s", "alpha", 0.4), (7, 2, "s", "beta", 0.3), (7, 3, "t", "beta", 0.2), (7, 4, "s", "gamma", 0.1), (7, 5, "t", "omega", 0.1), (8, 1, None, "delta", 0.1)]


def test_places_keep_their_own_section(spark):
    """A node in two sections: before, each place of one text was given to both."""
    found = spark.createDataFrame([("p", "topic:1", "nets", [])], "paper_id string, stable_id string, label string, aliases array<string>")
    nodes = spark.createDataFrame([("p", "s1", "n", "nets"), ("p", "s2", "n", "two Nets"), ("p", "s3", "m", "none")], "paper_id string, section_id string, node_id string, text string")
    assert sorted((r["scope_id"], r["start"], r["text"]) for r in D.anchored_occurrences(nodes, found).collect()) == [("s1", 0, "nets"), ("s2", 4, "Nets")]


def test_ids_of_occurrences_are_stable_ids(spark):
    places = [None, "", "--", "n1", "N 1", "é|x", "ſ", "a\u0301", "|", "ﬁ-7"]
    rows = spark.createDataFrame([(s, p, n, n + 3) for s in ("topic:ab", "Ä:1") for p in places for n in (0, 12, -5)], "s string, p string, start long, end long")
    assert rows.where(D.occurrence_id("s", "p") != D.stable("occurrence", F.col("s"), None, F.concat_ws("|", "p", "start", "end"))).count() == 0


def tables_written(monkeypatch, *modules):
    """What is written from now on, as (name, types)."""
    seen = []
    for m in modules:
        monkeypatch.setattr(m, "written", lambda d, name, w=m.written: (seen.append((name, dict(d.dtypes))), w(d, name))[1])
    return seen


def test_components_are_found_over_numbers(spark, monkeypatch):
    """Before, each round wrote and joined all links by the ids of both ends."""
    seen = tables_written(monkeypatch, registry, G)
    assert registry.component_sizes(spark, DATA).count() == 5
    assert {n for n, _ in seen} >= {"links", "hops"} and not [n for n, kinds in seen if "string" in kinds.values()]


def least_reached(n, links):
    low = list(range(n))
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_roots_are_the_least_codes_reached(spark):
    r = random.Random(3)
    order = r.sample(range(300), 300)
    path = list(zip(range(299), range(1, 300)))
    star = [(299, i) for i in range(299)]
    graphs = [path, [(order[a], order[b]) for a, b in path], star, [(r.randrange(300), r.randrange(300)) for _ in range(170)]]
    rows = [(k, min(a, b), max(a, b)) for k, g in enumerate(graphs) for a, b in g if a != b]
    got = {(x["paper_id"], x["code"]): x["root"] for x in G.roots(spark.createDataFrame(rows, "paper_id int, a long, b long")).collect()}
    ends = {(k, x) for k, *ab in rows for x in ab}
    assert got == {(k, x): low[x] for k, g in enumerate(graphs) for low in [least_reached(300, g)] for x in range(300) if (k, x) in ends}


def test_components_of_repeated_unknown_and_missing_ids(spark):
    o = spark.createDataFrame([("p", "c"), ("p", "b"), ("p", "b"), ("p", "a"), ("p", None), ("q", "b"), (None, "z")], "paper_id string, id string")
    e = spark.createDataFrame([("p", "c", "b"), ("p", "b", "c"), ("p", "a", "x"), ("p", "x", "c"), ("q", "b", "b"), ("q", "b", "c"), (None, "z", "a")], "paper_id string, source_id string, target_id string")
    got = sorted((str(x["paper_id"]), str(x["id"]), str(x["component"])) for x in G.components(o, e).collect())
    assert got == [("None", "z", "z"), ("p", "None", "None"), ("p", "a", "a"), ("p", "b", "b"), ("p", "b", "b"), ("p", "c", "b"), ("q", "b", "b")]


def test_overviews_take_links_as_numbers(spark, monkeypatch):
    """Before, all links were written twice with names and ranks, and once more for the measures."""
    seen = tables_written(monkeypatch, registry, G, Q)
    assert registry.quality_papers(spark, DATA).count() == 5
    assert len([n for n, _ in seen if n == "objects"]) == len([n for n, _ in seen if n == "relations"]) == 1
    assert not [n for n, kinds in seen if n in ("links", "link-ends", "roots", "hops", "overview-next") and "string" in kinds.values()]
    assert not [n for n, _ in seen if n == "overview-near"]


def test_measures_of_graphs_with_isolates_repeats_and_loops(spark):
    o = spark.createDataFrame([("p", x) for x in "abcdeee"] + [("lone", "a")], "paper_id string, id string")
    e = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a"), ("p", "a", "c"), ("p", "a", "d"), ("p", "e", "e"), ("p", "a", "z")], "paper_id string, source_id string, target_id string")
    got = {x["paper_id"]: x.asDict() for x in Q.connectivity(o, e).collect()}
    assert got["p"] == {"paper_id": "p", "nodes": 5, "edges": 4, "isolates": 1, "components": 2, "largest": 4, "mean_degree": 1.2, "density": 0.3, "least_degree": 0, "most_degree": 3, "ordinary": 4, "ordinary_mean": 0.75, "hubs": 1, "hub_mean": 3.0, "isolate_rate": 0.2, "largest_rate": 0.8}
    assert got["lone"] == {"paper_id": "lone", "nodes": 1, "edges": 0, "isolates": 1, "components": 1, "largest": 1, "mean_degree": 0.0, "density": 0.0, "least_degree": 0, "most_degree": 0, "ordinary": 1, "ordinary_mean": 0.0, "hubs": 0, "hub_mean": 0.0, "isolate_rate": 1.0, "largest_rate": 1.0}


def test_both_ways_of_retrieval_share_their_scores(spark, monkeypatch):
    """Before, passages were scored once for each way, and rows of tokens by questions were shuffled."""
    seen = tables_written(monkeypatch, registry, R)
    assert registry.retrieval_classes(spark, DATA).count() == 2
    assert [n for n, _ in seen].count("token-counts") == [n for n, _ in seen].count("lexical-scores") == 1


def test_best_scores_are_those_of_nine_digits(spark):
    r = random.Random(5)
    near = [(1, i, 5.0 + r.choice([0, 1e-10, 4e-10, 6e-10, 2e-9, 1e-7, -3e-10])) for i in range(60)] + [(2, 7, 0.0), (3, 9, 0.0), (3, 8, 0.0), (3, 7, -1.0)]
    scored = spark.createDataFrame(r.sample(near, len(near)), "question_id long, id long, score double")
    for k in (1, 2, 20):
        want = [(q, n, i) for q in (1, 2, 3) for n, (_, i) in enumerate(sorted((-round(s, 9), i) for p, i, s in near if p == q)[:k], 1)]
        assert [tuple(x)[:3] for x in R.best_scores(scored, k).orderBy("question_id", "rank").collect()] == want
