"""Adapters take whole tables and whole texts: nothing of the input is cut."""

import math
import re

import pytest

from quillgraph.operators import graph as G
from quillgraph.operators import trees
from quillgraph.plans import registry
from quillgraph.sources import adapters as A

ITEM = "one two three four five six seven eight needle haystack"


def tables(spark, folder, **frames):
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_questions_are_whole_items(spark, tmp_path):
    docs = [(1, "one two", "en", "s"), (2, "needle haystack needle haystack", "en", "s"), (3, f"x{ITEM}s", "en", "s"), (4, "zzz", "en", "s")]
    d = tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string"), benchmark=([(7, ITEM)], "item_id long, text string"))
    assert A.questions(spark, d).first()["question"] == ITEM
    got = {r["id"]: r["score"] for r in registry.QUERIES["passage_topk"](spark, d).collect()}
    tokens = {i: re.findall("[a-z0-9]+", t) for i, t, *_ in docs}
    df = {w: sum(w in t for t in tokens.values()) for w in ITEM.split()}
    score = {i: sum(t.count(w) * (math.log(5 / (df[w] + 1)) + 1) for w in ITEM.split()) for i, t in tokens.items()}
    score[3] += 1.5  # the phrase lies in the text, its ends in longer words
    best = sorted(score, key=lambda i: (-score[i], i))[:2]
    assert got == {i: round(score[i], 6) for i in best} and best == [3, 2]
    assert [r["id"] for r in registry.QUERIES["entity_link"](spark, d).collect()] == ["eight", "five", "four"]


def test_star_graph_has_parts_and_who_produces_them(spark, tmp_path):
    d = tables(
        spark, tmp_path,
        region=([(0, "A"), (1, "B")], "r_regionkey int, r_name string"), nation=([(0, "N", 0), (1, "M", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        supplier=([(1, "S1", 0, 10.0), (2, "S2", 1, 10.0), (3, "S3", 0, 10.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        customer=([(1, "C1", 0, 10.0)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double"),
        part=([(1, "P1", 1.0), (2, "P2", 3.0), (3, "unmade", 2.0)], "p_partkey long, p_name string, p_retailprice double"),
        orders=([(1, 1)], "o_orderkey long, o_custkey long"),
        lineitem=([(1, 1, 1), (1, 1, 1), (1, 2, 2), (1, 3, 1), (9, 2, 1)], "l_orderkey long, l_suppkey long, l_partkey long"),
    )
    made = A.star_relations(spark, d).where("type = 'produces'")
    assert sorted((r["paper_id"], r["id"], r["confidence"], r["evidence"]) for r in made.collect()) == [
        (0, "produces:s1:p1", 0.2, 2), (0, "produces:s3:p1", 0.1, 1), (1, "produces:s2:p1", 0.1, 1), (1, "produces:s2:p2", 0.1, 1)]
    parts = A.star_objects(spark, d).where("kind = 'artifact'")
    got = sorted((r["paper_id"], r["id"], r["label"], r["contribution"], r["prominence"], r["recurrence"]) for r in parts.collect())
    assert got == [(0, "p1", "P1", 0.0, 1.0, 1.0), (1, "p1", "P1", 0.0, 0.0, 0.333333), (1, "p2", "P2", 1.0, 0.0, 0.333333)]


def test_closure_and_rollup_have_no_depth_limit(spark):
    chain = spark.createDataFrame([(1, f"x{i}", f"x{i + 1}") for i in range(53)] + [(1, "x53", "x0")], "paper_id int, source_id string, target_id string").coalesce(1)
    start = spark.createDataFrame([(1, "x0")], "paper_id int, id string")
    assert sorted(r["depth"] for r in G.closure(chain, start).collect()) == list(range(54))
    nodes = [(f"t{i}", f"t{i - 1}" if i else None) for i in range(24)]
    own = spark.createDataFrame([("t23", 5)], "id string, n long")
    tree = spark.createDataFrame(nodes, "id string, parent string").coalesce(1)
    assert {tuple(r) for r in trees.rollup(tree, own).collect()} == {(f"t{i}", 5) for i in range(24)}
    with pytest.raises(ValueError):
        trees.rollup(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), own)
