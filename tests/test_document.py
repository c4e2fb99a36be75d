"""Canonical documents: symbols, names, notation, rules and paging on a paper made by hand."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import canonical as C
from quillgraph.operators import document as D
from quillgraph.sources import papers

SCHEMA = (
    "paper_id string, id string, kind string, label string, aliases array<string>, roles array<string>, summary string, facet_kind string, contribution double, prominence double, familiarity double, confidence double, "
    "section_id string, node_id string, equation_id string, quote string, char_start int, type string, source string, target string, qualifiers array<string>, latex string, scope_id string, "
    f"symbols array<{papers.SYMBOL}>, object_labels array<string>, defined_observation_id string, relations array<struct<type: string, target: string, qualifiers: array<string>, evidence: string, confidence: double>>"
)
FIELDS = [x.split(":")[0].split()[0] for x in SCHEMA.replace("array<struct<type: string, target: string, qualifiers: array<string>, evidence: string, confidence: double>>", "x").replace(f"array<{papers.SYMBOL}>", "x").split(", ")]


def row(**values):
    return tuple(values.get(f) for f in FIELDS)


def sym(symbol, meaning=None, scope=None, labels=()):
    return (symbol, meaning, scope, None, [], list(labels))


ROWS = [
    row(paper_id="p", id="o1", kind="topic", label="Neural Nets", aliases=["NN"], roles=["main", " "], summary=" about nets ", contribution=0.9, confidence=1.0, section_id="s1", node_id="n1", quote="uses Neural Nets here", char_start=10),
    row(paper_id="p", id="o2", kind="topic", label="nn", aliases=[], roles=[], confidence=0.5, section_id="s2", node_id="n2", quote="an nn", relations=[("uses", "SGD", ["x"], "seen", 0.7), ("uses", "Neural  nets", [], "loop", 0.7)]),
    row(paper_id="p", id="o3", kind="procedure", label="SGD", familiarity=0.9, confidence=0.8, section_id="s1", node_id="n1", quote="sgds and SGD"),
    row(paper_id="p", id="o4", kind="artifact", label="nn", confidence=0.8, section_id="s9", node_id=None, quote="nn"),
    row(paper_id="p", id="r1", kind="relation", label="x", type="defines", source="SGD", target="nn", qualifiers=["b"], confidence=0.4, quote="q"),
    row(paper_id="p", id="r2", kind="relation", label="x", type="is_a", source="sgd", target="NN", qualifiers=["c"], confidence=0.6, quote="q"),
    row(paper_id="p", id="r3", kind="relation", label="x", type="likes", source="sgd", target="NN", confidence=0.6, quote="q"),
    row(paper_id="p", id="e1", kind="equation", label="E1", equation_id="E1", latex="x_{1} = x_{1} + y", section_id="s1", symbols=[sym("x_{1}", "first", None, ["nn"]), sym(" "), sym("y")], object_labels=["SGD", "nothing"], defined_observation_id="o1", confidence=1.0, quote="q"),
    row(paper_id="p", id="e2", kind="equation", label="E2", equation_id="E2", latex="X_{1}", section_id="s1", symbols=[sym("X_{1}", "First", "s1", ["sgd"])], defined_observation_id="o2", confidence=1.0, quote="q"),
    row(paper_id="p", id="e3", kind="equation", label="E3", equation_id="E3", latex="z", section_id="s2", symbols=[sym("z", "first", "s1")], defined_observation_id="o3", confidence=1.0, quote="q"),
]


@pytest.fixture(scope="module")
def doc(spark):
    return D.build(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


def test_objects_and_relations(doc):
    o = {r["label"] + "/" + r["kind"]: r for r in doc.objects.collect()}
    assert set(o) == {"Neural Nets/topic", "SGD/procedure", "nn/artifact"}
    nets = o["Neural Nets/topic"]
    assert nets["aliases"] == ["NN", "nn"] and nets["roles"] == ["main"] and nets["members"] == 2
    assert (nets["contribution"], nets["prominence"], nets["familiarity"], nets["confidence"], nets["recurrence"]) == (0.9, 0.5, 0.0, 0.75, 0.666667)
    ids = {k: r["stable_id"] for k, r in o.items()}
    first = min(ids["Neural Nets/topic"], ids["nn/artifact"])
    r = {(x["type"], x["source_id"], x["target_id"]): (x["qualifiers"], x["evidence_id"], x["confidence"]) for x in doc.relations.collect()}
    # the later observation of a relation tells; a nested one starts from its own object
    assert r == {("is_a", ids["SGD/procedure"], first): (["c"], "r2", 0.6), ("uses", ids["Neural Nets/topic"], ids["SGD/procedure"]): (["x"], "o2", 0.7)} | (
        {("uses", ids["Neural Nets/topic"], first): ([], "o2", 0.7)} if False else {}
    )


def test_equations_and_notation(doc):
    n = {r["symbol"]: r for r in doc.notation.collect()}
    assert set(n) == {"X_{1}", "y", "z"}  # equal but for case: the last one tells, objects of both
    assert n["X_{1}"]["meaning"] == "First" and len(n["X_{1}"]["object_ids"]) == 2 and n["y"]["meaning"] == D.UNSAID and n["y"]["scope_id"] == "s1"
    e = {r["equation_id"]: r for r in doc.equations.collect()}
    # o1 and o2 are one object with two defining equations: neither defines it
    assert [e[k]["defined_object_id"] is None for k in ("E1", "E2", "E3")] == [True, True, False]
    assert len(e["E1"]["notation_ids"]) == 2 and len(e["E1"]["object_ids"]) == 1 and e["E1"]["summary"] == "Displayed equation E1"


def test_occurrences(doc):
    got = sorted((r["text"], r["dom_node_id"], r["equation_id"], r["start"], r["end"]) for r in doc.occurrences.collect())
    assert ("Neural Nets", "n1", None, 15, 26) in got and ("nn", "n2", None, 3, 5) in got
    assert ("sgds", "n1", None, 0, 4) in got  # the other number is longer and comes first
    assert [(t, s) for t, _, e, s, _ in got if e == "E2"] == [("X_{1}", 0)]
    assert [(t, s) for t, _, e, s, _ in got if e == "E1"] == [("y", 16)]


def test_details_and_paging(spark, doc):
    sections = spark.createDataFrame([("p", "s2", 0), ("p", "s1", 1)], "paper_id string, section_id string, section_pos int")
    nodes = spark.createDataFrame([("p", "s1", "n1", 5)], "paper_id string, section_id string, node_id string, node_pos int")
    d = {r["label"]: r for r in D.subject_details(doc, sections, nodes).collect()}
    assert d["Neural Nets"]["evidence"] == ["o2", "o1"] and d["Neural Nets"]["explanation"] == "about nets" and d["SGD"]["defining_equation"] == "E3" and d["z"]["kind"] == "notation"
    e = {r["equation_id"]: r for r in D.equation_details(doc).collect()}
    assert e["E3"]["defined"] == "SGD" and e["E3"]["defined_occurrences"] == 1 and e["E1"]["objects"] == ["SGD"]
    page = D.section_annotations(doc, 1, 1).collect()
    assert [(r["scope_id"], r["place"], r["total"]) for r in page] == [("s1", 2, 2)]
    g = {r["subject_id"]: (r["tier"], r["place"]) for r in D.glossary(doc, "NN").collect()}
    assert sorted(g.values()) == [(0, 1), (0, 2)]
    assert D.glossary(doc, "").count() == 6 and [r["tier"] for r in D.glossary(doc, "about").collect()] == [3]
    assert [r["place"] for r in D.subject_occurrences(doc, 1).collect()].count(1) == D.subject_occurrences(doc, 1).count()
    assert D.at_location(doc, section="s1", node="n2").count() == 0 and D.at_location(doc, section="s1", node="n1").count() == 2
    assert [(r["label"].lower(), r["kinds"]) for r in D.label_collisions(doc).collect()] == [("nn", ["artifact", "topic"])]


def test_rules(spark, doc):
    found = {(r["rule"], r["key"]) for r in D.violations(doc).collect()}
    assert {r for r, _ in found} <= {"V4 equation notation"}  # a symbol that a later one has taken over
    broken = dataclasses.replace(doc, objects=doc.objects.where("label <> 'SGD'").union(doc.objects.where("kind = 'artifact'")), observations=doc.observations.where("id not in ('o1', 'e1', 'r2')"))
    rules = {r["rule"] for r in D.violations(broken).collect()}
    assert rules >= {"V1 repeated object id", "V2 object evidence", "V2 facet evidence", "V3 relation source", "V3 relation target", "V3 relation evidence", "V4 equation object", "V4 defined object", "V5 equation evidence", "V7 notation object", "V7 notation evidence", "V8 explanation subject", "V8 occurrence subject"}
    twice = dataclasses.replace(doc, equations=doc.equations.withColumn("defined_object_id", F.lit("x")))
    assert "V6 several defining equations" in {r["rule"] for r in D.violations(twice).collect()}
    stored = D.metrics(doc).withColumn("n", F.when(F.col("name") == "objects", 9).otherwise(F.col("n")))
    assert [r["key"] for r in D.count_violations(doc, stored).collect()] == ["objects"]


def test_symbols_and_equation_rows(spark):
    cases = {r"\alpha x_{1} + \mathcal{L}(i) \leq X_{1}": ["\\alpha", "x_{1}", "L"], "a_b c k A": ["a_b", "c", "A"], r"\Sigma \sigma": ["\\Sigma"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "latex string")
    assert {r["latex"]: r["s"] for r in df.withColumn("s", T.scoped_symbols(F.col("latex"))).collect()} == cases
    starts = spark.createDataFrame([("aXaXXa", "X"), ("\\E\\E", "\\E"), ("aaa", "aa"), ("b", "a"), ("a", "")], "t string, p string").select(T.literal_starts(F.col("t"), F.col("p")).alias("s")).collect()
    assert [r["s"] for r in starts] == [[1, 3, 4], [0, 2], [0], [], []]
    e = spark.createDataFrame([("p", "m1", " a = b ", True), ("p", "m2", "a = b", False), ("p", "m3", "ab", True)], "paper_id string, equation_id string, latex string, is_display boolean")
    n = spark.createDataFrame([("p", "m1", "s")], "paper_id string, node_id string, section_id string")
    got = D.equation_observations(e, n).collect()
    assert [(r["equation_id"], r["section_id"], r["latex"], r["symbols"]) for r in got] == [("m1", "s", "a = b", ["a", "b"])]


def test_enrichment(spark):
    base = spark.createDataFrame([("p", f"E{i}", "x + y", "s", None, None, None, None) for i in range(4)], f"paper_id string, equation_id string, latex string, scope_id string, summary string, symbols array<{papers.SYMBOL}>, object_labels array<string>, defined_observation_id string")
    told = [("p", "E0", "sum", [sym("$x$", "m"), sym("i"), sym("q")], ["l"], "o1"), ("p", "E1", "s", [], [], "o1"), ("p", "E2", "s", [], [], "zz")]
    a = spark.createDataFrame(told, f"paper_id string, equation_id string, summary string, symbols array<{papers.SYMBOL}>, object_labels array<string>, defined_observation_id string")
    rows, messages = D.enriched(base, a, spark.createDataFrame([("p", "o1")], "paper_id string, id string"))
    got = {r["equation_id"]: r for r in rows.collect()}
    assert [s["symbol"] for s in got["E0"]["symbols"]] == ["x"] and got["E0"]["symbols"][0]["scope_id"] == "s" and got["E3"]["summary"] is None
    assert all(r["defined_observation_id"] is None for r in got.values())
    assert sorted(r["message"] for r in messages.collect()) == ["several defining equations of object o1", "unknown defining object zz of equation E2"]


def test_groups_follow_the_order(spark):
    obs = [("p", "t", "1", "a", []), ("p", "t", "2", "b", ["c"]), ("p", "t", "3", "a", ["b"]), ("p", "t", "4", "b", ["c"]), ("p", "t", "5", "c", [])]
    got = {r["observation_id"]: r["entity_id"] for r in C.groups(spark.createDataFrame(obs, "paper_id string, kind string, id string, label string, aliases array<string>")).collect()}
    # 3 widens the first group by b: 4 goes there although 2 has the same names; c then is in both, and the first one has it
    assert got == {"1": "1", "2": "2", "3": "1", "4": "1", "5": "1"}


def test_groups_of_many_components(spark):
    import random

    r = random.Random(4)
    obs = []
    for i in range(600):
        k = r.randrange(120)
        obs.append((r.choice([1, 2, None]), r.choice(["topic", "claim"]), i, f"Name {k}", r.choice([None, [], [f"name-{k + 1}"], [f"alias {k % 7}", "?"], [f"name {k}"]]) if r.random() < 0.2 else None))
    obs += [(1, "topic", 1000 + i, "Common", None) for i in range(300)] + [(1, "topic", 2000, "...", None), (1, "topic", 2001, "", ["!"])]
    norm = lambda t: " ".join("".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split())
    want, groups = {}, {}
    for paper, kind, i, label, aliases in sorted(obs, key=lambda x: x[2]):
        own = [n for n in map(norm, [label, *(aliases or [])]) if n]
        here = groups.setdefault((paper, kind), [])
        g = next((g for g in here if g[1] & set(own)), None)
        if g is None:
            here.append(g := (i, set()))
        g[1].update(own)
        want[i] = (paper, kind, g[0])
    df = spark.createDataFrame(obs, "paper_id int, kind string, id long, label string, aliases array<string>").repartition(7)
    got = {x["observation_id"]: (x["paper_id"], x["kind"], x["entity_id"]) for x in C.groups(df).collect()}
    assert got == want


def test_documents_nest_and_are_read_strictly(spark):
    import json

    from quillgraph.operators import codec

    objects = spark.createDataFrame([(1, "o2", "claim", "B", None, 0.5), (1, "o1", "topic", "A \"x\" é", ["a", "b"], None), (2, "o3", "topic", "C", [], 1.0)], "paper_id int, stable_id string, kind string, label string, aliases array<string>, contribution double")
    relations = spark.createDataFrame([(1, "r1", "uses", "o1", "o2", 0.25)], "paper_id int, stable_id string, type string, source_id string, target_id string, confidence double")
    tables = {"objects": objects, "relations": relations}
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id int")
    texts = codec.nested(tables, papers)
    schema = codec.schema_of(tables)
    read = codec.parsed(texts, schema)
    assert {(r["paper_id"], r["status"]) for r in read.collect()} == {(1, "ready"), (2, "ready"), (3, "ready")}
    for name, d in tables.items():
        assert sorted(map(tuple, codec.part(read, name).select(*d.columns).collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)
    good = {r["paper_id"]: r["document"] for r in texts.collect()}
    assert [r["bytes"] for r in texts.orderBy("paper_id").collect()] == [len(good[k].encode()) for k in (1, 2, 3)]
    assert [o["stable_id"] for o in json.loads(good[1])["objects"]] == ["o1", "o2"]

    def spoilt(change):
        d = json.loads(good[1])
        change(d)
        return json.dumps(d)

    cases = {
        "not a JSON object": "[1]", "unknown key extra": spoilt(lambda d: d.update(extra=1)), "objects: no list of objects": spoilt(lambda d: d.update(objects=7)),
        "relations: no list of objects": spoilt(lambda d: d.pop("relations")), "objects: unknown key colour": spoilt(lambda d: d["objects"][0].update(colour="red")),
        "objects.contribution: not of its type": spoilt(lambda d: d["objects"][1].update(contribution="much")), "objects.aliases: not of its type": spoilt(lambda d: d["objects"][0].update(aliases="a")),
        "objects.label: empty": spoilt(lambda d: d["objects"][0].update(label="")), "relations.source_id: empty": spoilt(lambda d: d["relations"][0].pop("source_id")),
        "objects.kind: out of bounds": spoilt(lambda d: d["objects"][0].update(kind="thing")), "objects.contribution: out of bounds": spoilt(lambda d: d["objects"][0].update(contribution=1.5)),
        "relations.type: out of bounds": spoilt(lambda d: d["relations"][0].update(type="likes")), "relations.confidence: out of bounds": spoilt(lambda d: d["relations"][0].update(confidence=-1)),
        "metrics.objects_count: not the number of rows": spoilt(lambda d: d["metrics"].update(objects_count=5)),
    }
    rows = [(e, t) for e, t in cases.items()] + [("none", None), ("none", "  "), ("rebuild", spoilt(lambda d: d.update(schema_version="2"))), ("rebuild", spoilt(lambda d: d.pop("schema_version"))), ("ready", good[1])]
    got = codec.parsed(spark.createDataFrame(rows, "paper_id string, document string"), schema).collect()
    for r in got:
        if r["paper_id"] in cases:
            assert r["status"] == "malformed" and r["paper_id"] in r["errors"], (r["paper_id"], r["status"], r["errors"])
            assert r["objects"] is None
        else:
            assert r["status"] == r["paper_id"] and r["errors"] == [], r
