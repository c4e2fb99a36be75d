"""Merging of local observations, held against comparing every pair of a paper's rows."""

import itertools
import random
import re

import pytest

from quillgraph.functions.text import GENERIC_WORDS
from quillgraph.operators import merge as M

DEFINITIONS = "paper_id {p}, pos long, term string, definition_text string, summary string, is_formal boolean, definition_number string, section_id string"
FORMULAS = "paper_id {p}, pos long, label string, latex string, summary string, section_id string, section_title string, symbols array<struct<symbol: string, latex: string, context: string, role: string>>"
SYMBOLS = "paper_id {p}, pos long, symbol string, latex string, context string, is_definition boolean, section_id string, section_title string"
OBSERVED = "paper_id {p}, pos long, symbol string, latex string, latex_key string, context string, scope_level string, section_id string, section_title string, role string, siblings array<string>, parent string, concept string, is_definition boolean, symbol_key string"

words = lambda t: set(re.findall("[a-z0-9_]+", (t or "").lower()))
telling = lambda t: words(t) - set(GENERIC_WORDS)
text = lambda t: " ".join((t or "").lower().split())
math = lambda t: re.sub(r"[{}\s]", "", re.sub(r"\\left|\\right", "", (t or "").strip("$ "))).lower()


def signatures(t):
    found = [x for p in (r"\$(.+?)\$", r"\\\((.+?)\\\)", r"\\\[(.+?)\\\]") for x in re.findall(p, t or "", re.S)]
    return [x for x in dict.fromkeys(map(math, found)) if x]


def components(items, alike):
    """The least item of each one's component."""
    first = {i: i for i in items}
    moved = True
    while moved:
        moved = False
        for a, b in itertools.combinations(items, 2):
            if first[a] != first[b] and alike(a, b):
                low = min(first[a], first[b])
                first[a] = first[b] = low
                moved = True
    return first


def same_symbol(x, y):
    if x["symbol_key"] == y["symbol_key"]:
        return True
    if not x["latex_key"] or x["latex_key"] != y["latex_key"]:
        return False
    context = telling(x["context"]) & telling(y["context"])
    title = telling(x["section_title"]) & telling(y["section_title"])
    role = x["role"] and x["role"] == y["role"]
    siblings = set(x["siblings"]) & set(y["siblings"])
    scope = x["scope_level"] == y["scope_level"]
    return bool(
        text(x["context"]) == text(y["context"]) or len(words(x["context"]) & words(y["context"])) >= 2 or (x["concept"] and x["concept"] == y["concept"] and (role or siblings or context))
        or (x["parent"] and x["parent"] == y["parent"]) or (scope and x["scope_level"] == "formula_scoped" and role and siblings) or (scope and role and title) or (title and context) or (x["section_id"] == y["section_id"] and context)
    )


@pytest.mark.parametrize("seed", range(3))
def test_symbol_classes_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    pick = lambda xs: r.choice([*xs, None])
    say = lambda n: " ".join(r.choice(["the", "loss", "alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) for _ in range(r.randrange(n)))
    rows = []
    for i in range(150):
        context, glyph = r.choice([say(4), None, "Alpha  beta"]), r.choice(["x", "y", "z", "t", ""])
        rows.append((1, i, glyph, None, glyph, context, r.choice(["paper_level", "formula_scoped", None]), f"s{r.randrange(25)}", pick([say(3), "on alpha"]), pick(["input", "state"]), r.sample(["a", "b", "c"], r.randrange(3)) if r.random() < 0.3 else [], f"f{r.randrange(40)}" if r.random() < 0.3 else None, f"c{r.randrange(10)}" if r.random() < 0.4 else None, False, f"{glyph}|{text(context)}"))
    # one group of copies that holds a third of all
    rows += [(1, 200 + i, "x", None, "x", "Alpha  beta", "paper_level", "s1", None, None, [], None, None, False, "x|alpha beta") for i in range(75)]
    df = spark.createDataFrame(rows, OBSERVED.format(p="int"))
    names = [f.name for f in df.schema]
    by = {x[1]: dict(zip(names, x)) for x in rows}
    want = components(sorted(by), lambda a, b: same_symbol(by[a], by[b]))
    got = {x["pos"]: x["first"] for x in M.symbol_classes(df.repartition(5)).collect()}
    assert got == want and len(set(want.values())) > 5


def some_definitions(r, n):
    say = lambda k: " ".join(r.choice(["the", "of", "loss", "reward", "policy", "state", "value", "gain", "rate"]) for _ in range(r.randrange(k)))
    return [(1, i, r.choice(["Reward", "reward ", "policy gain", "", None, "rate"]), r.choice([f"{say(6)} $x_{{{i % 4}}}$", say(8), None, "\\(y\\) and \\[ Z \\]"]), r.choice([say(7), "", None]), i % 2 == 0, r.choice([None, "", str(i)]), f"s{i % 6}") for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_definition_classes_are_those_of_all_pairs(spark, seed):
    rows = some_definitions(random.Random(seed), 60) + [(1, 100 + i, "rate", "a b c d", None, False, None, "s") for i in range(30)]
    by = {x[1]: x for x in rows}

    def alike(a, b):
        x, y = by[a], by[b]
        said = lambda z: words(z[4] or z[3])
        return bool(text(x[2])) and text(x[2]) == text(y[2]) and bool(set(signatures(x[3])) & set(signatures(y[3])) or len(said(x) & said(y)) >= 3)

    df = spark.createDataFrame(rows, DEFINITIONS.format(p="int"))
    found = M.definition_classes(df)
    assert {x["pos"]: x["first"] for x in found.collect()} == components(sorted(by), alike)
    m = {x["pos"]: x for x in M.merged_definitions(df, found).collect()}
    want = components(sorted(by), alike)
    for first in set(want.values()):
        own = [by[p] for p in sorted(by) if want[p] == first]
        assert m[first]["term"] == own[0][2] and m[first]["is_formal"] == any(x[5] for x in own)
        assert m[first]["summary"] == max(own, key=lambda x: (len(x[4] or ""), -x[1]))[4]
        assert m[first]["definition_number"] == next((x[6] for x in own if x[6]), None)
        assert m[first]["signatures"] == list(dict.fromkeys(s for x in own for s in signatures(x[3])))


def fit(d, f):
    said = d["summary"] or d["definition_text"]
    n = 0
    if f["label"]:
        n += 4 if text(d["term"]) == text(f["label"]) else 2 if telling(d["term"]) & telling(f["label"]) else 0
    n += 3 if math(f["latex"]) and math(f["latex"]) in d["signatures"] else 0
    return n + (2 if len(words(said) & words(f["summary"])) >= 2 else 1 if telling(said) & telling(f["summary"]) else 0)


@pytest.mark.parametrize("seed", range(3))
def test_attachment_and_offers_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(["the", "of", "loss", "reward", "policy", "state", "value", "gain", "rate"]) for _ in range(r.randrange(k)))
    defs = spark.createDataFrame(some_definitions(r, 40), DEFINITIONS.format(p="string"))
    rows = [("1", i, r.choice(["reward", "POLICY", None, "", "rate of gain", "loss", "other"]), r.choice([f"x_{{{i % 6}}}", "y", None, "q"]), r.choice([say(6), None]), f"s{i % 6}", "t", []) for i in range(60)]
    raw = spark.createDataFrame(rows, FORMULAS.format(p="string"))
    local = M.attached_locally(raw, defs)
    by_section = {}
    for d in defs.orderBy("pos").collect():
        by_section.setdefault(d["section_id"], []).append(d)
    for x in local.collect():
        f = rows[x["pos"]]
        hits = [d["pos"] for d in by_section[f[5]] if (text(f[2]) and text(f[2]) == text(d["term"])) or (math(f[3]) and math(f[3]) in signatures(d["definition_text"]))]
        assert x["definition"] == min(hits, default=None)
    formulas, _ = M.merged_formulas(raw, local, defs)
    merged = M.merged_definitions(defs, M.definition_classes(defs))
    fs, ds = formulas.orderBy("pos").collect(), merged.orderBy("pos").collect()
    assert len(fs) == len({text(x[2]) or math(x[3]) or text(x[4]) for x in rows} - {""})
    done = M.attached(formulas, merged)
    got = {x["pos"]: (x["definition"], x["reason"]) for x in done.collect()}
    want, open_ = {}, []
    for f in fs:
        if f["attached_term"]:
            want[f["pos"]] = (next(d["pos"] for d in ds if text(d["term"]) == text(f["attached_term"])), "same_section_label_or_math_match")
            continue
        tests = [("exact_term_match", lambda d: text(f["label"]) and text(f["label"]) == text(d["term"])), ("shared_math_signature", lambda d: math(f["latex"]) and math(f["latex"]) in d["signatures"]), ("multi_signal_match", lambda d: fit(d, f) >= 4)]
        hit = next(((d["pos"], reason) for reason, ok in tests for d in ds if ok(d)), None)
        if hit:
            want[f["pos"]] = hit
        else:
            open_.append(f)
    assert got == want
    offers = {}
    for x in M.definition_buckets(formulas, merged, done).orderBy("pos", "place").collect():
        offers.setdefault(x["pos"], []).append((x["definition"], x["score"]))
    expected = {}
    for f in open_:
        scored = sorted(((fit(d, f), -d["pos"]) for d in ds), reverse=True)
        kept = [(-p, s) for s, p in scored if s >= max(2, scored[0][0] - 1)][:4]
        if kept:
            expected[f["pos"]] = kept
    assert offers == expected


def test_local_symbols_take_a_lone_partners_key(spark):
    sym = lambda s, c, role=None: (s, None, c, role)
    formulas = spark.createDataFrame([(1, 0, "L", "L=x", "s", "a", "Loss", [sym("x", "in", "the  input"), sym("y", "out"), sym("x", "again")]), (1, 1, "M", "y", "s", None, None, [sym("y", "other", "")])], FORMULAS.format(p="int"))
    strays = spark.createDataFrame([(1, 0, "x", None, "Stray X", True, "a", None), (1, 1, "y", None, "one", False, "a", None), (1, 2, "y", "$y$", "two", False, "a", None), (1, 3, "y", None, "three", False, None, None), (1, 4, "", "", "", False, "a", None)], SYMBOLS.format(p="int"))
    parents = spark.createDataFrame([(1, 0, "f0"), (1, 1, "f1")], "paper_id int, pos long, formula_id string")
    rows = M.symbol_observations(strays, formulas, parents).orderBy("pos").collect()
    got = [(x["symbol"], x["symbol_key"], x["role"], x["siblings"], x["parent"]) for x in rows]
    assert got == [
        ("x", "x|stray x", None, [], None), ("y", "y|one", None, [], None), ("y", "y|two", None, [], None), ("y", "y|three", None, [], None),
        ("x", "x|stray x", "input", ["y"], "f0"), ("y", "y|out", None, ["x", "x"], "f0"), ("x", "x|stray x", None, ["y"], "f0"), ("y", "y|three", None, [], "f1"),
    ]


MERGED = "paper_id int, id string, pos long, symbol string, latex string, latex_key string, section_id string, scope_level string, role string, context string, is_definition boolean, section_title string, concept string, siblings array<string>, parents array<string>"


def test_clusters_become_their_longest_symbol(spark):
    row = lambda i, context, siblings, parents, **k: (1, f"s{i}", i, "x", None, "x", f"sec{i}", "paper_level", k.get("role"), context, k.get("is_definition", False), k.get("title"), k.get("concept"), siblings, parents)
    s = spark.createDataFrame([row(0, "ab", ["p", "q"], ["f1"], title="t0", role="r0"), row(1, "abc", ["q", "r"], [], is_definition=True, concept="c1"), row(2, "abc", ["z", "p", "p"], ["f2", "f1"], concept=""), row(3, None, [], []), row(4, "", [], [], concept="c4")], MERGED)
    clusters = spark.createDataFrame([(1, "s0", 1), (1, "s1", 1), (1, "s2", 1), (1, "s2", 1), (1, "nowhere", 1), (1, "s3", 2), (1, "s4", 3), (1, "s3", 3), (2, "s0", 9)], "paper_id int, id string, cluster int")
    got = {x["id"]: x for x in M.merged_clusters(s, clusters).collect()}
    assert set(got) == {"s2", "s3", "s4"}
    m = got["s2"]
    assert (m["context"], m["is_definition"], m["section_title"], m["concept"], m["role"], m["section_id"]) == ("abc", True, "t0", "c1", None, "sec2")
    assert m["siblings"] == ["z", "p", "q", "r"] and m["parents"] == ["f2", "f1"] and got["s3"]["siblings"] == []
    empty = clusters.limit(0)
    assert M.merged_clusters(s, empty).count() == 5 and M.merged_clusters(s.limit(0), clusters).count() == 0
    assert {x["id"] for x in M.symbol_buckets(s.where("pos < 3")).collect()} == {"s0", "s1", "s2"} and M.symbol_buckets(s).count() == 0


def test_scopes_reach_along_chains_and_cycles(spark):
    values = spark.createDataFrame([(1, "a", "A"), (1, "b", ""), (1, "z", None), (2, "x", "X")], "paper_id int, id string, value string")
    edges = [("a", "b", 5), ("b", "c", 0), ("c", "d", 0), ("d", "b", 0), ("d", "a", 0), ("z", "y", 0), ("y", "c", -1), ("c", "c", 0), ("a", "b", 6)]
    e = spark.createDataFrame([(1, *x) for x in edges] + [(2, "x", "w", 1), (2, "q", "w", 0)], "paper_id int, source_id string, target_id string, pos int")
    got = {(x["paper_id"], x["id"]): (x["value"], x["depth"]) for x in M.propagated(values, e).collect()}
    assert got == {(1, "a"): ("A", 0), (1, "b"): ("A", 1), (1, "c"): ("A", 2), (1, "d"): ("A", 3), (2, "x"): ("X", 0), (2, "w"): ("X", 1)}


def test_names_lead_to_the_first_kind(spark):
    f = spark.createDataFrame([("p", 0, "Loss", "L", ["Loss", "Cost"], "formula_loss", "Loss", None), ("p", 1, None, "x", [], "formula_x", None, None)], "paper_id string, pos long, label string, latex string, aliases array<string>, formula_id string, attached_term string, reason string")
    s = spark.createDataFrame([("p", 0, "symbol_x", "x", None, ["formula_loss", "formula_x", "gone"]), ("p", 1, "symbol_y", "y", "loss", ["formula_loss"])], "paper_id string, pos long, id string, symbol string, latex string, parents array<string>")
    d = spark.createDataFrame([("p", 0, "LOSS"), ("p", 1, "loss"), ("p", 2, "Other Thing")], "paper_id string, pos long, term string")
    t = spark.createDataFrame([("p", 0, "theorem", "1"), ("p", 1, "lemma", "A"), ("p", 2, "theorem", "1")], "paper_id string, pos long, type string, number string")
    nodes = M.graph_nodes(f, s, d, t)
    assert {(x["id"], x["type"], x["label"]) for x in nodes.collect()} == {("formula_loss", "formula", "Loss"), ("formula_x", "formula", "x"), ("symbol_x", "symbol", "x"), ("symbol_y", "symbol", "y"), ("def_loss", "definition", "LOSS"), ("def_other_thing", "definition", "Other Thing"), ("thm_1", "theorem", "Theorem 1"), ("thm_A", "theorem", "Lemma A")}
    index = M.name_index(f, s, d, t)
    asked = ["COST", "x", "Y", "other thing", "Lemma a", "A", "a", "Theorem 1", "No \\Such {name}", "loss"]
    got = {x["name"]: x["id"] for x in M.resolved(spark.createDataFrame([("p", a) for a in asked], "paper_id string, name string"), index).collect()}
    assert got == {"COST": "formula_loss", "x": "formula_x", "Y": "symbol_y", "other thing": "def_other_thing", "Lemma a": "thm_A", "A": "thm_A", "a": "a", "Theorem 1": "thm_1", "No \\Such {name}": "no_such_name", "loss": "formula_loss"}
    rel = [("A", "y", "uses", "e1"), ("lemma a", "Y", "uses", "e2"), ("cost", "loss", "uses", "self"), ("nobody", "y", "uses", "unknown"), ("1", "A", "uses", "e3")]
    r = spark.createDataFrame([("p", i, *x) for i, x in enumerate(rel)], "paper_id string, pos long, from_entity string, to_entity string, type string, evidence string")
    edges = {(x["source"], x["target"], x["type"]): x["evidence"] for x in M.graph_edges(nodes, index, f, s, d, r).collect()}
    assert edges == {
        ("def_loss", "formula_loss", "defines"): "Definition linked to its formula representation", ("formula_loss", "symbol_x", "has_symbol"): "Symbol extracted as part of formula context", ("formula_x", "symbol_x", "has_symbol"): "Symbol extracted as part of formula context",
        ("formula_loss", "symbol_y", "has_symbol"): "Symbol extracted as part of formula context", ("thm_A", "symbol_y", "uses"): "e1", ("thm_1", "thm_A", "uses"): "e3",
    }
    assert tuple(M.entity_counts(nodes).first()) == ("p", 8, 2, 2, 2, 2)
