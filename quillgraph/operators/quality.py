"""Measures of graphs and of anchoring, paper by paper and over a corpus, and the gates that they must pass."""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from . import graph as G

# Most isolates and least share of the largest component of an overview, least share of classified objects.
MAX_ISOLATES, MIN_LARGEST, MIN_CLASSIFIED = 0.1, 0.7, 0.9
#: A word, or one other character.
UNITS = re.compile(r"\w+|\W")


def rate(n, d):
    return F.round(T.safe_rate(n.cast("double"), d), 6)


def connectivity(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(paper_id, nodes, edges, isolates, components, largest, mean_degree, density, ordinary, ordinary_mean, hubs, hub_mean, isolate_rate,
    largest_rate): degrees by distinct neighbours; nodes with more than two are hubs. Loops and unknown ends don't count."""
    nodes = G.numbered(objects.select("paper_id", "id").distinct())
    return connectivity_of(nodes, G.linked(nodes, relations))


def connectivity_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``connectivity`` of nodes(paper_id, id) and links as ``graph.linked``. Nodes without links are those that the links' ends leave over."""
    ends = G.link_ends(links)
    hub, k = F.col("k") > 2, F.col("k")
    n = nodes.where("paper_id is not null").groupBy("paper_id").agg(F.count(F.lit(1)).alias("nodes"))
    d = ends.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("linked"), F.sum("k").alias("ends"), F.sum(F.when(~hub, 1).otherwise(0)).alias("few"), F.sum(F.when(~hub, k).otherwise(0)).alias("o"),
        F.sum(F.when(hub, 1).otherwise(0)).alias("hubs"), F.sum(F.when(hub, k).otherwise(0)).alias("h"), F.min("k").alias("least"), F.max("k").alias("most_degree"),
    )
    c = G.roots(links, ends).groupBy("paper_id", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("paper_id").agg(F.count(F.lit(1)).alias("trees"), F.max("size").alias("size"))
    e = links.groupBy("paper_id").agg(F.sum("times").alias("edges"))
    col = F.col
    j = n.join(d, "paper_id", "left").join(c, "paper_id", "left").join(e, "paper_id", "left").na.fill(0).withColumn("isolates", col("nodes") - col("linked"))
    alone = col("isolates") > 0
    j = j.withColumn("components", col("trees") + col("isolates")).withColumn("largest", F.greatest("size", alone.cast("long"))).withColumn("ordinary", col("few") + col("isolates"))
    return j.select(
        "paper_id", "nodes", "edges", "isolates", "components", "largest", rate(col("ends"), col("nodes")).alias("mean_degree"), F.round(T.safe_rate(col("ends") / 2, F.floor(col("nodes") * (col("nodes") - 1) / 2)), 9).alias("density"),
        F.when(alone, 0).otherwise(col("least")).alias("least_degree"), "most_degree", "ordinary", rate(col("o"), col("ordinary")).alias("ordinary_mean"), "hubs", rate(col("h"), col("hubs")).alias("hub_mean"), rate(col("isolates"), col("nodes")).alias("isolate_rate"), rate(col("largest"), col("nodes")).alias("largest_rate"),
    )


def flat_quality(nodes: DataFrame, edges: DataFrame, duplicates: DataFrame, unsupported: DataFrame, required: DataFrame, rebuilt: DataFrame | None = None) -> DataFrame:
    """One row for a flat graph and what people said about it: nodes(id), edges(id, evidence), duplicates(group, id), unsupported(id),
    required(id) edges, and the nodes of another build. Rates are 0 where there is nothing; stable is null without a rebuild."""
    one = lambda d, *a: d.agg(*a)
    n = one(nodes.select("id").distinct(), F.count(F.lit(1)).alias("nodes"))
    e = one(edges, F.count(F.lit(1)).alias("edges"))
    d = one(duplicates.groupBy("group").agg((F.countDistinct("id") - 1).alias("k")), F.coalesce(F.sum("k"), F.lit(0)).alias("duplicates"))
    u = one(unsupported.select("id").distinct(), F.count(F.lit(1)).alias("unsupported"))
    r = one(edges.join(required.select("id").distinct(), "id", "left_semi"), F.count(F.lit(1)).alias("required"), F.coalesce(F.sum((F.trim(F.coalesce("evidence", F.lit(""))) == "").cast("long")), F.lit(0)).alias("bare"))
    same = nodes.select("id").distinct().join(rebuilt.select("id"), "id", "left_semi") if rebuilt is not None else None
    s = one(same, F.count(F.lit(1)).alias("stable")) if rebuilt is not None else n.select(F.lit(None).cast("long").alias("stable"))
    row = n
    for part in (e, d, u, r, s):
        row = row.join(F.broadcast(part))  # one row each
    c = F.col
    return row.select(
        "nodes", "edges", "duplicates", rate(c("duplicates"), c("nodes")).alias("duplicate_rate"), "unsupported", rate(c("unsupported"), c("nodes")).alias("unsupported_rate"),
        "required", "bare", rate(c("required") - c("bare"), c("required")).alias("evidence_rate"), F.when(c("stable").isNotNull(), rate(c("stable"), c("nodes"))).alias("stable_rate"),
    )


def paper_quality(objects: DataFrame, relations: DataFrame, kinds: list[str], types: list[str], limit: int = 20, name=F.col) -> DataFrame:
    """(paper_id, and of the whole graph and of its overview nodes, edges, isolate and largest rates, what the overview keeps, the share of
    objects of known kinds, relations of unknown types, and whether the gates are passed). Equal objects are ordered by ``name`` of their id."""
    ranked = G.placed(G.ranked(objects, relations, d=written(G.degree(relations), "degrees")), name)
    links = G.linked(ranked, relations)
    nodes = written(G.chosen(ranked, links, limit).select("paper_id", "id"), "overview")
    spanning = written(G.backbone(objects, relations, nodes).select("paper_id", "id"), "backbone")
    kept = relations.join(spanning, ["paper_id", "id"], "left_semi")
    cols = ["nodes", "edges", "isolates", "largest", "isolate_rate", "largest_rate"]
    full = connectivity_of(ranked.select("paper_id", "id").distinct(), links).select("paper_id", *cols)
    view = connectivity(nodes, kept).select("paper_id", *[F.col(c).alias(f"view_{c}") for c in cols])
    known = objects.groupBy("paper_id").agg(F.sum(F.col("kind").isin(kinds).cast("long")).alias("classified"), F.count(F.lit(1)).alias("objects"))
    odd = relations.where(~F.col("type").isin(types)).groupBy("paper_id").agg(F.countDistinct("type").alias("unknown_types"))
    j = full.join(view, "paper_id").join(known, "paper_id").join(odd, "paper_id", "left").na.fill(0, ["unknown_types"])
    c = F.col
    j = j.withColumn("node_retention", rate(c("view_nodes"), c("nodes"))).withColumn("edge_retention", rate(c("view_edges"), c("edges"))).withColumn("classified_rate", rate(c("classified"), c("objects")))
    gate = (c("view_isolate_rate") <= MAX_ISOLATES) & (c("view_largest_rate") >= MIN_LARGEST)
    return j.withColumn("connected", gate).withColumn("classified_enough", c("classified_rate") >= MIN_CLASSIFIED)


def corpus_quality(papers: DataFrame) -> DataFrame:
    """One row over the papers' quality: rates are of sums, never means of rates."""
    s = lambda x: F.sum(x)
    return papers.agg(
        F.count(F.lit(1)).alias("papers"), s("view_nodes").alias("view_nodes"), s("view_edges").alias("view_edges"), rate(s("view_isolates"), s("view_nodes")).alias("isolate_rate"), rate(s("view_largest"), s("view_nodes")).alias("largest_rate"),
        rate(s(F.col("connected").cast("int")), F.count(F.lit(1))).alias("connected_rate"), rate(s("classified"), s("objects")).alias("classified_rate"), s("unknown_types").alias("unknown_types"),
    )


def surface_forms(objects: DataFrame) -> DataFrame:
    """(paper_id, form, subject_id, surface, category): what objects(paper_id, stable_id, kind, label, aliases) other than claims may be
    called: exact, by other number (inflection) or by hyphens and spaces (orthographic)."""
    said = objects.where("kind <> 'claim'").select("paper_id", F.col("stable_id").alias("subject_id"), F.explode(F.concat(F.array("label"), "aliases")).alias("surface"))
    said = said.withColumn("surface", F.trim("surface")).where(F.length("surface") >= 2).withColumn("form", F.lower("surface"))
    exact = said.groupBy("paper_id", "form", "subject_id").agg(F.min("surface").alias("surface")).withColumn("category", F.lit("exact"))
    other = said.select("paper_id", "subject_id", T.plural_variant(F.col("surface")).alias("surface"), F.lit("inflection").alias("category")).where("surface is not null")
    hyphens = F.filter(F.array(F.when(F.col("surface").rlike(r"\s"), F.regexp_replace("surface", r"\s+", "-")), F.when(F.contains("surface", F.lit("-")), F.regexp_replace("surface", "-+", " "))), lambda x: x.isNotNull())
    other = other.union(said.select("paper_id", "subject_id", F.explode(hyphens), F.lit("orthographic"))).withColumn("form", F.lower("surface"))
    other = other.groupBy("paper_id", "form", "subject_id").agg(F.min("surface").alias("surface"), F.min("category").alias("category"))
    other = other.join(exact.select("paper_id", "form", "subject_id"), ["paper_id", "form", "subject_id"], "left_anti")
    return exact.unionByName(other).select("paper_id", "form", "subject_id", "surface", "category")


def _fold(c: str) -> str:
    """The letter that stands for all that equal it without regard to case, as patterns take it."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


#: What to put for which character, so that texts are equal where a pattern without regard to case would match; one character for one.
FOLD = {i: f for i in range(0x20000) if (f := _fold(chr(i))) != chr(i)} | {0x130: "i", 0x1FD3: "\u0390", 0x1FE3: "\u03b0", 0xFB05: "\ufb06"}


def places_of_forms(text: str, forms: list[tuple[str, bool, str | None]]) -> list[tuple[int, int, str, bool, str | None]]:
    """(start, end, form, exact, owner) of forms(form, exact, owner) in a text: exact ones that don't overlap, the earliest and longest
    first, then of the others those beside them. Forms are a tree by words and single other characters; one walk from each
    finds all forms that begin there."""
    tree: dict = {}
    for form in forms:
        at = tree
        for u in UNITS.findall(form[0]):
            at = at.setdefault(u.translate(FOLD), {})
        at.setdefault(None, []).append(form)
    units = [(m.start(), m.end(), m[0].translate(FOLD)) for m in UNITS.finditer(text)]
    word = [text[a].isalnum() or text[a] == "_" for a, _, _ in units]
    ends: dict[str, int] = {}
    places = []
    for i, (start, _, u) in enumerate(units):
        # what begins with a mark must not stand behind a word, what ends with one not before a word
        if u not in tree or (not word[i] and i and word[i - 1]):
            continue
        at = tree
        for k in range(i, len(units)):
            at = at.get(units[k][2])
            if at is None:
                break
            if None in at and (word[k] or k + 1 == len(units) or not word[k + 1]):
                end = units[k][1]
                for x, exact, owner in at[None]:
                    # places of one form never overlap
                    if start >= ends.get(x, 0):
                        ends[x] = end
                        places.append((not exact, start, start - end, owner or x, x, owner))
    found, others, done = [], [], 0
    for rest, start, length, _, x, owner in sorted(places, key=lambda p: p[:5]):
        end = start - length
        if rest:
            others.append((start, end, x, owner))
        elif start >= done:
            found.append((start, end, x, True, owner))
            done = end
    starts, done, more = [f[0] for f in found], 0, []
    for start, end, x, owner in others:
        k = bisect.bisect_left(starts, end)
        if start >= done and (not k or found[k - 1][1] <= start):
            more.append((start, end, x, False, owner))
            done = end
    return found + more


def found_forms(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """(paper_id, form, text, exact, subject_id, n): how often ``places_of_forms`` finds forms in nodes(paper_id, node, text), not inside
    words. A node's words look up the forms."""
    word = lambda c: F.regexp_extract(c, r"(?U)\w+", 0)
    f = forms.groupBy("paper_id", "form").agg(F.max(F.col("category") == "exact").alias("exact"), F.min(F.when(F.col("category") == "exact", F.col("subject_id"))).alias("subject_id")).withColumn("word", word(F.col("form")))
    words = nodes.select("paper_id", "node", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    hit = words.join(f, ["paper_id", "word"]).groupBy("paper_id", "node").agg(F.collect_list(F.struct("form", "exact", "subject_id")).alias("f"))
    both = nodes.join(hit, ["paper_id", "node"]).select("paper_id", "text", F.col("f.form").alias("forms"), F.col("f.exact").alias("exacts"), F.col("f.subject_id").alias("owners"))
    columns = ["paper_id", "form", "text", "exact", "subject_id"]

    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            for paper, text, forms, exacts, owners in zip(b["paper_id"], b["text"], b["forms"], b["exacts"], b["owners"]):
                counts.update((paper, x, text[start:end], exact, owner) for start, end, x, exact, owner in places_of_forms(text, list(zip(forms, exacts, owners))))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=[*columns, "n"])

    kinds = dict(nodes.dtypes)
    found = both.mapInPandas(run, f"paper_id {kinds['paper_id']}, form string, text string, exact boolean, subject_id string, n long")
    return found.groupBy(*columns).agg(F.sum("n").alias("n"))


def occurrence_coverage(objects: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, missed): per paper how many mentions the exact surfaces anchor and how many other forms would add, and the 25 most
    frequent of those forms. A form of several subjects is ambiguous and adds nothing."""
    forms = written(surface_forms(objects), "forms")
    seen = written(found_forms(nodes, forms), "found-forms")
    owners = forms.groupBy("paper_id", "form").agg(F.countDistinct("subject_id").alias("owners"), F.min("subject_id").alias("owner"), F.min("category").alias("category"))
    more = seen.where("not exact").drop("subject_id").join(owners, ["paper_id", "form"])
    good = more.where("owners = 1")
    e = seen.where("exact").groupBy("paper_id").agg(F.sum("n").alias("exact"), F.countDistinct("subject_id").alias("exact_subjects"))
    times = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    m = more.groupBy("paper_id").agg(
        times((F.col("owners") == 1) & (F.col("category") == "inflection")).alias("inflection"), times((F.col("owners") == 1) & (F.col("category") == "orthographic")).alias("orthographic"), times(F.col("owners") > 1).alias("ambiguous")
    )
    both = seen.where("exact").select("paper_id", "subject_id").union(good.select("paper_id", "owner")).groupBy("paper_id").agg(F.countDistinct("subject_id").alias("all_subjects"))
    n = objects.where("kind <> 'claim'").groupBy("paper_id").agg(F.count(F.lit(1)).alias("subjects"))
    t = n.join(e, "paper_id", "left").join(m, "paper_id", "left").join(both, "paper_id", "left").na.fill(0)
    c = F.col
    totals = t.select(
        "paper_id", "subjects", "exact", "inflection", "orthographic", "ambiguous", rate(c("exact"), c("exact") + c("inflection") + c("orthographic")).alias("recall"), rate(c("exact_subjects"), c("subjects")).alias("exact_rate"), rate(c("all_subjects"), c("subjects")).alias("possible_rate")
    )
    g = good.groupBy("paper_id", "text", F.col("owner").alias("subject_id"), "category").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("paper_id").orderBy(F.desc("n"), F.lower("text"), "subject_id", "text")
    return totals, g.withColumn("place", F.row_number().over(w)).where("place <= 25")


def synthetic_graph(spark, n: int, edges: int, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(objects, relations) of a made graph: kinds in turn; edge i leads from i mod n to 7 i + 1 mod n."""
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(i, F.lit(len(kinds))) + 1).cast("int"))
    objects = spark.range(n).select(F.lit(0).alias("paper_id"), F.concat(F.lit("n"), i).alias("id"), kind.alias("kind"), F.concat(F.lit("Node "), i).alias("label"))
    relations = spark.range(edges).select(F.lit(0).alias("paper_id"), F.concat(F.lit("e"), i).alias("id"), F.lit("uses").alias("type"), F.concat(F.lit("n"), F.pmod(i, F.lit(n))).alias("source_id"), F.concat(F.lit("n"), F.pmod(7 * i + 1, F.lit(n))).alias("target_id"))
    return objects, relations
