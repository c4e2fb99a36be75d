"""Bounded, ranked projections of a property graph: objects and relations, each with paper_id."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Log, checkpointed, written

# How much a relation of each type tells.
INFORMATION = {"challenges": 1.0, "supports": 0.95, "depends_on": 0.9, "produces": 0.85, "compares_with": 0.8, "applies_to": 0.75, "part_of": 0.7, "uses": 0.65, "is_a": 0.6}
PENALTY = {"novice": 0.0, "intermediate": 0.1, "expert": 0.25}
CORE = 0.8


def degree(relations: DataFrame) -> DataFrame:
    """(paper_id, id, degree): relations at either end."""
    ends = relations.select("paper_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("paper_id", "id").agg(F.count(F.lit(1)).alias("degree"))


def ranked(objects: DataFrame, relations: DataFrame, expertise: str = "intermediate", d: DataFrame | None = None) -> DataFrame:
    """objects with degree and rank (0 at least); what is a core contribution has no penalty for familiarity. ``d`` is ``degree(relations)``,
    where that is at hand: it is read twice."""
    d = degree(relations) if d is None else d
    top = d.groupBy("paper_id").agg(F.max("degree").alias("most"))
    o = objects.join(d, ["paper_id", "id"], "left").join(top, "paper_id", "left").na.fill({"degree": 0, "most": 1})
    base = 0.35 * F.col("contribution") + 0.2 * F.col("prominence") + 0.15 * F.col("recurrence") + 0.15 * F.col("confidence") + 0.15 * F.col("degree") / F.greatest("most", F.lit(1))
    penalty = F.when(F.col("contribution") >= CORE, 0.0).otherwise(PENALTY[expertise])
    return o.withColumn("rank", F.round(F.greatest(F.lit(0.0), base - penalty * F.col("familiarity")), 6)).drop("most")


def rank_order() -> list[Column]:
    return [F.desc("rank"), F.lower("label"), F.col("id")]


def expert_view(r: DataFrame, kinds: list[str] | None = None, min_importance: float = 0.0) -> DataFrame:
    """Without what an expert knows anyway, of the kinds, of a rank."""
    keep = ~((F.col("familiarity") >= 0.8) & (F.col("contribution") < CORE)) & (F.col("rank") >= min_importance)
    return r.where(keep & F.col("kind").isin(kinds) if kinds else keep)


def top(r: DataFrame, limit: int = 20, most: int = 30) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy(*rank_order())
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, min(limit, most)))


def relation_order() -> list[Column]:
    info = F.create_map(*[F.lit(x) for kv in INFORMATION.items() for x in kv])
    return [F.desc(F.coalesce(F.element_at(info, F.col("type")), F.lit(0.0))), F.desc("confidence"), F.desc("evidence"), F.col("id")]


def ordered_relations(relations: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy(*relation_order())
    return relations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def search(objects: DataFrame, relations: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None, facets: DataFrame | None = None) -> DataFrame:
    """(paper_id, place, id, score): a label or alias (column ``aliases``, if there) that is the query 1, begins with it 0.8, holds it 0.6; else a
    text of facets(paper_id, id, text) that holds it 0.4; each plus 0.2 of the rank."""
    q = " ".join(query.lower().split())
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in objects.columns else F.array("label")
    names = F.transform(names, lambda n: F.trim(F.regexp_replace(F.lower(n), r"(?U)\s+", " ")))
    any_of = lambda test: F.coalesce(F.exists(names, lambda n: F.coalesce(test(n), F.lit(False))), F.lit(False))
    tier = F.when(any_of(lambda n: n == q), 1.0).when(any_of(lambda n: F.startswith(n, F.lit(q))), 0.8).when(any_of(lambda n: F.contains(n, F.lit(q))), 0.6)
    hit = objects.where(F.col("kind").isin(kinds)) if kinds else objects
    if facets is None:
        hit = hit.withColumn("tier", tier)
    else:
        told = facets.where(F.contains(F.lower("text"), F.lit(q))).select("paper_id", "id").distinct().withColumn("told", F.lit(0.4))
        hit = hit.join(told, ["paper_id", "id"], "left").withColumn("tier", F.coalesce(tier, "told")).drop("told")
    hit = ranked(hit.where("tier is not null"), relations).withColumn("score", F.round(F.col("tier") + 0.2 * F.col("rank"), 6))
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), F.lower("label"), "id")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, min(limit, 50))).select("paper_id", "place", "id", "score")


def neighbours(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(paper_id, id) one step from seeds(paper_id, id), either way, seeds left out."""
    both = relations.select("paper_id", F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("e"))
    step = both.select("paper_id", F.col("e.a").alias("id"), F.col("e.b").alias("to")).join(seeds, ["paper_id", "id"], "left_semi")
    return step.select("paper_id", F.col("to").alias("id")).distinct().join(seeds, ["paper_id", "id"], "left_anti")


def focus_nodes(objects: DataFrame, relations: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """(paper_id, id, role): seeds by rank, then the best neighbours, up to the limit."""
    r = ranked(objects, relations)
    s = r.join(seeds, ["paper_id", "id"], "left_semi").withColumn("role", F.lit(0))
    n = r.join(neighbours(relations, seeds), ["paper_id", "id"], "left_semi").withColumn("role", F.lit(1))
    w = Window.partitionBy("paper_id").orderBy("role", F.desc("rank"), "id")
    both = s.union(n).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, min(limit, 50)))
    return both.select("paper_id", "id", F.when(F.col("role") == 0, "seed").otherwise("neighbour").alias("role"))


def induced(relations: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """The relations with both ends in nodes(paper_id, id), the most telling first."""
    ends = nodes.select("paper_id", "id")
    r = relations.join(ends.withColumnRenamed("id", "source_id"), ["paper_id", "source_id"], "left_semi").join(ends.withColumnRenamed("id", "target_id"), ["paper_id", "target_id"], "left_semi")
    return ordered_relations(r, max(0, min(limit, 100)))


def omitted(relations: DataFrame, nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """(paper_id, id, omitted): a node's relations that the projection leaves out."""
    all_, here = degree(relations), degree(shown).withColumnRenamed("degree", "seen")
    n = nodes.select("paper_id", "id").join(all_, ["paper_id", "id"], "left").join(here, ["paper_id", "id"], "left").na.fill(0, ["degree", "seen"])
    return n.select("paper_id", "id", F.greatest(F.lit(0), F.col("degree") - F.col("seen")).cast("long").alias("omitted"))


def connectivity(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(paper_id, nodes, edges, isolates, mean_degree, density): mean and density by distinct neighbours."""
    valid = induced_all(relations, objects)
    pair = valid.select("paper_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    near = pair.select("paper_id", F.explode(F.array("a", "b")).alias("id")).groupBy("paper_id", "id").agg(F.count(F.lit(1)).alias("k"))
    per = objects.select("paper_id", "id").join(near, ["paper_id", "id"], "left").na.fill(0, ["k"])
    a = per.groupBy("paper_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("k") == 0).cast("long")).alias("isolates"), F.sum("k").alias("ends"))
    e = valid.groupBy("paper_id").agg(F.count(F.lit(1)).alias("edges"))
    j = a.join(e, "paper_id", "left").na.fill(0, ["edges"])
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return j.select("paper_id", "nodes", "edges", "isolates", F.round(F.col("ends") / F.col("nodes"), 6).alias("mean_degree"), F.round(F.when(possible > 0, F.col("ends") / 2 / possible).otherwise(0.0), 9).alias("density"))


def induced_all(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = nodes.select("paper_id", "id")
    return relations.join(ends.withColumnRenamed("id", "source_id"), ["paper_id", "source_id"], "left_semi").join(ends.withColumnRenamed("id", "target_id"), ["paper_id", "target_id"], "left_semi")


def numbered(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """nodes, written with ``code``: a whole number each, growing in the order where one is given."""
    return written((nodes.orderBy(*order) if order else nodes).withColumn("code", F.monotonically_increasing_id()), "numbered")


def linked(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(paper_id, a, b, times): the pairs a < b of codes of nodes(paper_id, id, code) with relations between them, and how many. Loops and
    unknown ends don't count."""
    code = nodes.groupBy("paper_id", "id").agg(F.min("code").alias("code"))
    e = relations.where("source_id <> target_id").select("paper_id", "source_id", "target_id")
    for end in ("source", "target"):
        e = e.join(code.select("paper_id", F.col("id").alias(f"{end}_id"), F.col("code").alias(end)), ["paper_id", f"{end}_id"]).drop(f"{end}_id")
    return written(e.groupBy("paper_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("times")), "links")


def link_ends(links: DataFrame) -> DataFrame:
    """(paper_id, code, k, least): each end of links(paper_id, a, b), how many links it has, and the least code at their other ends."""
    both = links.select("paper_id", F.col("a").alias("code"), F.col("b").alias("to")).union(links.select("paper_id", "b", "a"))
    return written(both.groupBy("paper_id", "code").agg(F.count(F.lit(1)).alias("k"), F.min("to").alias("least")), "link-ends")


def roots(links: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(paper_id, code, root): the least code that each end of links(paper_id, a, b) reaches; ends are ``link_ends(links)``.

    Each code points to its least neighbour, or to itself where that is less. Pointers are followed to their last code, by doubling,
    and links between different last codes make the graph of the next round. A code without less neighbours has
    others pointing to it, or less neighbours in the next round: two rounds leave half of the codes at most.
    """
    ends = link_ends(links) if ends is None else ends
    up = ends.select("paper_id", "code", F.least("code", "least").alias("root"))
    # only codes that are pointed to are followed
    hop = written(up.join(up.select("paper_id", F.col("root").alias("code")).distinct(), ["paper_id", "code"], "left_semi"), "hops")
    while True:
        over = hop.select("paper_id", F.col("code").alias("root"), F.col("root").alias("over"))
        hop = written(hop.join(over, ["paper_id", "root"]).select("paper_id", "code", F.col("over").alias("root"), (F.col("over") < F.col("root")).alias("moved")), "hops")
        if hop.where("moved").isEmpty():
            break
    last = hop.select("paper_id", F.col("code").alias("root"), F.col("root").alias("over"))
    found = written(up.join(last, ["paper_id", "root"]).select("paper_id", "code", F.col("over").alias("root")), "roots")
    rest = links.select("paper_id", "a", "b")
    for end in ("a", "b"):
        rest = rest.join(found.select("paper_id", F.col("code").alias(end), F.col("root").alias(f"of_{end}")), ["paper_id", end])
    rest = rest.where("of_a <> of_b").select("paper_id", F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
    rest = written(rest, "links")
    if rest.isEmpty():
        return found
    more = roots(rest).select("paper_id", F.col("code").alias("root"), F.col("root").alias("over"))
    return written(found.join(more, ["paper_id", "root"], "left").select("paper_id", "code", F.coalesce("over", "root").alias("root")), "roots")


def components(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(paper_id, id, component): the least id reachable. Ids are numbered once, so that rounds are over whole numbers."""
    nodes = numbered(objects.select("paper_id", "id").distinct())
    own = written(nodes.join(roots(linked(nodes, relations)), ["paper_id", "code"], "left").select("paper_id", "id", F.coalesce("root", "code").alias("root")), "rooted")
    least = own.groupBy("paper_id", "root").agg(F.min("id").alias("component"))
    known = own.join(least, ["paper_id", "root"]).select("paper_id", "id", "component")
    return objects.select("paper_id", "id").join(known, ["paper_id", "id"], "left").select("paper_id", "id", F.coalesce("component", "id").alias("component"))


def closure(relations: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """(paper_id, root, id, depth): what is reached from start(paper_id, id) along relations, each node once, at its least depth.

    As no node comes twice, cycles end too; rounds go on until nothing is new.
    """
    a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
    step = relations.select("paper_id", F.col(a).alias("id"), F.col(b).alias("to")).distinct()
    seen = checkpointed(start.select("paper_id", F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    front = seen
    for k in itertools.count(1):
        new = front.join(step, ["paper_id", "id"]).select("paper_id", "root", F.col("to").alias("id"), F.lit(k).alias("depth")).distinct()
        front = checkpointed(new.join(seen.select("paper_id", "root", "id"), ["paper_id", "root", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.union(front))
    return seen


def overview(objects: DataFrame, relations: DataFrame, limit: int = 20) -> DataFrame:
    """``overview_of`` all objects."""
    return overview_of(ranked(objects, relations), relations, limit)


def overview_of(r: DataFrame, relations: DataFrame, limit: int = 20) -> DataFrame:
    """``chosen`` of ranked objects."""
    nodes = placed(r)
    return chosen(nodes, linked(nodes, relations), limit)


def placed(r: DataFrame, name=F.col) -> DataFrame:
    """(paper_id, id, contribution, rank, code): ranked objects; codes grow as they are ordered by rank, label and id, or what ``name``
    makes of the id."""
    order = written(r.select("paper_id", "id", F.lower("label").alias("label"), "contribution", "rank"), "overview-objects")
    return numbered(order, F.desc("rank"), "label", name("id")).drop("label")


def chosen(nodes: DataFrame, links: DataFrame, limit: int = 20) -> DataFrame:
    """(paper_id, place, id, rank) of the overview's nodes among nodes as ``placed`` and links as ``linked``: core contributions first,
    then the neighbourhood.

    A quarter of the places go to the best core contributions, or one to the best object. Each further place goes to the
    object with most neighbours among those chosen, the best of equal ones; without neighbours, to the best left. All papers
    take a place in the same round, at most 30 rounds. A round adds to a written log the new node and its neighbours by their
    codes, which are all that the order takes, and chooses the next from the sums of the log: it holds the best of
    each paper, and what the chosen ones touch, never a whole paper.
    """
    limit = max(1, min(limit, 30))

    def touched(new: DataFrame) -> DataFrame:
        """The new nodes as chosen, and one tie for each of their neighbours."""
        ways = [links.select("paper_id", F.col(a).alias("by"), F.col(b).alias("code")).join(new.withColumnRenamed("code", "by"), ["paper_id", "by"]) for a, b in ("ab", "ba")]
        ties = ways[0].union(ways[1]).groupBy("paper_id", "code").agg(F.count(F.lit(1)).alias("ties"))
        return new.select("paper_id", "code", F.lit(0).cast("long").alias("ties"), F.lit(True).alias("chosen")).unionByName(ties.withColumn("chosen", F.lit(False)))

    best = Window.partitionBy("paper_id").orderBy("code")
    n = nodes.select("paper_id", "code", "contribution")
    first = n.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    # half to even, as the budget is defined
    budget = max(1, min(limit, round(limit * 0.25)))
    core = n.where(F.col("contribution") >= CORE).withColumn("place", F.row_number().over(best)).where(F.col("place") <= budget)
    seeds = core.unionByName(first.where("place = 1").join(core.select("paper_id").distinct(), "paper_id", "left_anti"))
    log = Log(nodes.sparkSession, "overview")
    log.add(first.select("paper_id", "code", F.lit(0).cast("long").alias("ties"), F.lit(False).alias("chosen")))
    seeds = written(seeds.select("paper_id", "code"), "overview-seeds")
    log.add(touched(seeds))
    had = seeds.groupBy("paper_id").count().agg(F.min("count")).first()[0] or limit
    for _ in range(limit - had):
        seen = log.read().groupBy("paper_id", "code").agg(F.sum("ties").alias("ties"), F.max("chosen").alias("chosen"))
        order = F.struct((-F.col("ties")).alias("ties"), "code")
        next_ = seen.groupBy("paper_id").agg(F.min(F.when(~F.col("chosen"), order)).alias("x"), F.sum(F.col("chosen").cast("int")).alias("n"))
        log.add(touched(written(next_.where(F.col("x").isNotNull() & (F.col("n") < limit)).select("paper_id", "x.code"), "overview-next")))
    shown = written(log.read().where("chosen").select("paper_id", "code").distinct(), "overview-chosen")
    shown = nodes.join(shown, ["paper_id", "code"]).withColumn("place", F.row_number().over(best))
    return shown.select("paper_id", "place", "id", "rank")


def backbone(objects: DataFrame, relations: DataFrame, nodes: DataFrame, budget: int = 100) -> DataFrame:
    """(paper_id, place, id) of the sparse relations among nodes: a spanning forest in the order of information, in which
    ordinary nodes first get two ties at most. At most 30 nodes a paper.

    Of the relations between two nodes only the first in order can be in the forest, the others count. So each pair of nodes
    is one row before a paper's rows meet: no more than nodes make pairs.
    """
    kinds = dict(relations.dtypes)
    core = nodes.select("paper_id", "id").join(objects.select("paper_id", "id", (F.col("contribution") >= CORE).alias("core")), ["paper_id", "id"])
    r = induced_all(relations, nodes)
    info = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in INFORMATION.items() for x in kv]), F.col("type")), F.lit(0.0))
    order = F.struct((-info).alias("info"), (-F.col("confidence")).alias("confidence"), (-F.col("evidence")).alias("evidence"), "id")
    pair = r.groupBy("paper_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("times"))
    for end in ("a", "b"):
        pair = pair.join(core.select("paper_id", F.col("id").alias(end), F.col("core").alias(f"core_{end}")), ["paper_id", end])
    n = nodes.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    rows = pair.join(n, "paper_id").select("paper_id", "a", "b", "times", "core_a", "core_b", "n", F.col("x.id").alias("id"), F.col("x.info").alias("i"), F.col("x.confidence").alias("c"), F.col("x.evidence").alias("e"))

    def forest(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["i", "c", "e", "id"])
        count: dict = {}
        for a, b, times in zip(p["a"], p["b"], p["times"]):
            count[a], count[b] = count.get(a, 0) + times, count.get(b, 0) + times
        bar = max(3, math.ceil(2 * sum(count.values()) / max(1, int(p["n"].iloc[0]))))
        hubs = {x for x, k in count.items() if k > bar} | set(p.loc[p["core_a"], "a"]) | set(p.loc[p["core_b"], "b"])
        tree: dict = {}
        used: dict = {}

        def root(x):
            while tree.get(x, x) != x:
                x = tree[x]
            return x

        out: list = []
        for strict in (True, False):
            for name, a, b in zip(p["id"], p["a"], p["b"]):
                full = strict and any(used.get(x, 0) >= 2 for x in (a, b) if x not in hubs)
                if len(out) < budget and not full and root(a) != root(b):
                    tree[root(b)] = root(a)
                    used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                    out.append(name)
        return pd.DataFrame({"paper_id": [p["paper_id"].iloc[0]] * len(out), "place": range(1, len(out) + 1), "id": out})

    return rows.groupBy("paper_id").applyInPandas(forest, f"paper_id {kinds['paper_id']}, place int, id {kinds['id']}")


def facets(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(paper_id, facet, name, n): how many objects of each kind and relations of each type."""
    count = lambda d, facet, c: d.groupBy("paper_id", F.lit(facet).alias("facet"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(objects, "node", "kind").union(count(relations, "edge", "type"))


def glossary_page(objects: DataFrame, query: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """(paper_id, place, id, tier, total): objects by label: exact 0, prefix 1, substring 2; one page, and how many there are."""
    q, name = query.lower(), F.lower("label")
    tier = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).when(F.contains(name, F.lit(q)), 2)
    hit = objects.select("paper_id", "id", name.alias("name"), tier.alias("tier")).where("tier is not null")
    per = Window.partitionBy("paper_id")
    hit = hit.withColumn("total", F.count(F.lit(1)).over(per)).withColumn("place", F.row_number().over(per.orderBy("tier", "name", "id")))
    return hit.where((F.col("place") > offset) & (F.col("place") <= offset + max(1, min(limit, 50)))).select("paper_id", "place", "id", "tier", "total")


def connections(relations: DataFrame) -> DataFrame:
    """(paper_id, id, direction, type, n): a node's relations by direction and type."""
    out = relations.select("paper_id", F.col("source_id").alias("id"), F.lit("outgoing").alias("direction"), "type")
    in_ = relations.select("paper_id", F.col("target_id").alias("id"), F.lit("incoming").alias("direction"), "type")
    return out.union(in_).groupBy("paper_id", "id", "direction", "type").agg(F.count(F.lit(1)).alias("n"))
