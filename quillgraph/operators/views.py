"""What a reader's screen shows of graphs, sections and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, written
from . import document as D
from . import graph as G


def of_document(d: D.Document) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, relations, facets) of a canonical document as the projections take them: with ``id``, and a relation's number of evidence."""
    objects = d.objects.withColumnRenamed("stable_id", "id")
    evidence = F.when(F.col("evidence_id").isNotNull(), 1).otherwise(0).cast("long").alias("evidence")
    relations = d.relations.select("paper_id", F.col("stable_id").alias("id"), "type", "source_id", "target_id", "confidence", evidence)
    return objects, written(relations, "relations"), d.facets.select("paper_id", F.col("object_id").alias("id"), "text")


def overview(objects: DataFrame, relations: DataFrame, kinds: list[str] | None = None, in_section: DataFrame | None = None, min_importance: float = 0.0, expertise: str = "intermediate", show_familiar: bool = False, limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals): the overview of what passes the filters: kinds, objects in_section(paper_id, id), what an expert
    knows, and rank. Totals are those of the whole graph; truncated tells that more passed than is shown."""
    o = objects.where(F.col("kind").isin(kinds or D.KINDS))
    o = o.join(in_section.select("paper_id", "id").distinct(), ["paper_id", "id"], "left_semi") if in_section is not None else o
    if expertise == "expert" and not show_familiar:
        o = o.where(~((F.col("familiarity") >= 0.8) & (F.col("contribution") < G.CORE)))
    passed = G.ranked(objects, relations, expertise).where(F.col("rank") >= min_importance).join(o.select("paper_id", "id"), ["paper_id", "id"], "left_semi")
    passed = checkpointed(passed)
    nodes = checkpointed(G.overview_of(passed, relations, limit))
    edges = checkpointed(G.backbone(objects, relations, nodes))
    return nodes, edges, totals(objects, relations, passed.groupBy("paper_id").agg(F.count(F.lit(1)).alias("candidates")), nodes, edges)


def totals(objects: DataFrame, relations: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, total_objects, total_relations, omitted_relations, truncated)."""
    n = lambda d, name: d.groupBy("paper_id").agg(F.count(F.lit(1)).alias(name))
    j = n(objects, "total_objects").join(n(relations, "total_relations"), "paper_id", "left").join(candidates, "paper_id", "left").join(n(nodes, "shown"), "paper_id", "left").join(n(edges, "edges"), "paper_id", "left").na.fill(0)
    return j.select("paper_id", "total_objects", "total_relations", F.greatest(F.lit(0), F.col("total_relations") - F.col("edges")).cast("long").alias("omitted_relations"), (F.col("candidates") > F.col("shown")).alias("truncated"))


def focus(objects: DataFrame, relations: DataFrame, seeds: DataFrame, kinds: list[str] | None = None, expertise: str = "intermediate", nodes: int = 30, edges: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals) around seeds(paper_id, id), given ones and those at a location: the best seeds, then their best
    neighbours; what is truncated counts seeds and neighbours of all kinds."""
    most = max(1, min(nodes, 50))
    s = seeds.select("paper_id", "id").distinct().join(objects.select("paper_id", "id"), ["paper_id", "id"], "left_semi")
    r = G.ranked(objects, relations, expertise)
    allowed = r.where(F.col("kind").isin(kinds)) if kinds else r
    best = lambda d, role: d.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("rank"), "id"))).select("paper_id", "id", F.lit(role).alias("role"), "rank", "place")
    first = checkpointed(best(allowed.join(s, ["paper_id", "id"], "left_semi"), "seed").where(F.col("place") <= most))
    near = checkpointed(G.neighbours(relations, first.select("paper_id", "id")))
    room = first.groupBy("paper_id").agg((most - F.count(F.lit(1))).alias("room"))
    rest = best(allowed.join(near, ["paper_id", "id"], "left_semi"), "neighbour").join(room, "paper_id").where(F.col("place") <= F.col("room")).drop("room")
    shown = checkpointed(first.union(rest).select("paper_id", "id", "role", "rank"))
    kept = checkpointed(G.induced(relations, shown, max(0, min(edges, 100))))
    reach = s.union(near).distinct().groupBy("paper_id").agg(F.count(F.lit(1)).alias("candidates"))
    return shown, kept, totals(objects, relations, reach, shown, kept)


def merged(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of two projections of a paper: rows of new replace equal ids; with too many nodes those that were there
    stay; edges without both ends go. nodes(paper_id, id, place), edges(paper_id, id, source_id, target_id)."""
    key = ["paper_id", "id"]
    up = lambda a, b: b.withColumn("fresh", F.lit(1)).unionByName(a.join(b.select(*key), key, "left_anti").withColumn("fresh", F.lit(0)))
    known = old[0].select(*key).withColumn("was", F.lit(True))
    n = up(old[0], new[0]).join(known, key, "left")
    w = Window.partitionBy("paper_id").orderBy(F.col("was").isNull(), "place", "id")
    n = n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k", "was", "fresh")
    return n, G.induced_all(up(old[1], new[1]).drop("fresh"), n)


def visible(nodes: DataFrame, edges: DataFrame, node_kinds: list[str], edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds; edges of the types between them."""
    n = nodes.where(F.col("kind").isin(node_kinds))
    return n, G.induced_all(edges.where(F.col("type").isin(edge_types)), n)


def flattened(sections: DataFrame) -> DataFrame:
    """(paper_id, id, depth, place): sections(paper_id, id, parent_id, pos) in preorder; a section whose parent isn't there is a root.

    Levels are joined to their parents' paths of positions, a round each; the paths sort in preorder. Sections on a cycle
    have no root and are left out.
    """
    s = sections.select("paper_id", "id", "parent_id", "pos")
    known = s.select("paper_id", F.col("id").alias("parent_id"))
    root = s.join(known, ["paper_id", "parent_id"], "left_anti")
    step = lambda p: F.lpad(F.col(p).cast("string"), 12, "0")
    level = checkpointed(root.select("paper_id", "id", F.lit(0).alias("depth"), F.array(F.concat_ws(":", step("pos"), "id")).alias("path")))
    whole = level
    while not level.isEmpty():
        up = level.select("paper_id", F.col("id").alias("parent_id"), "depth", "path")
        level = checkpointed(s.join(up, ["paper_id", "parent_id"]).select("paper_id", "id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(F.concat_ws(":", step("pos"), "id"))).alias("path")))
        whole = whole.union(level)
    w = Window.partitionBy("paper_id").orderBy("path")
    return whole.select("paper_id", "id", "depth", F.row_number().over(w).alias("place"))


def without_title_root(flat: DataFrame, sections: DataFrame, titles: DataFrame) -> DataFrame:
    """flat(paper_id, id, depth, place) without a root that stands alone and only repeats titles(paper_id, title), or is called title: its
    sections move up."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    roots = flat.where("depth = 0").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    r = roots.join(sections.select("paper_id", "id", "title"), ["paper_id", "id"]).join(titles.select("paper_id", F.col("title").alias("paper")), "paper_id", "left")
    r = r.where((norm("title") == norm("paper")) | F.lower("id").rlike(r"(^|[-_.])title($|[-_.])")).select("paper_id", F.col("id").alias("gone"))
    j = flat.join(r, "paper_id", "left").where(F.col("gone").isNull() | (F.col("id") != F.col("gone")))
    up = F.when(F.col("gone").isNotNull(), 1).otherwise(0)
    return j.select("paper_id", "id", (F.col("depth") - up).alias("depth"), (F.col("place") - up).alias("place"))


def notes_by_section(notes: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, section_id, title, n, first_id): notes(paper_id, id, dom_node_id) by the section of their node; those without one under null."""
    j = notes.join(nodes.select("paper_id", F.col("node_id").alias("dom_node_id"), "section_id"), ["paper_id", "dom_node_id"], "left")
    g = j.groupBy("paper_id", "section_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return g.join(sections.select("paper_id", "section_id", "title"), ["paper_id", "section_id"], "left")


def graph_search(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(paper_id, place, id): nodes(paper_id, id, type, label, texts) with the query in the label or one of the texts: labels first, then definitions,
    theorems, formulas, symbols."""
    q = query.lower()
    label = F.contains(F.lower("label"), F.lit(q))
    other = F.exists("texts", lambda t: F.contains(F.lower(t), F.lit(q)))
    order = F.array_position(F.array(*map(F.lit, ["definition", "theorem", "formula", "symbol"])), F.col("type"))
    w = Window.partitionBy("paper_id").orderBy(F.when(label, 0).otherwise(1), F.when(order > 0, order).otherwise(9), "id")
    return nodes.where(F.coalesce(label, F.lit(False)) | F.coalesce(other, F.lit(False))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("paper_id", "place", "id")
