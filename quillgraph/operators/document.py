"""The canonical document of a paper, built from observations as tables: objects, relations, equations, notation,
explanations and occurrences, with the rules that they must keep.

An observation is a row (paper_id, id, kind, label, aliases, roles, summary, facet_kind, contribution, prominence, familiarity,
confidence, section_id, node_id, equation_id, quote, char_start; of relations: type, source, target, qualifiers; of
equations: latex, scope_id, symbols, object_labels, defined_observation_id). What the reference keeps as lists of
evidence in an object is a table of pairs here, so that no object gathers its observations.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import checkpointed, written
from . import canonical as C

# Kinds of objects, types of relations, and what older names of types mean, with their qualifier.
KINDS = ["topic", "claim", "procedure", "artifact", "quantity"]
TYPES = ["is_a", "part_of", "uses", "depends_on", "applies_to", "produces", "supports", "challenges", "compares_with"]
OLD_TYPES = {"defines": ("is_a", "definition"), "derives_from": ("depends_on", "derivation"), "evaluated_by": ("uses", "evaluation")}
# Fixed value: what a symbol means of which nothing is said.
UNSAID = "Meaning not explicitly defined near this equation"


@dataclass
class Document:
    observations: DataFrame
    objects: DataFrame
    object_evidence: DataFrame
    facets: DataFrame
    relations: DataFrame
    equations: DataFrame
    notation: DataFrame
    notation_evidence: DataFrame
    explanations: DataFrame
    occurrences: DataFrame


def given(c: Column) -> Column:
    """Null for blank texts."""
    return F.when(F.trim(c) != "", F.trim(c))


def stable(kind: str | Column, label: Column, math: Column | None = None, scope: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return T.stable_identifier(kind, T.normalize_text(label), T.normalize_math(math) if math is not None else None, T.normalize_text(scope) if scope is not None else None)


def occurrence_id(subject: str, place: str) -> Column:
    """``stable`` by subject and place|start|end, where names that many rows share are normalised alone: a number stays, without its sign."""
    at = T.normalize_text(place)
    return T.stable_identifier(F.lit("occurrence"), T.normalize_text(subject), None, F.concat_ws(" ", F.when(at != "", at), F.abs("start"), F.abs("end")))


def observation_ids(obs: DataFrame) -> DataFrame:
    """obs(paper_id, kind, label, latex, equation_id, node_id, section_id) with ``id``: by kind, label, formula and the first place that is given."""
    place = F.coalesce(given(F.col("equation_id")), given(F.col("node_id")), given(F.col("section_id")), F.lit("paper"))
    return obs.withColumn("id", stable(F.concat(F.lit("observation-"), "kind"), F.col("label"), F.col("latex"), F.concat_ws("|", "paper_id", place)))


def objects(obs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, evidence, facets): one object for each group of observations; its representative is the least one."""
    o = obs.where(F.col("kind").isin(KINDS))
    groups = C.groups(o).select("paper_id", F.col("observation_id").alias("id"), "entity_id")
    rep = o.select("paper_id", F.col("id").alias("entity_id"), F.col("label").alias("name"), stable(F.col("kind"), F.col("label"), None, F.col("paper_id")).alias("stable_id"))
    o = o.select("paper_id", "id", "kind", "label", "aliases", "roles", "summary", "facet_kind", "contribution", "prominence", "familiarity", "confidence")
    m = written(o.join(groups, ["paper_id", "id"]).join(rep, ["paper_id", "entity_id"]), "members")
    signal = lambda c, d: F.round(F.max(F.coalesce(F.col(c), F.lit(d))), 6).alias(c)
    g = m.groupBy("paper_id", "stable_id", "kind", F.col("name").alias("label")).agg(
        signal("contribution", 0.5), signal("prominence", 0.5), signal("familiarity", 0.0), F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("members")
    )
    g = g.withColumn("recurrence", F.round(F.least(F.lit(1.0), F.col("members") / 3), 6))
    names = m.select("paper_id", "stable_id", "name", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias <> name").distinct()
    by_case = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    names = names.groupBy("paper_id", "stable_id").agg(F.array_sort(F.collect_list("alias"), by_case).alias("aliases"))
    roles = m.select("paper_id", "stable_id", F.explode("roles").alias("role")).where("trim(role) <> ''").groupBy("paper_id", "stable_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    empty = F.array().cast("array<string>")
    out = g.join(names, ["paper_id", "stable_id"], "left").join(roles, ["paper_id", "stable_id"], "left")
    out = out.withColumn("aliases", F.coalesce("aliases", empty)).withColumn("roles", F.coalesce("roles", empty))
    evidence = m.select("paper_id", F.col("stable_id").alias("object_id"), F.col("id").alias("observation_id"))
    facets = m.where(F.col("summary") != "").select("paper_id", F.col("stable_id").alias("object_id"), F.coalesce("facet_kind", "kind").alias("kind"), F.col("summary").alias("text"), F.col("id").alias("observation_id"))
    return written(out, "objects"), evidence, facets


def named(found: DataFrame) -> DataFrame:
    """(paper_id, norm, first, last, stable_id ...): the objects that a label or alias names; the first and last of several."""
    names = found.select("paper_id", "stable_id", F.explode(F.concat(F.array("label"), "aliases")).alias("name"))
    return names.groupBy("paper_id", T.normalize_text("name").alias("norm")).agg(F.min("stable_id").alias("first"), F.max("stable_id").alias("last"))


def relations(obs: DataFrame, found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(paper_id, stable_id, type, source_id, target_id, qualifiers, evidence_id, confidence): relations between objects by name;
    of several of one type and ends the last observation tells. Nested ones (column ``relations`` of an observation) start
    from its object and need evidence or a quote. Unknown types and names and loops are dropped."""
    own = obs.where("kind = 'relation'").select("paper_id", "id", F.lit(0).alias("pos"), "type", "source", F.lit(None).cast("string").alias("from_id"), "target", "qualifiers", "confidence")
    if "relations" in obs.columns:
        r = obs.where(F.col("kind") != "relation").select("paper_id", "id", "quote", F.col("confidence").alias("c"), F.posexplode("relations").alias("pos", "r"))
        r = r.where(F.trim(F.coalesce("r.evidence", "quote")) != "").join(evidence.select("paper_id", F.col("observation_id").alias("id"), F.col("object_id").alias("from_id")), ["paper_id", "id"])
        own = own.unionByName(r.select("paper_id", "id", "pos", "r.type", F.lit(None).cast("string").alias("source"), "from_id", "r.target", "r.qualifiers", F.coalesce("r.confidence", "c").alias("confidence")))
    old = lambda i: F.create_map(*[F.lit(x) for k, v in OLD_TYPES.items() for x in (k, v[i])])
    mark = F.element_at(old(1), F.col("type"))
    quals = F.coalesce("qualifiers", F.array().cast("array<string>"))
    own = own.withColumn("qualifiers", F.array_sort(F.array_distinct(F.when(mark.isNotNull(), F.concat(quals, F.array(mark))).otherwise(quals))))
    own = own.withColumn("type", F.coalesce(F.element_at(old(0), F.col("type")), F.col("type"))).where(F.col("type").isin(TYPES))
    names = named(found)
    side = lambda p: names.select("paper_id", F.col("norm").alias(p), F.col("first").alias(f"{p}_id"))
    own = own.withColumn("s", T.normalize_text("source")).withColumn("t", T.normalize_text("target"))
    own = own.join(side("s"), ["paper_id", "s"], "left").join(side("t"), ["paper_id", "t"]).withColumn("source_id", F.coalesce("from_id", "s_id")).where("source_id <> t_id")
    last = F.max_by(F.struct("qualifiers", F.col("id").alias("evidence_id"), F.round("confidence", 6).alias("confidence")), F.struct("id", "pos")).alias("x")
    one = own.groupBy("paper_id", "type", "source_id", F.col("t_id").alias("target_id")).agg(last)
    key = stable("relation", F.concat_ws("|", "type", "source_id", "target_id"))
    return one.select("paper_id", key.alias("stable_id"), "type", "source_id", "target_id", "x.*")


def equation_observations(equations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_id, id, equation_id, section_id, latex, scope_id, symbols): what displayed, significant equations(paper_id,
    equation_id, latex, is_display) say; the section is that of their node in nodes(paper_id, node_id, section_id)."""
    e = equations.withColumn("latex", F.trim("latex")).where(T.significant_equation(F.col("is_display"), F.col("latex")))
    place = nodes.groupBy("paper_id", F.col("node_id").alias("equation_id")).agg(F.min("section_id").alias("section_id"))
    e = e.join(place, ["paper_id", "equation_id"], "left").withColumn("kind", F.lit("equation")).withColumn("node_id", F.col("equation_id")).withColumn("label", F.coalesce(given(F.col("equation_id")), "latex"))
    return observation_ids(e).select("paper_id", "id", "equation_id", "section_id", "latex", F.coalesce("section_id", "equation_id").alias("scope_id"), T.scoped_symbols(F.col("latex")).alias("symbols"))


def enriched(equations: DataFrame, analysis: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(equations, messages) after an analysis(paper_id, equation_id, summary, symbols, object_labels, defined_observation_id).

    Symbols stay that aren't i, j or k and stand in the formula. A link to a defined object stays if candidates(paper_id, id)
    have it and no other equation asks for it; else it becomes null and a message says so.
    """
    asked = F.col("defined_observation_id")
    known = candidates.select("paper_id", F.col("id").alias("defined_observation_id"), F.lit(True).alias("known"))
    a = analysis.join(known, ["paper_id", "defined_observation_id"], "left")
    a = a.withColumn("rivals", F.when(F.col("known"), F.count(asked).over(Window.partitionBy("paper_id", "defined_observation_id"))))
    ok = F.col("known") & (F.col("rivals") == 1)
    unknown = F.concat(F.lit("unknown defining object "), asked, F.lit(" of equation "), F.col("equation_id"))
    message = F.when(given(asked).isNotNull() & F.col("known").isNull(), unknown).when(F.col("rivals") > 1, F.concat(F.lit("several defining equations of object "), asked))
    messages = a.select("paper_id", message.alias("message")).where("message is not null").distinct()
    a = a.select("paper_id", "equation_id", F.lit(True).alias("told"), F.col("summary").alias("s2"), F.col("symbols").alias("y2"), F.col("object_labels").alias("l2"), F.when(ok, asked).alias("d2"))
    j = equations.join(a, ["paper_id", "equation_id"], "left")
    bare = lambda y: F.regexp_replace(F.trim(y["symbol"]), r"^\$+|\$+$", "")
    kept = F.filter("y2", lambda y: (bare(y) != "") & ~T.legacy_math(bare(y)).isin("i", "j", "k") & F.contains("latex", bare(y)))
    kept = F.transform(kept, lambda y: y.withField("symbol", bare(y)).withField("scope_id", F.coalesce(given(y["scope_id"]), F.col("scope_id"), F.col("equation_id"))))
    pick = lambda new, old: F.when(F.col("told"), new).otherwise(F.col(old)).alias(old)
    rest = [c for c in equations.columns if c not in ("summary", "symbols", "object_labels", "defined_observation_id")]
    return j.select(*rest, pick(F.col("s2"), "summary"), pick(kept, "symbols"), pick(F.col("l2"), "object_labels"), pick(F.col("d2"), "defined_observation_id")), messages


def equations_and_notation(obs: DataFrame, found: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equations, notation, notation evidence).

    Notation is told apart by glyph, meaning and scope; what else it has comes from the last symbol of that signature, its
    objects from all. An object with several defining equations has none.
    """
    e = obs.where("kind = 'equation'").select(
        "paper_id", "id", F.coalesce(given(F.col("equation_id")), "label").alias("equation_id"), F.trim(F.coalesce("latex", F.lit(""))).alias("latex"), "summary", "symbols", "object_labels",
        F.coalesce(given(F.col("scope_id")), given(F.col("section_id")), given(F.col("equation_id")), "label").alias("scope"), "defined_observation_id",
    )
    names = named(found).select("paper_id", "norm", F.col("last").alias("object_id"))
    s = e.select("paper_id", "id", "equation_id", "scope", F.posexplode("symbols").alias("pos", "y")).where("trim(y.symbol) <> ''")
    s = s.select(
        "paper_id", "id", "pos", F.trim("y.symbol").alias("symbol"), F.coalesce(given(F.col("y.meaning")), F.lit(UNSAID)).alias("meaning"),
        F.coalesce(given(F.col("y.scope_id")), "scope").alias("scope_id"), F.col("y.units").alias("units"), F.array_sort(F.array_distinct("y.constraints")).alias("constraints"), F.col("y.object_labels").alias("labels"),
    )
    s = s.withColumn("stable_id", stable("notation", F.col("symbol"), F.col("meaning"), F.concat_ws("|", "paper_id", "scope_id")))
    s = written(s.withColumn("g", T.normalize_math("symbol")).withColumn("m", T.normalize_text("meaning")).withColumn("c", T.normalize_text("scope_id")), "symbols")
    key = ["paper_id", "g", "m", "c"]
    last = F.max_by(F.struct("stable_id", "symbol", "meaning", "scope_id", "units", "constraints"), F.struct("id", "pos")).alias("x")
    ids = lambda d, by: d.withColumn("norm", T.normalize_text("label")).join(names, ["paper_id", "norm"]).groupBy(*by).agg(F.array_sort(F.collect_set("object_id")).alias("object_ids"))
    empty = F.array().cast("array<string>")
    own = ids(s.select(*key, F.explode("labels").alias("label")).distinct(), key)
    heads = written(s.groupBy(*key).agg(last), "notation-heads")
    notation = heads.join(own, key, "left").select("paper_id", "x.*", F.coalesce("object_ids", empty).alias("object_ids"))
    told = s.join(heads.select(*key, F.col("x.stable_id").alias("notation_id")), key).select("paper_id", "notation_id", F.col("id").alias("observation_id")).distinct()
    marks = s.groupBy("paper_id", "id").agg(F.array_sort(F.collect_set("stable_id")).alias("notation_ids"))
    things = ids(e.select("paper_id", "id", F.explode("object_labels").alias("label")), ["paper_id", "id"])
    link = evidence.select("paper_id", F.col("observation_id").alias("defined_observation_id"), F.col("object_id").alias("defined_object_id"))
    # only those that ask are joined: the others of a paper would all be one key
    asked = e.where("defined_observation_id is not null").select("paper_id", "id", "defined_observation_id").join(link, ["paper_id", "defined_observation_id"])
    defined = asked.groupBy("paper_id", "defined_object_id").agg(F.count(F.lit(1)).alias("rivals"), F.min("id").alias("id")).where("rivals = 1").drop("rivals")
    e = e.where("latex <> ''").join(defined, ["paper_id", "id"], "left")
    e = e.join(marks, ["paper_id", "id"], "left").join(things, ["paper_id", "id"], "left")
    equations = e.select(
        "paper_id", stable("equation", F.col("equation_id"), F.col("latex")).alias("stable_id"), "equation_id", "latex", F.coalesce(given(F.col("summary")), F.concat(F.lit("Displayed equation "), "equation_id")).alias("summary"),
        F.coalesce("notation_ids", empty).alias("notation_ids"), F.coalesce("object_ids", empty).alias("object_ids"), "defined_object_id", F.col("id").alias("evidence_id"),
    )
    return equations, notation, told


def explanations(found: DataFrame, facets: DataFrame, notation: DataFrame) -> DataFrame:
    """(paper_id, stable_id, subject_id, base_content, expertise): an object's first text, else its label; a symbol's meaning."""
    first = facets.where("trim(text) <> ''").groupBy("paper_id", F.col("object_id").alias("stable_id")).agg(F.min_by(F.trim("text"), F.col("observation_id")).alias("said"))
    o = found.join(first, ["paper_id", "stable_id"], "left").select("paper_id", F.col("stable_id").alias("subject_id"), F.coalesce("said", "label").alias("base_content"))
    both = o.union(notation.select("paper_id", "stable_id", "meaning")).withColumn("expertise", F.lit("intermediate"))
    return both.select("paper_id", stable("explanation", F.col("subject_id"), None, F.lit("intermediate")).alias("stable_id"), "subject_id", "base_content", "expertise")


def subject_surfaces(found: DataFrame) -> DataFrame:
    """(paper_id, subject_id, surface, generated): labels and aliases of two characters at least, and their other number where
    one subject alone has it and none says it."""
    said = found.select("paper_id", F.col("stable_id").alias("subject_id"), F.explode(F.concat(F.array("label"), "aliases")).alias("surface")).withColumn("surface", F.trim("surface")).where(F.length("surface") >= 2).distinct()
    made = said.select("paper_id", "subject_id", T.plural_variant(F.col("surface")).alias("surface")).where("surface is not null").withColumn("low", F.lower("surface"))
    once = made.groupBy("paper_id", "low").agg(F.min("subject_id").alias("subject_id"), F.countDistinct("subject_id").alias("n"), F.min("surface").alias("surface")).where("n = 1")
    free = once.join(said.select("paper_id", F.lower("surface").alias("low")), ["paper_id", "low"], "left_anti")
    return said.withColumn("generated", F.lit(False)).union(free.select("paper_id", "subject_id", "surface", F.lit(True)))


def quoted_occurrences(obs: DataFrame, found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Occurrences where there are no sections: in each quote of an object, the first place of its longest surface that is there."""
    o = obs.where("node_id is not null").select("paper_id", F.col("id").alias("observation_id"), "node_id", "section_id", "quote", F.coalesce("char_start", F.lit(0)).alias("base"))
    s = subject_surfaces(found).withColumn("regex", F.concat(F.lit(r"(?iU)(?<!\w)\Q"), "surface", F.lit(r"\E(?!\w)")))
    hit = evidence.join(o, ["paper_id", "observation_id"]).withColumnRenamed("object_id", "subject_id").join(s, ["paper_id", "subject_id"])
    hit = hit.withColumn("text", F.regexp_substr("quote", F.col("regex"))).where("text is not null")
    hit = hit.withColumn("lead", F.concat(F.lit(r"(?isU)^(.*?)(?<!\w)\Q"), "surface", F.lit(r"\E(?!\w)")))
    before = F.expr("regexp_extract(quote, lead, 1)")
    best = F.min_by(F.struct(F.length(before).alias("at"), "text"), F.struct((-F.length("surface")).alias("n"), F.lower("surface").alias("low"))).alias("x")
    one = hit.groupBy("paper_id", "subject_id", "observation_id", "node_id", "section_id", "base").agg(best)
    one = one.withColumn("start", F.col("base") + F.col("x.at")).withColumn("end", F.col("start") + F.length("x.text"))
    key = occurrence_id("subject_id", "node_id")
    return last_by_id(one.select(
        "paper_id", key.alias("stable_id"), "subject_id", F.col("node_id").alias("dom_node_id"), F.lit(None).cast("string").alias("equation_id"), "start", "end", F.col("x.text").alias("text"),
        F.coalesce(given(F.col("section_id")), "node_id").alias("scope_id"),
    ), "scope_id")


def anchored_occurrences(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences in nodes(paper_id, section_id, node_id, text): surfaces that don't overlap, the earliest and longest first."""
    s = subject_surfaces(found).select("paper_id", F.col("subject_id").alias("subject"), "surface")
    hit = C.occurrences(nodes.select("paper_id", F.col("node_id").alias("node"), "text", "section_id"), s)
    key = occurrence_id("subject", "node")
    return hit.select("paper_id", key.alias("stable_id"), F.col("subject").alias("subject_id"), F.col("node").alias("dom_node_id"), F.lit(None).cast("string").alias("equation_id"), "start", "end", "text", F.col("section_id").alias("scope_id"))


def notation_occurrences(equations: DataFrame, notation: DataFrame) -> DataFrame:
    """Every literal place of an equation's symbols in its formula; different symbols may overlap."""
    e = equations.select("paper_id", "equation_id", "latex", F.explode("notation_ids").alias("subject_id"))
    n = notation.select("paper_id", F.col("stable_id").alias("subject_id"), "symbol", "scope_id")
    hit = e.join(n, ["paper_id", "subject_id"]).withColumn("start", F.explode(T.literal_starts(F.col("latex"), F.col("symbol")))).withColumn("end", F.col("start") + F.length("symbol"))
    key = occurrence_id("subject_id", "equation_id")
    return hit.select("paper_id", key.alias("stable_id"), "subject_id", F.lit(None).cast("string").alias("dom_node_id"), "equation_id", "start", "end", F.col("symbol").alias("text"), "scope_id")


def last_by_id(rows: DataFrame, *order: str) -> DataFrame:
    """One row for each (paper_id, stable_id): the last."""
    rest = [c for c in rows.columns if c not in ("paper_id", "stable_id")]
    return rows.groupBy("paper_id", "stable_id").agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("x")).select("paper_id", "stable_id", "x.*").select(*rows.columns)


def build(obs: DataFrame, nodes: DataFrame | None = None) -> Document:
    """The document of each paper; occurrences are anchored in nodes(paper_id, section_id, node_id, text), or without them in quotes."""
    found, evidence, facets = objects(obs)
    equations, notation, told = equations_and_notation(obs, found, evidence)
    equations, notation = written(equations, "equations"), written(notation, "notation")
    seen = quoted_occurrences(obs, found, evidence) if nodes is None else anchored_occurrences(nodes, found)
    seen = last_by_id(seen.select("paper_id", "stable_id", "subject_id", "dom_node_id", "equation_id", "start", "end", "text", "scope_id").unionByName(notation_occurrences(equations, notation)))
    return Document(obs, found, evidence, facets, relations(obs, found, evidence), equations, notation, told, explanations(found, facets, notation), seen)


def reanchored(d: Document, nodes: DataFrame) -> tuple[Document, DataFrame]:
    """The document with its occurrences found again in nodes, and (paper_id, before, after): how many there were and are."""
    seen = last_by_id(anchored_occurrences(nodes, d.objects).unionByName(notation_occurrences(d.equations, d.notation)))
    count = lambda x, name: x.groupBy("paper_id").agg(F.count(F.lit(1)).alias(name))
    both = count(d.occurrences, "before").join(count(seen, "after"), "paper_id", "full").na.fill(0, ["before", "after"])
    return Document(**{**d.__dict__, "occurrences": seen}), both


def subjects(d: Document) -> DataFrame:
    """(paper_id, subject_id, kind, label, aliases, roles, units, constraints, object_ids): objects, and symbols as kind notation."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    o = d.objects.select("paper_id", F.col("stable_id").alias("subject_id"), "kind", "label", "aliases", "roles", none("units", "string"), none("constraints", "array<string>"), none("object_ids", "array<string>"))
    n = d.notation.select("paper_id", F.col("stable_id").alias("subject_id"), F.lit("notation").alias("kind"), F.col("symbol").alias("label"), none("aliases", "array<string>"), none("roles", "array<string>"), "units", "constraints", "object_ids")
    return o.unionByName(n)


def explanation_index(d: Document) -> DataFrame:
    """(paper_id, subject_id, explanation): the last one for readers of medium expertise."""
    e = d.explanations.where("expertise = 'intermediate'")
    return e.groupBy("paper_id", "subject_id").agg(F.max_by("base_content", "stable_id").alias("explanation"))


def reading_order(evidence: DataFrame, obs: DataFrame, sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """evidence(paper_id, subject_id, observation_id) with ``place``: by section and node order, then character, then id; unknown
    sections come last, unknown nodes after the known ones. sections(paper_id, section_id, section_pos), nodes(paper_id,
    section_id, node_id, node_pos)."""
    o = obs.select("paper_id", F.col("id").alias("observation_id"), "section_id", "node_id", F.coalesce("char_start", F.lit(0)).alias("char_start"))
    s = sections.groupBy("paper_id", "section_id").agg(F.min("section_pos").alias("section_pos"))
    n = nodes.groupBy("paper_id", "section_id", "node_id").agg(F.min("node_pos").alias("node_pos"))
    e = evidence.join(o, ["paper_id", "observation_id"]).join(s, ["paper_id", "section_id"], "left").join(n, ["paper_id", "section_id", "node_id"], "left")
    w = Window.partitionBy("paper_id", "subject_id").orderBy(F.col("section_pos").asc_nulls_last(), F.coalesce("node_pos", F.lit(1_000_000)), "char_start", "observation_id")
    return e.withColumn("place", F.row_number().over(w))


def subject_evidence(d: Document) -> DataFrame:
    o = d.object_evidence.withColumnRenamed("object_id", "subject_id")
    return o.unionByName(d.notation_evidence.withColumnRenamed("notation_id", "subject_id"))


def subject_occurrences(d: Document, limit: int = 100) -> DataFrame:
    """Occurrences of each subject by place and start, at most ``limit`` (200 at most), with how many there are."""
    per = Window.partitionBy("paper_id", "subject_id")
    o = d.occurrences.withColumn("at", F.coalesce("dom_node_id", "equation_id"))
    o = o.withColumn("place", F.row_number().over(per.orderBy("at", "start", "stable_id"))).withColumn("total", F.count(F.lit(1)).over(per))
    return o.where(F.col("place") <= max(1, min(limit, 200))).drop("at")


def subject_details(d: Document, sections: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """(paper_id, subject_id, kind, label, explanation, occurrence_total, evidence, defining_equation): evidence is the first
    ``most`` observation ids in reading order."""
    e = reading_order(subject_evidence(d), d.observations, sections, nodes).where(F.col("place") <= most)
    e = e.groupBy("paper_id", "subject_id").agg(F.array_sort(F.collect_list(F.struct("place", "observation_id")))["observation_id"].alias("evidence"))
    total = d.occurrences.groupBy("paper_id", "subject_id").agg(F.count(F.lit(1)).alias("occurrence_total"))
    by = d.equations.where("defined_object_id is not null").groupBy("paper_id", F.col("defined_object_id").alias("subject_id")).agg(F.min_by("equation_id", "stable_id").alias("defining_equation"))
    out = subjects(d).select("paper_id", "subject_id", "kind", "label")
    for part in (explanation_index(d), total, e, by):
        out = out.join(part, ["paper_id", "subject_id"], "left")
    return out.na.fill(0, ["occurrence_total"])


def equation_details(d: Document) -> DataFrame:
    """(paper_id, equation_id, symbols, objects, defined, defined_explanation, defined_occurrences): what an equation refers to, by name."""
    key = ["paper_id", "equation_id"]
    own = d.equations.select(*key, "defined_object_id")
    label = subjects(d).select("paper_id", "subject_id", "label")
    per = lambda c, name: d.equations.select(*key, F.explode(c).alias("subject_id")).join(label, ["paper_id", "subject_id"]).groupBy(*key).agg(F.array_sort(F.collect_list("label")).alias(name))
    total = d.occurrences.groupBy("paper_id", "subject_id").agg(F.count(F.lit(1)).alias("defined_occurrences"))
    about = label.join(explanation_index(d), ["paper_id", "subject_id"], "left").join(total, ["paper_id", "subject_id"], "left")
    about = about.select("paper_id", F.col("subject_id").alias("defined_object_id"), F.col("label").alias("defined"), F.col("explanation").alias("defined_explanation"), "defined_occurrences")
    return own.join(per("notation_ids", "symbols"), key, "left").join(per("object_ids", "objects"), key, "left").join(about, ["paper_id", "defined_object_id"], "left").drop("defined_object_id")


def section_annotations(d: Document, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of the anchored occurrences of every section: (paper_id, scope_id, place, stable_id, subject_id, label, explanation, total)."""
    o = d.occurrences.where("dom_node_id is not null").join(subjects(d).select("paper_id", "subject_id", "label"), ["paper_id", "subject_id"])
    per = Window.partitionBy("paper_id", "scope_id")
    o = o.withColumn("place", F.row_number().over(per.orderBy("dom_node_id", "start", "stable_id"))).withColumn("total", F.count(F.lit(1)).over(per))
    o = o.where((F.col("place") > offset) & (F.col("place") <= offset + max(1, min(limit, 200)))).join(explanation_index(d), ["paper_id", "subject_id"], "left")
    return o.select("paper_id", "scope_id", "place", "stable_id", "subject_id", "label", "explanation", "total")


def glossary(d: Document, query: str = "", offset: int = 0, limit: int = 25) -> DataFrame:
    """(paper_id, place, subject_id, kind, tier, total): objects and symbols whose names equal the query (0), begin with it (1) or
    hold it (2), or whose explanation does (3); by tier, label and id, one page."""
    q = " ".join(query.casefold().split())
    s = subjects(d).join(explanation_index(d), ["paper_id", "subject_id"], "left")
    names = F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    tier = F.when(F.lit(q == "") | F.array_contains(names, q), 0).when(F.exists(names, lambda x: F.startswith(x, F.lit(q))), 1)
    tier = tier.when(F.exists(names, lambda x: F.contains(x, F.lit(q))), 2).when(F.contains(F.lower("explanation"), F.lit(q)), 3)
    per = Window.partitionBy("paper_id")
    s = s.withColumn("tier", tier).where("tier is not null").withColumn("total", F.count(F.lit(1)).over(per))
    s = s.withColumn("place", F.row_number().over(per.orderBy("tier", F.lower("label"), "subject_id"))).where((F.col("place") > offset) & (F.col("place") <= offset + max(1, min(limit, 50))))
    return s.select("paper_id", "place", "subject_id", F.when(F.col("kind") == "notation", "notation").otherwise("object").alias("kind"), "tier", "total")


def at_location(d: Document, section: str | None = None, node: str | None = None, equation: str | None = None) -> DataFrame:
    """(paper_id, id) of objects with one piece of evidence that lies in all the places given."""
    o = d.observations
    for column, value in (("section_id", section), ("node_id", node), ("equation_id", equation)):
        if value:
            o = o.where(F.col(column) == value)
    o = o.select("paper_id", F.col("id").alias("observation_id"))
    return d.object_evidence.join(o, ["paper_id", "observation_id"], "left_semi").select("paper_id", F.col("object_id").alias("id")).distinct()


def label_collisions(d: Document) -> DataFrame:
    """(paper_id, label, entity_ids, kinds): names that objects of several kinds share; of the names of the same objects the shortest."""
    names = d.objects.select("paper_id", "stable_id", "kind", F.explode(F.concat(F.array("label"), "aliases")).alias("name")).withColumn("norm", T.normalize_text("name")).where("norm <> ''")
    g = names.groupBy("paper_id", "norm").agg(F.array_sort(F.collect_set("stable_id")).alias("entity_ids"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min(F.struct(F.length("name").alias("n"), F.lower("name").alias("low"), "name")).alias("x"))
    g = g.where((F.size("entity_ids") >= 2) & (F.size("kinds") >= 2))
    return g.groupBy("paper_id", "entity_ids", "kinds").agg(F.min("x").alias("x")).select("paper_id", F.col("x.name").alias("label"), "entity_ids", "kinds")


def notation_measures(d: Document) -> DataFrame:
    """(paper_id, records, duplicates, several_meanings, reused): symbols, repeated signatures, glyphs with more than one meaning or
    scope, and records with more than one piece of evidence."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    s = d.notation.select("paper_id", F.regexp_replace(F.lower("symbol"), r"\s+", "").alias("g"), squeeze("meaning").alias("m"), squeeze("scope_id").alias("c"))
    sig = s.groupBy("paper_id", "g", "m", "c").agg(F.count(F.lit(1)).alias("n"))
    glyph = sig.groupBy("paper_id", "g").agg(F.sum("n").alias("records"), F.sum(F.col("n") - 1).alias("duplicates"), F.count(F.lit(1)).alias("kinds"))
    out = glyph.groupBy("paper_id").agg(F.sum("records").alias("records"), F.sum("duplicates").alias("duplicates"), F.sum((F.col("kinds") > 1).cast("long")).alias("several_meanings"))
    again = d.notation_evidence.groupBy("paper_id", "notation_id").agg(F.count(F.lit(1)).alias("n")).groupBy("paper_id").agg(F.sum((F.col("n") > 1).cast("long")).alias("reused"))
    return out.join(again, "paper_id", "left").na.fill(0, ["reused"])


def violations(d: Document) -> DataFrame:
    """(paper_id, rule, key): what the document must not have, rule by rule."""
    d = replace(d, relations=written(d.relations, "relations"), explanations=written(d.explanations, "explanations"), occurrences=written(d.occurrences, "occurrences"))
    out: list[DataFrame] = []

    def put(rule: str, rows: DataFrame, key: str) -> None:
        out.append(rows.select("paper_id", F.lit(rule).alias("rule"), F.col(key).alias("key")).distinct())

    def unknown(rule: str, refs: DataFrame, key: str, known: DataFrame, column: str) -> None:
        """refs(paper_id, key, ref) whose ref isn't among the column's values."""
        put(rule, refs.where("ref is not null").join(known.select("paper_id", F.col(column).alias("ref")), ["paper_id", "ref"], "left_anti"), key)

    tables = {"observation": (d.observations, "id")} | {n: (getattr(d, f), "stable_id") for n, f in (("object", "objects"), ("relation", "relations"), ("equation", "equations"), ("notation", "notation"), ("explanation", "explanations"), ("occurrence", "occurrences"))}
    for name, (rows, key) in tables.items():
        put(f"V1 repeated {name} id", rows.groupBy("paper_id", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)
    ref = lambda rows, key, c: rows.select("paper_id", key, F.col(c).alias("ref"))
    each = lambda rows, key, c: rows.select("paper_id", key, F.explode(c).alias("ref"))
    o, s = d.observations, subjects(d)
    unknown("V2 object evidence", ref(d.object_evidence, "object_id", "observation_id"), "object_id", o, "id")
    unknown("V2 facet evidence", ref(d.facets, "object_id", "observation_id"), "object_id", o, "id")
    unknown("V3 relation source", ref(d.relations, "stable_id", "source_id"), "stable_id", d.objects, "stable_id")
    unknown("V3 relation target", ref(d.relations, "stable_id", "target_id"), "stable_id", d.objects, "stable_id")
    unknown("V3 relation evidence", ref(d.relations, "stable_id", "evidence_id"), "stable_id", o, "id")
    unknown("V4 equation notation", each(d.equations, "stable_id", "notation_ids"), "stable_id", d.notation, "stable_id")
    unknown("V4 equation object", each(d.equations, "stable_id", "object_ids"), "stable_id", d.objects, "stable_id")
    unknown("V4 defined object", ref(d.equations, "stable_id", "defined_object_id"), "stable_id", d.objects, "stable_id")
    unknown("V5 equation evidence", ref(d.equations, "stable_id", "evidence_id"), "stable_id", o, "id")
    put("V6 several defining equations", d.equations.where("defined_object_id is not null").groupBy("paper_id", "defined_object_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "defined_object_id")
    unknown("V7 notation object", each(d.notation, "stable_id", "object_ids"), "stable_id", d.objects, "stable_id")
    unknown("V7 notation evidence", ref(d.notation_evidence, "notation_id", "observation_id"), "notation_id", o, "id")
    unknown("V8 explanation subject", ref(d.explanations, "stable_id", "subject_id"), "stable_id", s, "subject_id")
    unknown("V8 occurrence subject", ref(d.occurrences, "stable_id", "subject_id"), "stable_id", s, "subject_id")
    whole = out[0]
    for rows in out[1:]:
        whole = whole.union(rows)
    return whole


def metrics(d: Document) -> DataFrame:
    """(paper_id, name, n): how many rows each part has; what V9 compares with counts stored earlier."""
    count = lambda name, rows: rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).select("paper_id", F.lit(name).alias("name"), "n")
    whole = count("observations", d.observations)
    for name in ("objects", "relations", "equations", "notation", "explanations", "occurrences"):
        whole = whole.union(count(name, getattr(d, name)))
    return whole


def count_violations(d: Document, stored: DataFrame) -> DataFrame:
    """(paper_id, rule, key): V9: parts whose stored(paper_id, name, n) number isn't what there is."""
    now = metrics(d).withColumnRenamed("n", "now")
    both = stored.join(now, ["paper_id", "name"], "left").where(~F.col("n").eqNullSafe(F.coalesce("now", F.lit(0))))
    return both.select("paper_id", F.lit("V9 count").alias("rule"), F.col("name").alias("key"))
