"""Merging local observations of formulas, symbols, definitions and theorems into one graph of named nodes.

Rows that match are never paired with each other. Every rule of a match says that two rows share something: a name, a
formula, two words, a section and a word. What is shared is a key; the rows of a key are linked to its first row, and the
classes are the components of these links. Where a formula looks for a definition, the first ones of each key are kept
before anything is joined, as only the first can be chosen.

All tables have a paper_id and a ``pos``, the order of extraction, unique within the paper and kind:
definitions(term, definition_text, summary, is_formal, definition_number, section_id), formulas(label, latex, summary, section_id,
section_title, symbols: array of symbol, latex, context, role), symbols(symbol, latex, context, is_definition, section_id,
section_title), theorems(type, number, name), relationships(from_entity, to_entity, type, evidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import checkpointed, written
from .graph import components

#: Candidates that a formula is offered at most, and the least score of one (fixed values).
OFFERED, LEAST = 4, 2


def keyed(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(prefix), *[F.coalesce(p, F.lit("")) for p in parts])


def first_by(value: Column, order: Column) -> Column:
    """The first value that isn't null nor empty."""
    there = F.coalesce(value != "", F.lit(False))
    return F.min_by(F.when(there, value), F.when(there, order))


def longest(value: Column, order: Column) -> Column:
    """The longest value, the first of several."""
    return F.max_by(value, F.struct(F.length(F.coalesce(value, F.lit(""))).alias("n"), (-order).alias("o")))


def ordered_union(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group ..., name): the elements of rows(group ..., pos, name: array), each once, in the order of first appearance."""
    each = rows.select(*group, "pos", F.posexplode(name).alias("at", "value")).groupBy(*group, "value").agg(F.min(F.struct("pos", "at")).alias("o"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]).alias(name))


# -- one section: formulas and the definitions beside them, symbols and their only stray partner


def definition_keys(d: DataFrame, *group: str) -> DataFrame:
    """(group ..., key, definition): what a formula may share with definitions, with the first definition that has it. Merged definitions
    have the formulas of all their texts."""
    found = F.col("signatures") if "signatures" in d.columns else T.math_signatures(F.coalesce("definition_text", F.lit("")))
    keys = F.concat(F.array(keyed("t", T.legacy_text(F.col("term")))), F.transform(found, lambda s: keyed("m", s)))
    each = d.select(*group, F.explode(keys).alias("key"), "pos").where(~F.col("key").isin("t\x1f", "m\x1f"))
    return each.groupBy(*group, "key").agg(F.min("pos").alias("definition"))


def formula_keys() -> Column:
    return F.array(keyed("t", T.legacy_text(F.col("label"))), keyed("m", T.legacy_math(F.col("latex"))))


def attached_locally(formulas: DataFrame, definitions: DataFrame) -> DataFrame:
    """(paper_id, pos, definition): the first definition of a formula's section with its label or its formula; null without one."""
    at = lambda d: d.withColumn("section", F.coalesce("section_id", F.lit("")))
    first = definition_keys(at(definitions), "paper_id", "section")
    asked = at(formulas).select("paper_id", "section", "pos", F.explode(formula_keys()).alias("key"))
    return asked.join(first, ["paper_id", "section", "key"], "left").groupBy("paper_id", "pos").agg(F.min("definition").alias("definition"))


def lone_strays(symbols: DataFrame) -> DataFrame:
    """(paper_id, section, latex_key, stray, context): symbols that are alone in their section with their glyph."""
    s = symbols.select("paper_id", F.coalesce("section_id", F.lit("")).alias("section"), T.legacy_math(F.coalesce("latex", "symbol")).alias("latex_key"), "pos", "context").where("latex_key <> ''")
    g = s.groupBy("paper_id", "section", "latex_key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("stray"), F.min("context").alias("context"))
    return g.where("n = 1").drop("n")


def symbol_observations(symbols: DataFrame, formulas: DataFrame, parents: DataFrame) -> DataFrame:
    """Stray symbols and those of formulas as one table (paper_id, pos, symbol, latex, latex_key, context, scope_level, section_id,
    section_title, role, siblings, parent, concept, is_definition, symbol_key), strays first. parents(paper_id, pos, formula_id)
    names the merged formula of each. A symbol whose glyph one stray of the section alone has takes that one's key."""
    stray = symbols.select(
        "paper_id", F.struct(F.lit(0).alias("kind"), "pos", F.lit(0).alias("at")).alias("order"), "symbol", "latex", "context", F.lit("paper_level").alias("scope_level"), "section_id", "section_title",
        F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("siblings"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("concept"), "is_definition",
    )
    key = lambda s: T.legacy_math(F.coalesce(s["latex"], s["symbol"]))
    f = formulas.join(parents, ["paper_id", "pos"]).select("paper_id", "pos", "section_id", "section_title", "formula_id", F.filter(F.transform("symbols", key), lambda x: x != "").alias("keys"), F.posexplode("symbols").alias("at", "s"))
    inner = f.select(
        "paper_id", F.struct(F.lit(1).alias("kind"), "pos", "at").alias("order"), "s.symbol", "s.latex", "s.context", F.lit("formula_scoped").alias("scope_level"), "section_id", "section_title",
        T.formula_role(F.col("s.role")).alias("role"), F.filter("keys", lambda x: x != key(F.col("s"))).alias("siblings"), F.col("formula_id").alias("parent"), F.lit(None).cast("string").alias("concept"), F.lit(False).alias("is_definition"),
    )
    both = stray.unionByName(inner).withColumn("latex_key", T.legacy_math(F.coalesce("latex", "symbol"))).withColumn("section", F.coalesce("section_id", F.lit("")))
    lone = lone_strays(symbols).select("paper_id", "section", "latex_key", F.col("context").alias("stray_context"))
    both = both.join(lone, ["paper_id", "section", "latex_key"], "left")
    text = T.legacy_text(F.coalesce("stray_context", "context"))
    both = both.withColumn("symbol_key", F.concat_ws("|", "latex_key", text)).where("symbol_key <> '|'").drop("section", "stray_context")
    # one number for the order: strays, then formulas and their symbols
    return both.withColumn("pos", F.shiftleft(F.col("order.kind").cast("long"), 52) + F.shiftleft(F.col("order.pos").cast("long"), 16) + F.col("order.at")).drop("order")


# -- classes of symbols and definitions


def symbol_keys() -> Column:
    """What two symbols with one glyph share if they are the same one."""
    c, title, siblings = F.col("context"), F.col("section_title"), F.col("siblings")
    words, telling, titled = F.array_sort(T.word_set(c)), T.significant_words(c), T.significant_words(title)
    each = lambda xs, f: F.transform(F.coalesce(xs, F.array().cast("array<string>")), f)
    when = lambda ok, keys: F.when(F.coalesce(ok, F.lit(False)), keys).otherwise(F.array().cast("array<string>"))
    role, concept, scope = F.col("role"), F.col("concept"), F.col("scope_level")
    cross = lambda xs, ys, f: F.flatten(each(xs, lambda x: each(ys, lambda y: f(x, y))))
    rules = [
        F.array(keyed("text", T.legacy_text(c)), keyed("key", F.col("symbol_key"))),
        F.flatten(each(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: keyed("two words", a, b)))),
        when(concept != "", F.concat(when(role != "", F.array(keyed("concept and role", concept, role))), each(siblings, lambda s: keyed("concept and sibling", concept, s)), each(telling, lambda t: keyed("concept and word", concept, t)))),
        when(F.col("parent") != "", F.array(keyed("formula", F.col("parent")))),
        when((scope == "formula_scoped") & (role != ""), each(siblings, lambda s: keyed("role and sibling", role, s))),
        when(role != "", each(titled, lambda t: keyed("role and title", scope, role, t))),
        cross(titled, telling, lambda x, y: keyed("title and word", x, y)),
        each(telling, lambda t: keyed("section and word", F.col("section_id"), t)),
    ]
    return F.when(F.col("latex_key") == "", F.array(keyed("key", F.col("symbol_key")))).otherwise(F.array_distinct(F.concat(*rules)))


def classes(rows: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """(paper_id, pos, first): the class of each of rows(paper_id, pos), named by its first row: all that share a key of
    keys(group ..., pos, key), directly or through others."""
    lead = keys.groupBy(*group, "key").agg(F.min("pos").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = keys.join(lead, [*group, "key"]).where("pos <> lead").select("paper_id", F.col("pos").alias("source_id"), F.col("lead").alias("target_id")).distinct()
    found = components(rows.select("paper_id", F.col("pos").alias("id")), written(links, "links"))
    return found.select("paper_id", F.col("id").alias("pos"), F.col("component").alias("first"))


def symbol_classes(observations: DataFrame) -> DataFrame:
    keys = observations.select("paper_id", "latex_key", "pos", F.explode(symbol_keys()).alias("key"))
    return classes(observations, written(keys, "symbol-keys"), ["paper_id", "latex_key"])


def definition_classes(definitions: DataFrame, overlap: int = 3) -> DataFrame:
    """Definitions of one term that share a formula, or ``overlap`` words of their summaries (or texts, without one).

    Texts with as many words in common share one of all but their ``overlap`` - 1 most frequent words; equal texts are compared once.
    """
    said = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.col("definition_text"))
    d = definitions.select("paper_id", "pos", T.legacy_text(F.col("term")).alias("term"), T.math_signatures(F.coalesce("definition_text", F.lit(""))).alias("signatures"), F.array_sort(T.word_set(said)).alias("words"))
    d = written(d, "definitions").where("term <> ''")
    group = ["paper_id", "term"]
    keys = d.select(*group, "pos", F.explode("signatures").alias("s")).select(*group, "pos", keyed("m", F.col("s")).alias("key"))
    long_enough = d.where(F.size("words") >= overlap)
    same = long_enough.select(*group, "pos", keyed("w", F.array_join("words", " ")).alias("key"))
    texts = written(long_enough.groupBy(*group, "words").agg(F.min("pos").alias("pos")), "texts")
    df = texts.select("paper_id", F.explode("words").alias("word")).groupBy("paper_id", "word").count()
    ranked = texts.select(*group, "pos", F.explode("words").alias("word")).join(df, ["paper_id", "word"])
    rare = Window.partitionBy(*group, "pos").orderBy("count", "word")
    prefix = ranked.withColumn("k", F.row_number().over(rare)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group, "pos"))).where(F.col("k") <= F.col("n") - overlap + 1).select(*group, "pos", "word")
    pairs = prefix.join(prefix.withColumnRenamed("pos", "other"), [*group, "word"]).where("pos < other").select(*group, "pos", "other").distinct()
    pairs = pairs.join(texts.select(*group, "pos", "words"), [*group, "pos"]).join(texts.select(*group, F.col("pos").alias("other"), F.col("words").alias("others")), [*group, "other"])
    pairs = pairs.where(F.size(F.array_intersect("words", "others")) >= overlap)
    links = pairs.select(*group, F.explode(F.array("pos", "other")).alias("pos"), F.concat_ws("\x1f", F.lit("p"), "pos", "other").alias("key"))
    found = classes(d, written(keys.union(same).union(links.select(*group, "pos", "key")), "definition-keys"), group)
    blank = definitions.where(T.legacy_text(F.col("term")) == "").select("paper_id", "pos", F.col("pos").alias("first"))
    return found.unionByName(blank)


# -- merged rows


def merged_formulas(formulas: DataFrame, local: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, parents): formulas with one label, or formula, or summary, are one; of texts the longest stays, of labels all are aliases.
    parents(paper_id, pos, formula_id) leads each observation to it. local is ``attached_locally``."""
    key = F.coalesce(*[F.when(k != "", k) for k in (T.legacy_text(F.col("label")), T.legacy_math(F.col("latex")), T.legacy_text(F.col("summary")))])
    term = definitions.select("paper_id", F.col("pos").alias("definition"), F.col("term").alias("attached_term"))
    f = formulas.withColumn("key", key).where("key is not null").join(local, ["paper_id", "pos"], "left").join(term, ["paper_id", "definition"], "left")
    pos, group = F.col("pos"), ["paper_id", "key"]
    there = lambda c: F.when(F.col(c) != "", F.col(c))
    m = f.groupBy(*group).agg(
        F.min("pos").alias("pos"), F.min_by(F.coalesce(there("label"), there("latex"), F.col("key")), "pos").alias("name"), F.min_by(F.coalesce(there("label"), "latex"), "pos").alias("label"), longest(F.col("latex"), pos).alias("latex"), longest(F.col("summary"), pos).alias("summary"),
        F.min_by("section_id", "pos").alias("section_id"), F.min_by("section_title", "pos").alias("section_title"), first_by(F.col("attached_term"), pos).alias("attached_term"),
    )
    m = m.withColumn("formula_id", F.concat(F.lit("formula_"), T.sanitize_id(F.col("name")))).drop("name")
    aliases = ordered_union(f.where("label <> ''").withColumn("aliases", F.array("label")), group, "aliases")
    m = written(m.join(aliases, group, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), "formulas")
    return m, f.select("paper_id", "pos", "key").join(m.select(*group, "formula_id"), group).select("paper_id", "pos", "formula_id")


def merged_symbols(observations: DataFrame, found: DataFrame) -> DataFrame:
    """One symbol for each class of observations: the first one's names and place, the longest context, what others add."""
    o = observations.join(found, ["paper_id", "pos"])
    pos, group = F.col("pos"), ["paper_id", "first"]
    m = o.groupBy(*group).agg(
        *[F.min_by(c, "pos").alias(c) for c in ("symbol", "latex", "latex_key", "section_id", "scope_level")], longest(F.col("context"), pos).alias("context"), F.max(F.coalesce("is_definition", F.lit(False))).alias("is_definition"),
        *[first_by(F.col(c), pos).alias(c) for c in ("section_title", "role", "concept")],
    )
    siblings = ordered_union(o, group, "siblings")
    parents = ordered_union(o.where("parent is not null").withColumn("parents", F.array("parent")), group, "parents")
    empty = F.array().cast("array<string>")
    m = m.join(siblings, group, "left").join(parents, group, "left").withColumn("siblings", F.coalesce("siblings", empty)).withColumn("parents", F.coalesce("parents", empty))
    name = F.concat_ws("|", F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), "latex"), "section_id", F.col("first").cast("string"))
    return m.withColumn("id", F.concat(F.lit("symbol_"), T.sanitize_id(name))).withColumnRenamed("first", "pos")


def merged_definitions(definitions: DataFrame, found: DataFrame) -> DataFrame:
    """One definition for each class: the first one's term and place, the longest texts, formal if one is, all formulas."""
    d = definitions.join(found, ["paper_id", "pos"]).withColumn("signatures", T.math_signatures(F.coalesce("definition_text", F.lit(""))))
    pos, group = F.col("pos"), ["paper_id", "first"]
    m = d.groupBy(*group).agg(
        F.min_by("term", "pos").alias("term"), F.min_by("section_id", "pos").alias("section_id"), longest(F.col("summary"), pos).alias("summary"), longest(F.col("definition_text"), pos).alias("definition_text"),
        F.max(F.coalesce("is_formal", F.lit(False))).alias("is_formal"), first_by(F.col("definition_number"), pos).alias("definition_number"),
    )
    return m.join(ordered_union(d, group, "signatures"), group, "left").withColumn("signatures", F.coalesce("signatures", F.array().cast("array<string>"))).withColumnRenamed("first", "pos")


def merged_clusters(symbols: DataFrame, clusters: DataFrame) -> DataFrame:
    """symbols after clusters(paper_id, id, cluster) of them became one each: that with the longest context, then most formulas,
    then the first; its lists go first, the others' behind. Ids that aren't there, and clusters of one, change nothing; an id in
    several clusters is in the first."""
    own = clusters.groupBy("paper_id", "id").agg(F.min("cluster").alias("cluster"))
    s = symbols.join(own, ["paper_id", "id"], "left").withColumn("cluster", F.coalesce(F.concat(F.lit("c"), F.col("cluster").cast("string")), F.concat(F.lit("s"), "id")))
    group = ["paper_id", "cluster"]
    best = s.groupBy(*group).agg(F.max_by(F.struct("id", "pos"), F.struct(F.length(F.coalesce("context", F.lit(""))).alias("n"), F.size("parents").alias("m"), (-F.col("pos")).alias("o"))).alias("best"))
    s = written(s.join(best, group), "clustered")
    first = F.col("id") == F.col("best.id")
    m = s.groupBy(*group).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("id", "pos", "symbol", "latex", "latex_key", "section_id", "scope_level", "role", "context")], F.max("is_definition").alias("is_definition"),
        *[first_by(F.col(c), F.struct((~first).alias("a"), "pos")).alias(c) for c in ("section_title", "concept")],
    )
    turned = s.withColumn("pos", F.struct((~first).alias("a"), "pos"))
    empty = F.array().cast("array<string>")
    for name in ("siblings", "parents"):
        m = m.join(ordered_union(turned, group, name), group, "left").withColumn(name, F.coalesce(name, empty))
    return m.select(*symbols.columns)


# -- formulas and definitions across the paper


def match_score(term: Column, said: Column, signatures: Column, label: Column, latex: Column, summary: Column) -> Column:
    """How well a definition and a formula fit: 4 for the same name or 2 for a telling word of it, 3 for the formula, 2 for two words of the
    summaries or 1 for a telling one."""
    telling = lambda a, b: T.overlap_at_least(T.significant_words(a), T.significant_words(b), 1)
    named = F.when(F.coalesce(label, F.lit("")) == "", 0).when(T.legacy_text(term) == T.legacy_text(label), 4).when(telling(term, label), 2).otherwise(0)
    math = T.legacy_math(latex)
    shared = F.when((math != "") & F.array_contains(signatures, math), 3).otherwise(0)
    words = F.when(T.overlap_at_least(T.word_set(said), T.word_set(summary), 2), 2).when(telling(said, summary), 1).otherwise(0)
    return named + shared + words


def said_of(d: DataFrame) -> DataFrame:
    said = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.col("definition_text"))
    return d.select("paper_id", F.col("pos").alias("definition"), "term", "signatures", said.alias("said"))


def scored_pairs(formulas: DataFrame, definitions: DataFrame) -> DataFrame:
    """(paper_id, pos, definition, score) of merged formulas and definitions that may be offered: all pairs that share a name, a telling
    word of the names, or a formula; of those that share two words of their summaries only, score 2, the first ones.

    Each pair of words keeps its first definitions, as many as are offered: a later one is never among the first ones of all.
    """
    f = formulas.select("paper_id", "pos", "label", "latex", "summary")
    d = said_of(definitions)
    telling = lambda c: F.transform(T.significant_words(F.col(c)), lambda w: keyed("w", w))
    ours = F.concat(formula_keys(), telling("label"))
    theirs = F.concat(F.array(keyed("t", T.legacy_text(F.col("term")))), F.transform("signatures", lambda s: keyed("m", s)), telling("term"))
    blank = ["t\x1f", "m\x1f"]
    left = f.select("paper_id", "pos", F.explode(F.array_distinct(ours)).alias("key")).where(~F.col("key").isin(blank))
    right = d.select("paper_id", "definition", F.explode(F.array_distinct(theirs)).alias("key")).where(~F.col("key").isin(blank))
    strong = left.join(right, ["paper_id", "key"]).select("paper_id", "pos", "definition").distinct()

    def couples(c: str) -> Column:
        words = F.array_sort(T.word_set(F.col(c)))
        return F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))

    by_place = Window.partitionBy("paper_id", "key").orderBy("definition")
    first = d.select("paper_id", "definition", F.explode(couples("said")).alias("key")).withColumn("k", F.row_number().over(by_place)).where(F.col("k") <= OFFERED).drop("k")
    weak = f.select("paper_id", "pos", F.explode(couples("summary")).alias("key")).join(first, ["paper_id", "key"]).select("paper_id", "pos", "definition").distinct()
    offered = Window.partitionBy("paper_id", "pos").orderBy("definition")
    weak = weak.withColumn("k", F.row_number().over(offered)).where(F.col("k") <= OFFERED).drop("k")
    pairs = strong.union(weak).distinct().join(f, ["paper_id", "pos"]).join(d, ["paper_id", "definition"])
    score = match_score(F.col("term"), F.col("said"), F.col("signatures"), F.col("label"), F.col("latex"), F.col("summary"))
    return pairs.select("paper_id", "pos", "definition", score.cast("int").alias("score"))


def attached(formulas: DataFrame, definitions: DataFrame) -> DataFrame:
    """(paper_id, pos, definition, source, reason, score) of merged formulas that find a definition: the one they had from their section, else
    the first of their name, else the first with their formula, else the first with a score of 4."""
    f, d = formulas, definitions
    first = definition_keys(d, "paper_id")
    had = f.where("attached_term <> ''").select("paper_id", "pos", keyed("t", T.legacy_text(F.col("attached_term"))).alias("key")).join(first, ["paper_id", "key"])
    had = had.select("paper_id", "pos", "definition", F.lit("local_reconciliation").alias("source"), F.lit("same_section_label_or_math_match").alias("reason"), F.lit(None).cast("int").alias("score"))
    open_ = f.where("coalesce(attached_term, '') = ''")
    asked = open_.select("paper_id", "pos", F.explode(formula_keys()).alias("key")).join(first, ["paper_id", "key"])
    rank = lambda n: F.struct(F.lit(n).alias("rank"), "definition")
    found = asked.select("paper_id", "pos", F.when(F.startswith("key", F.lit("t")), rank(0)).otherwise(rank(1)).alias("x"))
    scored = scored_pairs(open_, d)
    found = found.union(scored.where("score >= 4").select("paper_id", "pos", rank(2)))
    best = found.groupBy("paper_id", "pos").agg(F.min("x").alias("x")).select("paper_id", "pos", "x.rank", "x.definition")
    whole = best.join(open_.select("paper_id", "pos", "label", "latex", "summary"), ["paper_id", "pos"]).join(said_of(d), ["paper_id", "definition"])
    score = match_score(F.col("term"), F.col("said"), F.col("signatures"), F.col("label"), F.col("latex"), F.col("summary"))
    reason = F.element_at(F.array(*map(F.lit, ["exact_term_match", "shared_math_signature", "multi_signal_match"])), F.col("rank") + 1)
    return had.union(whole.select("paper_id", "pos", "definition", F.lit("deterministic_match"), reason, score.cast("int")))


def definition_buckets(formulas: DataFrame, definitions: DataFrame, done: DataFrame) -> DataFrame:
    """(paper_id, pos, place, definition, score): what formulas without a definition (not in done(paper_id, pos)) are offered: at most four
    with a score of 2 at least and no more than 1 below the best, in order of score and place. For a person, or a model, to choose from."""
    left = formulas.join(done.select("paper_id", "pos"), ["paper_id", "pos"], "left_anti")
    best = Window.partitionBy("paper_id", "pos").orderBy(F.desc("score"), "definition")
    top = scored_pairs(left, definitions).where(F.col("score") >= LEAST).withColumn("place", F.row_number().over(best)).where(F.col("place") <= OFFERED)
    most = F.max("score").over(Window.partitionBy("paper_id", "pos"))
    return top.withColumn("most", most).where(F.col("score") >= F.greatest(F.lit(LEAST), F.col("most") - 1)).select("paper_id", "pos", "place", "definition", "score")


def symbol_buckets(symbols: DataFrame) -> DataFrame:
    """(paper_id, latex_key, id): glyphs that two to four merged symbols have, with these."""
    n = symbols.where("latex_key <> ''").groupBy("paper_id", "latex_key").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 4")
    return symbols.join(n, ["paper_id", "latex_key"]).select("paper_id", "latex_key", "id")


def propagated(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, id, value, depth) of all that values(paper_id, id, value) reach along edges(paper_id, source_id, target_id, pos).

    A node without a value takes that of the first edge from one that has it; then it hands it on. Rounds go on until none takes a
    value; as nothing is taken twice, cycles end too. Null and empty values are none.
    """
    known = checkpointed(values.where("value <> ''").groupBy("paper_id", "id").agg(F.min("value").alias("value")).withColumn("depth", F.lit(0)))
    e = edges.select("paper_id", F.col("source_id").alias("id"), F.col("target_id").alias("to"), "pos")
    depth = 0
    while True:
        depth += 1
        new = known.where(F.col("depth") == depth - 1).join(e, ["paper_id", "id"]).join(known.select("paper_id", F.col("id").alias("to")), ["paper_id", "to"], "left_anti")
        new = checkpointed(new.groupBy("paper_id", F.col("to").alias("id")).agg(F.min_by("value", F.struct("pos", "id")).alias("value")).withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return known
        known = checkpointed(known.union(new))


def scoped(symbols: DataFrame, formulas: DataFrame) -> DataFrame:
    """merged symbols with the scope of the first of their formulas that has one: its definition's term, its label, or itself."""
    there = lambda c: F.when(F.col(c) != "", F.col(c))
    of = formulas.groupBy("paper_id", F.col("formula_id").alias("id")).agg(F.max_by(T.legacy_text(F.coalesce(there("attached_term"), there("label"), "latex")), "pos").alias("value"))
    edges = symbols.select("paper_id", F.col("id").alias("target_id"), F.posexplode("parents").alias("pos", "source_id"))
    got = propagated(of, edges).where("depth = 1").select("paper_id", "id", F.col("value").alias("scope"))
    s = symbols.join(got, ["paper_id", "id"], "left")
    return s.withColumn("concept", F.coalesce("scope", "concept")).withColumn("scope_level", F.when(F.col("scope").isNotNull(), "formula_scoped").otherwise(F.col("scope_level"))).drop("scope")


# -- the graph


def definition_id(term: Column) -> Column:
    return F.concat(F.lit("def_"), T.sanitize_id(term))


def graph_nodes(formulas: DataFrame, symbols: DataFrame, definitions: DataFrame, theorems: DataFrame) -> DataFrame:
    """(paper_id, id, type, label): one node for each id; formulas come before symbols, definitions and theorems, then order decides."""
    row = lambda d, rank, key, kind, label: d.select("paper_id", key.alias("id"), F.struct(F.lit(rank).alias("rank"), "pos").alias("o"), F.lit(kind).alias("type"), label.alias("label"))
    all_ = row(formulas, 0, F.col("formula_id"), "formula", F.coalesce("label", "latex")).union(row(symbols, 1, F.col("id"), "symbol", F.col("symbol")))
    all_ = all_.union(row(definitions, 2, definition_id(F.col("term")), "definition", F.col("term"))).union(row(theorems, 3, F.concat(F.lit("thm_"), "number"), "theorem", F.concat_ws(" ", F.initcap("type"), "number")))
    return all_.groupBy("paper_id", "id").agg(F.min_by(F.struct("type", "label"), "o").alias("x")).select("paper_id", "id", "x.*")


def name_index(formulas: DataFrame, symbols: DataFrame, definitions: DataFrame, theorems: DataFrame) -> DataFrame:
    """(paper_id, name, id): all names of all nodes, each leading to the first: formulas, symbols, definitions, theorems, each in order.
    A theorem's number is a name as it stands, all others without regard to case."""
    row = lambda d, rank, names, key: d.select("paper_id", F.explode(names).alias("name"), F.struct(F.lit(rank).alias("rank"), "pos").alias("o"), key.alias("id"))
    low = lambda *c: F.transform(F.array(*c), F.lower)
    i = row(formulas, 0, F.concat(low("label", "latex"), F.transform("aliases", F.lower)), F.col("formula_id")).union(row(symbols, 1, low("symbol", "latex"), F.col("id")))
    i = i.union(row(definitions, 2, low("term"), definition_id(F.col("term"))))
    i = i.union(row(theorems, 3, F.array(F.lower(F.concat_ws(" ", "type", "number")), F.concat(F.lit("\x1f"), "number")), F.concat(F.lit("thm_"), "number")))
    return i.where("name is not null").groupBy("paper_id", "name").agg(F.min_by(F.struct("o", "id"), "o").alias("x")).select("paper_id", "name", "x.o", "x.id")


def resolved(names: DataFrame, index: DataFrame) -> DataFrame:
    """names(paper_id, name, ...) with ``id``: by the index, without a name there the sanitised name itself."""
    keys = F.array(F.lower("name"), F.concat(F.lit("\x1f"), "name"))
    each = names.select("paper_id", "name").distinct().select("paper_id", "name", F.explode(keys).alias("key")).join(index.withColumnRenamed("name", "key"), ["paper_id", "key"])
    best = each.groupBy("paper_id", "name").agg(F.min_by("id", "o").alias("found"))
    return names.join(best, ["paper_id", "name"], "left").withColumn("id", F.coalesce("found", T.sanitize_id(F.col("name")))).drop("found")


def graph_edges(nodes: DataFrame, index: DataFrame, formulas: DataFrame, symbols: DataFrame, definitions: DataFrame, relationships: DataFrame) -> DataFrame:
    """(paper_id, id, source, target, type, evidence): definitions to their formulas, formulas to their symbols, and the stated relationships whose
    two ends are nodes and not one; of equal ones the first."""
    terms = definitions.groupBy("paper_id", T.legacy_text(F.col("term")).alias("key")).agg(F.max_by(definition_id(F.col("term")), "pos").alias("source"))
    f = formulas.select("paper_id", "pos", F.col("formula_id").alias("target"), T.legacy_text(F.col("attached_term")).alias("key"), "reason")
    order = lambda rank: F.struct(F.lit(rank).alias("rank"), "pos").alias("o")
    one = f.where("key <> ''").join(terms, ["paper_id", "key"]).select("paper_id", "source", "target", F.lit("defines").alias("type"), F.coalesce("reason", F.lit("Definition linked to its formula representation")).alias("evidence"), order(0))
    known = formulas.select("paper_id", F.col("formula_id").alias("source")).distinct()
    two = symbols.select("paper_id", "pos", F.explode("parents").alias("source"), F.col("id").alias("target")).join(known, ["paper_id", "source"], "left_semi")
    two = two.select("paper_id", "source", "target", F.lit("has_symbol").alias("type"), F.lit("Symbol extracted as part of formula context").alias("evidence"), order(1))
    r = resolved(relationships.withColumn("name", F.col("from_entity")), index).withColumnRenamed("id", "source")
    r = resolved(r.withColumn("name", F.col("to_entity")), index).withColumnRenamed("id", "target").where("source <> target")
    ids = nodes.select("paper_id", "id")
    r = r.join(ids.withColumnRenamed("id", "source"), ["paper_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["paper_id", "target"], "left_semi")
    every = one.union(two).union(r.select("paper_id", "source", "target", "type", "evidence", order(2)))
    first = every.groupBy("paper_id", "source", "target", "type").agg(F.min_by("evidence", "o").alias("evidence"))
    return first.select("paper_id", F.concat("source", F.lit("_to_"), "target", F.lit("_"), "type").alias("id"), "source", "target", "type", "evidence")


def entity_counts(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_count, formula_count, symbol_count, definition_count, theorem_count)."""
    return nodes.groupBy("paper_id").agg(F.count(F.lit(1)).alias("node_count"), *[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in ("formula", "symbol", "definition", "theorem")])
