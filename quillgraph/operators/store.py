"""Changes of stored tables, as the table after the change: nothing is edited in place, and a change is one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import document as D
from . import injection


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """The rows whose columns have the values; null is a value."""
    for c, v in values.items():
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
    return rows


def newest(rows: DataFrame, at: str = "created_at", key: str = "id") -> DataFrame:
    """rows with ``place``, the latest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc(at), key)))


def insert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """rows and those of new whose key isn't there yet, once each; columns that new lacks are null."""
    fresh = new.join(rows.select(key), key, "left_anti").dropDuplicates([key])
    return rows.unionByName(fresh, allowMissingColumns=True)


def update(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """rows in which the values given in changes(key, columns) replace the old ones; nulls change nothing. A note of an entity
    whose content is given is one that its reader wrote (is_user_override)."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    j = rows.join(new, key, "left")
    out = {c: F.coalesce(f"new_{c}", c) for c in columns}
    if "content" in columns and {"entity_id", "is_user_override"} <= set(rows.columns):
        out["is_user_override"] = F.when(F.col("new_content").isNotNull() & F.col("entity_id").isNotNull(), F.lit(True)).otherwise(F.col("is_user_override"))
    return j.select(*[out[c].alias(c) if c in out else c for c in rows.columns])


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows without those that have the keys' values in all of the keys' columns."""
    return rows.join(keys.distinct(), keys.columns, "left_anti")


def delete_papers(papers: DataFrame, parts: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """papers and what hangs on them without the papers in gone(paper_id)."""
    return delete(papers, gone.select("paper_id")), {k: delete(v, gone.select("paper_id")) for k, v in parts.items()}


def delete_note(notes: DataFrame, pages: DataFrame, entity: str, node: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Without an entity's notes and anchors; with a node, its notes stay and the anchors in that node go."""
    return notes if node else notes.where(~F.col("entity_id").eqNullSafe(F.lit(entity))), injection.remove(pages, entity, node)


def replaced_suggestions(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Suggestions after another run: of the papers in new the generated ones go, those made by hand stay."""
    old = rows.where("is_ai_generated").join(new.select("paper_id").distinct(), "paper_id", "left_anti")
    return rows.where("not coalesce(is_ai_generated, false)").unionByName(old).unionByName(new.withColumn("is_ai_generated", F.lit(True)), allowMissingColumns=True)


def by_hand(rows: DataFrame) -> DataFrame:
    """Suggestions made by hand, with an id of their own, drawn once."""
    return written(rows.withColumn("entity_id", F.concat(F.lit("manual_"), F.expr("uuid()"))).withColumn("is_ai_generated", F.lit(False)), "by-hand")


def unknown_types(asked: list[str]) -> list[str]:
    """The types that suggestions can't be asked for."""
    return sorted(set(asked) - {*D.KINDS, "notation"})


def suggestion_candidates(d: D.Document, types: list[str] | None = None, chosen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(paper_id, entity_id, entity_type, entity_label, tooltip_content, evidence, occurrences): objects and symbols with an explanation, of
    the types, and how many pieces of evidence and occurrences they have.

    ``chosen`` narrows them for a reader; where it fails, all stay.
    """
    if types and (bad := unknown_types(types)):
        raise ValueError(f"unknown types {bad}; there are {sorted([*D.KINDS, 'notation'])}")
    s = D.subjects(d).join(D.explanation_index(d), ["paper_id", "subject_id"])
    s = s.where(F.col("kind").isin(types)) if types else s
    count = lambda rows, name: rows.groupBy("paper_id", "subject_id").agg(F.count(F.lit(1)).alias(name))
    s = s.join(count(D.subject_evidence(d), "evidence"), ["paper_id", "subject_id"], "left").join(count(d.occurrences, "occurrences"), ["paper_id", "subject_id"], "left").na.fill(0, ["evidence", "occurrences"])
    text = F.coalesce(D.given(F.col("explanation")), F.col("label"))
    out = s.select("paper_id", F.col("subject_id").alias("entity_id"), F.col("kind").alias("entity_type"), F.col("label").alias("entity_label"), text.alias("tooltip_content"), "evidence", "occurrences")
    if chosen is None:
        return out
    try:
        return chosen(out)
    except Exception:  # a reader's filter is a plug-in: it must not lose suggestions
        return out


def tooltip_text(kind: Column, label: Column, summary: Column, latex: Column, definition: Column, statement: Column, context: Column) -> Column:
    """What a tooltip of an older graph says, by type: formulas, symbols, definitions, theorems, others."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    name = F.coalesce(label, latex, F.lit("Formula"))
    formula = F.when(has(summary) & has(latex) & (latex != name), F.concat(name, F.lit(": "), summary, F.lit("\n\nFormula: "), latex)).when(has(summary), F.concat(name, F.lit(": "), summary)).when(has(latex), F.concat(F.lit("Formula: "), latex)).otherwise(name)
    symbol = F.when(has(context), context).otherwise(F.concat(F.lit("Mathematical symbol: "), F.coalesce(label, F.lit(""))))
    whole = F.when(has(summary) & has(definition), F.concat(summary, F.lit("\n\nFull definition: "), definition)).when(has(summary), summary).when(has(definition), definition).otherwise(F.concat(F.lit("Definition of "), F.coalesce(label, F.lit(""))))
    said = F.concat(F.coalesce(label, F.lit("Theorem")), F.lit(": "))
    short = has(statement) & (F.length(statement) < 200)
    theorem = F.when(has(summary), F.concat(said, summary, F.when(short, F.concat(F.lit("\n\nStatement: "), statement)).otherwise(""))).when(has(statement), F.concat(said, statement)).otherwise(F.coalesce(label, F.lit("Theorem")))
    return F.when(kind == "symbol", symbol).when(kind == "formula", formula).when(kind == "definition", whole).when(kind == "theorem", theorem).otherwise(F.coalesce(context, summary, label, F.lit("See knowledge graph")))


def facet_text(kind: Column, label: Column, facets: Column) -> Column:
    """What a tooltip says by facets (array of kind, text, summary, latex, roles), null where they say nothing: formulas by their summary and
    formula, symbols by their roles, others by the first text."""
    given = lambda c: F.when(c != "", c)
    last = lambda name: F.get(F.filter(facets, lambda f: f["kind"] == name), F.size(F.filter(facets, lambda f: f["kind"] == name)) - 1)
    formula, name = last("formula"), F.coalesce(label, F.lit("Formula"))
    summary, latex = given(formula["summary"]), given(formula["latex"])
    told = F.when(summary.isNotNull() & latex.isNotNull(), F.concat(name, F.lit(": "), summary, F.lit("\n\nFormula: "), latex)).otherwise(F.coalesce(summary, latex, name))
    roles = F.coalesce(given(F.array_join(last("symbol_scope")["roles"], "; ")), F.concat(F.lit("Mathematical symbol: "), F.coalesce(label, F.lit(""))))
    first = F.get(F.filter(F.transform(facets, lambda f: f["text"]), lambda t: t != ""), F.lit(0))
    return F.when(F.size(facets) > 0, F.when(kind == "formula", told).when(kind == "symbol", roles).otherwise(first))


# Fixed value: the order of types in a menu; others follow by name.
MENU = ["definition", "theorem", "formula", "symbol", "other"]


def suggestion_menu(rows: DataFrame) -> DataFrame:
    """(paper_id, top, top_place, type, label, place, n): suggestions made by hand, then generated ones, by type."""
    kind = F.lower("entity_type")
    g = rows.groupBy("paper_id", F.when(F.coalesce("is_ai_generated", F.lit(False)), "ai").otherwise("manual").alias("top"), kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(F.array(*map(F.lit, MENU)), F.col("type"))
    w = Window.partitionBy("paper_id", "top").orderBy(F.when(at > 0, at).otherwise(len(MENU) + 1), "type")
    label = F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)"))
    return g.select("paper_id", "top", F.when(F.col("top") == "manual", 0).otherwise(1).alias("top_place"), "type", label.alias("label"), F.row_number().over(w).alias("place"), "n")


def resolved_occurrences(suggestions: DataFrame, requested: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, without): for suggestions(paper_id, entity_id, label, place) the requested ones of those that have any, else the document's
    known ones; an occurrence comes once, by the first suggestion. ``without`` are the suggestions that have none.

    requested and known: (paper_id, entity_id, stable_id, dom_node_id, start, end, text).
    """
    key = ["paper_id", "entity_id"]
    cols = [*key, "stable_id", "dom_node_id", "start", "end", "text"]
    own = requested.where("dom_node_id is not null").select(*cols).join(suggestions.select(*key), key, "left_semi")
    rest = known.where("dom_node_id is not null").select(*cols).join(suggestions.select(*key), key, "left_semi").join(own.select(*key).distinct(), key, "left_anti")
    both = own.union(rest).join(suggestions.select(*key, "place"), key)
    w = Window.partitionBy("paper_id", "stable_id").orderBy("place", "entity_id")
    out = both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "place")
    return out, suggestions.join(both.select(*key).distinct(), key, "left_anti")


def applied(pages: DataFrame, suggestions: DataFrame, requested: DataFrame, known: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, notes, report) after suggestions were applied to their papers, all or nothing for each page(paper_id, html).

    Occurrences are anchored; a page that would lose more than an edit may is kept as it was, and its suggestions give
    no notes. The others give one to each entity that has none.
    """
    occ, without = resolved_occurrences(suggestions, requested, known)
    o = occ.select("paper_id", F.col("stable_id").alias("id"), "entity_id", F.col("dom_node_id").alias("node"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")
    new = injection.inject(pages, o)
    from ..sources import dom

    count = lambda d: dom.tag_counts(d.withColumnRenamed("paper_id", "page_id")).withColumnRenamed("page_id", "key")
    ok = injection.intact(count(pages), count(new.select("paper_id", "html"))).select(F.col("key").alias("paper_id"), "ok")
    j = pages.withColumnRenamed("html", "old").join(new, "paper_id").join(ok, "paper_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    after = j.select("paper_id", F.when(F.col("ok"), F.col("html")).otherwise(F.col("old")).alias("html"))
    good = suggestions.join(j.where("ok").select("paper_id"), "paper_id", "left_semi")
    had = notes.where("entity_id is not null").select("paper_id", "entity_id").distinct()
    w = Window.partitionBy("paper_id", "entity_id").orderBy("place")
    made = good.withColumn("n", F.row_number().over(w)).where("n = 1").join(had, ["paper_id", "entity_id"], "left_anti").select("paper_id", "entity_id", "content")
    none = without.groupBy("paper_id").agg(F.array_sort(F.collect_set("label")).alias("without"))
    report = j.select("paper_id", "ok", "injected", "skipped").join(none, "paper_id", "left")
    return after, made, report


def stored_state(papers: DataFrame) -> DataFrame:
    """papers(paper_id, document json) with ``status``: none, rebuild (another version), malformed, or ready."""
    version = F.get_json_object("document", "$.schema_version")
    parts = F.get_json_object("document", "$.observations").isNotNull() & F.get_json_object("document", "$.objects").isNotNull()
    status = F.when(F.col("document").isNull() | (F.trim("document") == ""), "none").when(version.isNull() | (version != "3.0"), "rebuild").when(~parts, "malformed").otherwise("ready")
    return papers.withColumn("status", status)


def first_sections(sections: DataFrame, most: int = 0) -> DataFrame:
    """sections(paper_id, section_pos) of each paper: the first ones, or with 0 all."""
    if most <= 0:
        return sections
    w = Window.partitionBy("paper_id").orderBy("section_pos")
    return sections.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def overwrite_papers(rows: DataFrame, path: str) -> None:
    """Replace the written rows of the papers in ``rows`` and no others."""
    rows.write.partitionBy("paper_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def payload(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(paper_id, json, bytes): the columns in order of name as compact JSON, nulls too, and its size in UTF-8."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.select("paper_id", body.alias("json")).withColumn("bytes", F.octet_length("json"))


def read_fixtures(spark, path: str, schema) -> DataFrame:
    """Records of JSON files of one document, {domain, document}, or {papers: [...]}, through Spark's reader."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    papers = F.from_json(F.get_json_object("raw", "$.papers"), "array<string>")
    one = raw.select(F.explode(F.coalesce(papers, F.array("raw"))).alias("raw"))
    return one.select(F.get_json_object("raw", "$.domain").alias("domain"), F.from_json(F.coalesce(F.get_json_object("raw", "$.document"), "raw"), schema).alias("document"))


# Characters of a section's text in a prompt, by what is asked; entries of each list of names.
PROMPT_CHARS = {"relations": 8000, "observations": 12000, "equations": 1500}
PROMPT_LINES = {"formula": 30, "symbol": 50, "definition": 30, "theorem": 20}


def prompt_parts(sections: DataFrame, chars: int = PROMPT_CHARS["relations"]) -> DataFrame:
    """sections(paper_id, section_id, text) with the text that fits a prompt."""
    return sections.withColumn("text", F.substring("text", 1, chars))


def prompt_lists(names: DataFrame, lines: dict[str, int] = PROMPT_LINES) -> DataFrame:
    """(paper_id, formula, symbol, definition, theorem): the first of names(paper_id, type, pos, line) of each type, a line each; ``None found``
    where a paper has none. No more than these leave a task."""
    w = Window.partitionBy("paper_id", "type").orderBy("pos", "line")
    kept = names.where(F.col("type").isin(list(lines))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(lines.values()))
    one = lambda kind, most: F.array_sort(F.collect_list(F.when((F.col("type") == kind) & (F.col("n") <= most), F.struct("n", "line"))))
    text = lambda c: F.when(F.size(c) == 0, "None found").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    got = kept.groupBy("paper_id").agg(*[one(kind, most).alias(kind) for kind, most in lines.items()])
    return got.select("paper_id", *[text(F.col(kind)).alias(kind) for kind in lines])


def batches(rows: DataFrame, size: int = 10) -> DataFrame:
    """rows(paper_id, id) with ``batch``: so many to each, in order of id."""
    w = Window.partitionBy("paper_id").orderBy("id")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def supported(found: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, errors): observations whose quote isn't blank and lies in their section's text, and the others with what is wrong."""
    j = found.join(sections.select("paper_id", "section_id", F.col("text").alias("_text")), ["paper_id", "section_id"], "left")
    ok = F.coalesce((F.trim("quote") != "") & F.contains("_text", F.trim("quote")), F.lit(False))
    errors = j.where(~ok).select("paper_id", "id", F.when(F.coalesce(F.trim("quote"), F.lit("")) == "", "blank quote").otherwise("quote not in section").alias("error"))
    return j.where(ok).drop("_text"), errors

