"""Whole documents of observations, sections and nodes from the text table: a source is a paper, a text one of its sections.

The stand-in for extraction is this engine's own: a text's most frequent words are what it is about, the two first ones are
related, and every text has one formula of them. What is computed from its rows is what counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .shared import written

SYMBOL = "struct<symbol: string, meaning: string, scope_id: string, units: string, constraints: array<string>, object_labels: array<string>>"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of all kinds: of objects, of relations between a text's two first ones, and of its formula. They are
    written, so that texts are read once however often a document asks for them."""
    o = written(A.observations(spark, sf_dir).select("paper_id", "id", "section_id", "pos", "kind", "label", "confidence"), "extracted")
    node, text = F.concat(F.lit("n"), "section_id"), F.col("section_id").cast("string")
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    things = o.select(
        "paper_id", "id", "kind", "label", F.array().cast("array<string>").alias("aliases"), F.array(F.concat(F.lit("role"), F.col("pos") % 2)).alias("roles"),
        F.when(F.col("pos") % 2 == 1, F.concat(F.lit("about "), "label")).alias("summary"), none("facet_kind"), (F.col("pos") / 10).alias("contribution"), none("prominence", "double"),
        F.round(F.length("label") / 20, 6).alias("familiarity"), "confidence", text.alias("section_id"), node.alias("node_id"), none("equation_id"), F.col("label").alias("quote"), (F.col("pos") * 100).cast("int").alias("char_start"),
        none("type"), none("source"), none("target"), none("qualifiers", "array<string>"), none("latex"), none("scope_id"), none("symbols", f"array<{SYMBOL}>"), none("object_labels", "array<string>"), none("defined_observation_id"),
    )
    pair = o.where("pos <= 2").groupBy("paper_id", "section_id").agg(
        F.max(F.when(F.col("pos") == 1, F.col("label"))).alias("a"), F.max(F.when(F.col("pos") == 2, F.col("label"))).alias("b"), F.max(F.when(F.col("pos") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("pos") == 1, F.col("confidence"))).alias("c")
    ).where("b is not null")
    types = F.array(*map(F.lit, ["is_a", "uses", "derives_from", "supports", "somehow"]))
    base = {c: F.lit(None).cast(t) for c, t in things.dtypes}
    place = {"section_id": text, "node_id": node, "paper_id": F.col("paper_id"), "confidence": F.col("c")}
    rel = base | place | {
        "id": F.concat(F.lit("r"), F.substring("first", 2, 12)), "kind": F.lit("relation"), "label": F.concat_ws(" ", "a", "b"), "type": F.element_at(types, (F.length("a") % 5 + 1).cast("int")),
        "source": F.col("a"), "target": F.col("b"), "qualifiers": F.array(F.lit("stated")), "quote": F.concat_ws(" ", "a", "b"),
    }
    head, tail = F.concat(F.upper(F.substring("a", 1, 1)), F.lit("_{"), F.length("a").cast("string"), F.lit("}")), F.substring("b", 1, 1)
    latex = F.concat(head, F.lit(" = \\sum "), tail, F.lit(" + "), head)
    sym = lambda s, meaning, scope, label: F.struct(s.alias("symbol"), meaning.alias("meaning"), scope.alias("scope_id"), F.lit(None).cast("string").alias("units"), F.array(F.lit("c")).alias("constraints"), F.array(label).alias("object_labels"))
    eq = base | place | {
        "id": F.concat(F.lit("q"), F.substring("first", 2, 12)), "kind": F.lit("equation"), "label": F.concat(F.lit("eq"), "section_id"), "equation_id": F.concat(F.lit("eq"), "section_id"), "latex": latex, "quote": latex,
        "symbols": F.array(sym(head, F.col("a"), F.lit("all"), F.col("a")), sym(tail, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("b"))).cast(f"array<{SYMBOL}>"),
        "object_labels": F.array("a", "b"), "defined_observation_id": F.when(F.length("b") % 2 == 0, F.col("first")),
    }
    row = lambda d: pair.select(*[d[c].alias(c) for c in things.columns])
    return written(things.unionByName(row(rel)).unionByName(row(eq)), "observations")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, section_id, section_pos): the texts of a source, the highest id first."""
    return A.read(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("section_id"), (-F.col("doc_id")).alias("section_pos"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, section_id, node_id, node_pos, text): one node for each text."""
    d = A.read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("section_id"), F.concat(F.lit("n"), "doc_id").alias("node_id"), F.lit(0).alias("node_pos"), "text")


def _id(kind: str, label: str, math: str = "''", scope: str = "''") -> str:
    return f"({kind} || ':' || substr(sha256({kind} || '|' || {label} || '|' || {math} || '|' || {scope}), 1, 20))"


#: The parts of the document in SQL. Labels are lower-case ASCII words, so that their normal form is what they are.
SQL = A.OBSERVATIONS_SQL + f""",
ev AS (SELECT paper_id, id AS observation_id, section_id, pos, kind, label, confidence, {_id("kind", "label", scope="coalesce(paper_id, '')")} AS object_id FROM observations),
objects AS (SELECT paper_id, object_id AS stable_id, kind, label, round(max(pos / 10.0::DOUBLE), 6) AS contribution, 0.5::DOUBLE AS prominence, round(max(length(label) / 20.0::DOUBLE), 6) AS familiarity, round(avg(confidence), 6) AS confidence,
  count(*) AS members, round(least(1.0::DOUBLE, count(*) / 3.0::DOUBLE), 6) AS recurrence, string_agg(DISTINCT 'role' || (pos % 2), ',' ORDER BY 'role' || (pos % 2)) AS roles,
  coalesce(arg_min(CASE WHEN pos % 2 = 1 THEN 'about ' || label END, observation_id) FILTER (pos % 2 = 1), label) AS said FROM ev GROUP BY paper_id, object_id, kind, label),
named AS (SELECT paper_id, label, min(stable_id) AS first, max(stable_id) AS last FROM objects GROUP BY ALL),
pair AS (SELECT paper_id, section_id, max(label) FILTER (pos = 1) AS a, max(label) FILTER (pos = 2) AS b, max(id) FILTER (pos = 1) AS first, max(confidence) FILTER (pos = 1) AS c FROM observations WHERE pos <= 2 GROUP BY ALL HAVING count(*) = 2),
told AS (SELECT p.paper_id, 'r' || substr(p.first, 2, 12) AS id, ['is_a', 'uses', 'depends_on', 'supports', 'somehow'][length(a) % 5 + 1] AS type, s.first AS source_id, t.first AS target_id, c, CASE WHEN length(a) % 5 = 2 THEN 'derivation,stated' ELSE 'stated' END AS qualifiers
  FROM pair p JOIN named s ON s.paper_id = p.paper_id AND s.label = a JOIN named t ON t.paper_id = p.paper_id AND t.label = b WHERE length(a) % 5 < 4),
relations AS (SELECT paper_id, {_id("'relation'", "type || ' ' || replace(source_id, ':', ' ') || ' ' || replace(target_id, ':', ' ')")} AS stable_id, type, source_id, target_id, arg_max(qualifiers, id) AS qualifiers, max(id) AS evidence_id, arg_max(c, id) AS confidence
  FROM told WHERE source_id <> target_id GROUP BY ALL),
eq AS (SELECT paper_id, 'q' || substr(first, 2, 12) AS id, 'eq' || section_id AS equation_id, section_id::VARCHAR AS section_id, a, b, upper(a[1]) || '_{{' || length(a) || '}}' AS head, b[1] AS tail, CASE WHEN length(b) % 2 = 0 THEN first END AS wanted FROM pair),
sym AS (SELECT paper_id, id, equation_id, head AS symbol, a AS meaning, 'all' AS scope_id, a AS label, 0 AS pos FROM eq UNION ALL SELECT paper_id, id, equation_id, tail, 'Meaning not explicitly defined near this equation', section_id, b, 1 FROM eq),
sig AS (SELECT *, lower(replace(replace(symbol, '{{', ''), '}}', '')) AS g, lower(meaning) AS m, trim(regexp_replace(lower(symbol), '[^a-z0-9_]+', ' ', 'g')) AS plain FROM sym),
sid AS (SELECT *, {_id("'notation'", "plain", "replace(m, ' ', '')", "paper_id || ' ' || scope_id")} AS stable_id FROM sig),
notation AS (SELECT paper_id, g, m, scope_id, arg_max(stable_id, (id, pos)) AS stable_id, arg_max(symbol, (id, pos)) AS symbol, arg_max(meaning, (id, pos)) AS meaning, count(DISTINCT id) AS evidence,
  string_agg(DISTINCT last, ',' ORDER BY last) AS object_ids FROM sid JOIN named USING (paper_id, label) GROUP BY ALL),
asked AS (SELECT eq.*, object_id FROM eq LEFT JOIN ev ON ev.observation_id = wanted AND ev.paper_id IS NOT DISTINCT FROM eq.paper_id),
defined AS (SELECT *, CASE WHEN count(object_id) OVER (PARTITION BY paper_id, object_id) = 1 THEN object_id END AS defined_object_id FROM asked),
equations AS (SELECT paper_id, {_id("'equation'", "equation_id", "lower(replace(replace(replace(head || ' = \\sum ' || tail || ' + ' || head, ' ', ''), '{', ''), '}', ''))")} AS stable_id, equation_id, head || ' = \\sum ' || tail || ' + ' || head AS latex, 'Displayed equation ' || equation_id AS summary,
  (SELECT string_agg(DISTINCT s.stable_id, ',' ORDER BY s.stable_id) FROM sid s WHERE s.id = defined.id) AS notation_ids,
  (SELECT string_agg(DISTINCT last, ',' ORDER BY last) FROM named n WHERE n.paper_id = defined.paper_id AND n.label IN (a, b)) AS object_ids, defined_object_id, id FROM defined),
explanations AS (SELECT paper_id, stable_id AS subject_id, said AS base_content FROM objects UNION ALL SELECT paper_id, stable_id, meaning FROM notation),
subjects AS (SELECT paper_id, stable_id AS subject_id, kind, label FROM objects UNION ALL SELECT paper_id, stable_id, 'notation', symbol FROM notation),
quoted AS (SELECT DISTINCT paper_id, object_id AS subject_id, 'n' || section_id AS dom_node_id, section_id::VARCHAR AS scope_id, pos * 100 AS start, pos * 100 + length(label) AS "end", label AS text,
  {_id("'occurrence'", "replace(object_id, ':', ' ')", scope="'n' || section_id || ' ' || (pos * 100) || ' ' || (pos * 100 + length(label))")} AS stable_id FROM ev WHERE length(label) >= 2)
"""
