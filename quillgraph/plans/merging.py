"""The queries of the merge operators and their SQL, which pairs all rows of a paper where the operators link by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as M
from ..sources import adapters as A
from ..sources import local as L
from ..sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _text(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def _math(x: str) -> str:
    return f"lower(regexp_replace(replace(replace(regexp_replace(coalesce({x}, ''), '^[$\\s]+|[$\\s]+$', '', 'g'), '\\left', ''), '\\right', ''), '[{{}}\\s]', '', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+'))"


def _telling(x: str) -> str:
    return f"[w for w in {_words(x)} if w NOT IN ({', '.join(map(repr, T.GENERIC_WORDS))})]"


def _id(x: str) -> str:
    return f"substr(replace(replace(replace(replace(lower({x}), ' ', '_'), '\\', ''), '{{', ''), '}}', ''), 1, 64)"


def _shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


BASE = f"""{A.OBSERVATIONS_SQL},
w AS MATERIALIZED (SELECT * FROM (SELECT paper_id, section_id AS pos, {', '.join(f"max(CASE WHEN pos = {k} THEN label END) AS l{k}" for k in range(1, 5))}, (section_id // 4)::VARCHAR AS section_id FROM observations WHERE paper_id IS NOT NULL GROUP BY paper_id, observations.section_id) WHERE l2 IS NOT NULL),
definitions AS MATERIALIZED (SELECT *, list_distinct([{_math('m')} for m in regexp_extract_all(definition_text, '\\$(.+?)\\$', 1)]) AS signatures FROM (SELECT paper_id, pos, l1 AS term, 'the ' || l1 || ' of ' || l2 || ' is $' || upper(l1[1]) || '_{{' || length(l2) || '}}$' AS definition_text,
  CASE WHEN pos % 4 = 0 THEN '' ELSE concat_ws(' ', l1, l2, l3) END AS summary, pos % 2 = 0 AS is_formal, CASE WHEN pos % 3 = 0 THEN pos::VARCHAR END AS definition_number, section_id FROM w)),
formulas AS MATERIALIZED (SELECT paper_id, pos, CASE pos % 3 WHEN 0 THEN l1 WHEN 1 THEN l2 END AS label, upper(l2[1]) || '_{{' || length(l1) || '}}' AS latex, concat_ws(' ', l2, l1, l4) AS summary, section_id, 'about ' || l1 AS section_title, l1, l2 FROM w),
strays AS MATERIALIZED (SELECT paper_id, pos, l3[1] AS symbol, l3 || ' ' || l1 AS context, pos % 5 = 0 AS is_definition, section_id, CASE WHEN pos % 2 = 0 THEN 'on ' || l3 END AS section_title FROM w WHERE l3 IS NOT NULL),
theorems AS (SELECT paper_id, pos, CASE WHEN pos % 2 = 0 THEN 'theorem' ELSE 'lemma' END AS type, (pos % 40)::VARCHAR AS number FROM w),
relationships AS (SELECT paper_id, pos * 2 AS pos, upper(l1) AS from_entity, l2 AS to_entity, 'uses' AS type, 'text ' || pos AS evidence FROM w
  UNION ALL SELECT paper_id, pos * 2 + 1, CASE WHEN pos % 3 = 0 THEN '' WHEN pos % 2 = 0 THEN 'Theorem ' ELSE 'Lemma ' END || (pos % 40), l1, 'supports', 'text ' || pos FROM w),
local AS MATERIALIZED (SELECT f.paper_id, f.pos, min(d.pos) AS definition FROM formulas f LEFT JOIN definitions d ON d.paper_id = f.paper_id AND d.section_id = f.section_id
  AND (({_text('f.label')} <> '' AND {_text('f.label')} = {_text('d.term')}) OR ({_math('f.latex')} <> '' AND list_contains(d.signatures, {_math('f.latex')}))) GROUP BY ALL),
lone AS MATERIALIZED (SELECT paper_id, section_id AS section, {_math('symbol')} AS latex_key, min(pos) AS stray, min(context) AS context FROM strays GROUP BY ALL HAVING count(*) = 1)"""

MERGED = f"""{BASE},
fk AS MATERIALIZED (SELECT f.*, d.term AS att, coalesce(nullif({_text('f.label')}, ''), nullif({_math('f.latex')}, ''), nullif({_text('f.summary')}, '')) AS key FROM formulas f JOIN local USING (paper_id, pos) LEFT JOIN definitions d ON d.paper_id = f.paper_id AND d.pos = local.definition),
al AS (SELECT paper_id, key, list(label ORDER BY p) AS aliases FROM (SELECT paper_id, key, label, min(pos) AS p FROM fk WHERE label <> '' GROUP BY ALL) GROUP BY ALL),
mf AS MATERIALIZED (SELECT m.*, 'formula_' || {_id('name')} AS formula_id, coalesce(aliases, []) AS aliases FROM (SELECT paper_id, key, min(pos) AS pos, first(coalesce(nullif(label, ''), nullif(latex, ''), key) ORDER BY pos) AS name, first(coalesce(nullif(label, ''), latex) ORDER BY pos) AS label,
  first(latex ORDER BY length(latex) DESC, pos) AS latex, first(summary ORDER BY length(summary) DESC, pos) AS summary, first(section_id ORDER BY pos) AS section_id, first(section_title ORDER BY pos) AS section_title, first(att ORDER BY pos) FILTER (att <> '') AS attached_term FROM fk GROUP BY ALL) m LEFT JOIN al USING (paper_id, key))"""


def _classes(name: str, rows: str, pairs: str) -> str:
    """The CTE name(paper_id, pos, first) of rows(paper_id, pos) linked by pairs(paper_id, a, b)."""
    return f"""{name}_e AS MATERIALIZED (SELECT paper_id, a, b FROM {pairs} UNION SELECT paper_id, b, a FROM {pairs}),
{name}_c(paper_id, id, component) USING KEY (paper_id, id) AS (SELECT paper_id, pos, pos FROM {rows} UNION
  SELECT e.paper_id, e.b, min(c.component) FROM {name}_c c JOIN {name}_e e ON e.paper_id = c.paper_id AND e.a = c.id JOIN recurring.{name}_c o ON o.paper_id = e.paper_id AND o.id = e.b WHERE c.component < o.component GROUP BY ALL),
{name} AS MATERIALIZED (SELECT paper_id, id AS pos, component AS first FROM {name}_c)"""


DEFINED = f"""dw AS MATERIALIZED (SELECT *, {_text('term')} AS key, {_words("coalesce(nullif(summary, ''), definition_text)")} AS words FROM definitions),
dp AS MATERIALIZED (SELECT x.paper_id, x.pos AS a, y.pos AS b FROM dw x JOIN dw y ON x.paper_id = y.paper_id AND x.key = y.key AND x.pos < y.pos WHERE x.key <> '' AND ({_shared('x.signatures', 'y.signatures')} > 0 OR {_shared('x.words', 'y.words')} >= 3)),
{_classes('dc', 'definitions', 'dp')},
sg AS (SELECT paper_id, first, list(s ORDER BY p, i) AS signatures FROM (SELECT paper_id, first, s, min(pos) AS p, min(i) AS i FROM (SELECT paper_id, pos, first, unnest(signatures) AS s, generate_subscripts(signatures, 1) AS i FROM definitions JOIN dc USING (paper_id, pos)) GROUP BY ALL) GROUP BY ALL),
md AS MATERIALIZED (SELECT m.*, coalesce(sg.signatures, []) AS signatures FROM (SELECT paper_id, first AS pos, first(term ORDER BY pos) AS term, first(section_id ORDER BY pos) AS section_id, first(summary ORDER BY length(summary) DESC, pos) AS summary, first(definition_text ORDER BY length(definition_text) DESC, pos) AS definition_text,
  bool_or(is_formal) AS is_formal, first(definition_number ORDER BY pos) FILTER (definition_number <> '') AS definition_number FROM definitions JOIN dc USING (paper_id, pos) GROUP BY paper_id, first) m LEFT JOIN sg ON sg.paper_id = m.paper_id AND sg.first = m.pos)"""

_SAID = "coalesce(nullif(d.summary, ''), d.definition_text)"
SCORED = f"""sp AS MATERIALIZED (SELECT f.paper_id, f.pos, d.pos AS definition, attached_term, {_text('f.label')} AS name, {_text('d.term')} AS term, list_contains(d.signatures, {_math('f.latex')}) AS math,
  CASE WHEN coalesce(f.label, '') = '' THEN 0 WHEN {_text('f.label')} = {_text('d.term')} THEN 4 WHEN {_shared(_telling('d.term'), _telling('f.label'))} > 0 THEN 2 ELSE 0 END + CASE WHEN list_contains(d.signatures, {_math('f.latex')}) THEN 3 ELSE 0 END
  + CASE WHEN {_shared(_words(_SAID), _words('f.summary'))} >= 2 THEN 2 WHEN {_shared(_telling(_SAID), _telling('f.summary'))} > 0 THEN 1 ELSE 0 END AS score FROM mf f JOIN md d USING (paper_id)),
hit AS MATERIALIZED (SELECT f.paper_id, f.pos, min(d.pos) AS definition, 'local_reconciliation' AS source, 'same_section_label_or_math_match' AS reason, NULL::INT AS score FROM mf f JOIN md d ON d.paper_id = f.paper_id AND {_text('d.term')} = {_text('f.attached_term')} WHERE f.attached_term <> '' GROUP BY ALL
  UNION ALL SELECT paper_id, pos, definition, 'deterministic_match', CASE r WHEN 0 THEN 'exact_term_match' WHEN 1 THEN 'shared_math_signature' ELSE 'multi_signal_match' END, score FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id, pos ORDER BY r, definition) AS n FROM (SELECT *, CASE WHEN name <> '' AND name = term THEN 0 WHEN math THEN 1 WHEN score >= 4 THEN 2 END AS r FROM sp WHERE attached_term IS NULL) WHERE r IS NOT NULL) WHERE n = 1)"""

_RULES = f"""x.symbol_key = y.symbol_key OR (x.latex_key <> '' AND ({_text('x.context')} = {_text('y.context')} OR {_shared('x.words', 'y.words')} >= 2 OR x.parent = y.parent
  OR (x.scope_level = 'formula_scoped' AND y.scope_level = 'formula_scoped' AND x.role = y.role AND {_shared('x.siblings', 'y.siblings')} > 0)
  OR (x.scope_level = y.scope_level AND x.role = y.role AND {_shared('x.titled', 'y.titled')} > 0) OR ({_shared('x.titled', 'y.titled')} > 0 AND {_shared('x.telling', 'y.telling')} > 0) OR (x.section_id = y.section_id AND {_shared('x.telling', 'y.telling')} > 0)))"""
SYMBOLS = f"""so AS MATERIALIZED (SELECT *, {_math('symbol')} AS latex_key FROM (
  SELECT paper_id, pos * 65536 AS pos, symbol, context, 'paper_level' AS scope_level, section_id, section_title, NULL::VARCHAR AS role, []::VARCHAR[] AS siblings, NULL::VARCHAR AS parent, is_definition FROM strays
  UNION ALL SELECT fk.paper_id, 4503599627370496 + fk.pos * 65536, l1[1], l1 || ' ' || l2, 'formula_scoped', fk.section_id, fk.section_title, CASE WHEN length(l1) % 2 = 0 THEN 'input' ELSE 'parameter' END, [x for x in [l2[1]] if x <> l1[1]], formula_id, false FROM fk JOIN mf USING (paper_id, key)
  UNION ALL SELECT fk.paper_id, 4503599627370496 + fk.pos * 65536 + 1, l2[1], l2, 'formula_scoped', fk.section_id, fk.section_title, NULL, [x for x in [l1[1]] if x <> l2[1]], formula_id, false FROM fk JOIN mf USING (paper_id, key))),
sk AS MATERIALIZED (SELECT so.*, so.latex_key || '|' || {_text('coalesce(lone.context, so.context)')} AS symbol_key, {_words('so.context')} AS words, {_telling('so.context')} AS telling, {_telling('so.section_title')} AS titled FROM so LEFT JOIN lone ON lone.paper_id = so.paper_id AND lone.section = so.section_id AND lone.latex_key = so.latex_key),
pp AS MATERIALIZED (SELECT x.paper_id, x.pos AS a, y.pos AS b FROM sk x JOIN sk y ON x.paper_id = y.paper_id AND x.latex_key = y.latex_key AND x.pos < y.pos WHERE {_RULES}),
{_classes('sc', 'sk', 'pp')},
sm AS MATERIALIZED (SELECT * FROM sk JOIN sc USING (paper_id, pos)),
sib AS (SELECT paper_id, first, list(v ORDER BY p) AS siblings FROM (SELECT paper_id, first, v, min(pos) AS p FROM (SELECT paper_id, first, pos, unnest(siblings) AS v FROM sm) GROUP BY ALL) GROUP BY ALL),
par AS (SELECT paper_id, first, list(v ORDER BY p) AS parents FROM (SELECT paper_id, first, parent AS v, min(pos) AS p FROM sm WHERE parent IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ms AS MATERIALIZED (SELECT m.*, coalesce(siblings, []) AS siblings, coalesce(parents, []) AS parents, 'symbol_' || {_id("concat_ws('|', m.symbol, m.section_id, m.pos::VARCHAR)")} AS id FROM (SELECT paper_id, first AS pos, first(symbol ORDER BY pos) AS symbol, first(latex_key ORDER BY pos) AS latex_key, first(section_id ORDER BY pos) AS section_id, first(scope_level ORDER BY pos) AS scope_level,
  first(context ORDER BY length(context) DESC, pos) AS context, bool_or(is_definition) AS is_definition, first(section_title ORDER BY pos) FILTER (section_title <> '') AS section_title, first(role ORDER BY pos) FILTER (role <> '') AS role FROM sm GROUP BY paper_id, first) m
  LEFT JOIN sib ON sib.paper_id = m.paper_id AND sib.first = m.pos LEFT JOIN par ON par.paper_id = m.paper_id AND par.first = m.pos)"""


class Local:
    """The observations of the tables and what is merged of them, each part once and when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        w = L.words(spark, sf_dir)
        self.definitions, self.formulas, self.symbols, self.theorems, self.relationships = L.definitions(w), L.formulas(w), L.symbols(w), L.theorems(w), L.relationships(w)

    def merged_formulas(self) -> tuple[DataFrame, DataFrame]:
        return M.merged_formulas(self.formulas, M.attached_locally(self.formulas, self.definitions), self.definitions)

    def merged_definitions(self) -> DataFrame:
        return written(M.merged_definitions(self.definitions, M.definition_classes(self.definitions)), "definitions")

    def observations(self, parents: DataFrame) -> DataFrame:
        return written(M.symbol_observations(self.symbols, self.formulas, parents), "symbols")

    def merged_symbols(self, parents: DataFrame) -> DataFrame:
        o = self.observations(parents)
        return written(M.merged_symbols(o, M.symbol_classes(o)), "merged-symbols")


@query(f"WITH {BASE} SELECT paper_id, pos, definition FROM local")
def legacy_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas and the first definition of their section with their name or formula."""
    t = Local(spark, sf_dir)
    return M.attached_locally(t.formulas, t.definitions)


@query(f"WITH {BASE} SELECT * FROM lone")
def legacy_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are alone in their section with their glyph."""
    return M.lone_strays(Local(spark, sf_dir).symbols)


@query(f"WITH {MERGED} SELECT paper_id, key, pos, label, latex, summary, section_id, attached_term, formula_id, array_to_string(aliases, ',') AS aliases FROM mf")
def legacy_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = Local(spark, sf_dir).merged_formulas()
    return m.select("paper_id", "key", "pos", "label", "latex", "summary", "section_id", "attached_term", "formula_id", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH RECURSIVE {BASE}, {DEFINED} SELECT paper_id, pos, term, section_id, summary, definition_text, is_formal, definition_number, array_to_string(signatures, ',') AS signatures FROM md")
def legacy_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Local(spark, sf_dir).merged_definitions().select("paper_id", "pos", "term", "section_id", "summary", "definition_text", "is_formal", "definition_number", F.array_join("signatures", ",").alias("signatures"))


@query(f"WITH RECURSIVE {MERGED}, {SYMBOLS} SELECT * FROM sc")
def legacy_symbol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each symbol, stray or of a formula."""
    t = Local(spark, sf_dir)
    return M.symbol_classes(t.observations(t.merged_formulas()[1]))


@query(f"WITH RECURSIVE {MERGED}, {DEFINED}, {SCORED} SELECT paper_id, pos, definition, source, reason, score FROM hit")
def legacy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged formulas and the definitions that they find in their paper."""
    t = Local(spark, sf_dir)
    return M.attached(t.merged_formulas()[0], t.merged_definitions())


@query(f"""WITH RECURSIVE {MERGED}, {DEFINED}, {SCORED}, c AS (SELECT *, max(score) OVER (PARTITION BY paper_id, pos) AS most, row_number() OVER (PARTITION BY paper_id, pos ORDER BY score DESC, definition) AS place FROM sp
  WHERE score >= 2 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.paper_id = sp.paper_id AND hit.pos = sp.pos)) SELECT paper_id, pos, place::INT AS place, definition, score FROM c WHERE place <= 4 AND score >= greatest(2, most - 1)""")
def legacy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formulas without a definition are offered."""
    t = Local(spark, sf_dir)
    f, d = t.merged_formulas()[0], t.merged_definitions()
    return M.definition_buckets(f, d, M.attached(f, d))


CLUSTERED = f"""gl AS (SELECT paper_id, latex_key FROM ms WHERE latex_key <> '' GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4),
cl AS MATERIALIZED (SELECT ms.*, CASE WHEN gl.latex_key IS NOT NULL THEN 'c' || ms.latex_key || ' ' || scope_level ELSE 's' || id END AS cluster FROM ms LEFT JOIN gl USING (paper_id, latex_key)),
bst AS MATERIALIZED (SELECT cl.*, id <> first(id) OVER (PARTITION BY paper_id, cluster ORDER BY length(context) DESC, len(parents) DESC, pos) AS other FROM cl),
csib AS (SELECT paper_id, cluster, list(v ORDER BY o, p, i) AS siblings FROM (SELECT paper_id, cluster, v, (min((o::INT, p, i))) AS m, m[1] AS o, m[2] AS p, m[3] AS i FROM (SELECT paper_id, cluster, other AS o, pos AS p, unnest(siblings) AS v, generate_subscripts(siblings, 1) AS i FROM bst) GROUP BY ALL) GROUP BY ALL),
cpar AS (SELECT paper_id, cluster, list(v ORDER BY o, p, i) AS parents FROM (SELECT paper_id, cluster, v, (min((o::INT, p, i))) AS m, m[1] AS o, m[2] AS p, m[3] AS i FROM (SELECT paper_id, cluster, other AS o, pos AS p, unnest(parents) AS v, generate_subscripts(parents, 1) AS i FROM bst) GROUP BY ALL) GROUP BY ALL),
mc AS MATERIALIZED (SELECT m.*, coalesce(siblings, []) AS siblings, coalesce(parents, []) AS parents FROM (SELECT paper_id, cluster, first(id ORDER BY other, pos) AS id, first(context ORDER BY other, pos) AS context, first(role ORDER BY other, pos) AS role, bool_or(is_definition) AS is_definition, first(section_title ORDER BY other, pos) FILTER (section_title <> '') AS section_title FROM bst GROUP BY ALL) m
  LEFT JOIN csib USING (paper_id, cluster) LEFT JOIN cpar USING (paper_id, cluster))"""


@query(f"WITH RECURSIVE {MERGED}, {SYMBOLS}, {CLUSTERED} SELECT paper_id, id, context, role, is_definition, section_title, array_to_string(siblings, ',') AS siblings, array_to_string(parents, ',') AS parents FROM mc")
def legacy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of glyphs that two to four have, those of one scope made one: this engine's stand-in for a person's choice."""
    t = Local(spark, sf_dir)
    s = t.merged_symbols(t.merged_formulas()[1])
    chosen = M.symbol_buckets(s).join(s.select("paper_id", "id", "scope_level"), ["paper_id", "id"]).select("paper_id", "id", F.concat_ws(" ", "latex_key", "scope_level").alias("cluster"))
    m = M.merged_clusters(s, chosen)
    return m.select("paper_id", "id", "context", "role", "is_definition", "section_title", F.array_join("siblings", ",").alias("siblings"), F.array_join("parents", ",").alias("parents"))


@query(f"""WITH RECURSIVE {MERGED}, {SYMBOLS}, sv AS (SELECT paper_id, formula_id, first({_text("coalesce(nullif(attached_term, ''), nullif(label, ''), latex)")} ORDER BY pos DESC) AS v FROM mf GROUP BY ALL),
pe AS (SELECT paper_id, id, unnest(parents) AS formula_id, generate_subscripts(parents, 1) AS i FROM ms), g AS (SELECT paper_id, id, first(v ORDER BY i) AS concept FROM pe JOIN sv USING (paper_id, formula_id) WHERE v <> '' GROUP BY ALL)
SELECT paper_id, id, concept, CASE WHEN concept IS NOT NULL THEN 'formula_scoped' ELSE scope_level END AS scope_level FROM ms LEFT JOIN g USING (paper_id, id)""")
def legacy_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with the scope of the first of their formulas."""
    t = Local(spark, sf_dir)
    f, parents = t.merged_formulas()
    return M.scoped(t.merged_symbols(parents), f).select("paper_id", "id", "concept", "scope_level")


GRAPH = f"""{MERGED}, {DEFINED}, {SCORED}, {SYMBOLS},
fa AS MATERIALIZED (SELECT mf.*, md.term AS found_term, hit.reason FROM mf LEFT JOIN hit USING (paper_id, pos) LEFT JOIN md ON md.paper_id = mf.paper_id AND md.pos = hit.definition),
nd AS (SELECT paper_id, 0 AS r, pos, formula_id AS id, 'formula' AS type, coalesce(label, latex) AS label FROM mf UNION ALL SELECT paper_id, 1, pos, id, 'symbol', symbol FROM ms
  UNION ALL SELECT paper_id, 2, pos, 'def_' || {_id('term')}, 'definition', term FROM md UNION ALL SELECT paper_id, 3, pos, 'thm_' || number, 'theorem', upper(type[1]) || type[2:] || ' ' || number FROM theorems),
nodes AS MATERIALIZED (SELECT paper_id, id, first(type ORDER BY r, pos) AS type, first(label ORDER BY r, pos) AS label FROM nd GROUP BY ALL),
ix AS MATERIALIZED (SELECT paper_id, lower(unnest([label, latex] || aliases)) AS name, false AS exact, 0 AS r, pos, formula_id AS id FROM mf UNION ALL SELECT paper_id, lower(symbol), false, 1, pos, id FROM ms UNION ALL SELECT paper_id, lower(term), false, 2, pos, 'def_' || {_id('term')} FROM md
  UNION ALL SELECT paper_id, type || ' ' || number, false, 3, pos, 'thm_' || number FROM theorems UNION ALL SELECT paper_id, number, true, 3, pos, 'thm_' || number FROM theorems),
nm AS (SELECT paper_id, from_entity AS name FROM relationships UNION SELECT paper_id, to_entity FROM relationships),
rs AS MATERIALIZED (SELECT nm.paper_id, nm.name, coalesce(first(ix.id ORDER BY r, ix.pos) FILTER (ix.id IS NOT NULL), {_id('nm.name')}) AS id FROM nm LEFT JOIN ix ON ix.paper_id = nm.paper_id AND (CASE WHEN ix.exact THEN nm.name ELSE lower(nm.name) END) = ix.name GROUP BY nm.paper_id, nm.name),
tm AS (SELECT paper_id, {_text('term')} AS key, first('def_' || {_id('term')} ORDER BY pos DESC) AS source FROM md GROUP BY paper_id, {_text('term')}),
ev AS (SELECT fa.paper_id, source, formula_id AS target, 'defines' AS type, coalesce(reason, 'Definition linked to its formula representation') AS evidence, 0 AS r, pos FROM fa JOIN tm ON tm.paper_id = fa.paper_id AND tm.key = {_text('fa.found_term')} WHERE fa.found_term <> ''
  UNION ALL SELECT paper_id, p, id, 'has_symbol', 'Symbol extracted as part of formula context', 1, pos FROM (SELECT paper_id, id, pos, unnest(parents) AS p FROM ms) x
  UNION ALL SELECT q.paper_id, a.id, b.id, q.type, q.evidence, 2, q.pos FROM relationships q JOIN rs a ON a.paper_id = q.paper_id AND a.name = from_entity JOIN rs b ON b.paper_id = q.paper_id AND b.name = to_entity
    WHERE a.id <> b.id AND EXISTS (SELECT 1 FROM nodes n WHERE n.paper_id = q.paper_id AND n.id = a.id) AND EXISTS (SELECT 1 FROM nodes n WHERE n.paper_id = q.paper_id AND n.id = b.id)),
edges AS (SELECT paper_id, source || '_to_' || target || '_' || type AS id, source, target, type, first(evidence ORDER BY r, pos) AS evidence FROM ev GROUP BY paper_id, source, target, type)"""


def legacy_graph(spark: SparkSession, sf_dir: str) -> tuple[Local, DataFrame, DataFrame, DataFrame]:
    """(observations, formulas with their definition's term, symbols, definitions)."""
    t = Local(spark, sf_dir)
    f, parents = t.merged_formulas()
    d = t.merged_definitions()
    own = M.attached(f, d).join(d.select("paper_id", F.col("pos").alias("definition"), F.col("term").alias("found")), ["paper_id", "definition"]).select("paper_id", "pos", "found", "reason")
    f = written(f.drop("attached_term").join(own, ["paper_id", "pos"], "left").withColumnRenamed("found", "attached_term"), "formulas")
    return t, f, t.merged_symbols(parents), d


@query(f"WITH RECURSIVE {GRAPH} SELECT * FROM nodes")
def legacy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f, s, d = legacy_graph(spark, sf_dir)
    return M.graph_nodes(f, s, d, t.theorems)


@query(f"WITH RECURSIVE {GRAPH} SELECT * FROM edges")
def legacy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f, s, d = legacy_graph(spark, sf_dir)
    nodes = written(M.graph_nodes(f, s, d, t.theorems), "nodes")
    return M.graph_edges(nodes, written(M.name_index(f, s, d, t.theorems), "names"), f, s, d, t.relationships)


@query(f"""WITH RECURSIVE {GRAPH} SELECT paper_id, count(*) AS node_count, count(*) FILTER (type = 'formula') AS formula_count, count(*) FILTER (type = 'symbol') AS symbol_count, count(*) FILTER (type = 'definition') AS definition_count,
  count(*) FILTER (type = 'theorem') AS theorem_count FROM nodes GROUP BY paper_id""")
def legacy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entity_counts(legacy_nodes(spark, sf_dir))
