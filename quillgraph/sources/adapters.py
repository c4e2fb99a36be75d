"""Tables of the data set in the shapes that the operators take.

The adapters are this engine's own; what the operators compute on their output is what counts.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from .dom import slices


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, section_id, kind, text) passages: the documents."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section_id"), F.col("lang").alias("kind"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): the benchmark items, whole."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


#: First letters of the star graph's ids.
LETTERS = "rnscp"


def named(letter: str, key) -> Column:
    """The id of a node of the star graph."""
    return F.concat(F.lit(letter), F.col(key))


def coded(letter: str, key) -> Column:
    """A whole number for that id, for rounds over many links."""
    return F.col(key).cast("long") * 8 + LETTERS.index(letter)


def decoded(code: Column) -> Column:
    """The id that the number stands for."""
    return F.concat(F.element_at(F.array(*map(F.lit, LETTERS)), (F.pmod(code, F.lit(8)) + 1).cast("int")), F.shiftright(code, 3))


def star_objects(spark: SparkSession, sf_dir: str, made: DataFrame | None = None, key=named) -> DataFrame:
    """(paper_id, id, kind, label, contribution, prominence, recurrence, confidence, familiarity).

    A region is a paper. Region and nations are topics, suppliers procedures, customers claims, and parts
    artifacts of each paper that has a supplier of them; signals are scaled balances, prices and counts. ``made`` is what
    ``produced`` gives, and ``key`` makes the ids.
    """
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("paper_id"))
    r = read(spark, sf_dir, "region")
    unit = lambda c: F.round((F.col(c) + 1000) / 11000, 6)
    one = F.lit(1.0)
    regions = r.select(F.col("r_regionkey").alias("paper_id"), key("r", "r_regionkey").alias("id"), F.lit("topic").alias("kind"), F.col("r_name").alias("label"), one.alias("contribution"), F.lit(0.5).alias("prominence"), one.alias("recurrence"), one.alias("confidence"), one.alias("familiarity"))
    nations = n.select("paper_id", key("n", "n_nationkey").alias("id"), F.lit("topic").alias("kind"), F.col("n_name").alias("label"), F.lit(0.6).alias("contribution"), F.lit(0.4).alias("prominence"), one.alias("recurrence"), one.alias("confidence"), F.lit(0.9).alias("familiarity"))

    def people(name: str, p: str, kind: str) -> DataFrame:
        d = read(spark, sf_dir, name).join(F.broadcast(n), F.col(f"{p}_nationkey") == F.col("n_nationkey"))  # 25 nations
        own = f"{p}_{'suppkey' if p == 's' else 'custkey'}"
        k = F.col(own)
        return d.select("paper_id", key(p, own).alias("id"), F.lit(kind).alias("kind"), F.col(f"{p}_name").alias("label"), unit(f"{p}_acctbal").alias("contribution"), F.round(F.pmod(k, F.lit(7)) / 7, 6).alias("prominence"), F.round(F.pmod(k, F.lit(3)) / 3, 6).alias("recurrence"), F.lit(0.8).alias("confidence"), F.round(F.pmod(k, F.lit(11)) / 10, 6).alias("familiarity"))

    made = (produced(spark, sf_dir) if made is None else made).groupBy("paper_id", "l_partkey").agg(F.sum("evidence").alias("n"), F.count(F.lit(1)).alias("makers"))
    span = lambda c, of: F.when(F.col(f"{of}_most") > F.col(f"{of}_least"), F.round((F.col(c) - F.col(f"{of}_least")) / (F.col(f"{of}_most") - F.col(f"{of}_least")), 6)).otherwise(0.0)
    p = read(spark, sf_dir, "part")
    prices = p.agg(F.min("p_retailprice").alias("p_least"), F.max("p_retailprice").alias("p_most"))
    degrees = made.agg(F.min("makers").alias("d_least"), F.max("makers").alias("d_most"))
    p = made.join(p, F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(prices)).join(F.broadcast(degrees))  # one row each
    parts = p.select("paper_id", key("p", "p_partkey").alias("id"), F.lit("artifact").alias("kind"), F.col("p_name").alias("label"), span("p_retailprice", "p").alias("contribution"), span("makers", "d").alias("prominence"), F.round(F.least(one, F.col("n") / 3), 6).alias("recurrence"), F.lit(0.8).alias("confidence"), span("makers", "d").alias("familiarity"))
    return regions.union(nations).union(people("supplier", "s", "procedure")).union(people("customer", "c", "claim")).union(parts)


def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, l_suppkey, l_partkey, evidence): the distinct pairs of lineitem, in the supplier's region, and their lines."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("paper_id"))
    s = read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("paper_id", "s_suppkey")
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("evidence"))
    known = read(spark, sf_dir, "part").select("p_partkey")
    return pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(known, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("paper_id", "l_suppkey", "l_partkey", "evidence")


def star_relations(spark: SparkSession, sf_dir: str, made: DataFrame | None = None, key=named) -> DataFrame:
    """(paper_id, id, type, source_id, target_id, confidence, evidence): nations are part of regions, suppliers and
    customers of nations; a supplier produces parts; a customer depends on suppliers of the region that it ordered from."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("paper_id"))
    s = read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("paper_id", "s_suppkey", "s_nationkey")
    c = read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("paper_id").alias("c_paper"), "c_custkey", "c_nationkey")
    part = [
        n.select("paper_id", F.lit("part_of").alias("type"), key("n", "n_nationkey").alias("source_id"), key("r", "paper_id").alias("target_id"), F.lit(1).cast("long").alias("evidence")),
        s.select("paper_id", F.lit("part_of"), key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit(1).cast("long")),
        c.select("c_paper", F.lit("part_of"), key("c", "c_custkey"), key("n", "c_nationkey"), F.lit(1).cast("long")),
    ]
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    deals = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("evidence"))
    deals = deals.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("paper_id") == F.col("c_paper")))
    part.append(deals.select("paper_id", F.lit("depends_on"), key("c", "c_custkey"), key("s", "s_suppkey"), "evidence"))
    part.append((produced(spark, sf_dir) if made is None else made).select("paper_id", F.lit("produces"), key("s", "l_suppkey"), key("p", "l_partkey"), "evidence"))
    out = part[0]
    for p in part[1:]:
        out = out.union(p)
    return out.select("paper_id", F.concat_ws(":", "type", "source_id", "target_id").alias("id"), "type", "source_id", "target_id", F.round(F.least(F.lit(1.0), F.col("evidence") / 10), 6).alias("confidence"), "evidence")


#: The two above in SQL, as common tables ``objects`` and ``relations``.
STAR_SQL = """
n AS (SELECT n_nationkey, n_name, n_regionkey AS paper_id FROM nation),
made AS (SELECT paper_id, l_suppkey, l_partkey, count(*) AS evidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN n ON s_nationkey = n_nationkey
  WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL),
makers AS (SELECT paper_id, l_partkey, sum(evidence)::BIGINT AS lines, count(*) AS makers FROM made GROUP BY ALL),
price AS (SELECT min(p_retailprice) AS p_least, max(p_retailprice) AS p_most FROM part),
many AS (SELECT min(makers) AS d_least, max(makers) AS d_most FROM makers),
scaled AS (SELECT paper_id, p_partkey, p_name, lines, CASE WHEN p_most > p_least THEN round((p_retailprice - p_least)::DOUBLE / (p_most - p_least)::DOUBLE, 6) ELSE 0.0 END AS cost,
  CASE WHEN d_most > d_least THEN round((makers - d_least) / (d_most - d_least)::DOUBLE, 6) ELSE 0.0 END AS spread FROM makers JOIN part ON l_partkey = p_partkey, price, many),
objects AS (
  SELECT r_regionkey AS paper_id, 'r' || r_regionkey AS id, 'topic' AS kind, r_name AS label, 1.0::DOUBLE AS contribution, 0.5::DOUBLE AS prominence, 1.0::DOUBLE AS recurrence, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS familiarity FROM region
  UNION ALL SELECT paper_id, 'n' || n_nationkey, 'topic', n_name, 0.6, 0.4, 1.0, 1.0, 0.9 FROM n
  UNION ALL SELECT paper_id, 's' || s_suppkey, 'procedure', s_name, round((s_acctbal + 1000) / 11000, 6), round((s_suppkey % 7) / 7.0::DOUBLE, 6), round((s_suppkey % 3) / 3.0::DOUBLE, 6), 0.8, round((s_suppkey % 11) / 10.0::DOUBLE, 6) FROM supplier JOIN n ON s_nationkey = n_nationkey
  UNION ALL SELECT paper_id, 'c' || c_custkey, 'claim', c_name, round((c_acctbal + 1000) / 11000, 6), round((c_custkey % 7) / 7.0::DOUBLE, 6), round((c_custkey % 3) / 3.0::DOUBLE, 6), 0.8, round((c_custkey % 11) / 10.0::DOUBLE, 6) FROM customer JOIN n ON c_nationkey = n_nationkey
  UNION ALL SELECT paper_id, 'p' || p_partkey, 'artifact', p_name, cost, spread, round(least(1.0::DOUBLE, lines / 3.0::DOUBLE), 6), 0.8, spread FROM scaled),
deals AS (SELECT o_custkey, l_suppkey, count(*) AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
links AS (
  SELECT paper_id, 'part_of' AS type, 'n' || n_nationkey AS source_id, 'r' || paper_id AS target_id, 1::BIGINT AS evidence FROM n
  UNION ALL SELECT paper_id, 'part_of', 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier JOIN n ON s_nationkey = n_nationkey
  UNION ALL SELECT paper_id, 'part_of', 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer JOIN n ON c_nationkey = n_nationkey
  UNION ALL SELECT a.paper_id, 'depends_on', 'c' || c_custkey, 's' || s_suppkey, evidence
    FROM deals JOIN supplier ON l_suppkey = s_suppkey JOIN n a ON s_nationkey = a.n_nationkey JOIN customer ON o_custkey = c_custkey JOIN n b ON c_nationkey = b.n_nationkey AND a.paper_id = b.paper_id
  UNION ALL SELECT paper_id, 'produces', 's' || l_suppkey, 'p' || l_partkey, evidence FROM made),
relations AS (SELECT paper_id, type || ':' || source_id || ':' || target_id AS id, type, source_id, target_id, round(least(1.0::DOUBLE, evidence / 10.0::DOUBLE), 6) AS confidence, evidence FROM links)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, id, section_id, pos, kind, label, alias, quote, confidence): a stand-in for extraction.

    The five most frequent long tokens of each document are its observations; their kind goes by their length. Texts are dealt
    and sorted by document, so that words are counted where they are found, one document at a time.
    """
    d = read(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.lower("text").alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")
    kinds = dict(d.dtypes)
    out = f"paper_id {kinds['source']}, doc_id {kinds['doc_id']}, label string, tf long, pos int"
    t = d.mapInArrow(frequent_words(out), out)
    kinds = F.array(*map(F.lit, ["topic", "claim", "procedure", "artifact", "quantity"]))
    return t.select("paper_id", F.concat(F.lit("o"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("-"), F.col("pos").cast("string")).alias("id"), F.col("doc_id").alias("section_id"), "pos", F.element_at(kinds, (F.pmod(F.length("label"), F.lit(5)) + 1).cast("int")).alias("kind"), "label", T.plural_variant(F.col("label")).alias("alias"), F.col("tf").alias("confidence_tf"), F.round(F.least(F.lit(1.0), F.col("tf") / 10), 6).alias("confidence"))


def frequent_words(schema: str, most: int = 5, batch: int = 1000):
    """A function of batches of (source, doc_id, lower-case text), rows of a document side by side: its most frequent words of four
    characters at least that say something, by frequency and word."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    stop, word = set(T.STOP_WORDS), re.compile("[a-z0-9]{4,}")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows = (r for b in slices(batches) for r in zip(*(c.to_pylist() for c in b.columns)))
        for doc, own in itertools.groupby(rows, key=lambda r: r[1]):
            counts: dict[str | None, Counter] = {}
            for source, _, text in own:
                counts.setdefault(source, Counter()).update(word.findall(text))
            found = [(-n, w, source) for source, c in counts.items() for w, n in c.items() if w not in stop]
            best = heapq.nsmallest(most, found, key=lambda x: x[:2])
            yield [(source, doc, w, -n, k) for k, (n, w, source) in enumerate(best, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = documents(batches)
        while some := list(itertools.islice(each, batch)):
            columns = list(zip(*(r for rows in some for r in rows))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return run


OBSERVATIONS_SQL = """
otok AS (SELECT source AS paper_id, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS label FROM documents),
otf AS (SELECT paper_id, doc_id, label, count(*) AS tf FROM otok WHERE length(label) >= 4 AND label NOT IN ('a', 'an', 'and', 'by', 'does', 'for', 'how', 'in', 'is', 'of', 'on', 'the', 'this', 'through', 'to', 'what', 'where', 'which', 'with') GROUP BY ALL),
otop AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, label) AS pos FROM otf),
observations AS (SELECT paper_id, 'o' || lpad(doc_id::VARCHAR, 12, '0') || '-' || pos AS id, doc_id AS section_id, pos,
  ['topic', 'claim', 'procedure', 'artifact', 'quantity'][length(label) % 5 + 1] AS kind, label, tf, round(least(1.0::DOUBLE, tf / 10.0::DOUBLE), 6) AS confidence FROM otop WHERE pos <= 5)
"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, paper_id, entity_id, dom_node_id, content, is_pinned, display_order, created_at): the turns of conversations."""
    c = read(spark, sf_dir, "conversations")
    own = F.col("role") != "user"
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("paper_id"), F.when(own, F.concat(F.col("role"), F.lit("_"), F.pmod("turn", F.lit(4)))).alias("entity_id"),
        F.when(~own, F.concat(F.lit("node"), "turn")).alias("dom_node_id"), F.col("text").alias("content"), (F.col("turn") % 3 == 0).alias("is_pinned"),
        F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("display_order"), at.alias("created_at"),
    )


ANNOTATIONS_SQL = """
annotations AS (SELECT conv_id || '-' || turn AS id, conv_id AS paper_id, CASE WHEN role <> 'user' THEN role || '_' || (turn % 4) END AS entity_id,
  CASE WHEN role = 'user' THEN 'node' || turn END AS dom_node_id, text AS content, turn % 3 = 0 AS is_pinned, CASE WHEN turn % 2 = 0 THEN turn END AS display_order,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations)
"""
