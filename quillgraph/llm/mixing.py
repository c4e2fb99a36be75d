"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 60-bit hash of its id. Word counts are summed by source and by the top bits
of the hash; the bucket in which a source's budget ends is found from the running sums, and only this
bucket is summed again by further bits. The result is one threshold per source, so that the mix is a
filter ``hash <= threshold``: nested (a larger budget keeps every document of a smaller one),
repeatable, and without a sort of the documents.

Defined cases: a null text counts 0 words; a null source is a source of its own, ordered last; rows with
the same id share a hash and are taken together; an empty table gives no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Bits of the hash that each of the two histograms resolves.
BITS = 12


def hashed(docs: DataFrame, seed: str = "", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, h) and the columns ``carry``: h is the first 60 bits of md5(seed + id)."""
    key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        "doc_id", "source", *carry,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("h"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code-point order, null last. A target is ``lambda * weight``, or
    ``most * source_size`` where that is less; lambda makes the targets add up to ``share`` of all sizes,
    which is what resharing every excess by weight ends in. The sources are ordered in one task, a row of two numbers for
    each: the weights go by order, so the number of sources has to fit there, as the rules of the mix do.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("n") + 1).cast("int"))
    ranked = ranked.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w"))
    ranked = ranked.withColumn("full", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("open_w", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("lam", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("full")) / F.col("open_w"))
    # the sources are filled in order of cap by weight; the first whose share fits under its cap sets lambda, and from
    # there on lam only falls: it is the greatest of those that fit
    ranked = ranked.withColumn("level", F.max(F.when(F.col("lam") <= F.col("ratio"), F.col("lam"))).over(all_rows))
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, key: str) -> DataFrame:
    """The bucket of each source in which the budget ``rest`` ends, with what lies below: rows(source, key, words, rest)."""
    w = Window.partitionBy("source").orderBy(key)
    return rows.withColumn("upto", F.sum("words").over(w)).where(
        (F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    )


def thresholds(d: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, limit): every document is taken ``copies`` times, once more where h <= limit.

    d(source, size, h); goals(source, source_size, target).
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    low = goals.select(F.col("source").alias("s"), "rest")
    shift = 60 - BITS
    d = d.where("size > 0")
    one = d.groupBy("source", F.shiftright("h", shift).alias("b1")).agg(F.sum("size").alias("words"))
    one = _boundary(one.join(low, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "b1")
    one = one.select(F.col("source").alias("s"), F.col("b1").alias("at1"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))
    inside = d.withColumn("b1", F.shiftright("h", shift)).withColumn("b2", F.shiftright("h", shift - BITS))
    inside = inside.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("at1"))).drop("s", "at1")
    two = _boundary(inside.groupBy("source", "b1", "b2", "rest").agg(F.sum("size").alias("words")), "b2")
    two = two.select(F.col("source").alias("s"), F.col("b2").alias("at2"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    # a boundary bucket of 24 bits holds few documents: the running sum settles them one by one
    last = inside.join(two, F.col("source").eqNullSafe(F.col("s")) & (F.col("b2") == F.col("at2"))).groupBy("source", "at2", "left", "h").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("h"))
    last = last.withColumn("both", 2 * upto - F.col("words"))
    ends = last.groupBy(F.col("source").alias("s")).agg(
        F.max(F.when(F.col("both") <= 2 * F.col("left"), F.col("h"))).alias("in_last"),
        (F.shiftleft(F.max("at2"), shift - BITS) - 1).alias("below"),
    )
    # no boundary in a level: the budget ends exactly between two of its buckets
    first = d.groupBy("source", F.shiftright("h", shift).alias("b1")).agg(F.sum("size").alias("words"))
    even = first.join(low, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    even = even.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b1"))).where("upto <= rest")
    even = even.groupBy(F.col("source").alias("s1")).agg((F.shiftleft(F.max("b1") + 1, shift) - 1).alias("even1"))
    mid = inside.groupBy("source", "b2", "rest").agg(F.sum("size").alias("words"))
    mid = mid.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b2"))).where("upto <= rest")
    mid = mid.groupBy(F.col("source").alias("s2")).agg((F.shiftleft(F.max("b2") + 1, shift - BITS) - 1).alias("even2"))
    out = goals.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").join(even, F.col("source").eqNullSafe(F.col("s1")), "left").join(mid, F.col("source").eqNullSafe(F.col("s2")), "left")
    limit = F.coalesce(F.greatest("in_last", "below", "even2", "even1"), F.lit(-1))
    return out.select("source", "source_size", "target", "copies", limit.alias("limit"))


def limits(d: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The written table of ``thresholds`` for d(source, size, h): a row for each source."""
    goals = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    return materialize(thresholds(d, materialize(goals, "mix-goals")), "mix-limits")


def taken(d: DataFrame, per: DataFrame) -> DataFrame:
    """d(source, size, h, ...) with source_size, target and taken: each row by its own hash and its source's limit."""
    n = F.col("size") * (F.col("copies") + F.when(F.col("h") <= F.col("limit"), 1).otherwise(0))
    both = d.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return both.withColumn("taken", n.cast("long")).drop("s", "h", "limit", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; taken counts repeats."""
    d = materialize(hashed(docs, seed), "mix")
    return taken(d, limits(d, weights, share, most)).select("doc_id", "size", "source_size", "target", "taken")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM n),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
        (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_w,
        (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - filled) / open_w AS lam FROM f),
v AS (SELECT *, max(CASE WHEN lam <= ratio THEN lam END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w > cap THEN cap ELSE level * w END AS target FROM v),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
j AS (SELECT d.doc_id, d.size, d.h, c.*,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN 2 * upto - here <= 2 * (target - copies * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
