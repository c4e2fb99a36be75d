"""Ranked lexical search: every item's best documents by summed term impacts, with thresholds seeded from stored lists.

1. The postings of all terms that items ask for are written once, in buckets of their document, so that whatever is
   joined by document later lies where it is needed.
2. For each term its greatest impacts are stored, ``k`` of them with their documents. They give the term's greatest
   impact and, where a term has k postings, its kth, times its weight a lower bound of the item's kth score.
3. What an item's terms have stored for one document adds up to a lower bound of that document's score. The
   documents with the greatest bounds are scored exactly; the kth of these scores is a lower bound too. The greater bound of
   both is the item's threshold.
4. An item's terms are ordered by their greatest contribution. The suffix of terms whose contributions together stay
   below the threshold can lift no document to it that has none of the terms before: only these generate candidates.
5. A candidate stays if what the terms before the suffix give it, and the suffix's bound, reach the threshold. The rest
   are scored exactly with the terms of the suffix, and ranked. No document that reaches the threshold is lost,
   ties included: bounds are integers, and only what is strictly below goes.

Defined cases: each row of the documents is a document of its own, rows with one id too; a null id orders last. A null or
empty text has no terms, is not counted and never found. Items with one id are one item with the terms of all; a null
id is an item too; an item without terms, or whose terms are in no document, has no rows. Empty tables give none. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, materialize, table

#: Documents that an item scores exactly for its threshold, for each result; a matter of pruning, not of results.
SEEDS = 4
#: Rows up to which a written table (a term or two numbers, and numbers) is sent to all tasks; counted before. Larger ones are joined by shuffles.
SENT_ROWS = 200_000


def sent(df: DataFrame) -> tuple[DataFrame, bool]:
    """A written table with the hint to send it to all tasks if it is small enough, and whether it is."""
    small = df.count() <= SENT_ROWS
    return (F.broadcast(df) if small else df), small


def by_row(df: DataFrame) -> DataFrame:
    """Dealt by row before it is written in buckets: a task then writes its own bucket, not a file into each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, times): the number of terms of each row's text, the different ones, and how often each comes.

    A term is a run of ASCII letters and digits and of characters beyond ASCII; in UTF-8, of their bytes. A row with
    terms has one more entry, the empty term, that counts once: it stands for the row itself.
    """
    inside = [chr(c).encode() for c in range(128) if chr(c).isalnum()] + [bytes([c]) for c in range(128, 256)]
    plain = bytes(c if bytes([c]) in inside else 32 for c in range(256)).lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, terms, times, ends = [], [], [], [0]
            for text in b.column("raw").to_pylist():
                words = (text or b"").translate(plain).split()
                found = Counter(words)
                if words:
                    terms.append(b""), times.append(1)
                terms += found.keys()
                times += found.values()
                n.append(len(words)), ends.append(len(terms))
            ends_ = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends_, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(ends_, pa.array(times, pa.int64()))],
                [key, "n", "terms", "times"],
            )

    raw = rows.select(key, F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, n bigint, terms array<binary>, times array<bigint>")


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, doc_id, n, term, tf) for asked(term), in buckets of row; the empty term for each document that has terms."""
    rows = term_counts(docs, "doc_id").where("n > 0").withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"))
    return bucketed(by_row(each.join(asked, "term", "left_semi").select("row", "doc_id", "n", "term", "tf")), "row", "postings")


def impact(documents: int, terms: int) -> Column:
    """The impact of a posting: 10^9 tf div (1000 tf + 20 m), where m is 50 and 50 times n to the mean n."""
    m = F.expr(f"50 + (50 * n * {documents}L) div {terms}L")
    return F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), F.lit(1000) * F.col("tf") + F.lit(20) * m)


def suffixes(asked: DataFrame) -> DataFrame:
    """asked(item_id, term, w, most, bound) with ``essential``, and ``rest``: the greatest sum of the item's other terms."""
    order = Window.partitionBy("item_id").orderBy(F.desc("most"), "term")
    onward = F.sum("most").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    asked = asked.withColumn("essential", onward >= F.greatest("bound", F.lit(1)))
    rest = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))).over(Window.partitionBy("item_id")), F.lit(0))
    return asked.withColumn("rest", rest)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs(doc_id, text) for each of items(item_id, text)."""
    spark = docs.sparkSession
    own = term_counts(items, "item_id").select("item_id", F.explode("terms").alias("term")).distinct()
    own = materialize(own, "search-items")
    posted = postings(docs, sent(materialize(own.select("term").distinct(), "search-asked-terms"))[0])
    size = posted.where("term = X''").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    hits = posted.where("term <> X''").withColumn("impact", impact(size["documents"], size["terms"] or 1))

    df = hits.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    best = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    stored = materialize(hits.select("term", "row", "impact", F.row_number().over(best).alias("place")).where(F.col("place") <= k), "search-stored")
    kth = stored.where(F.col("place") == k).select("term", F.col("impact").alias("kth"))
    weight = F.floor(1000 * F.log((2.0 * size["documents"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    terms = df.withColumn("w", weight).join(kth, "term", "left").where("w > 0")
    terms = materialize(own.join(terms, "term").select("item_id", "term", "w", (F.col("w") * F.col("top")).alias("most"), F.coalesce(F.col("w") * F.col("kth"), F.lit(0)).alias("alone")), "search-terms")

    score = F.sum(F.col("w") * F.col("impact")).alias("score")
    known = terms.select("item_id", "term", "w").join(stored.select("term", "row", "impact"), "term").groupBy("item_id", "row").agg(score)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), "row")
    seeds = known.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SEEDS * k).select("item_id", "row")
    seeds, _ = sent(materialize(seeds, "search-seeds"))
    wanted, _ = sent(terms.select(F.col("item_id").alias("of"), "term", "w"))
    exact = seeds.join(hits.select("row", "term", "impact"), "row").join(wanted, ["term"]).where(F.col("item_id").eqNullSafe(F.col("of"))).groupBy("item_id", "row").agg(score)
    at_k = exact.withColumn("place", F.row_number().over(first)).where(F.col("place") == k).select(F.col("item_id").alias("of"), F.col("score").alias("seeded"))
    alone = terms.groupBy("item_id").agg(F.max("alone").alias("alone"))
    bounds = alone.join(at_k, F.col("item_id").eqNullSafe(F.col("of")), "left").select(F.col("item_id").alias("of"), F.greatest("alone", F.coalesce("seeded", F.lit(0))).alias("bound"))
    asked = terms.join(bounds, F.col("item_id").eqNullSafe(F.col("of"))).select("item_id", "term", "w", "most", "bound")
    asked = materialize(suffixes(asked), "search-asked")

    given, small = sent(asked.where("essential").select("item_id", "term", "w", "bound", "rest"))
    found = hits.select("row", "doc_id", "term", "impact").join(given, "term").groupBy("row", "item_id", "doc_id", "bound", "rest").agg(score)
    found = found.where(F.col("score") + F.col("rest") >= F.col("bound")).select("row", "item_id", "doc_id", "score")
    # with the terms sent to the postings, what is found lies by row already
    found = bucketed(found if small else by_row(found), "row", "search-found")
    others, _ = sent(asked.where("not essential").select(F.col("item_id").alias("of"), "term", "w"))
    more = found.select("row", "item_id").join(hits.join(others, "term", "left_semi").select("row", "term", "impact"), "row")
    more = more.join(others, (more["term"] == others["term"]) & F.col("item_id").eqNullSafe(F.col("of"))).select("row", "item_id", F.lit(None).cast(dict(found.dtypes)["doc_id"]).alias("doc_id"), (F.col("w") * F.col("impact")).alias("score"))
    whole = found.unionByName(more).groupBy("row", "item_id").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search(docs, items)


OP13_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, r, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
z AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT p.*, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS part FROM p JOIN f USING (term), z),
s AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY ALL HAVING sum(part) > 0),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
