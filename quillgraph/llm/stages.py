"""The operators as stages of a corpus pipeline: documents in, documents out.

Each stage judges all it is given and keeps the columns doc_id, text, lang, source, n_chars (the last one adds
what it decides). Documents are told apart by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, mixing, near_dup, suffix_dedup
from .common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in ids(id); a null id is one too."""
    return docs.join(ids.select("id").distinct(), docs["doc_id"].eqNullSafe(F.col("id")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language the compressors reject: no letters, or two languages as good as equal.

    Null and empty texts go; rows with one id go if one of them is rejected; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    found = language_id.classify(docs.select("doc_id", "text"), language_id.train(docs))
    return without(docs, found.where("rejected").select(F.col("doc_id").alias("id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more on sets of five-word shingles: that with the smallest id.

    Texts without words and null ids stay, as they are linked with nothing; rows that repeat the kept id stay all; an empty
    table stays empty.
    """
    docs = docs.select(*COLUMNS)
    found = materialize(near_dup.linked(docs, k=5, percent=80), "stage-near")
    return without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that start in a document with a smaller id; no document goes.

    A null text becomes empty; rows with one id don't remove each other's strings; a null id counts as the largest; an empty
    table stays empty.
    """
    left = suffix_dedup.judged(docs.select(*COLUMNS), carry=["lang", "source"])
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, within the edit budget.

    Null and empty texts and items match nothing; rows with one id go if one of them does; without a benchmark all stay.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("id")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number of times that the mix takes each: ``copies``, 0 to 2, beside ``taken`` words.

    Every row is judged for itself, by the hash of its id: rows with one id are taken alike, each with its own words. Null
    and empty texts have no words and are not taken; a null source is a source; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    per = mixing.limits(materialize(mixing.hashed(docs), "mix"))
    out = mixing.taken(mixing.hashed(docs, carry=["text", "lang", "n_chars"]), per).where("taken > 0")
    return out.select(*COLUMNS, "size", "taken", F.expr("taken div size").alias("copies"))
