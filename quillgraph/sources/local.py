"""Local observations for the merge operators from the text table: this engine's stand-in for extraction.

A text is about its most frequent words. It defines the first one, has a formula of the two first with a symbol for each, speaks
of a third symbol, and states a theorem. Four texts with neighbouring ids are a section. A source is a paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from . import adapters as A


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, pos, l1 ... l4, section_id): the most frequent words of each text that has two."""
    o = A.observations(spark, sf_dir).where("paper_id is not null")
    w = o.groupBy("paper_id", F.col("section_id").alias("pos")).agg(*[F.max(F.when(F.col("pos") == k, F.col("label"))).alias(f"l{k}") for k in range(1, 5)])
    return written(w.where("l2 is not null").withColumn("section_id", F.expr("cast(pos div 4 as string)")), "words")


def definitions(w: DataFrame) -> DataFrame:
    text = F.format_string("the %s of %s is $%s_{%d}$", "l1", "l2", F.upper(F.substring("l1", 1, 1)), F.length("l2"))
    return w.select("paper_id", "pos", F.col("l1").alias("term"), text.alias("definition_text"), F.when(F.col("pos") % 4 == 0, "").otherwise(F.concat_ws(" ", "l1", "l2", "l3")).alias("summary"), (F.col("pos") % 2 == 0).alias("is_formal"), F.when(F.col("pos") % 3 == 0, F.col("pos").cast("string")).alias("definition_number"), "section_id")


def formulas(w: DataFrame) -> DataFrame:
    sym = lambda label, context, role: F.struct(F.substring(label, 1, 1).alias("symbol"), F.lit(None).cast("string").alias("latex"), context.alias("context"), role.alias("role"))
    one = sym("l1", F.concat_ws(" ", "l1", "l2"), F.when(F.length("l1") % 2 == 0, "the  Input").otherwise("weights"))
    two = sym("l2", F.col("l2"), F.lit(None).cast("string"))
    label = F.when(F.col("pos") % 3 == 0, F.col("l1")).when(F.col("pos") % 3 == 1, F.col("l2"))
    latex = F.format_string("%s_{%d}", F.upper(F.substring("l2", 1, 1)), F.length("l1"))
    return w.select("paper_id", "pos", label.alias("label"), latex.alias("latex"), F.concat_ws(" ", "l2", "l1", "l4").alias("summary"), "section_id", F.concat(F.lit("about "), "l1").alias("section_title"), F.array(one, two).alias("symbols"))


def symbols(w: DataFrame) -> DataFrame:
    s = w.where("l3 is not null")
    return s.select("paper_id", "pos", F.substring("l3", 1, 1).alias("symbol"), F.lit(None).cast("string").alias("latex"), F.concat_ws(" ", "l3", "l1").alias("context"), (F.col("pos") % 5 == 0).alias("is_definition"), "section_id", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("on "), "l3")).alias("section_title"))


def theorems(w: DataFrame) -> DataFrame:
    return w.select("paper_id", "pos", F.when(F.col("pos") % 2 == 0, "theorem").otherwise("lemma").alias("type"), (F.col("pos") % 40).cast("string").alias("number"))


def relationships(w: DataFrame) -> DataFrame:
    one = w.select("paper_id", (F.col("pos") * 2).alias("pos"), F.upper("l1").alias("from_entity"), F.col("l2").alias("to_entity"), F.lit("uses").alias("type"), F.concat(F.lit("text "), "pos").alias("evidence"))
    two = w.select("paper_id", (F.col("pos") * 2 + 1).alias("pos"), F.concat(F.when(F.col("pos") % 3 == 0, "").when(F.col("pos") % 2 == 0, "Theorem ").otherwise("Lemma "), (F.col("pos") % 40).cast("string")), F.col("l1"), F.lit("supports"), F.concat(F.lit("text "), "pos"))
    return one.union(two)
