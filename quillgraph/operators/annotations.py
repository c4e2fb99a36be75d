"""Reader annotations: comments on nodes, glossary notes on entities, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comments(a: DataFrame) -> DataFrame:
    return a.where("dom_node_id is not null and entity_id is null")


def glossary(a: DataFrame) -> DataFrame:
    return a.where("entity_id is not null")


def priority(newest_first: bool) -> list[Column]:
    """Pinned first, then by display order, then the newest (nulls as 999999), or the oldest and id (nulls last)."""
    if newest_first:
        return [F.desc("is_pinned"), F.coalesce("display_order", F.lit(999999)), F.desc("created_at"), F.col("id")]
    return [F.desc("is_pinned"), F.col("display_order").asc_nulls_last(), F.col("created_at"), F.col("id")]


def prioritised(a: DataFrame, newest_first: bool) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy(*priority(newest_first))
    return a.select("paper_id", "id", F.row_number().over(w).alias("place"))


def by_day(a: DataFrame) -> DataFrame:
    """(day, n, first_id), days descending."""
    return a.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def glossary_groups(a: DataFrame) -> DataFrame:
    """(prefix, n): notes by what stands before the first underscore; ``manual_`` ones together."""
    p = F.when(F.startswith("entity_id", F.lit("manual_")), "manual").otherwise(F.substring_index("entity_id", "_", 1))
    return glossary(a).groupBy(p.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def note_upsert(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """Notes after updates(paper_id, entity_id, content): the earliest note of an entity takes the new content, an entity
    without one gets a note; blank contents change nothing."""
    w = Window.partitionBy("paper_id", "entity_id").orderBy("created_at", "id")
    own = notes.where("entity_id is not null").withColumn("n", F.row_number().over(w))
    u = updates.where(F.trim("content") != "").select("paper_id", "entity_id", F.col("content").alias("new"))
    j = own.join(u, ["paper_id", "entity_id"], "full")
    content = F.when(F.col("n").isNull() | (F.col("n") == 1), F.coalesce("new", "content")).otherwise(F.col("content"))
    return j.select("paper_id", "entity_id", F.coalesce("id", F.concat_ws("-", F.lit("new"), "paper_id", "entity_id")).alias("id"), content.alias("content"))


def apply_suggestions(suggestions: DataFrame, notes: DataFrame) -> DataFrame:
    """(paper_id, entity_id, content): suggestions whose entity has no note yet, the first of each entity."""
    w = Window.partitionBy("paper_id", "entity_id").orderBy("id")
    one = suggestions.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return one.join(notes.where("entity_id is not null").select("paper_id", "entity_id").distinct(), ["paper_id", "entity_id"], "left_anti").select("paper_id", "entity_id", "content")
