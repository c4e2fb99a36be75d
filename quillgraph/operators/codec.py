"""A paper's document as one JSON text, and back: tables are nested in order, and read again under a declared schema.

A document is ``schema_version``, its parts (arrays of rows) and ``metrics`` (the number of rows of each part). Reading is strict:
a key that isn't declared, a field that isn't of its type, a missing part, a rule that a row breaks and a count that doesn't
fit each give an error, with where it lies. All of it is column expressions, a paper a row: a document is one cell by its nature, in
memory as large as it is; its tables are the form for work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .document import KINDS, TYPES

VERSION = "3.0"

Rule = tuple[str, str, Callable[[Column], Column]]

#: What rows must keep: part, field, and a condition of the field; null fields keep all but the first kind.
FILLED: list[tuple[str, str]] = [("objects", "stable_id"), ("objects", "label"), ("relations", "stable_id"), ("relations", "source_id"), ("relations", "target_id"), ("equations", "stable_id"), ("notation", "stable_id"), ("notation", "symbol")]
RULES: list[Rule] = [
    ("objects", "kind", lambda c: c.isin(KINDS)),
    ("relations", "type", lambda c: c.isin(TYPES)),
    *[("objects", f, lambda c: (c >= 0) & (c <= 1)) for f in ("contribution", "prominence", "familiarity", "confidence", "recurrence")],
    ("relations", "confidence", lambda c: (c >= 0) & (c <= 1)),
]


def schema_of(tables: dict[str, DataFrame]) -> dict[str, StructType]:
    """The declared schema: the columns of each part but the paper's id."""
    return {name: StructType([f for f in d.schema.fields if f.name != "paper_id"]) for name, d in tables.items()}


def nested(tables: dict[str, DataFrame], papers: DataFrame) -> DataFrame:
    """(paper_id, document, bytes) of papers(paper_id): the rows of each part in order of their columns; nulls are written out."""
    out = papers.select("paper_id").distinct()
    for name, d in tables.items():
        row = F.struct(*[c for c in d.columns if c != "paper_id"])
        per = d.groupBy("paper_id").agg(F.array_sort(F.collect_list(row)).alias(name))
        out = out.join(per, "paper_id", "left").withColumn(name, F.coalesce(name, F.array().cast(ArrayType(schema_of({name: d})[name]))))
    counts = F.struct(*[F.size(name).alias(f"{name}_count") for name in tables]).alias("metrics")
    body = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *tables, counts), {"ignoreNullFields": "false"})
    return out.select("paper_id", body.alias("document")).withColumn("bytes", F.octet_length("document"))


def _lost(field: str) -> Callable[[Column], Column]:
    """Of a row read under the schema, beside the same row as texts: whether the field was given, but isn't of its type."""
    return lambda x: x["l"][field].isNotNull() & x["r"][field].isNull()


def _breaks(field: str, ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda row: ~F.coalesce(ok(row[field]), F.lit(True))


def parsed(raw: DataFrame, schema: dict[str, StructType], filled: list[tuple[str, str]] = FILLED, rules: list[Rule] = RULES) -> DataFrame:
    """(paper_id, status, errors, part ...) of raw(paper_id, document): ``none`` without a document, ``rebuild`` for another version, ``malformed``
    with errors, else ``ready``. Only ready documents have parts."""
    none = F.array().cast("array<string>")
    d = raw.select("paper_id", "document", F.get_json_object("document", "$.schema_version").alias("version"), F.json_object_keys("document").alias("keys"))
    errors = [F.transform(F.array_except(F.coalesce("keys", none), F.array(*map(F.lit, ["schema_version", "metrics", *schema]))), lambda k: F.concat(F.lit("unknown key "), k))]
    for name, struct in schema.items():
        text = F.get_json_object("document", f"$.{name}")
        d = d.withColumn(name, F.from_json(text, ArrayType(struct))).withColumn(f"_{name}", F.from_json(text, "array<map<string,string>>")).withColumn(f"#{name}", F.get_json_object("document", f"$.metrics.{name}_count").cast("long"))
        rows, loose = F.col(name), F.col(f"_{name}")
        errors.append(F.when(rows.isNull() | loose.isNull() | F.exists(loose, lambda r: r.isNull()), F.array(F.lit(f"{name}: no list of objects"))).otherwise(none))
        fields = F.array(*map(F.lit, struct.names))
        errors.append(F.transform(F.array_distinct(F.flatten(F.transform(loose, lambda r: F.array_except(F.map_keys(r), fields)))), lambda k: F.concat(F.lit(f"{name}: unknown key "), k)))
        both = F.arrays_zip(rows.alias("r"), loose.alias("l"))
        for f in struct.names:
            errors.append(F.when(F.exists(both, _lost(f)), F.array(F.lit(f"{name}.{f}: not of its type"))).otherwise(none))
        for f in [f for part, f in filled if part == name and f in struct.names]:
            errors.append(F.when(F.exists(rows, _breaks(f, lambda c: F.coalesce(c, F.lit("")) != "")), F.array(F.lit(f"{name}.{f}: empty"))).otherwise(none))
        for f, ok in [(f, ok) for part, f, ok in rules if part == name and f in struct.names]:
            errors.append(F.when(F.exists(rows, _breaks(f, ok)), F.array(F.lit(f"{name}.{f}: out of bounds"))).otherwise(none))
        errors.append(F.when(F.coalesce(F.col(f"#{name}") != F.size(rows), F.col(f"#{name}").isNull()), F.array(F.lit(f"metrics.{name}_count: not the number of rows"))).otherwise(none))
    found = F.flatten(F.array(*[F.coalesce(e, none) for e in errors]))
    blank = F.coalesce(F.trim("document"), F.lit("")) == ""
    status = F.when(blank, "none").when(F.col("keys").isNull(), "malformed").when(F.coalesce(F.col("version") != VERSION, F.lit(True)), "rebuild").when(F.size("found") > 0, "malformed").otherwise("ready")
    d = d.withColumn("found", F.when(blank, none).when(F.col("keys").isNull(), F.array(F.lit("not a JSON object"))).otherwise(found)).withColumn("status", status)
    told = F.when(F.col("status") == "malformed", F.col("found")).otherwise(none)
    return d.select("paper_id", "status", told.alias("errors"), *[F.when(F.col("status") == "ready", F.col(name)).alias(name) for name in schema])


def part(documents: DataFrame, name: str) -> DataFrame:
    """The rows of one part of ``parsed`` documents, as the table that it was."""
    return documents.select("paper_id", F.explode(name).alias("row")).select("paper_id", "row.*")
