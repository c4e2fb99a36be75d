"""Where a user's own functions join in: extraction, analysis of formulas, resolution of names, grouping of notes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..sources.shared import written


class Extractor(Protocol):
    """Takes a section (paper_id, section_id, text) and gives its observations, rows of the output's columns after these two."""

    def __call__(self, paper_id: object, section_id: object, text: str) -> list[tuple]: ...


def extracted(sections: DataFrame, extract: Extractor, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): what ``extract`` finds in each section, in tasks; a section that it fails on gives an error, the others go on.

    The answers are written once, and rows and errors are read from there: both are of one call.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(sections.dtypes)
    key = f"paper_id {kinds['paper_id']}, section_id {kinds['section_id']}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, section, text in zip(b["paper_id"], b["section_id"], b["text"]):
                try:
                    rows += [(paper, section, *r, None) for r in extract(paper, section, text or "")]
                except Exception as e:
                    rows.append((paper, section, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["paper_id", "section_id", *names, "error"])

    out = written(sections.select("paper_id", "section_id", "text").mapInPandas(run, f"{key}, {schema}, error string"), "extracted")
    return out.where("error is null").drop("error"), out.where("error is not null").select("paper_id", "section_id", "error")


def analysed(equations: DataFrame, analyse: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``analyse`` says of batches of equations(paper_id, equation_id, latex): frames of the schema's columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield analyse(b)

    return equations.select("paper_id", "equation_id", "latex").mapInPandas(run, schema)


def resolved(name: Column, resolve: Callable[[str], str | None]) -> Column:
    """Names led to what ``resolve`` makes of them, each different one of a batch asked for once; null where it has no answer."""

    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        known = {x: resolve(x) for x in s.dropna().unique()}
        return s.map(lambda x: known.get(x))

    return run(name)


#: Ways to group notes(paper_id, id, dom_node_id, created_at): functions of notes to (paper_id, group, n).
GROUPINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "flat": lambda notes: notes.groupBy("paper_id", F.lit("all").alias("group")).agg(F.count(F.lit(1)).alias("n")),
    "day": lambda notes: notes.groupBy("paper_id", F.date_format("created_at", "yyyy-MM-dd").alias("group")).agg(F.count(F.lit(1)).alias("n")),
    "node": lambda notes: notes.groupBy("paper_id", F.col("dom_node_id").alias("group")).agg(F.count(F.lit(1)).alias("n")),
}


def grouped(notes: DataFrame, how: str) -> DataFrame:
    if how not in GROUPINGS:
        raise ValueError(f"no grouping {how}; there are {sorted(GROUPINGS)}")
    return GROUPINGS[how](notes)


def merged_state(parts: list[DataFrame]) -> DataFrame:
    """Lists that several steps add to, as one table."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole
