"""Source archives: members of tar and zip files, and which one is the main text."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Usual names of a main file.
COMMON = ["main.tex", "paper.tex", "article.tex", "manuscript.tex", "ms.tex"]


def safe(name: str) -> bool:
    """Whether a member stays under the folder that it is unpacked to."""
    path = posixpath.normpath(name)
    return not (path.startswith(("/", "..")) or path == ".")


def members(name: str, content: bytes) -> list[tuple[str, bytes]]:
    """(path, bytes) of the files of an archive, or of a lone .tex file; other names raise."""
    low = name.lower()
    if low.endswith((".tar.gz", ".tgz", ".tar")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and safe(m.name)]
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(m.filename, z.read(m)) for m in z.infolist() if not m.is_dir() and safe(m.filename)]
    if low.endswith(".tex"):
        return [(posixpath.basename(name), content)]
    raise ValueError(f"not an archive: {name}")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content_id, ord, member, content) of the archives under a path, through Spark's own readers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, key, content in zip(b["path"], b["content_id"], b["content"]):
                yield pd.DataFrame([(name, key, i, m, c) for i, (m, c) in enumerate(members(name, content))], columns=["archive", "content_id", "ord", "member", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_id"), "content")
    return files.mapInPandas(run, "archive string, content_id string, ord long, member string, content binary")


def main_files(found: DataFrame) -> DataFrame:
    """(archive, member): the best .tex member by name, document markers and size; the first of equals."""
    tex = found.where(F.lower("member").endswith(".tex")).withColumn("text", F.decode("content", "ISO-8859-1"))
    name = F.element_at(F.split(F.lower("member"), "/"), -1)
    score = F.when(name.isin(COMMON), 5).otherwise(0) + F.when(F.contains("text", F.lit("\\documentclass")), 3).otherwise(0) + F.when(F.contains("text", F.lit("\\begin{document}")), 3).otherwise(0) + F.least(F.floor(F.length("text") / 5000), F.lit(3))
    return tex.groupBy("archive").agg(F.max_by("member", F.struct(score.alias("s"), (-F.col("ord")).alias("o"))).alias("member"))
