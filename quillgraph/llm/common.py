"""What the operators of this subpackage share: the shared folder, written tables, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset, one of our own in local mode, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillgraph-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark drops an execution's shuffle files as soon as it ends, where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: the written table takes their place."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``materialize``, and the path, for tables that are dropped when nothing reads them any more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return written(df, name, codec)[0]


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, as many as a shuffle has partitions: joins by the key
    read it where it lies. The table is external, and only this session's catalog names it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    own = path.rsplit("/", 1)[1].replace("-", "_")
    with shuffles_dropped(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd").saveAsTable(own)
    return spark.table(own)


def drop_table(spark: SparkSession, df_path: str) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df_path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(id, comp)``; comp is the smallest id reachable.

    Alternating large-star and small-star rounds: each is a partially aggregated minimum and a
    join back, so a hub of any degree is spread by the skew join. Every round is written to the shared
    folder. Nodes without an edge do not appear; null endpoints and loops are dropped; repeated edges
    count once.
    """
    e = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if e.isEmpty():
        return e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    for _ in range(max_rounds):
        sym = e.union(e.select("b", "a"))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        before, e = e, materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        # both hold distinct rows: of the same number and none new, they are equal
        if e.count() == before.count() and e.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots)
