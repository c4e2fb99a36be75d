"""Progress events: batch forms, and the same over a stream of events."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir

# Stages after which nothing follows.
TERMINAL = ("complete", "error", "cancelled")


def latest(events: DataFrame) -> DataFrame:
    """(paper_id, stage, value): the last state of each paper, by time and event."""
    last = F.max_by(F.struct("stage", "value"), F.struct("ts", "event_id"))
    return events.groupBy("paper_id").agg(last.alias("x")).select("paper_id", "x.stage", "x.value")


def changes(events: DataFrame, terminal: str = "error") -> DataFrame:
    """(paper_id, event_id, stage): events whose stage differs from the one before, up to the first terminal one."""
    w = Window.partitionBy("paper_id").orderBy("ts", "event_id")
    e = events.withColumn("before", F.lag("stage").over(w))
    e = e.withColumn("ended", F.coalesce(F.max((F.col("stage") == terminal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return e.where((F.col("ended") == 0) & ~F.col("stage").eqNullSafe(F.col("before"))).select("paper_id", "event_id", "stage")


def percent(events: DataFrame, total: float = 100.0) -> DataFrame:
    """(paper_id, percent): done of all, each event at most its total."""
    return events.groupBy("paper_id").agg(F.round(F.sum(F.least(F.col("value"), F.lit(total))) / (F.count(F.lit(1)) * total) * 100, 4).alias("percent"))


def profile(events: DataFrame) -> DataFrame:
    """(stage, calls, wall): per stage."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("wall"))


def profile_attempts(calls: DataFrame) -> DataFrame:
    """(stage, calls, attempts, retries, wall, tokens, place) of calls(stage, attempts, wall, tokens): the slowest stage first."""
    g = calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("attempts").alias("attempts"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.round(F.sum("wall"), 4).alias("wall"), F.sum("tokens").alias("tokens"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("wall"), "stage")))  # a row for each stage


def nearest_rank(events: DataFrame, p: float = 0.95) -> DataFrame:
    """(stage, value): the element at floor(n * p) of the sorted values, without interpolation.

    Values are counted, each stage's into 4,096 equal ranges; the range with the rank is found from the running counts, and
    only its distinct values are put in order. No stage is sorted as a whole.
    """
    e = events.where("value is not null").groupBy("stage", "value").agg(F.count(F.lit(1)).alias("n"))
    span = e.groupBy("stage").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    span = span.withColumn("want", F.least(F.col("total") - 1, F.floor(F.col("total") * p)))
    width = (F.col("high") - F.col("low")) / 4096
    part = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(4095))).otherwise(F.lit(0))
    e = e.join(span, "stage").withColumn("part", part.cast("int"))
    run = lambda d, by: d.withColumn("upto", F.sum("n").over(Window.partitionBy("stage").orderBy(by)))
    parts = run(e.groupBy("stage", "part").agg(F.sum("n").alias("n"), F.first("want").alias("want")), "part")
    hit = parts.where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want"))).select("stage", "part", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
    inside = run(e.join(hit, ["stage", "part"]), "value")
    return inside.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left"))).select("stage", "value")


def stream_changes(events: DataFrame, timeout_ms: int = 30_000, heartbeat_ms: int | None = None) -> DataFrame:
    """(paper_id, stage, value, kind) from a stream of events(paper_id, event_id, ts, stage, value): each state that differs from the one
    before, up to the first terminal one; where nothing comes for ``timeout_ms``, an error that says so. With ``heartbeat_ms`` the
    last state is repeated as often while nothing comes. What has ended keeps a flag until the next timer and then leaves the state."""
    wait = min(timeout_ms, heartbeat_ms or timeout_ms)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        stage, value, ended, quiet = state.get if state.exists else (None, None, False, 0)
        if state.hasTimedOut:
            quiet += wait
            if ended or quiet >= timeout_ms:
                if not ended:
                    rows.append((key[0], "error", None, "timeout"))
                state.remove()
            else:
                rows.append((key[0], stage, value, "heartbeat"))
                state.update((stage, value, ended, quiet))
                state.setTimeoutDuration(min(wait, timeout_ms - quiet))
        else:
            got = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for s, v in zip(got["stage"], got["value"].astype(object).where(got["value"].notna(), None)):
                if not ended and (s, v) != (stage, value):
                    stage, value, ended = s, v, s in TERMINAL
                    rows.append((key[0], s, v, "change"))
            state.update((stage, value, ended, 0))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["paper_id", "stage", "value", "kind"])

    kind = dict(events.dtypes)["paper_id"]
    e = events.select("paper_id", "event_id", "ts", "stage", "value")
    return e.groupBy("paper_id").applyInPandasWithState(step, f"paper_id {kind}, stage string, value double, kind string", "stage string, value double, ended boolean, quiet long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Busy(RuntimeError):
    """A paper's build runs already."""


class Builds:
    """Builds of papers: one for each at a time, each under a tag by which its jobs are cancelled, whichever driver started it.

    A build's claim is a file of ``folder`` (in the shared folder, if none is given), created only if it isn't there: that is one atomic
    step of file systems like HDFS and local ones. A wish to cancel is a file beside it, which the build sees after each step; a
    build of this driver is interrupted at once. Each step renews its claim; one that wasn't renewed for ``stale_s`` seconds, as its
    driver died, may be taken over.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, stale_s: float = 3600.0) -> None:
        self.spark, self.stale_s = spark, stale_s
        self.folder = folder or f"{shared_dir(spark)}/builds"
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.hadoop.Path(self.folder))

    def _file(self, paper: str, kind: str):
        return self.hadoop.Path(f"{self.folder}/{hashlib.sha256(str(paper).encode()).hexdigest()}.{kind}")

    def running(self, paper: str) -> bool:
        claim = self._file(paper, "claim")
        return self.files.exists(claim) and time.time() - self.files.getFileStatus(claim).getModificationTime() / 1000 < self.stale_s

    @contextmanager
    def only(self, paper: str) -> Iterator[None]:
        """Jobs started inside are the paper's; a second build of it raises ``Busy``. An old wish to cancel is forgotten."""
        claim = self._file(paper, "claim")
        if self.files.exists(claim) and not self.running(paper):
            self.files.delete(claim, False)
        if not self.files.createNewFile(claim):
            raise Busy(paper)
        self.files.delete(self._file(paper, "cancel"), False)
        self.spark.addTag(f"build-{paper}")
        try:
            yield
        finally:
            self.spark.removeTag(f"build-{paper}")
            self.files.delete(claim, False)

    def cancel(self, paper: str) -> None:
        self.files.createNewFile(self._file(paper, "cancel"))
        self.spark.interruptTag(f"build-{paper}")

    def steps(self, paper: str, steps: list, told=lambda done, total: None) -> Iterator:
        """The results of steps, functions without arguments; after each one ``told`` hears of it, and then a wish to cancel ends the build."""
        for k, step in enumerate(steps):
            result = step()
            told(k + 1, len(steps))
            if self.files.exists(self._file(paper, "cancel")):
                raise InterruptedError(f"the build of {paper} was cancelled")
            now = int(time.time() * 1000)
            if self.files.exists(self._file(paper, "claim")):
                self.files.setTimes(self._file(paper, "claim"), now, now)
            yield result


def stream_latest(spark, path: str, schema, name: str):
    """A streaming query that keeps each paper's latest state in the memory table ``name``."""
    e = spark.readStream.schema(schema).parquet(path)
    last = e.groupBy("paper_id").agg(F.max_by(F.struct("stage", "value"), F.struct("ts", "event_id")).alias("x")).select("paper_id", "x.stage", "x.value")
    return last.writeStream.outputMode("complete").format("memory").queryName(name).start()
