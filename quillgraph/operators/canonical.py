"""From observations to canonical entities, relations, surfaces and occurrences."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..sources.dom import slices
from ..sources.shared import written
from .graph import components


def content_dedup(docs: DataFrame) -> DataFrame:
    """(content_id, id, copies): one row for each content, by SHA-256, with the least id."""
    d = docs.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id"))
    return d.groupBy("content_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def kind_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("paper_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def stable_ids(obs: DataFrame) -> DataFrame:
    """(id, stable_id) of ASCII labels."""
    return obs.select("id", T.stable_identifier(F.col("kind"), T.normalize_ascii(F.col("label")), None, F.concat(F.col("paper_id"), F.lit(" "), F.col("section_id").cast("string"))).alias("stable_id"))


def label_groups(obs: DataFrame) -> DataFrame:
    """(paper_id, kind, label, members, first_id, recurrence, confidence): entities where labels alone decide: the signals of
    each group of equal labels, and its representative, the least observation."""
    g = obs.groupBy("paper_id", "kind", T.normalize_ascii(F.col("label")).alias("label"))
    return g.agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"), F.round(F.avg("confidence"), 6).alias("confidence")).withColumn("recurrence", F.round(F.least(F.lit(1.0), F.col("members") / 3), 6))


def entities(obs: DataFrame) -> DataFrame:
    """``groups`` of observations with a label and one alias."""
    return groups(obs.select("paper_id", "kind", "id", "label", F.array("alias").alias("aliases")))


def groups(obs: DataFrame) -> DataFrame:
    """(paper_id, kind, entity_id, observation_id): greedy groups of observations(paper_id, kind, id, label, aliases).

    Observations in order of id join the first group of their kind with which they share a normalised name, and
    widen it; groups are not joined later. Only observations whose names hang together can meet, so Spark finds the components
    of names that stand in one observation first. Where all observations of a component have the same names, they
    are one group, named by the least id, however many they are. In other components the order decides (even a repeat of the same names may
    go elsewhere once another row has widened an earlier group): each is a grouped map of ids and names.
    """
    own = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = written(obs.select("paper_id", "kind", "id", T.normalize_texts(own).alias("names")), "names")
    # a struct is a key of joins that nulls in it don't break
    names = names.select(F.struct("paper_id", "kind").alias("at"), "id", "names")
    links = names.where(F.size("names") > 1).select(F.col("at").alias("paper_id"), F.col("names")[0].alias("source_id"), F.explode(F.slice("names", 2, 1 << 30)).alias("target_id")).distinct()
    links = written(links, "name-links")
    rows = names.where(F.size("names") > 0).withColumn("component", F.col("names")[0])
    if not links.isEmpty():
        ends = links.select("paper_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        known = components(ends, links).select(F.col("paper_id").alias("at"), F.col("id").alias("component"), F.col("component").alias("whole"))
        rows = rows.join(known, ["at", "component"], "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    per = rows.groupBy("at", "component").agg(F.min("id").alias("least"), (F.min("names") == F.max("names")).alias("alike"))
    rows = rows.join(per, ["at", "component"])
    of = ["at.paper_id", "at.kind"]
    kinds = dict(obs.dtypes)

    def group(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        first: dict[str, int] = {}
        reps: list = []
        out = []
        for x, own in zip(p["id"], p["names"]):
            # a name leads to the first group that has it
            g = min((first[n] for n in own if n in first), default=len(reps))
            if g == len(reps):
                reps.append(x)
            for n in own:
                first[n] = min(first.get(n, g), g)
            out.append(reps[g])
        return pd.DataFrame({"paper_id": p["paper_id"], "kind": p["kind"], "entity_id": out, "observation_id": p["id"]})

    same = rows.where("alike").select(*of, F.col("least").alias("entity_id"), F.col("id").alias("observation_id"))
    key = ["paper_id", "kind", "component"]
    mixed = rows.where("not alike").select(*of, "component", "id", "names").groupBy(*key).applyInPandas(group, f"paper_id {kinds['paper_id']}, kind string, entity_id {kinds['id']}, observation_id {kinds['id']}")
    nameless = names.where(F.size("names") == 0).select(*of, F.col("id").alias("entity_id"), F.col("id").alias("observation_id"))
    return same.union(mixed).union(nameless)


def label_collisions(obs: DataFrame) -> DataFrame:
    """(paper_id, label, kinds): labels that stand for several kinds."""
    g = obs.groupBy("paper_id", T.normalize_ascii(F.col("label")).alias("label")).agg(F.countDistinct("kind").alias("kinds"))
    return g.where("kinds > 1")


def duplicate_signatures(obs: DataFrame) -> DataFrame:
    """(paper_id, duplicates): how many observations repeat another's kind and label."""
    g = obs.groupBy("paper_id", "kind", T.normalize_ascii(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("paper_id").agg(F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)).alias("duplicates"))


def surfaces(obs: DataFrame) -> DataFrame:
    """(paper_id, subject, surface, generated): labels of two characters at least, and their other number where one subject
    alone has it and no label says it."""
    # written, as it is read three times
    lab = written(obs.select("paper_id", F.lower("label").alias("subject")).distinct().where(F.length("subject") >= 2), "labels")
    made = lab.select("paper_id", "subject", T.plural_variant(F.col("subject")).alias("surface")).where("surface is not null")
    once = made.groupBy("paper_id", "surface").agg(F.min("subject").alias("subject"), F.countDistinct("subject").alias("n")).where("n = 1")
    free = once.join(lab.select("paper_id", F.col("subject").alias("surface")), ["paper_id", "surface"], "left_anti")
    own = lab.select("paper_id", "subject", F.col("subject").alias("surface"), F.lit(False).alias("generated"))
    return own.union(free.select("paper_id", "subject", "surface", F.lit(True)))


def occurrence_counts(docs: DataFrame, surf: DataFrame) -> DataFrame:
    """(paper_id, subject, occurrences): one-word surfaces in texts(paper_id, id, text), by equality of ASCII words."""
    t = docs.select("paper_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("surface"))
    n = t.groupBy("paper_id", "surface").agg(F.count(F.lit(1)).alias("n"))
    return n.join(surf, ["paper_id", "surface"]).groupBy("paper_id", "subject").agg(F.sum("n").alias("occurrences"))


#: A word, or one other character: what texts and surfaces are made of.
UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"


def occurrences(nodes: DataFrame, surf: DataFrame) -> DataFrame:
    """(paper_id, node, start, end, text, subject, more ...): anchored mentions in nodes(paper_id, node, text, more columns ...).

    Surfaces match without regard to case, not inside words; of overlapping matches in a node the earliest, then
    the longest, then the first subject stays. A surface is a run of units: words, and single other characters. A node's units
    look up their paper's surfaces by the first one, whatever it is; beside a node its own are a tree by units, and one walk
    from each unit finds all that begin there. Blank surfaces match nothing.
    """
    unit = lambda c: F.regexp_extract_all(F.lower(c), F.lit(UNIT), F.lit(0))
    s = surf.select("paper_id", unit(F.trim("surface")).alias("units"), "subject").where(F.size("units") > 0)
    # of equal surfaces only the first subject is ever taken
    s = s.groupBy("paper_id", "units").agg(F.min("subject").alias("subject")).withColumn("unit", F.col("units")[0])
    kinds = dict(nodes.dtypes)
    pattern = re.compile(r"\w+|\W")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [list(set(map(str.lower, pattern.findall(x)))) for x in b["text"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64())
            yield pa.RecordBatch.from_arrays([b["paper_id"].take(at), b["node"].take(at), pa.array([u for x in own for u in x], pa.string())], names=["paper_id", "node", "unit"])

    own = nodes.select("paper_id", "node", "text").mapInArrow(apart, f"paper_id {kinds['paper_id']}, node {kinds['node']}, unit string")
    hit = own.join(s, ["paper_id", "unit"]).groupBy("paper_id", "node").agg(F.collect_list(F.struct("units", "subject")).alias("s"))
    rest = [c for c in nodes.columns if c not in ("paper_id", "node", "text")]
    both = nodes.join(hit, ["paper_id", "node"]).select("paper_id", "node", "text", F.col("s.units").alias("surfaces"), F.col("s.subject").alias("subjects"), *rest)
    out = f"paper_id {kinds['paper_id']}, node {kinds['node']}, start long, end long, text string, subject string" + "".join(f", {c} {kinds[c]}" for c in rest)
    fields = to_arrow_schema(StructType.fromDDL(out))

    def places(text: str, forms: Iterable[list[str]], owners: list[str]) -> Iterator[tuple[int, int, str]]:
        tree: dict = {}
        for form, owner in zip(forms, owners):
            at = tree
            for u in form:
                at = at.setdefault(u, {})
            at[None] = min(owner, at.get(None, owner))
        units = pattern.findall(text)
        low = [u.lower() for u in units]
        ends = list(itertools.accumulate(map(len, units)))
        word = lambda k: low[k][-1].isalnum() or low[k][-1] == "_"
        end = 0
        for i, first in enumerate(low):
            if first not in tree:
                continue
            start = ends[i] - len(units[i])
            # what begins with a mark must not stand behind a word, what ends with one not before a word
            if start < end or (i and not word(i) and word(i - 1)):
                continue
            at, best = tree, None
            for k in range(i, len(units)):
                at = at.get(low[k])
                if at is None:
                    break
                if None in at and (word(k) or k + 1 == len(units) or not word(k + 1)):
                    best = (ends[k], at[None])
            if best:
                end = best[0]
                yield start, end, best[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            # lists of lists become Python objects all words at once, by way of NumPy: one by one that takes longer than the walk
            flat = lambda c: iter(c.to_numpy(zero_copy_only=False).tolist())
            forms = b["surfaces"].flatten()
            words, sizes, owners = flat(forms.flatten()), flat(forms.value_lengths()), flat(b["subjects"].flatten())
            at, start, end, text, owner = found = [], [], [], [], []
            for i, (x, n) in enumerate(zip(b["text"].to_pylist(), b["surfaces"].value_lengths().to_pylist())):
                own = [list(itertools.islice(words, k)) for k in itertools.islice(sizes, n)]
                for p, q, who in places(x, own, list(itertools.islice(owners, n))):
                    for column, value in zip(found, (i, p, q, x[p:q], who)):
                        column.append(value)
            at = pa.array(at, pa.int64())
            columns = [b["paper_id"].take(at), b["node"].take(at), start, end, text, owner, *(b[c].take(at) for c in rest)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return both.mapInArrow(run, out)


def evidence_dedup(obs: DataFrame) -> DataFrame:
    """(paper_id, section_id, label, id): the first observation of each place and quote."""
    w = Window.partitionBy("paper_id", "section_id", "label").orderBy("id")
    return obs.withColumn("n", F.row_number().over(w)).where("n = 1").select("paper_id", "section_id", "label", "id")


def evidence_order(obs: DataFrame) -> DataFrame:
    """(id, place): evidence of each paper in reading order."""
    w = Window.partitionBy("paper_id").orderBy(F.col("section_id").asc_nulls_last(), F.col("pos").asc_nulls_last(), "id")
    return obs.select("id", F.row_number().over(w).alias("place"))


def violations(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(paper_id, rule, key): what a document must not have: repeated ids, loops, ends that aren't there, no evidence."""
    out = []
    for name, d in (("object id", objects), ("relation id", relations)):
        out.append(d.groupBy("paper_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("paper_id", F.lit(f"repeated {name}").alias("rule"), F.col("id").alias("key")))
    out.append(relations.where("source_id = target_id").select("paper_id", F.lit("loop"), "id"))
    for end in ("source", "target"):
        ids = objects.select("paper_id", F.col("id").alias(f"{end}_id"))
        out.append(relations.join(ids, ["paper_id", f"{end}_id"], "left_anti").select("paper_id", F.lit(f"unknown {end}"), "id"))
    out.append(relations.where("coalesce(evidence, 0) < 1").select("paper_id", F.lit("no evidence"), "id"))
    whole = out[0]
    for d in out[1:]:
        whole = whole.union(d)
    return whole


def relation_dedup(rows: DataFrame) -> DataFrame:
    """(paper_id, source_id, target_id, type, id): of relations of the same ends and type the last observation wins; loops go."""
    w = Window.partitionBy("paper_id", "source_id", "target_id", "type").orderBy(F.desc("id"))
    return rows.where("source_id <> target_id").withColumn("n", F.row_number().over(w)).where("n = 1").select("paper_id", "source_id", "target_id", "type", "id")
