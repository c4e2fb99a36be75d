"""Near-duplicate documents by HyperMinHash.

A document is the set of its shingles of k words. Shingle hashes are dealt to M registers; a register
keeps its least hash as leading-zero count (6 bits) and mantissa (10 bits). Bands of compressed registers are the
candidates' keys. Links are confirmed on the full sets:

1. equal sets are one class (by 128-bit digest), represented by the smallest id;
2. buckets of a few classes give their pairs; larger buckets have a few hubs, and a class is paired with the hubs that
   most of a fixed number of its larger buckets name. Pairs whose collision-corrected estimate may reach the
   threshold are verified on the full sets and make components: groups of copies collapse here, without all pairs;
3. larger buckets that still hold several components are compared in blocks, first by sketches, then, for the
   classes with a plausible partner, on the full sets. Only real links leave the block, and none is left out.

Bands of R = 5 registers, B = 40 of them, miss a pair of similarity 0.8 with a chance of (1 - 0.8^5)^40 = 1e-7.

Defined cases: a document with fewer than k words is one shingle, its whole sequence; one without words is an empty set,
linked with nothing; rows with the same id are one document, the different texts of which are linked and compared each;
null ids link with nothing, their component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, table

#: Bands, registers in a band, and with them registers in all.
B, R = 40, 5
M = B * R
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Buckets up to this size give their pairs; larger ones are compared in blocks of so many classes.
SMALL, BLOCK = 8, 1024
#: Members of a larger bucket, chosen by hash, that every other one is paired with first.
HUBS = 8
#: Of a class's larger buckets, so many name the hubs that it is paired with.
NAMING = 4
#: Chance that registers of different hashes agree: equal zeros (1/3) and equal mantissa.
COLLISION = 2.0**-MANTISSA / 3
#: Standard deviations that an estimate may lie under the threshold.
SIGMAS = 5
MULTIPLY, MIX = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; words are runs of bytes other than ASCII white space."""

    def __init__(self, k: int) -> None:
        self.k, self.memo = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.zeros(0, dtype=np.uint64)
        if len(self.memo) > 500_000:
            self.memo.clear()
        memo = self.memo
        hashes = np.array([memo.get(w) or memo.setdefault(w, xxhash.xxh64_intdigest(w)) for w in found], dtype=np.uint64)
        n = max(len(hashes) - self.k + 1, 1)
        out = np.full(n, min(len(hashes), self.k), dtype=np.uint64)
        for i in range(min(self.k, len(hashes))):
            out = (out ^ hashes[i : i + n]) * MULTIPLY
            out ^= out >> np.uint64(31)
        return np.unique(_mixed(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 (M,): by register, leading zeros and mantissa of its least hash; EMPTY without one."""
    out = np.full(M, EMPTY)
    if not len(shingles):
        return out
    at = (shingles >> np.uint64(40)) % np.uint64(M)
    value = _mixed(shingles + MULTIPLY) >> np.uint64(8)
    both = np.sort((at << np.uint64(56)) | value)
    place = (both >> np.uint64(56)).astype(np.int64)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    least = both[first] & np.uint64((1 << 56) - 1)
    # the highest 53 bits of a hash decide both parts; frexp gives the bit length exactly
    least = np.maximum(least >> np.uint64(3), np.uint64(1))
    length = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    mantissa = (least << (np.uint64(53) - length)) >> np.uint64(53 - 1 - MANTISSA)
    out[place[first]] = ((np.uint64(53) - length) << np.uint64(MANTISSA) | (mantissa & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    return out


def band_keys(reg: np.ndarray) -> list[int]:
    """A key for each band that isn't empty; its low six bits are the band's number."""
    bands = reg.reshape(B, R)
    h = np.arange(1, B + 1, dtype=np.uint64) * MIX
    for i in range(R):
        h = (h ^ bands[:, i].astype(np.uint64)) * MULTIPLY
        h ^= h >> np.uint64(32)
    h = (_mixed(h) & ~np.uint64(63)) | np.arange(B, dtype=np.uint64)
    return h[(bands != EMPTY).any(1)].view(np.int64).tolist()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, keys) of every document; digest null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(k)
        for b in batches:
            rows = []
            for text in b["text"]:
                s = cut(text)
                reg = registers(s)
                rows.append((len(s), hashlib.md5(s.tobytes()).hexdigest() if len(s) else None, reg.tobytes(), band_keys(reg)))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "sketch", "keys"])
            out.insert(0, "doc_id", b["doc_id"].values)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest string, sketch binary, keys array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents in ids(id): sorted 64-bit hashes as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(k)
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"].values, "shingles": [cut(t).tobytes() for t in b["text"]]})

    # a plan of one shape at every size: the ids grow with the documents and are never broadcast
    some = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return some.mapInPandas(run, f"id {dict(docs.dtypes)['doc_id']}, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| of their full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.loc[np.array(keep, dtype=bool), ["a", "b"]]

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    kind = dict(pairs.dtypes)["a"]
    return both.mapInPandas(run, f"a {kind}, b {kind}")


def plausible(same: np.ndarray, used: np.ndarray, goal: float) -> np.ndarray:
    """Whether pairs with ``same`` equal of ``used`` registers may have a similarity of ``goal``: the estimate,
    corrected for collisions, is at most SIGMAS standard deviations below it."""
    n = np.maximum(used, 1)
    j = (same / n - COLLISION) / (1 - COLLISION)
    return j >= goal - SIGMAS * np.sqrt(goal * (1 - goal) / n)


def compared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal, used) registers of every row of x with every row of y."""
    a, b = (x != EMPTY).astype(np.float32), (y != EMPTY).astype(np.float32)
    used = np.rint(a.sum(1)[:, None] + b.sum(1)[None, :] - a @ b.T).astype(np.int64)
    step = max(1, (1 << 22) // (len(y) * M))
    equal = np.concatenate([np.count_nonzero(x[i : i + step, None, :] == y[None, :, :], axis=2) for i in range(0, len(x), step)])
    return equal - (M - used), used


def matrix(sketch: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), dtype=np.uint16).reshape(-1, M)


def plausible_pairs(pairs: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches can't rule out."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = matrix(b["x"]), matrix(b["y"])
                used = (x != EMPTY) | (y != EMPTY)
                yield b.loc[plausible(((x == y) & used).sum(1), used.sum(1), percent / 100), ["a", "b"]]

    own = sk.select(F.col("doc_id").alias("id"), "sketch")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(run, f"a {kind}, b {kind}").distinct()


def blocks(members: DataFrame, what: str) -> DataFrame:
    """Rows (key, ids, comps, sides, values), one for each pair of blocks of each bucket: members(key, size, id, comp, what).

    side 0 and 2 are the two blocks of a pair, 1 is a block with itself; a row holds 2 * BLOCK members or so.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    m = members.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    m = m.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("with"), 1).when(F.col("mine") < F.col("with"), 0).otherwise(2)
    m = m.withColumn("part", F.least("mine", "with")).withColumn("other", F.greatest("mine", "with")).withColumn("side", side)
    one = F.struct("id", "comp", "side", F.col(what).alias("value"))
    g = m.groupBy("key", "part", "other").agg(F.collect_list(one).alias("m"))
    return g.select("key", *[F.col("m")[f].alias(f"{f}s") for f in ("id", "comp", "side", "value")])


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)


def plausible_members(members: DataFrame, percent: int, kind: str) -> DataFrame:
    """(key, id) of the classes with a plausible partner of another component in the bucket.

    A pair counts in the first band that it shares only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, ids, comps, side, value in zip(batch["key"], batch["ids"], batch["comps"], batch["sides"], batch["values"]):
                ids, comps, reg = np.asarray(ids), np.asarray(comps), matrix(value)
                left, right = _sides(np.asarray(side))
                hit = np.zeros(len(ids), dtype=bool)
                # every pair of different components has a member outside of the largest one
                names, sizes = np.unique(comps, return_counts=True)
                main = comps == names[sizes.argmax()]
                small = left[~main[left]]
                pieces = [(small, right)]
                if (np.asarray(side) != 1).any():
                    pieces.append((left[main[left]], right[~main[right]]))
                i, j = [], []
                for one, two in pieces:
                    if len(one) and len(two):
                        fits = plausible(*compared(reg[one], reg[two]), percent / 100)
                        fits &= (comps[one][:, None] != comps[two][None, :]) & (ids[one][:, None] != ids[two][None, :])
                        x, y = np.nonzero(fits)
                        i.append(one[x]), j.append(two[y])
                i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (i, j))
                for at in range(0, len(i), 1 << 14):
                    x, y = reg[i[at : at + (1 << 14)]], reg[j[at : at + (1 << 14)]]
                    equal = (x == y).reshape(-1, B, R).all(2) & (x != EMPTY).reshape(-1, B, R).any(2)
                    own = equal.argmax(1) == key & 63
                    hit[i[at : at + (1 << 14)][own]] = True
                    hit[j[at : at + (1 << 14)][own]] = True
                rows += [(key, x) for x in ids[hit]]
            yield pd.DataFrame(rows, columns=["key", "id"])

    return blocks(members, "sketch").mapInPandas(run, f"key long, id {kind}").distinct()


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in left with those in right: products of 0/1 matrices, a slice of the hashes at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def block_links(members: DataFrame, percent: int, kind: str) -> DataFrame:
    """(a, b): the links between different components in each bucket, by full sets: members(key, size, id, comp, shingles).

    Of several links between the same two components in a block one is returned: the components are what counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ids, comps, side, value in zip(batch["ids"], batch["comps"], batch["sides"], batch["values"]):
                ids, comps = np.asarray(ids), np.asarray(comps)
                sets = [np.frombuffer(x, dtype=np.uint64) for x in value]
                left, right = _sides(np.asarray(side))
                both = common(sets, left, right)
                size = np.array([len(x) for x in sets])
                union = size[left][:, None] + size[right][None, :] - both
                i, j = np.nonzero((100 * both >= percent * union) & (comps[left][:, None] != comps[right][None, :]))
                rows += {(min(a, b), max(a, b)): (x, y) for a, b, x, y in zip(comps[left[i]], comps[right[j]], ids[left[i]], ids[right[j]])}.values()
            yield pd.DataFrame(rows, columns=["a", "b"])

    return blocks(members, "shingles").mapInPandas(run, f"a {kind}, b {kind}").distinct()


def several(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the links between the classes of an id that has several texts: rows(doc_id, digest), classes(digest, rep)."""
    more = rows.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id")
    reps = rows.select("doc_id", "digest").join(more, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "rep").distinct()
    low = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(low, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def linked(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    sk = materialize(sketches(docs, k), "near-sketches")
    # a digest may have a third of all rows: aggregates combine before the shuffle, joins split it
    some = sk.where("digest is not null and doc_id is not null")
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = some.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = materialize(reps.select("doc_id", "sketch", "keys"), "near-reps")
    rows = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(rows.join(sizes, "key"), "near-buckets")
    few, many = shared.where(F.col("size") <= SMALL).select("key", "id"), shared.where(F.col("size") > SMALL)
    pick = [F.min_by("id", F.xxhash64("id", F.lit(h))) for h in range(HUBS)]
    hubs = many.groupBy("key").agg(F.array(*pick).alias("hubs"))
    met = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    met = met.select(F.posexplode("ids").alias("n", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("n") + 2, F.size("ids"))).alias("b"))
    # a few of a class's large buckets, of the lowest hash, name its hubs: rows in proportion to the classes
    keys = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("key").alias("h"), "key"))), 1, NAMING)
    named = many.groupBy("id").agg(keys.alias("k")).select("id", F.explode("k.key").alias("key"))
    stars = named.join(hubs, "key").groupBy("id").agg(F.flatten(F.collect_list("hubs")).alias("hubs"))
    bands = lambda h: F.size(F.filter("hubs", lambda x: x == h))
    often = F.transform(F.array_remove(F.array_distinct("hubs"), F.col("id")), lambda h: F.struct((-bands(h)).alias("bands"), h.alias("hub")))
    stars = stars.select("id", F.explode(F.slice(F.sort_array(often), 1, HUBS)["hub"]).alias("hub")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = materialize(plausible_pairs(met.union(stars).where("a <> b").distinct(), reps, percent), "near-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    links = materialize(verified(pairs, materialize(shingle_sets(docs, ids, k), "near-sets"), percent).union(several(some, classes)), "near-links")
    first = components(links)
    # what is left: buckets of several components
    labelled = many.select("key", "id", "size").join(first.withColumnRenamed("comp", "c"), "id", "left").select("key", "id", "size", F.coalesce("c", "id").alias("comp"))
    labelled = materialize(labelled, "near-labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    hot = labelled.join(mixed, "key", "left_semi").join(reps.select(F.col("doc_id").alias("id"), "sketch"), "id")
    hot = materialize(plausible_members(hot.select("key", "size", "id", "comp", "sketch"), percent, kind), "near-members")
    whole = first
    if not hot.isEmpty():
        sets = materialize(shingle_sets(docs, hot.select("id").distinct(), k), "near-sets")
        sizes = hot.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        left = hot.join(sizes, "key").join(labelled.select("id", "comp").distinct(), "id").join(sets, "id").select("key", "size", "id", "comp", "shingles")
        more = materialize(block_links(left, percent, kind), "near-more")
        if not more.isEmpty():
            whole = components(links.union(more))
    found = classes.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("class"))
    out = sk.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(table(spark, sf_dir, "documents"), k=4)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
