"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and their white space is collapsed. A passage of n characters that
is within e edits of an item shares at least n - q + 1 - q * e of its q-grams, on diagonals (text
position minus item position) that spread by e at most. So shared q-grams are counted in overlapping bands of 2e + 1
diagonals; bands that reach the bound are kept, and a banded alignment of the item within the band decides.

Defined cases: null and empty texts and items match nothing; items too short for the lemma (under 2q
characters) must occur exactly; repeated items count once; an item that occurs several times in a text
gives its best region; null ids are kept as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Q = 10
#: Edits allowed, as a share of an item's characters.
EDIT_RATE = 0.08
#: Characters of items that one broadcast index holds at most; a larger benchmark is searched in slices.
INDEX_CHARS = 4_000_000
#: Characters of texts that are searched at once.
BLOCK_CHARS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each position: hashes of halves are combined."""

    def of(width: int) -> np.ndarray:
        if width == 1:
            return a.astype(np.uint64)
        left, right = of(width // 2), of(width - width // 2) if width % 2 else None
        right = left if right is None else right
        n = len(a) - width + 1
        power = np.uint64(pow(int(MIX), width - width // 2, 1 << 64))
        return left[:n] * power + right[width // 2 : width // 2 + n]

    if len(a) < q:
        return np.zeros(0, dtype=np.uint64)
    h = of(q)
    return (h ^ (h >> np.uint64(29))) * MIX


class Index:
    """q-grams of items: sorted hashes with (item, position), and a bit table in front of them."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> None:
        self.q = q
        self.ids, self.texts = [i for i, _ in items], [codes(t) for _, t in items]
        self.short = [(n, items[n][1]) for n, t in enumerate(self.texts) if len(t) < 2 * q]
        n = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.length = n
        # the bound stays positive: no more edits than leave one shared q-gram
        self.edits = np.maximum(0, np.minimum((n * rate).astype(np.int64), (n - q) // q))
        self.bound = n - q + 1 - q * self.edits
        long = [k for k in range(len(n)) if n[k] >= 2 * q]
        hashes = [grams(self.texts[k], q) for k in long]
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        item = np.concatenate([np.full(len(x), k) for k, x in zip(long, hashes)]) if hashes else np.zeros(0, dtype=np.int64)
        at = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order].astype(np.int64), at[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << BITS, dtype=bool)
        self.bits[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def pairs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of every shared q-gram."""
        h = grams(text, self.q)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[maybe])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == h[maybe] if len(self.keys) else np.zeros(len(k), dtype=bool)
        pos, k = maybe[real], k[real]
        times = self.count[k]
        row = np.repeat(self.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(pos, times), self.item[row], self.at[row]


def bands(index: Index, doc: np.ndarray, pos: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, lowest diagonal) of the bands in which enough different q-grams of the item are shared."""
    # a text has to share enough with an item over all diagonals first
    n_items = len(index.ids)
    both = doc * n_items + item
    _, group, size = np.unique(both, return_inverse=True, return_counts=True)
    enough = size[group] >= index.bound[item]
    doc, pos, item, at = doc[enough], pos[enough], item[enough], at[enough]
    if not len(doc):
        return doc, item, pos
    e1 = index.edits[item] + 1
    diagonal = pos - at
    band = diagonal // e1
    # band k holds the 2e + 1 diagonals from k (e + 1) on: each diagonal but the last of a stride lies in two
    lower = diagonal - (band - 1) * e1 <= 2 * (e1 - 1)
    doc, item, at, band, e1 = (np.concatenate([x, x[lower]]) for x in (doc, item, at, band, e1))
    band[len(lower) :] -= 1
    rows = np.unique(np.stack([doc, item, band, at]), axis=1) if len(doc) < 64 else _distinct(doc, item, band, at)
    doc, item, band = rows[0], rows[1], rows[2]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)]))
    shared = np.diff(np.append(new, len(doc)))
    keep = new[shared >= index.bound[item[new]]]
    return doc[keep], item[keep], band[keep] * (index.edits[item[keep]] + 1)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    order = np.lexsort(columns[::-1])
    a = np.stack([c[order] for c in columns])
    return a[:, np.concatenate([[True], (np.diff(a, axis=1) != 0).any(0)])]


def align(index: Index, text: np.ndarray, item: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each candidate band: (edits, from, to), the best alignment of the whole item within its diagonals.

    One row of all candidates' bands is computed at a time. A cell holds the edits, and below them the
    diagonal on which its alignment began. Text outside [start, end) of the candidate's document matches nothing.
    """
    n, e = index.length[item], index.edits[item]
    width, longest = int(2 * e.max() + 1), int(n.max())
    c = len(item)
    pattern = np.full((c, longest), 0xFFFFFFFF, dtype=np.uint32)
    for k, i in enumerate(item):
        pattern[k, : n[k]] = index.texts[i]
    one = np.int64(1) << 32
    b = np.arange(width, dtype=np.int64)
    outside = b[None, :] > 2 * e[:, None]
    far = one << 20
    row = np.where(outside, far, b[None, :])
    best = np.full((c, 3), far, dtype=np.int64)
    for i in range(1, longest + 1):
        j = low[:, None] + b[None, :] + i - 1  # the text character that ends in this cell
        inside = (j >= start[:, None]) & (j < end[:, None])
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == pattern[:, i - 1 : i])
        new = row + np.where(same, 0, one)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + one)
        new[outside] = far
        row = np.minimum.accumulate(new - b * one, axis=1) + b * one
        row[outside] = far
        done = np.flatnonzero(n == i)
        if len(done):
            at = row[done].argmin(1)
            value = row[done, at]
            best[done] = np.stack([value >> 32, low[done] + (value & (one - 1)), low[done] + at + i], axis=1)
    return best[:, 0], best[:, 1], best[:, 2]


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits): the best region of each item in each normalised text."""
    arrays = [codes(t) for t in texts]
    sizes = np.array([len(a) + 1 for a in arrays], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    whole = np.zeros(int(sizes.sum()), dtype=np.uint32)
    for s, a in zip(starts, arrays):
        whole[s : s + len(a)] = a
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    pos, item, at = index.pairs(whole)
    doc = np.searchsorted(starts, pos, side="right") - 1
    doc, item, low = bands(index, doc, pos, item, at)
    step = 512
    for k in range(0, len(doc), step):
        d, i, lo = doc[k : k + step], item[k : k + step], low[k : k + step]
        edits, begin, end = align(index, whole, i, lo, starts[d], starts[d] + sizes[d] - 1)
        for x, y, n, s, t in zip(d, i, edits, begin - starts[d], end - starts[d]):
            if n <= index.edits[y]:
                found[x, y] = min(found.get((x, y), (1 << 60, 0, 0)), (int(n), int(max(s, 0)), int(t)))
    for y, word in index.short:
        for x, t in enumerate(texts):
            if (s := t.find(word)) >= 0:
                found[x, y] = (0, s, s + len(word))
    return [(int(x), index.ids[y], s, t, n) for (x, y), (n, s, t) in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every item found in a document; positions in the normalised text."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // index_chars))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, edits long, start long, end long"
    out = None
    for k in range(slices):
        same = F.xxhash64(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
        rows = items.where(F.pmod(same, F.lit(slices)) == k).collect()
        distinct = sorted({(r["item_id"], t) for r in rows if (t := normal(r["text"]))}, key=repr)
        shared = spark.sparkContext.broadcast(distinct)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value, q, rate)
            for b in batches:
                rows, block, ids, size = [], [], [], 0
                for doc_id, text in zip(b["doc_id"], b["text"]):
                    block.append(normal(text)), ids.append(doc_id)
                    size += len(block[-1])
                    if size >= BLOCK_CHARS:
                        rows += [(ids[x], i, n, s, t) for x, i, s, t, n in search(index, block)]
                        block, ids, size = [], [], 0
                if block:
                    rows += [(ids[x], i, n, s, t) for x, i, s, t, n in search(index, block)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end"])

        part = docs.select("doc_id", "text").where("text is not null").mapInPandas(run, schema)
        out = part if out is None else out.union(part)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
