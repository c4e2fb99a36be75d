"""Byte-level BPE as a monoid: texts are encoded by halves, and neighbours are joined at their boundary.

Two reductions over the same kind of tree:

* Texts into the pieces that the pattern matches. A piece depends on the text from its start on only, and no
  alternative of the pattern looks further than to the first character behind the piece, or the third from its start. So of
  two neighbours' pieces all stay but the last ones of the left and the first ones of the right: a window over the boundary
  is matched anew and grows until one of its settled pieces ends where a piece of the right begins.
* Pieces into tokens. A sequence of tokens is the encoding of its bytes if every token is the encoding of its own
  bytes and every two neighbours are that of theirs: the first merge across a boundary would be made in these two alone as
  well. So a window over the boundary is encoded anew and doubled until its outermost tokens are those that were there.
  Pieces too short to be halved are the tiktoken library's.

Decoding concatenates bytes up the same tree. Ranks and pattern are parameters; the ranks must hold all single bytes.
They travel to the tasks as they are: their number is that of the vocabulary.

Defined cases: a null text is an empty one and has no tokens; rows with one id are encoded each for itself; strings that name
special tokens are ordinary text; an empty table gives no rows; other columns stay as they are, but for one named ``ids``.
A text is encoded whole, in one task, in memory that grows with its length.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of a text, and bytes of a piece, that are encoded without halving; bytes that are merged without a heap; pieces
#: that a task remembers.
TEXT_LEAF, PIECE_LEAF, SHORT, REMEMBERED = 2048, 96, 256, 100_000

Ranks = dict[bytes, int]


def load_ranks(path: str) -> Ranks:
    """The ranks of a file with a token in base64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def patterns(pattern: str) -> tuple[str, str, str]:
    r"""The pattern with ``\p{L}`` and ``\p{N}`` as tiktoken's own regex engine has them, whose version of Unicode may be another one;
    and one for the characters that the two engines see differently, without which the pattern can stay as it is; and their first."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for name in (r"\p{L}", r"\p{N}"):
        e = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs, ours = set(e.decode_bytes(e.encode_ordinary(every)).decode()), set(regex.findall(name, every))
        pattern = pattern.replace(name, f"[[{name}{ranges(theirs - ours)}]--[\\n{ranges(ours - theirs)}]]")
        odd |= theirs ^ ours
    return "(?V1)" + pattern, f"[{ranges(odd)}]" if odd else "(?!)", min(odd, default="\U0010ffff")


def ranges(chars: set[str]) -> str:
    """A regex set's inside for characters: runs of code points."""
    codes = sorted(map(ord, chars))
    starts = [c for c in codes if chr(c - 1) not in chars]
    ends = [c for c in codes if chr(c + 1) not in chars]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def reduced(x, most: int, leaf: Callable, join: Callable):
    """The join of the leaves of x, halved until no part is longer than ``most``."""
    if len(x) <= most:
        return leaf(x)
    half = len(x) // 2
    return join(reduced(x[:half], most, leaf, join), reduced(x[half:], most, leaf, join))


def settled(pieces: list[str], length: int) -> int:
    """How many of the pieces of a text of that length stay, whatever follows the text."""
    n, start = len(pieces), length
    while n:
        start -= len(pieces[n - 1])
        if start + len(pieces[n - 1]) < length and length - start >= 3:
            break
        n -= 1
    return n


def spliced(left: list[str], right: list[str], find: Callable[[str], list[str]]) -> list[str]:
    """The pieces of two texts put together, from the pieces of each."""
    if not left or not right:
        return left or right
    # three characters and a piece behind the first to stay: no more pieces than that can change
    near = left[-4:]
    firm = settled(near, sum(map(len, near)))
    tail = "".join(near[firm:])
    del left[len(left) - len(near) + firm :]
    n = 2
    while True:
        text = tail + "".join(right[:n])
        new = find(text)
        if n >= len(right):
            return left + new
        ends, at = {len(tail): 0}, len(tail)
        for k, piece in enumerate(right[:n]):
            at += len(piece)
            ends[at] = k + 1
        at = 0
        for k in range(settled(new, len(text))):
            at += len(new[k])
            if at in ends:
                return left + new[: k + 1] + right[ends[at] :]
        n *= 2


def merged(piece: bytes, ranks: Ranks) -> list[int]:
    """The encoding of bytes by merging, again and again, the neighbours of the least rank, the leftmost of equal ones."""
    if len(piece) > SHORT:
        return merged_by_heap(piece, ranks)
    none = len(ranks)
    at = [*range(len(piece) + 1)]  # where tokens begin
    costs = [ranks.get(piece[a : a + 2], none) for a in range(len(piece) - 1)]
    while costs and (least := min(costs)) < none:
        k = costs.index(least)
        del at[k + 1], costs[k]
        if k:
            costs[k - 1] = ranks.get(piece[at[k - 1] : at[k + 1]], none)
        if k < len(costs):
            costs[k] = ranks.get(piece[at[k] : at[k + 2]], none)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def merged_by_heap(piece: bytes, ranks: Ranks) -> list[int]:
    """The same for windows that have grown, in little more than linear time."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a byte
    alive = [True] * n

    def pair(a: int) -> int | None:
        return ranks.get(piece[a : end[end[a]]]) if end[a] < n else None

    heap = [(r, a) for a in range(n - 1) if (r := ranks.get(piece[a : a + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, a = heapq.heappop(heap)
        if not alive[a] or pair(a) != r:
            continue
        b = end[a]
        alive[b], end[a] = False, end[b]
        if end[a] < n:
            before[end[a]] = a
        for c in (before[a], a):
            if c >= 0 and (again := pair(c)) is not None:
                heapq.heappush(heap, (again, c))
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


def fused(left: list[int], right: list[int], ranks: Ranks, tokens: list[bytes]) -> list[int]:
    """The encoding of two byte strings put together, from the encoding of each."""
    if not left or not right:
        return left or right
    i = j = 2
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        new = merged(b"".join(tokens[t] for t in left[len(left) - i :] + right[:j]), ranks)
        first, last = i == len(left) or new[0] == left[-i], j == len(right) or new[-1] == right[j - 1]
        if first and last:
            return left[: len(left) - i] + new + right[j:]
        i, j = i if first else 2 * i, j if last else 2 * j


class Encoder:
    """Encodes texts; remembers the ids of short pieces."""

    def __init__(self, ranks: Ranks, pattern: str, exact: str, odd: str, first: str):
        import tiktoken

        self.ranks, self.plain, self.exact = ranks, regex.compile(pattern).findall, regex.compile(exact).findall
        self.rare, self.odd = re.compile(f"[{first}-\U0010ffff]").search, re.compile(odd).search
        self.short = tiktoken.Encoding("short", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.leaf = max(PIECE_LEAF, *map(len, ranks))  # a token may be a piece of its own that no merge gives
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) > self.leaf:
            return reduced(raw, self.leaf, lambda x: merged(x, self.ranks), lambda a, b: fused(a, b, self.ranks, self.tokens))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = self.known[piece] = self.short(piece)
        return ids

    def find(self, text: str) -> list[str]:
        return (self.exact if self.rare(text) and self.odd(text) else self.plain)(text)

    def pieces(self, text: str) -> list[str]:
        return reduced(text, TEXT_LEAF, self.find, lambda a, b: spliced(a, b, self.find))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known.get
        for piece in self.pieces(text):
            out += known(piece) or self.piece(piece)
        return out


def encode(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text") -> DataFrame:
    """docs with ``ids``, the tokens of the column ``text``, in its place."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, *patterns(pattern)))
    rest = [c for c in docs.columns if c not in (text, "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in batches:
            # a row at a time: a list of Python numbers takes ten times the room of what it becomes
            ids = [np.array(encoder.encode(t.as_py() or ""), dtype=np.int32) for t in b.column(text)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [lists], [*rest, "ids"])

    kept = docs.select(*rest, text)
    schema = kept.drop(text).withColumn("ids", F.lit(None).cast("array<int>")).schema
    return kept.mapInArrow(run, schema)


def decoder(spark: SparkSession, ranks: Ranks) -> Callable[[str], Column]:
    """A function from a column of ids to one of bytes; null for null, an error for an id outside of the ranks."""
    shared = spark.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = shared.value.__getitem__

        def leaf(ids: np.ndarray) -> bytes:
            return b"".join(map(token, ids.tolist()))

        for b in batches:
            yield pa.array([None if not ids.is_valid else reduced(ids.values.to_numpy(), 4 * TEXT_LEAF, leaf, bytes.__add__) for ids in b], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoder(spark, ranks)("ids"), 256).alias("decoded_sha256"),
    )
