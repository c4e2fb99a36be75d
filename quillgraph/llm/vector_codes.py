"""Compression of vectors to short codes: product quantization with exact Lloyd rounds, pruned as Elkan does.

Vectors are scaled to integers and cut into equal parts; each position of a part has a codebook of a few entries.
A round assigns every part to its nearest entry and moves each entry to the floored mean of its parts. The state
of a row is kept between rounds in a written table: for each part its entry, one upper bound of the distance to
it, and one lower bound of the distance to every entry. After a round the bounds are shifted by what the entries
moved, and by the triangle inequality most distances need not be computed again: an entry is left out only if its
lower bound, or half the distance between it and the present entry, is strictly greater than the upper bound.
Bounds are rounded outwards; what is left is decided by 64-bit integer distances, ties to the lower index, so the
result is that of computing everything.

A round is one pass: the rows with their new bounds and, from each task, the sums and counts of each entry's
parts go to the same written table; the sums (as many rows as there are entries, for each task) are added up by Spark.
The driver holds the codebooks only: parts x entries x length of a part.

Defined cases: rows whose vector is null or has a null or non-finite component are dropped. The length of vectors
is that of the smallest kept vec_id whose length is a positive multiple of the number of parts; rows of other lengths
are dropped too. A null vec_id orders last; rows with one id are rows of their own, ordered by their vectors. With fewer
rows than entries the codebooks have as many entries as there are rows. Equal entries: the lower index takes the parts, the
other one stays as it is. Components so large that distances leave 64 bits raise an ArithmeticError. No rows, no result
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def scaled(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, v: array<bigint>) of the rows that are kept, and the length of their vectors (0 without rows)."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(sound, F.lit(False)) & (F.size(x) > 0) & (F.size(x) % parts == 0))
    first = rows.select("vec_id", F.size(x).alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1).collect()
    if not first:
        return rows.select("vec_id", "label", F.lit(None).cast("array<bigint>").alias("v")), 0
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return rows.where(F.size(x) == first[0]["n"]).select("vec_id", "label", whole.alias("v")), first[0]["n"]


def above(squares: np.ndarray) -> np.ndarray:
    """Roots of squared distances as 32-bit numbers that are not below them."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def below(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares_to(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the row of entries beside it."""
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def assigned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and lower bounds of parts without bounds: all distances are computed."""
    d2 = np.stack([squares_to(x, book[e][None, :]) for e in range(len(book))], axis=1)
    code = d2.argmin(axis=1)
    return code, above(d2[np.arange(len(x)), code]), below(d2)


def reassigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for parts with bounds against the entries before they moved by at most ``moved``; and how many distances it took."""
    n, every = len(x), np.arange(len(x))
    out = np.float32(np.inf)
    u = np.nextafter((upper.astype(np.float64) + moved[code]).astype(np.float32), out)
    low = np.maximum(np.nextafter((lower.astype(np.float64) - moved).astype(np.float32), -out), np.float32(0))
    code = code.copy()
    gaps = below(np.stack([squares_to(book, book[e][None, :]) for e in range(len(book))])) / 2

    def open_entries(rows: np.ndarray) -> np.ndarray:
        may = (low[rows] <= u[rows, None]) & (gaps[code[rows]] <= u[rows, None])
        may[np.arange(len(rows)), code[rows]] = False
        return may

    rows = np.flatnonzero(open_entries(every).any(axis=1))
    own = squares_to(x[rows], book[code[rows]])
    u[rows], low[rows, code[rows]] = above(own), below(own)
    took = len(rows)
    may = open_entries(rows)
    at, entry = np.nonzero(may)
    d2 = squares_to(x[rows[at]], book[entry])
    low[rows[at], entry] = below(d2)
    took += len(at)
    best = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    best[np.arange(len(rows)), code[rows]] = own
    best[at, entry] = d2
    code[rows] = best.argmin(axis=1)
    u[rows] = above(best.min(axis=1)) if len(book) else u[rows]
    return code, u, low, took


def packed(rows: np.ndarray) -> pa.Array:
    """A binary array with a value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.nbytes // max(1, len(rows)))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


STATE = "x binary, code binary, upper binary, lower binary"
SUMS = "cell int, n bigint, total array<bigint>"


def round_of(books: np.ndarray, moved: np.ndarray | None):
    """The pass of one round over rows (vec_id, label, v) or rows with bounds: rows with new bounds, then the task's sums."""
    parts, entries, width = books.shape
    sums = [pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = ["vec_id", "label", "x", "code", "upper", "lower", "cell", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.DataType] = []
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            if moved is None:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, width)
                if 4 * parts * width * int(max(abs(int(x.max())), abs(int(x.min())))) ** 2 >= 2**63 or np.abs(x).max() >= 2**31:
                    raise ArithmeticError("a component is too large for 64-bit distances")
                had = None
            else:
                x = unpacked(b.column("x"), np.int32, parts, width).astype(np.int64)
                had = [unpacked(b.column("code"), np.uint8, parts), unpacked(b.column("upper"), np.float32, parts), unpacked(b.column("lower"), np.float32, parts, entries)]
            code, upper, lower = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2], np.float32), np.empty((len(x), parts, entries), np.float32)
            for p in range(parts):
                if had is None:
                    c, upper[:, p], lower[:, p] = assigned(x[:, p], books[p])
                else:
                    c, upper[:, p], lower[:, p], _ = reassigned(x[:, p], books[p], moved[p], had[0][:, p].astype(np.int64), had[1][:, p], had[2][:, p])
                code[:, p] = c
                count[p] += np.bincount(c, minlength=entries)
                np.add.at(total[p], c, x[:, p])
            rows = [b.column("vec_id"), b.column("label"), packed(x.astype(np.int32)), packed(code), packed(upper), packed(lower)]
            own = [c.type for c in rows]
            yield pa.RecordBatch.from_arrays(rows + [pa.nulls(len(x), t) for t in sums], names)
        used = np.flatnonzero(count.ravel())
        if len(used):
            mine = [used, count.ravel()[used], list(total.reshape(-1, width)[used])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), t) for t in own] + [pa.array(v, t) for v, t in zip(mine, sums)], names)

    return run


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floored means of the entries' parts, unused entries as before."""
    sums = state.where("cell is not null").select("cell", "n", F.posexplode("total").alias("at", "v"))
    sums = sums.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    new = books.reshape(-1, books.shape[2]).copy()
    for r in sums:
        new[r["cell"], r["at"]] = r["v"] // r["n"]
    return new.reshape(books.shape)


def final_of(books: np.ndarray):
    """The last assignment: code as hex digits, and the exact squared distance over all parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column("x"), np.int32, parts, width).astype(np.int64)
            code = unpacked(b.column("code"), np.uint8, parts)
            error = sum(squares_to(x[:, p], books[p][code[:, p]]) for p in range(parts)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept row of vectors(vec_id, embedding, label), and the codebooks: an integer
    array by part, entry and position. code has two hex digits for each part; entries are at most 256."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    kinds = dict(vectors.dtypes)
    own = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    rows, length = scaled(vectors, parts, scale)
    if not length:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), np.zeros((parts, 0, 0), np.int64)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), parts, length // parts).transpose(1, 0, 2)
    ddl = f"{own}, {STATE}, {SUMS}"
    state, path, moved = rows, None, None
    for k in range(rounds + 1):
        last, gone = k == rounds or (moved is not None and not moved.any()), path
        # an entry's shift is rounded up as the bounds are; where none moved, the assignment stays as it is
        if not (last and k < rounds):
            state, path = written(state.mapInArrow(round_of(books, moved), ddl), f"codes-{k}", codec="lz4")
            if gone:
                drop_table(state.sparkSession, gone)
        if last:
            break
        new = moved_books(state, books)
        d2 = np.einsum("pew,pew->pe", new - books, new - books)
        moved, books = np.where(d2 > 0, above(d2), np.float32(0)).astype(np.float64), new
        state = state.where("cell is null")
    ddl = f"{own}, code string, error bigint"
    return state.where("cell is null").select("vec_id", "label", "x", "code").mapInArrow(final_of(books), ddl), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    codes = materialize(codes, "codes")
    # the sums are written, so that Spark knows their size before it plans the join
    sums = materialize(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    text = ",".join(str(v) for v in books.ravel().tolist())
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(text).cast("binary"), 256).alias("codebooks_sha256"))


def _sql() -> str:
    out = [r"""
WITH k AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * c::DOUBLE)::BIGINT for c in embedding] AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
x AS MATERIALIZED (SELECT r, p, v[(p * (len(v) // 8) + 1):((p + 1) * (len(v) // 8))] AS x FROM k, range(8) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= 16)"""]
    for n in range(7):
        out.append(f"""
a{n} AS MATERIALIZED (SELECT r, p, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::BIGINT * 16 + e) AS m FROM x JOIN c{n} USING (p) GROUP BY r, p)""")
        if n < 6:
            out.append(f"""
s{n} AS (SELECT p, m % 16 AS e, i, sum(x[i + 1])::BIGINT AS s, count(*) AS n FROM a{n} JOIN x USING (r, p), range(len(x)) t(i) GROUP BY ALL),
m{n} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM s{n} GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(new, c) AS c FROM c{n} LEFT JOIN m{n} USING (p, e))""")
    return ",".join(out) + """,
z AS (SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN z USING (r), h"""


OP12_SQL = _sql()
