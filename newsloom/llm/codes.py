"""Compression of vectors to short codes by product quantisation in whole numbers.

A vector is cut into equal parts, each part is replaced by the index of the nearest entry of its
position's codebook, and codebooks are improved in rounds: entries become the floored means of
what was assigned to them. All results are exact: the nearest entry is looked for by a matrix
product in float32, whose rounding error is bounded for each part and entry; where the intervals
of several entries overlap the best one's, their distances are worked out again in int64, and of
equal ones the lowest index holds. A round is one pass over the vectors; tasks return sums for
each entry, of which there is a fixed number, and the codebooks travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, narrow, read

#: Steps of a component's unit, parts of a vector, entries of a codebook, rounds of improvement.
UNIT, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components are held to this many steps either way: sums of squares then fit 64 bits for vectors of up to 2,048 components.
FURTHEST = 1 << 25
#: Vectors that a task works on at once.
ROWS = 4096
#: Distinct labels whose sums may be broadcast.
BROADCAST = 100_000
#: Unit roundoff of float32.
ROUNDOFF = 2.0**-24


def stepped(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors are kept, and each kept one's components in steps, floored."""
    kept, out = np.zeros(len(vectors), bool), []
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, ends = vectors.flatten(), np.cumsum(np.r_[0, np.asarray(vectors.value_lengths().fill_null(0))])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    good = np.isfinite(values)
    whole = np.clip(np.floor(np.where(good, values, 0.0) * UNIT), -FURTHEST, FURTHEST).astype(np.int32)
    bad = np.cumsum(np.r_[0, ~good])
    kept = (ends[1:] > ends[:-1]) & (bad[ends[1:]] == bad[ends[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    out = [whole[ends[k] : ends[k + 1]] for k in np.flatnonzero(kept)]
    return kept, out


def prepared(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``id, label, size, steps`` of the kept vectors: those without nulls, NaN or infinities that
    have any components. ``steps`` are little-endian 32-bit integers."""
    rows = df.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                kept, found = stepped(piece.column("vector"))
                mask = pa.array(kept, pa.bool_())
                columns = [piece.column("id").filter(mask), piece.column("label").filter(mask)]
                columns += [pa.array([len(v) for v in found], pa.int32()), pa.array([v.astype("<i4").tobytes() for v in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "size", "steps"])

    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, size int, steps binary")


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry of ``book`` (entries x width, int64) that is nearest
    to each row of ``parts`` (rows x width, int64), ties to the lower index.

    Compared is |c|^2 - 2 x.c, as |x|^2 is the same for all entries. With u the unit roundoff, a
    float32 product of n rounded factors differs from x.c by at most g = (n + 2) u / (1 - (n + 2) u)
    times the sum of |x_i| |c_i|, in whatever order it is summed; that sum is at most |x| |c|.
    The float64 steps around it round by less than 2^-50 of the largest number that they meet.
    """
    n = parts.shape[1]
    g = (n + 2) * ROUNDOFF / (1 - (n + 2) * ROUNDOFF)
    product = (parts.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    square = (book.astype(np.float64) ** 2).sum(1)
    reach = np.sqrt((parts.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(square)[None, :] * (1 + 2.0**-40)
    score = square - 2 * product
    error = 2 * g * reach + (square + 2 * reach) * 2.0**-40
    may = score - error <= (score + error).min(1)[:, None]
    best = may.argmax(1)  # the only one, unless several are left
    rows, entries = np.nonzero(may & (may.sum(1) > 1)[:, None])
    if len(rows):
        exact = ((parts[rows] - book[entries]) ** 2).sum(1)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(exact, starts)
        equal = exact == np.repeat(least, np.diff(np.r_[starts, len(rows)]))
        # entries ascend within a row: the first equal one has the lowest index
        first = np.flatnonzero(equal)
        _, where = np.unique(rows[first], return_index=True)
        best[rows[first[where]]] = entries[first[where]]
    return best, ((parts - book[best]) ** 2).sum(1)


def blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices with their vectors as (rows, parts, width) in int64."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            flat = np.frombuffer(b"".join(piece.column("steps").to_pylist()), "<i4")
            yield piece, flat.astype(np.int64).reshape(piece.num_rows, PARTS, width)


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the floored means of what is nearest to each entry; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, rows in blocks(batches, width):
            for p in range(parts):
                best, _ = nearest(rows[:, p], books[p])
                count[p] += np.bincount(best, minlength=entries)
                order = np.argsort(best, kind="stable")
                used, starts = np.unique(best[order], return_index=True)
                total[p, used] += np.add.reduceat(rows[order, p], starts)
        p, e = np.nonzero(count)
        if len(p):
            at = np.tile(np.arange(width), len(p))
            columns = [np.repeat(p, width), np.repeat(e, width), at, np.repeat(count[p, e], width), total[p, e].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "n", "total"])

    sums = vectors.select("steps").mapInArrow(run, "part long, entry long, at long, n long, total long")
    found = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # a row for each component of each entry
    p, e, at, n, total = (c.to_numpy() for c in found.select("part", "entry", "at", "n", "total").toArrow().columns)
    out = books.copy()
    out[p, e, at] = np.floor_divide(total, n)
    return out


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of each vector."""
    width = books.shape[2]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in blocks(batches, width):
            found = [nearest(rows[:, p], books[p]) for p in range(len(books))]
            codes = np.stack([best for best, _ in found], 1).astype(np.uint8)
            columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(d for _, d in found), pa.int64())]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), *columns], names=["id", "label", "code", "error"])

    return vectors.select("id", "label", "steps").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, vector``: what codes (id, code) stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
            whole = books[np.arange(len(books)), index].reshape(batch.num_rows, -1) / UNIT
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(whole), pa.list_(pa.float64()))], names=["id", "vector"])

    return codes.select("id", "code").mapInArrow(run, f"id {codes.schema['id'].dataType.simpleString()}, vector array<double>")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of the kept vectors, and the codebooks (parts x entries x width).

    Vectors are dropped that are null or empty, that hold a null, NaN or an infinity, or that have
    not as many components as the kept one that comes first, by id (nulls last), then by components.
    If that number isn't a multiple of the parts, it is an error. Codebooks begin with the first 16
    of that order, repeated rows included; of fewer vectors with as many. Components beyond
    +-2^25 steps count as that. Without vectors the result has no rows and the codebooks no entries.
    """
    vectors = durable(prepared(df, id, vector, label))
    order = [F.col("id").asc_nulls_last(), "steps"]
    first = vectors.orderBy(*order).select("size").first()
    size = first["size"] if first else 0
    if size % PARTS:
        raise ValueError(f"vectors of {size} components can't be cut into {PARTS} equal parts")
    alike = vectors.where(F.col("size") == size)
    least = [np.frombuffer(r["steps"], "<i4") for r in alike.orderBy(*order).select("steps").limit(ENTRIES).collect()]
    books = np.array(least, np.int64).reshape(len(least), PARTS, size // PARTS).transpose(1, 0, 2)
    if not len(least):
        return coded(alike, np.zeros((PARTS, 0, 1), np.int64)), books
    for _ in range(ROUNDS):
        books = improved(alike, books)
    return coded(alike, books), books


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """The code of each embedding, its error, and the sum of the errors of its label.

    Null labels are one label; null ids come last and repeated rows give a row each; other columns
    aren't read. Which vectors are dropped, :func:`compressed` says.
    """
    rows = narrow(read(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding", label="label")
    codes, books = compressed(rows)
    codes = durable(codes)
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = durable(sums)
    if sums.limit(BROADCAST + 1).count() <= BROADCAST:  # else adaptive execution splits what a common label has
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _sql() -> str:
    """The same in SQL, round by round, for vectors of one length."""
    width = "(len(embedding) // 8)"
    parts = [
        """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""v AS MATERIALIZED (SELECT r, i // {width} AS part, i % {width} AS pos, floor(embedding[i + 1]::DOUBLE * {UNIT})::BIGINT AS x
  FROM k, LATERAL (SELECT unnest(range(len(embedding))) AS i))""",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS y FROM v WHERE r <= {ENTRIES})",
    ]
    for j in range(ROUNDS + 1):
        parts.append(f"""a{j} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT r, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN b{j} USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part)""")
        if j < ROUNDS:  # // rounds towards zero, so the quotient of a negative sum is found by its remainder
            parts.append(f"""b{j + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, y) AS y FROM b{j} LEFT JOIN (
  SELECT part, entry, pos, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM v JOIN a{j} USING (r, part) GROUP BY part, entry, pos) USING (part, entry, pos))""")
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(parts)},
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY r),
s AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN k USING (r), s"""


SQL = _sql()
