"""Best-fit packing by minimum bin slack.

Only lengths matter to a packing, and there are at most ``size`` of them, so bins are planned on
the histogram of lengths: take the largest length left, then find by a bitset subset-sum over the
other lengths the fullest feasible combination, and remove it, as often as the counts allow. The
plan has a bounded number of rows; pieces find their place in it by their length and their rank
among the pieces of that length, and ranks are counted in blocks, so that no length, however
common, meets in one task.
"""

from __future__ import annotations

from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, durable, held, narrow, read
from .vocabulary import SpacedVocabulary, Tokens, default_path

#: Blocks of ranks that the rows of one id are dealt to.
SALT = 64


def fullest(counts: list[int], cap: int) -> list[tuple[int, int]]:
    """The multiset of lengths with the largest sum up to ``cap``: (length, how many) pairs.

    ``counts[x]`` is how many pieces of length x there are. Bit s of the set is 1 if some choice
    of the lengths seen so far adds up to s; longer lengths come first, and the search ends as
    soon as the bin can be filled.
    """
    full, mask, steps, reach = 1 << cap, (1 << cap + 1) - 1, [], 1
    for x in range(cap, 0, -1):
        if not counts[x] or reach & full:
            continue
        steps.append((x, reach))
        left, part = min(counts[x], cap // x), 1
        while left:
            take = min(part, left)
            reach |= reach << x * take & mask
            left, part = left - take, part * 2
    at, chosen = reach.bit_length() - 1, []
    for x, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at, n = at - x, n + 1
        if n:
            chosen.append((x, n))
    return chosen[::-1]


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset of the first)."""
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, bins = [0] * (size + 1), [], 0
    for length in range(size, 0, -1):
        while counts[length]:
            counts[length] -= 1
            chosen = dict(fullest(counts, size - length))
            counts[length] += 1
            chosen[length] = chosen.get(length, 0) + 1
            times = min(counts[x] // n for x, n in chosen.items())
            offset = 0
            for x, n in sorted(chosen.items(), reverse=True):
                rows.append((x, used[x], used[x] + n * times, bins, n, offset))
                used[x] += n * times
                counts[x] -= n * times
                offset += x * n
            bins += times
    return rows


def _tokens(path: str) -> Tokens:
    return held(("packing", path), lambda: _made(path))


def _made(path: str) -> Tokens:
    """Packed ids of chunks. Their split and merges run in a compiled library, with the vocabulary
    file's own pattern and merges as ranks; pre-tokens that it might split otherwise, for letters
    of other Unicode versions, are split as the file's library does and merged singly."""
    import tiktoken

    vocabulary = SpacedVocabulary(path)
    byte = {letter: b for b, letter in enumerate(vocabulary.letters)}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.ids.items()}
    # ids serve as ranks: each byte has one, and the merges' results are in the order of the merges
    made = [i for _, i in vocabulary.merges.values()]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or not set(byte) <= set(vocabulary.ids):
        raise ValueError(f"{path}: ids aren't in the order of the merges")
    own = tiktoken.Encoding("own", pat_str=vocabulary.pattern.pattern, mergeable_ranks=ranks, special_tokens={})
    core = own._core_bpe  # without the checks for special tokens, which are taken out before
    one = core.encode_single_piece

    def solve(words: list[str]) -> list[bytes]:
        return [array("I", one(w.encode())).tobytes() for w in words]

    def direct(chunks) -> list[bytes]:
        return [array("I", core.encode_ordinary(c)).tobytes() for c in chunks]

    return Tokens(vocabulary, solve, b"".join, lambda i: i.to_bytes(4, "little"), direct=direct)


def pieces(
    df: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = 1024, end_id: int = 2
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut from the
    end into pieces of ``size``, so that only the first of a longer document may be shorter.

    Null and empty texts are ``end_id`` alone; null ids stay null; equal texts have equal pieces and
    repeated rows each give theirs; an empty table gives none. A very long text is cut whole, in
    one task. Other columns, whatever their names, are not read.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")
    closing = end_id.to_bytes(4, "little")

    def make():
        tokens = _tokens(path)

        def step(batch: pa.RecordBatch):
            rows, starts, lengths, sums, numbers = [], [], [], [], []
            for row, ids in enumerate(tokens.of([t or "" for t in batch.column("text").to_pylist()])):
                ids += closing
                n = len(ids) // 4
                cuts = [0, *range(n - (n - 1) // size * size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row), numbers.append(k), starts.append(a), lengths.append(b - a)
                    sums.append(crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return step

    rows = narrow(df, doc_id=id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 1024, block: int = 20_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``size``.

    Pieces of a length are interchangeable; doc_id, piece and the checksum order them, and rows
    equal in those give equal results whichever comes first. A null doc_id is packed like any
    other. An empty table gives an empty result. ``block`` is the number of rows that a block of
    ranks has on average.
    """
    kept = durable(pieces)
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = 16 + sum(histogram.values()) // block
    made = plan(histogram, size)
    # the salt parts rows of one id, or of none; the rows are checkpointed, so it stays the same
    salted = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id() % SALT)
    blocked = kept.withColumn("block", F.pmod(salted, F.lit(blocks)))
    before = (
        blocked.groupBy("length", "block")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("block")) - F.col("n"))
        .drop("n")
    )
    within = F.row_number().over(W.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (
        blocked.withColumn("within", within.cast("long"))
        .join(before, ["length", "block"])
        .select(*kept.columns, (F.col("within") + F.col("before")).alias("rank"))
    )
    table = np.array(sorted(made), np.int64).reshape(-1, 6)

    def make():
        key = table[:, 0] << 44 | table[:, 1]

        def step(batch: pa.RecordBatch):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first, _, bins, a_bin, offset = table[np.searchsorted(key, length << 44 | rank, "right") - 1].T
            at = rank - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bins + at // a_bin), pa.array(offset + at % a_bin * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return arrow_map(ranked, make, f"{fields}, sequence_id long, offset long", rows=100_000)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    return pack(pieces(read(spark, sf_dir, "documents")))
