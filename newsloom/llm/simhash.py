"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is a ring of segments. Two fingerprints that differ in at most ``most``
bits have, somewhere on the ring, a chain of consecutive segments in which the first l segments
together differ in at most l * most / segments bits, for every l. Chains begin with segments that
are equal outright: those are the key of the candidate search; the rest of the chain is checked
before the full Hamming distance.

Keys that many fingerprints share would give pairs by the square of their number. Their members
are linked exactly another way: at two or fewer differing bits a fingerprint and another have a
common neighbour one bit or none away from each, so each member is put under itself and its 64
neighbours, and those under one neighbour are linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, narrow, read, release
from .components import components

#: Segments of the ring, differing bits that still link, members of a key that are paired.
SEGMENTS, MOST, PAIRED = 8, 2, 24
BITS = 64 // SEGMENTS
#: Segments that a chain begins with and that have to be equal.
EXACT = (SEGMENTS - 1) // MOST


def shingles(text: str, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles: A-Z in lower case, words parted by ASCII
    white space, joined by one space; of the whole sequence if there are fewer words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    of = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([of(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    return np.array([of(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, part: int = 65536) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), part):
        bits = np.unpackbits(hashes[at : at + part].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fp (long)`` for each row: the whole text's SimHash; no words, fingerprint 0."""

    def make():
        release()

        def step(batch: pa.RecordBatch):
            found = [fingerprint(shingles(t or "", size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

        return step

    rows = narrow(df, doc_id=id, text=text)
    return arrow_map(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def differing(a: str, b: str, segment: Column) -> Column:
    """Bits in which two fingerprints differ within a segment, counted on from 0 round the ring."""
    mask = F.lit((1 << BITS) - 1).cast("long")
    place = (segment % SEGMENTS) * BITS
    return F.bit_count(F.call_function("shiftrightunsigned", F.col(a).bitwiseXOR(F.col(b)), place.cast("int")).bitwiseAND(mask))


def chained(a: str, b: str, first: str) -> Column:
    """Whether the chain from segment ``first`` on stays within its budget at every length."""
    total, holds = F.lit(0), F.lit(True)
    for length in range(1, SEGMENTS + 1):
        total = total + differing(a, b, F.col(first) + length - 1)
        holds = holds & (total <= length * MOST // SEGMENTS)
    return holds


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of the relation
    "differs in at most MOST bits"."""
    first = F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("first")
    place = F.col("first") * BITS
    # the ring turned so that the chain's first segments are the lowest bits
    turned = F.call_function("shiftrightunsigned", F.col("fp"), place).bitwiseOR(
        F.call_function("shiftleft", F.col("fp"), 64 - place)
    )
    key = turned.bitwiseAND(F.lit((1 << BITS * EXACT) - 1).cast("long")).alias("key")
    keyed = fps.select("fp", first).select("fp", "first", key)
    sizes = keyed.groupBy("first", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = durable(keyed.join(sizes, ["first", "key"]))
    few = member.where(F.col("n") <= PAIRED)
    a = few.select("first", "key", F.col("fp").alias("a"))
    b = few.select("first", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["first", "key"]).where("a < b").where(chained("a", "b", "first"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST).select("a", "b")
    many = member.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = [0, *[(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]]
    near = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips])).alias("via"))
    # all under one neighbour are linked to the least of them, at most 65 of them
    least = near.groupBy("via").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = near.join(least, "via").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(star).distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id that links of two or fewer differing bits
    reach. Fingerprints are of 3-word shingles, repeats included.

    Equal texts share a fingerprint and so a component. Empty and null texts have fingerprint 0,
    which links like any other. Rows with a null id get the component of their fingerprint, and
    null where it holds no id at all. Repeated rows each give their row; an empty table gives none.
    A very long text is one task's, in parts. Other columns, whatever their names, are not read.
    """
    rows = durable(fingerprints(df, id, text))
    vertices = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("label")))
    edges = links(vertices.select("fp"))
    labelled = components(vertices.select(F.col("fp").alias("vertex"), "label"), edges)
    return rows.join(labelled.select(F.col("vertex").alias("fp"), F.col("label").alias("component_id")), "fp").select(
        "doc_id", "fp", "component_id"
    )


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint in hexadecimal digits and its component."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
