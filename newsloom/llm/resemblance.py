"""Near-duplicates by the exact Jaccard similarity of sets of word shingles, by prefix filtering.

In any one order of all shingles, two sets alike by ``ALIKE`` or more share one of the first
``n - ceil(ALIKE * n) + 1`` shingles of each. Somewhat more, the first ``n / PREFIX``, are the keys
of the candidate search, of which they share several; every link is checked on the whole sets. The order puts shingles that a sample finds common last:
the sample decides how many candidates there are, never which links are found.

Most keys are of one set alone. They drop out before any of them becomes a row: blocks of sets
send four bytes of each key's hash to parts of the hashes, and get back a bit, whether another
set sent the same.

A group of copies would give pairs by the square of its number. So each member of a key is first
compared with the key's hubs alone; pairs are then made only between members whose components
still differ. Sets of like sizes that are alike share not one key of their prefixes but many. So
of a set's crowded keys the most crowded count only for partners of other sizes, and sketches of
the sets sort out most of what is left: what hundreds of unlike texts quote doesn't pair them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, discard, durable, narrow, release, text_of
from .components import components
from .simhash import fingerprint, links, shingles

#: Words of a shingle; the least similarity, as a fraction.
SIZE, ALIKE = 5, (4, 5)
#: Texts of the sample, how many of them make a shingle common, shingles that are put last at
#: most, members of a key with a second hub, digests that are broadcast at most.
SAMPLED, COMMON, LAST, CROWD, BROADCAST = 20_000, 4, 100_000, 24, 1_000_000
#: What share of a set is its prefix (at least the least that finds all links: a fifth).
PREFIX = 4
#: Bits of a set's sketch; members of a crowded key that meet in one block.
BITS, GROUP = 2048, 2048
#: Keys of a block of sets, hashes of a part of them, parts at most.
BLOCK, PART, PARTS = 1 << 19, 1 << 20, 4096


def grams(text: str | None) -> np.ndarray:
    """The text's distinct shingles, ascending, as signed integers."""
    return np.unique(shingles(text or "", SIZE).view(np.int64))


def sketch(own: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its hash: bits that one set has and another hasn't are as many
    shingles at least."""
    bits = np.zeros(BITS, bool)
    bits[own.view(np.uint64) % np.uint64(BITS)] = True
    return np.packbits(bits).view(np.int64)


def prefix_size(n: int) -> int:
    return n // PREFIX + 1 if n else 0


def name(own: np.ndarray) -> int:
    """The name of a set: equal sets have equal ones."""
    return xxhash.xxh64_intdigest(own.tobytes(), 7) - (1 << 63)


def lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def common(texts: DataFrame) -> np.ndarray:
    """Shingles that many sampled texts have, ascending; a bounded number."""
    every = texts.agg(F.approx_count_distinct("text")).first()[0]
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 + every // SAMPLED)) == 0).select("text").distinct()

    def make():
        release()

        def step(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([lists([grams(t) for t in batch.column("text").to_pylist()])], names=["grams"])

        return step

    found = arrow_map(some, make, "grams array<long>").select(F.explode("grams").alias("gram"))
    counts = found.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(LAST).collect()], np.int64))


def prefixes(rows: DataFrame, last: np.ndarray, fps: bool = False) -> DataFrame:
    """``doc_id, mark, set (long), n, bits, keys, fp`` of each row: a name of the set of shingles, its
    size, its sketch, and its prefix in the order; ``mark`` is a digest of the text, ``fp`` its SimHash
    if ``fps``, else 0."""

    def make():
        release()

        def step(batch: pa.RecordBatch):
            names, sizes, bits, keys, prints = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = grams(text)
                names.append(name(own))
                sizes.append(len(own))
                bits.append(sketch(own))
                late = np.isin(own, last, assume_unique=True)
                keys.append(np.r_[own[~late], own[late]][: prefix_size(len(own))])
                prints.append(fingerprint(shingles(text or "")) if fps else 0)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), lists(bits), lists(keys)]
            columns.append(pa.array(prints, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "set", "n", "bits", "keys", "fp"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return arrow_map(marked, make, f"doc_id {kind}, mark long, set long, n int, bits array<long>, keys array<long>, fp long")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def blocks(once: DataFrame) -> DataFrame:
    """``block, sets, sizes, counts, keys``: the sets (set, n, keys) of about BLOCK keys in a row
    each, as bytes. A block has the name of its first set, of which there is one."""

    def run(batches):
        release()
        held: list = [[], [], [], [], 0]

        def row():
            sets, sizes, counts, keys, _ = held
            values = [sets[0][0].item(), *[np.concatenate(v).tobytes() for v in (sets, sizes, counts, keys)]]
            kinds = [pa.int64(), *[pa.binary()] * 4]
            arrays = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "sets", "sizes", "counts", "keys"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = part.column("keys")
                held[0].append(part.column("set").to_numpy())
                held[1].append(part.column("n").to_numpy())
                held[2].append(np.diff(keys.offsets.to_numpy()).astype(np.int32))
                held[3].append(keys.flatten().to_numpy())
                held[4] += len(held[3][-1])
                if held[4] >= BLOCK:
                    yield row()
                    held = [[], [], [], [], 0]
        if held[0]:
            yield row()

    return once.mapInArrow(run, "block long, sets binary, sizes binary, counts binary, keys binary")


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's keys: their order by part, the parts' edges in it, and four bytes of hash."""
    hashes = mixed(keys.view(np.uint64))
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1)), (hashes >> np.uint64(32)).astype(np.uint32)[order]


def met(table: pa.Table) -> pa.Table:
    """A part's answer to each block: a bit for each hash, whether it came more than once."""
    sent = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    every = np.concatenate(sent)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    same = np.zeros(len(every), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    again = np.empty(len(every), bool)
    again[order] = same
    edges = np.cumsum([0, *map(len, sent)])
    bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
    return pa.table([table.column("block"), table.column("part"), pa.array(bits, pa.binary())], names=["block", "part", "bits"])


def shared_keys(once: DataFrame) -> DataFrame:
    """``set, n, rest, key`` of the keys of (set, n, keys) rows, one a set, that several sets have;
    ``rest`` counts the key and what follows it in its set. A key of one set whose hash is
    another's, about one in some thousands, comes along."""
    packed = durable(blocks(once))
    total = packed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = min(PARTS, 1 + total // 8 // PART)

    def send(batches):
        release()
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys"), strict=True):
                _, edges, hashes = dealt(np.frombuffer(keys.as_py(), np.int64), parts)
                found = [(block, k, hashes[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "part", "hashes"])

    def chosen(own: pa.Table, told: pa.Table) -> pa.Table:
        release()
        names = ["set", "n", "rest", "key"]
        if not own.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64())], names=names)
        sets, sizes, counts, keys = (
            np.frombuffer(own.column(c)[0].as_py(), k)
            for c, k in (("sets", np.int64), ("sizes", np.int32), ("counts", np.int32), ("keys", np.int64))
        )
        order, edges, _ = dealt(keys, parts)
        again = np.zeros(len(keys), bool)
        for part, bits in zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True):
            a, b = edges[part], edges[part + 1]
            again[order[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).view(bool)
        at = np.flatnonzero(again)
        of = np.repeat(np.arange(len(sets)), counts)[at]
        begin = np.cumsum(counts) - counts
        rest = sizes[of] - (at - begin[of]).astype(np.int32)
        return pa.table([pa.array(sets[of]), pa.array(sizes[of]), pa.array(rest.astype(np.int32)), pa.array(keys[at])], names=names)

    hashes = packed.mapInArrow(send, "block long, part int, hashes binary")
    told = hashes.groupBy("part").applyInArrow(met, "block long, part int, bits binary")
    found = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(chosen, "set long, n int, rest int, key long")
    return durable(found)


def whole(texts: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set, grams`` of the wanted sets, worked out again from one text of each."""

    def make():
        release()

        def step(batch: pa.RecordBatch):
            found = [grams(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(name, found), pa.int64()), lists(found)], names=["set", "grams"])

        return step

    marks = rows.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("mark").alias("mark")).select("mark")
    marks = durable(marks)
    if marks.count() <= BROADCAST:  # otherwise the texts are dealt out by their marks
        marks = F.broadcast(marks)
    some = texts.join(marks, F.xxhash64("text") == F.col("mark"), "left_semi").select("text")
    some = some.groupBy(F.xxhash64("text").alias("mark")).agg(F.min("text").alias("text")).select("text")
    return durable(arrow_map(some, make, "set long, grams array<long>"))


def sizes_fit(a: str, b: str) -> Column:
    over, under = ALIKE
    return under * F.least(f"{a}.n", f"{b}.n") >= over * F.greatest(f"{a}.n", f"{b}.n")


def possible(a: str, b: str) -> Column:
    """Whether sizes and places of a shared key leave room for the similarity: the first key that
    two sets share has at most what follows it in either in common besides."""
    over, under = ALIKE
    return sizes_fit(a, b) & ((over + under) * F.least(f"{a}.rest", f"{b}.rest") >= over * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def fitting(x: dict[str, np.ndarray], y: dict[str, np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Pairs (set, set) of members of one crowded key, x and y or all of one block, that may be
    alike, if they share no other key; see :func:`crowded`."""
    over, under = ALIKE
    n, m = x["n"][:, None].astype(np.int32), y["n"][None, :].astype(np.int32)
    both = -(-over * (n + m) // (over + under))  # what alike sets have in common
    needed = both - np.maximum(n - n // PREFIX - 1, m - m // PREFIX - 1)
    fit = (under * np.minimum(n, m) >= over * np.maximum(n, m)) & (x["part"][:, None] != y["part"][None, :])
    fit &= (x["place"][:, None] >= needed) & (y["place"][None, :] >= needed)
    if same:
        fit &= x["set"][:, None] < y["set"][None, :]
    found = []
    i, j = np.nonzero(fit)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        own, other = x["bits"][a], y["bits"][b]
        least = both[a, b]
        keep = x["n"][a] - np.bitwise_count(own & ~other).sum(1, dtype=np.int32) >= least
        keep &= y["n"][b] - np.bitwise_count(other & ~own).sum(1, dtype=np.int32) >= least
        found += zip(x["set"][a[keep]].tolist(), y["set"][b[keep]].tolist(), strict=True)
    return found


def crowded(member: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, set, n, part, of, bits) of crowded keys that alike sets of
    different components are sure to be among, if they share no other key.

    Sets of n and m members, m the larger, share at least 4(n + m)/9 - 3m/4 keys of their prefixes.
    Where both leave out one less than that of their keys, the most crowded first in an order that
    all sets share, a shared one stays. A key's members meet in blocks of at most about GROUP, each
    with each; only pairs that the sets' bits leave possible become rows.
    """
    place = F.row_number().over(W.partitionBy("set").orderBy(F.desc("of"), "key"))
    over, under = ALIKE
    least = F.floor(F.col("n") * (over / (over + under) - (1 - 1 / PREFIX - over / (over + under)) * under / over))
    rows = member.withColumn("place", place).where(F.col("place") >= least)
    blocks = F.ceil(F.col("of") / GROUP)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def meet(table: pa.Table) -> pa.Table:
        release()
        columns = {c: table.column(c).to_numpy() for c in ("set", "n", "part", "place", "own")}
        bits = table.column("bits").combine_chunks()
        columns["bits"] = bits.flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sides = [{c: v[columns["own"] == k] for c, v in columns.items()} for k in (low, high)]
        pairs = fitting(*sides, low == high)
        ends = list(zip(*pairs, strict=True)) or [(), ()]
        return pa.table([pa.array(e, pa.int64()) for e in ends], names=["x", "y"])

    rows = rows.select("key", "low", "high", "own", "set", "n", "part", "place", "bits")
    found = rows.groupBy("key", "low", "high").applyInArrow(meet, "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def promising(pairs: DataFrame, member: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches (set, bits) allow ALIKE, and whose prefixes share enough
    keys for it.

    Up to the earlier end of the two prefixes all that the sets share is among the prefixes'
    shared keys; beyond it they share at most what follows the prefix that ends there.
    """
    over, under = ALIKE
    n = F.max("n")
    after = n - F.floor(n / PREFIX).cast("int") - 1  # what follows a prefix
    own = member.groupBy("set").agg(F.collect_list("key").alias("own"), n.alias("n"), after.alias("after")).join(sketches, "set")
    sides = [own.select(*[F.col(c).alias(f"{c}_{x}") for c in own.columns]) for x in "ab"]
    both = pairs.join(sides[0], F.col("a") == F.col("set_a")).join(sides[1], F.col("b") == F.col("set_b"))
    most = F.size(F.array_intersect("own_a", "own_b")) + F.greatest("after_a", "after_b")

    def left(a: str, b: str) -> Column:
        lacks = F.zip_with(f"bits_{a}", f"bits_{b}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.col(f"n_{a}") - F.aggregate(lacks, F.lit(0), lambda total, k: total + k)

    total = over * (F.col("n_a") + F.col("n_b"))
    fits = [(over + under) * x >= total for x in (most, left("a", "b"), left("b", "a"))]
    return both.where(fits[0] & fits[1] & fits[2]).select("a", "b")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike by ALIKE or more."""
    over, under = ALIKE
    left = sets.select(F.col("set").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("set").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    counted = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("both"), (F.size("ga") + F.size("gb")).alias("sum")
    )
    return counted.where((over + under) * F.col("both") >= over * F.col("sum")).select("a", "b")


def by_fingerprints(rows: DataFrame) -> DataFrame:
    """Links (a, b) of sets of the rows (doc_id, set, fp): of those whose fingerprints
    :func:`simhash.links` links, of one fingerprint, and of one id, each to the least."""
    once = durable(rows.select("fp", "set").distinct())
    hubs = durable(once.groupBy("fp").agg(F.min("set").alias("hub"), F.max("set").alias("last")))
    ends = [hubs.select(F.col("fp").alias(x), F.col("hub").alias(f"hub_{x}")) for x in "ab"]
    near = links(hubs.select("fp")).join(ends[0], "a").join(ends[1], "b").select("hub_a", "hub_b")
    same = once.join(hubs.where("hub <> last"), "fp").select("set", "hub")
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set").alias("hub"), F.max("set").alias("last"))
    own = rows.select("doc_id", "set").join(ids.where("hub <> last"), "doc_id").select("set", "hub")
    return near.union(same).union(own).toDF("a", "b").where("a <> b").distinct()


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", also: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``doc_id, component_id``: the smallest id that links of a similarity of ALIKE or more
    reach, by the sets of SIZE-word shingles, and the links of sets that ``also`` gives besides
    (:func:`by_fingerprints`).

    Texts of fewer words are one shingle; empty and null texts have none and are alike to each
    other alone. Rows with a null id get the component of their set, and null where it holds no
    id at all. Repeated rows each give their row; an empty table gives none. A very long text is
    one set, held whole by one task. Other columns, whatever their names, are not read.
    """
    texts = narrow(df, doc_id=id, text=text).select("doc_id", text_of("text").alias("text"))
    rows = durable(prefixes(texts, common(texts), also is not None))
    discard(texts.sparkSession)
    told = durable(also(rows)) if also else None
    discard(texts.sparkSession)
    named = rows.select("doc_id", "set")
    vertices = durable(named.groupBy(F.col("set").alias("vertex")).agg(F.min("doc_id").alias("label")))
    keyed = shared_keys(rows.select("set", "n", "keys").dropDuplicates(["set"]))
    discard(texts.sparkSession)
    member = durable(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("of")).where("of > 1"), "key"))
    del keyed
    discard(texts.sparkSession)

    one = F.struct("set", "n", "rest")
    any_ = F.max_by(one, F.struct(F.xxhash64("set", "key"), "set"))
    hubs = member.groupBy("key").agg(F.min(one).alias("least"), any_.alias("any"), F.first("of").alias("of"))
    both = F.when(F.col("of") > CROWD, F.array("least", "any")).otherwise(F.array("least"))
    star = member.select("key", one.alias("y")).join(hubs.select("key", F.explode(both).alias("x")), "key")
    star = star.where("x.set <> y.set").where(possible("x", "y"))
    ends = F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")
    star = durable(star.select(*ends).distinct())
    sketches = durable(rows.groupBy("set").agg(F.any_value("bits").alias("bits")))
    near = durable(promising(star, member, sketches))
    sets = whole(texts, rows, ends_of(near))
    edges = alike(near, sets)
    edges = durable(edges.union(told) if also else edges)
    discard(texts.sparkSession)

    parts = durable(components(vertices.select("vertex", F.col("vertex").alias("label")), edges))
    discard(texts.sparkSession)
    placed = member.join(parts.select(F.col("vertex").alias("set"), F.col("label").alias("part")), "set")
    mixed = placed.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count("*").alias("of"))
    placed = durable(placed.join(mixed.where("p0 <> p1 and of > 2").select("key"), "key"))
    few = placed.where(F.col("of") <= CROWD)
    x, y = (few.select("key", F.struct("set", "n", "part").alias(c)) for c in "xy")
    # the places of shared keys say nothing here: the first one may have been left out
    apart = (F.col("x.set") < F.col("y.set")) & (F.col("x.part") != F.col("y.part")) & sizes_fit("x", "y")
    pairs = x.join(y, "key").where(apart).select(*ends)
    many = placed.where(F.col("of") > CROWD).join(sketches, "set")
    rest = pairs.union(crowded(many)).distinct().join(star, ["a", "b"], "left_anti")
    rest = durable(promising(rest, member, sketches))
    more = whole(texts, rows, ends_of(rest).join(sets, "set", "left_anti"))
    late = durable(alike(rest, sets.union(more)))
    discard(texts.sparkSession)
    # what is in one part stays so: the late links are between parts
    of = parts.select("vertex", F.col("label").alias("part"))
    heads = durable(vertices.join(of, "vertex").groupBy(F.col("part").alias("vertex")).agg(F.min("label").alias("label")))
    ends = [of.select(F.col("vertex").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab"]
    between = late.join(ends[0], "a").join(ends[1], "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    found = components(heads, between).select(F.col("vertex").alias("part"), F.col("label").alias("component_id"))
    return named.join(of.withColumnRenamed("vertex", "set"), "set").join(found, "part").select("doc_id", "component_id")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
