"""Merkle manifest of a dataset: a tree of digests for each group of rows, one over the groups.

Rows become leaves, ordered within their group; every 16 consecutive nodes have one parent, until
one node is left. Leaves are dealt by ranges of (group, order), so a group of any size lies in
many tasks. In a task partial parents gather their children's digests by index; the child that
makes one complete, as its size by the number of nodes tells, is the event on which it is hashed
and becomes a child itself. What stays incomplete at the borders of ranges, a few nodes a level
and range, is the frontier; it is dealt again by parent until only roots are left. Parents keep
their children's digests: along these reverse links proofs go down from the root, level by level
for the upper ones, and in blocks of 4,096 leaves for the last three.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.order import numbered

from .common import durable, narrow, read

#: Children of a node, as a power of two, and levels that a block of leaves holds.
BITS, BLOCK = 4, 3
ARITY, WIDTH = 1 << BITS, 32
#: Incomplete parents that a task holds; beyond, they go to the frontier at once.
OPEN = 50_000


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def lowered(text: Column) -> Column:
    """A-Z alone in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def hashed(content: bytes) -> bytes:
    """Digest of digests, which are hashed as hex text."""
    return hashlib.sha256(content.hex().encode()).digest()


NODE = "root boolean, parent boolean, g long, level int, i long, n long, digest binary, children binary"


def combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (g, level, i, n, digest) to the parents that they complete, the roots, and the
    frontier: those whose parent isn't complete in this task."""
    partial: dict[tuple, dict[int, bytes]] = {}
    sizes: dict[tuple, int] = {}
    out: list[tuple] = []

    def flushed():
        for (g, level, p), have in partial.items():
            n = sizes[g, level, p]
            out.extend((False, False, g, level, (p << BITS) + at, n, have[at], None) for at in have)
        partial.clear()
        sizes.clear()

    def emitted():
        columns = zip(*out, strict=True)
        types = [pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in NODE.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for g, level, i, n, own in zip(*[batch.column(c).to_pylist() for c in ("g", "level", "i", "n", "digest")], strict=True):
            while n > 1:
                p, at = i >> BITS, i & (ARITY - 1)
                key = (g, level, p)
                have = partial.setdefault(key, {})
                have[at] = own
                arity = min(ARITY, n - (p << BITS))
                if len(have) < arity:
                    sizes[key] = n
                    break
                del partial[key]
                sizes.pop(key, None)
                children = b"".join(have[k] for k in range(arity))
                own, level, i, n = hashed(children), level + 1, p, -(-n >> BITS)
                out.append((False, True, g, level, i, n, own, children))
            else:
                out.append((True, False, g, level, i, n, own, None))
        if len(partial) > OPEN:
            flushed()
        if len(out) > 4000:
            yield emitted()
    flushed()
    if out:
        yield emitted()


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and roots of the trees over ``nodes`` (g, level, i, n, digest), which come in
    ranges: all levels of them, by rounds of which there are no more than levels."""
    steps = [durable(nodes.mapInArrow(combined, NODE))]
    while True:
        frontier = steps[-1].where("not root and not parent")
        if not frontier.limit(1).count():
            break
        parent = F.shiftright("i", BITS)
        dealt = frontier.repartition("g", "level", parent).sortWithinPartitions("g", "level", "i")
        steps.append(durable(dealt.mapInArrow(combined, NODE)))
    every = steps[0]
    for step in steps[1:]:
        every = every.union(step)
    return every.where("parent").select("g", "level", "i", "children"), every.where("root").select("g", "level", "digest")


def byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def descended(tops: DataFrame, parents: DataFrame, to: int) -> DataFrame:
    """From the nodes ``tops`` (g, level, i, path and others) down to the nodes at level ``to``;
    those at or below it stay. A path goes from a node up to the root and has for each level the
    place in the run, the number of siblings and their digests."""
    done, front = tops.where(F.col("level") <= to), tops.where(F.col("level") > to)
    while front.limit(1).count():
        own = front.join(parents.where(F.col("level") > to), ["g", "level", "i"])
        kids = (F.length("children") / WIDTH).cast("int")
        each = own.select("*", kids.alias("kids"), F.explode(F.sequence(F.lit(0), kids - 1)).alias("k"))
        siblings = F.concat(
            F.substring(F.col("children"), F.lit(1), F.col("k") * WIDTH),
            F.substring(F.col("children"), (F.col("k") + 1) * WIDTH + 1, F.lit(ARITY * WIDTH)),
        )
        path = F.concat(byte(F.col("k")), byte(F.col("kids") - 1), siblings, F.col("path"))
        changed = {"level": F.col("level") - 1, "i": F.shiftleft("i", BITS) + F.col("k"), "path": path}
        below = durable(each.select(*[changed.get(c, F.col(c)).alias(c) for c in tops.columns]))
        done, front = done.union(below.where(F.col("level") <= to)), below.where(F.col("level") > to)
    return done


def folded(own: bytes, path: bytes) -> bytes:
    """The root that a leaf and a path lead to."""
    at = 0
    while at < len(path):
        k, m = path[at], path[at + 1]
        siblings = path[at + 2 : at + 2 + m * WIDTH]
        own = hashed(siblings[: k * WIDTH] + own + siblings[k * WIDTH :])
        at += 2 + m * WIDTH
    return own


def siblings_of(path: bytes) -> bytes:
    """All siblings of a path, level by level."""
    out, at = [], 0
    while at < len(path):
        end = at + 2 + path[at + 1] * WIDTH
        out.append(path[at + 2 : end])
        at = end
    return b"".join(out)


@dataclass
class Manifest:
    """The trees of a dataset; every table can be written and read again.

    ``leaves`` (id, g, i, n, leaf and what else the leaves came with), ``parents`` (g, level, i,
    children), ``groups`` (g, key, subroot, path, root), a row for each group with its path to the root.
    """

    leaves: DataFrame
    parents: DataFrame
    groups: DataFrame

    def proofs(self, claim: str = "leaf") -> DataFrame:
        """``id, leaf, subroot, root, proof, folded`` of each leaf, digests as binary: the proof is
        the digest of its siblings up to the root, ``folded`` the root that the digest in the column
        ``claim`` leads to with them (null: the leaf's own)."""
        kind = self.leaves.schema["id"].dataType.simpleString()
        roots = self.groups.select("g", "level", F.lit(0).cast("long").alias("i"), "path", "subroot", "root")
        rest = descended(roots, self.parents, BLOCK)
        none, whole = F.lit(None).cast("binary"), F.lit(None).cast(kind).alias("id")
        # a node at the block's own level is the block; a whole tree of fewer levels has index 0
        up = F.expr(f"shiftright(i, {BITS} * greatest({BLOCK} - level, 0))").alias("block")
        shape = ["g", up, "kind", "level", "i", "id", "a", "b", "c"]
        first = rest.select("*", F.lit(0).alias("kind"), whole, F.col("path").alias("a"), F.col("subroot").alias("b"), F.col("root").alias("c"))
        inner = self.parents.where(F.col("level") <= BLOCK)
        inner = inner.select("*", F.lit(1).alias("kind"), whole, F.col("children").alias("a"), none.alias("b"), none.alias("c"))
        last = self.leaves.select("*", F.lit(2).alias("kind"), F.lit(0).alias("level"), F.col("leaf").alias("a"), F.coalesce(claim, "leaf").alias("b"), none.alias("c"))
        rows = first.select(*shape).union(inner.select(*shape)).union(last.select(*shape))
        dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", "kind", F.desc("level"), "i")
        return dealt.mapInArrow(proven, f"id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")


def proven(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each its rest of the path, its parents from above and its leaves."""
    paths: dict[tuple, bytes] = {}
    here = subroot = root = None
    names = ["leaf", "subroot", "root", "proof", "folded"]
    for batch in batches:
        ids, at, out = batch.column("id"), [], []
        columns = [batch.column(c).to_pylist() for c in ("g", "block", "kind", "level", "i", "a", "b", "c")]
        for row, (g, block, kind, level, i, a, b, c) in enumerate(zip(*columns, strict=True)):
            if (g, block) != here:
                here = (g, block)
                paths.clear()
            if kind == 0:
                paths[level, i], subroot, root = a, b, c
            elif kind == 1:
                above, kids = paths.pop((level, i)), len(a) // WIDTH
                for k in range(kids):
                    paths[level - 1, (i << BITS) + k] = bytes((k, kids - 1)) + a[: k * WIDTH] + a[(k + 1) * WIDTH :] + above
            else:
                path = paths[0, i]
                at.append(row)
                out.append((a, subroot, root, hashed(siblings_of(path)), folded(b, path)))
        if out:
            found = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *found], names=["id", *names])


def leaves_of(df: DataFrame, group: str, order: str, columns: list[str], **more: Column) -> DataFrame:
    """``id, key, leaf`` and the digests ``more`` of each row; null groups come before all others."""
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    return df.select(F.col(order).alias("id"), key.alias("key"), digest([F.col(c) for c in columns]).alias("leaf"), *[v.alias(k) for k, v in more.items()])


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (id, key, leaf, ...): within a key they ascend by (id, leaf), null
    ids first; keys ascend bytewise. Equal rows are leaves of their own, dealt by ranges like all
    others. Without leaves there is no group and no root."""
    more = [c for c in leaves.columns if c not in ("id", "key", "leaf")]
    own = durable(leaves).withColumn("tie", F.monotonically_increasing_id())
    order = ["key", "id", "leaf", "tie"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    marked = durable(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    # a row for each range and key: where the key's rows of this range begin, and how many it has
    runs = marked.groupBy("part", "key").agg(F.count("*").alias("m"), F.min("row").alias("least"))
    by_key = W.partitionBy("key")
    before = F.coalesce(F.sum("m").over(by_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = durable(runs.select("*", before.alias("before"), F.sum("m").over(by_key).alias("n")))
    keys = durable(numbered(runs.select("key").distinct(), ["key"], "g").withColumn("g", F.col("g") - 1))
    runs = runs.join(keys, "key").select("part", "key", "g", "least", "before", "n")
    i = (F.col("before") + F.col("row") - F.col("least")).alias("i")
    indexed = durable(marked.join(runs, ["part", "key"]).select("id", "g", i, "n", "leaf", *more).sortWithinPartitions("g", "i"))
    level = F.lit(0).alias("level")
    parents, roots = grown(indexed.select("g", level, "i", "n", F.col("leaf").alias("digest")))
    # the tree over the groups: its leaves are their roots
    known = roots.join(keys, "g").select("g", "key", "level", F.col("digest").alias("subroot"))
    n = keys.count()
    over = known.select(F.lit(0).cast("long").alias("g"), level, F.col("g").alias("i"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest"))
    above, root = grown(over.repartitionByRange("i").sortWithinPartitions("i"))
    tops = root.select("g", "level", F.lit(0).cast("long").alias("i"), F.lit(b"").alias("path"), F.col("digest").alias("root"))
    places = descended(tops, above, 0).select(F.col("i").alias("g"), "path", "root")
    return Manifest(indexed, parents, durable(known.join(places, "g")))


#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """The documents' manifest, each one's proof, and its check after some texts were changed.

    Null columns are hashed as ``-``; null sources are the first group; null ids come first in
    theirs and aren't tampered with; repeated rows are leaves each; other columns aren't read. An
    empty table gives no rows.
    """
    docs = narrow(read(spark, sf_dir, "documents"), **{c: c for c in FIELDS})
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    forged = F.when(hit, digest([*[F.col(c) for c in FIELDS[:-1]], lowered(F.col("text"))]))
    found = build(leaves_of(docs, "source", "doc_id", FIELDS, forged=forged)).proofs("forged")
    shown = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"),
        shown("leaf").alias("leaf"),
        shown("subroot").alias("subroot"),
        shown("root").alias("root"),
        shown("proof").alias("proof_sha256"),
        shown("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 6, above: int = 4) -> str:
    """The same in SQL, with the levels written out: up to 16 ** levels leaves a source."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    rest = " || ".join(value(c) for c in FIELDS[:-1])
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
    octets = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, z: {step})))"

    def tree(t: str, k: str, nodes: str, deep: int) -> list[str]:
        out = [f"{t}0 AS ({nodes})"]
        for j in range(deep):
            out.append(f"{t}r{j} AS (SELECT {k}, i // 16 AS p, list(h ORDER BY i) AS kids, any_value(n) AS n FROM {t}{j} WHERE n > 1 GROUP BY {k}, i // 16)")
            out.append(f"{t}{j + 1} AS (SELECT {k}, p AS i, sha256(array_to_string(kids, '')) AS h, (n + 15) // 16 AS n FROM {t}r{j})")
        out.append(f"{t}top AS ({' UNION ALL '.join(f'SELECT {k}, h FROM {t}{j} WHERE n = 1' for j in range(deep + 1))})")
        return out

    def climb(t: str, k: str, start: str, rows: str, deep: int) -> list[str]:
        """From the rows' node (i) up, what it folds to (cur) and its siblings (sib)."""
        out = [f"{start}0 AS ({rows})"]
        left, right = "coalesce(array_to_string(kids[1:x.i % 16], ''), '')", "coalesce(array_to_string(kids[x.i % 16 + 2:], ''), '')"
        for j in range(deep):
            out.append(f"""{start}{j + 1} AS (SELECT x.* REPLACE (CASE WHEN p IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur,
  CASE WHEN p IS NULL THEN sib ELSE sib || {left} || {right} END AS sib, x.i // 16 AS i) FROM {start}{j} x LEFT JOIN {t}r{j} r ON r.{k} = x.{k} AND r.p = x.i // 16)""")
        return out

    parts = [
        f"""d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k, sha256({rest} || {value("text")}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({rest} || {value(small)}) END AS forged FROM documents)""",
        "e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d)",
        *tree("s", "k", "SELECT k, i, leaf AS h, n FROM e", levels),
        *tree("u", "z", "SELECT 0 AS z, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n FROM stop", above),
        *climb("s", "k", "a", "SELECT doc_id, k, i, leaf, coalesce(forged, leaf) AS cur, '' AS sib FROM e", levels),
        "g AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i FROM stop)",
        *climb("u", "z", "b", f"SELECT doc_id, 0 AS z, g.i, leaf, g.h AS subroot, cur, sib FROM a{levels} JOIN g USING (k)", above),
    ]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, utop.h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = utop.h AS verified FROM b{above} CROSS JOIN utop"""


SQL = _sql()
