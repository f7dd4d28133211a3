"""Topics of posts that come in cycles.

Links go to earlier posts alone, so what a post once joined it stays in: a cycle settles its own
posts and never looks at settled ones again, but for joining new posts to them. What earlier cycles
leave is an index of three tables, a folder for each cycle: the posts with their signatures, roots
and classes; the classes' texts in blocks; and for each event and word the least root of the posts
that have both. A cycle joins its posts' blocks with the stored ones, whose sizes and events the
scan goes by, and its events' words with the marks; its own posts are clustered among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.durable import durable
from newsloom.functions.packs import Pack
from newsloom.operators import cluster, pairs

#: Cycles after which the index is written anew as a whole.
EVERY = 16
POSTS = "pos long, rep long, root long, anchors long, strong long, words array<bigint>, numbers array<bigint>, places array<bigint>"
BLOCKS = "lo int, hi int, events boolean, packed binary"
MARKS = "key long, word long, root long"


class Index:
    """Settled topics below a folder, which belongs to one run of cycles (a civil day's, say)."""

    def __init__(self, spark: SparkSession, folder: str, pack: Pack):
        self.spark, self.folder, self.pack = spark, folder, pack

    def _path(self, table: str, kind: str, number: int) -> str:
        return f"{self.folder}/{table}/{kind}={number}"

    def _before(self, table: str, shape: str, number: int) -> DataFrame:
        """The table as the cycles before ``number`` left it: the last whole one, and the rest."""
        base = max(number - 1, 0) // EVERY * EVERY
        paths = [self._path(table, "cycle", k) for k in range(base, number)]
        paths += [self._path(table, "base", base)] if base else []
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def posts(self, number: int) -> DataFrame:
        """``pos, root`` of all posts of the cycles before ``number``."""
        return self._before("posts", POSTS, number).select("pos", "root")

    def _write(self, df: DataFrame, table: str, kind: str, number: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, kind, number))

    def compact(self, number: int) -> None:
        """Writes the index anew as of cycle ``number``, a multiple of ``EVERY``, and lets go of what
        a repeated cycle can no longer ask for. Done again, it replaces itself."""
        whole = {}
        for table, shape in (("posts", POSTS), ("marks", MARKS)):
            base = number - EVERY
            paths = [self._path(table, "cycle", k) for k in range(base, number)] + ([self._path(table, "base", base)] if base else [])
            whole[table] = self.spark.read.schema(shape).parquet(*paths)
        self._write(whole["posts"], "posts", "base", number)
        self._write(whole["marks"].groupBy("key", "word").agg(F.min("root").alias("root")), "marks", "base", number)
        firsts = self.spark.read.schema(POSTS).parquet(self._path("posts", "base", number)).where("pos = rep").where(pairs.WORDY)
        self._write(_blocks(firsts), "blocks", "base", number)
        for table in ("posts", "marks", "blocks"):
            old = [self._path(table, "base", number - 2 * EVERY)] if number > 2 * EVERY else []
            old += [self._path(table, "cycle", k) for k in range(max(0, number - 2 * EVERY), number - EVERY)]
            for path in old:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def cycle(self, posts: DataFrame, number: int, pos: str = "pos", text: str = "text") -> DataFrame:
        """``pos, root`` of the cycle's posts, whose positions are distinct longs above all earlier
        ones; numbers go up by one from 0. A repeated cycle replaces itself."""
        if number and number % EVERY == 0:
            self.compact(number)
        signed = cluster.signatures(posts, self.pack, pos, text)
        every = durable(pairs.shaped(signed, self.pack.anchors, self.pack.strong_event))
        shaped = every.where(pairs.WORDY)
        found = cluster.links(shaped, self.pack)
        met = cluster.events(shaped, len(self.pack.strong_event))
        marked = met.select("key", "pos", F.explode("words").alias("word"))
        known, unsure, before = None, found.unsure, None
        if number:
            settled = self._before("posts", POSTS, number)
            fresh = durable(_blocks(cluster.first_texts(shaped, found.classed)))
            stored = self._before("blocks", BLOCKS, number)
            alike = _against(fresh, stored, event=False)
            apart = durable(_against(fresh, stored, event=True).where("not shares"))
            least = settled.join(alike.select(F.col("b").alias("rep")).distinct(), "rep").groupBy("rep").agg(F.min("root").alias("root"))
            by_class = alike.join(least, alike.b == least.rep).groupBy(F.col("a").alias("rep")).agg(F.min("root").alias("root"))
            known = found.classed.join(by_class, "rep").select(F.col("pos").alias("p"), "root")
            marks = self._before("marks", MARKS, number)
            known = known.union(marked.join(marks, ["key", "word"]).select(F.col("pos").alias("p"), "root"))
            known = durable(known.groupBy("p").agg(F.min("root").alias("root")))
            if apart.limit(1).count():
                unsure = unsure.union(apart.select("a", "b"))
                before = settled.select("pos", "rep", "root", "words")
        roots = durable(cluster.roots(every.select("pos"), found.sure, every.select("pos", "words"), unsure, found.classed, known, before))
        whole = every.join(roots, "pos").join(found.classed, "pos", "left")
        self._write(whole.select("pos", F.coalesce("rep", "pos").alias("rep"), "root", "anchors", "strong", *pairs.CODES), "posts", "cycle", number)
        self._write(_blocks(cluster.first_texts(shaped, found.classed)), "blocks", "cycle", number)
        self._write(marked.join(roots, "pos").groupBy("key", "word").agg(F.min("root").alias("root")), "marks", "cycle", number)
        return roots

    def publisher(self, out: Callable[[DataFrame, int], None], pos: str = "pos", text: str = "text") -> Callable[[DataFrame, int], None]:
        """For a stream: each batch is a cycle, whose topics go to ``out`` with its number."""
        return lambda batch, number: out(self.cycle(durable(batch), number, pos, text), number)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of texts with events and of those without, as stored."""
    with_events, without = rows.where(pairs.EVENT), rows.where(f"NOT ({pairs.EVENT})")
    kinds = [pairs.packed(part).select("lo", "hi", F.lit(e).alias("events"), "packed") for part, e in ((with_events, True), (without, False))]
    return kinds[0].union(kinds[1])


def _against(fresh: DataFrame, stored: DataFrame, event: bool) -> DataFrame:
    """``a, b, shares``: new and settled first texts that are similar, or of one event. New blocks
    go to every part of the stored ones; a cycle of more bytes than a group has does so in groups."""
    if event:
        fresh, stored = fresh.where("events"), stored.where("events")
    else:
        span = fresh.agg(F.min("lo"), F.max("hi")).first()
        if span[0] is not None:
            stored = stored.where((F.col("hi") >= pairs.HELPED * span[0]) & (F.col("lo") <= span[1] / pairs.HELPED))
    sizes = [df.agg(F.sum(F.length("packed"))).first()[0] or 0 for df in (fresh, stored)]
    groups = -(-sizes[0] // pairs.GROUP) or 1
    parts = max(-(-sizes[1] // pairs.GROUP), fresh.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("packed"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    new = fresh.select("packed", dealt(groups).alias("g"), every(parts).alias("h")).select("packed", "g", "h", F.lit(0).alias("side"))
    old = stored.select("packed", every(groups).alias("g"), dealt(parts).alias("h")).select("packed", "g", "h", F.lit(1).alias("side"))
    tile = (F.col("g").cast("long") * parts + F.col("h")).alias("tile")
    return pairs.joined(new.union(old).select(tile, "side", "packed"), event, groups * parts)
