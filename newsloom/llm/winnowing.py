"""Document fingerprints by winnowing. DataFrame functions only.

The k-grams of a text's words get a rolling hash (a cyclic polynomial, doubled from one word to
two to four). Every window of consecutive k-grams chooses its least hash, the rightmost of equal
ones, and what is chosen is kept with its position: any run of ``GRAM + WINDOW - 1`` words that
two texts share leaves a common hash in their fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import narrow, read, text_of

#: Words of a k-gram, k-grams of a window (powers of two), characters of a word at most (a
#: longer run without white space counts as several words), bits that hold a position.
GRAM, WINDOW, LONGEST, PLACES = 4, 8, 16, 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def doubled(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """Joins each element with the one ``step`` later; those without one stay."""
    return let(values, lambda v: F.zip_with(v, F.slice(v, step + 1, F.greatest(F.size(v), F.lit(1))), join))


def mixed(bits: int) -> Callable[[Column, Column], Column]:
    return lambda x, y: turned(x, bits).bitwiseXOR(F.coalesce(y, F.lit(0).cast("long")))


def shortened(values: Column, by: int) -> Column:
    """Without the last ``by`` elements, but with the first one."""
    return let(values, lambda v: F.slice(v, 1, F.greatest(F.size(v) - by, F.lit(1))))


def selected(text: Column) -> Column:
    """The fingerprint: an array of longs in the order of the text, each a hash above PLACES bits
    that hold the position's complement (positions are counted modulo 2 to the power PLACES).

    Fewer than GRAM words make one k-gram, fewer than WINDOW k-grams one window; a text without
    words has the empty fingerprint.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"\S{{1,{LONGEST}}}"), F.lit(0))
    grams, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < GRAM:
        grams, step = doubled(grams, step, mixed(step)), 2 * step
    low = (1 << PLACES) - 1
    mark = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, PLACES + 1), PLACES).bitwiseOR(
        F.lit(low).cast("long") - i.bitwiseAND(F.lit(low))
    )
    least, step = F.transform(shortened(grams, GRAM - 1), mark), 1
    while step < WINDOW:
        least, step = doubled(least, step, lambda x, y: F.least(x, y)), 2 * step
    return F.array_distinct(shortened(least, WINDOW - 1))


def hashes(found: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(found, lambda x: F.shiftrightunsigned(x, PLACES)))


def positions(found: Column) -> Column:
    """The word positions of a fingerprint."""
    low = F.lit((1 << PLACES) - 1).cast("long")
    return F.transform(found, lambda x: low - x.bitwiseAND(low))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return let(common, lambda n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n)))


def digest(found: Column) -> Column:
    """A short name of the fingerprint: the same hashes at the same positions have the same."""
    return F.sha2(F.array_join(F.transform(found, lambda x: F.hex(x)), ","), 256)


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, hashes, positions`` of each row, in the order of the text.

    Null texts count as empty and have empty arrays; equal texts have equal ones; null ids stay
    null; repeated rows each give their row. Other columns are not read.
    """
    rows = narrow(df, doc_id=id, text=text).select("doc_id", selected(text_of("text")).alias("found"))
    all_hashes = F.transform("found", lambda x: F.shiftrightunsigned(x, PLACES))
    return rows.select("doc_id", all_hashes.alias("hashes"), positions(F.col("found")).alias("positions"))


def bucketed(rows: DataFrame, at: str, most: int = 100_000, leaves: int = 128) -> DataFrame | None:
    """``rows`` with ``bucket`` and ``after``: buckets hold successive ranges of the long ``at``,
    and each bucket also gets, with ``after`` 1, the rows that begin the next one (the last
    bucket: the first one). None if there are no rows.

    Ranges come from approximate quantiles, each cut evenly, so their number, at most ``most``,
    bounds what the driver and the broadcast hold, whatever the rows' number.
    """
    share = [i / leaves for i in range(1, leaves)]
    stats = rows.agg(F.min(at), F.max(at), F.count("*"), F.percentile_approx(at, share, 2000)).first()
    if not stats[2]:
        return None
    wanted = min(most, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + stats[2] // 8)
    cuts = sorted({stats[0], *(stats[3] or [])}) if wanted > 1 else [stats[0]]
    parts = -(-wanted // len(cuts))

    def leaf(a: int, b: int) -> Column:
        """The number of the last cut from a to b that isn't above the row, by halving."""
        if b - a == 1:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col(at) < cuts[mid], leaf(a, mid)).otherwise(leaf(mid, b))

    low = F.element_at(F.array(*[F.lit(c).cast("double") for c in cuts]), F.col("leaf") + 1)
    span = F.element_at(
        F.array(*[F.lit(float(b - a) or 1.0) for a, b in zip(cuts, [*cuts[1:], stats[1] + 1], strict=True)]), F.col("leaf") + 1
    )
    inner = F.least(F.lit(parts - 1), F.floor((F.col(at).cast("double") - low) / span * parts))
    placed = rows.withColumn("leaf", leaf(0, len(cuts))).withColumn("bucket", (F.col("leaf") * parts + inner).cast("int"))
    placed = placed.drop("leaf")
    firsts = sorted(placed.groupBy("bucket").agg(F.min(at).alias("first")).collect())
    before = [(firsts[k]["first"], firsts[k - 1]["bucket"]) for k in range(len(firsts))]
    table = rows.sparkSession.createDataFrame(before, "first long, before int")
    copies = F.array(
        F.struct(F.col("bucket"), F.lit(0).alias("after")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("after"))
    )
    copies = F.when(F.col("before").isNull(), F.slice(copies, 1, 1)).otherwise(copies)
    placed = placed.join(F.broadcast(table), F.col(at) == F.col("first"), "left")
    return placed.withColumn("copy", F.explode(copies)).select(*rows.columns, "copy.bucket", "copy.after")


def edited_likeness(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they and the next document's are.

    The edited text ends in the beginning of the next document, by ascending id, null ids first
    and the text deciding between equal ids; after the last comes the first (a single row is its
    own next). Ids are whole numbers. Null texts count as empty; repeated rows each give their row;
    an empty table gives none. Rows of one id, or without one, are in one bucket, in one task's
    window; a very long text is one row's. Other columns, whatever their names, are not read.
    """
    rows = narrow(df, doc_id=id, text=text)
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("at")
    placed = bucketed(rows.select("doc_id", text_of("text").alias("text"), at), "at")
    if placed is None:
        placed = rows.select("doc_id", "text", at, F.lit(0).alias("bucket"), F.lit(0).alias("after")).limit(0)
    here = placed.repartition("bucket").withColumn("found", selected(F.col("text")))
    here = here.withColumn("own", hashes(F.col("found")))
    order = W.partitionBy("bucket").orderBy("after", "at", "text")
    following = here.withColumn("next", F.lead("text").over(order)).withColumn("other", F.lead("own").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    both = following.where("after = 0").withColumn("edited", changed).withColumn("found2", selected(F.col("edited")))
    own = F.col("own")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("found")).alias("fingerprint"),
        digest(F.col("found2")).alias("edited_fingerprint"),
        let(hashes(F.col("found2")), lambda h: likeness(own, h)).alias("near_edited"),
        likeness(own, F.col("other")).alias("near_next"),
    )


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_likeness(read(spark, sf_dir, "documents"))
