"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by its content. Only blobs that the ledger does not yet
have under the present rules are scanned, each once however many paths and versions hold it; the
findings go into the ledger and are joined back to all paths. DataFrame functions only.

Matches become rows, and running sums over a blob's rows give their places; so a text costs in
proportion to its length, however many secrets it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, narrow, read, text_of, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group`` has at
    least ``least`` characters. ``hint`` is a cheap pattern that every such text matches. Where
    shorter matches can't hide longer ones the pattern itself may ask for the length."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


# The patterns and lengths of the contract, letters of the first in either case.
RULES = (
    Rule(
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
        r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}",
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
RULE_VERSION = "1"
#: Where a finding is in code points, and from which byte to which.
SPAN = "struct<start:int,kind:int,end:int,first:int,last:int>"
#: A session's setting that names the folder in which ``op1_secrets`` keeps its ledger.
LEDGER = "spark.newsloom.ledger"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches in order: lengths of what is between them (from split()) and of their
    own (from regexp_extract_all()), in code points and bytes."""
    every = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), every(0).alias("own"), every(rule.group).alias("value"))

    def of(m: Column, i: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(m["value"]).alias("value"),
            F.length(m["own"]).alias("own"), (F.length(m["gap"]) + F.length(m["own"])).alias("step"),
            F.octet_length(m["own"]).alias("own_bytes"), (F.octet_length(m["gap"]) + F.octet_length(m["own"])).alias("step_bytes"),
        )

    # what follows the last match has no match of its own
    return F.when(text.rlike(rule.hint), F.filter(F.transform(found, of), lambda m: m["own"].isNotNull()))


def findings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, findings`` of (blob, text) rows, one a blob. The windows and the last grouping keep
    to the rows' own partitioning by blob."""
    none = F.array()
    every = F.concat(*[F.coalesce(matches(F.col("text"), rule, k), none) for k, rule in enumerate(rules)])
    rows = texts.select("blob", F.explode_outer(every).alias("m")).select("blob", "m.*")
    before = W.partitionBy("blob", "kind").orderBy("i")
    end, last = F.sum("step").over(before).cast("int"), F.sum("step_bytes").over(before).cast("int")
    rows = rows.select("blob", "kind", "value", "own", "own_bytes", end.alias("end"), last.alias("last"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    span = F.struct((F.col("end") - F.col("own")).alias("start"), "kind", "end", (F.col("last") - F.col("own_bytes")).alias("first"), "last")
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("value") >= least, span))).cast(f"array<{SPAN}>").alias("findings"))


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    id: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    version: str = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, blob, findings)`` of every row, and the ledger grown by what was scanned.

    The ledger has ``blob`` (SHA-256), ``rule_version`` and ``findings`` (start, kind as the
    number of the rule, end, and the bytes' first and last; by start, then kind). ``versions`` has
    a row for each version of a path; null texts count as empty. Rows with equal texts get equal
    findings; null ids stay null; repeated rows each give their row; an empty table gives none. A
    very long text is scanned whole by one task. Other columns, whatever their names, are not read.
    """
    rows = narrow(versions, doc_id=id, text=text).select("doc_id", text_of("text").alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("text", 256)))
    fresh = rows.select("blob", "text")
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version)
        fresh = fresh.join(known.select("blob"), "blob", "left_anti")
    fresh = fresh.groupBy("blob").agg(F.first("text").alias("text"))
    found = findings(fresh, rules).select("blob", F.lit(version).alias("rule_version"), "findings")
    scanned = durable(found)
    grown = scanned if ledger is None else ledger.select(*scanned.columns).union(scanned)
    hits = grown.where((F.col("rule_version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    back = rows.select("doc_id", "blob").join(hits, "blob", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return back.select("doc_id", "blob", F.coalesce("findings", none).alias("findings")), grown


def named(findings: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The findings as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    say = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(findings, say), ",")


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger that a folder holds; None before the first :func:`store`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(folder) if there else None


def store(grown: DataFrame, ledger: DataFrame | None, folder: str) -> None:
    """Adds to the folder what a scan has grown the ledger by; what is there isn't written again."""
    keys = ["blob", "rule_version"]
    new = grown if ledger is None else grown.join(ledger.select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(folder)


def cuts(ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """``blob, cuts``: first and last byte of each run of overlapping findings, in order."""
    hits = ledger.where(F.col("rule_version") == version).select("blob", F.explode("findings").alias("s"))
    order = W.partitionBy("blob").orderBy("s.start", "s.kind")
    before = F.max("s.end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = (before.isNull() | (F.col("s.start") >= before)).cast("int")
    runs = hits.select("blob", "s", begins.alias("begins"), F.col("s.start").alias("at"), F.col("s.kind").alias("kind"))
    runs = runs.select("blob", "s", F.sum("begins").over(W.partitionBy("blob").orderBy("at", "kind")).alias("run"))
    runs = runs.groupBy("blob", "run").agg(F.min("s.first").alias("first"), F.max("s.last").alias("last"))
    return runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def redacted(text: Column, cuts: Column, mark: str = "[secret]") -> Column:
    """The text with the mark in place of each of the cuts, which are in order and apart."""
    n = F.size(cuts)

    def joined(raw: Column) -> Column:
        def piece(i: Column) -> Column:
            begin = F.when(i > 0, F.element_at(cuts, i)["last"]).otherwise(0)
            end = F.when(i < n, F.try_element_at(cuts, i + 1)["first"]).otherwise(F.octet_length(raw))
            return F.substring(raw, begin + 1, end - begin).cast("string")

        return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), mark)

    # a variable of the bytes, which a cast would copy for every piece
    return F.transform(F.array(text.cast("binary")), joined)[0]


def redact(df: DataFrame, ledger: DataFrame, text: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """``df`` with the findings that the ledger has for each text's blob redacted, each run of
    overlapping ones by one mark. Null and empty texts stay as they are, and so do texts that the
    ledger doesn't have; all rows and columns stay, whatever their names."""
    blob, found = unused(df, "blob"), unused(df, "cuts")
    hits = cuts(ledger, version).select(F.col("blob").alias(blob), F.col("cuts").alias(found))
    own = F.col(f"`{text}`")
    joined = df.join(hits, F.unhex(F.sha2(text_of(f"`{text}`"), 256)) == F.col(blob), "left")
    clean = F.when(F.col(found).isNotNull(), redacted(own.cast("string"), F.col(found))).otherwise(own)
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document. The ledger adds no spans to the base rules' own. Where the
    session's setting LEDGER names a folder, blobs of earlier versions aren't scanned again, and
    new ones are added to it."""
    folder = spark.conf.get(LEDGER, None)
    known = load(spark, folder) if folder else None
    found, grown = scan(read(spark, sf_dir, "documents"), known)
    if folder:
        store(grown, known, folder)
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    spans = named(F.col("findings"))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(RULES)],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def _sql() -> str:
    word = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
    keys = "|".join([*map(word, ("password", "passwd", "secret", "token")), word("api") + "_?" + word("key")])
    assign = f"({keys})[\"\\x27]?\\x20*[:=]\\x20*[\"\\x27]?([A-Za-z0-9+/_.=-]+)"
    kinds = (("assign", assign, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}', 0) AS m, "
        f"regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS s FROM d"
        for k, (kind, p, group, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({each}),
u AS (SELECT doc_id, k, kind, least, unnest(v) AS v, unnest(m) AS m, unnest(s[1:len(m)]) AS s,
        unnest(range(1, len(m) + 1)) AS i FROM e),
p AS (SELECT doc_id, k, kind, least, v, sum(length(s) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e,
        length(m) AS n FROM u),
f AS (SELECT doc_id, k, kind, (e - n)::BIGINT AS b, e::BIGINT AS e FROM p WHERE length(v) >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


SQL = _sql()
