"""The corpus pipeline: five stages over the documents, each by one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, and each
works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import packing, resemblance, secrets, suffixes, toxicity
from newsloom.llm.common import read, shared_dir, unused


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go."""
    return toxicity.fit(docs, read(spark, sf_dir, "labels")).clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Linked are texts
    whose SimHash fingerprints differ in at most two bits, found by pigeonring filtering, and those
    whose 5-word shingles are alike by 0.8 or more; a group is what both kinds of links reach. Rows of
    one id count as one document; rows without an id stay if some whole group has none."""
    found = resemblance.near_duplicates(docs, also=resemblance.by_fingerprints)
    own = unused(docs, "kept")
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller id has go out of the texts; every document stays, and
    n_chars follows its text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffixes.dedup(docs, keep=tuple(rest))
    named = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    named |= {c: F.col(f"keep{k}") for k, c in enumerate(rest)}
    return found.select(*[named[c].alias(c) for c in docs.columns])


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; every document stays, and n_chars follows its text."""
    _, ledger = secrets.scan(docs)
    clean = secrets.redact(docs, ledger)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secrets", secret_spans),
    ("packing", packed),
]

#: Learned weights, reachability and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    folder = shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
    return docs
