"""The registry with postings that are kept: what each term of its stories is in.

A version of the registry is its records, as :func:`newsloom.operators.registry.upsert` leaves
them, each with the version in which its story last changed. Postings are only added: those of
new and changed stories, under that version and in buckets of terms, so that a posting counts if
its record still has the version. A cycle reads the buckets of its own topics' terms, and of
them the terms that it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.durable import durable
from newsloom.functions.order import numbered
from newsloom.functions.packs import Pack
from newsloom.operators import rank, registry

#: Folders that the postings' terms are dealt to.
BUCKETS = 64
RECORDS = "pos long, title string, status string, category string, url string, story string, since int"
POSTINGS = "term string, id long, of_title boolean, terms int, since int, bucket int"


class Stored:
    """A registry below a folder."""

    def __init__(self, spark: SparkSession, folder: str, pack: Pack):
        self.spark, self.folder, self.pack = spark, folder, pack

    def records(self, version: int) -> DataFrame:
        """The records of a version; version 0 has none."""
        if not version:
            return self.spark.createDataFrame([], RECORDS)
        return self.spark.read.schema(RECORDS).parquet(f"{self.folder}/records/version={version}")

    def change(self, updates: DataFrame, version: int) -> None:
        """Makes the ``version`` out of the one before by ``updates`` (pos, title, status, category,
        url, story) in the order of ``pos``. Done again, it replaces itself."""
        old = self.records(version - 1)
        after = durable(registry.upsert(old.drop("since"), updates))
        last = old.agg(F.max("pos")).first()[0]
        new = numbered(after.where("change = 'inserted'"), ["pos"]).withColumn("pos", F.col("place") + (last or 0)).drop("place")
        known = after.where("change <> 'inserted'").join(old.select("pos", "since", F.col("story").alias("told")), "pos")
        since = F.when(F.col("story").eqNullSafe(F.col("told")), F.col("since")).otherwise(version)
        names = ["pos", *registry.RECORD, "since"]
        every = known.withColumn("since", since).select(*names).union(new.withColumn("since", F.lit(version)).select(*names))
        every.write.mode("overwrite").parquet(f"{self.folder}/records/version={version}")
        changed = self.records(version).where(F.col("since") == version).select(F.col("pos").alias("id"), "title", "story")
        rows = rank.postings(changed, self.pack).select("*", F.lit(version).alias("since"), self._bucket(F.col("term")).alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/version={version}")

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")

    def unknown(self, topics: DataFrame, urls: DataFrame, version: int) -> DataFrame:
        """Topics (id, title, story) that no record of the version has, by any of the topic's
        ``urls`` (id, url) or as the same story: as :func:`rank.not_in_registry` tells them, by the
        postings of the topics' terms alone."""
        records = self.records(version)
        by_url = urls.join(records.where("url <> ''").select("url").distinct(), "url", "left_semi").select("id")
        topics = topics.join(by_url, "id", "left_anti")  # stories are compared only where no address tells
        told = rank.stated(topics.select("id", "title", "story"), self.pack)
        terms = told.select(F.explode(F.array_union("terms", "all")).alias("term")).distinct()
        buckets = [r["bucket"] for r in terms.select(self._bucket(F.col("term")).alias("bucket")).distinct().collect()]  # no more than there are
        stored = None
        if version and buckets:
            paths = [f"{self.folder}/postings/version={v}" for v in range(1, version + 1)]
            parts = [self.spark.read.schema(POSTINGS).parquet(p).where(F.col("bucket").isin(buckets)) for p in paths]
            stored = parts[0]
            for part in parts[1:]:
                stored = stored.union(part)
        if stored is None:
            return topics
        live = stored.join(records.select(F.col("pos").alias("id"), "since"), ["id", "since"], "left_semi")
        met = live.join(terms, "term")
        has = F.collect_list(F.when(F.col("of_title"), F.col("term"))).alias("terms")
        kept = durable(met.groupBy("id").agg(has, F.max("terms").alias("n"), F.collect_list("term").alias("all")))
        known = rank.told_by(told, kept).select(F.col("a").alias("id")).union(rank.told_by(kept, told).select(F.col("b").alias("id")))
        return topics.join(known, "id", "left_anti")
