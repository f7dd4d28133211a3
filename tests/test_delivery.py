from pyspark.sql import functions as F

from newsloom.functions.packs import CITY
from newsloom.operators import delivery, lookups

SHAPE = (
    "text string, primary_url string, primary_source string, source_urls array<string>, "
    "members array<struct<source:string,id:long,url:string,text:string,source_name:string>>"
)


def topic(spark, text="Пожар\nподробности", url=None, source=None, urls=(), members=()):
    return spark.createDataFrame([(text, url, source, list(urls), [tuple(m) for m in members])], SHAPE)


def test_the_matching_member_is_the_source(spark):
    members = [("a", 1, "u1", "t1", None), ("b", 2, "u2", "t2", "Б")]
    at = lambda **k: tuple(topic(spark, members=members, **k).select(delivery.source_of().alias("s")).first()["s"])
    assert at(url="u2") == ("t2", "Б", "u2")
    assert at(source="b") == ("t2", "Б", "u2")
    assert at() == ("t1", "Источник", "u1")
    alone = topic(spark, urls=["u9"]).select(delivery.source_of().alias("s")).first()["s"]
    assert tuple(alone) == ("Пожар\nподробности", "Источник", "u9")


def test_keys(spark):
    members = [("a", 1, "u1", "", ""), ("", 2, "u2", "", ""), ("c", None, None, "", "")]
    got = topic(spark, url="p", members=members).select(delivery.keys().alias("k")).first()["k"]
    assert (got["key"], got["member_keys"]) == ("p", ["a:1", "p", "u2"])
    assert topic(spark).select(delivery.keys().alias("k")).first()["k"]["key"] == "пожар"


def test_message(spark):
    def says(label, **k):
        return topic(spark, **k).select(delivery.message(F.lit(label), {"первая": "Г:"}).alias("m")).first()["m"]

    assert says("первая", url="u") == "Г: Пожар\n\nИсточник: u"
    assert says(None, url="u", text=" ") == "Источник: u"


def test_actionable(spark):
    def holds(age, text="Пожар", eligible=True, score=1.0, url="u"):
        rows = topic(spark, text=text, url=url)
        return rows.select(delivery.actionable(F.lit(-age), F.lit(0), F.lit(eligible), F.lit(score), CITY).alias("x")).first()["x"]

    assert holds(0) and holds(10_800)
    assert not holds(10_801) and not holds(-1) and not holds(0, text="дрон") and not holds(0, text="промокод")
    assert not holds(0, eligible=False) and not holds(0, score=None) and not holds(0, url=None)


def test_undelivered(spark):
    rows = spark.createDataFrame([("a", ["m1"]), ("b", ["m2", "m3"]), ("c", ["m4"]), ("", ["m5"])], "key string, member_keys array<string>")
    sent = spark.createDataFrame([("a",)], "key string")
    members = spark.createDataFrame([("m3",)], "key string")
    assert [r["key"] for r in delivery.undelivered(rows, sent, members).collect()] == ["c"]


def test_training_is_skipped_when_nothing_changed(spark):
    samples = spark.createDataFrame([("g", 3, 40), ("g", 1, 40), ("z", 3, 29)], "audience string, horizon int, n int")
    models = spark.createDataFrame([("g", 3, 40, ["a"]), ("g", 1, 39, ["a"])], "audience string, horizon int, samples int, features array<string>")
    due = lookups.due_for_training(samples, models, ["a"])
    assert [(r["audience"], r["horizon"]) for r in due.collect()] == [("g", 1)]
    assert lookups.due_for_training(samples, models, ["b"]).count() == 2


def test_a_model_of_other_features_predicts_nothing(spark):
    models = spark.createDataFrame([("g", 3, 40, 1.0, ["x"], [1.0]), ("z", 3, 40, 0.0, ["a"], [1.0])], "audience string, horizon int, samples int, scale double, features array<string>, coefficients array<double>")
    got = {r["audience"]: r for r in lookups.audience_scores(spark.range(1).select(F.lit(1.0).alias("a")), models, ["a"]).collect()}
    assert got["g"]["predicted"] is None and got["g"]["training_samples"] == 0 and got["z"]["priority"] == 100.0
