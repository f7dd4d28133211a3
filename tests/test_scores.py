import math

import pytest
from pyspark.sql import functions as F

from newsloom.functions import metrics as M
from newsloom.functions.packs import CITY
from newsloom.operators import classify as C
from newsloom.operators import diagnostics, topics

NOW = 1_700_000_000
SHAPE = "topic long, source string, timestamp long, views long, likes long, comments long, reposts long"


def score(spark, rows, locality=30.0, impact=20.0):
    stats = topics.stats(spark.createDataFrame(rows, SHAPE), "topic")
    parts = topics.components(topics.age_minutes(F.lit(NOW)), F.lit(locality), F.lit(impact))
    out = stats.select("topic", M.weighted_mean(parts).alias("score"), *[v.alias(n) for n, v in parts.items()])
    return {r["topic"]: r.asDict() for r in out.collect()}


def post(topic=1, source="a", age=5, views=1000, likes=35, comments=8, reposts=5):
    return (topic, source, NOW - 60 * age, views, likes, comments, reposts)


def test_newer_ranks_above_older(spark):
    got = score(spark, [post(1, age=5), post(2, age=60), post(3, age=500)])
    assert got[1]["score"] > got[2]["score"] > got[3]["score"] and got[3]["freshness"] == 0


def test_missing_counters_are_not_zero(spark):
    got = score(spark, [post(1, views=None, likes=None, comments=None, reposts=None), post(2, likes=0, comments=0, reposts=0)])
    assert all(got[1][n] is None for n in ("reach", "engagement", "discussion", "reshare", "velocity"))
    assert got[2]["engagement"] == 0.0 and got[2]["reach"] > 0
    known = {"freshness": 100 * (1 - 5 / 180), "local_relevance": 30, "event_impact": 20, "cross_source_spread": 0}
    weights = sum(M.WEIGHTS[n] for n in known)
    assert got[1]["score"] == pytest.approx(sum(M.WEIGHTS[n] * v for n, v in known.items()) / weights)


def test_zero_views_count_as_unmeasured(spark):
    assert score(spark, [post(views=0)])[1]["reach"] is None


def test_spread_raises_the_score(spark):
    rows = [post(1, s) for s in "aaa"] + [post(2, s) for s in "abc"]
    got = score(spark, rows)
    assert got[2]["cross_source_spread"] == pytest.approx(100 * (1 - math.exp(-1))) and got[1]["cross_source_spread"] == 0
    assert got[2]["score"] > got[1]["score"]


def test_no_source_has_no_spread(spark):
    assert score(spark, [post(source="  ")])[1]["cross_source_spread"] is None


def test_labels_and_actions_at_the_thresholds(spark):
    rows = spark.createDataFrame([(44.9,), (45.0,), (69.9,), (70.0,)], "s double")
    got = rows.select(M.priority(F.col("s")).alias("l"), topics.action(F.col("s"))["status"].alias("a")).collect()
    assert [tuple(r) for r in got] == [("low", "reject"), ("medium", "take_now"), ("medium", "take_now"), ("high", "take_now")]


def test_clamp_keeps_null(spark):
    assert spark.range(1).select(M.clamp(F.lit(None).cast("double")).alias("x")).first()[0] is None


@pytest.mark.parametrize(
    "flags, want",
    [
        ({"score": 70}, "take_now"),
        ({"score": 20}, "reject"),
        ({"score": 99, "help_only": True}, "reject"),
        ({"score": 10, "viral_complaint": True, "complaint_only": True}, "take_now"),
        ({"score": 99, "nonlocal_only": True}, "reject"),
        ({"score": 10, "confidence": 25, "viral": 60}, "take_now"),
        ({"score": 99, "excluded_only": True, "viral_complaint": True}, "reject"),
    ],
)
def test_editorial_status(spark, flags, want):
    assert spark.range(1).select(C.editorial_status(**flags)["status"].alias("x")).first()[0] == want


def classified(spark, text, source="группа", kind=None):
    df = spark.createDataFrame([(text, source, kind)], "text string, source string, kind string")
    return C.classify(df, CITY, kind="kind").first()


def test_content_types(spark):
    says = lambda *a, **k: classified(spark, *a, **k)["content_type"]
    assert says("Прокуратура сообщила о проверке школы") == "news"
    assert says("Над городом беспилотник") == "excluded_topic"
    assert says("Скидки и промокоды каждому") == "advertising"
    assert says("Какой позор") == "opinion"
    assert says("Просьба откликнуться очевидцев") == "help_request"
    assert says("Просьба откликнуться очевидцев, в ДТП погиб человек") == "news"
    assert says("В Екатеринбурге открыли парк") == "nonlocal"
    assert says("Жители жалуются: льётся вода") == "complaint"
    assert says("Красивый закат") == "social_story"
    assert says(None) == "social_story" and says("") == "social_story"


def test_confidence_and_source_kind(spark):
    official = classified(spark, "МЧС предупредил о морозе")
    assert official["confidence"] == 90 and official["source_kind"] == "official_attribution"
    media = classified(spark, "Красивый закат", kind="regional_media")
    assert media["confidence"] == 65 and media["source_kind"] == "regional_media"
    assert classified(spark, "МЧС сообщил: в Иркутске мороз")["confidence"] == 10


def test_fatal_incidents_come_first(spark):
    def kind(text):
        rows = spark.createDataFrame([(text,)], "t string")
        return tuple(rows.select(C.event_class(F.col("t"), CITY).alias("x")).first()[0])

    assert kind("погиб мужчина при пожаре") == ("fatal_incident", 100.0)
    assert kind("угроза взрыва") == ("public_safety", 85.0)
    assert kind("памяти погибших") == ("general", 20.0)


def test_caps(spark):
    rows = spark.createDataFrame([("интервью с хоккеистом",), ("состоится концерт",), ("пожар",)], "t string")
    got = [r[0] for r in rows.select(C.capped(F.lit(90.0), F.col("t"), CITY)).collect()]
    assert got == [40.0, 42.0, 90.0]


def test_distribution_of_no_rows(spark):
    row = diagnostics.distribution(spark.createDataFrame([], "s double"), "s").first()
    assert row["n"] == 0 and row["mean"] is None and row["saturation"] == "ok"


def test_percentiles_interpolate(spark):
    row = diagnostics.distribution(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "s double"), "s").first()
    assert row["p90"] == pytest.approx(7.9)
