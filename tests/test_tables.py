import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.packs import CITY
from newsloom.operators import model, posts, rank, registry, tracker
from newsloom.sources import documents, feeds


def test_checkpoint_windows(spark):
    observed = spark.createDataFrame([("o", "north", [123], 10_000), ("p", "north", [123, 456], 10_000)], "observation_id string, audience string, member_ids array<long>, predicted_at long")

    def state(at, now):
        snaps = spark.createDataFrame([("north", 123, at, 100, 10, 2, 1)], "audience string, post_id long, snap_ts long, views long, likes long, comments long, reposts long")
        rows = tracker.checkpoints(observed, snaps, F.lit(now)).collect()
        return {(r["observation_id"], r["hours"]): (r["state"], r["score"]) for r in rows}

    got = state(13_600, 13_600)
    assert got["o", 1] == ("completed", pytest.approx(0.18)) and got["o", 3] == ("pending", None)
    assert got["p", 1] == ("pending", None)  # one of its two posts is missing
    assert state(14_200, 14_200)["o", 1][0] == "completed"
    assert state(14_201, 14_201)["o", 1][0] == "missed"
    assert state(13_599, 13_599)["o", 1][0] == "pending"


def test_first_complete_snapshot_counts(spark):
    observed = spark.createDataFrame([("o", "a", [1], 0)], "observation_id string, audience string, member_ids array<long>, predicted_at long")
    snaps = spark.createDataFrame([("a", 1, t, v, 0, 0, 0) for t, v in ((3700, 7), (3650, 5), (4300, 9))], "audience string, post_id long, snap_ts long, views long, likes long, comments long, reposts long")
    row = tracker.checkpoints(observed, snaps, F.lit(9999)).where("hours = 1").first()
    assert (row["measured_at"], row["views"]) == (3650, 5)


def test_bootstrap_emits_nothing(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 1, 1), ("a", 3, 1), ("b", 3, 1)]
    got = tracker.first_seen(spark.createDataFrame(rows, "audience string, post long, poll long"), "audience", "post", "poll")
    assert [tuple(r) for r in got.collect()] == [("a", 3, 1)]


def test_observation_id_is_of_sorted_distinct_ids(spark):
    from hashlib import sha256

    row = spark.range(1).select(tracker.observation_id(F.lit("north"), F.array(F.lit(2), F.lit(1), F.lit(2)))).first()
    assert row[0] == sha256(b"north|[1,2]").hexdigest()


def test_stored_leaves_known_ids(spark):
    old = spark.createDataFrame([("x", 1)], "observation_id string, n long")
    new = spark.createDataFrame([("x", 2), ("y", 3), ("y", 3)], "observation_id string, n long")
    assert sorted(map(tuple, tracker.stored(old, new).collect())) == [("x", 1), ("y", 3)]


def test_registry_transitions(spark):
    shape = "pos long, title string, status string, category string, url string, story string"
    old = spark.createDataFrame([(1, "Пожар", "published", "", "u1", "s"), (2, "Мост", "rejected", "", "u2", "s")], shape)
    new = spark.createDataFrame([(1, "x", "rejected", "", "u1", ""), (2, " МОСТ ", "published", "К", "", ""), (3, "Новое", "published", "", "", "")], shape)
    got = {r["title"]: r for r in registry.upsert(old, new).collect()}
    assert got["Пожар"]["status"] == "published" and got["Пожар"]["change"] == "refused"
    assert got["Мост"]["status"] == "published" and got["Мост"]["category"] == "К" and got["Мост"]["url"] == "u2"
    assert got["Новое"]["change"] == "inserted" and len(got) == 3


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(60), rng.random((60, 2))]
    y = x @ [0.5, 1.0, -0.3] + 0.01 * rng.random(60)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "intercept double, a double, b double, y double")
    fitted = model.fit(df, ["intercept", "a", "b"], "y")
    want = np.linalg.solve(x.T @ x + np.diag([0, 0.1, 0.1]), x.T @ y)
    assert np.allclose(fitted.coefficients, want)
    assert fitted.scale == pytest.approx(max(np.expm1(sorted(y)[int(0.9 * 60)]), 1e-6))
    assert model.fit(df.limit(29), ["intercept", "a", "b"], "y") is None


def test_spearman_of_a_constant_or_single_row(spark):
    rows = spark.createDataFrame([(1, 5.0, 1.0)], "id long, a double, b double")
    assert model.spearman(rows, "a", "b", "id").first()["spearman"] is None
    rows = spark.createDataFrame([(i, float(i), float(-i)) for i in range(5)], "id long, a double, b double")
    assert model.spearman(rows, "a", "b", "id").first()["spearman"] == pytest.approx(-1.0)


def test_features_use_the_utc_hour(spark):
    made = model.features(F.lit("ДТП и мэр"), F.lit(3600 * 30), CITY)
    row = spark.range(1).select(*[v.alias(n) for n, v in made.items()]).first().asDict()
    assert row["topic_incident"] == 1 and row["topic_public_decision"] == 1 and row["topic_culture"] == 0
    assert row["hour_cos"] == pytest.approx(0, abs=1e-9) and len(row) == 12


def test_strongest_model(spark):
    def of(g, ng, z, nz):
        rows = spark.createDataFrame([(g, ng, z, nz)], "g double, ng long, z double, nz long")
        found = rows.select(rank.strongest({"Г": (F.col("g"), F.col("ng")), "Ж": (F.col("z"), F.col("nz"))}).alias("m")).first()["m"]
        return found and tuple(found)

    assert of(50.0, 30, 60.0, 29) == (50.0, "Г") and of(50.0, 30, 60.0, 30) == (60.0, "Ж")
    assert of(50.0, 30, 50.04, 30) == (50.04, "Г/Ж") and of(None, 30, 1.0, 3) is None


def test_in_batch_a_dropped_topic_drops_none(spark):
    shape = "rank int, topic_key string, member_keys array<string>, title_terms array<string>, story_terms array<string>"
    rows = [(1, "a", ["m1"], [], []), (2, "a", ["m2"], [], []), (3, "b", ["m2"], [], []), (4, "c", ["m1"], [], []), (5, "", ["m9"], [], [])]
    got = rank.fresh_in_batch(spark.createDataFrame(rows, shape))
    assert [r["rank"] for r in got.orderBy("rank").collect()] == [1, 3]


def test_legacy_fields_go_at_any_depth(spark):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(
        {"verification_required": True, "publication_mode": "verification_required", "text": "t",
         "members": [{"text": "m", "publish_disclaimer_required": True, "post": {"views": 3, "disclaimer_required": True}}]}
    )]))
    row = posts.without_legacy(df).first().asDict(recursive=True)
    assert row == {"publication_mode": None, "text": "t", "members": [{"text": "m", "post": {"views": 3}}]}


def test_civil_day_is_half_open(spark):
    start = 1_704_218_400  # 2024-01-03 00:00 at UTC+6
    rows = spark.createDataFrame([(t,) for t in (None, 0, start - 1, start, start + 86_399, start + 86_400)], "timestamp long")
    assert [r[0] for r in posts.of_day(rows, "2024-01-03").collect()] == [start, start + 86_399]


def test_feeds(spark):
    rss = """<rss xmlns:dc="d"><channel><item><title>Пожар</title><link>http://a/1</link><description> в
      доме </description><pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate></item>
      <item><title>без даты</title><link>http://a/2</link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Мост</title><link href="http://b/1"/>
      <summary>открыт</summary><updated>2024-01-03T16:00:00+06:00</updated></entry></feed>"""
    rows = [("http://a/rss", None, rss), ("http://b/atom", "Б", atom), ("http://c", None, "<broken"), ("http://d", None, None)]
    got = {r["url"]: r for r in feeds.from_feeds(spark.createDataFrame(rows, "url string, name string, body string")).collect()}
    assert set(got) == {"http://a/1", "http://b/1"}
    assert got["http://a/1"]["text"] == "Пожар в доме" and got["http://a/1"]["source"] == "rss_a"
    assert got["http://a/1"]["timestamp"] == got["http://b/1"]["timestamp"] == 1_704_276_000
    assert got["http://b/1"]["date"] == "2024-01-03 16:00:00" and got["http://b/1"]["source_name"] == "Б"
    assert got["http://a/1"]["views"] is None


def test_channels_and_messages(spark):
    names = spark.createDataFrame([("@news", "Новости"), ("-100555", None), ("b d", "x")], "channel string, name string")
    rows = [("@news", 1, 1_704_276_000, " текст ", "photo"), ("@news", 2, 1, " ", None), ("-100555", 3, 1, "а", None), ("b d", 4, 1, "а", None)]
    got = feeds.from_channels(spark.createDataFrame(rows, "channel string, id long, timestamp long, message string, media_type string"), names)
    assert {(r["source"], r["url"], r["source_name"]) for r in got.collect()} == {
        ("tg_news", "https://t.me/news/1", "Новости"), ("tg_555", "https://t.me/c/555/3", "-100555")
    }


def test_json_documents(spark, tmp_path):
    from pyspark.sql.types import LongType, StructType

    for name, value in (("a", [{"id": 1}]), ("b", {"items": [{"id": 2}]}), ("c", {"other": []}), ("d", {"posts": [{"id": 3}], "data": [{"id": 4}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    rows = documents.rows_of(spark, str(tmp_path), StructType().add("id", LongType()))
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3]


def test_wall_posts_and_media(spark):
    raw = spark.createDataFrame([(7, 1_704_276_000, "т", -5, (3,), None, None, None)], "id long, date long, text string, owner_id long, views struct<count:long>, likes struct<count:long>, comments struct<count:long>, reposts struct<count:long>")
    other, own = posts.from_wall(raw, F.lit("g")).first(), posts.from_wall(raw, F.lit("g"), owned=True).first()
    assert other["views"] is None and own["views"] == 3 and own["likes"] == 0 and own["url"] == "https://vk.ru/wall-5_7"
    kind = lambda *a: spark.range(1).select(posts.media_type(*[F.lit(x) for x in a])).first()[0]
    assert kind(True, "", False, False, True) == "photo" and kind(False, "video/mp4", True, False, True) == "video"
    assert kind(False, "x/y", True, False, True) == "document" and kind(False, "", False, False, False) is None


def test_envelopes(spark):
    rows = ['{"response": {"id": 1}}', '{"error": {"error_msg": "no access"}}', '{"error": "text"}', '{"other": 1}', "[1]", None]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = [tuple(r["e"]) for r in df.select(documents.envelope(F.col("v"), "struct<id: long>").alias("e")).collect()]
    assert got == [((1,), None), (None, "no access"), (None, "text"), (None, "no response"), (None, "not an object"), (None, "not an object")]


def test_registry_files_round_trip(spark):
    df = spark.createDataFrame([([("a", "published"), ("b", "draft")],)], "topics array<struct<title: string, status: string>>")
    sent = df.select(documents.encoded("topics").alias("content"))
    rows = sent.select(F.explode(documents.records_of(F.col("content"), "struct<title: string, status: string>")).alias("r")).select("r.*")
    assert [tuple(r) for r in registry.decided(rows).collect()] == [("a", "published")]
