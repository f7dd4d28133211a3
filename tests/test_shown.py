from pyspark.sql import functions as F

from newsloom.functions.packs import CITY
from newsloom.operators import diagnostics


def test_lists_of_the_diagnostics(spark):
    rows = [("Над городом  БПЛА", None), (None, ["Самые\n свежие новости"]), ("дом", ["сад", None])]
    df = spark.createDataFrame(rows, "title string, texts array<string>")
    text = diagnostics.shown_text(F.array("title"), F.coalesce("texts", F.array().cast("array<string>")))
    excluded, promo = diagnostics.shown(text, CITY)
    zero = [F.lit(1000.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    found = df.select(text.alias("t"), diagnostics.warnings(F.lit(1.0), *zero, excluded, promo).alias("w")).collect()
    assert [r["w"] for r in found] == [["EXCLUDED_TOPIC"], ["PROMO"], []] and found[2]["t"] == "дом сад"


def test_first_number_with_the_prediction_behind(spark):
    rows = ['{"priority_score": 3, "score": 5}', '{"priority_score": "3", "score": 5.5}', '{"prediction": {"priority_score": 7}, "score": 1}', '{"score": true}', "{}"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, r string").withColumn("v", F.parse_json("r"))
    found = df.orderBy("k").select(diagnostics.metric(F.col("v"), "priority_score", "score").alias("m")).collect()
    assert [r["m"] for r in found] == [3.0, 5.5, 7.0, 1.0, None]
