import random

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.packs import CITY


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()[0]


def test_norm_collapses_unicode_space(spark):
    assert one(spark, X.norm(F.col("t")), "  Пожар в \n ОМСКЕ ") == "пожар в омске"
    assert one(spark, X.norm(F.col("t")), None) is None
    assert one(spark, X.norm(F.col("t")), "") == ""


def test_patterns_match_cyrillic_words(spark):
    found = X.matches_any(F.col("t"), (r"\bпогиб\w+",))
    assert one(spark, found, "ПОГИБЛИ люди") and not one(spark, found, "непогибли")


def test_utf16(spark):
    assert one(spark, X.utf16_units(F.col("t")), "a😀é") == 4
    for units, want in ((0, ""), (1, "a"), (2, "a"), (3, "a😀"), (4, "a😀é"), (9, "a😀é")):
        assert one(spark, X.utf16_truncated(F.col("t"), units), "a😀é") == want


def test_first_line_and_sentence(spark):
    assert one(spark, X.first_line(F.col("t")), "\n  \r первая  вторая") == "первая"
    assert one(spark, X.first_line(F.col("t")), None) == ""
    assert one(spark, X.first_sentence(F.col("t")), "Пожар!  Погиб человек.") == "Пожар!"
    assert one(spark, X.first_sentence(F.col("t")), "ы" * 400) == "ы" * 320 + "…"
    assert one(spark, X.first_sentence(F.col("t")), "коротко") == "коротко"


def test_rejection_title(spark):
    assert one(spark, X.rejection_title(F.col("t")), "Одно. Два.") == "Одно."
    assert one(spark, X.rejection_title(F.col("t")), "Одно.") == "Одно."
    assert one(spark, X.rejection_title(F.col("t")), " ") == "Без заголовка"
    assert one(spark, X.rejection_title(F.col("t")), "я" * 300) == "я" * 240


def test_clean_drops_emoji(spark):
    assert one(spark, X.clean(F.col("t")), "🔥 Пожар ⚠️ в  городе") == "Пожар в городе"


def test_shown_source(spark):
    assert one(spark, X.shown_source(F.col("t")), "НОВОСТИ ОМСКА ТВ") == "Новости Омска ТВ"
    assert one(spark, X.shown_source(F.col("t")), "Новости") == "Новости"
    assert one(spark, X.shown_source(F.col("t")), "") == "Источник"


def test_story_terms_take_the_longest_suffix(spark):
    suffixes = sorted(CITY.suffixes, key=len, reverse=True)

    def plain(word):
        for s in suffixes:
            if word.endswith(s) and len(word) - len(s) >= 4:
                return word[: -len(s)]
        return word

    rng = random.Random(1)
    words = ["".join(rng.choice("авеиймстьюя") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    want = {s for s in map(plain, words) if len(s) >= 4 and s not in CITY.stopwords}
    assert set(one(spark, X.story_terms(F.col("t"), CITY), " ".join(words) + " 12345")) == want


def test_jaccard_of_empty_sets_is_null(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, X.jaccard(empty, empty), "x") is None
    assert one(spark, X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), "x") == 0.5
