import random

import pytest

#: Names that operators use inside or give out: extra columns may have them.
CLASH = "n_tokens score fp blob bucket after run key rank block z component_id digest held_out words text2 next ids".split()


def odd_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = "the and password=abcdefgh12 thou é 😀 <|endoftext|> ing's 12 AKIAABCDEFGH1234 0123456789abcdef0123456789abcdef idiot \n \t \0 x".split(" ")
    return ["" if k % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for k in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and texts, and clashing extra columns."""
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, " "), (103, texts[5]), (103, texts[5]), (None, texts[7]), (None, None)]
    rows += [(104, "long words here, " * 4000), (105, "z" * 30_000), (106, "á Ᲊ Σ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASH])
    return df, rows


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")
