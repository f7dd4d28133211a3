import random

from pyspark.sql import functions as F

from newsloom.functions import order


def test_values_at_places(spark):
    """Ties, one value alone, both infinities, far values and neighbours, NaN and null."""
    rng = random.Random(9)
    near = [1.0, 1.0000000000000002, 1.0000000000000004]
    cases = [
        [5.0] * 9,
        [rng.gauss(0, 1) for _ in range(500)] + [3.0] * 200,
        [1.7e308, -1.7e308, 5e-324, 0.0, float("inf"), float("-inf"), float("-inf"), *near],
    ]
    for values in cases:
        places = sorted({1, 2, len(values) // 2 + 1, len(values) - 1, len(values)})
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        assert order.values_at(df, "x", places) == [sorted(values)[p - 1] for p in places]
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    got = order.values_at(df, "x", [1, 2])
    assert got[0] == 1.0 and got[1] != got[1]
    assert order.values_at(df.where("x > 2 AND NOT isnan(x)"), "x", []) == []


def test_many_distinct_values(spark):
    """No shuffle has more rows than buckets and tasks make, however many values are distinct."""
    n = 3_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7_919, F.lit(n)) + 0.25).alias("x"))
    assert order.values_at(df, "x", [1, n // 2, n]) == [0.25, n // 2 - 1 + 0.25, n - 1 + 0.25]


def test_chains_over_ranges(spark):
    """Each position is linked to the one before it of its key, over the borders of ranges too."""
    rng = random.Random(1)
    rows = sorted({(rng.randrange(3), rng.randrange(2), rng.randrange(4000)) for _ in range(3000)})
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = {(r["p"], r["q"]) for r in order.chained(spark.createDataFrame(rows, "a long, b long, pos long"), ["a", "b"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_key = {}
    for a, b, pos in rows:
        by_key.setdefault((a, b), []).append(pos)
    want = {(p, q) for own in by_key.values() for q, p in zip(own, own[1:])}
    every = {(p, q) for own in by_key.values() for p in own for q in own if q < p}
    assert want <= found <= every
