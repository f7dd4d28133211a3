"""Scores of topics whose values lie at a half, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.functions import metrics as M
from newsloom.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A user for each number, with one event that carries no counter: the hook alone makes the score."""
    folder = tmp_path_factory.mktemp("halves")
    duckdb.sql(f"""COPY (SELECT k AS event_id, TIMESTAMP '2024-01-30 23:00:00' AS ts, k AS user_id, 'error' AS event_type,
      0.0::DOUBLE AS value, '{{}}' AS props FROM range(1, 400) t(k)) TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["analyser_scores", "topics_by_score"])
def test_halves(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    answer = con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    got = QUERIES[name](spark, tables).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(answer.fetchall())


def test_rounding_goes_by_the_scaled_value(spark):
    values = [0.35 * 11, 2.5, -0.25, 0.35 * 3, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(M.rounded(F.col("v"), 1)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 1)", [v]).fetchall()[0][0] for v in values]
