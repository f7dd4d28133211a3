import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.sources import documents, remote


def test_calls_are_repeated_after_growing_pauses(monkeypatch):
    pauses, tries = [], []
    monkeypatch.setattr(remote.time, "sleep", pauses.append)

    def fails(*a):
        tries.append(a)
        raise ValueError(len(tries))

    with pytest.raises(ValueError, match="3"):
        remote.called(fails, 1, 2)
    assert tries == [(1, 2)] * 3 and pauses == [1.0, 2.0]
    assert remote.called(lambda: 7) == 7


def test_answers_are_checked():
    assert remote.checked({"response": [1]}) == [1]
    for bad, said in (([1], "object"), ({"error": {"error_msg": "limit"}}, "limit"), ({"error": 5}, "5")):
        with pytest.raises(RuntimeError, match=said):
            remote.checked(bad)


def test_remote_rows(spark):
    remote.register(spark)

    def rows(*requests):
        df = spark.read.format("newsloom_remote").option("call", "json:loads").option("requests", json.dumps(requests))
        return df.option("rows", "`group` string, id long").option("pause", "0").load()

    asked = ('[{"group": "a", "id": 1, "more": 0}, {"group": "a"}]', "[]", '[{"group": "b", "id": 2}]')
    assert rows(*asked).rdd.getNumPartitions() == 3  # a request is a task
    assert sorted(map(tuple, rows(*asked).collect()), key=str) == [("a", 1), ("a", None), ("b", 2)]
    with pytest.raises(Exception, match="JSONDecodeError"):
        rows("[").collect()


def test_tables_are_replaced_by_renaming(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for n in (3, 2):
        documents.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        documents.replace(broken, path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "table").rename(tmp_path / "table.old")  # as a failure between the renames leaves it
    documents.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "table.old").exists()


def test_documents_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/state/doc.json"
    assert documents.read_document(spark, path) is None
    for text in ('{"a": 1}', "ё\n"):
        documents.write_document(spark, path, text)
        assert documents.read_document(spark, path) == text
    assert [p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")] == ["doc.json"]


def test_log_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(2):
        documents.append_lines(spark.range(1), path, F.lit("2024-01-01 00:00:00"), F.lit(f"line {k}"))
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == [f"[2024-01-01 00:00:00] line {k}" for k in range(2)]


def test_create_or_update():
    class Store:
        def __init__(self, conflicts=0):
            self.held, self.conflicts = {}, conflicts

        def get(self, path):
            return self.held.get(path)

        def put(self, path, content, version):
            if self.conflicts:
                self.conflicts -= 1
                self.held[path] = ("other", "theirs")
            if (self.held.get(path) or (None,))[0] != version:
                raise documents.Conflict
            self.held[path] = (f"v{content}", content)

    store = Store()
    assert documents.create_or_update(store, "p", "a") and not documents.create_or_update(store, "p", "b")
    assert store.held["p"] == ("vb", "b")
    assert not documents.create_or_update(Store(conflicts=1), "p", "a")

    class Busy(Store):
        def put(self, path, content, version):
            raise documents.Conflict

    with pytest.raises(documents.Conflict):
        documents.create_or_update(Busy(), "p", "a")


def test_config_of(spark):
    values = ['{"a": "1", "b": 2}', "[1]", "oops", None, "{", " {}"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = dict(df.select("k", documents.config_of(F.col("v"))).collect())
    assert got == {0: {"a": "1", "b": "2"}, 1: {}, 2: {}, 3: {}, 4: {}, 5: {}}


def test_casefold_and_console(spark):
    values = ["Straße ﬁn ΣΑΣ ſ", "Ёлка", "plain", "", "İ", "ᾳ ŉ ǰ", "😀 é я\x07"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = {r["k"]: r for r in df.select("k", X.casefold(F.col("v")).alias("f"), X.console_safe(F.col("v")).alias("c")).collect()}
    for k, v in enumerate(values):
        assert got[k]["f"] == v.casefold()
        assert got[k]["c"] == v.encode("ascii", "backslashreplace").decode()
