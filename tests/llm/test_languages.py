import random
import zlib

import numpy as np
import pytest

from newsloom.llm import languages


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = {"en": "the and ing that wh ly sh".split(), "de": "sch der und ich lich ö ü".split(), "ru": "про ста ый ение на".split()}
    out = []
    for k in range(n):
        lang = rng.choice(sorted(parts))
        out.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    return languages.fit(spark.createDataFrame(texts(600), "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark, fitted):
    rows = texts(900, seed=2)
    got = {r["doc_id"]: r for r in fitted.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows) >= 890
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= got[k]["score"] <= 1 for k, _, _ in rows)
    assert 0 < (fitted.weights != 0).mean() < 0.5


def test_odd_rows(spark, fitted, odd, none):
    df, rows = odd
    got = fitted.predict(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[k]["lang_pred"] for k in (100, 101, 102)} == {"und"} and by_id[105]["lang_pred"] != "und"
    assert fitted.predict(none).count() == 0


def test_only_learnable_rows_count(spark):
    """Held-out languages, and lang where it is null, change nothing."""
    rows = texts(200)
    hidden = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows] + [(None, None, "yy"), (5000, "abc", None)]
    shape = "doc_id long, text string, lang string"
    a, b = (languages.fit(spark.createDataFrame(r, shape)) for r in (rows, hidden))
    assert a.languages == b.languages[: len(a.languages)] and "xx" not in b.languages
    assert np.allclose(a.weights, b.weights[:, : len(a.languages)])


def test_no_model(spark, none):
    df = none.selectExpr("doc_id", "text", "extra as lang")
    model = languages.fit(df)
    got = model.predict(spark.createDataFrame([(1, "some words")], "doc_id long, text string")).first()
    assert model.languages == [] and (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_n_grams_of_whole_texts(monkeypatch):
    """Pieces change nothing; case, digits and marks don't either; every n-gram counts."""
    text = "Größe, 12 der Straße! " * 50
    whole = languages.counts(text)
    normal = " größe der straße" * 50 + " "
    assert whole.sum() == sum(len(normal) - n + 1 for n in (2, 3)) + sum(c != " " for c in normal)
    monkeypatch.setattr(languages, "PIECE", 7)
    assert (languages.counts(text) == whole).all() and (languages.counts(text.upper().replace("SS", "ß")) == whole).all()
    assert languages.counts("12 !? \n") is None and languages.counts(None) is None


def test_the_leader_by_its_definition():
    """A few steps, feature by feature, in plain Python."""
    import math

    leader = languages.Leader.new(2)
    z, n = {}, {}
    rng = random.Random(4)
    for _ in range(30):
        at = sorted(rng.sample(range(6), 3))
        x = [rng.random() for _ in at]
        y = rng.randrange(2)
        leader.learn(np.array(at), np.array(x), y)
        active = [*zip(at, x), (1 << languages.BITS, 1.0)]
        w = {}
        for f, _ in active:
            for k in range(2):
                s = z.get((f, k), 0.0)
                small = abs(s) <= languages.LASSO
                w[f, k] = 0.0 if small else -(s - math.copysign(languages.LASSO, s)) / ((languages.BETA + math.sqrt(n.get((f, k), 0.0))) / languages.ALPHA + languages.RIDGE)
        logits = [sum(v * w[f, k] for f, v in active) for k in range(2)]
        total = sum(map(math.exp, logits))
        for f, v in active:
            for k in range(2):
                g = (math.exp(logits[k]) / total - (k == y)) * v
                old = n.get((f, k), 0.0)
                z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / languages.ALPHA * w[f, k]
                n[f, k] = old + g * g
    assert all(abs(leader.z[f, k] - v) < 1e-9 for (f, k), v in z.items())


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, (4000, 3))
    p = languages.softmax(logits)
    y = np.array([rng.choice(3, p=v) for v in p])
    assert abs(languages.tempered(logits * 4, y) - 4) < 0.5
