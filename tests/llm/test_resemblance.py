import random

import corpus_pipeline
from newsloom.llm import resemblance


def sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def classes(rows):
    """Least id of each row's component at a similarity of 0.8 or more, by all pairs."""
    found = [(i, sets(t or "")) for i, t in rows]
    up = list(range(len(rows)))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for k, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:k]):
            if top(k) != top(j) and 9 * len(a & b) >= 4 * (len(a) + len(b)) and bool(a) == bool(b):
                up[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [least.get(top(k)) for k in range(len(rows))]


def near_copies():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(12)]
    out = []
    for _ in range(25):
        text = [word() for _ in range(rng.choice([3, 6, 30, 100, 300]))] + line * rng.randint(0, 2)
        for _ in range(rng.randint(1, 5)):
            out.append(" ".join(text))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    hub = [word() for _ in range(200)]
    for _ in range(60):  # more than a key pairs outright
        own = list(hub)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(200)] = word()
        out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_by_all_pairs(spark, monkeypatch):
    rows = near_copies() + [(900, None), (901, ""), (902, " "), (None, "a b"), (None, "a  B"), (903, "A b c"), (903, "A b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(zip([i for i, _ in rows], classes(rows), strict=True), key=str)
    assert len({c for _, c in want}) < len(rows) - 60
    assert sorted(map(tuple, resemblance.near_duplicates(df).collect()), key=str) == want
    monkeypatch.setattr(resemblance, "COMMON", 10**9)  # no shingle counts as common
    assert sorted(map(tuple, resemblance.near_duplicates(df).collect()), key=str) == want
    monkeypatch.setattr(resemblance, "CROWD", 2)  # most keys are crowded
    monkeypatch.setattr(resemblance, "BLOCK", 500)
    monkeypatch.setattr(resemblance, "GROUP", 20)
    assert sorted(map(tuple, resemblance.near_duplicates(df).collect()), key=str) == want


def test_quoted_passages_bring_no_pairs(spark, monkeypatch):
    """Unlike texts of many sizes that quote one passage, near copies of some of them, and texts
    that differ in size as much as alike ones may."""
    rng = random.Random(12)
    monkeypatch.setattr(resemblance, "COMMON", 10**9)
    word = lambda: f"w{rng.randrange(10**5)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(150):
        text = [word() for _ in range(rng.randint(20, 400))] + passage
        rows.append(" ".join(text))
        if rng.random() < 0.3:
            text[rng.randrange(10)] = word()
            rows.append(" ".join(text))
        if rng.random() < 0.3:
            rows.append(" ".join(text + [word() for _ in range(rng.randint(0, len(text) // 3))]))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(zip([i for i, _ in rows], classes(rows), strict=True))
    made = []
    own = resemblance.promising
    monkeypatch.setattr(resemblance, "promising", lambda pairs, *a: made.append(pairs.count()) or own(pairs, *a))
    for crowd in (24, 3):
        monkeypatch.setattr(resemblance, "CROWD", crowd)
        assert sorted(map(tuple, resemblance.near_duplicates(df).collect())) == want
    assert max(made) < len(rows) * 5


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(10, 290, 20), 3):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * k for k in range(40)]
