import random
import re
from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import simhash, suffixes
from newsloom.llm.components import components


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """Least label of each value's component at two or fewer differing bits."""
    distinct = sorted(set(values.values()))
    up = {v: v for v in distinct}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(distinct):
        for b in distinct[i:]:
            if (a ^ b).bit_count() <= 2:
                up[top(b)] = top(a)
    least = {}
    for label, v in sorted(values.items()):
        least.setdefault(top(v), label)
    return {label: least[top(v)] for label, v in values.items()}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_simhash_rows(spark, odd, none):
    df, rows = odd
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    values = {i: plain_fingerprint(t or "") for i, t in rows if i is not None}
    want = classes(values)
    assert all(r["fp"] == signed(values[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.near_duplicates(none).count() == 0


def test_crowded_and_chained_fingerprints(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(100)]
    centre = rng.getrandbits(64)
    for _ in range(150):  # far more than are paired under a key
        v = centre
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    v = values[0]
    for _ in range(20):  # a chain that drifts away
        v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        values.append(v)
    labelled = dict(enumerate(values))
    rows = spark.createDataFrame([(i, signed(v)) for i, v in labelled.items()], "label long, vertex long")
    vertices = rows.groupBy("vertex").agg(F.min("label").alias("label"))
    found = components(vertices, simhash.links(vertices.select(F.col("vertex").alias("fp"))))
    got = {r["vertex"]: r["label"] for r in found.collect()}
    assert all(got[signed(labelled[i])] == c for i, c in classes(labelled).items())


def test_chain_condition_never_loses_a_near_pair(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long").withColumn("first", F.explode(F.array(*map(F.lit, range(simhash.SEGMENTS)))))
    held = df.withColumn("ok", simhash.chained("a", "b", "first")).groupBy("a", "b").agg(F.bool_or("ok").alias("ok"))
    assert held.where("not ok").count() == 0


def removed(rows):
    """By the definition: (id, bytes, removed bytes, spans, digest) of each row."""
    first, out = {}, []
    key = lambda i: suffixes.LAST if i is None else i
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], key(i))
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def pieces(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde \n") for _ in range(rng.randint(30, 200))) for _ in range(40)]
    rows = []
    for i in range(250):
        text = ""
        for _ in range(rng.randint(0, 6)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            text += b[a : rng.randint(a, len(b))] + rng.choice(["", "x", "é", "😀", "\0", " "])
        rows.append((i, text))
    rows += [(5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1] + "tail" * 20), (1000, None), (1001, "")]
    rows += [(1002, "a" * 500), (1003, "a" * 300), (1004, "\0" * 120), (1005, "\0" * 100), (1006, "ab" * 200), (1006, "ab" * 200)]
    rng.shuffle(rows)
    return rows


def test_suffix_rows_by_every_path(spark):
    rows = pieces()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows)
    for options in ({}, {"frequent": 3}, {"run": 2000, "frequent": 20}, {"direct": 1}, {"direct": 2, "run": 2000, "frequent": 3}):
        assert sorted(map(tuple, suffixes.digests(df, **options).collect()), key=str) == want


def test_suffix_odd_rows(odd, none):
    df, rows = odd
    assert sorted(map(tuple, suffixes.digests(df).collect()), key=str) == removed(rows)
    assert suffixes.digests(none).count() == 0


def test_dedup_keeps_columns_and_whole_characters(spark):
    rows = [(1, "é" * 40, "a"), (2, "x" + "é" * 40 + "y", "b"), (3, "é" * 40, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["text"], r["keep0"]) for r in suffixes.dedup(df, keep=("lang",)).collect()}
    assert got == {1: ("é" * 40, "a"), 2: ("xy", "b"), 3: ("", "c")}


def test_loser_tree_merges_in_order():
    rng = random.Random(8)
    runs, every = [], []
    for _ in range(7):
        own = sorted({bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(rng.randint(0, 40))})
        every += own
        found = suffixes.Strings(np.frombuffer(b"".join(own), np.uint8).reshape(-1, 20))
        assert [bytes(r) for r in found.rows] == own
        runs.append(found.front_coded(np.arange(len(own))))
    out = list(suffixes.Merger(runs, 20))
    assert [s for _, _, s in out] == sorted(every)
    for (_, _, a), (_, shared, b) in zip(out, out[1:]):
        assert shared == next((k for k in range(20) if a[k] != b[k]), 20)
