import hashlib
import math

import numpy as np
import pytest

from newsloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, size string, steps string, error int"


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")


def expected(rows):
    """In Python's whole numbers, all distances of all entries."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = lambda x: max(-codes.FURTHEST, min(codes.FURTHEST, math.floor(float(np.float32(x)) * 4096)))
    kept = [(i, [whole(x) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // 8
    parts = [[tuple(v[p * width : (p + 1) * width]) for p in range(8)] for _, v, _ in kept]
    books = [[v[p] for v in parts[:16]] for p in range(8)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            near = [best(v[p], books[p])[1] for v in parts]
            for e in range(len(books[p])):
                own = [v[p] for v, k in zip(parts, near) if k == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [[best(v[p], books[p]) for p in range(8)] for v in parts]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    rows = [(i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(kept, found, errors)]
    return sorted(rows, key=repr)


def check(spark, tmp_path, rows):
    write(spark, tmp_path, rows)
    found = codes.op11_codes(spark, str(tmp_path)).collect()
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == expected(rows)


def test_by_all_distances(spark, tmp_path):
    """Ties, repeated vectors and ids, null ids and labels, what is dropped, and very large values."""
    rng = np.random.default_rng(3)
    rows = [(int(k) * 3 % 1009, [float(np.float32(x)) for x in v], int(k) % 4 or None) for k, v in enumerate(rng.normal(0, 1, (300, 16)))]
    coarse = rng.integers(-1, 2, (200, 16)) / 2
    rows += [(2000 + k, v.tolist(), 9) for k, v in enumerate(coarse)]
    rows += [(1, [0.25] * 16, 1)] * 60 + [(None, [0.5] * 16, None), (None, [0.25] * 16, 2)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [None] + [0.0] * 15, 1), (9003, [math.nan] * 16, 1), (9004, [math.inf] * 16, 1), (9005, [1.0] * 8, 1)]
    rows += [(9100, [3e38] * 8 + [-3e38] * 8, 5), (9101, [8191.5, -8191.5] * 8, 5)]
    check(spark, tmp_path, rows)


def test_few_vectors(spark, tmp_path):
    check(spark, tmp_path, [(k, [k / 3.0] * 8, 0) for k in range(5)])


def test_none_and_parts(spark, tmp_path):
    write(spark, tmp_path / "a", [(1, None, 1)])
    assert codes.op11_codes(spark, str(tmp_path / "a")).count() == 0
    write(spark, tmp_path / "b", [(1, [1.0] * 9, 1)])
    with pytest.raises(ValueError, match="equal parts"):
        codes.op11_codes(spark, str(tmp_path / "b"))


@pytest.mark.parametrize("far", [3, 5000, 1 << 25])
def test_the_nearest_entry_whatever_float32_rounds(far):
    rng = np.random.default_rng(far)
    for width in (1, 8, 96):
        book = rng.integers(-far, far + 1, (16, width))
        book[5] = book[3]
        book[9] = book[8] + 1
        rows = np.r_[rng.integers(-far, far + 1, (500, width)), book, (book[:1] + book[1:2]) // 2]
        exact = ((rows[:, None, :] - book[None]) ** 2).sum(2)
        best, distance = codes.nearest(rows, book)
        assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_codes_stand_for_entries(spark):
    df = spark.createDataFrame([(k, [float(k % 5)] * 8, 0) for k in range(50)], "vec_id long, embedding array<float>, label int")
    found, books = codes.compressed(df)
    back = {r["id"]: r["vector"] for r in codes.decoded(found, books).collect()}
    assert all(back[k] == [float(k % 5)] * 8 for k in range(50))
