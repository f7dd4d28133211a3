import hashlib
import random
import zlib

import pytest

from newsloom.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(digests):
    """All levels of a tree, from the leaves to its root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    """(place in the run, siblings) of each level up to the root."""
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((i - start, level[start:i] + level[i + 1 : start + 16]))
        i //= 16
    return out


def expected(rows):
    """By the definition, as a sorted list of rows."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r, H(*[field(r[c]) for c in merkle.FIELDS])))
    ordered = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in ordered:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[s] = climbed([leaf for _, leaf in groups[s]])
    over = climbed([trees[s][-1][0] for s in ordered])
    out = []
    for place, s in enumerate(ordered):
        for i, (r, leaf) in enumerate(groups[s]):
            steps = path(trees[s], i) + path(over, place)
            cur = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = r["text"] and r["text"].translate(lower)
                cur = H(*[field(r[c]) for c in merkle.FIELDS[:-1]], field(text))
            for k, siblings in steps:
                cur = H(*siblings[:k], cur, *siblings[k:])
            proof = H(*[d for _, siblings in steps for d in siblings])
            out.append((r["doc_id"], leaf, trees[s][-1][0], over[-1][0], proof, cur, cur == over[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int, path string"


def check(spark, tmp_path, rows):
    full = [{**{c: None for c in ("source", "lang", "n_chars", "text")}, **r} for r in rows]
    data = [tuple(r[c] for c in merkle.FIELDS) + ("x", 1, "y") for r in full]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op13_merkle(spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == expected(full)
    return found


def test_by_the_definition(spark, tmp_path):
    """Groups of 1 to 5,000 leaves: a hot one, nulls, bytewise order, repeated rows, null ids."""
    rng = random.Random(5)
    rows = [{"doc_id": k, "source": "hot", "lang": "en", "n_chars": k % 7, "text": f"Text {k} ÄB"} for k in range(5000)]
    for s, n in (("one", 1), ("sixteen", 16), ("seventeen", 17), (None, 33), ("é", 3), ("Z", 257), ("", 2), ("😀", 4)):
        rows += [{"doc_id": rng.randrange(10**6), "source": s, "text": rng.choice([None, "", "SAME", "x" * 5000])} for _ in range(n)]
    rows += [{"doc_id": 7, "source": "é", "text": "Twice"}] * 40 + [{"doc_id": None, "source": "é", "text": t} for t in ("B", "a", None, None)]
    rng.shuffle(rows)
    found = check(spark, tmp_path, rows)
    assert not found.where("verified").count() == found.count()


@pytest.mark.parametrize("n", [1, 2])
def test_smallest(spark, tmp_path, n):
    check(spark, tmp_path, [{"doc_id": k, "source": None, "text": "A"} for k in range(n)])


def test_none(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13_merkle(spark, str(tmp_path)).count() == 0


def test_frontiers_are_resolved_in_any_order(spark, monkeypatch):
    """Nodes dealt at random, so that no parent is complete in one task, make the same tree."""
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(700)]
    nodes = spark.createDataFrame([(0, 0, k, 700, d) for k, d in enumerate(digests)], "g long, level int, i long, n long, digest binary")
    for dealt in (nodes.coalesce(1), nodes.repartition(9)):
        parents, roots = merkle.grown(dealt)
        assert roots.first()["digest"].hex() == climbed([d.hex() for d in digests])[-1][0]
        assert parents.count() == 44 + 3 + 1


def test_a_manifest_tells_changed_rows(spark):
    rows = spark.createDataFrame([(k, "s", f"t{k}") for k in range(40)], "id long, source string, text string")
    now = rows.selectExpr("id", "source", "if(id = 7, 'other', text) as text")
    claim = merkle.leaves_of(now, "source", "id", ["id", "text"]).selectExpr("id", "leaf as claim")
    made = merkle.leaves_of(rows, "source", "id", ["id", "text"]).join(claim, "id")
    found = merkle.build(made).proofs("claim")
    assert [r["id"] for r in found.where("folded <> root").collect()] == [7]
