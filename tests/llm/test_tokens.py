import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import bpe, packing, token_counts
from newsloom.llm.vocabulary import SpacedVocabulary, Tokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [" ", " ", "  ", "\n", "\t", "a", "b", "é", "1", "2", "'s", "'", "!", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "ß",
         "\x1c", "\x85", " ", "中", "𝒳", "é", "՘", "Ᲊ", "the", "ing", "aaaa", "!!!!!!", "<|"]


def strange(n=4000):
    rng = random.Random(2)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def test_counts_equal_the_library(byte_library):
    texts = strange()
    tokens = token_counts._tokens(BYTES)
    assert tokens.of(texts) == [len(e.ids) for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_codec_equals_the_library():
    texts, library, codec = strange(), Tokenizer.from_file(WORDS), bpe.codec(WORDS)
    packed = codec.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == want
    assert [codec.decode(x) for x in packed] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_packing_ids_equal_the_library(byte_library):
    texts = strange()
    got = [np.frombuffer(x, "<u4").tolist() for x in packing._tokens(BYTES).of(texts)]
    assert got == [e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_a_small_memory_changes_no_result(byte_library):
    texts = strange(600)
    vocabulary = SpacedVocabulary(BYTES)
    small = Tokens(vocabulary, token_counts.RankMerger(vocabulary).count, sum, lambda _: 1, limit=5, long=3)
    got = [n for at in range(0, 600, 50) for n in small.of(texts[at : at + 50])]
    assert got == [len(e.ids) for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_count_rows(odd, none, byte_library):
    df, rows = odd
    got = Counter(map(tuple, token_counts.count_tokens(df).collect()))
    want = Counter()
    for i, t in rows:
        n = len(byte_library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.count_tokens(none).count() == 0


def test_encode_rows(odd, none):
    df, rows = odd
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_digests(df).collect())) == want
    assert bpe.encode(df).where("doc_id = 0").first()["ids"] == library.encode(rows[0][1], add_special_tokens=False).ids
    assert bpe.encode_digests(none).count() == 0


def test_pack_rows(odd, none, byte_library):
    df, rows = odd
    got = packing.pack(packing.pieces(df)).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*byte_library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[-1 if i is None else i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, bin in got.sort_values("offset").groupby("sequence_id"):
        assert (bin.offset.values == (bin.length.cumsum() - bin.length).values).all() and bin.length.sum() <= 1024
    assert packing.pack(packing.pieces(none)).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(4)
    histogram = Counter(min(1024, 1 + int(rng.expovariate(1 / 300))) for _ in range(20_000))
    rows = packing.plan(histogram, 1024)
    bins, taken = Counter(), Counter()
    for length, a, b, first, each, _ in rows:
        taken[length] += b - a
        for at in range(0, b - a, each):
            bins[first + at // each] += each * length
    assert taken == histogram and max(bins.values()) <= 1024
    assert len(bins) <= 1.01 * -(-sum(k * n for k, n in histogram.items()) // 1024)


def test_fullest_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.randint(0, 30)
        counts = [0] + [rng.choice([0, 0, 1, 2]) for _ in range(30)]
        sums = {0}
        for x, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= cap}
        chosen = packing.fullest(counts, cap)
        assert sum(x * n for x, n in chosen) == max(sums) and all(n <= counts[x] for x, n in chosen)
