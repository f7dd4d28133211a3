"""BPE encoding with a priority queue over a doubly linked symbol list, and decoding.

The symbols of a pre-token form a doubly linked list of array slots. A heap holds the merge rank
and place of every neighbouring pair that has one. The lowest is taken; an entry whose pair has
changed since it was pushed is stale and skipped; a merge links the right neighbour out and
pushes the two new pairs. Decoding concatenates the vocabulary strings of the ids.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, held, narrow, read
from .vocabulary import Tokens, Vocabulary, WordVocabulary, default_path


class HeapMerger:
    """Encodes pre-tokens with the merges of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def ids(self, word: str) -> list[int]:
        symbols = self.vocabulary.symbols(word)
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.vocabulary.merges
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            if merge := merges.get((symbols[i], symbols[i + 1])):
                heap.append((merge[0], i, merge[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, both = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] < 0:
                continue
            now = merges.get((symbols[i], symbols[j]))
            if now is None or now[0] != rank:
                continue
            symbols[i], symbols[j] = both, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if merge := merges.get((both, symbols[k])):
                    heapq.heappush(heap, (merge[0], i, merge[1]))
            h = before[i]
            if h >= 0 and (merge := merges.get((symbols[h], both))):
                heapq.heappush(heap, (merge[0], h, merge[1]))
        return [s for s in symbols if s >= 0]

    def packed(self, words: list[str]) -> list[bytes]:
        return [np.array(self.ids(w), "<u4").tobytes() for w in words]


class Codec:
    """Texts to packed ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, path: str):
        self.vocabulary = WordVocabulary(path)
        merger = HeapMerger(self.vocabulary)
        self.tokens = Tokens(self.vocabulary, merger.packed, b"".join, lambda i: i.to_bytes(4, "little"))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.tokens.of(texts)

    def decode(self, packed: bytes) -> str:
        """The vocabulary strings in order. The file names no decoder, so a space goes between
        them and word ends stay, as the library does with such files."""
        strings = self.vocabulary.strings
        return " ".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist()])


def codec(path: str) -> Codec:
    return held(("bpe", path), lambda: Codec(path))


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids (array<int>), decoded`` for each row, the ids and text in full.

    A null or empty text has no ids and decodes to the empty text; a null id stays null. Rows are
    independent: ties and repeated rows each give their row, an empty table gives none, other
    columns are not read.
    """
    return _coded(df, id, text, tokenizer, "ids array<int>, decoded string", lambda ids, back: (
        pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
        pa.array(back, pa.string()),
    ))


def encode_digests(df: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """As :func:`encode`, with the number and digests of what it gives in place of that."""
    return _coded(df, id, text, tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, back: (
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
        pa.array([sha256(x.encode()).hexdigest() for x in back], pa.string()),
    ))


def _coded(df, id, text, tokenizer, columns, give) -> DataFrame:
    path = tokenizer or default_path("word_bpe_49k.json")
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def make():
        coder = codec(path)

        def step(batch: pa.RecordBatch):
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            back = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *give(ids, back)], names=names)

        return step

    rows = narrow(df, doc_id=id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, make, f"doc_id {kind}, {columns}", rows=128)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    return encode_digests(read(spark, sf_dir, "documents"))
