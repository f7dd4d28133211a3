"""Token counts by rank-synchronous array merging.

Many pre-tokens are merged at once. Their symbols lie in one ragged numpy array; in each round
every sequence looks up the ranks of its neighbouring pairs, takes its own lowest rank and
merges all places of that pair together, left to right where places overlap. A sequence with no
known pair left is finished; its surviving symbols are its tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, held, narrow, read
from .vocabulary import SpacedVocabulary, Tokens, default_path


class RankMerger:
    """Counts the tokens of pre-tokens with the merges of one vocabulary."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        pairs = sorted((left << 32 | right, rank, both) for (left, right), (rank, both) in vocabulary.merges.items())
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.both = np.array([p[2] for p in pairs], np.int64)
        self.single = np.array([vocabulary.ids[c] for c in vocabulary.letters], np.int64)

    def count(self, words: list[str]) -> list[int]:
        """How many tokens each pre-token becomes."""
        raw = [w.encode() for w in words]
        total = np.array([len(r) for r in raw], np.int64)
        out = total.copy()
        which = np.flatnonzero(total > 1)
        symbols = self.single[np.frombuffer(b"".join(raw[i] for i in which), np.uint8)]
        owner = np.repeat(which, total[which])
        while len(symbols):
            symbols, owner, done, left = self._round(symbols, owner)
            out[done] = left
        return out.tolist()

    def _round(self, symbols, owner):
        """Merges every sequence's lowest pair; returns the unfinished symbols and their owners,
        then the finished owners and their numbers of symbols."""
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        rank = np.full(len(symbols), self.NONE, np.int32)
        known = (self.keys[at] == key) & (owner[:-1] == owner[1:])
        rank[:-1][known] = self.ranks[at[known]]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        ended = lowest == self.NONE
        chosen = (rank == np.repeat(lowest, sizes)) & (rank != self.NONE)
        # places that overlap follow each other: keep every other one of such a run
        places = np.flatnonzero(chosen)
        if len(places):
            fresh = np.r_[True, np.diff(places) != 1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            symbols[places] = self.both[at[places]]
        keep = ~np.repeat(ended, sizes)
        keep[places + 1] = False
        return symbols[keep], owner[keep], owner[starts[ended]], sizes[ended]


def _tokens(path: str) -> Tokens:
    def make() -> Tokens:
        vocabulary = SpacedVocabulary(path)
        return Tokens(vocabulary, RankMerger(vocabulary).count, sum, lambda _: 1)

    return held(("token_counts", path), make)


def count_tokens(
    df: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = 512
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) for each row.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null. Rows are independent:
    ties and repeated rows each give their row, an empty table gives none, other columns are not
    read. Whole texts are counted, whatever their length.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")

    def make():
        tokens = _tokens(path)

        def step(batch: pa.RecordBatch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = pa.array(tokens.of(texts), pa.int64())
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, counts, pc.greater(counts, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    rows = narrow(df, doc_id=id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(read(spark, sf_dir, "documents"))
