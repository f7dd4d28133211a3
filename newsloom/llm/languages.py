"""Language of a text by sparse multinomial logistic regression over character n-grams.

A text's letters in lower case, runs of anything else as one space, give n-grams of one to three
characters, hashed to 2^15 features. A feature's value is its count in the text times its inverse
document frequency, over all documents that may be learned from; each text's vector has length 1.
The weights are those of follow-the-regularised-leader with an L1 and an L2 penalty: most are
exactly zero. They are trained by parameter mixing: in each epoch every shard of the sample starts
from the common state, goes through its rows one by one, and the shards' states are averaged. A
temperature, fitted on rows that the weights weren't trained on, then calibrates the probabilities.

Trained on is a sample of at most about ``MOST_ROWS`` rows of each of the ``MOST_LANGUAGES`` most
frequent languages (documented bounds), and the temperature fitted on a quarter as many; frequencies
are counted over all learnable rows, and all rows are predicted from whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, narrow, read, release

#: Features, as a power of two, and characters of the longest n-gram.
BITS, LONGEST = 15, 3
#: Rows of a language in the sample, languages, passes over the sample, shards of it.
MOST_ROWS, MOST_LANGUAGES, EPOCHS, SHARDS = 2000, 256, 3, 6
#: Learning rate and its offset, and the L1 and L2 penalties.
ALPHA, BETA, LASSO, RIDGE = 2.0, 1.0, 0.05, 0.001
#: Characters of a text that are hashed at once, and texts scored at once.
PIECE, ROWS = 1 << 18, 64
#: Odd multipliers of the hash, one for each place in an n-gram, and of the n-gram's length.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
#: What documents that aren't learned from have as crc32 of the id mod 4.
HELD_OUT = 2

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter, made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normal(text: str) -> np.ndarray:
    """Code points of the lower-case letters, with one space for any run of others and around all."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.r_[np.uint32(32), np.where(letters()[points], points, 32), np.uint32(32)]
    blank = points == 32
    return points[~(blank & np.r_[False, blank[:-1]])]


def hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """Features of all n-grams of a normal text, piece by piece; a lone space is none."""
    for at in range(0, len(points), PIECE):
        wide = points[max(at - LONGEST + 1, 0) : at + PIECE].astype(np.uint64)
        new = min(at, LONGEST - 1)  # characters that only begin n-grams which end in this piece
        for n in range(1, LONGEST + 1):
            size = len(wide) - n + 1
            start = max(new - n + 1, 0)
            if size <= start:
                continue
            mixed = np.full(size - start, FACTORS[3] * n & (1 << 64) - 1, np.uint64)
            for k in range(n):
                mixed += wide[start + k : size + k] * np.uint64(FACTORS[k])
                mixed ^= mixed >> np.uint64(29)
            found = ((mixed * np.uint64(FACTORS[1])) >> np.uint64(64 - BITS)).astype(np.int64)
            yield found[wide[start:] != 32] if n == 1 else found


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs; None for a text without letters."""
    points = normal(text or "")
    if len(points) < 2:
        return None
    out = np.zeros(1 << BITS, np.float32)
    for found in hashes(points):
        out += np.bincount(found, minlength=1 << BITS)
    return out


def frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with letters, and of those that have each feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        texts, total = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                found = counts(text.as_py())
                if found is not None:
                    texts += 1
                    total += found > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([texts, *total[at]], pa.int64())], names=["at", "n"])

    sums = rows.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = (c.to_numpy() for c in sums.columns)  # no more rows than features
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[at] = n
    return int(out[-1]), out[:-1]


@dataclass
class Leader:
    """State of follow-the-regularised-leader for features (and one constant) by languages."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls, languages: int) -> Leader:
        shape = ((1 << BITS) + 1, languages)
        return cls(np.zeros(shape), np.zeros(shape))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= LASSO, 0.0, (np.sign(z) * LASSO - z) / ((BETA + np.sqrt(n)) / ALPHA + RIDGE))

    def learn(self, at: np.ndarray, x: np.ndarray, language: int) -> None:
        """One row: its features and their values, and its language."""
        at, x = np.r_[at, len(self.z) - 1], np.r_[x, 1.0]
        w = self.weights(at)
        p = np.exp((s := x @ w) - s.max())
        p /= p.sum()
        p[language] -= 1
        g = x[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def epoch(rows: DataFrame, leader: Leader) -> Leader:
    """The average of what the shards of ``rows`` (shard, place, language, at, x) make of the state.
    What a shard has not touched it returns unchanged, so it only tells what it did touch."""
    languages = leader.z.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, shard, seen = None, None, None

        def told():
            f, k = (a.ravel() for a in np.meshgrid(np.flatnonzero(seen), np.arange(languages), indexing="ij"))
            columns = [pa.array(f * languages + k, pa.int64()), pa.array(own.z[f, k] - leader.z[f, k]), pa.array(own.n[f, k] - leader.n[f, k])]
            return pa.RecordBatch.from_arrays(columns, names=["at", "z", "n"])

        for batch in batches:
            for s, k, at, x in zip(*[batch.column(c) for c in ("shard", "language", "at", "x")], strict=True):
                if s.as_py() != shard:
                    if own is not None:
                        yield told()
                    shard, own, seen = s.as_py(), Leader(leader.z.copy(), leader.n.copy()), np.zeros(len(leader.z), bool)
                    seen[-1] = True
                at = np.frombuffer(at.as_py(), "<i4")
                own.learn(at, np.frombuffer(x.as_py(), "<f4").astype(np.float64), k.as_py())
                seen[at] = True
        if own is not None:
            yield told()

    dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place")
    moved = dealt.mapInArrow(run, "at long, z double, n double").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
    at, z, n = (c.to_numpy() for c in moved.columns)  # no more rows than features times languages
    out = Leader(leader.z.copy(), leader.n.copy())
    out.z.ravel()[at] += z / SHARDS
    out.n.ravel()[at] += n / SHARDS
    return out


@dataclass
class Model:
    """Languages, inverse document frequencies, weights and temperature; without languages, none."""

    languages: list
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vectors(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has letters, and its vector of length 1 (zeros without)."""
        found = [counts(t) for t in texts]
        known = np.array([f is not None for f in found], bool)
        x = np.zeros((len(texts), 1 << BITS), np.float32)
        for k in np.flatnonzero(known):
            x[k] = found[k] * self.idf
            x[k] /= max(np.sqrt(np.dot(x[k], x[k])), 1e-30)
        return known, x

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)

    def predict(self, df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id, held_out, lang_pred, score`` of each row: the language with the highest
        probability, ties to the first in order, and that probability. Null texts, texts without
        letters and all texts under a model without languages are ``und`` with score 0. Null ids
        stay and aren't held out; repeated rows each give their row; other columns aren't read."""
        from pyspark.sql.types import StringType, StructField, StructType

        rows = narrow(df, doc_id=id, text=text)

        def make():
            release()

            def step(batch: pa.RecordBatch):
                names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                if self.languages:
                    known, x = self.vectors(batch.column("text").to_pylist())
                    p = softmax(self.logits(x) / self.temperature)
                    best = p.argmax(1)
                    names = [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                    scores = np.where(known, p.max(1), 0.0)
                columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

            return step

        kind = rows.schema["doc_id"].dataType.simpleString()
        rows = rows.select("doc_id", F.col("text").cast("string"))
        found = arrow_map(rows, make, f"doc_id {kind}, lang_pred string, score double", rows=ROWS)
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
        return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def tempered(logits: np.ndarray, language: np.ndarray) -> float:
    """The temperature between 1/50 and 50 under which the rows' languages are likeliest, by golden
    section over its logarithm (the loss is convex in the inverse temperature)."""

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(s)), language]).mean())

    low, high, ratio = -math.log(50), math.log(50), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def learnable(df: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """``text, lang, order`` of the rows that may be learned from: a text, a language and an id
    with crc32 mod 4 other than 2 (rows without an id are learned from)."""
    rows = narrow(df, id=id, text=text, lang=lang).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(~F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == HELD_OUT, F.lit(False)))
    order = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 30))
    return rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), order.alias("order"))


def sampled(known: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each of the most frequent languages, chosen by a hash of the id: the
    rows whose order is under the language's share."""
    n = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    shares = [(k, r["lang"], int(min(1.0, most / r["n"]) * (1 << 30))) for k, r in enumerate(sorted(n, key=lambda r: r["lang"]))]
    listed = known.sparkSession.createDataFrame(shares, "language int, lang string, share long")
    return known.join(F.broadcast(listed), "lang").where("order < share").drop("share")


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns as the module says. The temperature's rows are a fifth of the sampled ones, by another
    part of the hash; where they are none it is 1. Without learnable rows there is no language."""
    known = learnable(df, id, text, lang)
    chosen = durable(sampled(known, MOST_ROWS * 5 // 4))
    languages = [r["lang"] for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([], np.zeros(1 << BITS, np.float32), np.zeros(((1 << BITS) + 1, 0)))
    texts, having = frequencies(known)
    idf = np.where(having > 0, np.log((1 + texts) / (1 + having)) + 1, 0.0).astype(np.float32)
    model = Model(languages, idf, np.zeros(((1 << BITS) + 1, len(languages)), np.float32))
    number = F.coalesce(*[F.when(F.col("lang") == v, k) for k, v in enumerate(languages)]).alias("language")
    rows = chosen.select("text", "order", number, (F.col("order") % 5 == 0).alias("apart"))

    def make():
        release()

        def step(batch: pa.RecordBatch):
            known, x = model.vectors(batch.column("text").to_pylist())
            at = [np.flatnonzero(v) for v in x]
            columns = [pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], pa.binary())]
            columns = [batch.column("language"), batch.column("order"), *columns]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "place", "at", "x"]).filter(pa.array(known, pa.bool_()))

        return step

    trained = arrow_map(rows.where("not apart").drop("apart"), make, "language int, place long, at binary, x binary", rows=ROWS)
    trained = durable(trained.withColumn("shard", (F.col("place") % SHARDS).cast("int")))
    leader = Leader.new(len(languages))
    for _ in range(EPOCHS):
        leader = epoch(trained, leader)
    model.weights = leader.weights().astype(np.float32)

    def judge():
        release()

        def step(batch: pa.RecordBatch):
            known, x = model.vectors(batch.column("text").to_pylist())
            own = pa.array(list(model.logits(x)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("language"), own], names=["language", "logits"]).filter(pa.array(known, pa.bool_()))

        return step

    apart = arrow_map(rows.where("apart").drop("apart", "order"), judge, "language int, logits array<double>", rows=ROWS).toArrow()
    if apart.num_rows:  # of a bounded number
        model.temperature = tempered(np.array(apart.column("logits").to_pylist()), apart.column("language").to_numpy())
    return model


def op12_languages(spark, sf_dir: str) -> DataFrame:
    """Each document's language, learned from the rows not held out. What nulls, empty texts and the
    like give, :meth:`Model.predict` and :func:`learnable` say."""
    documents = read(spark, sf_dir, "documents")
    return fit(documents).predict(documents)
