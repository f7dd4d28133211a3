"""Toxic passages by maximum-scoring segments.

Each word has a log-odds weight: how much likelier toxic documents use it than clean ones, under
a Dirichlet prior whose mean comes from the word's first six letters, theirs from the first four
and theirs from all documents. Less a drift, weights sum over a neutral text to ever less, and
a linear-time scan finds every maximal segment with a positive score. Under the extreme-value law
of such scores a segment's score turns into a p-value, the p-values of the r best segments into
one for their sum, and a logistic curve over its logarithm, fitted on labelled rows that the
weights were not learned from, into the probability of label 1.

Weights are learned from a sample of the labelled rows of at most about ``MOST_ROWS`` of each
label (a documented bound), the curve from half as many; so the words that go to the driver and
back to the tasks, which are those of ``SUPPORT`` toxic rows or more, are bounded too. A word of
fewer has the weight of its beginnings. The labelled rows are read once; all rows are scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, narrow, read, release

#: Letters kept of a word (0: all), from general to special.
LEVELS = (4, 6, 0)
WORD = re.compile(r"\w+")
#: Weight that each level's prior has in rows, what each word's weight loses, and its bounds.
PRIOR, DRIFT, LEAST, MOST = 12.0, 1.0, -2.0, 9.0
#: Sampled rows of a label, and toxic rows that a word or beginning needs for its own weight.
MOST_ROWS, SUPPORT = 25_000, 3
#: Passages as good that chance may give a text, for one of them to count beside the best.
CHANCE = 1.0
#: Width of the bins in which the clean words' weights are counted.
BIN = 0.05
#: Bounds of the evidence in the curve.
LOW, HIGH = -20.0, 40.0


def keys_of(word: str) -> list[int]:
    """64-bit hashes of the word's beginnings and of itself."""
    return [xxhash.xxh64_intdigest(f"{k}{word[:n] if n else word}") - 2**63 for k, n in enumerate(LEVELS)]


@dataclass
class Model:
    """Weights by key, and the extreme-value law."""

    keys: np.ndarray
    weights: np.ndarray
    scale: float  # lambda: the clean words' weights s have mean exp(lambda * s) 1
    table: dict = field(default_factory=dict)
    memory: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "scale": self.scale, "table": {}, "memory": {}}

    def weight(self, chunk: str) -> float:
        """The highest weight of a word in the chunk: its own, else that of its longest known
        beginning, else 0."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), self.weights.tolist(), strict=True))
        found = []
        for word in WORD.findall(chunk):
            found.append(next((self.table[k] for k in reversed(keys_of(word)) if k in self.table), 0.0))
        return max(found, default=0.0)

    def of(self, chunks: list[str], every: bool = False) -> np.ndarray:
        """The weights in order; a chunk that has come before in the text counts 0, as the
        weights are of texts that hold a word, however often, unless ``every`` one counts."""
        memory = self.memory
        if len(memory) > 250_000:
            memory.clear()
        once = dict.fromkeys(chunks)
        for c in once:
            if c not in memory:
                memory[c] = self.weight(c)
        if every or len(once) == len(chunks):
            return np.fromiter(map(memory.__getitem__, chunks), np.float32, len(chunks))
        out = np.zeros(len(chunks), np.float32)
        first = dict(zip(reversed(chunks), range(len(chunks) - 1, -1, -1), strict=True))
        out[list(first.values())] = [memory[c] for c in first]
        return out


def log_odds(rows: list[tuple[int, int, int, int]], n_clean: int, n_toxic: int) -> dict[int, float]:
    """Weights of (key, clean rows, toxic rows, key above or 0) rows."""
    root = n_toxic / (n_clean + n_toxic)
    by_key = {key: (clean, toxic, above) for key, clean, toxic, above in rows}
    share: dict[int, float] = {}

    def of(key: int) -> float:
        if key not in by_key:
            return root
        if key not in share:
            clean, toxic, above = by_key[key]
            share[key] = (toxic + PRIOR * of(above)) / (toxic + clean + PRIOR)
        return share[key]

    return {key: math.log(of(key) / (1 - of(key))) - math.log(root / (1 - root)) for key in by_key}


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score) in one pass over the scores.

    Candidates keep the running total before them (low) and after them (high). A new one joins
    the latest earlier candidate that began lower, unless that one's end is at least as high.
    Each candidate remembers that earlier one, so none is looked at again in vain.
    """
    found: list[tuple[int, int, float, float, int]] = []  # from, to, low, high, lower one before
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, low, high = i, before, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, low, after = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = after
        found.append((start, i + 1, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def passages(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Segments of a text's words, from the sums of its runs of gains and losses."""
    scores = weights - DRIFT
    if not len(scores) or scores.max() <= 0:
        return []
    gain = scores > 0
    starts = np.flatnonzero(np.r_[True, gain[1:] != gain[:-1]])
    ends = np.r_[starts[1:], len(scores)]
    sums = np.add.reduceat(scores.astype(np.float64), starts)
    return [(int(starts[a]), int(ends[b - 1]), s) for a, b, s in segments(sums.tolist())]


def evidence(found: list[float], words: int, scale: float) -> float:
    """-log of the p-value of the best sum of r significant segment scores among ``words`` words.

    A segment is significant if fewer than ``CHANCE`` as good ones are expected by chance in a
    text of that length; the best one counts in any case.
    """
    size = math.log(max(words, 1))
    best, total = -size, 0.0
    for r, score in enumerate(sorted(found, reverse=True), 1):
        own = scale * score - size
        if r > 1 and own < -math.log(CHANCE):
            break
        total += own
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def learn(rows: DataFrame) -> Model | None:
    """A model from a bounded number of (text, toxic) rows; None without rows of both labels.
    A word counts once a row."""

    def make():
        release()

        def step(batch: pa.RecordBatch):
            clean, toxic, above = {}, {}, {}
            n = [0, 0]
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                into, n[label] = (toxic if label else clean), n[label] + 1
                seen = set()
                own = set(WORD.findall((text or "").lower()))
                for word in own:
                    keys = keys_of(word)
                    seen.update(keys)
                    above.update(zip(keys, [0, *keys], strict=False))
                for key in seen:
                    into[key] = into.get(key, 0) + 1
            keys = list(above)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0, *keys], pa.int64()),
                    pa.array([n[0], *[clean.get(k, 0) for k in keys]], pa.int64()),
                    pa.array([n[1], *[toxic.get(k, 0) for k in keys]], pa.int64()),
                    pa.array([0, *[above[k] for k in keys]], pa.int64()),
                ],
                names=["key", "clean", "toxic", "above"],
            )

        return step

    counted = arrow_map(rows, make, "key long, clean long, toxic long, above long", rows=1000)
    sums = counted.groupBy("key").agg(*[f(c).alias(c) for f, c in ((F.sum, "clean"), (F.sum, "toxic"), (F.min, "above"))])
    sums = durable(sums.where((F.col("toxic") >= SUPPORT) | (F.col("key") == 0)))
    total = sums.where("key = 0").first()
    if total is None or not total["clean"] or not total["toxic"]:
        return None
    found = sums.where("key <> 0").toArrow()  # of a bounded number of rows
    found = list(zip(*[c.to_pylist() for c in found.columns], strict=True))
    weights = log_odds(found, total["clean"], total["toxic"])
    keys = np.array(sorted(weights), np.int64)
    values = np.clip([weights[k] for k in keys.tolist()], LEAST, MOST).astype(np.float32)
    return Model(keys, values, 1.0)


def calibrated(rows: DataFrame, model: Model) -> Model:
    """The model with the extreme-value law of (text, toxic) rows that it wasn't learned from:
    lambda is the positive root of mean(exp(lambda * s)) = 1 over the clean rows' words, whose
    weights are counted in bins."""

    def make():
        release()

        def step(batch: pa.RecordBatch):
            counts = np.zeros(int((MOST - LEAST) / BIN) + 2, np.int64)
            for text in batch.column("text").to_pylist():
                weights = model.of((text or "").lower().split())
                counts += np.bincount(((weights - LEAST) / BIN).astype(np.int64), minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bin", "n"])

        return step

    clean = rows.where("toxic = 0").select("text")
    found = arrow_map(clean, make, "bin long, n long", rows=2000).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    if not found:
        return model
    s, n = np.array([[LEAST + BIN * (r["bin"] + 0.5) - DRIFT, r["n"]] for r in found]).T
    low, high = 1e-3, 20.0
    for _ in range(60):  # the only positive root, as the mean of s is negative
        mid = (low + high) / 2
        mean = (n * np.exp(np.minimum(mid * s, 300.0))).sum() / n.sum()
        low, high = (mid, high) if mean < 1 else (low, mid)
    return Model(model.keys, model.weights, low)


def curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve over z, by Newton's method with a weak prior."""
    beta, design = np.zeros(2), np.stack([np.clip(z, LOW, HIGH) / HIGH, np.ones(len(z))], 1)
    loss = lambda w: np.logaddexp(0, design @ w).sum() - y @ (design @ w) + 5e-3 * w @ w  # noqa: E731  convex
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * beta
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), slope)
        size = 1.0
        while size > 1e-9 and loss(beta + size * step) > loss(beta) - 1e-4 * size * (slope @ step):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0] / HIGH), float(beta[1])


def training_labels(labels: DataFrame, id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``doc_id, toxic, fold`` of each labelled id that may be learned from: the fold, crc32 of the
    id as text mod 5, is not 0. Of an id's several labels the largest holds; null ids and null
    labels are left out."""
    rows = narrow(labels, doc_id=id, toxic=label).where(F.col("toxic").isNotNull())
    rows = rows.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).where("fold <> 0")
    return rows.groupBy("doc_id", "fold").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def sample(known: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """About ``most`` rows of each label at most, by a hash of the id."""
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.coalesce(*[F.when(F.col("toxic") == k, min(1.0, most / n)) for k, n in counts.items()], F.lit(0.0))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part * (1 << 30))


@dataclass
class Scorer:
    """A fitted model and curve; without a model every score is 0."""

    model: Model | None
    slope: float = 0.0
    shift: float = 0.0

    def judge(self, text: str) -> tuple[int, list[tuple[int, int, float]], float, float]:
        """(words, passages, z, score) of a whole text."""
        chunks = text.lower().split()
        if self.model is None:
            return len(chunks), [], 0.0, 0.0
        found = passages(self.model.of(chunks))
        z = evidence([s for _, _, s in found], len(chunks), self.model.scale)
        if len(set(chunks)) < len(chunks):  # evidence counts a word once, passages show every place
            found = passages(self.model.of(chunks, every=True))
        at = self.slope * min(max(z, LOW), HIGH) + self.shift
        return len(chunks), found, z, 1 / (1 + math.exp(-min(max(at, -500.0), 500.0)))

    def score(self, df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id, held_out, score, predicted, words, z, passages`` for each row: passages are
        all the maximal ones, of repeated words too, word positions from ``begin`` to ``end`` and
        the score. The evidence z counts a word once a text.

        Null and empty texts have no passages and get the curve's value at no evidence. Null ids
        stay null and count as not held out. Repeated rows each give their row. Other columns are
        not read.
        """

        def make():
            release()

            def step(batch: pa.RecordBatch):
                judged = [self.judge(t or "") for t in batch.column("text").to_pylist()]
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                found = [[{"begin": a, "end": b, "score": s} for a, b, s in f] for _, f, _, _ in judged]
                columns = [
                    pa.array([s for _, _, _, s in judged], pa.float64()),
                    pa.array([n for n, _, _, _ in judged], pa.int64()),
                    pa.array([z for _, _, z, _ in judged], pa.float64()),
                    pa.array(found, kind),
                ]
                names = ["doc_id", "score", "words", "z", "passages"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

            return step

        rows = narrow(df, doc_id=id, text=text)
        kind = rows.schema["doc_id"].dataType.simpleString()
        shape = "passages array<struct<begin:int,end:int,score:double>>"
        judged = arrow_map(rows, make, f"doc_id {kind}, score double, words long, z double, {shape}")
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
        predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
        return judged.select("doc_id", held_out, "score", predicted, "words", "z", "passages")

    def clean(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``df``, with all their columns, whose score is under 0.5."""
        names = df.columns
        at = names.index(text)

        def make():
            release()

            def step(batch: pa.RecordBatch):
                keep = [self.judge(t or "")[3] < 0.5 for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

            return step

        return arrow_map(df, make, df.schema)


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> Scorer:
    """Learns from ``df`` and ``labels`` (doc_id, toxic) as :func:`training_labels` says: the
    weights from a sample of the folds 2 to 4, the curve from one of fold 1. Only texts are inputs.
    Without labelled rows of both kinds in the folds 2 to 4 there is no model; without any in
    fold 1 the curve is fitted on the others."""
    rows = narrow(df, doc_id=id, text=text)
    known = durable(training_labels(labels))
    learns = sample(known.where("fold > 1")).select("doc_id", "toxic", F.lit(True).alias("learns"))
    rest = sample(known.where("fold = 1"), MOST_ROWS // 2).select("doc_id", "toxic", F.lit(False).alias("learns"))
    # a bounded number of (id, label) rows, and their texts, read once
    chosen = durable(rows.join(F.broadcast(learns.union(rest)), "doc_id").select("text", "toxic", "learns"))
    learned, unseen = (chosen.where(c).select("text", "toxic") for c in ("learns", "not learns"))
    model = learn(learned)
    if model is None:
        return Scorer(None)
    if unseen.select("toxic").distinct().count() < 2:
        unseen = learned
    model = calibrated(unseen, model)
    return Scorer(model, *curve(*_evidence(unseen, model)))


def _evidence(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """z and label of a bounded number of (text, toxic) rows."""
    scorer = Scorer(model)

    def make():
        release()

        def step(batch: pa.RecordBatch):
            zs = pa.array([scorer.judge(t or "")[2] for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([zs, batch.column("toxic")], names=["z", "toxic"])

        return step

    found = arrow_map(rows, make, "z double, toxic int").toArrow()
    return found.column("z").to_numpy(), found.column("toxic").to_numpy().astype(float)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Each document's probability of label toxic = 1, learned from the rows not held out."""
    documents = read(spark, sf_dir, "documents")
    scored = fit(documents, read(spark, sf_dir, "labels")).score(documents)
    return scored.select("doc_id", "held_out", "score", "predicted")
