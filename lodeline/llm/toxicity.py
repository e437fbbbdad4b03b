"""Toxicity by multiple-instance learning.

A sentence's score is a logistic function of its words (hashed words and their character grams); a document's is
the noisy-or of its sentences'. Only documents are labelled: the gradient of the noisy-or reaches the
sentences, which so learn which of them offend.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import blobs, crc_fold

BITS = 18
GRAM = 4
#: Beginnings of a word, in letters, that are features too.
HEADS = (5, 6, 7, 8)
#: Labelled rows of each label that a model is fitted on at most, by hash of doc_id; longer texts aren't fitted on, and the texts
#: fitted on have FIT_BYTES together at most.
SAMPLE = 3000
SAMPLE_BYTES = 1 << 16
FIT_BYTES = 24 << 20
EPOCHS = 6
THRESHOLD = 0.7
#: Folds of the texts that are fitted on, each scored by a fit to the others to find the cut; what a false alarm costs there in misses.
FOLDS, ALARM = 3, 3.0
SENTENCE = re.compile(r"[.!?\n]+")


def features(token: str) -> list[int]:
    """Buckets of a token: its letters as a whole, which count twice, each GRAM of them, ends marked, and its first letters."""
    word = "".join(c for c in token.lower() if c.isalpha())
    if not word:
        return []
    grams = {f"={word}", f"=={word}"} | {f"<{word}>"[i : i + GRAM] for i in range(len(word) + 3 - GRAM)} | {f"^{word[:n]}" for n in HEADS if len(word) >= n}
    return [xxh3_64_intdigest(g.encode()) >> (64 - BITS) for g in sorted(grams)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    shift: float = 0.0  # of the log odds of a document, so that the cut is at THRESHOLD

    def scorer(self):
        w = self.weights

        class Scores(dict):
            def __missing__(self, token: str) -> float:
                if len(self) > 400_000:
                    self.clear()
                s = self[token] = float(w[features(token)].sum())
                return s

        return Scores()

    def sentences(self, text: str, scores: dict | None = None) -> list[tuple[str, float]]:
        """The sentences of a text with their probability."""
        scores = self.scorer() if scores is None else scores
        return [(s, _sigmoid(self.bias + sum(map(scores.__getitem__, s.split())))) for s in SENTENCE.split(text) if s.strip()]

    def offending(self, text: str, scores: dict | None = None) -> list[tuple[int, int]]:
        """(start, length), in characters, of the sentences that alone reach the threshold; of the likeliest if only together they do."""
        found, at = [], 0
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            if text[at:end].strip():
                found.append((self.sentences(text[at:end], scores)[0][1], at, end - at))
            at = m.end() if m else end
        chosen = [x for x in found if self._shifted(x[0]) >= THRESHOLD] or ([max(found, key=lambda x: x[0])] if found else [])
        return [x[1:] for x in chosen]

    def _shifted(self, p: float) -> float:
        return 0.0 if p <= 0 else 1.0 if p >= 1 else _sigmoid(math.log(p / (1 - p)) + self.shift)

    def score(self, text: str, scores: dict) -> float:
        get, bias, clean = scores.__getitem__, self.bias, 1.0
        for s in SENTENCE.split(text):
            if words := s.split():
                clean *= 1 - _sigmoid(bias + sum(map(get, words)))
        return self._shifted(1 - clean)


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -30 else 0.0 if z < -700 else math.exp(z)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its sentences' features, and where each sentence begins among them."""
    memo: dict[str, list[int]] = {}
    bags = []
    for text in texts:
        idx, begin = [], []
        for s in SENTENCE.split(text):
            own = []
            for token in s.split():
                if (f := memo.get(token)) is None:
                    f = memo[token] = features(token)
                own += f
            if own:
                begin.append(len(idx))
                idx += own
        bags.append((np.array(idx, np.int32), np.array(begin, np.int64)))
    return bags


def _descended(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float) -> tuple[np.ndarray, float]:
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, bias2 = -4.0, 1.0
    weigh = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            idx, begin = bags[i]
            if not len(begin):
                continue
            z = np.clip(bias + np.add.reduceat(w[idx], begin), -30, 30)
            p = 1 / (1 + np.exp(-z))
            # log(1 - score) = sum of log(1 - p): its gradient in z is -p
            clean = max(np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()), 1e-12)
            dz = weigh[i] * (p if y[i] == 0 else -p * clean / max(1 - clean, 1e-9))
            sizes = np.diff(np.r_[begin, len(idx)])
            touched, inverse = np.unique(idx, return_inverse=True)
            grad = np.bincount(inverse, weights=np.repeat(dz, sizes)) + 1e-6 * w[touched]
            g2[touched] += grad**2
            w[touched] = np.maximum(w[touched] - rate * grad / np.sqrt(g2[touched]), 0)
            db = dz.sum()
            bias2 += db**2
            bias -= rate * db / math.sqrt(bias2)
    return w, float(bias)


def _documents(bags: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, bias: float) -> np.ndarray:
    """The noisy-or of each bag."""
    out = np.zeros(len(bags))
    for i, (idx, begin) in enumerate(bags):
        if len(begin):
            p = 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(w[idx], begin), -30, 30)))
            out[i] = 1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
    return out


def _cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The log odds from which on texts are taken for toxic: the middle of where misses and ALARM times false alarms, each by their share, are fewest."""
    odds = np.log(np.clip(scores, 1e-3, 1 - 1e-3) / (1 - np.clip(scores, 1e-3, 1 - 1e-3)))
    grid = np.linspace(-3, 3, 121)
    cost = np.array([(odds[y == 1] < c).mean() + ALARM * (odds[y == 0] >= c).mean() for c in grid])
    least = grid[cost <= cost.min() + 1e-9]
    return float((least[0] + least[-1]) / 2)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 0.3) -> Model:
    """Projected Adagrad on the noisy-or's log loss, the labels weighed evenly.

    Weights stay at 0 or above: what is said around an offence doesn't take it back. Fits to all folds but one give that fold's scores, and these the cut.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), -math.inf)
    bags, fold = _bags(texts), np.arange(len(y)) % FOLDS
    cut = math.log(THRESHOLD / (1 - THRESHOLD))
    if min((y[fold == k] == v).sum() for k in range(FOLDS) for v in (0, 1)) >= 5:
        scores = np.zeros(len(y))
        for k in range(FOLDS):
            w, bias = _descended([bags[i] for i in np.flatnonzero(fold != k)], y[fold != k], epochs, rate)
            scores[fold == k] = _documents([bags[i] for i in np.flatnonzero(fold == k)], w, bias)
        cut = _cut(scores, y)
    w, bias = _descended(bags, y, epochs, rate)
    return Model(w.astype(np.float32), bias, math.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of documents (doc_id, text) labelled in labels (doc_id, toxic), from a bounded sample of rows.

    At most `sample` rows of each label, those of the least hash of doc_id, and FIT_BYTES of text; texts over SAMPLE_BYTES are passed
    over. Of several labels of one doc_id the greatest holds, of several texts the least. The caller leaves out the rows that aren't to be learnt from.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = drawn[0].union(drawn[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for b in batches for x in zip(b.column("order").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True))
        bytes_ = np.cumsum([len(x[2]) for x in found])
        found = found[: int(np.searchsorted(bytes_, FIT_BYTES, "right"))]
        m = fit([x[2] for x in found], [x[3] for x in found])
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.bias]), pa.array([m.shift])], ["weights", "bias", "shift"])

    rows = rows.select(F.xxhash64("doc_id").alias("order"), "doc_id", "text", "toxic")
    w, bias, shift = rows.coalesce(1).mapInArrow(run, "weights binary, bias double, shift double").first() or (np.zeros(1 << BITS, np.float32).tobytes(), -math.inf, 0.0)
    return Model(np.frombuffer(w, np.float32), bias, shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) as doc_id, score double in 0..1, and offending: (start, length), in characters, of the sentences that make a text reach THRESHOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for b in batches:
            texts = [x.decode("utf-8", "replace") for x in blobs(b, "text")]
            found = [model.score(x, scores) for x in texts]
            spans = [[{"start": at, "length": n} for at, n in model.offending(x, scores)] if p >= THRESHOLD else [] for x, p in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], ["doc_id", "score", "offending"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,length:int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every row of documents; learnt from rows outside fold 1 of 3.

    Null and empty texts have no sentence and score 0; repeated rows score alike; without labels of both kinds all score 0.
    """
    model = train(docs, labels.where(crc_fold("doc_id", 3) != 1))
    return scored(docs, model).select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "offending")


def accepted(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose score is below the threshold.

    The model learns from `learn_from` (doc_id, text), docs themselves if none is given.
    """
    model = train(docs if learn_from is None else learn_from, labels.where(crc_fold("doc_id", 3) != 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for b in batches:
            yield b.filter(pa.array([model.score(x.decode("utf-8", "replace"), scores) < threshold for x in blobs(b, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
