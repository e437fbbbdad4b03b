"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all rows to learn from. The weights are fitted on a bounded sample with
follow-the-regularised-leader and elastic-net penalties; a temperature fitted on rows kept apart calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, crc_fold

BITS = 16
ORDERS = (1, 2, 3)
#: Different rows of each language that the weights are fitted on, about, by a hash of doc_id and text; longer texts aren't fitted on.
SAMPLE = 1000
SAMPLE_BYTES = 1 << 17
#: Bytes of text that the weights are fitted on, about; each language has an equal part of them.
FIT_BYTES = 1 << 28
#: Weights of a model: beyond 512 languages the buckets of n-grams are halved until that many suffice.
WEIGHTS = 1 << 25
#: Languages that a model learns, the most frequent ones, ties by name.
MOST_LANGUAGES = 4096
EPOCHS = 3
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def buckets(text: str) -> np.ndarray:
    """The hashed character n-grams of a text in lower case, runs of anything but letters as one space."""
    u = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(u) < n:
            continue
        h = np.full(len(u) - n + 1, np.uint64(n))
        for k in range(n):
            h = (h ^ u[k : len(u) - n + 1 + k]) * _K[k]
            h ^= h >> np.uint64(29)
        out.append((h * _K[0]) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


def _tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = buckets(text)
    if len(idx) > 1 << BITS:
        count = np.bincount(idx, minlength=1 << BITS)
        idx = np.flatnonzero(count)
        count = count[idx]
    else:
        idx, count = np.unique(idx, return_counts=True)
    x = np.log1p(count) * idf[idx]
    norm = np.sqrt((x * x).sum())
    return idx, x / norm if norm else x


def _folded(idx: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features in 2**bits buckets: those of buckets that become one are summed."""
    if bits == BITS:
        return idx, x
    at, own = np.unique(idx >> (BITS - bits), return_inverse=True)
    return at, np.bincount(own, x, minlength=len(at))


def _bits(languages: int) -> int:
    bits = BITS
    while bits > 1 and languages << bits > WEIGHTS:
        bits -= 1
    return bits


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets, languages)
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        idx, x = _folded(*_tfidf(text, self.idf), int(self.weights.shape[0]).bit_length() - 1)
        return x @ self.weights[idx] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):  # Unicode's letters; \w has numerals too
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(texts: list[str], langs: list[str], idf: np.ndarray, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """FTRL-proximal; every fifth row is kept apart for the temperature."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[x] for x in langs], np.int64)
    k = len(names)
    bits = _bits(k)
    rows = [_folded(*_tfidf(t, idf), bits) for t in texts]
    z, n = np.zeros((1 << bits, k)), np.zeros((1 << bits, k))
    bias = np.zeros(k)
    learn = [i for i in range(len(rows)) if i % 5 or len(rows) < 10]

    def weights(idx):
        zi, ni = z[idx], n[idx]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            idx, x = rows[i]
            w = weights(idx)
            g = _softmax(x @ w + bias)
            g[y[i]] -= 1
            grad = x[:, None] * g
            sigma = (np.sqrt(n[idx] + grad**2) - np.sqrt(n[idx])) / alpha
            z[idx] += grad - sigma * w
            n[idx] += grad**2
            bias -= 0.02 * g
    w = np.zeros((1 << bits, k), np.float32)
    for lo in range(0, 1 << bits, 8192):
        w[lo : lo + 8192] = weights(np.arange(lo, min(lo + 8192, 1 << bits)))
    apart = [i for i in range(len(rows)) if not i % 5]
    temperature = 1.0
    if apart:
        logits = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in apart])
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(apart)), y[apart]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(names, idf, w, bias, temperature)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts have each bucket, over all rows; at most 2**BITS sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for b in batches:
            for x in blobs(b, "text"):
                idx = buckets(x.decode("utf-8", "replace"))
                if len(idx) < 4096:
                    df[np.unique(idx)] += 1
                else:
                    df[:-1] += np.bincount(idx, minlength=1 << BITS) > 0
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for bucket, n in docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df")).collect():
        out[bucket] = n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text, lang); rows without text or lang aren't learnt from.

    Rows that come several times count in the document frequencies as often, and once in the fit. Rows are drawn by a hash, so that
    neither their order nor their files matter. A language has SAMPLE rows or its part of FIT_BYTES, whichever is less. Of more than MOST_LANGUAGES values of lang the most frequent are
    learnt, rows of the others count in the document frequencies only.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    short = F.octet_length("text") <= SAMPLE_BYTES
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(short, F.octet_length("text")).otherwise(0)).alias("size")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return Model([], idf, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    own = FIT_BYTES / len(sizes)
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, sample / r.n, own / max(r.size, 1))) for r in sizes], "lang string, share double")
    drawn = docs.where(short).join(F.broadcast(shares), "lang").withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    drawn = drawn.groupBy("h", "lang").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in zip(b.column("h").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True))
        m = fit([x[2] for x in rows], [x[1] for x in rows], idf)
        yield pa.RecordBatch.from_arrays([pa.array([m.langs], pa.list_(pa.string())), pa.array([m.weights.tobytes()]), pa.array([m.bias.tobytes()]), pa.array([m.temperature])], ["langs", "weights", "bias", "temperature"])

    got = drawn.coalesce(1).mapInArrow(run, "langs array<string>, weights binary, bias binary, temperature double").first()
    if not got or not got.langs:
        return Model([], idf, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    return Model(list(got.langs), idf, np.frombuffer(got.weights, np.float32).reshape(-1, len(got.langs)), np.frombuffer(got.bias), got.temperature)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text). A text is held whole, with some 100 bytes a character of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(x.decode("utf-8", "replace")) for x in blobs(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents; learnt from rows outside fold 0 of 5.

    Null texts and texts without a letter (numerals like the Roman ones are none) are `und` with score 0; so are all rows if nothing can
    be learnt. Repeated rows and rows of one doc_id are judged each by its text; a null doc_id is kept.
    """
    model = train(docs.where(crc_fold("doc_id", 5) != 0))
    return predicted(docs, model).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
