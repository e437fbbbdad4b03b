"""Likelihood under a hidden Markov language model.

The states emit words, the end of a text, or classes of rarer words. A word whose share of the training tokens is SHARE or more (so at
most 1 / SHARE words, whatever the corpus) is emitted itself; any other belongs to the class of its last letters, and
follows its smoothed count among that class's words, so that every text has a proper probability. Word counts and
Baum-Welch counts are summed across partitions over all texts to learn from; texts are cut into tokens once and kept as
class ids. A text's likelihood is exact: the scaled forward recursion runs over all its tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, crc_fold, forget, sliced, stored

STATES = 8
#: Share of all training tokens from which on a word has emissions of its own, and its least count.
SHARE, LEAST = 2.0**-20, 32
#: Classes of the other words, by a hash of their last ENDING bytes.
ENDINGS, ENDING = 4096, 3
#: Rounds over all texts end when a token gains less (log10) than GAIN, or after MOST_ROUNDS.
GAIN, MOST_ROUNDS = 0.01, 4
#: Rounds, over all texts too, of the mixture that the states start from, at most; shares of a text that are left out there.
FIRST_ROUNDS, FAINT = 6, 1e-3
#: Tokens of the corpus' mean distribution that are added to what a state has emitted.
PRIOR = 200.0
#: The end token; no word has a blank.
END = " "
#: Tokens of a block of texts that run in step; of a longer text, steps whose states are kept at once.
BLOCK = 1 << 18
#: Tokens of a block whose emissions are looked up at once.
GATHER = 1 << 15
#: Distinct words that a task counts before it passes the counts on.
WORDS = 1 << 17
#: Bytes of text, and of ids, worked on at once; the more texts are sorted by length together, the more run in step.
STEP, IDS = 2 << 20, 16 << 20


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END.encode()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs, the end token included; combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for x in blobs(b, "text"):
                held.update(tokens(x))
                if len(held) > WORDS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> int:
    return crc32(word[-ENDING:]) % ENDINGS


def _ending(word: Column) -> Column:
    return F.crc32(F.substring(word.cast("binary"), -ENDING, ENDING)) % ENDINGS


@dataclass
class Classes:
    """words: class of a word with emissions of its own, or the end; the endings' classes follow. counts, total, distinct: of the training tokens."""

    words: dict[bytes, int]
    counts: np.ndarray
    rare_n: np.ndarray  # of each ending: tokens and distinct words
    rare_v: np.ndarray
    total: int
    distinct: int

    @classmethod
    def of(cls, counts: DataFrame) -> Classes:
        """From (word, n). At most 1 / SHARE words and a row for each ending come to the driver."""
        total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        own = (F.col("n") >= max(LEAST, total * SHARE)) | (F.col("word") == END)
        top = sorted(((r.word.encode(), r.n) for r in counts.where(own).collect()), key=lambda x: (-x[1], x[0]))
        words = {w: i for i, (w, _) in enumerate(x for x in top if x[0] != END.encode())}
        words[END.encode()] = len(words)
        freq = np.zeros(len(words), np.int64)
        for w, n in top:
            freq[words[w]] = n
        rare = np.zeros((2, ENDINGS), np.int64)
        for r in counts.where(~own).groupBy(_ending(F.col("word")).alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            rare[:, r.e] = r.n, r.v
        return cls(words, freq, rare[0], rare[1], total, distinct)

    def prior(self) -> np.ndarray:
        """The share of each class in the training tokens, none zero."""
        p = np.r_[self.counts, self.rare_n] + 0.5
        return p / p.sum()


def encoder(words: dict[bytes, int]):
    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > len(words) + WORDS:
                self.clear()
                self.update(words)
            i = self[word] = len(words) + ending(word)
            return i

    return Ids(words)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, classes)

    def at(self, kind: type) -> Model:
        return Model(self.start.astype(kind), self.move.astype(kind), self.emit.astype(kind))


def blocks(seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences, long to short, as (their places, (longest, count) classes, lengths) of about BLOCK tokens."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    i = 0
    while i < len(order):
        longest = len(seqs[order[i]])
        part = order[i : i + max(1, min(4096, BLOCK // longest))]
        i += len(part)
        x = np.zeros((longest, len(part)), np.int32)
        for k, s in enumerate(part):
            x[: len(seqs[s]), k] = seqs[s]
        yield np.array(part), x, np.array([len(seqs[s]) for s in part])


def _live(sizes: np.ndarray, longest: int) -> list[int]:
    """Of sequences from long to short, how many have a token at each step."""
    return np.searchsorted(-sizes, -np.arange(longest + 1), "left").tolist()


def _gathered(emit: np.ndarray, x: np.ndarray, live: list[int], lo: int, hi: int) -> np.ndarray:
    """Emissions of the steps lo to hi of x, as (states, steps, those live at lo)."""
    return np.take(emit, x[lo:hi, : live[lo]], axis=1)


def _runs(live: list[int], steps: int) -> list[tuple[int, int]]:
    """Ranges of steps whose emissions are looked up together: GATHER of them for a state, about."""
    out, lo = [], 0
    while lo < steps:
        hi = min(steps, lo + max(1, GATHER // max(1, live[lo])))
        out.append((lo, hi))
        lo = hi
    return out


def _even(live: list[int], steps: int) -> list[tuple[int, int]]:
    """Ranges of steps of which each has four fifths or more of its first step's sequences."""
    out, lo = [], 0
    for t in range(steps):
        if live[t] * 5 < live[lo] * 4:
            out.append((lo, t))
            lo = t
    return [*out, (lo, steps)]


def _ahead(m: Model, x: np.ndarray, live: list[int], before: np.ndarray | None, keep: bool):
    """The scaled forward recursion over the steps of x. before: the states' shares at the step before, none at a text's start.
    Scales, the shares after the last step, and with keep those of all steps, as (steps, states, count)."""
    steps, n = x.shape
    k = len(m.start)
    scales = np.ones((steps, n), m.emit.dtype)
    every = np.zeros((steps, k, n), m.emit.dtype) if keep else None
    a, turn = before, np.ascontiguousarray(m.move.T)
    for lo, hi in _runs(live, steps):
        e = _gathered(m.emit, x, live, lo, hi)
        for t in range(lo, hi):
            n_live = live[t]
            now = e[:, t - lo, :n_live]
            now = m.start[:, None] * now if a is None else (turn @ a[:, :n_live]) * now
            c = np.add.reduce(now, 0, out=scales[t, :n_live])
            a = np.divide(now, c, out=every[t, :, :n_live] if keep else now)
    return scales, a, every


def forward(m: Model, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log likelihoods; of a long text BLOCK steps at a time."""
    live, out, a = _live(sizes, len(x)), np.zeros(x.shape[1]), None
    for lo in range(0, len(x), BLOCK):
        scales, a, _ = _ahead(m, x[lo : lo + BLOCK], live[lo:], a, False)
        out += np.log(scales, dtype=np.float64).sum(axis=0)
    return out


def expected(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts: starts, moves, emissions (states, classes); and the natural log likelihood.

    Of a text over BLOCK tokens only the states at every BLOCK steps are kept on the way ahead; each stretch is run again on the way back, so
    that memory is bounded but for the text's own ids.
    """
    k = len(m.start)
    start, move, emit, like = np.zeros(k), np.zeros((k, k)), np.zeros((k, m.emit.shape[1])), 0.0
    for _, x, sizes in blocks(seqs):
        live = _live(sizes, len(x))
        cuts = list(range(0, len(x), BLOCK))
        states: list[np.ndarray | None] = [None]
        for lo in cuts[:-1]:
            states.append(_ahead(m, x[lo : lo + BLOCK], live[lo:], states[-1], False)[1])
        later = None  # what the steps after a stretch say of its last step
        for lo, before in zip(reversed(cuts), reversed(states), strict=True):
            part = x[lo : lo + BLOCK]
            scales, _, shares = _ahead(m, part, live[lo:], before, True)
            like += float(np.log(scales, dtype=np.float64).sum())
            own = live[lo:]
            for first, last in reversed(_runs(own, len(part))):
                e = _gathered(m.emit, part, own, first, last)
                e /= scales[first:last, : own[first]]
                for t in range(last - 1, first - 1, -1):
                    n_live, more = own[t], own[t + 1]
                    now = e[:, t - first, :n_live]
                    if more:
                        a = shares[t, :, :more]
                        move += a @ later.T
                        back = m.move @ later
                        a *= back
                        now[:, :more] *= back
                    later = now
            # Where a sequence has ended its shares are 0.
            even = _even(own, len(part))
            seen = np.concatenate([part[i:j, : own[i]].ravel() for i, j in even])
            for s in range(k):
                emit[s] += np.bincount(seen, weights=np.concatenate([shares[i:j, s, : own[i]].ravel() for i, j in even]), minlength=emit.shape[1])
        start += shares[0].sum(axis=1)
    return start, move * m.move, emit, like


def _normal(prior: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    emit = emit + PRIOR * prior
    # Rows of emissions that lie together: np.take would copy others whole at every step.
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), np.ascontiguousarray(emit / emit.sum(axis=1, keepdims=True)))


def first_guess(classes: int, states: int) -> np.ndarray:
    """What tells the states apart before any text has been read: each makes a half of the classes, by a hash of state and class, three times as likely as the other half."""
    return np.array([np.fromiter((crc32(b"%d %d" % (s, c)) & 1 for c in range(classes)), np.float64, classes) for s in range(states)]) + 0.5


def shared_out(log: np.ndarray, seqs: list[np.ndarray]) -> tuple[np.ndarray, float, int]:
    """A round of a mixture of `states` bags of words, whose log emissions are (states, classes): each text's tokens, dealt to the states by how likely
    each makes the whole text (shares under FAINT to none), as (states, classes); the natural log likelihood and the tokens. BLOCK tokens at a time."""
    states, classes = log.shape
    sizes = [len(s) for s in seqs]
    ids, first = np.concatenate(seqs), np.cumsum([0, *sizes])
    like, out = np.zeros((states, len(seqs))), np.zeros((states, classes))
    for lo in range(0, len(ids), BLOCK):
        x = ids[lo : lo + BLOCK]
        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, lo + len(x), "left")
        starts = np.maximum(first[a:b] - lo, 0)
        for s in range(states):
            like[s, a:b] += np.add.reduceat(np.take(log[s], x), starts, dtype=np.float64)
    top = like.max(axis=0)
    share = np.exp(like - top)
    total = float((top + np.log(share.mean(axis=0))).sum())
    share /= share.sum(axis=0)
    share[share < FAINT] = 0
    share /= share.sum(axis=0)
    for s in range(states):
        # Most texts are nearly whole one state's, so only the tokens of those it has a share of are counted.
        own = np.flatnonzero(share[s])
        for lo, hi in sliced([range(sizes[i]) for i in own], BLOCK):
            some = own[lo:hi]
            if len(some) == 1:
                for at in range(first[some[0]], first[some[0] + 1], BLOCK):
                    out[s] += share[s, some[0]] * np.bincount(ids[at : min(at + BLOCK, first[some[0] + 1])], minlength=classes)
            else:
                out[s] += np.bincount(np.concatenate([seqs[i] for i in some]), weights=np.repeat(share[s, some], [sizes[i] for i in some]), minlength=classes)
    return out, total, len(ids)


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about IDS bytes of ids; a longer text stands alone."""
    for b in batches:
        sizes = pa.compute.binary_length(b.column("ids")).to_pylist()
        for lo, hi in sliced([range(n) for n in sizes], IDS):
            yield b.slice(lo, hi - lo)


def _summed(coded: DataFrame, states: int, kind: str, run) -> dict[int, tuple]:
    """The sums, by row, of what run gives for batches of ids: (row, s0, s1 ...). They come to the driver: a row for each class and few more."""
    cols = [f"s{s}" for s in range(states)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = run(_sequences(b) for b in _sliced(batches))
        at = np.flatnonzero(x.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at, s], pa.float32() if kind == "float" else pa.float64()) for s in range(states))], ["row", *cols])

    found = coded.select("ids").mapInArrow(rows, "row long, " + ", ".join(f"{c} {kind}" for c in cols)).groupBy("row").agg(*(F.sum(c).alias(c) for c in cols)).collect()
    return {r[0]: r[1:] for r in found}


def started(coded: DataFrame, prior: np.ndarray, states: int, rounds: int = FIRST_ROUNDS) -> tuple[Model, list[float]]:
    """A model whose states are kinds of texts: a mixture of bags of words, fitted to all of coded (doc_id, ids) until a round gains less than GAIN a token;
    and the mean log10 likelihood of a token in each round. Each state stays where it is with a probability of nearly 1 at first."""
    spark, classes = coded.sparkSession, len(prior)
    emit, likes = first_guess(classes, states) * prior, []
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(np.log(emit / emit.sum(axis=1, keepdims=True)).astype(np.float32))

        def run(parts: Iterator[list[np.ndarray]], told=told) -> np.ndarray:
            own = np.zeros((classes + 2, states))
            for seqs in parts:
                if seqs:
                    out, like, n = shared_out(told.value, seqs)
                    own[:classes] += out.T
                    own[-2, 0] += n
                    own[-1, 0] += like
            return own

        found = _summed(coded, states, "float", run)
        told.destroy()
        if classes not in found:
            break
        emit = np.zeros((classes, states))
        for r in found.keys() - {classes, classes + 1}:
            emit[r] = found[r]
        emit = emit.T + PRIOR * prior
        likes.append(found[classes + 1][0] / found[classes][0] / math.log(10))
        if len(likes) > 1 and likes[-1] - likes[-2] < GAIN:
            break
    return _normal(prior, np.ones(states), np.eye(states) * 200, emit - PRIOR * prior if likes else np.zeros((states, classes))), likes


def train(coded: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = MOST_ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over all of coded (doc_id, ids), from a start that is fitted to all of it too, and the mean log10 likelihood of a token in each round.

    The summed counts, a row for each class, come to the driver: at most 1 / SHARE + ENDINGS + states + 3 rows.
    """
    spark, classes = coded.sparkSession, len(prior)
    (m, _), likes = started(coded, prior, states), []
    for _ in range(rounds):
        told = spark.sparkContext.broadcast((m.start.astype(np.float32), m.move.astype(np.float32), m.emit.astype(np.float32)))

        def run(parts: Iterator[list[np.ndarray]], told=told) -> np.ndarray:
            m = Model(*told.value)
            start, move, emit, like, n = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)), 0.0, 0
            for seqs in parts:
                s, v, e, x = expected(m, seqs)
                start, move, emit, like, n = start + s, move + v, emit + e, like + x, n + sum(map(len, seqs))
            return np.r_[emit.T, move, start[None], np.array([[like, n] + [0.0] * (states - 2)])]

        found = _summed(coded, states, "double", run)
        told.destroy()
        rows = np.zeros((classes + 2 + states, states))
        for r, x in found.items():
            rows[r] = x
        if not rows[-1, 1]:
            break
        m = _normal(prior, rows[-2], rows[classes : classes + states], rows[:classes].T)
        likes.append(rows[-1, 0] / rows[-1, 1] / math.log(10))
        if len(likes) > 1 and likes[-1] - likes[-2] < GAIN:
            break
    return m, likes


def scored(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text), and `learn`.

    learn: a condition on doc_id that names the rows to learn from. Null text is empty and has the end token
    alone. Repeated rows score alike. With nothing to learn from every count is 0 and all words are rare. A text's ids are held whole
    (4 bytes a token); the rest of the memory doesn't depend on its length. No rows give no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    counts = stored(word_counts(base.where("learn")))
    c = Classes.of(counts)
    own = len(c.words)
    log_all = math.log10(c.total + c.distinct + 1)
    gain = np.r_[np.log10(c.counts + 1), np.zeros(ENDINGS)]
    inner = np.r_[np.zeros(own), np.log10(c.rare_n + c.rare_v + 1)]
    known = np.r_[c.counts > 0, np.zeros(ENDINGS, bool)]
    words = spark.sparkContext.broadcast(c.words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = encoder(words.value).__getitem__
        for b in batches:
            texts = blobs(b, "text")
            for lo, hi in sliced(texts, STEP):
                seqs, others = [], []
                for x in texts[lo:hi]:
                    t = tokens(x)
                    ids = np.fromiter(map(get, t), np.int32, len(t))
                    seqs.append(ids)
                    others.append(b" ".join([t[i] for i in np.flatnonzero(ids >= own).tolist()]))
                part = b.slice(lo, hi - lo)
                cols = {
                    "doc_id": part.column("doc_id"), "learn": part.column("learn"), "ids": pa.array([s.tobytes() for s in seqs], pa.binary()), "n_tokens": pa.array([len(s) for s in seqs], pa.int64()), "n_known": pa.array([int(known[s].sum()) for s in seqs], pa.int64()),
                    "base": pa.array([float(gain[s].sum()) for s in seqs]), "inner": pa.array([float(inner[s].sum()) for s in seqs]), "words": pa.array(others, pa.binary()).cast(pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    coded = stored(base.mapInArrow(encode, "doc_id long, learn boolean, ids binary, n_tokens long, n_known long, base double, inner double, words string"))
    model, _ = train(coded.where("learn").select("doc_id", "ids"), c.prior())
    told = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            seqs = _sequences(b)
            log = np.zeros(len(seqs))
            for part, x, sizes in blocks(seqs):
                log[part] = forward(Model(*told.value), x, sizes)
            names = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(log / math.log(10))], [*names, "hmm"])

    rows = coded.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "ids", "n_tokens", "n_known", "base", "inner", "words").mapInArrow(score, "rid long, doc_id long, n_tokens long, n_known long, base double, inner double, words string, hmm double")
    rows = stored(rows)
    forget(coded)
    each = rows.select("rid", F.explode(F.split("words", " ")).alias("word"))
    sums = each.join(counts, "word").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known"))
    out = rows.drop("words").join(sums, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(c.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("hmm") + more - F.col("inner")).alias("score"),
    )


def likelihoods(docs: DataFrame) -> DataFrame:
    """The scores with held_out, learnt from rows outside fold 2 of 7."""
    return scored(docs, crc_fold("doc_id", 7) != 2).select("doc_id", (crc_fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
