"""Language identification with many languages: none is an error, what is fitted on and what comes of it are bounded."""

import random

import numpy as np

from lodeline.llm import langid


def speech(i, n, seed):
    words = [random.Random(i).sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçåøæœ", 12)[k : k + 4] for k in (0, 4, 8)]
    rng = random.Random(f"{i} {seed}")
    return " ".join("".join(rng.choice(words)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_more_languages_than_weights_allow(spark):
    rows = [(10 * i + k, speech(i, 30, k), f"l{i:03}") for i in range(600) for k in range(4)]
    model = langid.train(frame(spark, rows))
    assert len(model.langs) == 600 and model.weights.shape == (1 << 15, 600) and model.weights.size <= langid.WEIGHTS
    found = langid.predicted(frame(spark, [(i, speech(i, 30, "new"), None) for i in range(600)]), model).collect()
    assert len(found) == 600 and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in found) > 540


def test_most_frequent_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(k, speech(1, 20, k), "b") for k in range(40)] + [(100 + k, speech(2, 20, k), "c") for k in range(40)] + [(200 + k, speech(3, 20, k), "a") for k in range(39)]
    assert langid.train(frame(spark, rows)).langs == ["b", "c"]
    assert len(langid.identified(frame(spark, rows)).collect()) == len(rows)


def test_bytes_of_the_fit(spark, monkeypatch):
    d = frame(spark, [(k, speech(k % 2, 100, k), "xy"[k % 2]) for k in range(1000)])
    monkeypatch.setattr(langid, "FIT_BYTES", 40_000)  # some 80 of 1,000 rows
    few = langid.train(d)
    monkeypatch.undo()
    every = langid.train(d)
    assert few.langs == every.langs == ["x", "y"] and (few.idf == every.idf).all() and (few.weights != every.weights).any()
    assert sum(r.lang_pred == "xy"[r.doc_id % 2] for r in langid.predicted(d, few).collect()) > 950


def test_folded_features_are_sums():
    idx, x = np.array([0, 1, 2, 5]), np.array([1.0, 2.0, 3.0, 4.0])
    at, y = langid._folded(idx, x, langid.BITS - 1)
    assert at.tolist() == [0, 1, 2] and y.tolist() == [3.0, 3.0, 4.0]
    assert langid._folded(idx, x, langid.BITS)[0] is idx
    assert langid._bits(4) == langid._bits(512) == 16 and langid._bits(513) == 15 and langid._bits(4096) == 13
