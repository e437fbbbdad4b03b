"""The start of op8's model is fitted to every text to learn from."""

import numpy as np
import pytest

from lodeline.llm import lm


def coded(spark, seqs):
    return spark.createDataFrame([(i, bytearray(np.array(s, np.int32).tobytes())) for i, s in enumerate(seqs)], "doc_id long, ids binary")


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_tokens_are_dealt_by_whole_texts(monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    emit = np.array([[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]])
    seqs = [np.array(s) for s in ([0, 1, 2, 0], [1], [2, 2, 1, 0, 1, 1, 2], [0] * 9)]
    want, total = np.zeros((2, 3)), 0.0
    for s in seqs:
        p = emit[:, s].prod(axis=1)
        total += np.log(p.mean())
        q = p / p.sum()
        q = np.where(q < lm.FAINT, 0, q)
        for c in s:
            want[:, c] += q / q.sum()
    out, like, n = lm.shared_out(np.log(emit), seqs)
    assert np.allclose(out, want) and like == pytest.approx(total) and n == 21


def test_every_text_counts_in_the_start(spark):
    """Of 6,000 texts three are of a kind of their own: a start that is fitted to some 1,500 texts can't give them a state but by chance."""
    seqs = [[s % 7, s % 5, 3, s % 3, 6] * 8 for s in range(6000)] + [[20, 21, 22, 23] * 400] * 3
    prior = np.bincount(np.concatenate(seqs), minlength=24) + 0.5
    m, likes = lm.started(coded(spark, seqs).repartition(5), prior / prior.sum(), 4)
    assert likes == sorted(likes) and len(likes) > 1
    assert (m.emit[:, 20:].sum(axis=1) > 0.9).any()
    assert np.allclose([m.start.sum(), *m.move.sum(axis=1), *m.emit.sum(axis=1)], 1)


def test_long_texts_count_in_the_start(spark):
    """Also texts over 16,384 tokens, which no start was fitted to."""
    long = [[20, 21, 22, 23] * 5000]
    prior = np.bincount(np.concatenate([[0, 1, 2] * 400, *long]), minlength=24) + 0.5
    m, _ = lm.started(coded(spark, [[0, 1, 2, 0, 2]] * 200 + long), prior / prior.sum(), 4)
    assert (m.emit[:, 20:].sum(axis=1) > 0.9).any()


def test_nothing_to_start_from(spark):
    m, likes = lm.started(coded(spark, [[0]]).where("false"), np.array([0.5, 0.5]), 3)
    assert likes == [] and np.allclose(m.emit, 0.5)
