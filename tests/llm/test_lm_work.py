"""What op8's rounds cost, and that they count the same."""

import numpy as np
import pytest

from lodeline.llm import lm


def toy(classes=40, states=4, texts=60, seed=3):
    rng = np.random.default_rng(seed)
    m = lm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states))
    return m, [rng.integers(0, classes, n).astype(np.int32) for n in rng.integers(1, 90, texts)]


def plain(m, seqs):
    """Forward and backward of each sequence by itself."""
    k = len(m.start)
    start, move, emit, like = np.zeros(k), np.zeros((k, k)), np.zeros((k, m.emit.shape[1])), 0.0
    for s in seqs:
        a, c = [], []
        for t, w in enumerate(s):
            x = (m.start if t == 0 else a[-1] @ m.move) * m.emit[:, w]
            c.append(x.sum())
            a.append(x / c[-1])
        like += np.log(c).sum()
        back = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            emit[:, s[t]] += a[t] * back
            if t == 0:
                start += a[0] * back
            else:
                later = m.emit[:, s[t]] * back / c[t]
                move += a[t - 1][:, None] * m.move * later[None]
                back = m.move @ later
    return start, move, emit, like


@pytest.mark.parametrize("gather", [1, 7, 100, 1 << 15])
@pytest.mark.parametrize("block", [1 << 18, 200, 16])
def test_counts_are_those_of_each_text(monkeypatch, gather, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "GATHER", gather)
    m, seqs = toy()
    for got, want in zip(lm.expected(m, seqs), plain(m, seqs), strict=True):
        assert np.allclose(got, want)
    out = np.zeros(len(seqs))
    for part, x, sizes in lm.blocks(seqs):
        out[part] = lm.forward(m, x, sizes)
    assert out.sum() == pytest.approx(plain(m, seqs)[3])


def test_emissions_are_looked_up_for_many_steps_at_once(monkeypatch):
    m, seqs = toy()
    calls, take = [], np.take
    monkeypatch.setattr(np, "take", lambda *a, **k: calls.append(1) or take(*a, **k))
    lm.expected(m, seqs)
    assert len(calls) <= 4  # each way; once a step before


def test_a_start_counts_the_tokens_of_a_states_own_texts(monkeypatch):
    emit = np.full((8, 64), 1e-6)
    for s in range(8):
        emit[s, s * 8 : s * 8 + 8] = 0.12
    seqs = [np.arange(8, dtype=np.int32).repeat(5) + 8 * (i % 8) for i in range(80)]
    counted, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: counted.append(len(x)) or count(x, *a, **k))
    out, _, n = lm.shared_out(np.log(emit / emit.sum(axis=1, keepdims=True)), seqs)
    assert sum(counted) == n == 3200  # states times as many, twice, before
    assert np.allclose(out, np.kron(np.eye(8), np.full(8, 50)))
