"""op11 aligns each distinct form of a stretch once, and shares tables of stretches by chunks of text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeline.llm import align


def shuffled(n):
    rng, words = random.Random(n), [f"unbelievably{i} mat" for i in range(50)]
    return [(i, " ".join(rng.sample(words, 50))) for i in range(n)]


def test_what_is_aligned_does_not_grow_with_what_recurs(spark, monkeypatch):
    """Ten times the documents of the same words give as many tokens to explode and to sum over."""
    seen, real = [], align.aligned_forms

    def counted(forms):
        seen.append(forms.agg(F.sum(F.size("sizes"))).first()[0])
        return real(forms)

    monkeypatch.setattr(align, "aligned_forms", counted)
    for n in (20, 200):
        rows = align.digest(spark.createDataFrame(shuffled(n), "doc_id long, text string")).collect()
        assert len(rows) == n and len({(r.n_a, r.n_b, r.n_groups, r.n_links) for r in rows}) == 1
        assert all(r.count_sum == n * r.n_links for r in rows) and rows[0].n_a > 100
    assert seen[0] == seen[1] < 100


def read_back(batches):
    """By rid, the ids of A and of B that the rows of `coded` stand for."""
    out, open_ = {}, []
    for r in (r for b in batches for r in b.to_pylist()):
        if r["low"] is not None:
            open_.append(r)
            continue
        n, m = (np.append(r[c], 0).astype(int)[r["form"]] for c in ("form_n", "form_m"))
        ends = np.cumsum(n + m)
        for d in open_:
            assert d["chunk"] == r["chunk"] == open_[0]["rid"]
            own = [(h << 16) + x + align.NARROW for x, h in zip(d["low"], d["high"], strict=True)]
            parts = [([i + align.NARROW for i in r["ids"][ends[u] - n[u] - m[u] : ends[u]]], n[u]) for u in own]
            out[d["rid"]] = [i for x, k in parts for i in x[:k]], [i for x, k in parts for i in x[k:]]
        open_ = []
    assert not open_
    return out


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["rid", "doc_id", "text"])


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 500, "STEP": 200}, {"UNITS": 40, "STEP": 100}])
def test_chunks_hold_every_text(monkeypatch, limits):
    for k, x in limits.items():
        monkeypatch.setattr(align, k, x)
    texts = ["", "a b  c \n", "日本語 テキスト", "▁a", *(t for _, t in shuffled(20)), "x" * 3000, " ", "a b\x85 c"]
    made = list(align.coded(align.Pair(), iter([batch(texts)])))
    assert sum(b.column("low").null_count for b in made) == 1 if not limits else sum(b.column("low").null_count for b in made) > 5
    assert read_back(made) == dict(enumerate(align.Pair().encoded(texts)))


def test_a_text_that_is_the_same_only_as_a_whole():
    """Where the bytes of two stretches are wrong but those of the text are right, the text is one stretch; else it has no tokens."""

    class Shifted(align.Pair):
        def ids(self, new):
            self.odd.update({x: (y, y) for x, y in {"zz": b" z", "yy": b"z yy"}.items() if x in new})
            return super().ids(new)

    texts = ["zz yy", "a zz yy b", "yy zz", "a b", "zz yy"]
    want = dict(enumerate(align.Pair().encoded(texts)))
    assert read_back(align.coded(Shifted(), iter([batch(texts)]))) == want | {2: ([], [])}
