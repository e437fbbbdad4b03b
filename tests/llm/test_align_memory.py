"""What a worker of op11 holds in memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodeline.llm import align


@pytest.fixture
def pair():
    return align.Pair()


def peak(run):
    tracemalloc.start()
    try:
        kept = run()
        return kept, *tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_a_remembered_stretch_is_small(pair):
    """Ids are held as bytes, 4 each, not as lists of numbers; and no second table of them is made for a long stretch."""
    texts = [" ".join(f"word{i}x{i * 7919 % 10007}" for i in range(k, k + 100)) for k in range(0, 20_000, 100)]
    _, held, _ = peak(lambda: pair.encoded(texts) and None)
    assert len(pair.memo) == 20_000 and held < 20_000 * 450
    _, _, most = peak(lambda: pair.encoded(["y" * (align.MEMO_CHARS + 1)]) and None)
    assert most < 100_000 and "y" * (align.MEMO_CHARS + 1) not in pair.memo


def test_rows_are_worked_on_by_their_bytes(pair):
    """512 long texts aren't encoded together."""
    texts = [" ".join(f"w{k * 31 + i}" for i in range(6000)) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), pa.array(texts)], ["rid", "doc_id", "text"])
    parts = []
    _, _, most = peak(lambda: parts.extend(align.batch_ids(pair, batch)))
    assert all(sum(len(texts[r]) for r in p.column("rid").to_pylist()) <= align.STEP for p in parts)
    assert most < 48 << 20
    got = pa.Table.from_batches(parts).to_pylist()
    assert [r["rid"] for r in got] == list(range(100))
    for r, (a, b) in zip(got, align.Pair().encoded(texts), strict=True):
        assert [i + align.NARROW for i in r["ids"]] == a + b and r["n"] == len(a)
    assert pair.narrow and parts[0].schema.field("ids").type == pa.list_(pa.int16())
    assert np.mean([r["n"] for r in got]) > 6000


@pytest.mark.parametrize("narrow", [True, False])
def test_pairs_are_counted_by_rows(spark, monkeypatch, narrow):
    """A row's pair counts once, however often it is linked; ids of 2 and of 4 bytes give the same."""
    made = align.Pair.__init__

    def init(self, *a):
        made(self, *a)
        self.narrow = narrow

    monkeypatch.setattr(align.Pair, "__init__", init)
    d = spark.createDataFrame([(i, "the cat sat on the mat, unbelievably " * 50) for i in range(40)], "doc_id long, text string")
    out = align.digest(d)
    rows = out.collect()
    assert len({tuple(r)[1:] for r in rows}) == 1 and len(rows) == 40
    assert rows[0].n_links > 400 and rows[0].count_sum == 40 * rows[0].n_links
    pairs = align.pair_counts(spark.createDataFrame([([1 << 32 | 7, 1 << 32 | 7, 1 << 32 | 8],), ([1 << 32 | 7],), ([50_000 << 32 | 31_999],)], "links array<long>"))
    assert sorted(map(tuple, pairs.collect())) == [(1 << 32 | 7, 2, True), (1 << 32 | 8, 1, False), (50_000 << 32 | 31_999, 1, True)]
