"""Suffix arrays of several shards: they are merged in the query at its own sizes, and wherever the shards end the windows are the same."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from lodeline.llm import queries, suffix

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def plain(strings, docs):
    first = {}
    for s, d in zip(strings, docs, strict=True):
        for i in range(len(s) - suffix.WINDOW + 1):
            w = s[i : i + suffix.WINDOW]
            first[w] = min(first.get(w, d), d)
    return [(k, i) for k, (s, d) in enumerate(zip(strings, docs, strict=True)) for i in range(len(s) - suffix.WINDOW + 1) if first[s[i : i + suffix.WINDOW]] < d]


@pytest.mark.parametrize("size", [1, 300, 2000, suffix.SHARD])
def test_shards_of_any_size(monkeypatch, size):
    monkeypatch.setattr(suffix, "SHARD", size)
    rng = random.Random(size)
    shared = [bytes(rng.choice(b"ab\xff") for _ in range(200)) for _ in range(5)]
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) + rng.choice(shared)[rng.randrange(100) :] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(60))) for _ in range(60)] + [b"a" * 500, b"", b"a" * 49, b"a" * 50]
    docs = np.array([rng.randrange(40) for _ in strings])
    source = np.sort(np.array([rng.randrange(9) for _ in strings]))
    string, offset = suffix.solve(strings, docs, source)
    assert list(zip(string.tolist(), offset.tolist(), strict=True)) == plain(strings, docs.tolist())


def test_arrays_are_merged_in_the_query(spark, monkeypatch, tmp_path):
    """At the sizes that the query has, whole tables."""
    whole, folder = suffix.merge, str(tmp_path)

    def counted(words, shards):
        with open(os.path.join(folder, str(os.getpid())), "a") as f:
            f.write(f"{len(shards)}\n")
        whole(words, shards)

    monkeypatch.setattr(suffix, "merge", counted)
    assert queries.op2_suffix_array(spark, "/root/testdata/sf0.1").where("n_removed > 0").count() > 0
    met = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert met and min(met) > 1
