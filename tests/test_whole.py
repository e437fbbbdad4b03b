"""Queries over whole tables, against brute force."""

import math
import re
from collections import Counter

import duckdb
import pytest

from lodeline.plans import catalogue

SF = "/root/testdata/sf0.001"


def _terms(text):
    words = re.findall(r"[^\W_]+", (text or "").lower().replace("_", " ").replace("-", " "))
    return [w for w in words if re.fullmatch("[a-z]{3,}", w)]


@pytest.fixture(scope="module")
def words():
    return {d: _terms(t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def _idf(n, df):
    return math.log1p((n - df + 0.5) / (df + 0.5))


def test_lexical_queries_take_every_language(spark, words):
    df = Counter(w for x in words.values() for w in set(x))
    assert {r.term: r.df for r in catalogue.QUERIES["term_idf"](spark, SF).collect()} == dict(df)
    q = set(_terms(catalogue.QUERY))
    want = {d: sum(_idf(len(words), df[w]) for w in q & set(x)) for d, x in words.items()}
    assert {r.id: r.score for r in catalogue.QUERIES["lexical_scores"](spark, SF).collect()} == pytest.approx(want, abs=1e-5)


def test_bm25_takes_every_language(spark, words):
    df = Counter(w for x in words.values() for w in set(x))
    avg = sum(map(len, words.values())) / len(words)
    want = {}
    for d, x in words.items():
        tf = Counter(x)
        want[d] = sum(_idf(len(words), df[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in set(_terms(catalogue.QUERY)))
    assert {r.id: r.score for r in catalogue.QUERIES["bm25"](spark, SF).collect()} == pytest.approx(want, abs=1e-5)


def test_graph_takes_every_order_line(spark):
    lines = duckdb.sql(f"SELECT DISTINCT l_orderkey, l_partkey FROM '{SF}/lineitem.parquet'").fetchall()
    want = Counter(f"p{p}" for _, p in lines)
    assert len(lines) > 5000
    got = {r.id: (r.n_in, r.n_out) for r in catalogue.QUERIES["degrees"](spark, SF).where("type = 'INTERFACE'").collect()}
    assert {k: v for k, v in got.items() if v != (0, 0)} == {k: (n, 0) for k, n in want.items()}
    assert {r.type: r.n for r in catalogue.QUERIES["edge_mix"](spark, SF).collect()}["CALLS"] == len(lines)


def test_report_takes_every_order_line(spark):
    lines = duckdb.sql(f"SELECT DISTINCT l_orderkey, l_partkey FROM '{SF}/lineitem.parquet'").fetchall()
    found = {r.provider: r.value_json for r in catalogue.QUERIES["metrics_report"](spark, SF).collect()}
    assert f'"edges_calls":{len(lines)},' in found["topology"]


def test_report_has_what_its_providers_say(spark):
    import json

    from lodeline.operators import graph
    from lodeline.plans import fixtures

    g = fixtures.graph(spark, SF)
    found: dict = {}
    for r in catalogue.QUERIES["metrics_report"](spark, SF).collect():
        found.setdefault(r.provider, []).append(r.value_json)
    assert set(found) == set(graph.PROVIDERS)
    for name, f in graph.PROVIDERS.items():
        assert sorted(found[name]) == sorted(f(g).toJSON().collect()) and all(map(json.loads, found[name]))
