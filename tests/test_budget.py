"""The greedy budget in rounds, against the plain loop."""

import random

import pytest

from lodeline.operators import ranking


def plain(rows, cap, spent=0):
    out = []
    for i, s in rows:
        if s is not None and s >= 0 and spent + s <= cap:
            spent += s
            out.append(i)
    return out


@pytest.mark.parametrize("few", [0, 5, 1 << 16])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_rounds(spark, monkeypatch, few, kind):
    monkeypatch.setattr(ranking, "FEW", few)
    rng = random.Random(few)
    sizes = [rng.choice([0, 1, 2, 7, 60, 61, 400, 5000, None]) for _ in range(400)]
    rows = [(i, s if s is None or kind == "long" else float(s)) for i, s in enumerate(sizes)]
    d = spark.createDataFrame(rows, f"id long, size {kind}").repartition(9)
    for cap, spent in ((0, 0), (63, 2), (5461, 0), (9999, 17), (10**9, 0)):
        assert sorted(r.id for r in ranking.within_budget(d, cap, d.id, spent=spent).collect()) == plain(rows, cap, spent)
    assert ranking.within_budget(d, 5461, d.id).columns == ["id", "size"]


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_what_fits_exactly_is_kept(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    rows = [("a", 1, 33), ("a", 2, 100), ("a", 3, 31), ("a", 4, 1)]  # 4 for the header, then 33, 31 and 1, is 69
    blocks = spark.createDataFrame(rows, "domain string, rank int, chars int")
    assert {r["rank"] for r in ranking.packed_by_domain(blocks, 20).collect()} == {1, 3, 4}  # 70 characters
    assert {r["rank"] for r in ranking.packed_by_domain(blocks, 20, spent=1).collect()} == {1, 3, 4}
    assert {r["rank"] for r in ranking.packed_by_domain(blocks, 20, spent=2).collect()} == {1, 3}


def test_jobs_do_not_follow_the_ranges(spark, monkeypatch):
    """A size that halves what is left again and again is the worst case; ranges that fit in part cost nothing."""
    monkeypatch.setattr(ranking, "FEW", 10)
    rows = [(i, 3 + i % 50) for i in range(3000)]

    def jobs(parts):
        spark.sparkContext.setJobGroup(f"budget-{parts}", "")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sorted(r.id for r in ranking.within_budget(spark.createDataFrame(rows, "id long, size long"), 4000, "id").collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.sparkContext.setJobGroup("", "")
        assert got == plain(rows, 4000)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"budget-{parts}"))

    assert jobs(24) <= jobs(3) + 6
