"""What an index counts in a document's own row, and what its building leaves behind."""

import os
from collections import Counter

from lodeline.operators import lexindex


def test_terms_are_counted_in_their_row_and_shuffled_once(spark, tmp_path):
    texts = ["beta alpha Beta gamma beta", "", None, "a bb", "one_one-two", "zeta " * 300 + "eta"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: Counter({x.term: x.tf for x in r.terms or []}) for r in lexindex._counted(df, "id", "text").collect()}
    words = [Counter(w for w in (t or "").lower().replace("_", " ").replace("-", " ").split() if len(w) > 2) for t in texts]
    assert found == dict(enumerate(words))
    index = lexindex.build(df, str(tmp_path), buckets=3, block=2)
    assert sorted(os.listdir(tmp_path)) == ["about", "postings"]
    assert (index.n, index.avg_len) == (6, (5 + 0 + 0 + 3 + 301) / 5)
    assert [r.id for r in lexindex.top(index, spark, "beta zeta", 5).collect()] == [0, 5]
