"""Benchmark items whose ids are null or repeated."""

from lodeline.llm import decontam


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(d, b).collect()
    kept = {r.doc_id for r in decontam.clean(d, b).collect()}
    assert kept == {i for i, _ in docs} - {r.doc_id for r in rows}
    return sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in rows)


def test_items_without_an_id_are_found(spark):
    items = [(1, None), (2, ""), (3, "too short"), (4, "one two three four five"), (None, "one two three four five"), (None, "six seven eight nine ten")]
    docs = [(1, "x One two, three four five y"), (2, None), (3, "six seven eight nine ten"), (4, "nothing of the kind is in here")]
    assert found(spark, docs, items) == [(1, -1), (1, 4), (3, -1)]


def test_every_text_of_an_item_is_found(spark):
    items = [(7, "one two three four five"), (7, "six seven eight nine ten"), (7, "Six seven eight, nine ten"), (7, "a b c d e f")]
    docs = [(1, "one two three four five"), (2, "six seven eight nine ten"), (3, "x a b c d e f y"), (4, "one two three four five then six seven eight nine ten")]
    assert found(spark, docs, items) == [(1, 7), (2, 7), (3, 7), (4, 7), (4, 7)]


def test_short_items_are_found(spark):
    items = [(1, "Two, three"), (2, "alpha beta gamma delta"), (3, ""), (None, "omega"), (4, "one two three four five")]
    docs = [(1, "two three"), (2, "x one two three four five"), (3, "alpha beta gamma"), (4, "so alpha beta gamma delta"), (5, "alpha gamma beta delta"), (6, "the omega"), (7, "omegas")]
    assert found(spark, docs, items) == [(1, 1), (2, 1), (2, 4), (4, 2), (6, -1)]
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("doc_id = 4").collect()
    assert [(r.similarity, r.start_word, r.n_words) for r in rows] == [(1.0, 1, 4)]
