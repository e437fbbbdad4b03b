"""Long messages, rows of one doc_id, columns of any type."""

import time

from lodeline.llm import chat, simhash

A = "the quick brown fox jumps over the lazy dog while seven small cats look on from a warm window sill"
B = "every morning at nine the old tram leaves the depot and rolls slowly down towards the harbour bridge"


def test_a_message_of_ten_megabytes(spark):
    def took(megabytes):
        text = "héllo wörld & <| \n" * (megabytes * 55_000)
        rows = spark.createDataFrame([(1, 0, "user", "go on"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
        began = time.perf_counter()
        got = [r for r in chat.digest(spark, rows).collect() if r.conv_id == 1]
        assert [(r.n_turns, r.loss_chars) for r in got] == [(2, len(text))]
        return time.perf_counter() - began

    took(1)
    one, ten = took(1), took(10)
    assert ten < 10 * one + 5  # a copy of the text for each delta would take a hundred times as long


def test_folding(spark):
    log = [("message", "a", "user"), ("delta", "b", None), ("regenerate", "x", None), ("delta", "c", None), ("delta", "d", "bot"), ("edit", "e", None), ("delta", "f", None), ("delta", None, None)]

    def folded(n):
        rows = [(1, 7, i, k, t, r) for i, (k, t, r) in enumerate(log[:n])]
        return [(r.text, r.role) for r in chat.folded(spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, text string, role string")).collect()]

    assert [folded(n) for n in range(1, 9)] == [[("a", "user")], [("ab", "user")], [("", "user")], [("c", "user")], [("cd", "bot")], [("e", "bot")], [("ef", "bot")], [("ef", "bot")]]
    deltas = spark.createDataFrame([(1, 1, 2, "delta", "y", None), (1, 1, 1, "delta", "x", None)], "conv_id long, message long, seq long, kind string, text string, role string")
    assert [(r.text, r.role) for r in chat.folded(deltas).collect()] == [("xy", "")]


def kept(spark, rows):
    d = spark.createDataFrame([(i, t, {"k": n}, b"\xff", [n]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, m map<string,int>, b binary, sid array<int>")
    r = simhash.first_texts(d, measure="dice", plain=True)
    assert r.schema == d.schema
    return sorted(((x.doc_id, x.text) for x in r.collect()), key=repr)


def test_rows_of_one_doc_id_are_judged_by_their_texts(spark):
    rows = [(1, A), (1, B), (2, A + " "), (3, B + " now"), (None, A), (4, "x"), (4, "x"), (4, "x"), (5, None), (6, "")]
    assert kept(spark, rows) == sorted([(1, A), (1, B), (None, A), (4, "x"), (5, None)], key=repr)
    assert kept(spark, [(1, A), (2, B), (3, A.upper() + "!")]) == sorted([(1, A), (2, B)], key=repr)  # none repeated
    assert kept(spark, [(9, A), (8, B), (8, A)]) == sorted([(8, B), (8, A)], key=repr)


def test_repeated_rows_leave_the_same_one(spark):
    rows = [(1, A, {"k": n}) for n in range(20)]
    got = {simhash.first_texts(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").repartition(k), measure="dice").first().m["k"] for k in (1, 3, 7)}
    assert len(got) == 1


def test_items_that_share_an_instruction_and_edited_passages(spark):
    """Every item begins alike, most are of one size, and documents hold passages with words changed, as well as the instruction alone."""
    import random

    from lodeline.llm import decontam
    from tests.llm.test_llm import plain_leaks

    rng = random.Random(11)
    lead = "answer the question below and give your reasons in a short paragraph"
    items = [(i, f"{lead} " + " ".join(f"t{rng.randrange(900)}" for _ in range(60 if i % 4 else 45 + i))) for i in range(40)]
    docs = [(i, f"{lead} " + " ".join(f"d{rng.randrange(900)}" for _ in range(80))) for i in range(30)]
    for i, text in items:
        words = text.split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        docs.append((100 + i, " ".join(f"x{rng.randrange(900)}" for _ in range(rng.randrange(40))) + " " + " ".join(words) + " and on"))
    want = plain_leaks(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(d, b).collect()}
    assert len(want) >= 25 and len(got.keys() & want.keys()) >= 0.9 * len(want) and got.keys() <= want.keys()
    assert all(k[0] >= 100 for k in got)
