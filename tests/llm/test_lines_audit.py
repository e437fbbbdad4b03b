"""Line dedup and the filter interaction audit against plain Python, and on odd inputs."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lodeline.llm import audit, lines, queries

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
CLASH = "doc_id long, text string, source string, h long, g long, pos int, doc long, part string, A int, every int, n_lines long, m map<string,int>, b binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1, 1, 1, "x", 1, 1, 1, {"k": 1}, b"\xff") for i, t, s in rows], CLASH)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain_lines(rows, documents=10, least=1):
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                seen[key(x)].add(i)
    gone = {k for k, v in seen.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        each = (t or "").split("\n")
        kept = [x for x in each if key(x) not in gone]
        out.append((i, len(each), len(each) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LINES = [
    *((i, f"Common  line\nown {i}\n  Grüße É \n\n\tcommon  LINE\t", "a") for i in range(12)),
    *((100 + i, f"seldom\nseldom\nGRÜßE É\r\nown {i}", "b") for i in range(9)),
    (None, "seldom\n\x0b common  line \x0c", "a"), (None, "other", None), (None, None, None), (200, "", ""), (201, None, ""), (202, "\n\n", ""), (0, "Common  line", "a"), (0, "Common  line", "a"), (203, "common  line\n" * 50_000 + "end", "z"), (204, "COMMON  LINE", "é"),
]


@pytest.mark.parametrize("documents,least", [(10, 1), (2, 1), (10, 8), (1, 1), (5, 0)])
def test_lines_by_brute_force(spark, documents, least):
    d = frame(spark, LINES)
    r = lines.without_common_lines(d, documents, least)
    assert r.columns == [*d.columns, "__n_lines", "__n_dropped", "__kept_text"]
    from pyspark.sql import functions as F

    assert got(r.select("doc_id", "__n_lines", "__n_dropped", F.sha2("__kept_text", 256))) == plain_lines([(i, t) for i, t, _ in LINES], documents, least)


def test_lines_met_by_shuffle_alone(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 1)  # then no line is broadcast
    assert got(lines.digest(frame(spark, LINES))) == plain_lines([(i, t) for i, t, _ in LINES])


def test_lines_over_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got(queries.op12_line_dedup(spark, SF)) == plain_lines(rows)
    assert any(r[2] for r in plain_lines(rows))


def test_lines_of_an_empty_table(spark):
    assert lines.digest(frame(spark, LINES).where("false")).count() == 0


def plain_audit(docs, labels):
    least = {}
    ids = [i if i is not None else 2**63 - 1 for i, _, _ in docs]
    for i, (_, t, _) in zip(ids, docs, strict=True):
        least[t or ""] = min(least.get(t or "", i), i)
    rows = defaultdict(list)
    for i, (own, t, s) in zip(ids, docs, strict=True):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": least[t] < i}
        rows[s or ""].append((fails, any(x[1] == 1 for x in labels if x[0] == own is not None), any(x[2] == 1 for x in labels if x[0] == own is not None)))
    out = []
    for part, own in rows.items():
        runs, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, stay = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                runs.append((part, "".join(order), k + 1, len(stay), len(gone), sum(x[0][f] for x in own) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), f))
                shapley[f] += len(gone)
                left = stay
        out += [(*r[:-1], shapley[r[-1]]) for r in runs]
    return sorted(out)


WORDS = " ".join(f"w{i}" for i in range(60))
AUDIT = [(1, WORDS, "s"), (2, WORDS, "s"), (2, WORDS, "s"), (1, WORDS, "t"), (None, WORDS, "s"), (3, None, None), (4, "", ""), (5, "a b", "s"), (6, WORDS + " #", "s"), (7, WORDS.upper(), "t"), (8, "x " * 70_000, "t"), (9, WORDS.upper() + " W1 W1 |" + " q" * 60, "é"), (None, None, None), (10, " \t\n", "s")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, None, None), (5, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)]


def test_audit_by_brute_force(spark):
    l = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert got(audit.interactions(frame(spark, AUDIT), l)) == plain_audit(AUDIT, LABELS)
    empty = l.where("false")
    assert got(audit.interactions(frame(spark, AUDIT), empty)) == plain_audit(AUDIT, [])
    assert audit.interactions(frame(spark, AUDIT).where("false"), l).count() == 0


def test_audit_over_documents(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    found = got(queries.op13_filter_audit(spark, SF))
    assert found == plain_audit(docs, labels)
    assert {r[2] for r in found} == {1, 2, 3, 4, 5} and sum(r[4] for r in found) > 0
