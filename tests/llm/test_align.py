"""Cross-tokenizer alignment against a plain version that encodes whole texts, and on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from lodeline.llm import align, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    return align.Pair()


def whole(pair, text):
    """Ids of both tokenizers for a text encoded as one, or none."""
    if not text:
        return [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    want = (" " + text).encode()
    same = b"".join(pair.a_bytes[i] for i in a) == want == b"".join(pair.b_bytes[i] for i in b)
    return (a, b) if same else ([], [])


def test_bytes_of_tokens(pair):
    assert pair.a_bytes[pair.a.token_to_id("Ġthe")] == b" the" and b"".join(pair.a_bytes[i] for i in pair.a.encode("é\n\x00").ids) == "é\n\x00".encode()
    assert pair.b_bytes[pair.b.piece_to_id("▁the")] == b" the" and pair.b_bytes[pair.b.piece_to_id("<0x0A>")] == b"\n"
    assert pair.apart


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "a\n b\t c", "x\xa0 y", "x  y 　 z", "<|endoftext|> <s> </s> <unk>", "don't  I'll 'tis", "日本語 テキスト 한국어", "🙂🙂 🙂", "é é ﬁ ½", "\x00\x01 \x1f a", "a" * 500, "​ ​", "1234567890 12,5 %%% $$ \r\n x", "▁a ▁ b▁c", "ĠaĠ b", "﻿ x", "word\x85 word \x1c next"]


def texts():
    rng = random.Random(5)
    signs = "ab c.,'\n\t  é日\xa0🙂1 |<>▁"
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]


def test_stretches_are_encoded_as_the_whole(pair):
    every = texts()
    assert align.Pair().encoded(every) == [whole(pair, t) for t in every]
    assert " ".join(pair.stretches("a  b \n c d ")) == "a  b \n c d "


def test_what_a_worker_forgets(pair, monkeypatch):
    every = texts()[-60:]
    monkeypatch.setattr(align, "MEMO", 10)
    monkeypatch.setattr(align, "MEMO_CHARS", 3)
    p = align.Pair()
    assert [x for k in range(0, len(every), 7) for x in p.encoded(every[k : k + 7])] == [whole(pair, t) for t in every]


def plain(pair, rows):
    per = []
    for i, t in rows:
        a, b = whole(pair, t)
        ends = []
        for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, own = 0, []
            for x in ids:
                own.append((at, at := at + len(of[x]), x))
            ends.append(own)
        cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups, at = [], [0, 0]
        for hi in cuts:
            both = []
            for k, own in enumerate(ends):
                ids = []
                while at[k] < len(own) and own[at[k]][1] <= hi:
                    ids.append(str(own[at[k]][2]))
                    at[k] += 1
                both.append(",".join(ids))
            groups.append("|".join(both))
        links = [(x, y) for s, e, x in ends[0] for u, v, y in ends[1] if s < v and u < e] if len(a) < 3000 else linked(*ends)
        per.append((i, len(a), len(b), groups, links))
    docs = Counter(x for r in per for x in set(r[4]))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return sorted(((i, a, b, len(g), len(l), sum(docs[x] == best[x[0]] for x in l), sum(docs[x] for x in l), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, l in per), key=repr)


def linked(a, b):
    out, j = [], 0
    for s, e, x in a:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            out.append((x, b[k][2]))
            k += 1
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_alignment_over_documents(spark, pair):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = queries.op11_alignment(spark, SF)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(found) == plain(pair, rows)


@pytest.mark.parametrize("hot", [1 << 17, 1])
def test_alignment_of_odd_rows(spark, pair, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT", hot)
    rows = [*enumerate(ODD), (3, "a  b"), (3, "a  b"), (None, "no id"), (None, None), (7, None), (8, "lorem ipsum dolor " * 20_000), (9, "x" * 30_000)]
    d = spark.createDataFrame([(i, t, 1, 1, 1, "x", {"k": 1}) for i, t in rows], "doc_id long, text string, rid long, pos int, n int, ids string, m map<string,int>")
    assert got(align.digest(d)) == plain(pair, rows)
    assert align.digest(d.where("false")).count() == 0
