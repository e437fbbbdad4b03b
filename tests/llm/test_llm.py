"""The corpus operators against brute-force versions, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import chat, decontam, langid, lm, packing, quality, queries, simhash, substring, suffix, toxicity

SF = "/root/testdata/sf0.001"
#: Columns that operators use themselves, as extra columns of the input.
CLASH = "fp long, did long, tid long, words string, score double, part int, n_words long, keys string, rid long, item_id long, group long"
DOC = "doc_id long, text string, lang string, source string, n_chars long, toxic int, quality int, " + CLASH
LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [(1, "one two three", "en"), (1, "one two three", "en"), (2, None, None), (None, "no id at all", "de"), (3, "", "en"), (4, LONG, "fr"), (5, " \t\n ", None), (6, "é" * 200 + " ü" * 60, "de"), (7, "one two three", "en"), (1, "another text of id one", "en"), (8, "\x00 nul &lt;| <|", "en")]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(*r, "s", 1, 1, 1, 9, 9, 9, "x", 9.0, 9, 9, "x", 9, 9, 9) for r in rows], DOC)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- SimHash


def groups(ids, linked):
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        x, y = find(a), find(b)
        if x != y and linked(a, b):
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return 0
    g = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    fp = {d: plain_fingerprint(t) for d, t in docs}
    want = groups(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


@pytest.mark.parametrize("radius", [1, 2, 3, 22])
def test_bit_sliced_compare(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    f = np.array([x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 2))) for x in base for _ in range(8)], np.uint64)
    cut = len(f) // 3
    first, last = np.r_[np.zeros(cut, int), np.full(len(f) - cut, cut)], np.r_[np.full(cut, cut), np.full(len(f) - cut, len(f))]
    i, j = simhash.compare(f, first, last, radius)
    want = {(a, b) for a in range(len(f)) for b in range(a + 1, int(last[a])) if (int(f[a]) ^ int(f[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_simhash_chunks_of_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(1)
    fps = sorted({rng.getrandbits(6) | (rng.getrandbits(3) << 60) for _ in range(120)})
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    from lodeline.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(reps)).collect()}
    want = groups(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_near_copies(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "COPY_CHUNK", 3)
    sets = {d: set(simhash.grams((t or "").encode()).tolist()) for d, t in docs}
    want = groups(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, "documents")).collect()} == want
    kept = simhash.first_of_each(table(spark, "documents"))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == table(spark, "documents").columns


def plain_near_copies(docs):
    """{document: smallest document of its group}, all pairs of sets of five plain words, by Dice."""
    plain = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) or t.lower().split()
    sets = {}
    for d, t in docs:
        w = plain(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    return groups(sets, lambda a, b: 2 * len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b])))


def test_components_of_a_long_chain(spark):
    from lodeline.llm.components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 1999), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1999: 1999, 2000: 1999}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_by_dice(spark, monkeypatch, sf):
    """Blocks in chunks, against all pairs; the bands may miss a pair once in thousands."""
    monkeypatch.setattr(simhash, "COPY_CHUNK", 3)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    want = plain_near_copies(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), measure="dice", plain=True).collect()} == want
    assert len(set(want.values())) < len(rows)


def test_near_copies_of_a_group_that_changes_word_by_word(spark, monkeypatch):
    """A chain of texts, each near the next only, in small chunks, and short texts whose fingerprints lie far apart."""
    monkeypatch.setattr(simhash, "COPY_CHUNK", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 120]), "en") for i in range(30)]
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(12)) + (" more" if i % 2 else ""), "en") for i in range(20) for i in (i // 2 * 2 + i % 2,)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), measure="dice").collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[100 + i] == 100 + i for i in range(20))
    rows = [(i, "a b c d e f g h" + (" i" if i else ""), "en") for i in range(2)]
    assert {r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()} == {0}


def test_first_of_each_is_the_least_row(spark):
    rows = [(1, "b text", "en"), (1, "a text", "en"), (2, "c c c", "de"), (3, "C c, c", "fr"), (None, "c c c", "en")]
    for r in (rows, rows[::-1]):
        kept = simhash.first_of_each(frame(spark, r), measure="dice", plain=True)
        assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == [(0, "c c c"), (1, "a text"), (2, "c c c")] and kept.columns == frame(spark, r).columns


# --- repeated passages


def brute(units, window=50):
    seen = {}
    for d in sorted(units):
        for i in range(len(units[d]) - window + 1):
            seen.setdefault(tuple(units[d][i : i + window]), d)
    out = {}
    for d, u in units.items():
        gone = bytearray(len(u))
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] < d:
                gone[i : i + window] = b"\1" * window
        out[d] = gone
    return out


def test_substring(spark, docs):
    words = {d: (t or "").encode().split() for d, t in docs}
    gone = brute(words)
    want = {d: (len(w), sum(gone[d]), hashlib.sha256(b" ".join(x for x, g in zip(w, gone[d], strict=True) if not g)).hexdigest()) for d, w in words.items()}
    assert sum(x[1] for x in want.values()) > 100
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring(spark, SF).collect()} == want


def test_suffix_array_query(spark, docs):
    raw = {d: (t or "").encode() for d, t in docs}
    gone = brute(raw)
    want = {d: (len(x), sum(gone[d]), len(re.findall(rb"\x01+", bytes(gone[d]))), hashlib.sha256(bytes(c for c, g in zip(x, gone[d], strict=True) if not g)).hexdigest()) for d, x in raw.items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_array(spark, SF).collect()} == want


@pytest.mark.parametrize("most", [suffix.MOST, 300])
def test_suffix_solver(monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST", most)
    rng = random.Random(3)
    for _ in range(10):
        base = [bytes(rng.choice(b"ab\0") for _ in range(60)) for _ in range(4)]
        strings = [b"".join(rng.choice(base) for _ in range(rng.randint(1, 14)))[rng.randint(0, 9) :] for _ in range(12)]
        ids = np.array([rng.randint(0, 5) for _ in strings])
        seen = {}
        for s, d in zip(strings, ids, strict=True):
            for i in range(len(s) - 49):
                seen[s[i : i + 50]] = min(d, seen.get(s[i : i + 50], 99))
        want = [[i for i in range(len(s) - 49) if seen[s[i : i + 50]] < d] for s, d in zip(strings, ids, strict=True)]
        string, at = suffix.solve(strings, ids)
        assert [at[string == k].tolist() for k in range(len(strings))] == want and (np.diff(string) >= 0).all()


@pytest.mark.parametrize("letters", [b"ab", bytes(range(256))])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(9)
    text = bytes(rng.choice(letters) for _ in range(700))
    text = text + text[100:400] + text[:60]
    raw = np.frombuffer(text, np.uint8)
    sa, rank, close = suffix.suffix_array(raw)
    keys = [text[i : i + 50] for i in sa]
    assert keys == sorted(keys) and sorted(sa.tolist()) == list(range(len(text)))
    assert all((rank[a] == rank[b]) == (text[a : a + 50] == text[b : b + 50]) for a, b in itertools.pairwise(sa))
    assert all(close[a] and close[b] for a, b in itertools.pairwise(sa) if text[a : a + 50] == text[b : b + 50])
    order = sa[sa <= len(text) - 50]
    lcp = suffix.common_prefixes(raw, order)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] : order[k - 1] + 50], text[order[k] : order[k] + 50]
        assert lcp[k] == next((i for i in range(50) if a[i] != b[i]), 50)


def test_binary_search_of_windows():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(900)) + b"\xff" * 70 + b"\0" * 70
    raw, n = np.frombuffer(text, np.uint8), 990
    first = {}
    for i in rng.sample(range(n), 500):
        first.setdefault(text[i : i + 50], i)
    have = sorted(first)
    at = np.array(sorted(rng.sample(range(n), 300), key=lambda i: text[i : i + 50]))
    where, met = suffix.search(suffix.words_at(raw), np.array([first[x] for x in have]), at)
    import bisect

    assert [bisect.bisect_left(have, text[i : i + 50]) for i in at] == where.tolist() and [text[i : i + 50] in first for i in at] == met.tolist()


@pytest.mark.parametrize("name", ["op2", "op5"])
def test_windows_of_hot_minimisers_and_many_shards(spark, docs, monkeypatch, name):
    """The same result if minimisers are hot from two documents on, buckets are small, tasks hold little and arrays are short."""
    from lodeline.llm import windows

    monkeypatch.setattr(windows, "BUCKET", 1 << 15)
    run = queries.op2_suffix_array if name == "op2" else queries.op5_substring
    want = sorted(map(repr, run(spark, SF).collect()))
    monkeypatch.setattr(windows, "HOT", 3)
    monkeypatch.setattr(windows, "HOT_SHARE", 1 << 60)
    monkeypatch.setattr(windows, "HOLD", 1 << 14)
    monkeypatch.setattr(windows, "STEP", 1 << 14)
    monkeypatch.setattr(suffix, "MOST", 4000)
    assert sorted(map(repr, run(spark, SF).collect())) == want


def test_windows_of_the_greatest_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2**63 - 1, text, "en"), (None, text, "en"), (5, text, "en"), (None, text + " x", "en")]
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substring.digest(frame(spark, rows)).collect())
    assert got == [(0, 60), (0, 60), (5, 0), (2**63 - 1, 60)]
    assert {r.doc_id for r in suffix.digest(frame(spark, rows)).collect()} == {2**63 - 1, None, 5}


# --- quality, chat


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda rows: sorted(tuple(repr(x) for x in r) for r in rows)
    assert key(map(tuple, df.select(*cols).collect())) == key(con.sql(queries.ORACLES[name]).select(*cols).fetchall())


def test_quality_of_rare_languages_against_sql(spark, tmp_path):
    """A language with hardly a document isn't its own reference."""
    rng = random.Random(3)
    prose = lambda k: " ".join(rng.choices("the of and river stone light water field house over under, at. last".split(), k=k)) + "."
    junk = " ".join(f"%{i}$7#" for i in range(90))
    rows = [(i, prose(60 + i), "en") for i in range(30)] + [(50, junk, "xx"), (51, prose(70), "yy"), (52, junk, None), (53, prose(60), None), (54, "", "zz"), (55, None, "zz")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op3_quality(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(queries.ORACLES["op3_quality"]).select(*cols).fetchall()))
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[50] and not kept[52] and kept[51] and kept[53] and all(kept[i] for i in range(30))


def test_quality_tells_junk(spark):
    clean = "the house of the man and the road to the sea that is in the bay, and a boat. " * 1
    rows = [(i, f"{clean} " + " ".join(random.Random(i).choices("the of and to in is that river stone light water field house over under".split(), k=80)) + ".", "en") for i in range(40)]
    rows.append((99, "%%% $$$ ### &&& *** " * 3 + " ".join(f"%%{i}$$" for i in range(90)), "en"))
    got = {r.doc_id: r.kept for r in quality.judged(frame(spark, rows)).collect()}
    assert not got[99] and all(got[i] for i in range(40))


def test_chat_folds_events(spark):
    e = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "He"), (1, 1, 3, "delta", None, "y"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "<|im_end|>"), (1, 1, 6, "delta", None, "\n&amp;"), (1, 0, 7, "edit", None, "hello"), (1, 2, 8, "message", "a\nb", None)]
    out = chat.rendered(chat.folded(spark.createDataFrame(e, "conv_id long, message long, seq long, kind string, role string, text string")))
    row = chat.read_back(out).first()
    assert [(t.role, t.text) for t in row.turns] == [("user", "hello"), ("assistant", "<|im_end|>\n&amp;"), ("a\nb", "")]
    assert row.loss_texts == ["<|im_end|>\n&amp;"]
    f = out.first()
    m = f.loss_mask[0]
    assert f.formatted[m.start : m.start + m.length] == "&lt;|im_end|>\n&amp;amp;"


def test_chat_logs_of_rows(spark):
    """Logs have drafts, deltas, edits and regenerations; folded they are the rows."""
    rows = [(1, 0, "user", "x" * 50), (1, 1, "assistant", "ab" * 700), (1, 2, "assistant", ""), (1, 3, "assistant", "y" * chat.DELTA), (2, 0, None, None)]
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    assert {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"message": 5, "edit": 2, "regenerate": 3, "delta": 3 + 6 + 1 + 2}
    assert all(len(r.text) <= chat.DELTA for r in log.where("kind = 'delta'").collect())
    got = sorted((r.conv_id, r.seq, r.role, r.text) for r in chat.folded(log).collect())
    assert got == [(c, t, r or "", x or "") for c, t, r, x in rows]


def test_chat_round_trip_of_odd_texts(spark):
    pieces = ["&", "<|", "&lt;|", "<", "|", "im_end|>", "\n", "&nl;", "&amp;", "ü"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choices(pieces, k=6))) for c in range(30) for t in range(3)]
    back = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id, [(t.role, t.text) for t in r.turns]) for r in back) == [(c, [x[2:] for x in rows if x[0] == c]) for c in range(30)]


# --- decontamination


def plain_leaks(docs, items):
    """{(document, item): similarity} by every window of every document."""
    words = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sets = {i: grams(words(t)) for i, t in items}
    df = Counter(h for s in sets.values() for h in set(s))
    want = {}
    for d, t in docs:
        sh = grams(words(t or ""))
        for i, s in sets.items():
            if not set(s) & set(sh):
                continue
            ci = Counter(s)
            weigh = lambda h: math.log1p(len(sets) / df[h]) if h in ci else math.log1p(len(sets))  # noqa: E731, B023
            best = 0
            for a in range(max(1, len(sh) - len(s) + 1)):
                cw = Counter(sh[a : a + len(s)])
                best = max(best, sum(weigh(h) * min(cw[h], ci[h]) for h in ci) / sum(weigh(h) * max(cw[h], ci[h]) for h in {*cw, *ci}))
            if round(best, 12) >= 0.8:
                want[d, i] = round(best, 9)
    return want


def test_decontamination_recall(spark):
    """All of sf0.01 against every window."""
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = plain_leaks(docs, duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall())
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.op7_decontamination(spark, sf).collect()}
    assert len(want) > 10 and len(got.keys() & want.keys()) >= 0.9 * len(want) and got.items() <= want.items()


def test_decontamination(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    words = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    # Also near forms: two words changed, a word put in.
    docs = [*docs, *((10_000 + i, "some words before " + " ".join(words(t)[:-2] + ["x", "y"]) + " and after it all") for i, t in items), *((20_000 + i, " ".join(w := words(t)) + " " + " ".join(w[:1])) for i, t in items)]
    want = plain_leaks(docs, items)
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), table(spark, "benchmark"))
    assert len(want) > 60 and {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == want


# --- models


def test_language_held_out(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = queries.op6_langid(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in lang}
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_letters(spark):
    model = langid.Model(["a", "b"], np.ones(1 << langid.BITS), np.zeros((1 << langid.BITS, 2), np.float32), np.array([1.0, 0.0]), 1.0)
    got = {t: model.predict(t)[0] for t in ("½²³", "Ⅷ", "①②", "12 -_", "", "é", "1 a", "漢", None)}
    assert got == {"½²³": "und", "Ⅷ": "und", "①②": "und", "12 -_": "und", "": "und", "é": "a", "1 a": "a", "漢": "a", None: "und"}


def test_language_fit_against_a_plain_loop(monkeypatch):
    """FTRL, weight by weight in dictionaries."""
    monkeypatch.setattr(langid, "BITS", 13)
    rng = random.Random(6)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(3, 20))) for a in ("abc ", "cde ", "xyz ") * 8]
    langs = ["p", "q", "r"] * 8
    idf = np.array([1 + rng.random() for _ in range(1 << 13)])
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.05, 0.02, 2
    m = langid.fit(texts, langs, idf, epochs, alpha, beta, l1, l2)
    rows = []
    for t in texts:
        c = Counter(langid.buckets(t).tolist())
        x = {i: math.log1p(n) * idf[i] for i, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows.append({i: v / norm for i, v in x.items()})
    z, n, bias = Counter(), Counter(), [0.0] * 3

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - math.copysign(l1, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    def chances(x, heat=1.0, w=weight):
        s = [(sum(v * w(i, k) for i, v in x.items()) + bias[k]) / heat for k in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation([i for i in range(len(rows)) if i % 5]):
            p = chances(rows[i])
            g = [p[k] - (langs[i] == "pqr"[k]) for k in range(3)]
            for f, v in rows[i].items():
                for k in range(3):
                    d, w = v * g[k], weight(f, k)
                    z[f, k] += d - (math.sqrt(n[f, k] + d * d) - math.sqrt(n[f, k])) / alpha * w
                    n[f, k] += d * d
            bias = [b - 0.02 * x for b, x in zip(bias, g, strict=True)]
    assert np.allclose([[weight(i, k) for k in range(3)] for i in range(1 << 13)], m.weights, atol=1e-6) and np.allclose(bias, m.bias)
    apart = [i for i in range(len(rows)) if not i % 5]
    loss = lambda heat: -sum(math.log(chances(rows[i], heat)["pqr".index(langs[i])]) for i in apart)
    assert all(loss(m.temperature) <= loss(h) + 1e-6 for h in (0.05, 0.1, 0.3, 1, 2, 5))
    for t, x in zip(texts, rows, strict=True):
        p = chances(x, m.temperature)
        assert m.predict(t) == ("pqr"[p.index(max(p))], pytest.approx(max(p), abs=1e-5))


def test_language_sample_is_of_the_rows(spark):
    """Neither order nor files nor copies of the rows change the model."""
    d = table(spark, "documents")
    a = langid.train(d)
    b = langid.train(d.repartition(5, "source").orderBy(F.desc("n_chars")))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature


def test_toxicity_finds_the_sentence():
    rng = random.Random(5)
    plain = "river stone light water field house over under tree cloud".split()
    sentence = lambda: " ".join(rng.choices(plain, k=8))
    texts, labels = [], []
    for i in range(400):
        s = [sentence() for _ in range(rng.randint(2, 9))]
        if i % 2:
            s.insert(rng.randint(0, len(s)), f"you {rng.choice(['glorp', 'znark'])} there")
        texts.append(". ".join(s))
        labels.append(i % 2)
    m = toxicity.fit(texts[:300], labels[:300])
    scores = m.scorer()
    assert all((m.score(t, scores) >= 0.7) == bool(y) for t, y in zip(texts[300:], labels[300:], strict=True))
    top = max(m.sentences(texts[301]), key=lambda x: x[1])
    assert "you" in top[0] and m.score("", scores) == 0
    for t, y in zip(texts[300:], labels[300:], strict=True):
        if y:
            assert [t[a : a + n] for a, n in m.offending(t, scores)] == [x for x in re.split(r"[.!?\n]+", t) if "you" in x]


def test_noisy_or_by_hand():
    w = np.zeros(1 << toxicity.BITS, np.float32)
    for f in toxicity.features("bad"):
        w[f] += 0.5
    m = toxicity.Model(w, -2.0, 0.3)
    n = sum(w[f] for f in toxicity.features("bad"))
    p = [1 / (1 + math.exp(-(-2 + n * k))) for k in (0, 1, 2)]
    joint = 1 - math.prod(1 - x for x in p)
    assert m.score("good. a bad day!\n bad bad", m.scorer()) == pytest.approx(1 / (1 + math.exp(-(math.log(joint / (1 - joint)) + 0.3))))


def test_toxicity_fit_against_a_plain_loop():
    """Projected Adagrad on the noisy-or, weight by weight in dictionaries."""
    rng = random.Random(8)
    texts = [". ".join(" ".join(rng.choices("alpha beta gamma delta worse".split(), k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(30)] + [""]
    y = np.array([int("worse" in t) for t in texts])
    w, bias = toxicity._descended(toxicity._bags(texts), y, 2, 0.3)
    v, g2, b, b2 = Counter(), {}, -4.0, 1.0
    weigh = {k: len(y) / (2 * (y == k).sum()) for k in (0, 1)}
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(texts)):
            bags = [[f for x in s.split() for f in toxicity.features(x)] for s in texts[i].split(".") if s.split()]
            if not bags:
                continue
            p = [1 / (1 + math.exp(-(b + sum(v[f] for f in bag)))) for bag in bags]
            clean = math.prod(1 - q for q in p)
            d = [weigh[y[i]] * (q if not y[i] else -q * clean / (1 - clean)) for q in p]
            grad = Counter()
            for bag, x in zip(bags, d, strict=True):
                for f in bag:
                    grad[f] += x
            for f, x in grad.items():
                x += 1e-6 * v[f]
                g2[f] = g2.get(f, 1e-2) + x * x
                v[f] = max(v[f] - 0.3 * x / math.sqrt(g2[f]), 0)
            b2 += sum(d) ** 2
            b -= 0.3 * sum(d) / math.sqrt(b2)
    assert bias == pytest.approx(b) and np.allclose([v[f] for f in range(1 << toxicity.BITS)], w) and w.any()


def test_toxicity_held_out(spark):
    """Labels are noisy: some texts with none of the words that the others have are labelled toxic."""
    sf = "/root/testdata/sf0.1"
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    rows = [r for r in queries.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in label]
    found = Counter((label[r.doc_id], r.predicted) for r in rows)
    assert found[1, 1] >= 0.9 * (found[1, 1] + found[1, 0]) and found[0, 1] <= 0.03 * (found[0, 0] + found[0, 1])
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert all(bool(r.offending) == bool(r.predicted) and all(text[r.doc_id][x.start : x.start + x.length].strip() for x in r.offending) for r in rows)


def test_toxicity_query(spark, docs):
    rows = queries.op9_toxicity(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def plain_paths(m, s):
    """Likelihood and Baum-Welch counts of one sequence over all paths of its states."""
    k, n = len(m.start), m.emit.shape[1]
    total, a, b, c = 0, np.zeros(k), np.zeros((k, k)), np.zeros((k, n))
    for path in itertools.product(range(k), repeat=len(s)):
        p = m.start[path[0]] * math.prod(m.emit[j, x] for x, j in zip(s, path, strict=True)) * math.prod(m.move[i, j] for i, j in itertools.pairwise(path))
        total += p
        a[path[0]] += p
        for x, j in zip(s, path, strict=True):
            c[j, x] += p
        for i, j in itertools.pairwise(path):
            b[i, j] += p
    return math.log(total), a / total, b / total, c / total


@pytest.mark.parametrize("block", [1 << 18, 4, 1])
def test_baum_welch_and_forward(monkeypatch, block):
    """Also with texts over BLOCK tokens, whose states are kept stretch by stretch."""
    monkeypatch.setattr(lm, "BLOCK", block)
    m = lm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]]))
    seqs = [np.array(s) for s in ([0, 1, 2, 0], [1], [2, 2, 1, 0, 1, 1, 2, 0, 0], [0, 0])]
    like, *want = (sum(x) for x in zip(*(plain_paths(m, s) for s in seqs), strict=True))
    start, move, emit, found = lm.expected(m, seqs)
    assert all(np.allclose(x, y) for x, y in zip((start, move, emit), want, strict=True)) and found == pytest.approx(like)
    for part, x, sizes in lm.blocks(seqs):
        assert np.allclose(lm.forward(m, x, sizes), [plain_paths(m, seqs[i])[0] for i in part])


def test_lm_query(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 1 / 400)  # so that most words are rare
    models = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    words = {d: [*(t or "").encode().lower().split(), b" "] for d, t in docs}
    count = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    own = sorted((w for w in count if w != b" " and count[w] >= max(lm.LEAST, n / 400)), key=lambda w: (-count[w], w))
    place = {w: i for i, w in enumerate([*own, b" "])}
    tail = Counter(lm.ending(w) for w in count if w not in place)
    mass = Counter()
    for w in count:
        if w not in place:
            mass[lm.ending(w)] += count[w]
    rows = queries.op8_hmm(spark, SF).collect()
    (m, likes), = models
    assert len(rows) == len(docs) and likes == sorted(likes) and len(likes) > 1
    assert np.allclose([m.start.sum(), *m.move.sum(axis=1), *m.emit.sum(axis=1)], 1)
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    for r in rows[:40]:  # the whole score by a plain forward recursion
        a, score = m.start, 0.0
        for i, w in enumerate(words[r.doc_id]):
            e = lm.ending(w)
            a = (a if not i else a @ m.move) * m.emit[:, place.get(w, len(place) + e)]
            score += math.log10(a.sum()) + (0 if w in place else math.log10((count[w] + 1) / (mass[e] + tail[e] + 1)))
            a = a / a.sum()
        assert r.score == pytest.approx(score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score - r.base_score for r in held) > 0.2 * sum(r.n_tokens for r in held)


def test_endings_agree(spark):
    w = ["a", "ab", "abc", "abcd", "zü", "é", "漢字"]
    got = [r.e for r in spark.createDataFrame([(x,) for x in w], "w string").select(lm._ending(lm.F.col("w")).alias("e")).collect()]
    assert got == [lm.ending(x.encode()) for x in w]


# --- packing


def test_packing(spark, docs):
    rows = queries.op10_packing(spark, SF).collect()
    used, size = Counter(), {}
    by_doc: dict = {}
    for r in rows:
        used[r.bin_id] += r.length
        size[r.bin_id] = r.bin_capacity
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for b, n in used.items():
        assert n <= size[b] == min(c for c in packing.CAPACITIES if c >= n)
    assert {d: sum(n for _, n in x) for d, x in by_doc.items()} == {d: len((t or "").encode().split()) + 1 for d, t in docs}
    for x in by_doc.values():
        assert [s for s, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))]
    spans = sorted((r.bin_id, r.bin_offset, r.length) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in itertools.pairwise(spans))


def plain_best_fit(lengths, sizes, overhead):
    """Bins as lists of places, by looking at every open bin."""
    rest, bins = sum(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        rest -= n
        fitting = [b for b in bins if b["room"] >= n]
        if fitting:
            b = min(fitting, key=lambda b: (b["room"], b["no"]))
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / min(c, n + rest), -c))
            b = {"room": room, "no": len(bins), "own": []}
            bins.append(b)
        b["own"].append(i)
        b["room"] -= n
    return [(b["own"], min(c for c in sizes if c >= sum(lengths[i] for i in b["own"]))) for b in bins]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_against_looking_at_every_bin(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(200)]
    bins, offset, sizes = packing.best_fit(np.array(lengths), (16, 32, 64), 4)
    want = plain_best_fit(lengths, (16, 32, 64), 4)
    assert sizes.tolist() == [c for _, c in want]
    for k, (own, _) in enumerate(want):
        assert sorted(own) == np.flatnonzero(bins == k).tolist() and [int(offset[i]) for i in own] == [sum(lengths[j] for j in own[:x]) for x in range(len(own))]


def test_packed_texts(spark, docs):
    """Whole texts come back, sequences hold what their size says, and neither the order nor the files of the rows matter."""
    d = table(spark, "documents")
    small = {"capacities": (64, 256), "overhead": 8, "group_tokens": 5000}
    rows = packing.packed_documents(d, **small).collect()
    back: dict = {}
    for r in sorted(rows, key=lambda r: r.piece):
        back[r.doc_id] = back.get(r.doc_id, "") + r.text
        assert len(r.text.split()) + r.ends == r.length
    assert back == {i: t or "" for i, t in docs}
    key = lambda rows: sorted((r.doc_id, r.piece, r.bin_id, r.bin_offset, r.bin_capacity) for r in rows)
    assert key(packing.packed_documents(d.repartition(7, "source").orderBy("n_chars"), **small).collect()) == key(rows)
    for r in packing.sequences(packing.packed_documents(d, **small)).collect():
        assert len(r.sequence.split()) == r.n_tokens <= r.bin_capacity


def test_packing_spreads_repeated_rows(spark):
    rows = packing.packed_documents(frame(spark, [(1, "a b c", "en")] * 300), capacities=(8, 16), group_tokens=100).collect()
    assert len(rows) == 300 and len({r.bin_id >> 32 for r in rows}) > 6
    assert Counter(r.bin_id for r in rows).most_common(1)[0][1] <= 4


def test_pieces():
    text = b"  a b\tc \n d e f "
    for most in (1, 2, 3, 4, 7, 8):
        p = packing.pieces(text, most)
        assert b"".join(x for *_, x in p) == text and sum(n for _, n, _ in p) == 7 and all(n <= most for _, n, _ in p) and [a for a, *_ in p] == list(range(0, 7, most))
    assert packing.pieces(b"", 1) == [(0, 1, b"")] and packing.pieces(b" ", 5) == [(0, 1, b" ")]


def test_best_fit_takes_the_fullest_bin():
    bins, offset, sizes = packing.best_fit(np.array([70, 60, 35, 28]), (100,), 0)
    assert bins.tolist() == [0, 1, 1, 0] and offset.tolist() == [0, 0, 60, 70] and sizes.tolist() == [100, 100]
    assert packing.best_fit(np.array([10]), (16, 64), 4)[2].tolist() == [16]
    assert packing.best_fit(np.zeros(0, int))[2].tolist() == []


# --- odd inputs


LABELS = [(1, 0), (3, 1), (4, None), (7, 1), (8, 0)]
RUNS = {
    "simhash": lambda s, d: simhash.near_duplicates(d), "near_copies": lambda s, d: simhash.near_copies(d), "first_of_each": lambda s, d: simhash.first_of_each(d), "suffix": lambda s, d: suffix.digest(d), "quality": lambda s, d: quality.judged(d),
    "substring": lambda s, d: substring.digest(d), "langid": lambda s, d: langid.identified(d), "decontam": lambda s, d: decontam.contaminated(d, table(s, "benchmark")), "lm": lambda s, d: lm.likelihoods(d), "packing": lambda s, d: packing.packed_documents(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame(LABELS, "doc_id long, toxic int")), "accepted": lambda s, d: toxicity.accepted(d, s.createDataFrame(LABELS, "doc_id long, toxic int")), "clean": lambda s, d: decontam.clean(d, table(s, "benchmark")),
}
FEWER = {"first_of_each": 6, "decontam": 0, "packing": None, "accepted": None, "near_copies": len(ODD)}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    got = RUNS[name](spark, frame(spark)).collect()
    if name not in FEWER:
        assert len(got) == len(ODD)
    elif FEWER[name] is not None:
        assert len(got) == FEWER[name]


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, frame(spark).where("false")).count() == 0


def test_rows_of_one_id_do_not_take_from_each_other(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring.without_repeats(frame(spark, [(5, text, "en"), (5, text, "en"), (5, text + " more", "en"), (6, text, "en"), (None, text, "en")])).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in rows) == [(5, 0), (5, 0), (5, 0), (6, 60), (99, 60)]


def test_chat_odd_rows(spark):
    c = spark.createDataFrame([(1, None, None, None, 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (None, 1, "assistant", "b", 1)], "conv_id long, turn long, role string, text string, seq long")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(spark, c).collect()}
    assert got == {1: (3, 0), None: (1, 1), -1: (2, len(chat.PROBE))}
    assert chat.digest(spark, c.where("false")).count() == 1


def test_benchmark_odd_rows(spark):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "one two three four five"), (None, "one two three four five")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x One two, three four five y"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} >= {(1, 4)}
    assert decontam.contaminated(d, b.where("false")).count() == 0


def test_labels_of_one_kind(spark):
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark), one).collect()} == {0.0}


def test_pipeline_against_plain_python(spark, docs):
    """Every stage by brute force, but for the weights of the toxicity model."""
    import corpus_pipeline as p

    labels = table(spark, "labels").where(p.common.crc_fold("doc_id", 3) != 1)
    m = toxicity.train(table(spark, "documents"), labels)

    def toxic(text):
        clean = math.prod(1 - q for _, q in m.sentences(text))
        odds = math.log((1 - clean) / clean) if 0 < clean < 1 else math.inf if clean <= 0 else -math.inf
        return 1 / (1 + math.exp(-min(max(odds + m.shift, -700), 700))) >= 0.7

    left = [(d, t) for d, t in docs if not toxic(t or "")]
    near = plain_near_copies(left)
    left = [(d, t) for d, t in left if near[d] == d]
    gone = brute({d: (t or "").split() for d, t in left})
    left = [(d, " ".join(w for w, g in zip(t.split(), gone[d], strict=True) if not g) if any(gone[d]) else t) for d, t in left]
    leaks = {d for d, _ in plain_leaks(left, duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())}
    want = {d: t for d, t in left if d not in leaks}
    assert len(docs) > len(near) > len(left) > len(want) > 50 and any(any(x) for x in gone.values())
    got: dict = {}
    for r in sorted(p.run(spark, SF).collect(), key=lambda r: r.piece):
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == want


def test_pipeline_keeps_columns_and_takes_odd_rows(spark):
    import corpus_pipeline as p

    d = frame(spark, [*ODD, (None, None, None)])
    for _, stage in p.STAGES[:-1]:
        e = stage(spark, d, SF)
        assert e.columns == d.columns and stage(spark, d.where("false"), SF).count() == 0
    assert p.STAGES[-1][1](spark, d.where("false"), SF).count() == 0
    for columns in (("doc_id", "text"), ("text", "other", "doc_id")):
        few = d.withColumn("other", F.lit(1)).select(*columns)
        assert all(stage(spark, few, SF).columns == list(columns) for _, stage in p.STAGES[:-1])


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    d, sizes = table(spark, "documents"), []
    for _, stage in p.STAGES[:-1]:
        before = {r.doc_id for r in d.select("doc_id").collect()}
        d = p.common.stored(stage(spark, d, SF))
        assert d.columns == list(p.COLUMNS)
        sizes.append(d.count())
        assert {r.doc_id for r in d.select("doc_id").collect()} <= before
    assert sizes[2] == sizes[1] and sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert {r.doc_id for r in p.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in d.select("doc_id").collect()}
