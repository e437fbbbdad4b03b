"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with its language's, which are sums
over all documents of that language that pass the base rules. The Jensen-Shannon distance is judged only
above a least length, below which a histogram says little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, stored

#: Classes of characters; all others are one class more.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", "[#*$%&|<>]")
#: Common words of English, German, French and Spanish; all other words are one bin more.
COMMON = "the of and to in is that der die und das von mit zu le la les de et que qui el los en y un del por".split()
LEAST_WORDS = 50
MOST_CHAR_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.34
NEAR = 5
#: Words that a language's reference must have; without them a text is compared with all languages', and by character classes only.
LEAST_REFERENCE = 1000


def _count(text: str, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the histograms `chars` and `common` of each row of documents."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    n = F.size("words")
    windows = F.when(n >= NEAR, F.transform(F.sequence(F.lit(1), F.greatest(n - NEAR + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, NEAR)))).otherwise(F.array().cast("array<bigint>"))
    # A word is compared without the marks that end a sentence.
    plain = F.filter(F.transform("words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))), lambda w: w.isin(*COMMON))
    d = d.select("doc_id", "lang", "text", n.cast("long").alias("n_words"), windows.alias("w"), plain.alias("plain"))
    # Only a text with a window twice sorts its windows to find them.
    twice = F.size(F.array_distinct("w")) < F.size("w")
    ranked = F.when(twice, F.array_sort(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "n_words", ranked.alias("r"), (F.length("text") - _count("text", r"[\x20\x09-\x0D]")).alias("word_chars"), _count("text", CLASSES[-1]).alias("n_symbols"), lines.alias("lines"),
        F.array(*(_count("text", c) for c in CLASSES), F.length("text").cast("long")).alias("chars"),
        F.array(*((F.size("plain") - F.size(F.array_remove("plain", w))).cast("long") for w in COMMON), n_other(F.col("n_words"), F.size("plain"))).alias("common"),
    )
    same = F.filter("r", lambda x, i: F.coalesce(F.get("r", i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get("r", i + 1).h == x.h, F.lit(False)))
    d = d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.array_sort(F.transform(same, lambda x: x.i)).alias("at"), "chars", "common")
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.when(a.isNull(), 0).otherwise(F.least(F.lit(NEAR), F.coalesce(b - a, F.lit(NEAR)))))
    rest = F.element_at("chars", -1) - F.aggregate(F.slice("chars", 1, len(CLASSES)), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"), F.concat(F.slice("chars", 1, len(CLASSES)), F.array(rest)).alias("chars"), "common")


def n_other(n: Column, common: Column) -> Column:
    return (n - common).cast("long")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms; 0 if either is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    tp, tq = total(p), total(q)
    sums = F.aggregate(F.zip_with(F.transform(p, lambda v: v / tp), F.transform(q, lambda v: v / tq), lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, v: s + v)
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(sums / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def judged(docs: DataFrame, least_words: int = LEAST_WORDS, most_char: float = MOST_CHAR_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """Of each row of documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance.

    base_failed: under 10 words, or over a fifth of the words in five-word windows that come twice. Others are kept unless
    they have `least_words` or more and lie further than allowed from their language. Null text has no words; a null
    language is a language of its own. One with fewer than LEAST_REFERENCE words in documents that passed is judged by the character classes of
    all languages together, so that no document is its own reference. Repeated rows are judged alike; no rows give none.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    f = stored(features(docs).withColumn("base_failed", failed))
    bins = {"chars": len(CLASSES) + 1, "common": len(COMMON) + 1}
    sums = f.where(~F.col("base_failed") & (F.col("n_words") >= least_words)).groupBy("lang").agg(F.sum("n_words").alias("words"), *(F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, k in bins.items() for i in range(k)))
    refs = sums.where(F.col("words") >= LEAST_REFERENCE).select("lang", *(F.array(*(F.col(f"{c}{i}") for i in range(k))).alias(f"ref_{c}") for c, k in bins.items()))
    every = sums.agg(F.array(*(F.sum(f"chars{i}") for i in range(bins["chars"]))).alias("all_chars"))
    j = f.join(refs, "lang", "left").crossJoin(F.broadcast(every)).withColumn("ref_chars", F.coalesce("ref_chars", "all_chars"))  # every is one row
    j = j.withColumns({"char_distance": F.coalesce(distance(F.col("chars"), F.col("ref_chars")), F.lit(0.0)), "word_distance": F.coalesce(distance(F.col("common"), F.col("ref_common")), F.lit(0.0))})
    near = (F.col("n_words") < least_words) | ((F.col("char_distance") <= most_char) & (F.col("word_distance") <= most_word))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _oracle() -> str:
    """DuckDB SQL for judged() over documents."""
    quoted = [c.replace("'", "''") for c in CLASSES]
    chars = ", ".join(f"length(text) - length(regexp_replace(text, '{c}+', '', 'g'))" for c in quoted)
    common = ", ".join(f"len(list_filter(plain, lambda x: x = '{w}'))" for w in COMMON)
    inside = ", ".join(f"'{w}'" for w in COMMON)
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+{NEAR - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {NEAR - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, {NEAR}) AS t(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '{quoted[-1]}+', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words,
        list_filter(list_transform(words, lambda x: rtrim(lower(x), '.,;:!?')), lambda x: x IN ({inside})) AS plain, [{chars}] AS cc, length(text) AS len
    FROM d LEFT JOIN rep USING (doc_id)),
g AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        list_concat(cc, [len - list_sum(cc)]) AS chars, list_concat([{common}], [n_words - len(plain)]) AS common FROM f),
bins AS (SELECT doc_id, lang, kind, i, v, sum(v) OVER (PARTITION BY doc_id, kind) AS tv FROM (
    SELECT doc_id, lang, 'c' AS kind, unnest(range(1, len(chars) + 1)) AS i, unnest(chars) AS v FROM g UNION ALL
    SELECT doc_id, lang, 'w', unnest(range(1, len(common) + 1)), unnest(common) FROM g)),
refs AS (SELECT lang, kind, i, v, sum(v) OVER (PARTITION BY lang, kind) AS tv FROM (
    SELECT b.lang, kind, i, sum(v) AS v FROM bins b JOIN g USING (doc_id) WHERE NOT base_failed AND n_words >= {LEAST_WORDS} GROUP BY ALL)),
words AS (SELECT lang, coalesce(sum(n_words) FILTER (NOT base_failed AND n_words >= {LEAST_WORDS}), 0) AS n FROM g GROUP BY lang),
own AS (SELECT r.* FROM refs r JOIN words w USING (lang) WHERE n >= {LEAST_REFERENCE} UNION ALL
    SELECT w.lang, kind, i, sum(v), sum(sum(v)) OVER (PARTITION BY w.lang) FROM refs r, words w WHERE kind = 'c' AND w.n < {LEAST_REFERENCE} GROUP BY w.lang, kind, i),
js AS (SELECT doc_id, kind, CASE WHEN min(a.tv) > 0 THEN sqrt(greatest(sum({part.format('(a.v / a.tv)', '(r.v / r.tv)')} + {part.format('(r.v / r.tv)', '(a.v / a.tv)')}) / 2, 0)) ELSE 0 END AS dist
    FROM bins a JOIN own r USING (lang, kind, i) WHERE r.tv > 0 GROUP BY ALL),
x AS (SELECT g.*, coalesce(c.dist, 0) AS cd, coalesce(w.dist, 0) AS wd FROM g LEFT JOIN js c ON c.doc_id = g.doc_id AND c.kind = 'c' LEFT JOIN js w ON w.doc_id = g.doc_id AND w.kind = 'w')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND (n_words < {LEAST_WORDS} OR (cd <= {MOST_CHAR_DISTANCE} AND wd <= {MOST_WORD_DISTANCE})) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM x
""".replace("\\\\", "\\")


ORACLE = _oracle()
