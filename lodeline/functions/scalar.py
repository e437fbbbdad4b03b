"""Scalar expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token stands for.
CHARS_PER_TOKEN = 3.5
LONG_TOP = ("src", "app", "lib", "cli", "frontend", "backend")
IMPACT_TOP = ("src", "lib", "app", "packages")


def node_id(kind: str, key: Column) -> Column:
    """A stable id: the kind, then 12 hex digits of the key's SHA-256."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(key, 256), 1, 12))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def module_path(path: Column) -> Column:
    """a/b/c.py as a.b.c."""
    return F.replace(without_extension(path), F.lit("/"), F.lit("."))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def normal_path(path: Column) -> Column:
    """The path with `.` and `..` resolved; `..` above the root is dropped."""

    def step(out: Column, part: Column) -> Column:
        return F.when((part == ".") | (part == ""), out).when(part == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def spaced(path: Column) -> Column:
    """camelCase split, `_` and `-` as blanks."""
    return F.translate(F.regexp_replace(path, "([a-z])([A-Z])", "$1 $2"), "_-", "  ")


def term_list(text: Column) -> Column:
    """Lower-case words of three ASCII letters or more, `_` and `-` dividing words, repeats included."""
    return F.regexp_extract_all(F.translate(F.lower(text), "_-", "  "), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))


def terms(text: Column) -> Column:
    """The distinct ones of term_list()."""
    return F.array_distinct(term_list(text))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.9, "High").when(c >= 0.7, "Medium").otherwise("Low")


def pack_domain(path: Column) -> Column:
    """First directory, the first two below well-known tops when deep enough; `root` for files at the top."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n < 2, F.lit("root")).when(parts[0].isin(*LONG_TOP) & (n > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def impact_domain(path: Column) -> Column:
    """First segment, the second below a source top."""
    parts = F.split(path, "/")
    return F.when(parts[0].isin(*IMPACT_TOP) & (F.size(parts) > 1), parts[1]).otherwise(parts[0])


def safe_name(name: Column, most: int = 100) -> Column:
    """A file name: anything but letters, digits, `.`, `_`, `-` as `_`, at most `most` characters."""
    return F.substring(F.rtrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, most)


def requirement_name(line: Column) -> Column:
    """The package that a requirement line names; null for blanks, comments, flags and plain URLs."""
    t = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    named = F.regexp_extract(t, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    plain_url = t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.when((t == "") | t.startswith("-") | plain_url | (named == ""), None).otherwise(F.lower(named))


def estimated_tokens(chars: Column) -> Column:
    return chars / CHARS_PER_TOKEN


def closing_tag_safe(text: Column, tag: str) -> Column:
    """The text with every closing form of the tag made harmless."""
    return F.regexp_replace(text, rf"(?i)</\s*{tag}\s*>", f"&lt;/{tag}&gt;")


def excerpt(text: Column, most: int = 1000, mark: str = "\n... (cut)") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
