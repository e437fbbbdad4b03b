"""Dependencies of manifest files: (path, text) to (path, ecosystem, name)."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import file_name, normal_path, requirement_name
from ..operators.iterate import closure

MOST_BYTES = 500_000


def npm(files: DataFrame) -> DataFrame:
    """Keys of dependencies and devDependencies; a malformed file gives none."""
    small = files.where((file_name(F.col("path")) == "package.json") & (F.octet_length("text") <= MOST_BYTES))
    j = F.from_json("text", "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>")
    keys = F.array_union(F.coalesce(F.map_keys(j.dependencies), F.array().cast("array<string>")), F.coalesce(F.map_keys(j.devDependencies), F.array().cast("array<string>")))
    return small.select("path", F.lit("npm").alias("ecosystem"), F.explode(keys).alias("name"))


def requirement_lines(files: DataFrame) -> DataFrame:
    return files.where(F.octet_length("text") <= MOST_BYTES).select("path", F.explode(F.split("text", r"\r?\n")).alias("line"))


def requirements(files: DataFrame, starts: tuple[str, ...] = ("requirements.txt",)) -> DataFrame:
    """Packages of the files named in starts and of all that they include by -r or -c; an include out of the root leads nowhere."""
    lines = requirement_lines(files)
    target = F.regexp_extract("line", r"^\s*(?:-r|-c|--requirement|--constraint)[ =]+(\S+)", 1)
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    includes = lines.withColumn("t", target).where("t <> ''").select(F.col("path").alias("src"), normal_path(F.concat_ws("/", folder, "t")).alias("dst"))
    used = closure(includes, files.where(file_name(F.col("path")).isin(*starts)).select(F.col("path").alias("id")))
    named = lines.join(used, lines.path == used.id, "left_semi").select("path", F.lit("python").alias("ecosystem"), requirement_name(F.col("line")).alias("name"))
    return named.where("name IS NOT NULL").distinct()


def pipfile(files: DataFrame) -> DataFrame:
    """Keys of [packages] and [dev-packages]; the section of a line is the last header before it."""
    lines = files.where((file_name(F.col("path")) == "Pipfile") & (F.octet_length("text") <= MOST_BYTES)).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1)
    section = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("path").orderBy("n"))
    key = F.trim(F.regexp_extract("line", r"^\s*\"?([A-Za-z0-9._-]+)\"?\s*=", 1))
    return lines.select("path", section.alias("s"), key.alias("name")).where("s IN ('packages', 'dev-packages') AND name <> ''").select("path", F.lit("python").alias("ecosystem"), F.lower("name").alias("name"))


def pyproject(files: DataFrame) -> DataFrame:
    """Project dependencies, optional groups, and Poetry's keys but python; parsed by Arrow batches, a malformed file gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    doc = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
                lines = [*project.get("dependencies", []), *(x for xs in project.get("optional-dependencies", {}).values() for x in xs)]
                keys = [*poetry.get("dependencies", {}), *(k for g in poetry.get("group", {}).values() for k in g.get("dependencies", {})), *poetry.get("dev-dependencies", {})]
                rows += [(path, x) for x in [*map(str, lines), *(k for k in keys if k.lower() != "python")]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["path", "line"])

    small = files.where((file_name(F.col("path")) == "pyproject.toml") & (F.octet_length("text") <= MOST_BYTES)).select("path", "text")
    return small.mapInArrow(run, "path string, line string").select("path", F.lit("python").alias("ecosystem"), requirement_name(F.col("line")).alias("name")).where("name IS NOT NULL").distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """All of them, distinct (ecosystem, name)."""
    return npm(files).unionByName(requirements(files)).unionByName(pipfile(files)).unionByName(pyproject(files)).select("ecosystem", F.lower("name").alias("name")).distinct()
