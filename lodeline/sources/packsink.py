"""A Python data sink for packs: a folder with a file or more for each domain, and an index of them.

Tasks write their files to a staging folder beside the target. A commit keeps the files that successful tasks name, adds the index and puts the folder in its place;
an abort, or a task that fails, leaves nothing. The folder lies where the driver and all executors see it. Rows (domain, best, rank, block) come with a domain's rows together, in the
order of rank. Options: path; header and footer, around each domain, `{}` standing for its name.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

INDEX = "index.jsonl"


@dataclass
class _Written(WriterCommitMessage):
    """What a task has written: (best, rank of the first block, domain, file, blocks, characters)."""

    files: list[tuple[int, int, str, str, int, int]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target, self.overwrite = options["path"].rstrip("/"), overwrite
        self.header, self.footer = options.get("header", ""), options.get("footer", "")
        self.stage = f"{self.target}.{uuid.uuid4().hex}.new"
        if os.path.exists(self.target) and not overwrite:
            raise FileExistsError(self.target)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        os.makedirs(self.stage, mode=0o700, exist_ok=True)
        context, files, out = TaskContext.get(), [], None
        try:
            for r in rows:
                if not files or files[-1][2] != r.domain:
                    if out:
                        out.write(self.footer)
                        out.close()
                    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", r.domain or "")[:60] or "domain"
                    name = f"{safe}-{context.partitionId()}-{context.taskAttemptId()}-{len(files)}.md"
                    out = os.fdopen(os.open(os.path.join(self.stage, name), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8")
                    out.write(self.header.replace("{}", r.domain or ""))
                    files.append((r.best, r["rank"], r.domain, name, 0, 0))
                out.write(r.block)
                files[-1] = (*files[-1][:4], files[-1][4] + 1, files[-1][5] + len(r.block))
            if out:
                out.write(self.footer)
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.stage, mode=0o700, exist_ok=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[0], f[2] or "", f[1]))
        for name in {*os.listdir(self.stage)} - {f[3] for f in files}:  # of attempts that didn't count
            os.unlink(os.path.join(self.stage, name))
        with open(os.path.join(self.stage, INDEX), "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"n": n, "domain": domain, "file": name, "blocks": blocks, "chars": chars}) + "\n" for n, (_, _, domain, name, blocks, chars) in enumerate(files))
        old = f"{self.stage}.old"
        if self.overwrite and os.path.exists(self.target):
            os.rename(self.target, old)
        os.rename(self.stage, self.target)
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class PackFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pack_folder"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def save(blocks: DataFrame, path: str, header: str = "", footer: str = "", mode: str = "append") -> None:
    """Writes blocks (domain, rank, block) to the folder path, which must not exist yet unless mode is overwrite. A domain is one task's, read as a stream: no domain is one string, and none passes the driver."""
    blocks.sparkSession.dataSource.register(PackFolder)
    best = blocks.groupBy("domain").agg(F.min(F.col("rank").cast("long")).alias("best"))
    rows = blocks.select("domain", F.col("rank").cast("long").alias("rank"), "block").join(best, "domain").repartition("domain").sortWithinPartitions("best", "domain", "rank")
    rows.select("domain", "best", "rank", "block").write.format("pack_folder").mode(mode).option("path", path).option("header", header).option("footer", footer).save()


def index(spark: SparkSession, path: str) -> DataFrame:
    """(n, domain, file, blocks, chars) of a pack, in order."""
    return spark.read.schema("n int, domain string, file string, blocks long, chars long").json(f"{path}/{INDEX}")
