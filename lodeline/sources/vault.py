"""The rules that a project keeps: a JSON file below its settings folder, read on the driver as a DataFrame and replaced as a whole."""

from __future__ import annotations

import json
import os
import shutil
import time
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

NAME = ".lodeline/memory.json"
FIELDS = ("id", "name", "category", "rule", "confidence", "source", "created_at")
SCHEMA = "id string, name string, category string, rule string, confidence double, source string, created_at string"


class VaultError(ValueError):
    """The file can't be parsed, a rule lacks what it needs, or the vault is held by somebody else."""


def load(spark: SparkSession, root: str) -> DataFrame:
    """The vault's rules; none if there is no file, if it is empty, or, with a warning, if it holds anything but a mapping."""
    path = os.path.join(root, NAME)
    text = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
    try:
        raw = json.loads(text) if text.strip() else {}
    except ValueError as e:
        raise VaultError(f"{path}: {e}") from e
    if not isinstance(raw, dict):
        warnings.warn(f"{path} holds no mapping; it counts as empty", stacklevel=2)
        raw = {}
    rows = []
    for r in raw.get("rules") or []:
        if not isinstance(r, dict) or any(not isinstance(r.get(k), str) for k in ("id", "category", "rule")) or not isinstance(r.get("confidence"), (int, float)):
            raise VaultError(f"{path}: a rule needs id, category, rule and confidence: {r}")
        rows.append(tuple(float(r[k]) if k == "confidence" else r.get(k) for k in FIELDS))
    return spark.createDataFrame(rows, SCHEMA)


@contextmanager
def held(root: str, seconds: float = 5.0) -> Iterator[None]:
    """The vault's lock, waited for up to `seconds`."""
    path = os.path.join(root, NAME + ".lock")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    end = time.monotonic() + seconds
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.monotonic() > end:
                raise VaultError(f"{path} is held by somebody else") from None
            time.sleep(0.05)
    try:
        yield
    finally:
        os.unlink(path)


def save(rules: DataFrame, root: str) -> int:
    """Writes the rules, by category and id, in place of the file, of which a copy stays beside it; how many there are. A vault is what one project has learnt: it fits the driver."""
    path = os.path.join(root, NAME)
    rows = [r.asDict() for r in rules.select(*FIELDS).orderBy("category", "id").collect()]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if os.path.exists(path):
        shutil.copy2(path, path + ".bak")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump({"rules": rows}, f, indent=1)
    os.replace(path + ".new", path)
    return len(rows)
