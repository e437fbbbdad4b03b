"""A Python data source over a folder tree: path, length, mtime and, on demand, content.

Spark's file sources leave out names that start with `_` or `.`; this one doesn't. The driver looks at folders only, breadth first, until there are enough of them to
deal out; executors walk the subtrees below, prune ignored folders and read what they find. No file's name is held on the driver. The tree lies where the driver and all
executors see it. Options: path, depth (none: unlimited; 0: the root's files), ignore (patterns, a line each), defaults, maxBytes, content, folders (looked at on the
driver at most), tasks (at most), pushdown: conditions on a path's beginning and on the length reach the walk. Spark 4.1 keeps what was pushed for a DataFrame that is used again without
conditions, so this is off unless asked for, by those who use the DataFrame for one query.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .ignore import Ignore

IGNORE_FILES = (".gitignore", ".ignore")


def ignore_lines(root: str) -> list[str]:
    out = []
    for name in IGNORE_FILES:
        try:
            raw = open(os.path.join(root, name), "rb").read()
        except OSError:
            continue
        for code in ("utf-8-sig", "utf-16", "latin-1"):
            try:
                out += raw.decode(code).splitlines()
                break
            except UnicodeError:
                continue
    return out


def walk(root: str, depth: int | None, ignore: Ignore, start: str = "", level: int = 0, below: bool = True, prefix: str = "") -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime) of files below start, a folder `level` below root, in path order; links aren't followed. below: its subfolders too. prefix: only paths that begin so."""
    stack = [(start, level)]
    while stack:
        folder, level = stack.pop()
        folders = []
        for e in sorted(_entries(root, folder), key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if below and (depth is None or level < depth) and _leads_to(path, prefix) and not ignore.ignores(path, True):
                    folders.append((path, level + 1))
            elif path.startswith(prefix) and e.is_file(follow_symlinks=False) and not ignore.ignores(path):
                s = e.stat(follow_symlinks=False)
                yield path, s.st_size, s.st_mtime
        stack += reversed(folders)


def _entries(root: str, folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            yield from found
    except OSError:
        return


def _leads_to(folder: str, prefix: str) -> bool:
    """Whether files below the folder may have paths that begin with prefix."""
    return f"{folder}/".startswith(prefix) or prefix.startswith(f"{folder}/")


class _Folders(InputPartition):
    """Folders to walk: (folder, its level, whether its subfolders belong to it)."""

    def __init__(self, folders: list[tuple[str, int, bool]]):
        self.folders = folders


#: Whether a length is asked for, by the filter's kind.
_LENGTHS = {EqualTo: lambda x, v: x == v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.depth = int(options["depth"]) if "depth" in options else None
        self.most = int(options.get("maxbytes", 5 << 20))
        self.content = options.get("content", "true").lower() == "true"
        self.folders, self.tasks = int(options.get("folders", 512)), int(options.get("tasks", 64))
        own = options.get("ignore", "").splitlines()
        self.ignore = Ignore.of([*ignore_lines(self.root), *own], options.get("defaults", "true").lower() == "true")
        self.prefix, self.path, self.lengths = "", None, []

    def _start(self) -> str:
        """What all paths begin with."""
        return self.prefix if self.path is None else max(self.prefix, self.path, key=len)

    def partitions(self) -> list[InputPartition]:
        """Subtrees, from a breadth-first look at up to `folders` folders; a folder with more subfolders than that is dealt out whole."""
        start, todo, units, seen = self._start(), [("", 0)], [], 0
        while todo and seen < self.folders and len(todo) + len(units) < self.folders:
            folder, level = todo.pop(0)
            seen += 1
            below, whole = [], False
            if self.depth is None or level < self.depth:
                for e in _entries(self.root, folder):
                    path = f"{folder}/{e.name}" if folder else e.name
                    if not e.is_symlink() and e.is_dir(follow_symlinks=False) and _leads_to(path, start) and not self.ignore.ignores(path, True):
                        below.append((path, level + 1))
                        if whole := len(below) + len(todo) + len(units) >= 2 * self.folders:
                            break
            units.append((folder, level, whole))
            todo += [] if whole else sorted(below)
        units += [(folder, level, True) for folder, level in todo]
        n = min(self.tasks, len(units))
        return [_Folders(units[k::n]) for k in range(n)]

    def read(self, partition: _Folders):
        start = self._start()
        for folder, level, below in partition.folders:
            for path, length, mtime in walk(self.root, self.depth, self.ignore, folder, level, below, start):
                if (self.path is not None and (path != self.path or not path.startswith(self.prefix))) or not all(_LENGTHS[kind](length, v) for kind, v in self.lengths):
                    continue
                body, error = None, None
                if self.content:
                    if length > self.most:
                        error = f"over {self.most} bytes"
                    else:
                        try:
                            with open(os.path.join(self.root, path), "rb") as f:
                                body = f.read()
                        except OSError as e:
                            error = e.strerror
                yield path, length, mtime, body, error


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on the beginning of path, on path and on length; others stay with Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and self.path is None:
                self.path = f.value
            elif type(f) in _LENGTHS and f.attribute == ("length",):
                self.lengths.append((type(f), f.value))
            else:
                yield f


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "path string, length long, mtime double, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known; its filters need Spark's setting for them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoTree)


def project_root(start: str, markers: tuple[str, ...] = (".lodeline", ".git", "pyproject.toml", "package.json")) -> str | None:
    """The nearest folder at or above start that has a marker."""
    here = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(here, m)) for m in markers):
            return here
        up = os.path.dirname(here)
        if up == here:
            return None
        here = up


def safe_path(path: str, root: str) -> str:
    """The real path of one that stays below root, or ValueError."""
    real, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([real, base]) != base:
        raise ValueError(f"{path} leads out of {root}")
    return real
