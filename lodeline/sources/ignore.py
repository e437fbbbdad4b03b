"""Ignore patterns in gitignore syntax, compiled to regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from fnmatch import fnmatchcase

#: Defaults of our own.
DEFAULTS = (".git/", "node_modules/", "__pycache__/", "dist/", "build/", ".venv/", "venv/", "target/", "*.egg-info/", "*.pyc", ".DS_Store")
SECRET_FOLDERS = (".ssh", ".aws", ".gnupg")
SECRET_FILES = (".env*", "*.key", "*.pem", "id_rsa*", "*.pfx", "credentials.json", ".netrc")


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + f"[{'^' + body[1:] if body[0] in '!^' else body}]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


@dataclass
class Ignore:
    """The last pattern that matches decides; what lies below an ignored folder stays ignored. Secrets always are."""

    rules: list[tuple[bool, bool, re.Pattern]]  # (ignores, folders only, pattern)

    @classmethod
    def of(cls, lines: Iterable[str], defaults: bool = True) -> Ignore:
        rules = []
        for line in [*(DEFAULTS if defaults else ()), *lines]:
            text = line.rstrip("\r\n").rstrip(" ") if not line.rstrip("\r\n").endswith("\\ ") else line.rstrip("\r\n")
            if not text or text.startswith("#"):
                continue
            negated, text = text.startswith("!"), text.removeprefix("!").removeprefix("\\")
            folder, text = text.endswith("/"), text.rstrip("/")
            anchored = "/" in text
            rules.append((not negated, folder, re.compile(("" if anchored else "(?:.*/)?") + _regex(text.removeprefix("/")) + r"\Z", re.S)))
        return cls(rules)

    def _own(self, path: str, folder: bool) -> bool:
        hit = False
        for ignores, only, pattern in self.rules:
            if (folder or not only) and pattern.match(path):
                hit = ignores
        return hit

    def secret(self, path: str) -> bool:
        *folders, name = path.split("/")
        return any(f in SECRET_FOLDERS for f in [*folders, name]) or any(fnmatchcase(name, p) for p in SECRET_FILES)

    def ignores(self, path: str, folder: bool = False) -> bool:
        """Of a path relative to the root, with `/`; one that leads outside the root is ignored."""
        parts = path.strip("/").split("/")
        if ".." in parts or self.secret("/".join(parts)):
            return True
        return any(self._own("/".join(parts[:i]), folder or i < len(parts)) for i in range(1, len(parts) + 1))
