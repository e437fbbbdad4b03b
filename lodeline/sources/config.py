"""Settings of a project: a YAML or JSON file, read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

try:
    import yaml
except ImportError:
    yaml = None

NAMES = (".lodeline/config.yaml", ".lodeline/config.json")


class ConfigError(ValueError):
    """The file is no mapping, can't be parsed, or has a value of the wrong kind."""


@dataclass
class Config:
    project: str = ""
    depth: int = 6
    max_bytes: int = 5 << 20
    max_tokens: int | None = None
    profiles: dict[str, list[str]] = field(default_factory=dict)
    rules: list[str] = field(default_factory=list)


def load(root: str) -> Config:
    """The settings below root, defaults where there are none or null; unknown keys are passed over."""
    for name in NAMES:
        path = os.path.join(root, name)
        if not os.path.exists(path):
            continue
        text = open(path, encoding="utf-8").read()
        try:
            raw = json.loads(text) if name.endswith("json") or yaml is None else yaml.safe_load(text)
        except Exception as e:
            raise ConfigError(f"{path}: {e}") from e
        if raw is None:
            return Config()
        if not isinstance(raw, dict):
            raise ConfigError(f"{path}: a mapping is wanted")
        own = Config(**{f.name: raw[f.name] for f in fields(Config) if raw.get(f.name) is not None})
        for f, kind in (("project", str), ("depth", int), ("max_bytes", int), ("profiles", dict), ("rules", list)):
            if not isinstance(getattr(own, f), kind):
                raise ConfigError(f"{path}: {f} is to be a {kind.__name__}")
        return own
    return Config()


def initialise(root: str) -> bool:
    """Lays down the settings folder; False if there is one already."""
    path = os.path.join(root, NAMES[1])
    if any(os.path.exists(os.path.join(root, n)) for n in NAMES):
        return False
    os.makedirs(os.path.join(os.path.dirname(path), "packs"), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"project": os.path.basename(os.path.abspath(root)), "depth": 6}, f, indent=1)
    return True
