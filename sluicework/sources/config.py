"""Layered configuration: nearer files override farther ones."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from . import yaml

NAME = "sluicework.yaml"


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    rules: dict[str, bool] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    source_dirs: list[str] = field(default_factory=lambda: ["lib", "bin"])
    a11y: bool = True
    update_check: bool = True


def parse(text: str) -> dict:
    """The top-level map of a configuration; an empty text is an empty one."""
    try:
        value = yaml.load(text)
    except yaml.YamlError as e:
        raise ConfigError(str(e)) from e
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError("a configuration must be a map")
    return value


def _strings(name: str, value) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ConfigError(f"{name} must be a list of strings")
    return value


def _top_dirs(value) -> list[str]:
    """The first segments of directories, each once."""
    if not all(v.strip() for v in _strings("source_dirs", value)):
        raise ConfigError("source_dirs must not have an empty entry")
    tops = [v.strip().replace("\\", "/").split("/")[0] for v in value]
    return list(dict.fromkeys(t for t in tops if t))


def merge(layers: list[dict], known: Iterable[str] | None = None) -> Config:
    """layers from the farthest to the nearest: toggles one by one, globs all together, the others as a whole.

    known: the rules that may be named, if given.
    """
    c = Config()
    for layer in layers:
        rules = layer.get("rules")
        if rules is not None:
            if not isinstance(rules, dict) or not all(isinstance(v, bool) for v in rules.values()):
                raise ConfigError("rules must map ids to true or false")
            for rule in rules:
                if known is not None and rule not in known:
                    raise ConfigError(f"there is no rule {rule}")
            c.rules |= {str(k): v for k, v in rules.items()}
        if layer.get("ignore") is not None:
            c.ignore = list(dict.fromkeys([*c.ignore, *_strings("ignore", layer["ignore"])]))
        if layer.get("source_dirs") is not None:
            c.source_dirs = _top_dirs(layer["source_dirs"])
        for name in ("a11y", "update_check"):
            if layer.get(name) is not None:
                if not isinstance(layer[name], bool):
                    raise ConfigError(f"{name} must be true or false")
                setattr(c, name, layer[name])
    return c


def discover(root: str, known: Iterable[str] | None = None) -> Config:
    """Merges the files from the repository's root (the folder with .git) down to the project's root.

    Without a repository around it only the project's own file counts.
    """
    chain = [os.path.abspath(root)]
    while not os.path.exists(os.path.join(chain[-1], ".git")):
        above = os.path.dirname(chain[-1])
        if above == chain[-1]:
            chain = chain[:1]
            break
        chain.append(above)
    found = []
    for folder in reversed(chain):
        path = os.path.join(folder, NAME)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                found.append(parse(f.read()))
    return merge(found, known)


SCAFFOLD = """# Checks of this project.
rules: {}
source_dirs:
  - lib
  - bin
ignore: []
a11y: true
"""


def scaffold(root: str) -> bool:
    """Writes a first file; false if there is one."""
    path = os.path.join(root, NAME)
    if os.path.exists(path):
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(SCAFFOLD)
    return True
