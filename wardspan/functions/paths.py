"""Paths into instances: $, .key, ["key"], [0] and [pk="v", ...]."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from ..schema.model import Schema, Type

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Path:
    """Steps: a key (str), an index (int) or a child's key ((name, value), ...)."""

    steps: tuple[str | int | tuple[tuple[str, str], ...], ...] = ()

    def key(self, name: str) -> Path:
        return Path((*self.steps, name))

    def index(self, at: int) -> Path:
        if at < 0:
            raise PathError("an index is not negative")
        return Path((*self.steps, at))

    def child(self, **keys: str) -> Path:
        return Path((*self.steps, tuple(keys.items())))

    def __str__(self) -> str:
        out = "$"
        for s in self.steps:
            if isinstance(s, int):
                out += f"[{s}]"
            elif isinstance(s, tuple):
                out += "[" + ",".join(f"{k}={json.dumps(v, ensure_ascii=False)}" for k, v in s) + "]"
            else:
                out += f".{s}" if _NAME.fullmatch(s) else f"[{json.dumps(s, ensure_ascii=False)}]"
        return out


def parse_path(text: str) -> Path:
    if not text.startswith("$"):
        raise PathError("a path begins with $")
    path, at = Path(), 1

    def take(pattern: re.Pattern, what: str) -> str:
        nonlocal at
        m = pattern.match(text, at)
        if not m:
            raise PathError(f"{what} expected at {at}")
        at = m.end()
        return m[0]

    def expect(c: str) -> None:
        nonlocal at
        if text[at : at + 1] != c:
            raise PathError(f"{c!r} expected at {at}")
        at += 1

    while at < len(text):
        if text[at] == ".":
            at += 1
            path = path.key(take(_NAME, "a name"))
            continue
        expect("[")
        if text[at : at + 1] == '"':
            path = path.key(json.loads(take(_STRING, "a string")))
        elif text[at : at + 1].isdigit():
            path = path.index(int(take(re.compile(r"[0-9]+"), "an index")))
        else:
            keys = []
            while True:
                name = take(_NAME, "a key's name")
                expect("=")
                keys.append((name, json.loads(take(_STRING, "a string"))))
                if text[at : at + 1] != ",":
                    break
                at += 1
            path = Path((*path.steps, tuple(keys)))
        expect("]")
    return path


def check_path(path: Path, schema: Schema, type_name: str) -> Type:
    """The type that a path of a type's instance ends in; PathError if the schema has no such place."""
    t = schema.find(type_name)
    for s in path.steps:
        if isinstance(s, str):
            relation = next((r for r in t.all_relations if r.field == s), None)
            if relation is not None:
                t = schema.find(relation.target)
            elif t.property(s) is None:
                raise PathError(f"{t.name} has no {s}")
        elif isinstance(s, tuple) and {k for k, _ in s} != {k.name for k in t.keys}:
            raise PathError(f"{t.name} has other keys")
    return t
