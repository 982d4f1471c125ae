"""The compiled model of a schema: plain frozen records, made once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: Multiplicities as written, and (optional, many) for each.
MULTIPLICITY = {"": (True, False), "_": (True, False), "_:one": (True, False), "_:many": (True, True), "one": (False, False), "one:one": (False, False), "many": (True, True), "one:many": (False, True)}
KEY_KINDS = ("String", "UUID", "Date", "Timestamp")
MAX_DIMENSIONS = 65_536


@dataclass(frozen=True)
class Constraint:
    """kind is a built-in name, or Alias with a name to resolve."""

    kind: str
    low: float | int | None = None
    high: float | int | None = None
    values: tuple[str, ...] = ()
    element: Constraint | None = None
    size: int = 0
    format: str | None = None
    name: str = ""

    def narrows(self, wider: Constraint) -> bool:
        """Whether every value of this is one of the wider's."""
        if self.kind != wider.kind:
            return False
        if self.kind in ("Integer", "Float", "String", "List"):
            inside = (wider.low is None or (self.low is not None and self.low >= wider.low)) and (wider.high is None or (self.high is not None and self.high <= wider.high))
            return inside and (self.kind != "List" or self.element.narrows(wider.element))
        if self.kind == "Enum":
            return set(self.values) <= set(wider.values)
        return self == wider


@dataclass(frozen=True)
class Property:
    name: str
    constraint: Constraint
    optional: bool = True
    primary: bool = False
    owner: str = ""
    line: int = 0


@dataclass(frozen=True)
class Relation:
    name: str
    target: str
    optional: bool = True
    many: bool = False
    composition: bool = False
    properties: tuple[Property, ...] = ()
    reverse: str = ""
    reverse_many: bool = False
    owner: str = ""
    line: int = 0

    @property
    def field(self) -> str:
        return lower_snake(self.name)

    def same(self, other: Relation) -> bool:
        return replace(self, owner="", line=0) == replace(other, owner="", line=0)


@dataclass(frozen=True)
class Invariant:
    message: str
    expression: tuple
    owner: str = ""
    line: int = 0


@dataclass(frozen=True)
class Type:
    name: str
    abstract: bool = False
    part: bool = False
    extends: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()
    relations: tuple[Relation, ...] = ()
    invariants: tuple[Invariant, ...] = ()
    line: int = 0
    #: Merged members and ancestors, filled in by the compiler.
    all_properties: tuple[Property, ...] = ()
    all_relations: tuple[Relation, ...] = ()
    all_invariants: tuple[Invariant, ...] = ()
    ancestors: tuple[str, ...] = ()

    @property
    def keys(self) -> tuple[Property, ...]:
        return tuple(p for p in self.all_properties if p.primary)

    def property(self, name: str) -> Property | None:
        return next((p for p in self.all_properties if p.name == name), None)

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.all_relations if r.name == name or r.field == name), None)


@dataclass(frozen=True)
class Schema:
    name: str
    source: str = ""
    types: dict[str, Type] = field(default_factory=dict)
    aliases: dict[str, Constraint] = field(default_factory=dict)
    imports: dict[str, Schema] = field(default_factory=dict)

    def find(self, name: str) -> Type | None:
        """A local type, or one of a direct import by alias.Name."""
        if "." in name:
            alias, _, own = name.partition(".")
            other = self.imports.get(alias)
            return other.types.get(own) if other else None
        return self.types.get(name)

    def type_id(self, name: str) -> str:
        """Identity across files: the schema's source and the type's name."""
        alias, _, own = name.rpartition(".")
        schema = self.imports[alias] if alias else self
        return f"{schema.source or schema.name}#{own}"

    def subtypes(self, name: str) -> list[str]:
        return sorted(t.name for t in self.types.values() if name in t.ancestors)


_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def lower_snake(name: str) -> str:
    """worksAt, WorksAt, WORKS_AT -> works_at; HTTPServer -> http_server."""
    return "_".join(w.lower() for part in name.split("_") for w in _WORDS.findall(part)) or name.lower()
