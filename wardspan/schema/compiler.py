"""From parsed types to a sealed schema: indexes, aliases, inheritance, collisions, targets, static checks."""

from __future__ import annotations

import re
from dataclasses import replace

from ..diag import Problems, SchemaError
from .model import KEY_KINDS, Constraint, Invariant, Property, Relation, Schema, Type, lower_snake
from .parser import RESERVED

PREFIX = "_target_"
PARAMETERS = re.compile(r"^[0-9]+$")


class Compiler:
    def __init__(self, name: str, source: str, types: list[Type], aliases: dict[str, Constraint], imports: dict[str, Schema], problems: Problems):
        self.name, self.source, self.aliases, self.imports, self.problems = name, source, dict(aliases), imports, problems
        self.types: dict[str, Type] = {}
        for t in types:
            if t.name in self.types:
                self.error("E_DUPLICATE_TYPE", f"{t.name} is declared twice", t.line)
            elif t.name in aliases:
                self.error("E_TYPE_COLLISION", f"{t.name} is a type and a data type", t.line)
            else:
                self.types[t.name] = t

    def error(self, code: str, message: str, line: int = 0) -> None:
        self.problems.add(code, message, self.source, line)

    def find(self, name: str) -> Type | None:
        alias, _, own = name.rpartition(".")
        if alias:
            return self.imports[alias].types.get(own) if alias in self.imports else None
        return self.types.get(own)

    def compile(self) -> Schema:
        self.aliases = {k: self.resolve(c, (k,)) for k, c in self.aliases.items()}
        self.types = {k: self.resolve_members(t) for k, t in self.types.items()}
        done: dict[str, Type] = {}
        for t in self.types.values():
            self.merge(t, done, ())
        self.types = {k: done[k] for k in self.types if k in done}
        for t in self.types.values():
            self.check_names(t)
            self.check_targets(t)
            for i in t.invariants:
                self.check_expression(i.expression, t, frozenset(), i)
        if not self.problems.ok:
            raise SchemaError(self.problems)
        return Schema(self.name, self.source, self.types, self.aliases, self.imports)

    # Aliases
    def resolve(self, c: Constraint, path: tuple[str, ...] = ()) -> Constraint:
        if c.kind == "List":
            return replace(c, element=self.resolve(c.element, path))
        if c.kind != "Alias":
            return c
        if c.name in path:
            self.error("E_INVALID_CONSTRAINT", f"data type {c.name} refers to itself")
            return Constraint("Unknown", name=c.name)
        alias, _, own = c.name.rpartition(".")
        if alias:
            found = self.imports[alias].aliases.get(own) if alias in self.imports else None
            return found or Constraint("Unknown", name=c.name)
        if own in self.aliases:
            return self.resolve(self.aliases[own], (*path, own))
        self.problems.add("E_UNKNOWN_TYPE", f"data type {c.name} is unknown; its values will not match", self.source, severity="warning")
        return Constraint("Unknown", name=c.name)

    def resolve_members(self, t: Type) -> Type:
        properties = tuple(replace(p, constraint=self.resolve(p.constraint)) for p in t.properties)
        relations = []
        for r in t.relations:
            edge = tuple(replace(p, constraint=self.resolve(p.constraint)) for p in r.properties)
            for p in edge:
                if p.constraint.kind == "Vector":
                    self.error("E_INVALID_CONSTRAINT", f"{t.name}.{r.name}.{p.name}: no Vector on an edge", p.line)
                if p.constraint.kind == "List":
                    self.error("E_LIST_ON_EDGE", f"{t.name}.{r.name}.{p.name}: no List on an edge", p.line)
            relations.append(replace(r, properties=edge))
        for p in properties:
            if p.primary and p.constraint.kind not in KEY_KINDS:
                self.error("E_INVALID_PRIMARY_KEY_TYPE", f"{t.name}.{p.name}: {p.constraint.kind} can't be a key", p.line)
        return replace(t, properties=properties, relations=tuple(relations))

    # Inheritance
    def merge(self, t: Type, done: dict[str, Type], path: tuple[str, ...]) -> Type | None:
        """Ancestors depth first, left to right, before their heirs; own members first, then theirs, first of a name kept."""
        if t.name in done:
            return done[t.name]
        if t.name in path:
            self.error("E_INHERIT_CYCLE", " -> ".join([*path[path.index(t.name) :], t.name]), t.line)
            return None
        parents = []
        for name in t.extends:
            p = self.find(name)
            if p is None:
                self.error("E_UNKNOWN_TYPE", f"{t.name} extends {name}, which is unknown", t.line)
                continue
            if "." not in name:
                p = self.merge(p, done, (*path, t.name))
            if p is not None:
                parents.append((name, p))
        ancestors: list[str] = []
        for name, p in parents:
            for a in (*p.ancestors, name):
                if a not in ancestors:
                    ancestors.append(a)
        properties = self.merge_properties(t, [p for _, p in parents])
        relations = self.merge_relations(t, [p for _, p in parents])
        invariants: list[Invariant] = list(t.invariants)
        for _, p in parents:
            for i in p.all_invariants:
                if all(i.message != x.message for x in invariants):
                    invariants.append(i)
        out = replace(t, all_properties=properties, all_relations=relations, all_invariants=tuple(invariants), ancestors=tuple(ancestors))
        done[t.name] = out
        return out

    def merge_properties(self, t: Type, parents: list[Type]) -> tuple[Property, ...]:
        out: list[Property] = []
        for p in t.properties:
            if any(p.name == x.name for x in out):
                self.error("E_DUPLICATE_PROPERTY", f"{t.name}.{p.name} is declared twice", p.line)
            else:
                out.append(p)
        own = {p.name for p in out}
        for parent in parents:
            for p in parent.all_properties:
                have = next((x for x in out if x.name == p.name), None)
                if have is None:
                    out.append(p)
                elif have.name in own:
                    if not have.constraint.narrows(p.constraint) or (have.optional and not p.optional) or (p.primary and not have.primary):
                        self.error("E_PROPERTY_CONFLICT", f"{t.name}.{p.name} doesn't narrow {parent.name}.{p.name}", have.line)
                elif replace(have, owner="", line=0) != replace(p, owner="", line=0):
                    self.error("E_PROPERTY_CONFLICT", f"{t.name} inherits unlike {p.name}", t.line)
        return tuple(out)

    def merge_relations(self, t: Type, parents: list[Type]) -> tuple[Relation, ...]:
        out: list[Relation] = []
        for r in t.relations:
            if any(r.name == x.name for x in out):
                self.error("E_DUPLICATE_RELATION", f"{t.name}.{r.name} is declared twice", r.line)
            else:
                out.append(r)
        for parent in parents:
            for r in parent.all_relations:
                have = next((x for x in out if x.name == r.name), None)
                if have is None:
                    out.append(r)
                elif not have.same(r):
                    self.error("E_RELATION_COLLISION", f"{t.name} has unlike relations {r.name}", t.line)
        return tuple(out)

    # Names and targets
    def check_names(self, t: Type) -> None:
        seen: dict[str, str] = {}
        for p in t.all_properties:
            if p.name.startswith(PREFIX) or p.name.lower().startswith(PREFIX):
                self.error("E_RESERVED_PREFIX", f"{t.name}.{p.name} begins with {PREFIX}", p.line)
            if seen.setdefault(p.name.lower(), p.name) != p.name:
                self.error("E_CASE_COLLISION", f"{t.name}.{p.name} and {seen[p.name.lower()]} differ in case only", p.line)
        fields: dict[str, str] = {}
        for r in t.all_relations:
            if r.field in seen:
                self.error("E_PROPERTY_RELATION_COLLISION", f"{t.name}.{r.name} has the field of property {r.field}", r.line)
            if fields.setdefault(r.field, r.name) != r.name:
                self.error("E_RELATION_NORMALIZATION_COLLISION", f"{t.name}.{r.name} and {fields[r.field]} have the same field", r.line)
            if any(p.name.lower().startswith(PREFIX) for p in r.properties):
                self.error("E_RESERVED_PREFIX", f"a property of {t.name}.{r.name} begins with {PREFIX}", r.line)
            names = [p.name.lower() for p in r.properties]
            if len(set(names)) < len(names):
                self.error("E_DUPLICATE_PROPERTY", f"{t.name}.{r.name} repeats a property", r.line)

    def check_targets(self, t: Type) -> None:
        for r in t.relations:
            target = self.find(r.target)
            if target is None:
                self.error("E_UNKNOWN_TYPE", f"{t.name}.{r.name}: {r.target} is unknown", r.line)
            elif r.composition and (not target.part or target.abstract):
                self.error("E_INVALID_COMPOSITION_TARGET", f"{t.name}.{r.name}: {r.target} is no concrete part type", r.line)
            elif not r.composition and target.part:
                self.error("E_INVALID_ASSOCIATION_TARGET", f"{t.name}.{r.name}: {r.target} is a part type", r.line)
        if t.part and any(not r.composition for r in t.all_relations):
            self.error("E_INVALID_RELATION", f"part type {t.name} declares an association", t.line)

    # Invariants
    def check_expression(self, e: tuple, t: Type, bound: frozenset[str], i: Invariant) -> None:
        """Names must be properties or fields of relations; $names must be bound or properties."""
        kind = e[0]
        if kind in ("name", "rel"):
            name = e[1].lower()
            known = {p.name.lower() for p in t.all_properties} | {r.field for r in t.all_relations} | {lower_snake(r.name) for r in t.all_relations} | bound
            if name not in known:
                self.error("E_UNKNOWN_PROPERTY", f"{t.name}, invariant {i.message!r}: {e[1]} is unknown", i.line)
        elif kind == "var":
            if not PARAMETERS.match(e[1]) and e[1] not in bound and t.property(e[1]) is None and e[1] != "self":
                self.error("E_UNKNOWN_PROPERTY", f"{t.name}, invariant {i.message!r}: ${e[1]} is unknown", i.line)
        elif kind == "call":
            _, receiver, _, args, params, body = e
            self.check_expression(receiver, t, bound, i)
            for a in args:
                self.check_expression(a, t, bound, i)
            if body is not None:
                self.check_expression(body, t, bound | frozenset(params) | {"acc", "it"} & set(params), i)
        elif kind == "dot":
            self.check_expression(e[1], t, bound, i)
        elif kind in ("neg", "not"):
            self.check_expression(e[1], t, bound, i)
        elif kind == "list":
            for x in e[1]:
                self.check_expression(x, t, bound, i)
        elif kind == "at":
            self.check_expression(e[1], t, bound, i)
            for x in e[2]:
                self.check_expression(x, t, bound, i)
        elif kind == "op":
            self.check_expression(e[2], t, bound, i)
            self.check_expression(e[3], t, bound, i)
        elif kind == "if":
            for x in e[1:]:
                if x is not None:
                    self.check_expression(x, t, bound, i)


def compile_schema(name: str, types: list[Type], aliases: dict[str, Constraint] | None = None, imports: dict[str, Schema] | None = None, source: str = "", problems: Problems | None = None) -> Schema:
    return Compiler(name, source, types, aliases or {}, imports or {}, problems if problems is not None else Problems()).compile()


def check_alias(alias: str, taken: set[str], problems: Problems, source: str, line: int) -> bool:
    if alias in RESERVED or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", alias):
        problems.add("E_INVALID_ALIAS", f"{alias!r} can't be an alias", source, line)
        return False
    if alias in taken:
        problems.add("E_IMPORT_ALIAS_COLLISION", f"alias {alias} is taken", source, line)
        return False
    return True
