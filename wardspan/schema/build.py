"""A fluent builder of schemas."""

from __future__ import annotations

from .compiler import compile_schema
from .model import MULTIPLICITY, Constraint, Invariant, Property, Relation, Schema, Type
from .parser import parse_expression


def integer(low=None, high=None) -> Constraint:
    return Constraint("Integer", low, high)


def floating(low=None, high=None) -> Constraint:
    return Constraint("Float", low, high)


def string(low=None, high=None) -> Constraint:
    return Constraint("String", low, high)


def enum(*values: str) -> Constraint:
    return Constraint("Enum", values=values)


def pattern(*values: str) -> Constraint:
    return Constraint("Pattern", values=values)


def vector(size: int) -> Constraint:
    return Constraint("Vector", size=size)


def list_of(element: Constraint, low=None, high=None) -> Constraint:
    return Constraint("List", low, high, element=element)


def alias(name: str) -> Constraint:
    return Constraint("Alias", name=name)


def timestamp(layout: str | None = None) -> Constraint:
    return Constraint("Timestamp", format=layout)


boolean, date, uuid = Constraint("Boolean"), Constraint("Date"), Constraint("UUID")


class TypeBuilder:
    def __init__(self, owner: SchemaBuilder, name: str, abstract: bool, part: bool, extends: tuple[str, ...]):
        self.owner, self.name, self.abstract, self.part, self.parents = owner, name, abstract, part, extends
        self.properties: list[Property] = []
        self.relations: list[Relation] = []
        self.invariants: list[Invariant] = []

    def key(self, name: str, constraint: Constraint) -> TypeBuilder:
        self.properties.append(Property(name, constraint, False, True, self.name))
        return self

    def required(self, name: str, constraint: Constraint) -> TypeBuilder:
        self.properties.append(Property(name, constraint, False, False, self.name))
        return self

    def optional(self, name: str, constraint: Constraint) -> TypeBuilder:
        self.properties.append(Property(name, constraint, True, False, self.name))
        return self

    def _relation(self, name: str, target: str, multiplicity: str, composition: bool, edge) -> TypeBuilder:
        optional, many = MULTIPLICITY[multiplicity]
        properties = tuple(Property(n, c, not required, False, self.name) for n, c, required in edge)
        self.relations.append(Relation(name, target, optional, many, composition, properties, owner=self.name))
        return self

    def association(self, name: str, target: str, multiplicity: str = "", edge: tuple = ()) -> TypeBuilder:
        """edge: (name, constraint, required) of the edge's properties."""
        return self._relation(name, target, multiplicity, False, edge)

    def composition(self, name: str, target: str, multiplicity: str = "") -> TypeBuilder:
        return self._relation(name, target, multiplicity, True, ())

    def invariant(self, message: str, expression: str) -> TypeBuilder:
        self.invariants.append(Invariant(message, parse_expression(expression), self.name))
        return self

    def end(self) -> SchemaBuilder:
        return self.owner


class SchemaBuilder:
    def __init__(self, name: str, source: str = ""):
        self.name, self.source = name, source
        self.types: list[TypeBuilder] = []
        self.aliases: dict[str, Constraint] = {}
        self.imports: dict[str, Schema] = {}

    def type(self, name: str, abstract: bool = False, part: bool = False, extends: tuple[str, ...] = ()) -> TypeBuilder:
        self.types.append(TypeBuilder(self, name, abstract, part, extends))
        return self.types[-1]

    def data_type(self, name: str, constraint: Constraint) -> SchemaBuilder:
        self.aliases[name] = constraint
        return self

    def uses(self, alias_name: str, schema: Schema) -> SchemaBuilder:
        self.imports[alias_name] = schema
        return self

    def build(self) -> Schema:
        types = [Type(b.name, b.abstract, b.part, tuple(b.parents), tuple(b.properties), tuple(b.relations), tuple(b.invariants)) for b in self.types]
        return compile_schema(self.name, types, self.aliases, self.imports, self.source)
