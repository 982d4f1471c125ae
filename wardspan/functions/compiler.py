"""Expressions to Columns.

An expression compiles to a value of a statically known kind and, if it can fail, an error: a nullable string Column. Nothing
throws when rows are evaluated: divisions, overflows and missing values are guarded, and errors become issues. Values follow a
total order (nil < bool < number < string < list), so null takes part in comparisons and three-valued logic stays out.

Where this is narrower than a dynamic language: lists have elements of one kind; integer overflow is an error; an integer and a
float are compared as doubles, exactly so up to 2^53.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema.model import Constraint, Type, lower_snake
from ..schema.parser import java_pattern, parse_expression

SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string", "nil": "string"}
RANK = {"nil": 0, "bool": 1, "int": 2, "float": 2, "str": 3}
#: Names that TypeOf gives.
TYPE_NAMES = {"str": "string", "int": "int64", "float": "float64", "bool": "bool", "nil": "nil"}
UUID_FORMS = r"^(?:(?:[uU][rR][nN]:[uU][uU][iI][dD]:)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\{[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}|[0-9a-fA-F]{32})\z"


class CompileError(ValueError):
    pass


@dataclass(frozen=True)
class Kind:
    """nil, bool, int, float, str, regex, list (of an element kind) or struct (of fields)."""

    name: str
    element: Kind | None = None
    fields: tuple[tuple[str, Kind], ...] = ()

    def spark(self) -> str:
        if self.name == "list":
            return f"array<{self.element.spark()}>"
        if self.name == "struct":
            return "struct<" + ",".join(f"`{n}`:{k.spark()}" for n, k in self.fields) + ">"
        return SPARK[self.name]

    @property
    def numeric(self) -> bool:
        return self.name in ("int", "float")


NIL, BOOL, INT, FLOAT, STR, REGEX = (Kind(k) for k in ("nil", "bool", "int", "float", "str", "regex"))


def list_kind(element: Kind) -> Kind:
    return Kind("list", element)


def kind_of(c: Constraint) -> Kind:
    if c.kind == "List":
        return list_kind(kind_of(c.element))
    return {"Integer": INT, "Float": FLOAT, "Boolean": BOOL, "Vector": list_kind(FLOAT)}.get(c.kind, STR)


@dataclass(frozen=True)
class Value:
    kind: Kind
    value: Column
    error: Column | None = None
    #: A literal's Python value, for patterns and type names.
    known: object = None


def first_error(*errors: Column | None) -> Column | None:
    there = [e for e in errors if e is not None]
    return None if not there else there[0] if len(there) == 1 else F.coalesce(*there)


def fail_if(condition: Column, message: str) -> Column:
    return F.when(condition, F.lit(message))


def null(kind: Kind) -> Column:
    return F.lit(None).cast(kind.spark())


def unify(a: Kind, b: Kind) -> Kind | None:
    """A kind that holds values of both, if there is one."""
    if a == b or b.name == "nil":
        return a
    if a.name == "nil":
        return b
    if a.numeric and b.numeric:
        return FLOAT
    if a.name == b.name == "list":
        element = unify(a.element, b.element)
        return list_kind(element) if element else None
    return None


def to_kind(v: Value, kind: Kind) -> Column:
    if v.kind == kind:
        return v.value
    if v.kind == NIL:
        return null(kind)
    if v.kind == list_kind(NIL):
        return F.transform(v.value, lambda x: null(kind.element))
    return v.value.cast(kind.spark())


@dataclass
class Scope:
    properties: dict[str, Value]
    variables: dict[str, Value] = field(default_factory=dict)
    #: Names that are nil in invariants: relations.
    absent: frozenset[str] = frozenset()

    def child(self, **more: Value) -> Scope:
        return Scope(self.properties, self.variables | more, self.absent)

    def name(self, name: str) -> Value | None:
        low = name.lower()
        for k, v in self.variables.items():
            if k.lower() == low:
                return v
        for k, v in self.properties.items():
            if k.lower() == low:
                return v
        return None


class ExpressionCompiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def compile(self, e: tuple, scope: Scope | None = None) -> Value:
        return getattr(self, f"_{e[0]}")(e, scope or self.scope)

    # Leaves
    def _lit(self, e, scope) -> Value:
        _, kind, value = e
        if kind == "regex":
            return Value(REGEX, F.lit(java_pattern(value)), known=java_pattern(value))
        if kind == "int" and not -(2**63) <= value < 2**63:
            raise CompileError(f"{value} is out of range")
        return Value(Kind(kind), F.lit(value).cast(SPARK[kind]), known=value)

    def _nil(self, e, scope) -> Value:
        return Value(NIL, null(NIL))

    def _type(self, e, scope) -> Value:
        return Value(Kind("type"), F.lit(e[1]), known=e[1])

    def _name(self, e, scope) -> Value:
        found = scope.name(e[1])
        return found if found is not None else Value(NIL, null(NIL))

    def _rel(self, e, scope) -> Value:
        if e[1] in ("Int", "Number", "Bool"):
            return Value(Kind("type"), F.lit(e[1]), known=e[1])
        found = scope.name(lower_snake(e[1]))
        return found if found is not None else Value(NIL, null(NIL))

    def _var(self, e, scope) -> Value:
        name = e[1]
        if name in scope.variables:
            return scope.variables[name]
        if name in scope.properties:
            return scope.properties[name]
        if name == "self":
            fields = tuple((k, v.kind) for k, v in scope.properties.items())
            return Value(Kind("struct", fields=fields), F.struct(*[v.value.alias(k) for k, v in scope.properties.items()]))
        if name.isdigit():
            return Value(NIL, null(NIL))
        return Value(NIL, null(NIL), F.lit(f"${name} is unknown"))

    def _list(self, e, scope) -> Value:
        items = [self.compile(x, scope) for x in e[1]]
        kind = NIL
        for x in items:
            merged = unify(kind, x.kind)
            if merged is None:
                raise CompileError("a list's elements have unlike kinds")
            kind = merged
        array = F.array(*[to_kind(x, kind) for x in items]) if items else F.array()
        return Value(list_kind(kind), array.cast(list_kind(kind).spark()), first_error(*[x.error for x in items]))

    # Operators
    def _neg(self, e, scope) -> Value:
        v = self.compile(e[1], scope)
        if not v.kind.numeric:
            return self._bad(v, FLOAT, "- needs a number")
        missing = fail_if(v.value.isNull(), "- needs a number")
        if v.kind == INT:
            return Value(INT, F.try_subtract(F.lit(0).cast("bigint"), v.value), first_error(v.error, missing, fail_if(v.value == -(2**63), "integer overflow")), -v.known if v.known is not None else None)
        return Value(FLOAT, -v.value, first_error(v.error, missing))

    def _bad(self, v: Value, kind: Kind, message: str) -> Value:
        return Value(kind, null(kind), first_error(v.error, F.lit(message)))

    def _bool(self, v: Value, what: str) -> tuple[Column, Column | None]:
        """A value as bool: nil is false, other kinds fail."""
        if v.kind == BOOL:
            return F.coalesce(v.value, F.lit(False)), v.error
        if v.kind == NIL:
            return F.lit(False), v.error
        return F.lit(False), first_error(v.error, fail_if(v.value.isNotNull(), f"{what} needs a bool"))

    def _strict(self, v: Value, what: str) -> tuple[Column, Column | None]:
        if v.kind == BOOL:
            return v.value, first_error(v.error, fail_if(v.value.isNull(), f"{what} needs a bool"))
        return F.lit(False), first_error(v.error, F.lit(f"{what} needs a bool"))

    def _not(self, e, scope) -> Value:
        value, error = self._strict(self.compile(e[1], scope), "!")
        return Value(BOOL, ~value, error)

    def _op(self, e, scope) -> Value:
        _, op, left, right = e
        if op in ("&&", "||"):
            return self._logic(op, left, right, scope)
        a, b = self.compile(left, scope), self.compile(right, scope)
        error = first_error(a.error, b.error)
        if op == "^":
            (x, ex), (y, ey) = self._strict(a, "^"), self._strict(b, "^")
            return Value(BOOL, x != y, first_error(ex, ey))
        if op in ("==", "!="):
            same = equal(a, b)
            return Value(BOOL, same if op == "==" else ~same, error)
        if op in ("<", "<=", ">", ">="):
            sign = compare(a, b)
            return Value(BOOL, {"<": sign < 0, "<=": sign <= 0, ">": sign > 0, ">=": sign >= 0}[op], error)
        if op == "in":
            return self._in(a, b, error)
        if op in ("=~", "!~"):
            found = self._match(a, b, error)
            return found if op == "=~" else Value(BOOL, ~found.value, found.error)
        return self._arithmetic(op, a, b, error)

    def _logic(self, op: str, left, right, scope) -> Value:
        a, ea = self._strict(self.compile(left, scope), op)
        b, eb = self._strict(self.compile(right, scope), op)
        decided = ~a if op == "&&" else a
        # The right side's errors count only where the left doesn't decide.
        late = F.when(ea.isNotNull(), F.lit(None)).when(decided, F.lit(None)).otherwise(eb) if ea is not None and eb is not None else F.when(~decided, eb) if eb is not None else None
        value = F.when(decided, F.lit(op == "||")).otherwise(b)
        return Value(BOOL, value, first_error(ea, late))

    def _if(self, e, scope) -> Value:
        c, ec = self._strict(self.compile(e[1], scope), "?")
        yes = self.compile(e[2], scope)
        if e[3] is None:
            return Value(yes.kind, null(yes.kind), F.lit("a choice needs both branches"))
        no = self.compile(e[3], scope)
        kind = unify(yes.kind, no.kind)
        if kind is None:
            raise CompileError("branches have unlike kinds")
        error = None
        if yes.error is not None or no.error is not None:
            text = F.lit(None).cast("string")
            error = F.when(c, yes.error if yes.error is not None else text).otherwise(no.error if no.error is not None else text)
        return Value(kind, F.when(c, to_kind(yes, kind)).otherwise(to_kind(no, kind)), first_error(ec, error))

    def _arithmetic(self, op: str, a: Value, b: Value, error) -> Value:
        if op == "+" and (a.kind.name == "list" or b.kind.name == "list"):
            kind = unify(a.kind, b.kind)
            if kind is None or kind.name != "list":
                raise CompileError("+ joins lists of one kind")
            empty = F.array().cast(kind.spark())
            return Value(kind, F.concat(F.coalesce(to_kind(a, kind), empty), F.coalesce(to_kind(b, kind), empty)), error)
        missing = fail_if(a.value.isNull() | b.value.isNull(), f"{op} needs two values")
        error = first_error(error, missing)
        if op == "+" and a.kind == b.kind == STR:
            return Value(STR, F.concat(a.value, b.value), error)
        if not (a.kind.numeric and b.kind.numeric):
            return Value(FLOAT, null(FLOAT), first_error(error, F.lit(f"{op} doesn't take {a.kind.name} and {b.kind.name}")))
        if a.kind == b.kind == INT:
            zero = b.value == 0
            if op in ("/", "%"):
                safe = F.when(zero, F.lit(None)).otherwise(b.value)
                least = (a.value == -(2**63)) & (b.value == -1)
                value = F.when(least, F.lit(None if op == "/" else 0)).otherwise(_div(a.value, safe) if op == "/" else a.value % safe)
                over = fail_if(least, "integer overflow") if op == "/" else None
                return Value(INT, value.cast("bigint"), first_error(error, fail_if(zero, "division by zero"), over))
            f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
            value = f(a.value, b.value)
            return Value(INT, value, first_error(error, fail_if(value.isNull() & a.value.isNotNull() & b.value.isNotNull(), "integer overflow")))
        x, y = to_kind(a, FLOAT), to_kind(b, FLOAT)
        if op == "%":
            return Value(INT, null(INT), first_error(error, F.lit("% needs integers")))
        if op == "/":
            by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when((x > 0) == (F.lit(1.0) * _sign_bit(y) > 0), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return Value(FLOAT, F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)), error)
        return Value(FLOAT, {"+": x + y, "-": x - y, "*": x * y}[op], error)

    def _in(self, a: Value, b: Value, error) -> Value:
        if b.kind == NIL:
            return Value(BOOL, F.lit(False), error)
        if b.kind.name != "list":
            return Value(BOOL, F.lit(False), first_error(error, F.lit("in needs a list")))
        return Value(BOOL, F.exists(_items(b), lambda x: equal(a, Value(b.kind.element, x))), error)

    def _match(self, a: Value, b: Value, error) -> Value:
        if b.kind.name == "type":
            return Value(BOOL, is_type(a, b.known), error if b.known not in ("Enum", "Pattern", "Vector", "List") else F.lit(f"{b.known} can't be matched"))
        if b.kind not in (REGEX, STR) or (b.kind == STR and b.known is None):
            return Value(BOOL, F.lit(False), first_error(error, F.lit("=~ needs a pattern")))
        pattern = b.known if b.kind == REGEX else java_pattern(b.known)
        if a.kind != STR:
            return Value(BOOL, F.lit(False), first_error(error, F.lit("=~ needs a string")))
        return Value(BOOL, F.coalesce(a.value.rlike(pattern), F.lit(False)), first_error(error, fail_if(a.value.isNull(), "=~ needs a string")))

    # Access and calls
    def _at(self, e, scope) -> Value:
        v, i = self.compile(e[1], scope), self.compile(e[2][0], scope) if e[2] else Value(NIL, null(NIL), F.lit("an index is missing"))
        error = first_error(v.error, i.error)
        if v.kind == NIL:
            return Value(NIL, null(NIL), error)
        if i.kind != INT:
            return Value(v.kind, null(v.kind), first_error(error, F.lit("an index is an integer")))
        at = F.when((i.value >= 0) & (i.value < 2**31 - 1), i.value.cast("int"))
        if v.kind == STR:
            return Value(STR, F.when(at < F.char_length(v.value), F.substring(v.value, at + 1, F.lit(1))), error)
        if v.kind.name != "list":
            return Value(NIL, null(NIL), first_error(error, F.lit(f"{v.kind.name} has no items")))
        return Value(v.kind.element, F.get(v.value, at), error)

    def _dot(self, e, scope) -> Value:
        from .builtins import BUILTINS

        _, left, name = e
        if name.lower() in BUILTINS:
            return self._call(("call", left, name, (), (), None), scope)
        v = self.compile(left, scope)
        if v.kind == NIL:
            return Value(NIL, null(NIL), v.error)
        if v.kind.name != "struct":
            return Value(NIL, null(NIL), first_error(v.error, fail_if(v.value.isNotNull(), f"{v.kind.name} has no members")))
        exact = [f for f in v.kind.fields if f[0] == name] or [f for f in v.kind.fields if f[0].lower() == name.lower()]
        if not exact:
            return Value(NIL, null(NIL), v.error)
        return Value(exact[0][1], v.value.getField(exact[0][0]), v.error)

    def _call(self, e, scope) -> Value:
        from .builtins import BUILTINS

        _, receiver, name, args, params, body = e
        f = BUILTINS.get(name.lower())
        if f is None:
            return Value(NIL, null(NIL), F.lit(f"unknown function {name}"))
        said = f.misuse(len(args), len(params), body is not None)
        if said:
            return Value(NIL, null(NIL), F.lit(f"{name}: {said}"))
        run = Call(self, scope, params, body)
        return f.build(run, self.compile(receiver, scope), [self.compile(a, scope) for a in args])


@dataclass
class Call:
    """A call's lambda, compiled for given values."""

    compiler: ExpressionCompiler
    scope: Scope
    params: tuple[str, ...]
    body: tuple | None

    def run(self, *values: Value) -> Value:
        """Parameters get the values in order; $0, $1, ... do too."""
        bound = {str(i): v for i, v in enumerate(values)} | dict(zip(self.params, values, strict=False))
        return self.compiler.compile(self.body, self.scope.child(**bound))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, cut off toward zero."""
    return F.try_divide((a - a % b).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("bigint")


def _sign_bit(y: Column) -> Column:
    """1 or -1; a zero's sign shows in its text."""
    return F.when(F.startswith(y.cast("string"), F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))


def _items(v: Value) -> Column:
    return F.coalesce(v.value, F.array().cast(v.kind.spark()))


def equal(a: Value, b: Value) -> Column:
    """Equality of the total order: null equals null, values of unlike kinds are unlike, never an error."""
    kind = unify(a.kind, b.kind)
    if kind is None or "struct" in (a.kind.name, b.kind.name):
        return a.value.isNull() & b.value.isNull()
    if NIL in (a.kind, b.kind):
        return a.value.isNull() & b.value.isNull()
    return to_kind(a, kind).eqNullSafe(to_kind(b, kind))


def compare(a: Value, b: Value) -> Column:
    """-1, 0 or 1 in the total order."""
    kind = unify(a.kind, b.kind)
    if kind is not None and NIL not in (a.kind, b.kind):
        x, y = to_kind(a, kind), to_kind(b, kind)
        sign = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    else:
        ranks = [4 if v.kind.name == "list" else RANK.get(v.kind.name, 5) for v in (a, b)]
        sign = F.lit((ranks[0] > ranks[1]) - (ranks[0] < ranks[1]))
    return F.when(a.value.isNull() & b.value.isNull(), 0).when(a.value.isNull(), -1).when(b.value.isNull(), 1).otherwise(sign)


def is_type(v: Value, name: str) -> Column:
    there = v.value.isNotNull()
    if name == "String":
        return there if v.kind == STR else F.lit(False)
    if name in ("Integer", "Int"):
        whole = there & (v.value == F.floor(v.value)) & (F.abs(v.value) < 2.0**63) if v.kind == FLOAT else F.lit(False)
        return there if v.kind == INT else F.coalesce(whole, F.lit(False))
    if name in ("Float", "Number"):
        return there if v.kind == INT else F.coalesce(there & ~F.isnan(v.value) & (F.abs(v.value) < float("inf")), F.lit(False)) if v.kind == FLOAT else F.lit(False)
    if name in ("Boolean", "Bool"):
        return there if v.kind == BOOL else F.lit(False)
    if v.kind != STR:
        return F.lit(False)
    if name == "UUID":
        return F.coalesce(v.value.rlike(UUID_FORMS), F.lit(False))
    from ..operators.checks import is_date, is_timestamp

    if name == "Date":
        return F.coalesce(is_date(v.value), F.lit(False))
    return F.coalesce(is_timestamp(v.value, None), F.lit(False)) if name == "Timestamp" else F.lit(False)


def scope_of(t: Type, columns: dict[str, Column]) -> Scope:
    """The scope of a type's invariants: its properties; relations are nil."""
    properties = {p.name: Value(kind_of(p.constraint), columns[p.name].cast(kind_of(p.constraint).spark())) for p in t.all_properties if p.name in columns}
    return Scope(properties, absent=frozenset(r.field for r in t.all_relations))


def compile_text(text: str, columns: dict[str, tuple[Column, Kind]]) -> Value:
    """An expression over named columns."""
    scope = Scope({name: Value(kind, c.cast(kind.spark())) for name, (c, kind) in columns.items()})
    return ExpressionCompiler(scope).compile(parse_expression(text))


Builder = Callable[[Call, Value, list[Value]], Value]
