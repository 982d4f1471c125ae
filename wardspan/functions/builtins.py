"""The expression language's functions, by lower-case name. Receivers come first; a nil receiver is an empty list or text fails."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compiler import BOOL, FLOAT, INT, NIL, REGEX, STR, TYPE_NAMES, Call, Value, compare, equal, fail_if, first_error, list_kind, null, to_kind, unify

LAMBDA, NO_LAMBDA = "required", "none"


@dataclass(frozen=True)
class Builtin:
    name: str
    build: Callable[[Call, Value, list[Value]], Value]
    least: int = 0
    most: int | None = 0
    params: int = 0
    body: str = NO_LAMBDA

    def misuse(self, args: int, params: int, body: bool) -> str:
        if args < self.least or (self.most is not None and args > self.most):
            return f"{args} arguments"
        if self.body == NO_LAMBDA:
            return "takes no lambda" if body or params else ""
        return "needs a body" if not body else "too many parameters" if params > self.params else ""


BUILTINS: dict[str, Builtin] = {}


def builtin(name: str, least: int = 0, most: int | None = -1, params: int = 0, body: str = NO_LAMBDA):
    def register(f):
        BUILTINS[name.lower()] = Builtin(name, f, least, least if most == -1 else most, params, body)
        return f

    return register


def register(name: str, build: Callable[[Call, Value, list[Value]], Value], least: int = 0, most: int | None = None) -> None:
    """A function of the user's own: from compiled receiver and arguments to a compiled value."""
    if name.lower() in BUILTINS:
        raise ValueError(f"{name} is registered already")
    BUILTINS[name.lower()] = Builtin(name, build, least, most)


def names() -> list[str]:
    return sorted(b.name for b in BUILTINS.values())


# Helpers --------------------------------------------------------------------------------------------------------------


def listed(v: Value) -> Value:
    """A list that is never null: nil is empty, other kinds fail."""
    if v.kind == NIL:
        return Value(list_kind(NIL), F.array().cast("array<string>"), v.error)
    if v.kind.name != "list":
        return Value(list_kind(NIL), F.array().cast("array<string>"), first_error(v.error, fail_if(v.value.isNotNull(), f"{v.kind.name} is no list")))
    return Value(v.kind, F.coalesce(v.value, F.array().cast(v.kind.spark())), v.error)


def item(v: Value, x: Column) -> Value:
    return Value(v.kind.element, x)


def each_error(v: Value, f: Callable[[Column], Column | None]) -> Column | None:
    """The first error of f over the list's elements."""
    probe = f(F.lit(None).cast(v.kind.element.spark()))
    if probe is None:
        return None
    return F.get(F.filter(F.transform(v.value, f), lambda e: e.isNotNull()), F.lit(0))


def predicate(call: Call, v: Value) -> tuple[Callable[[Column], Column], Column | None]:
    """The lambda as a condition: nil counts as false, other kinds fail."""

    def run(x: Column) -> Value:
        return call.run(item(v, x))

    def condition(x: Column) -> Column:
        out = run(x)
        return F.coalesce(out.value, F.lit(False)) if out.kind == BOOL else F.lit(False)

    def error(x: Column) -> Column | None:
        out = run(x)
        wrong = None if out.kind in (BOOL, NIL) else F.lit("a predicate gives a bool")
        return first_error(out.error, wrong)

    return condition, each_error(v, error)


def text(v: Value, name: str) -> tuple[Column, Column | None]:
    if v.kind != STR:
        return null(STR), first_error(v.error, F.lit(f"{name} needs a string"))
    return v.value, first_error(v.error, fail_if(v.value.isNull(), f"{name} needs a string"))


# Collections ----------------------------------------------------------------------------------------------------------


@builtin("Map", params=1, body=LAMBDA)
def _map(call, recv, args):
    v = listed(recv)
    kind = call.run(item(v, F.lit(None).cast(v.kind.element.spark()))).kind
    errors = each_error(v, lambda x: call.run(item(v, x)).error)
    return Value(list_kind(kind), F.transform(v.value, lambda x: call.run(item(v, x)).value.cast(kind.spark())), first_error(v.error, errors))


@builtin("Filter", params=1, body=LAMBDA)
def _filter(call, recv, args):
    v = listed(recv)
    condition, error = predicate(call, v)
    return Value(v.kind, F.filter(v.value, condition), first_error(v.error, error))


@builtin("Count", params=1, body=LAMBDA)
def _count(call, recv, args):
    v = listed(recv)
    condition, error = predicate(call, v)
    return Value(INT, F.size(F.filter(v.value, condition)).cast("bigint"), first_error(v.error, error))


@builtin("All", params=1, body=LAMBDA)
def _all(call, recv, args):
    v = listed(recv)
    condition, error = predicate(call, v)
    return Value(BOOL, F.forall(v.value, condition), first_error(v.error, error))


@builtin("Any", params=1, body=LAMBDA)
def _any(call, recv, args):
    v = listed(recv)
    condition, error = predicate(call, v)
    return Value(BOOL, F.exists(v.value, condition), first_error(v.error, error))


@builtin("AllOrNone", params=1, body=LAMBDA)
def _all_or_none(call, recv, args):
    v = listed(recv)
    condition, error = predicate(call, v)
    return Value(BOOL, F.forall(v.value, condition) | ~F.exists(v.value, condition), first_error(v.error, error))


@builtin("Reduce", 0, 1, params=2, body=LAMBDA)
def _reduce(call, recv, args):
    v = listed(recv)
    element = v.kind.element

    def step(acc: Value, x: Column) -> Value:
        return call.run(acc, item(v, x))

    first = args[0] if args else Value(element, F.get(v.value, F.lit(0)))
    kind = first.kind
    for _ in range(3):  # until the accumulator's kind holds what the body gives
        out = step(Value(kind, null(kind)), F.lit(None).cast(element.spark())).kind
        wider = unify(kind, out)
        if wider is None or wider == kind:
            break
        kind = wider
    rest = v.value if args else F.slice(v.value, 2, F.greatest(F.size(v.value) - 1, F.lit(0)))
    # The accumulator is a pair: the value and the first error.
    start = F.struct(to_kind(first, kind).alias("v"), (first.error if first.error is not None else F.lit(None).cast("string")).alias("e"))

    def merge(acc: Column, x: Column) -> Column:
        out = step(Value(kind, acc["v"]), x)
        error = F.coalesce(acc["e"], out.error) if out.error is not None else acc["e"]
        return F.struct(out.value.cast(kind.spark()).alias("v"), error.cast("string").alias("e"))

    total = F.aggregate(rest, start, merge)
    empty = None if args else fail_if(F.size(v.value) == 0, "Reduce of nothing needs a seed")
    return Value(kind, total["v"], first_error(v.error, empty, total["e"]))


@builtin("Compact")
def _compact(call, recv, args):
    v = listed(recv)
    return Value(v.kind, F.array_compact(v.value), v.error)


@builtin("Unique")
def _unique(call, recv, args):
    v = listed(recv)
    return Value(v.kind, F.array_distinct(v.value), v.error)


@builtin("Len")
def _len(call, recv, args):
    if recv.kind == STR:
        return Value(INT, F.coalesce(F.char_length(recv.value), F.lit(0)).cast("bigint"), recv.error)
    if recv.kind == NIL:
        return Value(INT, F.lit(0).cast("bigint"), recv.error)
    if recv.kind.name == "struct":
        return Value(INT, F.when(recv.value.isNull(), 0).otherwise(len(recv.kind.fields)).cast("bigint"), recv.error)
    v = listed(recv)
    wrong = F.lit("Len needs a text or a list") if recv.kind.name != "list" else None
    return Value(INT, F.size(v.value).cast("bigint"), first_error(v.error, wrong))


@builtin("Sum")
def _sum(call, recv, args):
    v = listed(recv)
    if v.kind.element == NIL:
        return Value(INT, F.lit(0).cast("bigint"), v.error)
    if not v.kind.element.numeric:
        return Value(INT, null(INT), first_error(v.error, fail_if(F.size(v.value) > 0, "Sum needs numbers")))
    missing = fail_if(F.exists(v.value, lambda x: x.isNull()), "Sum needs numbers")
    if v.kind.element == FLOAT:
        return Value(FLOAT, F.aggregate(v.value, F.lit(0.0), lambda a, x: a + x), first_error(v.error, missing))
    total = F.aggregate(v.value, F.lit(0).cast("bigint"), lambda a, x: F.try_add(a, x))
    return Value(INT, total, first_error(v.error, missing, fail_if(total.isNull(), "integer overflow")))


@builtin("First")
def _first(call, recv, args):
    v = listed(recv)
    return Value(v.kind.element, F.get(v.value, F.lit(0)), v.error)


@builtin("Last")
def _last(call, recv, args):
    v = listed(recv)
    return Value(v.kind.element, F.try_element_at(v.value, F.lit(-1)), v.error)


@builtin("Sort")
def _sort(call, recv, args):
    v = listed(recv)
    return Value(v.kind, F.sort_array(v.value, True), v.error)


@builtin("Reverse")
def _reverse(call, recv, args):
    v = listed(recv)
    return Value(v.kind, F.reverse(v.value), v.error)


@builtin("Flatten")
def _flatten(call, recv, args):
    v = listed(recv)
    if v.kind.element.name != "list":
        return v
    inner = v.kind.element
    return Value(inner, F.flatten(F.transform(v.value, lambda x: F.coalesce(x, F.array(F.lit(None)).cast(inner.spark())))), v.error)


@builtin("Contains", 1)
def _contains(call, recv, args):
    v = listed(recv)
    return Value(BOOL, F.exists(v.value, lambda x: equal(item(v, x), args[0])), first_error(v.error, args[0].error))


# Control flow and kinds -----------------------------------------------------------------------------------------------


@builtin("Then", params=1, body=LAMBDA)
def _then(call, recv, args):
    out = call.run(recv)
    there = recv.value.isNotNull()
    return Value(out.kind, F.when(there, out.value), first_error(recv.error, F.when(there, out.error) if out.error is not None else None))


@builtin("Lest", body=LAMBDA)
def _lest(call, recv, args):
    out = call.run()
    kind = unify(recv.kind, out.kind) or out.kind
    error = F.when(recv.value.isNull(), out.error) if out.error is not None else None
    return Value(kind, F.coalesce(to_kind(recv, kind), to_kind(out, kind)), first_error(recv.error, error))


@builtin("With", params=1, body=LAMBDA)
def _with(call, recv, args):
    out = call.run(recv)
    return replace(out, error=first_error(recv.error, out.error))


@builtin("TypeOf")
def _type_of(call, recv, args):
    name = "[]any" if recv.kind.name == "list" else "map[string]any" if recv.kind.name == "struct" else TYPE_NAMES.get(recv.kind.name, recv.kind.name)
    return Value(STR, F.when(recv.value.isNull(), "nil").otherwise(name), recv.error)


@builtin("IsNil")
def _is_nil(call, recv, args):
    return Value(BOOL, recv.value.isNull(), recv.error)


@builtin("Default", 1)
def _default(call, recv, args):
    kind = unify(recv.kind, args[0].kind) or args[0].kind
    return Value(kind, F.coalesce(to_kind(recv, kind), to_kind(args[0], kind)), first_error(recv.error, args[0].error))


@builtin("Coalesce", 1, None)
def _coalesce(call, recv, args):
    kind = recv.kind
    for a in args:
        kind = unify(kind, a.kind) or a.kind
    return Value(kind, F.coalesce(*[to_kind(x, kind) for x in (recv, *args)]), first_error(recv.error, *[a.error for a in args]))


# Math -----------------------------------------------------------------------------------------------------------------


def _number(v: Value, name: str) -> Column | None:
    if not v.kind.numeric:
        return first_error(v.error, F.lit(f"{name} needs a number"))
    return first_error(v.error, fail_if(v.value.isNull(), f"{name} needs a number"))


def _rounding(name: str, f: Callable[[Column], Column]) -> None:
    @builtin(name)
    def build(call, recv, args):
        error = _number(recv, name)
        if recv.kind == INT:
            return Value(INT, recv.value, error)
        if recv.kind != FLOAT:
            return Value(FLOAT, null(FLOAT), error)
        # Beyond 2^53 every double is whole; Spark's floor and ceil give longs.
        big = ~(F.abs(recv.value) < 2.0**53)
        return Value(FLOAT, F.when(big, recv.value).otherwise(f(F.when(~big, recv.value)).cast("double")), error)


_rounding("Floor", F.floor)
_rounding("Ceil", F.ceil)
_rounding("Round", F.rint)


@builtin("Abs")
def _abs(call, recv, args):
    error = _number(recv, "Abs")
    if recv.kind == INT:
        least = recv.value == -(2**63)
        return Value(INT, F.abs(F.when(~least, recv.value)), first_error(error, fail_if(least, "integer overflow")))
    return Value(FLOAT, F.abs(recv.value) if recv.kind == FLOAT else null(FLOAT), error)


def _extreme(name: str, sign: int) -> None:
    @builtin(name, 0, 1)
    def build(call, recv, args):
        if args:
            kind = unify(recv.kind, args[0].kind)
            error = first_error(recv.error, args[0].error)
            if kind is None:
                return Value(recv.kind, null(recv.kind), first_error(error, F.lit(f"{name} of unlike kinds")))
            first = compare(recv, args[0]) * sign <= 0
            return Value(kind, F.when(first, to_kind(recv, kind)).otherwise(to_kind(args[0], kind)), error)
        v = listed(recv)
        ordered = F.sort_array(v.value, sign > 0)
        return Value(v.kind.element, F.get(ordered, F.lit(0)), first_error(v.error, fail_if(F.size(v.value) == 0, f"{name} of nothing")))


_extreme("Min", 1)
_extreme("Max", -1)


@builtin("Compare", 1)
def _compare(call, recv, args):
    return Value(INT, compare(recv, args[0]).cast("bigint"), first_error(recv.error, args[0].error))


# Strings --------------------------------------------------------------------------------------------------------------


@builtin("Upper")
def _upper(call, recv, args):
    s, error = text(recv, "Upper")
    return Value(STR, F.upper(s), error)


@builtin("Lower")
def _lower(call, recv, args):
    s, error = text(recv, "Lower")
    return Value(STR, F.lower(s), error)


@builtin("Trim")
def _trim(call, recv, args):
    s, error = text(recv, "Trim")
    return Value(STR, F.regexp_replace(s, r"(?U)^\s+|\s+\z", ""), error)


@builtin("TrimPrefix", 1)
def _trim_prefix(call, recv, args):
    s, error = text(recv, "TrimPrefix")
    p, more = text(args[0], "TrimPrefix")
    return Value(STR, F.when(F.startswith(s, p), F.substring(s, F.char_length(p) + 1, F.char_length(s))).otherwise(s), first_error(error, more))


@builtin("TrimSuffix", 1)
def _trim_suffix(call, recv, args):
    s, error = text(recv, "TrimSuffix")
    p, more = text(args[0], "TrimSuffix")
    return Value(STR, F.when(F.endswith(s, p), F.substring(s, F.lit(1), F.char_length(s) - F.char_length(p))).otherwise(s), first_error(error, more))


@builtin("Split", 1)
def _split(call, recv, args):
    s, error = text(recv, "Split")
    p, more = text(args[0], "Split")
    if args[0].known == "":
        characters = F.filter(F.split(s, "", -1), lambda c: c != "")
        return Value(list_kind(STR), characters, first_error(error, more))
    if args[0].known is not None:
        return Value(list_kind(STR), F.split(s, re.escape(args[0].known), -1), first_error(error, more))
    quoted = F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    apart = F.when(p == "", F.filter(F.split(s, "", -1), lambda c: c != "")).otherwise(F.split(s, quoted, -1))
    return Value(list_kind(STR), apart, first_error(error, more))


@builtin("Join", 1)
def _join(call, recv, args):
    v = listed(recv)
    p, more = text(args[0], "Join")
    if v.kind.element not in (STR, NIL):
        return Value(STR, null(STR), first_error(v.error, fail_if(F.size(v.value) > 0, "Join needs strings")))
    missing = fail_if(F.exists(v.value, lambda x: x.isNull()), "Join needs strings")
    return Value(STR, F.array_join(v.value, args[0].known) if args[0].known is not None else F.call_function("array_join", v.value, p), first_error(v.error, more, missing))


@builtin("StartsWith", 1)
def _starts_with(call, recv, args):
    s, error = text(recv, "StartsWith")
    p, more = text(args[0], "StartsWith")
    return Value(BOOL, F.startswith(s, p), first_error(error, more))


@builtin("EndsWith", 1)
def _ends_with(call, recv, args):
    s, error = text(recv, "EndsWith")
    p, more = text(args[0], "EndsWith")
    return Value(BOOL, F.endswith(s, p), first_error(error, more))


@builtin("Replace", 2)
def _replace(call, recv, args):
    s, error = text(recv, "Replace")
    old, more = text(args[0], "Replace")
    new, most = text(args[1], "Replace")
    spread = F.concat(new, F.array_join(F.transform(F.filter(F.split(s, "", -1), lambda c: c != ""), lambda c: F.concat(c, new)), ""))
    return Value(STR, F.when(old == "", spread).otherwise(F.replace(s, old, new)), first_error(error, more, most))


@builtin("Substring", 1, 2)
def _substring(call, recv, args):
    s, error = text(recv, "Substring")
    size = F.char_length(s)
    for a in args:
        error = first_error(error, a.error, fail_if(a.value.isNull(), "Substring needs integers") if a.kind == INT else F.lit("Substring needs integers"))
    if any(a.kind != INT for a in args):
        return Value(STR, null(STR), error)

    def place(v: Column) -> Column:
        """From the end if negative; clamped."""
        at = F.when(v < 0, v + size).otherwise(v)
        return F.least(F.greatest(at, F.lit(0)), size).cast("int")

    start = place(args[0].value)
    end = place(args[1].value) if len(args) > 1 else size
    return Value(STR, F.when(end > start, F.substring(s, start + 1, end - start)).otherwise(F.when(s.isNotNull(), "")), error)


@builtin("Match", 1)
def _match(call, recv, args):
    s, error = text(recv, "Match")
    if args[0].kind != REGEX:
        return Value(list_kind(STR), null(list_kind(STR)), first_error(error, F.lit("Match needs a pattern")))
    pattern = args[0].known
    groups = re.compile(re.sub(r"\\[zp](?:\{\w+\})?", "x", pattern).replace("(?<", "(?P<")).groups
    found = F.array(*[F.regexp_extract(s, pattern, g) for g in range(groups + 1)])
    return Value(list_kind(STR), F.when(s.rlike(pattern), found), error)


