"""Constraints as Columns: for a value of a property, the failing code and message, or null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.compiler import UUID_FORMS, kind_of
from ..schema.model import Constraint
from ..schema.parser import java_pattern

RFC3339 = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z"
# Elements of layouts and what they match, longest first.
LAYOUT = {"2006": r"\d{4}", "January": r"[A-Z][a-z]+", "Jan": r"[A-Z][a-z]{2}", "Monday": r"[A-Z][a-z]+day", "Mon": r"[A-Z][a-z]{2}", "MST": r"[A-Z]{3,4}", "Z07:00": r"(?:Z|[+-]\d{2}:\d{2})", "Z0700": r"(?:Z|[+-]\d{4})", "-07:00": r"[+-]\d{2}:\d{2}", "-0700": r"[+-]\d{4}", "-07": r"[+-]\d{2}", "01": r"(?:0[1-9]|1[0-2])", "02": r"(?:0[1-9]|[12]\d|3[01])", "03": r"(?:0[1-9]|1[0-2])", "04": r"[0-5]\d", "05": r"[0-5]\d(?:[.,]\d+)?", "06": r"\d{2}", "15": r"(?:[01]\d|2[0-3])", "PM": r"[AP]M", "pm": r"[ap]m", "1": r"(?:[1-9]|1[0-2])", "2": r"(?:[1-9]|[12]\d|3[01])", "3": r"(?:[1-9]|1[0-2])", "4": r"[0-5]?\d", "5": r"[0-5]?\d(?:[.,]\d+)?"}
_ELEMENT = re.compile("|".join(map(re.escape, sorted(LAYOUT, key=len, reverse=True))))


def is_date(c: Column) -> Column:
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    return shape & F.when(shape, F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).isNotNull()


def layout_pattern(layout: str) -> str:
    out, at = [], 0
    for m in _ELEMENT.finditer(layout):
        out += [re.escape(layout[at : m.start()]), LAYOUT[m[0]]]
        at = m.end()
    return "^" + "".join(out) + re.escape(layout[at:]) + r"\z"


def is_timestamp(c: Column, layout: str | None) -> Column:
    """By its shape; where the day's place in it is known, also by the calendar."""
    if layout is None:
        shape = c.rlike(RFC3339)
        return shape & is_date(F.substring(c, 1, 10))
    shape = c.rlike(layout_pattern(layout))
    if layout.startswith("2006-01-02"):
        return shape & is_date(F.substring(c, 1, 10))
    return shape


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def _between(c: Column, low, high) -> Column | None:
    parts = ([c >= F.lit(low)] if low is not None else []) + ([c <= F.lit(high)] if high is not None else [])
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def _bounds(c: Constraint) -> str:
    return f"[{'_' if c.low is None else c.low}, {'_' if c.high is None else c.high}]"


MISMATCH, FAIL = "E_TYPE_MISMATCH", "E_CONSTRAINT_FAIL"
ELEMENT_FAILS = "an element fails"


def violations(c: Constraint, value: Column) -> list[tuple[Column, str, str]]:
    """(condition, code, message) in the order they are tested; value is of the constraint's own type and not null."""
    if c.kind == "String":
        ok = _between(F.char_length(value), c.low, c.high)
        return [(~ok, FAIL, f"length not in {_bounds(c)}")] if ok is not None else []
    if c.kind == "Integer":
        ok = _between(value, c.low, c.high)
        return [(~ok, FAIL, f"value not in {_bounds(c)}")] if ok is not None else []
    if c.kind == "Float":
        ok = _between(value, c.low, c.high)
        return [(~finite(value), MISMATCH, "not a finite number"), *([(~ok, FAIL, f"value not in {_bounds(c)}")] if ok is not None else [])]
    if c.kind == "Enum":
        return [(~value.isin(*c.values), FAIL, "not one of the enum's values")]
    if c.kind == "Pattern":
        return [(~value.rlike(java_pattern(p)), FAIL, f"doesn't match /{p}/") for p in c.values]
    if c.kind == "Timestamp":
        return [(~is_timestamp(value, c.format), MISMATCH, "no timestamp")]
    if c.kind == "Date":
        return [(~is_date(value), MISMATCH, "no date")]
    if c.kind == "UUID":
        return [(~value.rlike(UUID_FORMS), MISMATCH, "no UUID")]
    if c.kind == "Vector":
        return [(F.size(value) != c.size, FAIL, f"not {c.size} dimensions"), (F.exists(value, lambda x: x.isNull() | ~finite(x)), MISMATCH, "not all components are finite numbers")]
    if c.kind == "List":
        ok = _between(F.size(value), c.low, c.high)
        own = [(~ok, FAIL, f"length not in {_bounds(c)}")] if ok is not None else []
        return own + [(F.exists(value, lambda x: x.isNotNull() & _any(c.element, x)), FAIL, ELEMENT_FAILS)] if violations(c.element, F.lit(None).cast(kind_of(c.element).spark())) else own
    return [] if c.kind == "Boolean" else [(F.lit(True), MISMATCH, f"data type {c.name} is unknown")]


def _any(c: Constraint, x: Column) -> Column:
    out = F.lit(False)
    for condition, _, _ in violations(c, x):
        out = out | condition
    return F.coalesce(out, F.lit(False))


def failing_index(c: Constraint, value: Column) -> Column:
    """Place of a list's first failing element, from 0, or null."""
    hits = F.transform(value, lambda x: F.coalesce(x.isNotNull() & _any(c.element, x), F.lit(False)))
    at = F.array_position(hits, True)
    return F.when(at > 0, at - 1)


def check(c: Constraint, value: Column) -> Column:
    """struct(code, message) of the first violation, or null; null values pass."""
    out = None
    for condition, code, message in violations(c, value):
        said = F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
        out = F.when(condition, said) if out is None else out.when(condition, said)
    none = F.lit(None).cast("struct<code:string,message:string>")
    return F.when(value.isNotNull(), out) if out is not None else none
