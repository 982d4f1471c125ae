"""Row validation: phases of issues, each evaluated only where the ones before found none.

Phases: 1 names and required properties, types and constraints; 2 invariants; 3 primary key; 4 references; 5 owned children, each
by the same phases, to any depth that its columns have. All are Columns over one row, so validation is a projection: no shuffle,
the same on a stream. Each phase is a projection of its own, evaluated once. No input fails the job: what can't be read as a
property's type is an issue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..diag import ISSUE, ISSUES, issue, no_issues
from ..functions.compiler import ExpressionCompiler, Kind, Scope, Value, kind_of
from ..schema.model import Constraint, Relation, Schema, Type
from .checks import ELEMENT_FAILS, violations

CAP = 100


@dataclass(frozen=True)
class Binding:
    """Where a type's members are found: a Column each, and its data type; members without one are missing."""

    properties: dict[str, Column]
    relations: dict[str, Column]
    types: dict[str, T.DataType] = field(default_factory=dict)
    unknown: dict[str, Column] = field(default_factory=dict)
    #: Members that several columns fold to.
    collisions: tuple[str, ...] = ()


def _bind_names(names: list[str], types: list[T.DataType], t: Type, read: Callable[[str], Column], strict: bool) -> Binding:
    used: set[str] = set()
    found: dict[str, str] = {}
    collisions = []
    for member, wanted in [(p.name, p.name) for p in t.all_properties] + [(r.name, r.field) for r in t.all_relations]:
        hits = [c for c in names if c == wanted] or ([] if strict else [c for c in names if c.lower() == wanted.lower()])
        used.update(hits)
        if len(hits) == 1:
            found[member] = hits[0]
        elif hits:
            collisions.append(member)
    kinds = dict(zip(names, types, strict=True))
    return Binding(
        {p.name: read(found[p.name]) for p in t.all_properties if p.name in found},
        {r.name: read(found[r.name]) for r in t.all_relations if r.name in found},
        {m: kinds[c] for m, c in found.items()},
        {c: read(c) for c in names if c not in used},
        tuple(collisions),
    )


def bind(df: DataFrame, t: Type, columns: dict[str, str | Column] | None = None, strict: bool = False) -> tuple[Binding, list[str]]:
    """By the given columns, else by name: exact, or the only one that is equal in lower case. Also the unknown columns."""
    if columns is None:
        bound = _bind_names(df.columns, [f.dataType for f in df.schema], t, lambda c: df[c], strict)
        return bound, list(bound.unknown)
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    properties = {p.name: given[p.name] for p in t.all_properties if p.name in given}
    relations = {r.name: given[r.name] for r in t.all_relations if r.name in given}
    members = properties | relations
    read = df.select(*[c.alias(m) for m, c in members.items()]).schema if members else []
    return Binding(properties, relations, {f.name: f.dataType for f in read}), []


def bind_struct(value: Column, dtype: T.StructType, t: Type) -> Binding:
    return _bind_names(dtype.fieldNames(), [f.dataType for f in dtype], t, lambda c: value[c], False)


def there(*issues: Column) -> Column:
    """The issues that are not null."""
    return F.filter(F.array(*[i.cast(ISSUE) for i in issues]), lambda x: x.isNotNull()) if issues else no_issues()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once; for use inside of lambdas, where no projection can hold it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key_string(parts: list[Column]) -> Column:
    """A key's canonical text: a compact JSON array, with <, > and & escaped."""
    text = F.to_json(F.array(*[p.cast("string") for p in parts]))
    for c in "<>&":
        text = F.replace(text, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return text


def as_column(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def under(base: str | Column, more: str) -> str | Column:
    return base + more if isinstance(base, str) else F.concat(base, F.lit(more))


# Types ----------------------------------------------------------------------------------------------------------------


def typed(value: Column, dtype: T.DataType | None, kind: Kind) -> tuple[Column, Column | None]:
    """The value in a kind's Spark type, null where it can't be read so; and a condition that holds there (None: never).

    Texts are read as numbers and booleans where they are some, whole floats as integers; a float with a fraction is no integer.
    """
    target = kind.spark()
    if dtype is None or isinstance(dtype, T.NullType) or dtype.simpleString() == target:
        return value.cast(target), None
    never = (F.lit(None).cast(target), value.isNotNull())
    if kind.name == "list":
        if not isinstance(dtype, T.ArrayType):
            return never
        _, wrong = typed(F.lit(None).cast(dtype.elementType), dtype.elementType, kind.element)
        cast = F.transform(value, lambda x: typed(x, dtype.elementType, kind.element)[0])
        if wrong is None:
            return cast, None
        return cast, F.coalesce(F.exists(value, lambda x: F.coalesce(typed(x, dtype.elementType, kind.element)[1], F.lit(False))), F.lit(False))
    text, number = isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)), isinstance(dtype, T.NumericType)
    if kind.name == "str":
        return never if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)) else (value.cast(target), None)
    if kind.name == "int" and isinstance(dtype, T.IntegralType) or kind.name == "float" and number:
        return value.cast(target), None
    if text or (kind.name == "int" and number):
        cast = value.try_cast(target)
        wrong = cast.isNull() if text else cast.isNull() | (cast.cast("double") != value.cast("double"))
        return (cast if text else F.when(~wrong, cast)), value.isNotNull() & wrong
    return never


def _index(value: Column, wrong: Callable[[Column], Column]) -> Column:
    """[i] of the first element that is wrong, as text."""
    at = F.array_position(F.transform(value, lambda x: F.coalesce(wrong(x), F.lit(False))), True) - 1
    return F.concat(F.lit("["), at.cast("string"), F.lit("]"))


def _element_fails(c: Constraint, n: int) -> Callable[[Column], Column]:
    """By the n-th of the constraint's violations; null elements pass."""
    return lambda x: F.coalesce(x.isNotNull() & violations(c, x)[n][0], F.lit(False))


def value_issue(phase: int, name: str, prop: str, c: Constraint, value: Column, dtype: T.DataType | None, path: str | Column, said: str | None = None) -> tuple[Column, Column]:
    """(the value in its own type, the first issue it has or null). A list's issue has the place of the failing element in its path."""
    cast, wrong = typed(value, dtype, kind_of(c))
    said = said or name
    out = None

    def add(condition: Column, found: Column) -> None:
        nonlocal out
        out = F.when(condition, found) if out is None else out.when(condition, found)

    if wrong is not None:
        at = path
        if c.kind in ("List", "Vector") and isinstance(dtype, T.ArrayType):
            at = F.concat(as_column(path), _index(value, lambda x: typed(x, dtype.elementType, kind_of(c).element)[1]))
        add(wrong, issue(phase, "E_TYPE_MISMATCH", f"{said}: another type", at, prop))
    for condition, code, message in violations(c, cast):
        if c.kind == "List" and message == ELEMENT_FAILS:
            for n, (_, inner_code, inner) in enumerate(violations(c.element, F.lit(None).cast(kind_of(c.element).spark()))):
                fails = _element_fails(c.element, n)
                at = _index(cast, fails)
                add(F.exists(cast, fails), issue(phase, inner_code, F.concat(F.lit(f"{said}: element "), at, F.lit(f": {inner}")), F.concat(as_column(path), at), prop))
            continue
        add(condition, issue(phase, code, f"{said}: {message}", path, prop))
    return cast, F.lit(None).cast(ISSUE) if out is None else F.when(value.isNotNull(), out)


def property_issues(t: Type, bound: Binding, base: str | Column = "$", phase: int = 1) -> tuple[dict[str, Column], list[Column]]:
    """(the values in their own types, issues)."""
    values, out = {}, []
    for p in t.all_properties:
        path = under(base, f".{p.name}")
        if p.name in bound.collisions:
            out.append(issue(phase, "E_CASE_FOLD_COLLISION", f"several fields fold to {p.name}", path, p.name))
        missing = issue(phase, "E_MISSING_REQUIRED", f"{p.name} is required", path, p.name)
        value = bound.properties.get(p.name)
        if value is None:
            if not p.optional and p.name not in bound.collisions:
                out.append(missing)
            continue
        values[p.name], failed = value_issue(phase, p.name, p.name, p.constraint, value, bound.types.get(p.name), path)
        out.append(failed if p.optional else F.when(value.isNull(), missing).otherwise(failed))
    return values, out


def invariant_issues(t: Type, values: dict[str, Column], relations: dict[str, Value] | None = None, path: str | Column = "$", phase: int = 2) -> list[Column]:
    scope = Scope({p.name: Value(kind_of(p.constraint), values[p.name].cast(kind_of(p.constraint).spark())) for p in t.all_properties if p.name in values}, relations or {})
    compiler = ExpressionCompiler(scope)
    out = []
    for i in t.all_invariants:
        v = compiler.compile(i.expression)
        fails = issue(phase, "E_INVARIANT_FAIL", i.message, path)
        if v.kind.name == "bool":
            said = F.when(~F.coalesce(v.value, F.lit(False)), fails)
        elif v.kind.name == "nil":
            said = fails
        else:
            said = F.when(v.value.isNull(), fails).otherwise(issue(phase, "E_EVAL_ERROR", f"{i.message}: not a bool", path))
        if v.error is not None:
            said = F.when(v.error.isNotNull(), issue(phase, "E_EVAL_ERROR", F.concat(F.lit(f"{i.message}: "), v.error), path)).otherwise(said)
        out.append(said)
    return out


# References and children ----------------------------------------------------------------------------------------------


def shape_issue(phase: int, r: Relation, path: str | Column, wanted: str) -> Column:
    return issue(phase, "E_EDGE_SHAPE_MISMATCH", f"{r.name}: not {wanted}", path, r.field)


def reference_issues(schema: Schema, r: Relation, value: Column, dtype: T.DataType | None, base: str | Column = "$", phase: int = 4, allow_unknown: bool = True) -> Column:
    """Of one association's column: a struct, or an array of structs, with _target_* and edge properties."""
    target = schema.find(r.target)
    path = under(base, f".{r.field}")
    inner = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    if isinstance(dtype, T.NullType) or dtype is None:
        return no_issues()
    if isinstance(dtype, T.ArrayType) != r.many or not isinstance(inner, T.StructType):
        return there(F.when(value.isNotNull(), shape_issue(phase, r, path, "an array of objects" if r.many else "an object")))
    kinds = {f.name: f.dataType for f in inner}
    names = {p.name: [c for c in kinds if c == p.name] or [c for c in kinds if c.lower() == p.name.lower()] for p in r.properties}
    strange = [c for c in kinds if not c.startswith("_target_") and not any(c in hits for hits in names.values())]

    def of_edge(edge: Column, path: str | Column) -> Column:
        given = {k.name: edge[f"_target_{k.name}"] if f"_target_{k.name}" in kinds else F.lit(None).cast("string") for k in target.keys}
        n = sum(F.when(g.isNotNull(), 1).otherwise(0) for g in given.values()) if given else F.lit(0)
        found = [F.when(n == 0, issue(phase, "E_MISSING_FK_TARGET", f"{r.name} has no target", path, r.field)).when(n < len(given), issue(phase, "E_PARTIAL_COMPOSITE_FK", f"{r.name} has part of a key", path, r.field))]
        for k in target.keys:
            field_name = f"_target_{k.name}"
            _, bad = value_issue(phase, r.field, r.field, k.constraint, given[k.name], kinds.get(field_name), path, f"{r.name}.{field_name}")
            found.append(F.when(bad.isNotNull(), issue(phase, "E_TYPE_MISMATCH", f"{r.name}.{field_name}: no value of its key", path, r.field)))
        for p in r.properties:
            hits = names[p.name]
            missing = issue(phase, "E_MISSING_REQUIRED", f"{r.name}.{p.name} is required", path, p.name)
            if len(hits) > 1:
                found.append(issue(phase, "E_CASE_FOLD_COLLISION", f"several fields fold to {r.name}.{p.name}", path, p.name))
            elif not hits:
                found += [] if p.optional else [missing]
            else:
                _, bad = value_issue(phase, p.name, p.name, p.constraint, edge[hits[0]], kinds[hits[0]], path, f"{r.name}.{p.name}")
                found.append(bad if p.optional else F.when(edge[hits[0]].isNull(), missing).otherwise(bad))
        if not allow_unknown:
            found += [F.when(edge[c].isNotNull(), issue(phase, "E_UNKNOWN_EDGE_FIELD", f"{r.name}.{c} is unknown", under(path, f".{c}"), c)) for c in strange]
        return there(*found)

    if r.many:
        def placed(x: Column, i: Column) -> Column:
            at = F.concat(as_column(path), F.lit("["), i.cast("string"), F.lit("]"))
            return F.when(x.isNull(), there(shape_issue(phase, r, at, "an object"))).otherwise(of_edge(x, at))

        return F.when(value.isNotNull(), F.flatten(F.transform(value, placed))).otherwise(no_issues())
    return F.when(value.isNotNull(), of_edge(value, path)).otherwise(no_issues())


def sibling_issues(r: Relation, value: Column, keys: Column | None, path: str | Column, phase: int) -> list[Column]:
    """keys: an array of the children's canonical keys."""
    found = []
    if not r.optional:
        found.append(F.when(F.coalesce(F.size(value), F.lit(0)) <= 0, issue(phase, "E_UNRESOLVED_REQUIRED_COMPOSITION", f"{r.name} is required", path, r.field)))
    if keys is not None:
        found.append(F.when(F.size(F.array_distinct(keys)) < F.size(keys), issue(phase, "E_DUPLICATE_COMPOSED_PK", f"{r.name} repeats a key", path, r.field)))
    if not r.many:
        found.append(F.when(F.size(value) > 1, issue(phase, "E_DUPLICATE_COMPOSED_PK", f"{r.name} holds one child", path, r.field)))
    return found


def child_issues(schema: Schema, r: Relation, value: Column, dtype: T.DataType | None, base: str | Column = "$", allow_unknown: bool = True) -> Column:
    """Of one composition's column, an array of structs: each child's own issues, in place, its children's too; siblings with equal keys.

    A struct's missing fields are missing members.
    """
    child, path, phase = schema.find(r.target), under(base, f".{r.field}"), 5
    if dtype is None or isinstance(dtype, T.NullType):
        return there(*sibling_issues(r, F.lit(None).cast("array<string>"), None, path, phase))
    if not isinstance(dtype, T.ArrayType) or not isinstance(dtype.elementType, T.StructType):
        return there(F.when(value.isNotNull(), shape_issue(phase, r, path, "an array of objects")))

    def of_child(x: Column, i: Column) -> Column:
        place = F.concat(as_column(path), F.lit("["), i.cast("string"), F.lit("]"))
        bound = bind_struct(x, dtype.elementType, child)
        own = first_of([c for c, _ in phases_of(schema, child, bound, place, phase, allow_unknown)])
        return F.when(x.isNull(), there(shape_issue(phase, r, place, "an object"))).otherwise(own)

    found = F.when(value.isNotNull(), F.flatten(F.transform(value, of_child))).otherwise(no_issues())
    named = {k.name: bind_struct(F.lit(None), dtype.elementType, child).types.get(k.name) for k in child.keys}
    keys = F.transform(value, lambda x: key_string([bind_struct(x, dtype.elementType, child).properties[k.name] for k in child.keys])) if child.keys and all(named.values()) else None
    return F.concat(found, there(*sibling_issues(r, value, keys, path, phase)))


# Phases ---------------------------------------------------------------------------------------------------------------


def phases_of(schema: Schema, t: Type, bound: Binding, base: str | Column = "$", phase: int | None = None, allow_unknown: bool = True) -> list[tuple[Column, list[Column]]]:
    """Issues by phase, as (array, the same as single issues where that is known); phase: a number that all get."""
    values, first = property_issues(t, bound, base, phase or 1)
    if not allow_unknown:
        first += [F.when(value.isNotNull(), issue(phase or 1, "E_UNKNOWN_FIELD", f"{c} is unknown", under(base, f".{c}"), c)) for c, value in bound.unknown.items()]
    second = invariant_issues(t, values, path=base, phase=phase or 2)
    third = [F.when(bound.properties[k.name].isNull(), issue(phase or 3, "E_MISSING_PRIMARY_KEY", "a key is missing", base)) for k in t.keys if k.name in bound.properties]
    references, children = [], []
    for r in t.all_relations:
        if r.name in bound.collisions:
            children.append(there(issue(phase or (5 if r.composition else 4), "E_CASE_FOLD_COLLISION", f"several fields fold to {r.field}", under(base, f".{r.field}"), r.field)))
        elif r.name in bound.relations and r.composition:
            children.append(child_issues(schema, r, bound.relations[r.name], bound.types.get(r.name), base, allow_unknown))
        elif r.name in bound.relations:
            references.append(reference_issues(schema, r, bound.relations[r.name], bound.types.get(r.name), base, phase or 4, allow_unknown))
        elif r.composition and not r.optional:
            children.append(there(issue(5, "E_UNRESOLVED_REQUIRED_COMPOSITION", f"{r.name} is required", under(base, f".{r.field}"), r.field)))
    out = [(there(*own), own) for own in (first, second, third) if own]
    return out + [(F.concat(*own), []) for own in (references, children) if own]


def first_of(phases: list[Column]) -> Column:
    """The first array that has any, each evaluated once."""

    def either(own: Column, rest: Column) -> Column:
        return let(own, lambda x: F.when(F.size(x) > 0, x).otherwise(rest))

    out = None
    for p in reversed(phases):
        out = p.cast(ISSUES) if out is None else either(p.cast(ISSUES), out)
    return no_issues() if out is None else out


def free_prefix(df: DataFrame) -> str:
    """What no column's name begins with."""
    prefix = "_w"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "w"
    return prefix


def staged(df: DataFrame, phases: list[tuple[Column, list[Column]]], into: str) -> DataFrame:
    """df with the issues of the first phase that has any. Every issue is a column that later projections only read, so that it
    is evaluated once, and none of a phase is where the phases before found any; arrays are built for rows with issues only."""
    prefix = free_prefix(df)
    found = f"{prefix}_found"
    out = df.withColumn(found, F.lit(None).cast(ISSUES))
    for n, (whole, single) in enumerate(phases):
        clean = F.col(found).isNull()
        if single:
            names = [f"{prefix}_{n}_{i}" for i in range(len(single))]
            out = out.withColumns({c: F.when(clean, i.cast(ISSUE)) for c, i in zip(names, single, strict=True)})
            some = F.when(F.coalesce(*names).isNotNull(), F.filter(F.array(*names), lambda x: x.isNotNull()))
        else:
            names = [f"{prefix}_{n}"]
            out = out.withColumn(names[0], F.when(clean, whole.cast(ISSUES)))
            some = F.when(F.size(names[0]) > 0, F.col(names[0]))
        out = out.withColumn(found, F.coalesce(found, some)).drop(*names)
    # A generator of one row: filters on the issues stay above it, or the optimizer would put all of the above in their place once more.
    one = F.inline(F.array(F.struct(F.coalesce(found, no_issues()).alias(into))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], one)


def capped(df: DataFrame, issues: str, cap: int) -> DataFrame:
    return df.withColumn("_issues", F.slice(issues, 1, cap)).withColumn("_dropped", F.greatest(F.size(issues) - cap, F.lit(0))).drop(issues)


def validate(df: DataFrame, schema: Schema, type_name: str, columns: dict[str, str | Column] | None = None, *, allow_unknown: bool = True, as_child: bool = False, cap: int = CAP) -> DataFrame:
    """df with _key (the canonical key), _issues (up to cap of the first phase that has any) and _dropped (beyond the cap)."""
    t = schema.find(type_name)
    if t is None:
        return _all_rows(df, issue(0, "E_INSTANCE_TYPE_NOT_FOUND", f"{type_name} is unknown"))
    if t.abstract:
        return _all_rows(df, issue(0, "E_ABSTRACT_TYPE", f"{type_name} is abstract"))
    if t.part and not as_child:
        return _all_rows(df, issue(0, "E_PART_TYPE_DIRECT", f"{type_name} lives inside its owner only"))
    bound, _ = bind(df, t, columns)
    keys = [bound.properties[k.name] for k in t.keys if k.name in bound.properties]
    out = df.withColumn("_key", key_string(keys) if keys else F.lit(None).cast("string"))
    return capped(staged(out, phases_of(schema, t, bound, allow_unknown=allow_unknown), "_all"), "_all", cap)


def validate_children(df: DataFrame, schema: Schema, parent_type: str, relation: str, columns: dict[str, str | Column] | None = None, **more) -> DataFrame:
    """Rows that are children of a parent type's composition, one child a row."""
    t = schema.find(parent_type)
    if t is None:
        return _all_rows(df, issue(0, "E_INSTANCE_TYPE_NOT_FOUND", f"{parent_type} is unknown"))
    r = t.relation(relation)
    if r is None or not r.composition:
        return _all_rows(df, issue(0, "E_COMPOSITION_NOT_FOUND", f"{parent_type} has no composition {relation}"))
    return validate(df, schema, r.target, columns, as_child=True, **more)


def _all_rows(df: DataFrame, i: Column) -> DataFrame:
    return df.withColumns({"_key": F.lit(None).cast("string"), "_issues": F.array(i).cast(ISSUES), "_dropped": F.lit(0)})


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failures)."""
    ok = F.size("_issues") == 0
    return validated.filter(ok), validated.filter(~ok)


def coerce(df: DataFrame, t: Type, columns: dict[str, str | Column] | None = None) -> DataFrame:
    """The properties in their canonical types, in order of declaration; null where a value can't be read so."""
    bound, _ = bind(df, t, columns)
    return df.select(*[typed(bound.properties[p.name], bound.types.get(p.name), kind_of(p.constraint))[0].alias(p.name) for p in t.all_properties if p.name in bound.properties])


def issue_rows(validated: DataFrame) -> DataFrame:
    """A row per issue, with the key of its instance."""
    return validated.select("_key", F.explode("_issues").alias("i")).select(F.col("_key").alias("key"), "i.*")
