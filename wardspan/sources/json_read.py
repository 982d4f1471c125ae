"""JSON documents to rows of raw instances, and raw instances to validated ones.

Documents become VARIANT values; nothing is inferred. Rows are (type, obj VARIANT, source, position) plus issue rows for what
can't be an instance. Validation of raw rows resolves field names (exact, then the only one equal in lower case), tells kinds
per value, and coerces; it is still one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diag import issue, no_issues
from ..functions.compiler import kind_of
from ..operators.validate import CAP, as_column, under, capped, first_of, free_prefix, invariant_issues, key_string, let, shape_issue, sibling_issues, staged, there, value_issue
from ..schema.model import Constraint, Property, Relation, Schema, Type
from ..schema.parser import BUILT_IN

TAG = r"^(?:[A-Za-z][A-Za-z0-9_]*\.)?[A-Z][A-Za-z0-9_]*\z"
#: Names of data types can't be tags, List can.
NOT_TAGS = tuple(b for b in BUILT_IN if b != "List")
#: Possessive runs: nothing is tried twice, and long strings need no stack.
_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'


def plain_json(text: Column) -> Column:
    """JSON with comments and trailing commas as JSON without: strings are kept, comments go; then commas before a closing bracket."""
    text = F.regexp_replace(text, rf"({_STRING})|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "$1")
    return F.regexp_replace(text, rf"({_STRING})|,(?=\s*[\]}}])", "$1")


def parsed(docs: DataFrame, text: Column, strict: bool = False) -> DataFrame:
    """docs (source) with (text, doc VARIANT, broken) of the given texts; comments and trailing commas are allowed unless strict."""
    own = docs.withColumn("text", text if strict else plain_json(text))
    return own.withColumn("doc", F.try_parse_json("text")).withColumn("broken", F.col("doc").isNull())


def documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(source, text, doc VARIANT, broken): one row per file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return parsed(files, F.col("value"), strict).drop("value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, text, doc, broken): one row per line, for large inputs; a broken line spoils no other."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return rows.select("source", "text", F.try_parse_json("text").alias("doc")).withColumn("broken", F.col("doc").isNull())


def adapter_issues(docs: DataFrame) -> DataFrame:
    return docs.filter("broken").select("source", F.lit("E_ADAPTER_PARSE").alias("code"))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _is_array(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def valid_tag(tag: Column) -> Column:
    return F.coalesce(tag.rlike(TAG) & ~tag.isin(*NOT_TAGS), F.lit(False))


def _elements(df: DataFrame, column: str, into: str) -> DataFrame:
    """A row per element of an array VARIANT, with its place."""
    items = F.try_variant_get(F.col(column), "$", "array<variant>")
    return df.select(*[c for c in df.columns if c != column], F.posexplode(items).alias("position", into))


def _entries(df: DataFrame, column: str) -> DataFrame:
    """A row per member of an object VARIANT."""
    members = F.try_variant_get(F.col(column), "$", "map<string,variant>")
    return df.select(*[c for c in df.columns if c != column], F.explode(members).alias("tag", "items"))


def _sorted_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, issues) of rows (source, type, position, obj); nulls and non-objects are issues."""
    good = F.coalesce(_is_object(F.col("obj")), F.lit(False)) & valid_tag(F.col("type"))
    code = F.when(~valid_tag(F.col("type")) & F.col("type").isNotNull(), "E_INVALID_TYPE_TAG").when(F.col("type").isNull() & F.coalesce(_is_object(F.col("obj")), F.lit(False)), "E_MISSING_TYPE_TAG").otherwise("E_ADAPTER_PARSE")
    return rows.filter(good).select("type", "obj", "source", "position"), rows.filter(~good).select("source", "position", code.alias("code"))


def by_type(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """{"Type": [{...}, ...], ...}: instances and issues."""
    entries = _entries(docs.filter("not broken").select("source", "doc"), "doc")
    wrong = entries.filter(~valid_tag(F.col("tag")) | ~F.coalesce(_is_array(F.col("items")), F.lit(False))).select("source", F.lit(None).cast("int").alias("position"), F.when(~valid_tag(F.col("tag")), "E_INVALID_TYPE_TAG").otherwise("E_ADAPTER_PARSE").alias("code"))
    rows = _elements(entries.filter(valid_tag(F.col("tag"))), "items", "obj").withColumnRenamed("tag", "type")
    good, bad = _sorted_out(rows)
    return good, wrong.unionByName(bad)


def tagged(docs: DataFrame, field: str = "$type") -> tuple[DataFrame, DataFrame]:
    """[{"$type": "T", ...}, ...]: the tag is taken out of the object."""
    if not field:
        raise ValueError("the tag's field needs a name")
    rows = _elements(docs.filter("not broken").select("source", "doc"), "doc", "item")
    members = F.try_variant_get(F.col("item"), "$", "map<string,variant>")
    tag = F.try_variant_get(F.element_at(members, field), "$", "string")
    rest = F.parse_json(F.to_json(F.map_filter(members, lambda k, _: k != field)))
    return _sorted_out(rows.select("source", "position", tag.alias("type"), F.coalesce(F.when(members.isNotNull(), rest), F.col("item")).alias("obj")))


def typed(docs: DataFrame, type_name: str) -> tuple[DataFrame, DataFrame]:
    """[{...}, ...] of one type."""
    rows = _elements(docs.filter("not broken").select("source", "doc"), "doc", "obj")
    return _sorted_out(rows.withColumn("type", F.lit(type_name)))


def single(docs: DataFrame, type_name: str) -> tuple[DataFrame, DataFrame]:
    """{...}: one instance per document."""
    return _sorted_out(docs.filter("not broken").select("source", F.lit(0).alias("position"), F.lit(type_name).alias("type"), F.col("doc").alias("obj")))


# Raw instances --------------------------------------------------------------------------------------------------------

#: Prefixes of schema_of_variant that a constraint's values may have.
_KINDS = {"Integer": ("BIGINT", "DECIMAL", "DOUBLE"), "Float": ("BIGINT", "DECIMAL", "DOUBLE"), "Boolean": ("BOOLEAN",), "Vector": ("ARRAY",), "List": ("ARRAY",)}


def _fits(c: Constraint, v: Column) -> Column:
    """Whether a VARIANT value is of a constraint's kind; whole floats are integers."""
    kind = F.schema_of_variant(v)
    ok = F.lit(False)
    for k in _KINDS.get(c.kind, ("STRING",)):
        ok = ok | F.startswith(kind, F.lit(k))
    if c.kind == "Integer":
        as_float = F.try_variant_get(v, "$", "double")
        ok = ok & (F.startswith(kind, F.lit("BIGINT")) | ((as_float == F.floor(as_float)) & (F.abs(as_float) < 2.0**63)))
    if c.kind in ("List", "Vector"):
        element = c.element or Constraint("Float")
        inner = F.try_variant_get(v, "$", "array<variant>")
        ok = ok & F.coalesce(F.forall(inner, lambda x: x.isNull() | F.is_variant_null(x) | _fits(element, x)), F.lit(False))
    return F.coalesce(ok, F.lit(False))


#: Owned children inside owned children, to this depth; below it, any are E_LIMIT_REACHED.
DEPTH = 6


def _members(v: Column) -> Column:
    """An object VARIANT as a map, or null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _field(m: Column, wanted: str, strict: bool) -> tuple[Column, Column]:
    """(a member's VARIANT, null where it is absent; whether several names fold to it)."""
    exact = F.array_contains(F.map_keys(m), wanted)
    if strict:
        return F.when(exact, F.try_element_at(m, F.lit(wanted))), F.lit(False)
    same = F.filter(F.map_keys(m), _lower_is(wanted))
    return F.try_element_at(m, F.when(exact, F.lit(wanted)).when(F.size(same) == 1, F.get(same, F.lit(0)))), ~exact & (F.size(same) > 1)


def _given(v: Column) -> Column:
    """The VARIANT, SQL null for JSON's null."""
    return F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), v)


def _cast(c: Constraint, value: Column) -> Column:
    if c.kind == "Integer":
        return F.coalesce(F.try_variant_get(value, "$", "bigint"), F.when(_fits(c, value), F.try_variant_get(value, "$", "double").cast("bigint")))
    return F.try_variant_get(value, "$", kind_of(c).spark())


def _raw_issues(p: Property, found: Column, collides: Column, cast: Column | None, path: str | Column, phase: int, said: str) -> list[Column]:
    """Issues of a property's VARIANT; cast: the column that has its value in its own type, where there is one."""

    def of_value(value: Column, cast: Column) -> Column:
        bad = value_issue(phase, p.name, p.name, p.constraint, cast, None, path, said)[1]
        own = F.when(value.isNotNull() & ~_fits(p.constraint, value), issue(phase, "E_TYPE_MISMATCH", f"{said} has another type", path, p.name)).otherwise(bad)
        return own if p.optional else F.when(value.isNull(), issue(phase, "E_MISSING_REQUIRED", f"{said} is required", path, p.name)).otherwise(own)

    own = of_value(found, cast) if cast is not None else let(_given(found), lambda v: let(_cast(p.constraint, v), lambda c: of_value(v, c)))
    return [F.when(collides, issue(phase, "E_CASE_FOLD_COLLISION", f"several fields fold to {said}", path, p.name)), own]


def _strange(m: Column, known: list[str], strict: bool) -> Column:
    """Names that are none of the known ones (in lower case, unless strict)."""

    def odd(n: Column) -> Column:
        own = (n if strict else F.lower(n)).isin(*(k if strict else k.lower() for k in known)) if known else F.lit(False)
        return ~own

    return F.filter(F.map_keys(m), odd)


def _raw_reference(schema: Schema, r: Relation, value: Column, base: str | Column, phase: int, strict: bool, allow_unknown: bool) -> Column:
    """Issues of one association's value; an absent one has none (the graph knows which are required)."""
    target, path = schema.find(r.target), under(base, f".{r.field}")

    def of_edge(x: Column, path: str | Column) -> Column:
        def of_members(m: Column) -> Column:
            given = {k.name: _given(F.try_element_at(m, F.lit(f"_target_{k.name}"))) for k in target.keys}
            n = sum(F.when(g.isNotNull(), 1).otherwise(0) for g in given.values()) if given else F.lit(0)
            found = [F.when(n == 0, issue(phase, "E_MISSING_FK_TARGET", f"{r.name} has no target", path, r.field)).when(n < len(given), issue(phase, "E_PARTIAL_COMPOSITE_FK", f"{r.name} has part of a key", path, r.field))]
            for k in target.keys:
                bad = value_issue(phase, r.field, r.field, k.constraint, _cast(k.constraint, given[k.name]), None, path)[1]
                wrong = given[k.name].isNotNull() & (~_fits(k.constraint, given[k.name]) | bad.isNotNull())
                found.append(F.when(wrong, issue(phase, "E_TYPE_MISMATCH", f"{r.name}._target_{k.name}: no value of its key", path, r.field)))
            for p in r.properties:
                own, collides = _field(m, p.name, strict)
                found += _raw_issues(p, own, collides, None, path, phase, f"{r.name}.{p.name}")
            if allow_unknown:
                return there(*found)
            odd = F.filter(_strange(m, [p.name for p in r.properties], strict), lambda n: ~F.startswith(n, F.lit("_target_")))
            return F.concat(there(*found), F.transform(odd, lambda n: issue(phase, "E_UNKNOWN_EDGE_FIELD", F.concat(F.lit(f"{r.name}."), n, F.lit(" is unknown")), F.concat(as_column(path), F.lit("."), n))))

        return let(_members(x), lambda m: F.when(m.isNull(), there(shape_issue(phase, r, path, "an object"))).otherwise(of_members(m)))

    if not r.many:
        return F.when(value.isNotNull(), of_edge(value, path)).otherwise(no_issues())

    def of_array(items: Column) -> Column:
        each = F.transform(items, lambda x, i: of_edge(x, F.concat(as_column(path), F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(items.isNull(), there(shape_issue(phase, r, path, "an array of objects"))).otherwise(F.flatten(each))

    return F.when(value.isNotNull(), let(F.try_variant_get(value, "$", "array<variant>"), of_array)).otherwise(no_issues())


def _raw_children(schema: Schema, r: Relation, value: Column, base: str | Column, strict: bool, allow_unknown: bool, depth: int) -> Column:
    child, path, phase = schema.find(r.target), under(base, f".{r.field}"), 5
    if depth > DEPTH:
        return there(F.when(value.isNotNull(), issue(phase, "E_LIMIT_REACHED", f"{r.name} is nested too deep", path, r.field)))

    def of_child(x: Column, place: Column) -> Column:
        def of_members(m: Column) -> Column:
            return first_of([c for c, _ in _raw_phases(schema, child, m, place, phase, strict, allow_unknown, depth + 1)])

        return let(_members(x), lambda m: F.when(m.isNull(), there(shape_issue(phase, r, place, "an object"))).otherwise(of_members(m)))

    def key_of(x: Column) -> Column:
        return let(_members(x), lambda m: key_string([_cast(k.constraint, _given(_field(m, k.name, strict)[0])) for k in child.keys]))

    def of_array(items: Column) -> Column:
        each = F.flatten(F.transform(items, lambda x, i: of_child(x, F.concat(as_column(path), F.lit("["), i.cast("string"), F.lit("]")))))
        keys = F.transform(items, key_of) if child.keys else None
        return F.when(items.isNull(), there(shape_issue(phase, r, path, "an array of objects"))).otherwise(F.concat(each, there(*sibling_issues(r, items, keys, path, phase))))

    absent = no_issues() if r.optional else there(issue(phase, "E_UNRESOLVED_REQUIRED_COMPOSITION", f"{r.name} is required", path, r.field))
    return F.when(value.isNull(), absent).otherwise(let(F.try_variant_get(value, "$", "array<variant>"), of_array))


def _raw_phases(schema: Schema, t: Type, m: Column, base: str | Column, phase: int | None, strict: bool, allow_unknown: bool, depth: int, fields: dict[str, tuple[Column, Column]] | None = None, read: dict[str, Column] | None = None) -> list[tuple[Column, list[Column]]]:
    """Issues by phase. fields and read: the columns that have the members' VARIANTs and the properties' values, where there are any."""
    known = fields or {p.name: _field(m, p.name, strict) for p in t.all_properties} | {r.name: _field(m, r.field, strict) for r in t.all_relations}
    first: list[Column] = []
    for p in t.all_properties:
        first += _raw_issues(p, *known[p.name], read[p.name] if read else None, under(base, f".{p.name}"), phase or 1, p.name)
    unknown = F.transform(_strange(m, [p.name for p in t.all_properties] + [r.field for r in t.all_relations], strict), lambda n: issue(phase or 1, "E_UNKNOWN_FIELD", F.concat(n, F.lit(" is unknown")), F.concat(as_column(base), F.lit("."), n)))
    phases = [(there(*first), first) if allow_unknown else (F.concat(there(*first), unknown), [])]
    values = read or {p.name: _cast(p.constraint, _given(known[p.name][0])) for p in t.all_properties}
    if t.all_invariants:
        second = invariant_issues(t, values, path=base, phase=phase or 2)
        phases.append((there(*second), second))
    if t.keys:
        third = [F.when(values[k.name].isNull(), issue(phase or 3, "E_MISSING_PRIMARY_KEY", "a key is missing", base)) for k in t.keys]
        phases.append((there(*third), third))
    references, children = [], []
    for r in t.all_relations:
        value, collides = known[r.name]
        number = phase or (5 if r.composition else 4)
        said = there(F.when(collides, issue(number, "E_CASE_FOLD_COLLISION", f"several fields fold to {r.field}", under(base, f".{r.field}"), r.field)))
        if r.composition:
            children += [said, _raw_children(schema, r, value, base, strict, allow_unknown, depth)]
        else:
            references += [said, _raw_reference(schema, r, value, base, number, strict, allow_unknown)]
    return phases + [(F.concat(*own), []) for own in (references, children) if own]


def validate_raw(rows: DataFrame, schema: Schema, type_name: str, *, strict_names: bool = False, allow_unknown: bool = False, as_child: bool = False, cap: int = CAP) -> DataFrame:
    """rows (obj VARIANT, ...) of one type with _key, the properties in a struct _values, _issues and _dropped.

    The phases are those of the typed rows: properties, invariants, keys, references, owned children (nested ones too).
    """
    t = schema.find(type_name)
    code = "E_INSTANCE_TYPE_NOT_FOUND" if t is None else "E_ABSTRACT_TYPE" if t.abstract else "E_PART_TYPE_DIRECT" if t.part and not as_child else None
    if code:
        return rows.withColumns({"_key": F.lit(None).cast("string"), "_values": F.struct(), "_issues": F.array(issue(0, code, f"{type_name} can't be read as rows")), "_dropped": F.lit(0)})
    prefix = free_prefix(rows)
    m = F.col(f"{prefix}_members")
    df = rows.withColumn(f"{prefix}_members", _members(F.col("obj")))
    fields = {}
    for i, (name, wanted) in enumerate([(p.name, p.name) for p in t.all_properties] + [(r.name, r.field) for r in t.all_relations]):
        found, collides = _field(m, wanted, strict_names)
        own = _given(found) if i < len(t.all_properties) else found
        df = df.withColumns({f"{prefix}_f{i}": own, f"{prefix}_c{i}": collides})
        fields[name] = (F.col(f"{prefix}_f{i}"), F.col(f"{prefix}_c{i}"))
    df = df.withColumn("_values", F.struct(*[_cast(p.constraint, fields[p.name][0]).alias(p.name) for p in t.all_properties]))
    read = {p.name: F.col("_values")[p.name] for p in t.all_properties}
    keys = [read[k.name] for k in t.keys]
    df = df.withColumn("_key", key_string(keys) if keys else F.lit(None).cast("string"))
    out = staged(df, _raw_phases(schema, t, m, "$", None, strict_names, allow_unknown, 1, fields, read), "_all")
    return capped(out, "_all", cap).drop(*[c for c in out.columns if c.startswith(f"{prefix}_")])


def _lower_is(name: str):
    low = name.lower()
    return lambda n: F.lower(n) == low
