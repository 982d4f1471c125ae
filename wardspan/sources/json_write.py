"""The graph as JSON: an object per type, rows in the order of their keys, references as key arrays, children inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema.model import Schema


def instance_json(schema: Schema, type_name: str, columns: dict[str, Column], pretty: bool = False) -> Column:
    """One row's object: properties by name; a reference is an array of its target's key parts, of many an array of those;
    children are objects, one for a (one) relation and an array, ordered by key, for (many). Edge properties are left out."""
    t = schema.find(type_name)
    fields = [columns[p.name].alias(p.name) for p in sorted(t.all_properties, key=lambda p: p.name) if p.name in columns]
    for r in sorted(t.all_relations, key=lambda r: r.field):
        if r.name not in columns:
            continue
        value, target = columns[r.name], schema.find(r.target)
        if r.composition:
            ordered = _ordered(value, [k.name for k in target.keys])
            fields.append((ordered if r.many else F.get(value, F.lit(0))).alias(r.field))
        else:
            parts = _parts(tuple(k.name for k in target.keys))
            fields.append((F.transform(value, parts) if r.many else F.when(value.isNotNull(), parts(value))).alias(r.field))
    return F.to_json(F.struct(*fields), {"pretty": "true"} if pretty else {})


def _parts(names: tuple[str, ...]):
    return lambda edge: F.array(*[edge[f"_target_{n}"].cast("string") for n in names])


def _ordered(value: Column, names: list[str]) -> Column:
    if not names:
        return value
    keyed = F.transform(value, lambda x: F.struct(F.array(*[x[n].cast("string") for n in names]).alias("k"), x.alias("row")))
    return F.transform(F.array_sort(keyed), lambda x: x["row"])


def rows_json(df: DataFrame, schema: Schema, type_name: str, columns: dict[str, Column], key: Column, pretty: bool = False) -> DataFrame:
    """(type, key, json): a row per instance, for writing large graphs line by line."""
    return df.select(F.lit(type_name).alias("type"), key.alias("key"), instance_json(schema, type_name, columns, pretty).alias("json"))


def edge_index(edges: DataFrame) -> DataFrame:
    """(type, key, relation, targets): a relation's targets in order."""
    return edges.groupBy("type", "key", "relation").agg(F.array_sort(F.collect_list("target_key")).alias("targets"))


def diagnostics_json(unresolved: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows (section, json) of what a graph leaves over."""
    lost = unresolved.select(F.lit("unresolved").alias("section"), F.to_json(F.struct("type", "key", "relation", "target_type", "target_key", "reason")).alias("json"))
    told = [c for c in ("type", "key", "nth", "instance", "conflict") if c in duplicates.columns]
    return lost.unionByName(duplicates.select(F.lit("duplicates").alias("section"), F.to_json(F.struct(*told)).alias("json")))


def whole_json(rows: DataFrame) -> DataFrame:
    """One object of all types, {"Type": [...]}, for small graphs: it is a single row."""
    per_type = rows.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("key", "json"))).alias("r"))
    text = F.concat(F.lit('"'), F.col("type"), F.lit('":['), F.array_join("r.json", ","), F.lit("]"))
    return per_type.select(F.col("type"), text.alias("t")).agg(F.array_sort(F.collect_list(F.struct("type", "t"))).alias("a")).select(F.concat(F.lit("{"), F.array_join("a.t", ","), F.lit("}")).alias("json"))


def write_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of JSON, a folder per type."""
    rows.select("type", F.col("json").alias("value")).write.mode(mode).partitionBy("type").text(path)
