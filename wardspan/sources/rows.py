"""Instances written in Python as DataFrames of their type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.compiler import kind_of
from ..schema.model import Schema


def row_schema(schema: Schema, type_name: str, depth: int = 3) -> str:
    """The struct of a type's rows: properties, references with _target_ keys and edge properties, owned children (to a depth)."""
    t = schema.find(type_name)
    fields = [f"`{p.name}`:{kind_of(p.constraint).spark()}" for p in t.all_properties]
    for r in t.all_relations:
        target = schema.find(r.target)
        if r.composition:
            if depth:
                fields.append(f"`{r.field}`:array<{row_schema(schema, r.target, depth - 1)}>")
            continue
        edge = [f"`_target_{k.name}`:string" for k in target.keys] + [f"`{p.name}`:{kind_of(p.constraint).spark()}" for p in r.properties]
        struct = f"struct<{','.join(edge)}>"
        fields.append(f"`{r.field}`:" + (f"array<{struct}>" if r.many else struct))
    return f"struct<{','.join(fields)}>"


def frame(spark: SparkSession, schema: Schema, type_name: str, rows: list[dict]) -> DataFrame:
    """Rows as dicts; what they leave out is null."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    shape = _parse_datatype_string(row_schema(schema, type_name))
    assert isinstance(shape, StructType)
    return spark.createDataFrame([{f.name: row.get(f.name) for f in shape.fields} for row in rows], shape)
