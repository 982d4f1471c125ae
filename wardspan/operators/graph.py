"""The instance graph as frames: nodes, references, children; duplicates, resolved edges, unresolved references, checks.

Nodes have (type, key, seq, ...); references (type, key, relation, required, target_type, target_key, ...). Keys are canonical
texts, so joins are equi-joins on (type, key); a target that half of all rows point to is a hot join key that adaptive
execution can split, and windows run over rows that share a key only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema.model import Schema
from .validate import bind, key_string, split, validate

#: Reasons of unresolved references.
MISSING, ABSENT, EMPTY = "target_missing", "absent", "empty"


def nodes_of(valid: DataFrame, schema: Schema, type_name: str, order: list[str | Column]) -> DataFrame:
    """(type, key, seq): seq orders rows that share a key; the first one stays."""
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return valid.select(F.lit(schema.type_id(type_name)).alias("type"), F.col("_key").alias("key"), rank.alias("seq"))


def dedup(df: DataFrame, keys: list[str], order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, the others); one window, no join."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_nth = 1").drop("_nth"), ranked.filter("_nth > 1").drop("_nth")


def duplicates(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rejected rows, with the place each has in its key's order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth > 1")


REFERENCE = "type string, key string, relation string, required boolean, target_type string, target_key string, reason string"


def references_of(valid: DataFrame, schema: Schema, type_name: str, columns: dict[str, str | Column] | None = None) -> DataFrame:
    """(type, key, relation, required, target_type, target_key, reason): one row per edge, and one per required relation that has none."""
    t = schema.find(type_name)
    bound, _ = bind(valid, t, columns)
    out = []
    for r in t.all_relations:
        if r.composition or (r.name not in bound.relations and r.optional):
            continue
        target = schema.find(r.target)
        names = [F.lit(schema.type_id(type_name)).alias("type"), F.col("_key").alias("key"), F.lit(r.name).alias("relation"), F.lit(not r.optional).alias("required"), F.lit(schema.type_id(r.target)).alias("target_type")]
        if r.name not in bound.relations:
            out.append(valid.select(*names, F.lit(ABSENT).alias("reason"), F.lit(None).cast("string").alias("target_key")))
            continue
        value = bound.relations[r.name]
        edges = value if r.many else F.when(value.isNotNull(), F.array(value))
        reason = F.when(value.isNull(), ABSENT).when(F.size(edges) == 0, EMPTY)
        own = valid.select(*names, F.explode_outer(edges).alias("e"), reason.alias("reason"))
        own = own.withColumn("target_key", F.when(F.col("e").isNotNull(), key_string([F.col("e")[f"_target_{k.name}"] for k in target.keys])))
        out.append(own.filter("target_key is not null or (required and reason is not null)").drop("e"))
    if not out:
        return valid.sparkSession.createDataFrame([], REFERENCE).select("type", "key", "relation", "required", "target_type", "reason", "target_key")
    return reduce(DataFrame.unionByName, out)


def resolve(references: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved). Targets are found by exact type and key, not by subtype."""
    targets = nodes.select(F.col("type").alias("target_type"), F.col("key").alias("target_key")).distinct().withColumn("_hit", F.lit(True))
    met = references.join(targets, ["target_type", "target_key"], "left")
    edges = met.filter("_hit").drop("_hit", "reason", "required")
    unresolved = met.filter("_hit is null").withColumn("reason", F.coalesce("reason", F.lit(MISSING))).drop("_hit")
    return edges, unresolved


def completeness(unresolved: DataFrame) -> DataFrame:
    """E_UNRESOLVED_REQUIRED for each required reference without target; asking again changes nothing."""
    return unresolved.filter("required").select(F.lit("E_UNRESOLVED_REQUIRED").alias("code"), "type", "key", "relation", "target_type", "target_key", "reason")


# The whole graph ------------------------------------------------------------------------------------------------------

ISSUE_ROW = "code string, type string, key string, relation string, detail string"


@dataclass(frozen=True)
class Input:
    """Rows of one type, where its members are, and the order in which rows that share a key come."""

    rows: DataFrame
    columns: dict[str, str | Column] | None = None
    order: tuple[str | Column, ...] = ()


@dataclass(frozen=True)
class Graph:
    """What build_graph() makes. Of each type, accepted has the rows that became nodes, with _key; rejected the invalid ones, with
    _issues. duplicates (type, key, nth, instance, conflict, code): rows whose key was taken, as JSON, with the node that has it;
    their edges and children count for nothing. unresolved has a reason; issues are the graph's own."""

    schema: Schema
    accepted: dict[str, DataFrame]
    rejected: dict[str, DataFrame]
    columns: dict[str, dict[str, str | Column] | None]
    nodes: DataFrame
    duplicates: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    issues: DataFrame

    def check(self) -> DataFrame:
        return completeness(self.unresolved)

    def children(self, type_name: str, relation: str) -> DataFrame:
        return children_of(self.accepted[type_name], self.schema, type_name, relation, self.columns[type_name])

    def with_edge(self, type_name: str, relation: str) -> DataFrame:
        """The nodes' rows that have a resolved edge of the relation."""
        sources = self.edges.filter((F.col("relation") == relation) & (F.col("type") == self.schema.type_id(type_name))).select(F.col("key").alias("_key")).distinct()
        return self.accepted[type_name].join(sources, "_key", "left_semi")


def build_graph(inputs: dict[str, Input], schema: Schema, *, allow_unknown: bool = True) -> Graph:
    """Validate, take valid rows only, keep the first of each key, resolve the references of those, and tell what is left over.

    Types that are unknown, parts or without a key give an issue and no nodes. A type's window over its keys is the only shuffle
    before references meet nodes; keys hold few rows each unless the input repeats them.
    """
    if not inputs:
        raise ValueError("a graph needs rows of one type at least")
    spark = next(iter(inputs.values())).rows.sparkSession
    accepted, rejected, nodes, references, repeated, issues = {}, {}, [], [], [], []
    for name, given in inputs.items():
        t = schema.find(name)
        code = "E_GRAPH_TYPE_NOT_FOUND" if t is None else "E_GRAPH_INVALID_COMPOSITION" if t.part else "E_GRAPH_MISSING_PK" if not t.abstract and not t.keys else None
        if code:
            issues.append((code, name))
            continue
        good, bad = split(validate(given.rows, schema, name, given.columns, allow_unknown=allow_unknown))
        rejected[name] = bad
        keyless = good.filter(F.col("_key").isNull())
        nth = F.row_number().over(Window.partitionBy("_key").orderBy(*(given.order or [F.monotonically_increasing_id()])))
        ranked = good.filter(F.col("_key").isNotNull()).withColumn("_nth", nth)
        first, others = ranked.filter("_nth = 1").drop("_nth"), ranked.filter("_nth > 1")
        accepted[name] = first
        type_id = F.lit(schema.type_id(name)).alias("type")
        nodes.append(first.select(type_id, F.col("_key").alias("key")))
        references.append(references_of(first, schema, name, given.columns))
        bound, _ = bind(given.rows, t, given.columns)
        told = F.to_json(F.struct(*[c.alias(p) for p, c in bound.properties.items()])) if bound.properties else F.lit("{}")
        lost = others.select("_key", "_nth", told.alias("instance"))
        kept = first.select("_key", told.alias("conflict")).join(lost.select("_key").distinct(), "_key", "left_semi")
        repeated.append(lost.join(kept, "_key").select(type_id, F.col("_key").alias("key"), F.col("_nth").alias("nth"), "instance", "conflict", F.lit("E_DUPLICATE_PK").alias("code")))
        repeated[-1] = repeated[-1].unionByName(keyless.select(type_id, F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("nth"), told.alias("instance"), F.lit(None).cast("string").alias("conflict"), F.lit("E_GRAPH_MISSING_PK").alias("code")))
    found = spark.createDataFrame([(code, name, None, None, None) for code, name in issues], ISSUE_ROW)
    if not nodes:
        none = spark.createDataFrame([], "type string, key string")
        lost = spark.createDataFrame([], REFERENCE)
        return Graph(schema, accepted, rejected, {}, none, spark.createDataFrame([], "type string, key string, nth int, instance string, conflict string, code string"), lost.drop("required", "reason"), lost, found)
    all_nodes, left_over = reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, repeated)
    wanted = {schema.type_id(r.target) for name in accepted for r in schema.find(name).all_relations if not r.composition}
    targets = [n for name, n in zip(accepted, nodes, strict=True) if schema.type_id(name) in wanted]  # the others are not read again
    edges, unresolved = resolve(reduce(DataFrame.unionByName, references), reduce(DataFrame.unionByName, targets or [nodes[0].limit(0)]))
    own = left_over.select("code", "type", "key", F.lit(None).cast("string").alias("relation"), F.col("instance").alias("detail"))
    missing = completeness(unresolved).select("code", "type", "key", "relation", F.col("reason").alias("detail"))
    return Graph(schema, accepted, rejected, {n: inputs[n].columns for n in accepted}, all_nodes, left_over.filter("code = 'E_DUPLICATE_PK'").drop("code"), edges, unresolved, found.unionByName(own).unionByName(missing))


def children_of(valid: DataFrame, schema: Schema, type_name: str, relation: str, columns: dict[str, str | Column] | None = None) -> DataFrame:
    """(parent_key, position, key, child): a row per owned child; a key of its own, or its place where its type has none."""
    t = schema.find(type_name)
    r = t.relation(relation)
    if r is None or not r.composition:
        raise ValueError(f"{type_name} has no composition {relation}")
    bound, _ = bind(valid, t, columns)
    rows = valid.select(F.col("_key").alias("parent_key"), F.posexplode(bound.relations[r.name]).alias("position", "child"))
    keys = schema.find(r.target).keys
    key = key_string([F.col("child")[k.name] for k in keys]) if keys else F.col("position").cast("string")
    return rows.select("parent_key", "position", key.alias("key"), "child")


def attach(children: DataFrame, parents: DataFrame, schema: Schema, parent_type: str, relation: str, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """Late children (parent_key, key, ...) to parents (key): (attached, issues). A parent's (one) relation keeps the first child."""
    t = schema.find(parent_type)
    r = t.relation(relation) if t else None
    if r is None or not r.composition:
        return children.limit(0), children.select(F.lit("E_GRAPH_INVALID_COMPOSITION").alias("code"), "parent_key", "key")
    known = parents.select(F.col("key").alias("parent_key")).distinct().withColumn("_there", F.lit(True))
    met = children.join(known, "parent_key", "left")
    lost = met.filter("_there is null").select(F.lit("E_GRAPH_PARENT_NOT_FOUND").alias("code"), "parent_key", "key")
    by = ["parent_key", "key"] if r.many else ["parent_key"]
    ranked = met.filter("_there").drop("_there").withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    keyless = F.col("key").isNull() & F.lit(r.many)
    kept = ranked.filter((F.col("_nth") == 1) | keyless).drop("_nth")
    repeated = ranked.filter((F.col("_nth") > 1) & ~keyless).select(F.lit("E_DUPLICATE_COMPOSED_PK").alias("code"), "parent_key", "key")
    return kept, lost.unionByName(repeated)


def composed_key(parent: Column, relation: str, child: Column) -> Column:
    """[[parent],"REL",[child] or index]."""
    return F.concat(F.lit("["), parent, F.lit(f',"{relation}",'), child.cast("string"), F.lit("]"))


def snapshot_duplicates(duplicates: DataFrame) -> DataFrame:
    return duplicates.orderBy("type", "key", "nth")


def snapshot_unresolved(unresolved: DataFrame) -> DataFrame:
    return unresolved.orderBy("type", "key", "relation", "target_type", "target_key", "reason")


def snapshot_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("type", "key")


def snapshot_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("type", "key", "relation", "target_type", "target_key")


def types_present(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct().orderBy("type")


def instance_by_key(nodes: DataFrame, type_id: str, key: str) -> DataFrame:
    return nodes.filter((F.col("type") == type_id) & (F.col("key") == key))


def walk(nodes: DataFrame, visit, edges: DataFrame | None = None, visit_edge=None) -> int:
    """Call visit(row) in the order of (type, key), a partition at a time on the driver, then visit_edge(row) for its edges in
    order; the number of nodes visited."""
    n = 0
    ordered = iter(snapshot_edges(edges).toLocalIterator(prefetchPartitions=True)) if edges is not None and visit_edge else iter(())
    edge = next(ordered, None)
    for row in snapshot_nodes(nodes).toLocalIterator(prefetchPartitions=True):
        visit(row)
        n += 1
        while edge is not None and (edge["type"], edge["key"]) <= (row["type"], row["key"]):
            if (edge["type"], edge["key"]) == (row["type"], row["key"]):
                visit_edge(edge)
            edge = next(ordered, None)
    return n
