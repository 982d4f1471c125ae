"""A graph that grows: batches of nodes, references and children in any order, kept as tables.

Row-local validation works on a stream as it is. State is Parquet tables: nodes (type, key) and duplicates, told apart when a batch
comes (its nodes meet the keys known so far, the first one wins, and history is never ranked again), references, and children.
References resolve when asked, so a target that comes later resolves all that wait for it; so do children and their parents.
Asking changes nothing. Each batch writes its own folder, named by its number: a batch that is tried again after a failure
replaces its folder, so results are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import attach, completeness, resolve, snapshot_duplicates, snapshot_edges, snapshot_nodes, snapshot_unresolved
from ..schema.model import Schema

NODE = "type string, key string, seq long"
CHILD = "parent_type string, relation string, parent_key string, key string, seq long, child string"
REFERENCE = "type string, key string, relation string, required boolean, target_type string, target_key string, reason string"


class IncrementalGraph:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def add_nodes(self, nodes: DataFrame, batch: int) -> None:
        """nodes: type, key, seq (the order within the batch)."""
        nth = F.row_number().over(Window.partitionBy("type", "key").orderBy("seq"))
        known = self._table("nodes", NODE).filter(F.col("batch") != batch).select("type", "key", F.lit(True).alias("known"))
        ranked = nodes.select("type", "key", F.col("seq").cast("long")).withColumn("nth", nth).join(known, ["type", "key"], "left")
        fresh = F.col("known").isNull() & (F.col("nth") == 1)
        ranked.filter(~fresh).select("type", "key", "seq").write.mode("overwrite").parquet(f"{self.path}/duplicates/batch={batch}")
        ranked.filter(fresh).select("type", "key", "seq").write.mode("overwrite").parquet(f"{self.path}/nodes/batch={batch}")

    def add_children(self, children: DataFrame, schema: Schema, parent_type: str, relation: str, batch: int) -> None:
        """children: parent_key, key, seq, child (JSON); their parents may come later. A relation that isn't one is an error here."""
        t = schema.find(parent_type)
        r = t.relation(relation) if t else None
        if r is None or not r.composition:
            raise ValueError(f"E_GRAPH_INVALID_COMPOSITION: {parent_type} has no composition {relation}")
        rows = children.select(F.lit(schema.type_id(parent_type)).alias("parent_type"), F.lit(r.name).alias("relation"), "parent_key", "key", F.col("seq").cast("long"), F.col("child").cast("string"))
        rows.write.mode("overwrite").parquet(f"{self.path}/children/batch={batch}")

    def add_references(self, references: DataFrame, batch: int) -> None:
        references.select("type", "key", "relation", "required", "target_type", "target_key", "reason").write.mode("overwrite").parquet(f"{self.path}/references/batch={batch}")

    def nodes(self) -> DataFrame:
        return self._table("nodes", NODE).select("type", "key")

    def duplicates(self) -> DataFrame:
        """nth: the place among the rejected ones, from 2."""
        nth = F.row_number().over(Window.partitionBy("type", "key").orderBy("batch", "seq")) + 1
        return self._table("duplicates", NODE).select("type", "key", nth.alias("nth"))

    def children(self, schema: Schema, parent_type: str, relation: str) -> tuple[DataFrame, DataFrame]:
        """(attached, issues) of what has come so far."""
        type_id = schema.type_id(parent_type)
        own = self._table("children", CHILD).filter((F.col("parent_type") == type_id) & (F.col("relation") == schema.find(parent_type).relation(relation).name))
        return attach(own, self.nodes().filter(F.col("type") == type_id).select("key"), schema, parent_type, relation, ["batch", "seq"])

    def snapshot(self) -> dict[str, DataFrame]:
        """The graph at this moment, each part in its order."""
        edges, unresolved = resolve(self.references(), self.nodes())
        return {"nodes": snapshot_nodes(self.nodes()), "edges": snapshot_edges(edges), "duplicates": snapshot_duplicates(self.duplicates()), "unresolved": snapshot_unresolved(unresolved)}

    def references(self) -> DataFrame:
        return self._table("references", REFERENCE).drop("batch")

    def edges(self) -> DataFrame:
        return resolve(self.references(), self.nodes())[0]

    def unresolved(self) -> DataFrame:
        return resolve(self.references(), self.nodes())[1]

    def check(self) -> DataFrame:
        return completeness(self.unresolved())

    def follow(self, nodes: DataFrame | None, references: DataFrame | None, checkpoint: str, **trigger):
        """Start streaming queries that feed the tables; trigger as for writeStream.trigger."""
        started = []
        for name, stream, f in (("nodes", nodes, self.add_nodes), ("references", references, self.add_references)):
            if stream is not None:
                started.append(stream.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, n, f=f: f(df, n)).start())
        return started
