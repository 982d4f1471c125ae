import pytest
from pyspark.sql import functions as F

from wardspan.operators.validate import split, validate
from wardspan.schema.load import load_string
from wardspan.streaming.incremental import IncrementalGraph

SCHEMA = load_string('schema "t" type A { id String primary  n Integer[0, 9] }')
REFERENCE = "type string, key string, relation string, required boolean, target_type string, target_key string, reason string"


def test_late_targets_and_duplicates(spark, tmp_path):
    g = IncrementalGraph(spark, str(tmp_path / "g"))
    assert g.nodes().count() == 0 and g.check().count() == 0
    g.add_references(spark.createDataFrame([("A", "1", "R", True, "B", "x", None), ("A", "2", "R", True, "B", "y", None)], REFERENCE), 0)
    assert g.check().count() == 2
    g.add_nodes(spark.createDataFrame([("B", "x", 1), ("B", "x", 2)], "type string, key string, seq long"), 1)
    assert [r["target_key"] for r in g.edges().collect()] == ["x"] and g.check().count() == 1 and g.check().count() == 1
    g.add_nodes(spark.createDataFrame([("B", "x", 1), ("B", "y", 2)], "type string, key string, seq long"), 2)
    g.add_nodes(spark.createDataFrame([("B", "x", 1), ("B", "y", 2)], "type string, key string, seq long"), 2)  # tried again
    assert g.edges().count() == 2 and g.check().count() == 0 and g.duplicates().count() == 2


OWNERS = load_string('schema "o" type A { id String primary  *-> PARTS (many) P  *-> ONE P } part type P { no String primary }')


def test_children_before_and_after_their_parents(spark, tmp_path):
    g = IncrementalGraph(spark, str(tmp_path / "g"))
    child = "parent_key string, key string, seq long, child string"
    g.add_children(spark.createDataFrame([("a", "1", 1, "{}"), ("b", "1", 2, "{}")], child), OWNERS, "A", "PARTS", 0)
    assert g.children(OWNERS, "A", "PARTS")[0].count() == 0 and g.children(OWNERS, "A", "PARTS")[1].count() == 2
    g.add_nodes(spark.createDataFrame([(OWNERS.type_id("A"), "a", 1)], "type string, key string, seq long"), 1)
    g.add_children(spark.createDataFrame([("a", "1", 1, "{}"), ("a", "2", 2, "{}")], child), OWNERS, "A", "PARTS", 2)
    g.add_children(spark.createDataFrame([("a", "1", 1, "{}"), ("a", "2", 2, "{}")], child), OWNERS, "A", "PARTS", 2)
    there, issues = g.children(OWNERS, "A", "PARTS")
    assert sorted(r["key"] for r in there.collect()) == ["1", "2"]
    assert sorted(r["code"] for r in issues.collect()) == ["E_DUPLICATE_COMPOSED_PK", "E_GRAPH_PARENT_NOT_FOUND"]
    assert g.children(OWNERS, "A", "ONE")[0].count() == 0
    with pytest.raises(ValueError, match="E_GRAPH_INVALID_COMPOSITION"):
        g.add_children(spark.createDataFrame([], child), OWNERS, "A", "NOPE", 3)


def test_snapshot_is_sorted(spark, tmp_path):
    g = IncrementalGraph(spark, str(tmp_path / "g"))
    g.add_nodes(spark.createDataFrame([("B", "y", 1), ("A", "z", 2), ("B", "x", 3), ("B", "x", 4)], "type string, key string, seq long"), 0)
    g.add_references(spark.createDataFrame([("B", "y", "R", True, "A", "z", None), ("A", "z", "R", True, "B", "q", None), ("A", "z", "Q", True, "B", "p", None)], REFERENCE), 0)
    now = {k: [tuple(r)[:3] for r in v.collect()] for k, v in g.snapshot().items()}
    assert now["nodes"] == [("A", "z"), ("B", "x"), ("B", "y")] and now["duplicates"] == [("B", "x", 2)]
    assert [r["relation"] for r in g.snapshot()["unresolved"].collect()] == ["Q", "R"] and len(now["edges"]) == 1


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 11), ("c", 3)], "id string, n long").write.parquet(source)
    stream = spark.readStream.schema("id string, n long").parquet(source)
    good, _ = split(validate(stream, SCHEMA, "A"))
    g = IncrementalGraph(spark, str(tmp_path / "g"))
    nodes = good.select(F.lit("A").alias("type"), F.col("_key").alias("key"), F.lit(0).alias("seq"))
    for q in g.follow(nodes, None, str(tmp_path / "cp")):
        q.awaitTermination(120)
    assert sorted(r["key"] for r in g.nodes().collect()) == ['["a"]', '["c"]']
