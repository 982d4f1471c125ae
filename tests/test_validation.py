import pytest
from pyspark.sql import functions as F

from wardspan.operators import checks, graph
from wardspan.operators.validate import coerce, issue_rows, split, validate
from wardspan.schema.load import load_string
from wardspan.schema.model import Constraint

SCHEMA = load_string(
    """schema "t"
    abstract type Base { id String primary  age Integer[0, 150] }
    type Person extends Base { name String[1, 4] required  ! "adult" age >= 18  ! "ratio" 100 / age > 0  --> WORKS_AT Company { role String required  since Date } --> KNOWS (many) Person }
    type Company { id String primary }
    type Cart { id String primary  *-> ITEMS (one:many) Item  *-> NOTE Note }
    part type Item { sku String primary  quantity Integer[1, 9] required  ! "even" quantity % 2 == 0 }
    part type Note { text String required }
    """
)
PERSON = "id string, age long, name string, works_at struct<_target_id:string,role:string,since:string>, knows array<struct<_target_id:string>>"


def issues(df):
    return {r["_key"]: [(i["code"], i["path"]) for i in r["_issues"]] for r in df.select("_key", "_issues").collect()}


def test_phases(spark):
    rows = [
        ("a", 30, "Ann", None, None),
        ("b", 10, "Bob", None, None),
        ("c", 0, "Cléo", None, None),
        ("d", 200, None, None, None),
        ("e", 40, "Eve", (None, "x", None), None),
        ("f", 40, "Eve", ("k", None, "2024-13-01"), [("a",), (None,)]),
        (None, 40, "Eve", None, None),
        ("g", None, "Gus!?", None, None),
    ]
    got = issues(validate(spark.createDataFrame(rows, PERSON), SCHEMA, "Person"))
    assert got['["a"]'] == []
    assert got['["b"]'] == [("E_INVARIANT_FAIL", "$")]
    assert got['["c"]'] == [("E_INVARIANT_FAIL", "$"), ("E_EVAL_ERROR", "$")]
    assert sorted(got['["d"]']) == [("E_CONSTRAINT_FAIL", "$.age"), ("E_MISSING_REQUIRED", "$.name")]
    assert got['["e"]'] == [("E_MISSING_FK_TARGET", "$.works_at")]
    assert sorted(got['["f"]']) == [("E_MISSING_FK_TARGET", "$.knows[1]"), ("E_MISSING_REQUIRED", "$.works_at"), ("E_TYPE_MISMATCH", "$.works_at")]
    assert got["[null]"] == [("E_MISSING_REQUIRED", "$.id")]
    assert got['["g"]'] == [("E_CONSTRAINT_FAIL", "$.name")]


def test_children(spark):
    rows = [("a", [("x", 2), ("y", 4)], None), ("b", [("x", 2), ("x", 4)], None), ("c", [("x", 10), ("y", 3)], None), ("d", [], None), ("e", None, [("n",), ("m",)])]
    got = issues(validate(spark.createDataFrame(rows, "id string, items array<struct<sku:string,quantity:long>>, note array<struct<text:string>>"), SCHEMA, "Cart"))
    assert got['["a"]'] == []
    assert got['["b"]'] == [("E_DUPLICATE_COMPOSED_PK", "$.items")]
    assert got['["c"]'] == [("E_CONSTRAINT_FAIL", "$.items[0].quantity"), ("E_INVARIANT_FAIL", "$.items[1]")]
    assert got['["d"]'] == [("E_UNRESOLVED_REQUIRED_COMPOSITION", "$.items")]
    assert sorted(got['["e"]']) == [("E_DUPLICATE_COMPOSED_PK", "$.note"), ("E_UNRESOLVED_REQUIRED_COMPOSITION", "$.items")]


def test_types_that_have_no_rows(spark):
    df = spark.createDataFrame([("a",)], "id string")
    for name, code in (("Base", "E_ABSTRACT_TYPE"), ("Item", "E_PART_TYPE_DIRECT"), ("Zzz", "E_INSTANCE_TYPE_NOT_FOUND")):
        assert issue_rows(validate(df, SCHEMA, name)).first()["code"] == code
    assert issue_rows(validate(df.limit(0), SCHEMA, "Company")).count() == 0


def test_split_cap_and_coerce(spark):
    df = spark.createDataFrame([("a", "30", "toolong"), ("b", "300", "toolong"), ("c", "20", "ok")], "ID string, age string, Name string")
    out = validate(df, SCHEMA, "Person", cap=1)
    good, bad = split(out)
    assert good.count() == 1 and {r["ID"]: (len(r["_issues"]), r["_dropped"]) for r in bad.collect()} == {"a": (1, 0), "b": (1, 1)}
    assert coerce(df, SCHEMA.types["Person"]).schema.simpleString() == "struct<name:string,id:string,age:bigint>"


@pytest.mark.parametrize(
    ("constraint", "good", "bad"),
    [
        (Constraint("Timestamp"), ["2024-02-29T23:59:59Z", "2024-01-01T00:00:00.123+02:00"], ["2023-02-29T00:00:00Z", "2024-01-01 00:00:00", "2024-01-01T24:00:00Z", ""]),
        (Constraint("Timestamp", format="02/Jan/2006 15:04:05"), ["01/Feb/2024 10:00:00.5"], ["32/Feb/2024 10:00:00", "1/Feb/2024 10:00:00"]),
        (Constraint("Date"), ["2024-02-29"], ["2024-2-9", "2024-02-30", "2024-02-29\n", "20240229"]),
        (Constraint("UUID"), ["123E4567-e89b-12d3-a456-426614174000", "urn:uuid:123e4567-e89b-12d3-a456-426614174000", "{123e4567-e89b-12d3-a456-426614174000}", "123e4567e89b12d3a456426614174000"], ["123e4567", "{123e4567e89b12d3a456426614174000}", "123e4567-e89b-12d3-a456-42661417400g"]),
        (Constraint("Pattern", values=("b", "^a")), ["ab"], ["ba", "a", "xab"]),
        (Constraint("Pattern", values=("c$",)), ["abc"], ["abc\n"]),
        (Constraint("String", 2, 4), ["éé", "日本語字"], ["é", "日本語字字"]),
    ],
)
def test_text_constraints(spark, constraint, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, good boolean")
    found = df.select("v", "good", checks.check(constraint, F.col("v")).isNull().alias("ok")).collect()
    assert [r for r in found if r["ok"] != r["good"]] == []


def test_graph(spark):
    people = validate(spark.createDataFrame([("a", 30, "Ann", ("k", "x", None), [("b",), ("z",)]), ("b", 30, "Bob", ("q", "x", None), [])], PERSON), SCHEMA, "Person")
    refs = graph.references_of(people, SCHEMA, "Person")
    nodes = spark.createDataFrame([("t#Company", '["k"]'), ("t#Person", '["b"]'), ("t#Person", '["q"]')], "type string, key string")
    edges, lost = graph.resolve(refs, nodes.withColumn("type", F.replace("type", F.lit("t#"), F.lit(SCHEMA.type_id("X")[:-1]))))
    assert {(r["key"], r["relation"], r["target_key"]) for r in edges.collect()} == {('["a"]', "WORKS_AT", '["k"]'), ('["a"]', "KNOWS", '["b"]')}
    assert {(r["key"], r["target_key"], r["reason"]) for r in lost.collect()} == {('["a"]', '["z"]', "target_missing"), ('["b"]', '["q"]', "target_missing")}
    assert graph.completeness(lost).count() == 0
    seen = []
    assert graph.walk(nodes, seen.append) == 3 and [r["key"] for r in seen] == ['["k"]', '["b"]', '["q"]']


def test_attach(spark):
    parents = spark.createDataFrame([("p",)], "key string")
    children = spark.createDataFrame([("p", "1", 2), ("p", "1", 1), ("p", None, 3), ("p", None, 4), ("q", "1", 5)], "parent_key string, key string, n int")
    kept, found = graph.attach(children, parents, SCHEMA, "Cart", "ITEMS", ["n"])
    assert sorted(r["n"] for r in kept.collect()) == [1, 3, 4]
    assert sorted(r["code"] for r in found.collect()) == ["E_DUPLICATE_COMPOSED_PK", "E_GRAPH_PARENT_NOT_FOUND"]
    kept, found = graph.attach(children, parents, SCHEMA, "Cart", "NOTE", ["n"])
    assert [r["n"] for r in kept.collect()] == [1]
    assert graph.attach(children, parents, SCHEMA, "Person", "KNOWS", ["n"])[1].count() == 5


def test_nothing_throws(spark):
    """Values of other types are issues, wherever they are; what can be read is."""
    schema = load_string('schema "x" type M { k String primary  a Integer  b Float  c Boolean  d List<Integer[0, 9]>  e Vector[2]  g Date  ! "small" a < 100 }')
    rows = [("1", "5", "1.5", "true", ["1"], [1, 2]), ("2", "x", "y", "z", ["1", "q"], [1, 2]), ("3", "2.5", "1e3", "FALSE", ["12"], [1]), ("4", "99999999999999999999", None, None, None, None)]
    out = validate(spark.createDataFrame(rows, "k string, a string, b string, c string, d array<string>, e array<int>"), schema, "M")
    assert issues(out) == {
        '["1"]': [],
        '["2"]': [("E_TYPE_MISMATCH", "$.a"), ("E_TYPE_MISMATCH", "$.b"), ("E_TYPE_MISMATCH", "$.c"), ("E_TYPE_MISMATCH", "$.d[1]")],
        '["3"]': [("E_TYPE_MISMATCH", "$.a"), ("E_CONSTRAINT_FAIL", "$.d[0]"), ("E_CONSTRAINT_FAIL", "$.e")],
        '["4"]': [("E_TYPE_MISMATCH", "$.a")],
    }
    df = spark.range(1).selectExpr("'k' as k", "cast(2.5 as double) as a", "array(1) as b", "5 as c", "'x' as d", "map('a', 1) as e", "struct(1) as g")
    assert issues(validate(df, schema, "M"))['["k"]'] == [("E_TYPE_MISMATCH", f"$.{c}") for c in "abcdeg"]
    whole = spark.range(1).selectExpr("'k' as k", "cast(3 as double) as a", "cast(1.5 as decimal(5, 2)) as b", "array(cast(3 as double), 2.5D) as d", "date'2024-02-29' as g")
    assert issues(validate(whole, schema, "M"))['["k"]'] == [("E_TYPE_MISMATCH", "$.d[1]")]
    got = coerce(whole, schema.types["M"]).first()
    assert (got["a"], got["b"], got["d"], got["g"]) == (3, 1.5, [3, None], "2024-02-29")


NESTED = load_string(
    """schema "n"
    type A { id String primary  *-> PARTS (many) P }
    part type P { no Integer required  note String  *-> PARTS (_:many) Q }
    part type Q { v Float[0, 1] required  w Integer }
    """
)


def test_nested_children_and_shapes(spark):
    rows = spark.sql("select 'a' as id, array(named_struct('NO', 1, 'parts', array(named_struct('v', 0.5, 'w', 'q'), named_struct('v', 2.0, 'w', null))), null) as parts")
    assert issues(validate(rows, NESTED, "A")) == {'["a"]': [("E_TYPE_MISMATCH", "$.parts[0].parts[0].w"), ("E_CONSTRAINT_FAIL", "$.parts[0].parts[1].v"), ("E_EDGE_SHAPE_MISMATCH", "$.parts[1]")]}
    assert issues(validate(spark.sql("select 'a' as id, 'x' as parts"), NESTED, "A")) == {'["a"]': [("E_EDGE_SHAPE_MISMATCH", "$.parts")]}
    odd = spark.sql("select 'a' as id, array(named_struct('no', 1, 'odd', 2)) as parts")
    assert issues(validate(odd, NESTED, "A"))['["a"]'] == [] and issues(validate(odd, NESTED, "A", allow_unknown=False))['["a"]'] == [("E_UNKNOWN_FIELD", "$.parts[0].odd")]
    edges = "id string, age long, name string, works_at struct<_target_id:string,ROLE:string,odd:int>, knows struct<_target_id:string>"
    df = spark.createDataFrame([("a", 30, "Ann", ("k", "x", 1), ("b",))], edges)
    assert issues(validate(df, SCHEMA, "Person")) == {'["a"]': [("E_EDGE_SHAPE_MISMATCH", "$.knows")]}
    assert ("E_UNKNOWN_EDGE_FIELD", "$.works_at.odd") in issues(validate(df, SCHEMA, "Person", allow_unknown=False))['["a"]']


def test_build_graph(spark):
    """Only valid rows count, the first of a key stays, and duplicates have neither edges nor children."""
    people = spark.createDataFrame([("a", 30, "Ann", ("k", "x", None), [("b",)], 1), ("a", 31, "Anna", ("q", "x", None), [("a",)], 2), ("b", 3, "Bob", ("k", "x", None), [], 1), ("c", 30, "Cy", ("none", "x", None), [("b",), ("a",)], 1)], PERSON + ", n int")
    columns = {c: c for c in ("id", "age", "name")} | {"WORKS_AT": "works_at", "KNOWS": "knows"}
    companies = spark.createDataFrame([("k",), ("q",), (None,)], "id string")
    carts = spark.createDataFrame([("x", [("1", 2), ("2", 4)], 1), ("x", [("9", 2)], 2)], "id string, items array<struct<sku:string,quantity:long>>, n int")
    inputs = {"Person": graph.Input(people, columns, ("n",)), "Company": graph.Input(companies), "Cart": graph.Input(carts, {"id": "id", "ITEMS": "items"}, ("n",)), "Item": graph.Input(companies), "Nope": graph.Input(companies)}
    g = graph.build_graph(inputs, SCHEMA)
    assert sorted((r["type"].split("#")[1], r["key"]) for r in g.nodes.collect()) == [("Cart", '["x"]'), ("Company", '["k"]'), ("Company", '["q"]'), ("Person", '["a"]'), ("Person", '["c"]')]
    assert sorted((r["key"], r["relation"], r["target_key"]) for r in g.edges.collect()) == [('["a"]', "WORKS_AT", '["k"]'), ('["c"]', "KNOWS", '["a"]')]
    assert sorted((r["key"], r["relation"], r["target_key"], r["reason"]) for r in g.unresolved.collect()) == [('["a"]', "KNOWS", '["b"]', "target_missing"), ('["c"]', "KNOWS", '["b"]', "target_missing"), ('["c"]', "WORKS_AT", '["none"]', "target_missing")]
    assert sorted((r["key"], r["nth"]) for r in g.duplicates.collect()) == [('["a"]', 2), ('["x"]', 2)]
    taken = g.duplicates.filter("key = '[\"a\"]'").first()
    assert '"name":"Anna"' in taken["instance"] and '"name":"Ann"' in taken["conflict"]
    assert sorted(r["code"] for r in g.issues.collect()) == ["E_DUPLICATE_PK", "E_DUPLICATE_PK", "E_GRAPH_INVALID_COMPOSITION", "E_GRAPH_TYPE_NOT_FOUND"]
    assert sorted((r["parent_key"], r["key"]) for r in g.children("Cart", "ITEMS").collect()) == [('["x"]', '["1"]'), ('["x"]', '["2"]')]
    assert g.rejected["Person"].count() == 1 and g.rejected["Company"].count() == 1 and g.check().count() == 0
    assert [r["id"] for r in g.with_edge("Person", "WORKS_AT").collect()] == ["a"]
    with pytest.raises(ValueError):
        graph.build_graph({}, SCHEMA)
    assert graph.build_graph({"Nope": graph.Input(companies)}, SCHEMA).nodes.count() == 0


def test_absent_required_references(spark):
    schema = load_string('schema "r" type A { id String primary  --> TO (one) B } type B { id String primary }')
    g = graph.build_graph({"A": graph.Input(spark.sql("select 'a' as id")), "B": graph.Input(spark.sql("select 'b' as id"))}, schema)
    assert [(r["key"], r["reason"]) for r in g.unresolved.collect()] == [('["a"]', "absent")] and g.check().count() == 1


def test_walk_with_edges(spark):
    nodes = spark.createDataFrame([("T", "b"), ("T", "a"), ("S", "z")], "type string, key string")
    edges = spark.createDataFrame([("T", "a", "R", "T", "b"), ("T", "a", "Q", "T", "b"), ("S", "z", "R", "T", "a"), ("T", "gone", "R", "T", "a")], "type string, key string, relation string, target_type string, target_key string")
    seen = []
    assert graph.walk(nodes, lambda r: seen.append(r["key"]), edges, lambda r: seen.append(r["relation"])) == 3
    assert seen == ["z", "R", "a", "Q", "R", "b"]
