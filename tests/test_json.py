import json

from pyspark.sql import functions as F

from wardspan.operators.validate import issue_rows
from wardspan.schema.load import load_string
from wardspan.sources import json_read, json_write

SCHEMA = load_string(
    """schema "t"
    type Person { id String primary  age Integer[0, 150]  tags List<String>[_, 2]  score Float  ! "named" id != "bad" --> WORKS_AT Company *-> PHONES (many) Phone }
    type Company { id String primary }
    part type Phone { no String primary }
    """
)


def put(path, text):
    path.write_text(text)
    return str(path)


def test_by_type(spark, tmp_path):
    docs = json_read.documents(spark, put(tmp_path / "a.json", '{"Person": [{"id": "x"}, null, 3, {"id": "y"},], /* c */ "bad tag": [{}], "Date": [{}], // d\n "List": [{"u": "//no"}], "Company": {}}'))
    good, bad = json_read.by_type(docs)
    got = [(r["type"], r["position"], json.loads(r["j"])) for r in good.select("type", "position", F.to_json("obj").alias("j")).collect()]
    assert sorted(got, key=str) == [("List", 0, {"u": "//no"}), ("Person", 0, {"id": "x"}), ("Person", 3, {"id": "y"})]
    assert sorted(r["code"] for r in bad.collect()) == ["E_ADAPTER_PARSE"] * 3 + ["E_INVALID_TYPE_TAG"] * 2


def test_tagged_single_and_broken(spark, tmp_path):
    docs = json_read.documents(spark, put(tmp_path / "a.json", '[{"$type": "Person", "id": "x"}, {"id": "y"}, {"$type": "lower"}, {"$type": "al.Person"}]'))
    good, bad = json_read.tagged(docs)
    assert sorted((r["type"], r["j"]) for r in good.select("type", F.to_json("obj").alias("j")).collect()) == [("Person", '{"id":"x"}'), ("al.Person", "{}")]
    assert sorted(r["code"] for r in bad.collect()) == ["E_INVALID_TYPE_TAG", "E_MISSING_TYPE_TAG"]
    broken = json_read.documents(spark, put(tmp_path / "b.json", "{nope"))
    assert json_read.adapter_issues(broken).first()["code"] == "E_ADAPTER_PARSE" and json_read.single(broken, "Person")[0].count() == 0
    assert json_read.single(json_read.lines(spark, put(tmp_path / "c.jsonl", '{"id": 1}\n\n{"id"\n{"id": 2}')), "Person")[0].count() == 2
    assert json_read.documents(spark, put(tmp_path / "d.json", "[1,]"), strict=True).first()["broken"]


def test_raw_validation(spark, tmp_path):
    rows = ['{"id": "a", "age": 3, "tags": ["x"], "score": 1}', '{"ID": "b", "age": 4.0}', '{"id": "c", "Id": "d"}', '{"ID": "e", "Id": "e2"}', '{"id": "f", "age": 4.5}', '{"id": "g", "tags": ["x", 1]}', '{"id": "h", "tags": ["x", "y", "z"]}', '{"id": "i", "nope": 1, "works_at": {}}', '{"id": 5}', '{"id": "bad"}', '{"id": null}', '{"id": "j", "age": 99999999999999999999}', '{"id": "k", "score": "1"}']
    docs = json_read.typed(json_read.documents(spark, put(tmp_path / "a.json", "[" + ",".join(rows) + "]")), "Person")[0]
    out = json_read.validate_raw(docs, SCHEMA, "Person")
    got = {r["position"]: [i["code"] for i in r["_issues"]] for r in out.collect()}
    assert got == {0: [], 1: [], 2: ["E_UNKNOWN_FIELD"] if got[2] == ["E_UNKNOWN_FIELD"] else [], 3: ["E_CASE_FOLD_COLLISION", "E_MISSING_REQUIRED"], 4: ["E_TYPE_MISMATCH"], 5: ["E_TYPE_MISMATCH"], 6: ["E_CONSTRAINT_FAIL"], 7: ["E_UNKNOWN_FIELD"], 8: ["E_TYPE_MISMATCH"], 9: ["E_INVARIANT_FAIL"], 10: ["E_MISSING_REQUIRED"], 11: ["E_TYPE_MISMATCH"], 12: ["E_TYPE_MISMATCH"]}
    assert {r["position"]: r["_values"]["age"] for r in out.filter("position < 2").collect()} == {0: 3, 1: 4}
    assert issue_rows(out).count() > 0


def test_write(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, ("k",), [("2",), ("1",)]), ("b", None, None, None)], "id string, age long, w struct<_target_id:string>, p array<struct<no:string>>")
    columns = {"id": F.col("id"), "age": F.col("age"), "WORKS_AT": F.col("w"), "PHONES": F.col("p")}
    rows = json_write.rows_json(df, SCHEMA, "Person", columns, F.col("id"))
    whole = json.loads(json_write.whole_json(rows).first()["json"])
    assert whole == {"Person": [{"age": 3, "id": "a", "phones": [{"no": "1"}, {"no": "2"}], "works_at": ["k"]}, {"id": "b"}]}
    json_write.write_rows(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_long_strings_and_comments(spark, tmp_path):
    """A megabyte in one string, of escapes or in one comment needs no stack."""
    for i, text in enumerate(('["' + "x" * 1_000_000 + '",]', '["' + "\\n" * 500_000 + '"]', "[/*" + "* " * 500_000 + "*/1]", "[//" + "*" * 1_000_000 + "\n1,]")):
        row = json_read.documents(spark, put(tmp_path / f"{i}.json", text)).select(F.length("text").alias("n"), "broken").first()
        assert not row["broken"] and (i > 1 or row["n"] > 1_000_000)


DEEP = load_string(
    """schema "d"
    type A { id String primary  n Integer  --> TO (one) B { since Date required  note String }  --> MANY (many) B  *-> PARTS (one:many) P }
    type B { x String primary  y String primary }
    part type P { no String primary  size Integer[0, 9] required  ! "even" size % 2 == 0  *-> PARTS (_:many) Q }
    part type Q { v Float[0, 1] required  *-> ONE (_:one) R }
    part type R { ok Boolean required }
    """
)
CASES = [
    ('{"id": "a", "to": {"_target_x": "1", "_target_y": "2", "since": "2024-01-01", "note": "n"}, "many": [], "parts": [{"no": "1", "size": 2}]}', []),
    ('{"id": "a", "to": [], "many": {}, "parts": [{"no": "1", "size": 2}]}', [("E_EDGE_SHAPE_MISMATCH", "$.to"), ("E_EDGE_SHAPE_MISMATCH", "$.many")]),
    ('{"id": "a", "to": null, "many": [null, {"_target_x": "1"}], "parts": [{"no": "1", "size": 2}]}', [("E_EDGE_SHAPE_MISMATCH", "$.to"), ("E_EDGE_SHAPE_MISMATCH", "$.many[0]"), ("E_PARTIAL_COMPOSITE_FK", "$.many[1]")]),
    ('{"id": "a", "to": {"since": "no", "odd": 1}, "parts": [{"no": "1", "size": 2}]}', [("E_MISSING_FK_TARGET", "$.to"), ("E_TYPE_MISMATCH", "$.to"), ("E_UNKNOWN_EDGE_FIELD", "$.to.odd")]),
    ('{"id": "a", "to": {"_target_x": 1, "_target_y": "2", "SINCE": "2024-01-01", "Since": "2024-01-01"}, "parts": [{"no": "1", "size": 2}]}', [("E_TYPE_MISMATCH", "$.to"), ("E_CASE_FOLD_COLLISION", "$.to"), ("E_MISSING_REQUIRED", "$.to")]),
    ('{"id": "a"}', [("E_UNRESOLVED_REQUIRED_COMPOSITION", "$.parts")]),
    ('{"id": "a", "parts": []}', [("E_UNRESOLVED_REQUIRED_COMPOSITION", "$.parts")]),
    ('{"id": "a", "parts": {}}', [("E_EDGE_SHAPE_MISMATCH", "$.parts")]),
    ('{"id": "a", "parts": [1, {"no": "1", "size": 10}, {"no": "1", "size": 3}]}', [("E_EDGE_SHAPE_MISMATCH", "$.parts[0]"), ("E_CONSTRAINT_FAIL", "$.parts[1].size"), ("E_INVARIANT_FAIL", "$.parts[2]"), ("E_DUPLICATE_COMPOSED_PK", "$.parts")]),
    ('{"id": "a", "parts": [{"no": "1", "size": 2, "odd": 1}]}', [("E_UNKNOWN_FIELD", "$.parts[0].odd")]),
    ('{"id": "a", "parts": [{"no": "1", "size": 2, "parts": [{"v": 0.5}, {"v": 2}, {"v": 1, "one": [{"ok": true}, {"ok": false}]}, {"v": 0, "one": [{"ok": 3}]}]}]}', [("E_CONSTRAINT_FAIL", "$.parts[0].parts[1].v"), ("E_DUPLICATE_COMPOSED_PK", "$.parts[0].parts[2].one"), ("E_TYPE_MISMATCH", "$.parts[0].parts[3].one[0].ok")]),
    ('{"id": "a", "Parts": [{"no": "1", "size": 2}], "PARTS": []}', [("E_CASE_FOLD_COLLISION", "$.parts"), ("E_UNRESOLVED_REQUIRED_COMPOSITION", "$.parts")]),
]


def test_references_and_children_of_raw_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", F.parse_json("t").alias("obj"))
    out = json_read.validate_raw(rows, DEEP, "A")
    got = {r["i"]: sorted((x["code"], x["path"]) for x in r["_issues"]) for r in out.collect()}
    assert got == {i: sorted(want) for i, (_, want) in enumerate(CASES)}
    assert out.columns == ["i", "obj", "_values", "_key", "_issues", "_dropped"]
    assert out.filter("size(_issues) = 0").count() == 1
    for name, code in (("P", "E_PART_TYPE_DIRECT"), ("Z", "E_INSTANCE_TYPE_NOT_FOUND")):
        assert issue_rows(json_read.validate_raw(rows, DEEP, name)).first()["code"] == code
    assert issue_rows(json_read.validate_raw(rows, DEEP, "P", as_child=True)).count() > 0
