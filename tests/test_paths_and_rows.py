import pytest
from hypothesis import given
from hypothesis import strategies as st

from wardspan.functions.paths import Path, PathError, check_path, parse_path
from wardspan.operators.validate import validate
from wardspan.schema.load import load_string
from wardspan.sources.rows import frame, row_schema

SCHEMA = load_string('schema "t" type A { id String primary  n Integer  --> OF (one) A { w Float required } *-> PARTS (many) P } part type P { no String primary  v Integer[0, 9] }')
STEP = st.one_of(st.text(max_size=8), st.integers(0, 99), st.lists(st.tuples(st.from_regex(r"[a-z]{1,5}", fullmatch=True), st.text(max_size=5)), min_size=1, max_size=3).map(tuple))


@given(st.lists(STEP, max_size=6))
def test_round_trip(steps):
    path = Path(tuple(steps))
    assert parse_path(str(path)) == path


def test_forms():
    assert str(Path().key("a").index(0).key("b c").child(no="1", x='"')) == '$.a[0]["b c"][no="1",x="\\""]'
    for bad in ("", "a", "$.", "$[", "$[-1]", "$[a]", '$["a', "$.a b", "$[a=1]"):
        with pytest.raises(PathError):
            parse_path(bad)


def test_against_schema():
    assert check_path(parse_path('$.parts[no="1"].v'), SCHEMA, "A").name == "P"
    for bad in ("$.nope", '$.parts[v="1"]'):
        with pytest.raises(PathError):
            check_path(parse_path(bad), SCHEMA, "A")


def test_frame(spark):
    assert row_schema(SCHEMA, "A") == "struct<`id`:string,`n`:bigint,`of`:struct<`_target_id`:string,`w`:double>,`parts`:array<struct<`no`:string,`v`:bigint>>>"
    df = frame(spark, SCHEMA, "A", [{"id": "a", "of": {"_target_id": "b", "w": 1.0}, "parts": [{"no": "1", "v": 3}]}, {"id": "b", "of": {"_target_id": "b"}}])
    assert {r["id"]: [i["code"] for i in r["_issues"]] for r in validate(df, SCHEMA, "A").collect()} == {"a": [], "b": ["E_MISSING_REQUIRED"]}
