import pytest

from wardspan.diag import SchemaError
from wardspan.schema import build as b
from wardspan.schema.load import Registry, default_alias, load, load_sources, load_string
from wardspan.schema.model import lower_snake
from wardspan.schema.parser import parse_expression


def codes(body, head='schema "t"\n'):
    try:
        load_string(head + body)
    except SchemaError as e:
        return e.problems.codes()
    return []


def test_members_and_inheritance():
    s = load_string(
        """schema "t"
        abstract type Named { name String required }
        abstract type Timed { at Timestamp required  ! "m" name == "a" || true }
        type Money = Float[0, _]
        type Doc extends Named, Timed { id UUID primary  price Money  --> OWNER (one) Person / DOCS (many) { since Date } *-> PAGES (one:many) Page }
        type Person extends Named { id String primary }
        part type Page { no Integer[1, _] required }
        """.replace('name == "a" || true', "true")
    )
    doc = s.types["Doc"]
    assert [p.name for p in doc.all_properties] == ["id", "price", "name", "at"]
    assert doc.ancestors == ("Named", "Timed") and s.subtypes("Named") == ["Doc", "Person"]
    assert doc.property("price").constraint.kind == "Float" and doc.property("price").constraint.low == 0
    owner, pages = doc.all_relations
    assert (owner.optional, owner.many, owner.reverse, owner.reverse_many) == (False, False, "DOCS", True)
    assert (pages.optional, pages.many, pages.composition) == (False, True, True)
    assert [i.message for i in doc.all_invariants] == ["m"]


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("type A { id Integer primary }", "E_INVALID_PRIMARY_KEY_TYPE"),
        ("type A { x Integer[5, 1] }", "E_INVALID_CONSTRAINT"),
        ("type A { x String[-1, 1] }", "E_SYNTAX"),
        ('type A { x Enum["a", "a"] }', "E_INVALID_CONSTRAINT"),
        ('type A { x Pattern["(?=a)"] }', "E_INVALID_CONSTRAINT"),
        ("type A { v Vector[0] }".replace("v ", "vv "), "E_INVALID_CONSTRAINT"),
        ("type A { x String x String }", "E_DUPLICATE_PROPERTY"),
        ("type A {} type A {}", "E_DUPLICATE_TYPE"),
        ("type A extends B {} type B extends A {}", "E_INHERIT_CYCLE"),
        ("type A extends Nope {}", "E_UNKNOWN_TYPE"),
        ("type A { x Integer[0, 5] } type B extends A { x Integer[0, 9] }", "E_PROPERTY_CONFLICT"),
        ("type A { x String required } type B extends A { x String }", "E_PROPERTY_CONFLICT"),
        ("type A { --> R Nope }", "E_UNKNOWN_TYPE"),
        ("type A { *-> R A }", "E_INVALID_COMPOSITION_TARGET"),
        ("part type P {} type A { --> R P }", "E_INVALID_ASSOCIATION_TARGET"),
        ("type A {} part type P { --> R A }", "E_INVALID_RELATION"),
        ("type A { --> R A { x Vector[3] } }", "E_INVALID_CONSTRAINT"),
        ("type A { --> R A { x List<String> } }", "E_LIST_ON_EDGE"),
        ("type A { --> R A --> R A }", "E_DUPLICATE_RELATION"),
        ("type A { worksAt String --> WORKS_AT A }".replace("worksAt", "works_at"), "E_PROPERTY_RELATION_COLLISION"),
        ("type A { --> WorksAt A --> WORKS_AT A }", "E_RELATION_NORMALIZATION_COLLISION"),
        ("type A { aB String ab String }", "E_CASE_COLLISION"),
        ("type A { _x String }", "E_SYNTAX"),
        ('type A { ! "m" nope == 1 }', "E_UNKNOWN_PROPERTY"),
        ("type A {", "E_SYNTAX"),
    ],
)
def test_problems(body, code):
    assert code in codes(body)


def test_narrowing_and_keywords_pass():
    assert codes('type A { x Integer[0, 150]  e Enum["a", "b", "c"] } type B extends A { x Integer[18, 65] required  e Enum["a", "b"] }') == []
    assert codes("type A { schema String type String required String primary String }") == []


def test_imports(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "main.txt").write_text('schema "m" import "./lib/parts-x" import "./lib/other" as o  type A { w parts_x.Size  --> WHEEL parts_x.Wheel  --> THING o.Thing }')
    (tmp_path / "lib/parts-x.txt").write_text('schema "p"  type Size = Integer[1, 3]  type Wheel { id String primary }')
    (tmp_path / "lib/other.txt").write_text('schema "q"  type Thing { id String primary }')
    s = load(str(tmp_path / "main.txt"))
    assert s.find("parts_x.Wheel").name == "Wheel" and s.types["A"].property("w").constraint.high == 3
    assert s.type_id("o.Thing") == "lib/other.txt#Thing"
    r = Registry()
    r.register(s)
    assert r.type("main.txt#A").name == "A"
    with pytest.raises(ValueError):
        r.register(s)


@pytest.mark.parametrize(
    ("sources", "code"),
    [
        ({"a.s": 'schema "a" import "./b"', "b.s": 'schema "b" import "./a"'}, "E_IMPORT_CYCLE"),
        ({"a.s": 'schema "a" import "../../etc/x"'}, "E_PATH_ESCAPE"),
        ({"a.s": 'schema "a" import "./nope"'}, "E_IMPORT_RESOLVE"),
        ({"a.s": 'schema "a" import "./b" as type', "b.s": 'schema "b"'}, "E_INVALID_ALIAS"),
        ({"a.s": 'schema "a" import "./b" import "./b" as c', "b.s": 'schema "b"'}, "E_DUPLICATE_IMPORT"),
        ({"a.s": 'schema "a" import "./b" import "./c" as b', "b.s": 'schema "b"', "c.s": 'schema "c"'}, "E_IMPORT_ALIAS_COLLISION"),
        ({"a.s": 'schema "a" import "./b"', "b.s": 'schema "b" type A { x Integer[2, 1] }'}, "E_UPSTREAM_FAIL"),
    ],
)
def test_import_problems(sources, code):
    with pytest.raises(SchemaError) as e:
        load_sources(sources)
    assert code in e.value.problems.codes()


def test_string_has_no_imports():
    assert "E_IMPORT_NOT_ALLOWED" in codes("", 'schema "t" import "./b"\n')


def test_names():
    assert [lower_snake(x) for x in ("WORKS_AT", "worksAt", "HTTPServer", "Owner")] == ["works_at", "works_at", "http_server", "owner"]
    assert default_alias("./3rd-party", "") == "n3rd_party"


def test_builder_equals_text():
    built = b.SchemaBuilder("t").type("N").key("id", b.string()).required("name", b.string(1, 5)).association("OF", "N", "one").invariant("i", "name != nil").end().build()
    read = load_string('schema "t" type N { id String primary  name String[1, 5] required  --> OF (one) N  ! "i" name != nil }')
    a, c = built.types["N"], read.types["N"]
    assert [(p.name, p.constraint, p.optional, p.primary) for p in a.all_properties] == [(p.name, p.constraint, p.optional, p.primary) for p in c.all_properties]
    assert a.all_invariants[0].expression == c.all_invariants[0].expression


def test_precedence():
    assert parse_expression("-x -> Abs") == ("call", ("neg", ("name", "x")), "Abs", (), (), None)
    assert parse_expression("!a == b") == ("op", "==", ("not", ("name", "a")), ("name", "b"))
    assert parse_expression("a || b && c") == ("op", "||", ("name", "a"), ("op", "&&", ("name", "b"), ("name", "c")))
    assert parse_expression("6 / 2 / 3 =~ /a\\/b/")[1] == "=~"


def test_rendering_of_diagnostics():
    import json

    from wardspan.diag import Problems, render_json, render_text

    one, two = Problems(limit=2), Problems()
    two.add("E_SYNTAX", "odd token", "b.txt", 3)
    two.add("E_INVALID_NAME", "no name", "a.txt")
    two.add("E_SYNTAX", "another", "b.txt", 1)
    one.merge(two)
    assert render_text(one) == "a.txt: error[E_INVALID_NAME]: no name\nb.txt:3: error[E_SYNTAX]: odd token\n1 more not shown"
    said = json.loads(render_json(one))
    assert said["dropped"] == 1 and said["issues"][0] == {"severity": "error", "code": "E_INVALID_NAME", "category": "schema", "message": "no name", "source": "a.txt"}
    assert render_text(Problems()) == ""
