import pytest
from pyspark.sql import functions as F

from wardspan.functions import builtins
from wardspan.functions.compiler import BOOL, FLOAT, INT, STR, CompileError, Kind, Value, compile_text, list_kind

def columns():
    return {"i": (F.lit(7), INT), "f": (F.lit(2.5), FLOAT), "s": (F.lit("héllo"), STR), "n": (F.lit(None), INT), "b": (F.lit(True), BOOL), "l": (F.array(F.lit(3), F.lit(None), F.lit(1)), list_kind(INT)), "o": (F.struct(F.lit(1).alias("a"), F.lit("x").alias("Bc")), Kind("struct", fields=(("a", INT), ("Bc", STR))))}
ERROR = object()

CASES = [
    ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7 / 0", ERROR), ("7 % 0", ERROR), ("1.0 / 0.0", float("inf")), ("-1.0 / 0.0", float("-inf")), ("1 + 1.5", 2.5), ("9223372036854775807 + 1", ERROR), ("\"a\" + \"b\"", "ab"), ("[1] + nil", [1]), ("1 + \"a\"", ERROR), ("1.5 % 1.0", ERROR),
    ("1 == 1.0", True), ("1 == \"1\"", False), ("nil == nil", True), ("n == nil", True), ("n < 0", True), ("0 < n", False), ("nil < false", True), ("true < 0", True), ("5 < \"a\"", True), ("\"z\" < [1]", True), ("[1, 2] < [1, 3]", True), ("[1] < [1, 0]", True),
    ("b && 1 / 0 == 1", ERROR), ("!b && 1 / 0 == 1", False), ("b || 1 / 0 == 1", True), ("i && b", ERROR), ("true ^ false", True), ("nil && true", ERROR), ("!i", ERROR),
    ("i in [1, 7]", True), ("i in nil", False), ("nil in [1, nil]", True), ("i in 3", ERROR), ("s =~ /^h.l+o$/", True), ("s !~ /z/", True), ("i =~ /7/", ERROR), ("f =~ Integer", False), ("2.0 =~ Integer", True), ("i =~ Float", True), ("s =~ UUID", False), ("\"2024-02-29\" =~ Date", True), ("\"2023-02-29\" =~ Date", False), ("\"2024-02-29T10:00:00Z\" =~ Timestamp", True), ("\"123e4567-e89b-12d3-a456-426614174000\" =~ UUID", True), ("s =~ Enum", ERROR),
    ("s[1]", "é"), ("s[9]", None), ("s[-1]", None), ("l[0]", 3), ("l[5]", None), ("n[0]", ERROR), ("nil[0]", None), ("s[0, 2]", "h"), ("o.a", 1), ("o.bC", "x"), ("o.zzz", None), ("s.zzz", ERROR), ("o.bc -> Upper", "X"),
    ("b ? { 1 : 2.5 }", 1.0), ("!b ? { 1 : 1 / 0 }", ERROR), ("b ? { 1 : 1 / 0 }", 1), ("b ? { 1 }", ERROR),
    ("l -> Len", 3), ("nil -> Len", 0), ("i -> Len", ERROR), ("s -> Len", 5), ("l -> Compact -> Sum", 4), ("l -> Sum", ERROR), ("[] -> Sum", 0), ("[1, 2.5] -> Sum", 3.5), ("l -> Sort", [None, 1, 3]), ("l -> Min", None), ("l -> Max", 3), ("[] -> Max", ERROR), ("3 -> Min(2)", 2), ("n -> Max(2)", 2), ("l -> Contains(nil)", True), ("l -> First", 3), ("l -> Last", 1), ("[] -> First", None), ("[2, 1, 2] -> Unique", [2, 1]), ("[[1], [2, 3]] -> Flatten", [1, 2, 3]), ("[1, 2] -> Flatten", [1, 2]), ("l -> Reverse", [1, None, 3]),
    ("[1, 2, 3] -> Map |$x| { $x * 2 }", [2, 4, 6]), ("[1, 2] -> Map { $0 + 1 }", [2, 3]), ("[1, 0] -> Map |$x| { 1 / $x }", ERROR), ("[1, 2] -> Filter |$x| { $x }", ERROR), ("[1, 2, 3] -> Reduce |$a, $x| { $a - $x }", -4), ("[1, 2] -> Reduce(0.5) |$a, $x| { $a + $x }", 3.5), ("[] -> Reduce |$a, $x| { $a }", ERROR), ("[1, 2] -> Reduce(0) |$a| { $a + $1 }", 3), ("[1, 2] -> All", ERROR), ("l -> Any |$x| { $x == nil }", True), ("[[1, 2], [3]] -> Map |$x| { $x -> Map |$y| { $y + 1 } -> Sum }", [5, 4]),
    ("nil -> Then |$x| { 1 / 0 }", None), ("i -> Then |$x| { $x + 1 }", 8), ("n -> Lest { 4 }", 4), ("i -> Lest { 1 / 0 }", 7), ("nil -> With |$x| { $x == nil }", True), ("n -> Default(3)", 3), ("n -> Coalesce(nil, 5)", 5), ("n -> IsNil", True), ("s -> TypeOf", "string"), ("n -> TypeOf", "nil"), ("l -> TypeOf", "[]any"),
    ("-7 -> Abs", 7), ("-2.5 -> Round", -2.0), ("0.5 -> Round", 0.0), ("1.5 -> Round", 2.0), ("2.1 -> Ceil", 3.0), ("i -> Floor", 7), ("s -> Abs", ERROR), ("1 -> Compare(\"a\")", -1), ("2 -> Compare(1.5)", 1),
    ("s -> Upper", "HÉLLO"), ("nil -> Upper", ERROR), ("\" \\t a \\n\" -> Trim", "a"), ("s -> TrimPrefix(\"hé\")", "llo"), ("s -> TrimSuffix(\"lo\")", "hél"), ("\"a.b\" -> Split(\".\")", ["a", "b"]), ("s -> Split(\"\")", ["h", "é", "l", "l", "o"]), ("\"\" -> Split(\",\")", [""]), ("[\"a\", \"b\"] -> Join(\"-\")", "a-b"), ("[\"a\", nil] -> Join(\"-\")", ERROR), ("[1] -> Join(\"-\")", ERROR), ("s -> Replace(\"l\", \"L\")", "héLLo"), ("\"ab\" -> Replace(\"\", \"-\")", "-a-b-"), ("s -> Substring(1, 3)", "él"), ("s -> Substring(-2)", "lo"), ("s -> Substring(3, 1)", ""), ("s -> Substring(0, 99)", "héllo"), ("s -> Match(/h(.)(l+)/)", ["héll", "é", "ll"]), ("s -> Match(/q/)", None), ("s -> StartsWith(\"h\")", True), ("s -> EndsWith(i)", ERROR), ("s -> Nope", ERROR), ("s -> Upper(1)", ERROR), ("[1] -> Map", ERROR), ("$zz", ERROR), ("_ == nil", True),
]


def test_cases(spark):
    found = []
    for k, (text, _) in enumerate(CASES):
        v = compile_text(text, columns())
        found += [v.value.alias(f"v{k}"), (v.error if v.error is not None else F.lit(None).cast("string")).alias(f"e{k}")]
    row = spark.range(1).select(*found).first()
    wrong = [(text, want, row[f"v{k}"], row[f"e{k}"]) for k, (text, want) in enumerate(CASES) if (row[f"e{k}"] is None if want is ERROR else row[f"e{k}"] is not None or row[f"v{k}"] != want)]
    assert not wrong


def test_mixed_lists_are_refused():
    with pytest.raises(CompileError):
        compile_text('[1, "a"]', {})


def test_own_function(spark):
    builtins.register("Twice", lambda call, recv, args: Value(recv.kind, recv.value * 2, recv.error), 0, 0)
    assert spark.range(1).select(compile_text("4 -> twice", {}).value).first()[0] == 8
    assert "Twice" in builtins.names()
    del builtins.BUILTINS["twice"]
