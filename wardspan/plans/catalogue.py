"""Queries over the driver's tables, each with an SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diag import of_category
from ..functions.compiler import BOOL, FLOAT, INT, STR, Kind, compile_text, list_kind
from ..operators import checks, graph
from ..operators.validate import coerce, issue_rows, key_string, split, validate, validate_children
from ..schema.model import Constraint
from ..sources import json_read, json_write
from .tables import BINDINGS, bound, day, shop, table, target, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = list_kind(STR)


def add(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# Expressions: one value per row ---------------------------------------------------------------------------------------

#: What expressions call the columns of each table: (column or SQL for Spark, kind).
NAMES: dict[str, dict[str, tuple[str, Kind]]] = {
    "nation": {"name": ("n_name", STR), "region": ("n_regionkey", INT), "key": ("n_nationkey", INT)},
    "customer": {"name": ("c_name", STR), "balance": ("c_acctbal", FLOAT), "segment": ("c_mktsegment", STR), "nation": ("c_nationkey", INT), "odd": ("c_custkey % 2 = 1", BOOL), "gap": ("case when c_custkey % 3 <> 0 then c_acctbal end", FLOAT), "nick": ("case when c_custkey % 4 <> 0 then c_mktsegment end", STR), "whole": ("case when c_custkey % 5 <> 0 then c_nationkey end", INT)},
    "part": {"name": ("p_name", STR), "size": ("p_size", INT), "price": ("p_retailprice", FLOAT), "brand": ("p_brand", STR), "words": ("split(p_name, ' ')", WORDS), "more": ("array(p_type, p_brand, p_type)", WORDS), "sizes": ("array(p_size, p_size % 7, 10 - p_size)", list_kind(INT)), "holes": ("array(p_name, case when p_size % 2 = 0 then p_type end)", WORDS), "nested": ("array(split(p_name, ' '), array(p_brand))", list_kind(WORDS))},
    "supplier": {"at": ("struct(s_suppkey as id, s_name as Label, struct(s_nationkey as nation) as home)", Kind("struct", fields=(("id", INT), ("Label", STR), ("home", Kind("struct", fields=(("nation", INT),)))))), "balance": ("s_acctbal", FLOAT)},
    "lineitem": {"price": ("l_extendedprice", FLOAT), "quantity": ("l_quantity", FLOAT), "line": ("l_linenumber", INT), "part": ("l_partkey", INT), "supplier": ("l_suppkey", INT), "discount": ("l_discount", FLOAT)},
}
KEYS = {"nation": "n_nationkey", "customer": "c_custkey", "part": "p_partkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}


def expression_query(table_name: str, expression: str, result: str = "string") -> Query:
    """k, v and failed for every row; a list comes as text, joined by a bar."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = compile_text(expression, {n: (F.expr(c), k) for n, (c, k) in NAMES[table_name].items()})
        failed = v.error.isNotNull() if v.error is not None else F.lit(False)
        value = v.value if v.kind.name != "list" else F.array_join(F.transform(v.value, lambda x: F.coalesce(x.cast("string"), F.lit("nil"))), "|")
        return table(spark, sf_dir, table_name).select(F.col(KEYS[table_name]).cast("long").alias("k"), F.when(~failed, value).alias("v"), failed.alias("failed"))

    return run


def expressions(entries: list[tuple[str, str, str, str]]) -> None:
    for name, table_name, expression, sql in entries:
        QUERIES[name] = expression_query(table_name, expression)
        value, _, failed = sql.partition(" FAILED ")
        failed = failed or "false"
        guarded = f"CASE WHEN NOT ({failed}) THEN {value} END" if failed != "false" else value
        SQL[name] = f"SELECT {KEYS[table_name]}::BIGINT AS k, {guarded} AS v, {failed} AS failed FROM {table_name}"


GAP = "(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END)"
NICK = "(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END)"
WHOLE = "(CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END)"
SPLIT = "string_split(p_name, ' ')"
MORE = "[p_type, p_brand, p_type]"
SIZES = "[p_size, p_size % 7, 10 - p_size]"
HOLES = "[p_name, CASE WHEN p_size % 2 = 0 THEN p_type END]"
BAR = lambda s: f"array_to_string({s}, '|')"
BARNIL = lambda s: f"array_to_string(list_transform({s}, lambda z: coalesce(z, 'nil')), '|')"

expressions(
    [
        # Logic
        ("op_and", "customer", "odd && balance > 0.0", "(c_custkey % 2 = 1) AND c_acctbal > 0"),
        ("op_and_short_circuit", "customer", "odd && gap / 2.0 > 10.0", "CASE WHEN c_custkey % 2 <> 1 THEN false ELSE " + GAP + " / 2 > 10 END FAILED c_custkey % 2 = 1 AND c_custkey % 3 = 0"),
        ("op_or", "customer", "odd || segment == \"BUILDING\"", "(c_custkey % 2 = 1) OR c_mktsegment = 'BUILDING'"),
        ("op_xor", "customer", "odd ^ (balance > 1000.0)", "(c_custkey % 2 = 1) <> (c_acctbal > 1000)"),
        ("op_not", "customer", "!odd", "NOT (c_custkey % 2 = 1)"),
        ("op_ternary", "customer", "balance < 0.0 ? { \"debt\" : segment }", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END"),
        ("op_ternary_without_else", "customer", "odd ? { 1 }", "NULL::BIGINT FAILED true"),
        ("op_eq_nil", "customer", "gap == nil", GAP + " IS NULL"),
        ("op_neq", "customer", "nick != segment", NICK + " IS DISTINCT FROM c_mktsegment"),
        ("op_eq_cross_kind", "customer", "name == balance", "false"),
        ("op_cmp_nil", "customer", "gap < 100.0", "CASE WHEN " + GAP + " IS NULL THEN true ELSE " + GAP + " < 100 END"),
        ("op_cmp_cross_kind", "customer", "balance < name", "true"),
        ("op_ge", "customer", "balance >= 5000.0", "c_acctbal >= 5000"),
        ("op_le_int_float", "customer", "nation <= balance", "c_nationkey <= c_acctbal"),
        ("op_in", "customer", "segment in [\"BUILDING\", \"MACHINERY\"]", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
        ("op_member", "supplier", "at.id + at.home.nation", "s_suppkey + s_nationkey"),
        ("op_member_folded", "supplier", "at.label -> Upper", "upper(s_name)"),
        ("op_member_missing", "supplier", "at.nowhere == nil", "true"),
        ("op_method_chain", "supplier", 'at.label -> Substring(0, 4) -> Lower', "lower(substr(s_name, 1, 4))"),
        ("op_match", "customer", "name =~ /0[13579]$/", "regexp_matches(c_name, '0[13579]$')"),
        ("op_match_nil", "customer", "nick =~ /^B/", "regexp_matches(" + NICK + ", '^B') FAILED " + NICK + " IS NULL"),
        ("op_not_match", "customer", "segment !~ /^[A-H]/", "NOT regexp_matches(c_mktsegment, '^[A-H]')"),
        ("op_type_match", "customer", "balance =~ Integer", "c_acctbal = floor(c_acctbal)"),
        ("op_index", "part", "words[1]", SPLIT + "[2]"),
        ("op_index_text", "part", "name[2]", "CASE WHEN length(p_name) > 2 THEN substr(p_name, 3, 1) END"),
        ("op_index_bad", "part", "words[-1]", "NULL::VARCHAR"),
        # Arithmetic
        ("op_add", "lineitem", "line + part", "l_linenumber::BIGINT + l_partkey"),
        ("op_add_mixed", "lineitem", "line + quantity", "l_linenumber + l_quantity"),
        ("op_sub", "lineitem", "part - supplier", "l_partkey - l_suppkey"),
        ("op_mul", "lineitem", "price * discount", "l_extendedprice * l_discount"),
        ("op_div_int", "lineitem", "(supplier - part) / line", "CASE WHEN l_suppkey - l_partkey < 0 THEN -((l_partkey - l_suppkey) // l_linenumber) ELSE (l_suppkey - l_partkey) // l_linenumber END::BIGINT"),
        ("op_div_zero", "part", "100 / (size % 3)", "(100 // nullif(p_size % 3, 0))::BIGINT FAILED p_size % 3 = 0"),
        ("op_div_float", "lineitem", "price / quantity", "l_extendedprice / l_quantity"),
        ("op_div_float_zero", "lineitem", "price / (discount * 0.0)", "'infinity'::DOUBLE"),
        ("op_mod", "lineitem", "(supplier - part) % line", "((l_suppkey - l_partkey) % l_linenumber)::BIGINT"),
        ("op_neg", "lineitem", "-line", "(-l_linenumber)::BIGINT"),
        ("op_concat", "customer", "name + \"/\" + segment", "c_name || '/' || c_mktsegment"),
        ("op_concat_nil", "customer", "name + nick", "c_name || " + NICK + " FAILED " + NICK + " IS NULL"),
        ("op_list_concat", "part", "words + more", BAR(f"list_concat({SPLIT}, {MORE})")),
        # Collections
        ("fn_reduce", "part", "sizes -> Reduce(100) |$a, $x| { $a - $x }", "(100 - p_size - p_size % 7 - (10 - p_size))::BIGINT"),
        ("fn_reduce_seedless", "part", "sizes -> Reduce |$a, $x| { $a * 2 + $x }", "((p_size * 2 + p_size % 7) * 2 + (10 - p_size))::BIGINT"),
        ("fn_map", "part", "words -> Map |$w| { $w -> Upper }", BAR(f"list_transform({SPLIT}, lambda w: upper(w))")),
        ("fn_filter", "part", "words -> Filter |$w| { $w -> Len > 4 }", BAR(f"list_filter({SPLIT}, lambda w: length(w) > 4)")),
        ("fn_count", "part", "sizes -> Count |$x| { $x > 3 }", f"len(list_filter({SIZES}, lambda x: x > 3))::BIGINT"),
        ("fn_all", "part", "sizes -> All |$x| { $x > 0 }", "p_size > 0 AND p_size % 7 > 0 AND 10 - p_size > 0"),
        ("fn_any", "part", "sizes -> Any |$x| { $x > 30 }", "p_size > 30 OR p_size % 7 > 30 OR 10 - p_size > 30"),
        ("fn_allornone", "part", "sizes -> AllOrNone |$x| { $x % 2 == 0 }", f"len(list_filter({SIZES}, lambda x: x % 2 = 0)) IN (0, 3)"),
        ("fn_compact", "part", "holes -> Compact", BAR(f"list_filter({HOLES}, lambda x: x IS NOT NULL)")),
        ("fn_unique", "part", "more -> Unique", BAR("CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END")),
        ("fn_len", "part", "words -> Len", f"len({SPLIT})::BIGINT"),
        ("fn_len_text", "part", "name -> Len", "length(p_name)::BIGINT"),
        ("fn_sum", "part", "sizes -> Sum", "(p_size + p_size % 7 + 10 - p_size)::BIGINT"),
        ("fn_first", "part", "words -> First", SPLIT + "[1]"),
        ("fn_last", "part", "words -> Last", SPLIT + "[-1]"),
        ("fn_sort", "part", "holes -> Sort", BARNIL(f"list_sort({HOLES}, 'ASC', 'NULLS FIRST')")),
        ("fn_reverse", "part", "holes -> Reverse", BARNIL(f"list_reverse({HOLES})")),
        ("fn_flatten", "part", "nested -> Flatten", BAR(f"list_concat({SPLIT}, [p_brand])")),
        ("fn_contains", "part", "words -> Contains(\"ring\")", f"list_contains({SPLIT}, 'ring')"),
        ("fn_contains_nil", "part", "holes -> Contains(nil)", "p_size % 2 <> 0"),
        # Control flow and kinds
        ("fn_then", "customer", "nick -> Then |$x| { $x -> Lower }", f"lower({NICK})"),
        ("fn_lest", "customer", "nick -> Lest { name }", f"coalesce({NICK}, c_name)"),
        ("fn_with", "customer", "balance -> With |$b| { $b * $b }", "c_acctbal * c_acctbal"),
        ("fn_typeof", "customer", "gap -> TypeOf", f"CASE WHEN {GAP} IS NULL THEN 'nil' ELSE 'float64' END"),
        ("fn_isnil", "customer", "nick -> IsNil", f"{NICK} IS NULL"),
        ("fn_default", "customer", "gap -> Default(0.0)", f"coalesce({GAP}, 0.0::DOUBLE)"),
        ("fn_coalesce", "customer", "nick -> Coalesce(nil, name)", f"coalesce({NICK}, c_name)"),
        # Math
        ("fn_abs", "customer", "balance -> Abs", "abs(c_acctbal)"),
        ("fn_floor", "customer", "balance -> Floor", "floor(c_acctbal)"),
        ("fn_ceil", "customer", "balance -> Ceil", "ceil(c_acctbal)"),
        ("fn_round", "lineitem", "quantity / 2.0 -> Round", "l_quantity / round_even(2.0::DOUBLE, 0)"),
        ("fn_round_half_even", "lineitem", "(quantity / 2.0) -> Round", "round_even(l_quantity / 2.0::DOUBLE, 0)"),
        ("fn_min", "customer", "gap -> Min(0.0)", f"CASE WHEN {GAP} IS NULL THEN NULL ELSE least({GAP}, 0.0::DOUBLE) END"),
        ("fn_max", "customer", "gap -> Max(0.0)", f"greatest(coalesce({GAP}, 0.0::DOUBLE), 0.0::DOUBLE)"),
        ("fn_min_list", "part", "sizes -> Min", f"list_min({SIZES})::BIGINT"),
        ("fn_max_list", "part", "sizes -> Max", f"list_max({SIZES})::BIGINT"),
        ("fn_compare", "customer", "whole -> Compare(7)", f"CASE WHEN {WHOLE} IS NULL THEN -1 ELSE sign({WHOLE} - 7) END::BIGINT"),
        # Strings
        ("fn_upper", "part", "name -> Upper", "upper(p_name)"),
        ("fn_lower", "customer", "segment -> Lower", "lower(c_mktsegment)"),
        ("fn_trim", "customer", "(\" \" + name + \"  \") -> Trim", "c_name"),
        ("fn_trimprefix", "customer", "name -> TrimPrefix(\"Customer#\")", "substr(c_name, 10)"),
        ("fn_trimsuffix", "customer", "name -> TrimSuffix(\"7\")", "CASE WHEN suffix(c_name, '7') THEN substr(c_name, 1, length(c_name) - 1) ELSE c_name END"),
        ("fn_split", "part", "name -> Split(\"r\")", BAR("string_split(p_name, 'r')")),
        ("fn_join", "part", "words -> Join(\"-\")", f"array_to_string({SPLIT}, '-')"),
        ("fn_join_nil", "part", "holes -> Join(\"-\")", "p_name || '-' || p_type FAILED p_size % 2 <> 0"),
        ("fn_startswith", "part", "name -> StartsWith(\"small\")", "starts_with(p_name, 'small')"),
        ("fn_endswith", "part", "name -> EndsWith(\"ring\")", "suffix(p_name, 'ring')"),
        ("fn_replace", "part", "name -> Replace(\"r\", \"RR\")", "replace(p_name, 'r', 'RR')"),
        ("fn_substring", "part", "name -> Substring(-4, -1)", "substr(p_name, greatest(length(p_name) - 4, 0) + 1, greatest(length(p_name) - 1 - greatest(length(p_name) - 4, 0), 0))"),
        ("fn_match", "customer", "name -> Match(/#0*([1-9][0-9]*)/)", "CASE WHEN regexp_matches(c_name, '#0*([1-9][0-9]*)') THEN regexp_extract(c_name, '#0*([1-9][0-9]*)', 0) || '|' || regexp_extract(c_name, '#0*([1-9][0-9]*)', 1) END"),
        ("fn_unknown", "nation", "name -> Frobnicate", "NULL::VARCHAR FAILED true"),
    ]
)
SQL["fn_round"] = SQL["fn_round"].replace("l_quantity / round_even(2.0::DOUBLE, 0)", "l_quantity / 2.0::DOUBLE")


# Constraints: rows by code --------------------------------------------------------------------------------------------


def constraint_query(table_name: str, constraint: Constraint, value: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = checks.check(constraint, value())
        return table(spark, sf_dir, table_name).select(F.coalesce(found["code"], F.lit("ok")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))

    return run


def constraints(entries: list[tuple[str, str, Constraint, Callable[[], Column], str]]) -> None:
    """The SQL is a CASE's branches."""
    for name, table_name, constraint, value, cases in entries:
        QUERIES[name] = constraint_query(table_name, constraint, value)
        SQL[name] = f"SELECT CASE {cases} ELSE 'ok' END AS code, count(*)::BIGINT AS n FROM {table_name} GROUP BY 1"


FAIL, MISMATCH = "'E_CONSTRAINT_FAIL'", "'E_TYPE_MISMATCH'"
UUID = lambda: F.concat(F.substring(F.md5(text("c_custkey")), 1, 8), F.lit("-0000-4000-8000-"), F.lpad(F.when(F.col("c_custkey") % 3 == 0, F.lit("xyz")).otherwise(text("c_custkey")), 12, "0"))
constraints(
    [
        ("chk_string_len", "part", Constraint("String", 8, 11), lambda: F.col("p_name"), f"WHEN length(p_name) NOT BETWEEN 8 AND 11 THEN {FAIL}"),
        ("chk_int_range", "part", Constraint("Integer", 5, 40), lambda: F.col("p_size").cast("long"), f"WHEN p_size NOT BETWEEN 5 AND 40 THEN {FAIL}"),
        ("chk_float_range", "lineitem", Constraint("Float", 0.02, 0.08), lambda: F.col("l_discount"), f"WHEN l_discount NOT BETWEEN 0.02 AND 0.08 THEN {FAIL}"),
        ("chk_enum", "customer", Constraint("Enum", values=("BUILDING", "MACHINERY", "HOUSEHOLD")), lambda: F.col("c_mktsegment"), f"WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN {FAIL}"),
        ("chk_pattern", "customer", Constraint("Pattern", values=("^Customer#", "[02468]$")), lambda: F.col("c_name"), f"WHEN NOT regexp_matches(c_name, '^Customer#') OR NOT regexp_matches(c_name, '[02468]$') THEN {FAIL}"),
        ("chk_date", "orders", Constraint("Date"), lambda: F.when(F.col("o_orderkey") % 7 == 0, F.lit("1997-02-30")).otherwise(day("o_orderdate")), f"WHEN o_orderkey % 7 = 0 THEN {MISMATCH}"),
        ("chk_timestamp", "events", Constraint("Timestamp"), lambda: F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit("+02:00"))), f"WHEN event_id % 5 = 0 THEN {MISMATCH}"),
        ("chk_timestamp_layout", "events", Constraint("Timestamp", format="2006-01-02 15:04"), lambda: F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm"), f"WHEN false THEN {FAIL}"),
        ("chk_uuid", "customer", Constraint("UUID"), UUID, f"WHEN c_custkey % 3 = 0 THEN {MISMATCH}"),
        ("chk_vector", "embeddings", Constraint("Vector", size=64), lambda: F.when(F.col("vec_id") % 10 == 0, F.slice(F.col("embedding").cast("array<double>"), 1, 60)).otherwise(F.col("embedding").cast("array<double>")), f"WHEN vec_id % 10 = 0 THEN {FAIL}"),
        ("chk_list", "part", Constraint("List", 1, 2, element=Constraint("String", 4, None)), lambda: F.split("p_name", " "), f"WHEN len({SPLIT}) NOT BETWEEN 1 AND 2 OR len(list_filter({SPLIT}, lambda w: length(w) < 4)) > 0 THEN {FAIL}"),
        ("chk_finite", "customer", Constraint("Float"), lambda: F.when(F.col("c_custkey") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")), f"WHEN c_custkey % 6 = 0 THEN {MISMATCH}"),
        ("chk_null_passes", "customer", Constraint("Float", 0, None), lambda: F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), f"WHEN {GAP} < 0 THEN {FAIL}"),
    ]
)


@add("chk_list_index", f"SELECT p_partkey::BIGINT AS k, (list_position(list_transform({SPLIT}, lambda w: length(w) < 5), true) - 1)::BIGINT AS at FROM part WHERE list_contains(list_transform({SPLIT}, lambda w: length(w) < 5), true)")
def chk_list_index(spark, sf_dir):
    at = checks.failing_index(Constraint("List", element=Constraint("String", 5, None)), F.split("p_name", " "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), at.cast("long").alias("at")).filter("at is not null")


# Validation -----------------------------------------------------------------------------------------------------------


def validated(spark: SparkSession, sf_dir: str, type_name: str, source: DataFrame | None = None, **more: str | Column | None) -> DataFrame:
    columns = {k: v for k, v in (bound(type_name) | more).items() if v is not None}
    return validate(source if source is not None else table(spark, sf_dir, BINDINGS[type_name][0]), shop(), type_name, columns)


def by_code(df: DataFrame) -> DataFrame:
    return issue_rows(df).groupBy("code", "property", "message").agg(F.count(F.lit(1)).alias("n"))


def counted(branches: list[tuple[str, str, str, str]], table_name: str, gate: str = "") -> str:
    """branches: (condition, code, property, message), each a row of issue counts where it holds."""
    own = [f"SELECT '{code}' AS code, '{prop}' AS property, '{message}' AS message, count(*)::BIGINT AS n FROM {table_name} WHERE {condition}{gate if code in ('E_INVARIANT_FAIL', 'E_EVAL_ERROR') else ''} HAVING count(*) > 0" for condition, code, prop, message in branches]
    return "\nUNION ALL ".join(own)


@add(
    "validate_customer",
    counted([("c_acctbal < 0", "E_INVARIANT_FAIL", "", "solvent"), ("NOT starts_with(c_name, 'Customer#')", "E_INVARIANT_FAIL", "", "named_by_key"), ("c_acctbal < -1000", "E_CONSTRAINT_FAIL", "acctbal", "acctbal: value not in [-1000.0, _]")], "customer", " AND c_acctbal >= -1000"),
)
def validate_customer(spark, sf_dir):
    return by_code(validated(spark, sf_dir, "Customer"))


ORDER_OK = " AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_totalprice BETWEEN 0 AND 450000"


@add(
    "validate_orders",
    counted([("o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "E_CONSTRAINT_FAIL", "priority", "priority: not one of the enum''s values"), ("o_totalprice NOT BETWEEN 0 AND 450000", "E_CONSTRAINT_FAIL", "total", "total: value not in [0.0, 450000.0]"), ("o_orderdate < DATE '1995-01-01'", "E_INVARIANT_FAIL", "", "recent"), ("o_orderpriority = '1-URGENT' AND o_totalprice <= 1000", "E_INVARIANT_FAIL", "", "urgent_is_dear")], "orders", ORDER_OK),
)
def validate_orders(spark, sf_dir):
    return by_code(validated(spark, sf_dir, "Order"))


@add(
    "validate_lineitem",
    counted([("l_quantity NOT BETWEEN 1 AND 45", "E_CONSTRAINT_FAIL", "quantity", "quantity: value not in [1.0, 45.0]"), ("l_tax NOT BETWEEN 0 AND 0.07", "E_CONSTRAINT_FAIL", "tax", "tax: value not in [0.0, 0.07]"), ("l_extendedprice < 0", "E_CONSTRAINT_FAIL", "price", "price: value not in [0.0, _]"), ("l_discount NOT BETWEEN 0 AND 0.1", "E_CONSTRAINT_FAIL", "discount", "discount: value not in [0.0, 0.1]"), ("l_extendedprice / l_quantity <= 1000", "E_INVARIANT_FAIL", "", "unit_price"), ("l_discount + l_tax >= 0.16::DOUBLE", "E_INVARIANT_FAIL", "", "fees")], "lineitem", " AND l_quantity BETWEEN 1 AND 45 AND l_tax BETWEEN 0 AND 0.07 AND l_extendedprice >= 0 AND l_discount BETWEEN 0 AND 0.1"),
)
def validate_lineitem(spark, sf_dir):
    return by_code(validated(spark, sf_dir, "Line"))


@add("validate_events", counted([("event_type NOT IN ('click', 'view', 'purchase', 'signup')", "E_CONSTRAINT_FAIL", "kind", "kind: not one of the enum''s values"), ("value NOT BETWEEN 0 AND 80", "E_CONSTRAINT_FAIL", "value", "value: value not in [0.0, 80.0]"), ("event_type = 'purchase' AND value <= 1", "E_INVARIANT_FAIL", "", "dear_purchase")], "events", " AND event_type IN ('click', 'view', 'purchase', 'signup') AND value BETWEEN 0 AND 80"))
def validate_events(spark, sf_dir):
    return by_code(validated(spark, sf_dir, "Event"))


@add("chk_required", "SELECT 'E_MISSING_REQUIRED' AS code, 'segment' AS property, 'segment is required' AS message, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 4 = 0")
def chk_required(spark, sf_dir):
    return by_code(validated(spark, sf_dir, "Customer", segment=F.expr("case when c_custkey % 4 <> 0 then c_mktsegment end"))).filter("code = 'E_MISSING_REQUIRED'")


MIXED = 'schema "mixed" type M { k String primary  a Integer  b Integer  c Float  d Boolean  words List<String[1, 4]>[_, 2] }'


def mixed(spark, sf_dir, **columns: str | Column) -> DataFrame:
    from ..schema.load import load_string

    return validate(table(spark, sf_dir, "part"), load_string(MIXED, "mixed"), "M", {"k": text("p_partkey")} | columns)


@add("chk_type_mismatch", "SELECT 'E_TYPE_MISMATCH' AS code, property, count(*)::BIGINT AS n FROM (SELECT 'a' AS property FROM part WHERE TRY_CAST(p_name AS BIGINT) IS NULL UNION ALL SELECT 'b' FROM part WHERE p_retailprice <> floor(p_retailprice) UNION ALL SELECT 'c' FROM part WHERE TRY_CAST(p_brand AS DOUBLE) IS NULL) GROUP BY property")
def chk_type_mismatch(spark, sf_dir):
    """A text under Integer, a number with a fraction under Integer, a text under Float."""
    return issue_rows(mixed(spark, sf_dir, a="p_name", b="p_retailprice", c="p_brand")).groupBy("code", "property").agg(F.count(F.lit(1)).alias("n"))


@add("chk_boolean", "SELECT 'E_TYPE_MISMATCH' AS code, count(*)::BIGINT AS n FROM part WHERE p_size % 3 = 0")
def chk_boolean(spark, sf_dir):
    """true and false as texts are booleans, other texts aren't."""
    said = F.expr("case p_size % 3 when 0 then 'perhaps' when 1 then 'true' else 'false' end")
    return issue_rows(mixed(spark, sf_dir, d=said)).filter("property = 'd'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@add("list_issue_index", "SELECT p_partkey::BIGINT AS k, '$.words[' || (CASE WHEN length(w[1]) > 4 THEN 0 ELSE 1 END) || ']' AS path FROM (SELECT p_partkey, string_split(p_name, ' ')[1:2] AS w FROM part) WHERE length(w[1]) > 4 OR length(w[2]) > 4")
def list_issue_index(spark, sf_dir):
    out = mixed(spark, sf_dir, words=F.slice(F.split("p_name", " "), 1, 2))
    return out.select(F.col("p_partkey").alias("k"), F.explode("_issues").alias("i")).select("k", F.col("i.path").alias("path"))


@add("case_fold_collision", "SELECT 'E_CASE_FOLD_COLLISION' AS code, '$.name' AS path, count(*)::BIGINT AS n FROM nation")
def case_fold_collision(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(text("n_nationkey").alias("nation_key"), F.struct(F.col("n_name").alias("Name"), F.col("n_name").alias("NAME")).alias("s"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        found = issue_rows(validate(df.select("nation_key", "s.Name", "s.NAME"), shop(), "Nation")).filter("phase = 1").groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))
        found.schema  # names are resolved while they are told apart by case  # noqa: B018
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    return found


@add("phase_gating", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS phase, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def phase_gating(spark, sf_dir):
    out = validated(spark, sf_dir, "Customer", segment=F.expr("case when c_custkey % 4 <> 0 then c_mktsegment end"))
    return out.select(F.coalesce(F.get("_issues", F.lit(0))["phase"], F.lit(0)).alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@add("issue_counts", "SELECT 'error' AS severity, count(*)::BIGINT AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0")
def issue_counts(spark, sf_dir):
    return issue_rows(validated(spark, sf_dir, "Customer")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@add("issue_cap", "SELECT o_orderkey::BIGINT AS k, 1::BIGINT AS kept, 1::BIGINT AS dropped FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_totalprice NOT BETWEEN 0 AND 450000")
def issue_cap(spark, sf_dir):
    out = validate(table(spark, sf_dir, "orders"), shop(), "Order", bound("Order"), cap=1)
    return out.filter("_dropped > 0").select(F.col("o_orderkey").alias("k"), F.size("_issues").cast("long").alias("kept"), F.col("_dropped").cast("long").alias("dropped"))


@add("batch_split", "SELECT c_acctbal >= 0 AS valid, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def batch_split(spark, sf_dir):
    good, bad = split(validated(spark, sf_dir, "Customer"))
    return good.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@add("coerce_types", "SELECT p_partkey::VARCHAR AS part_key, p_name AS name, p_brand AS brand, p_size::BIGINT AS size, p_retailprice AS price FROM part")
def coerce_types(spark, sf_dir):
    return coerce(table(spark, sf_dir, "part"), shop().types["Part"], bound("Part")).select("part_key", "name", "brand", "size", "price")


@add("abstract_type", "SELECT 'E_ABSTRACT_TYPE' AS code, count(*)::BIGINT AS n FROM nation")
def abstract_type(spark, sf_dir):
    return issue_rows(validate(table(spark, sf_dir, "nation"), shop(), "Named", {"name": "n_name"})).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@add("part_type_direct", "SELECT 'E_PART_TYPE_DIRECT' AS code, count(*)::BIGINT AS n FROM orders")
def part_type_direct(spark, sf_dir):
    return issue_rows(validate(table(spark, sf_dir, "orders"), shop(), "Item", {})).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@add("type_not_found", "SELECT 'E_INSTANCE_TYPE_NOT_FOUND' AS code, count(*)::BIGINT AS n FROM nation")
def type_not_found(spark, sf_dir):
    return issue_rows(validate(table(spark, sf_dir, "nation"), shop(), "Nowhere", {})).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@add("unknown_fields", "SELECT 'E_UNKNOWN_FIELD' AS code, 'n_regionkey' AS property, count(*)::BIGINT AS n FROM nation")
def unknown_fields(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(text("n_nationkey").alias("Nation_Key"), F.col("n_name").alias("NAME"), "n_regionkey")
    return issue_rows(validate(df, shop(), "Nation", None, allow_unknown=False)).groupBy("code", "property").agg(F.count(F.lit(1)).alias("n"))


@add("primary_key_text", "SELECT l_orderkey::BIGINT AS k, count(*)::BIGINT AS n, min('[\"' || l_orderkey || '-' || l_linenumber || '\"]') AS least FROM lineitem GROUP BY 1")
def primary_key_text(spark, sf_dir):
    return validated(spark, sf_dir, "Line").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("least"))


# Invariants -----------------------------------------------------------------------------------------------------------


def invariant_query(table_name: str, expression: str) -> Query:
    """k of the rows that fail, with whether by an error."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = compile_text(expression, {n: (F.expr(c), k) for n, (c, k) in NAMES[table_name].items()})
        error = v.error.isNotNull() if v.error is not None else F.lit(False)
        return table(spark, sf_dir, table_name).select(F.col(KEYS[table_name]).cast("long").alias("k"), error.alias("error"), F.coalesce(v.value, F.lit(False)).alias("v")).filter(F.col("error") | ~F.col("v")).select("k", "error")

    return run


for _name, _table, _expression, _sql in [
    ("inv_price_positive", "part", "price > 950.0", "SELECT p_partkey::BIGINT AS k, false AS error FROM part WHERE NOT p_retailprice > 950"),
    ("inv_cross_field", "part", "size < 20 || price > 1000.0", "SELECT p_partkey::BIGINT AS k, false AS error FROM part WHERE NOT (p_size < 20 OR p_retailprice > 1000)"),
    ("inv_eval_error", "part", "100 / (size % 5) > 30", "SELECT p_partkey::BIGINT AS k, p_size % 5 = 0 AS error FROM part WHERE p_size % 5 = 0 OR NOT 100 // nullif(p_size % 5, 0) > 30"),
    ("inv_conditional_presence", "customer", "gap == nil || nick != nil", f"SELECT c_custkey::BIGINT AS k, false AS error FROM customer WHERE {GAP} IS NOT NULL AND {NICK} IS NULL"),
]:
    QUERIES[_name] = invariant_query(_table, _expression)
    SQL[_name] = _sql


@add("inv_order_dates", "SELECT o_orderkey::BIGINT AS k FROM orders WHERE o_orderdate - INTERVAL 300 DAY < DATE '1995-01-01'" + ORDER_OK)
def inv_order_dates(spark, sf_dir):
    """The dates set back by 300 days, so that some are before the year that the invariant names."""
    earlier = F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), 300), "yyyy-MM-dd")
    return validated(spark, sf_dir, "Order", order_date=earlier).filter(F.exists("_issues", lambda i: i["message"] == "recent")).select(F.col("o_orderkey").alias("k"))


# References -----------------------------------------------------------------------------------------------------------


ORDERS_OK = "(SELECT * FROM orders WHERE o_totalprice BETWEEN 0 AND 450000 AND o_orderstatus IN ('P', 'F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderdate >= DATE '1995-01-01' AND NOT (o_orderpriority = '1-URGENT' AND o_totalprice <= 1000))"


def graph_of(spark, sf_dir, *types: str, conditions: dict[str, str] | None = None, **more) -> graph.Graph:
    """Of the tables of these types; conditions pick rows, further columns replace those of the first type."""
    inputs = {}
    for t in types:
        rows = table(spark, sf_dir, BINDINGS[t][0])
        rows = rows.filter(conditions[t]) if t in (conditions or {}) else rows
        inputs[t] = graph.Input(rows, bound(t) | (more if t == types[0] else {}), (KEYS_OF[t],))
    return graph.build_graph(inputs, shop())


KEYS_OF = {"Region": "r_regionkey", "Nation": "n_nationkey", "Customer": "c_custkey", "Order": "o_orderkey"}


@add("edge_customer_nation", "SELECT '[\"' || n_nationkey || '\"]' AS target_key, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY 1")
def edge_customer_nation(spark, sf_dir):
    edges = graph_of(spark, sf_dir, "Customer", "Nation").edges.filter("relation = 'NATION'")
    return edges.groupBy("target_key").agg(F.count(F.lit(1)).alias("n"))


@add("edge_order_customer", f"SELECT '[\"' || o_orderkey || '\"]' AS key, '[\"' || c_custkey || '\"]' AS target_key FROM {ORDERS_OK} JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0")
def edge_order_customer(spark, sf_dir):
    return graph_of(spark, sf_dir, "Order", "Customer").edges.filter("relation = 'CUSTOMER'").select("key", "target_key")


@add("unresolved_target_missing", f"SELECT '[\"' || o_orderkey || '\"]' AS key, '[\"' || o_custkey || '\"]' AS target_key, 'target_missing' AS reason FROM {ORDERS_OK} WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3 AND c_acctbal >= 0)")
def unresolved_target_missing(spark, sf_dir):
    lost = graph_of(spark, sf_dir, "Order", "Customer", conditions={"Customer": "c_custkey % 10 <> 3"}).unresolved
    return lost.filter("relation = 'CUSTOMER'").select("key", "target_key", "reason")


SOME_CUSTOMERS = "case when o_orderkey % 11 <> 0 then cast(o_custkey as string) end"


@add("unresolved_absent", f"SELECT '[\"' || o_orderkey || '\"]' AS key, 'absent' AS reason FROM {ORDERS_OK} WHERE o_orderkey % 11 = 0")
def unresolved_absent(spark, sf_dir):
    lost = graph_of(spark, sf_dir, "Order", "Customer", CUSTOMER=target(F.expr(SOME_CUSTOMERS), "cust_key")).unresolved
    return lost.filter("reason = 'absent' and relation = 'CUSTOMER'").select("key", "reason")


MANY_TEXT = """
schema "many"
type Order { order_key String primary  --> PARTS (one:many) Part { quantity Float[1, 40] required } }
type Part { part_key String primary }
type Enrollment { region String primary  student String primary }
type Grade { grade_key String primary  --> OF (one) Enrollment }
"""


def many_schema():
    from ..schema.load import load_string

    return load_string(MANY_TEXT, "many")


def orders_with_parts(spark, sf_dir) -> DataFrame:
    """Orders with an array of references to parts, empty for orders without lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(text("l_partkey").alias("_target_part_key"), F.col("l_quantity").alias("quantity"))).alias("parts"))
    none = F.array().cast("array<struct<_target_part_key:string,quantity:double>>")
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(text("o_orderkey").alias("order_key"), F.coalesce("parts", none).alias("parts"))


@add("edge_many_to_many", "SELECT '[\"' || l_partkey || '\"]' AS target_key, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 40) AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def edge_many_to_many(spark, sf_dir):
    schema = many_schema()
    orders, _ = split(validate(orders_with_parts(spark, sf_dir), schema, "Order", cap=1))
    parts = table(spark, sf_dir, "part").select(F.lit(schema.type_id("Part")).alias("type"), key_string([text("p_partkey")]).alias("key"))
    edges, _ = graph.resolve(graph.references_of(orders, schema, "Order"), parts)
    return edges.groupBy("target_key").agg(F.count(F.lit(1)).alias("n"))


@add("edge_properties", "SELECT 'E_CONSTRAINT_FAIL' AS code, 'quantity' AS property, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 40 HAVING count(*) > 0")
def edge_properties(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(text("l_orderkey").alias("order_key"), F.array(F.struct(text("l_partkey").alias("_target_part_key"), F.col("l_quantity").alias("quantity"))).alias("parts"))  # a row per edge
    return issue_rows(validate(lines, many_schema(), "Order")).groupBy("code", "property").agg(F.count(F.lit(1)).alias("n"))


@add("unresolved_empty", "SELECT '[\"' || o_orderkey || '\"]' AS key, 'empty' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unresolved_empty(spark, sf_dir):
    schema = many_schema()
    refs = graph.references_of(split(validate(orders_with_parts(spark, sf_dir), schema, "Order"))[0], schema, "Order")
    return refs.filter("reason = 'empty'").select("key", "reason")


@add("graph_check", f"SELECT 'E_UNRESOLVED_REQUIRED' AS code, reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'absent' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'target_missing' END AS reason FROM {ORDERS_OK}) WHERE reason IS NOT NULL GROUP BY reason")
def graph_check(spark, sf_dir):
    built = graph_of(spark, sf_dir, "Order", "Customer", "Nation", conditions={"Nation": "n_nationkey >= 0"}, CUSTOMER=target(F.expr(SOME_CUSTOMERS), "cust_key"))
    return built.check().filter("relation = 'CUSTOMER'").groupBy("code", "reason").agg(F.count(F.lit(1)).alias("n"))


REPEATED = "SELECT * FROM customer UNION ALL SELECT c_custkey, 'Customer#again', 0, (c_nationkey + 1) % 25, 500.0, 'BUILDING' FROM customer WHERE c_custkey % 8 = 0"


def repeated_graph(spark, sf_dir) -> graph.Graph:
    """Customers of which every eighth comes once more, later, with another nation."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", F.lit(0).alias("turn"))
    again = own.filter("c_custkey % 8 = 0").withColumns({"c_name": F.lit("Customer#again"), "c_nationkey": ((F.col("c_nationkey") + 1) % 25).cast(own.schema["c_nationkey"].dataType), "c_acctbal": F.lit(500.0), "turn": F.lit(1)})
    inputs = {"Customer": graph.Input(own.unionByName(again), bound("Customer"), ("turn",)), "Nation": graph.Input(table(spark, sf_dir, "nation"), bound("Nation"), ("n_nationkey",)), "Region": graph.Input(table(spark, sf_dir, "region"), bound("Region"), ("r_regionkey",))}
    return graph.build_graph(inputs, shop())


@add("graph_duplicates", "SELECT '[\"' || c_custkey || '\"]' AS key, 2 AS nth, 'Customer#again' AS rejected, c_name AS kept, 'E_DUPLICATE_PK' AS code FROM customer WHERE c_custkey % 8 = 0 AND c_acctbal >= 0")
def graph_duplicates(spark, sf_dir):
    built = repeated_graph(spark, sf_dir)
    codes = built.issues.filter("code = 'E_DUPLICATE_PK'").select("key", "code").distinct()
    return built.duplicates.join(codes, "key").select("key", "nth", F.get_json_object("instance", "$.name").alias("rejected"), F.get_json_object("conflict", "$.name").alias("kept"), "code")


@add("graph_duplicates_have_no_edges", "SELECT '[\"' || c_custkey || '\"]' AS key, '[\"' || CASE WHEN c_acctbal >= 0 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END || '\"]' AS target_key FROM customer WHERE c_acctbal >= 0 OR c_custkey % 8 = 0")
def graph_duplicates_have_no_edges(spark, sf_dir):
    return repeated_graph(spark, sf_dir).edges.filter("relation = 'NATION'").select("key", "target_key")


@add("graph_issue_codes", "SELECT code, count(*)::BIGINT AS n FROM (SELECT 'E_DUPLICATE_PK' AS code FROM customer WHERE c_custkey % 8 = 0 AND c_acctbal >= 0 UNION ALL SELECT unnest(['E_GRAPH_TYPE_NOT_FOUND', 'E_GRAPH_INVALID_COMPOSITION'])) GROUP BY code")
def graph_issue_codes(spark, sf_dir):
    built = repeated_graph(spark, sf_dir)
    wrong = graph.build_graph({"Nowhere": graph.Input(table(spark, sf_dir, "region")), "Item": graph.Input(table(spark, sf_dir, "region"))}, shop())
    return built.issues.unionByName(wrong.issues).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def grades(spark, sf_dir) -> DataFrame:
    part = lambda k, m: F.expr(f"case when {k} % {m} <> 0 then cast({k} as string) end")
    return table(spark, sf_dir, "customer").select(text("c_custkey").alias("grade_key"), F.struct(part("c_nationkey", 2).alias("_target_region"), part("c_custkey", 3).alias("_target_student")).alias("of"))


@add("fk_missing", "SELECT '[\"' || c_custkey || '\"]' AS key FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 = 0")
def fk_missing(spark, sf_dir):
    return issue_rows(validate(grades(spark, sf_dir), many_schema(), "Grade")).filter("code = 'E_MISSING_FK_TARGET'").select("key")


@add("fk_partial_composite", "SELECT '[\"' || c_custkey || '\"]' AS key FROM customer WHERE (c_nationkey % 2 = 0) <> (c_custkey % 3 = 0)")
def fk_partial_composite(spark, sf_dir):
    return issue_rows(validate(grades(spark, sf_dir), many_schema(), "Grade")).filter("code = 'E_PARTIAL_COMPOSITE_FK'").select("key")


@add("semi_join_resolved", f"SELECT o_orderkey::BIGINT AS k FROM {ORDERS_OK} WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def semi_join_resolved(spark, sf_dir):
    return graph_of(spark, sf_dir, "Order", "Customer").with_edge("Order", "CUSTOMER").select(F.col("o_orderkey").alias("k"))


# Duplicates, children, snapshots --------------------------------------------------------------------------------------

LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@add("dup_pk_lineitem", f"SELECT l_orderkey::BIGINT AS order_key, l_linenumber::BIGINT AS line, nth::BIGINT AS nth, l_partkey::BIGINT AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER_SQL}) AS nth FROM lineitem) WHERE nth > 1")
def dup_pk_lineitem(spark, sf_dir):
    out = graph.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)
    return out.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"), F.col("l_partkey").alias("part"))


@add("dedup_first_wins", f"SELECT l_orderkey::BIGINT AS order_key, l_linenumber::BIGINT AS line, l_partkey::BIGINT AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER_SQL}) AS nth FROM lineitem) WHERE nth = 1")
def dedup_first_wins(spark, sf_dir):
    first, _ = graph.dedup(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)
    return first.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"))


def order_items(spark, sf_dir) -> DataFrame:
    item = F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_partkey").alias("part"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return table(spark, sf_dir, "orders").join(items, "o_orderkey", "left")


ITEMS = """
schema "items"
type Order { order_key String primary  *-> ITEMS (_:many) Item  *-> FIRST (_:one) Item }
part type Item { line Integer required  *-> MARKS (_:many) Mark }
part type Mark { flag Enum["A", "N"] required }
type Bill { order_key String primary  *-> LINES (_:many) BillLine }
part type BillLine { line_key String primary }
"""


def items_schema():
    from ..schema.load import load_string

    return load_string(ITEMS, "items")


def children_of_orders(spark, sf_dir) -> DataFrame:
    checked, _ = split(validate(order_items(spark, sf_dir), shop(), "Order", {"order_key": text("o_orderkey"), "status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice", "order_date": day("o_orderdate"), "ITEMS": "items"}))
    return graph.children_of(checked, shop(), "Order", "ITEMS", {"ITEMS": "items"})


GOOD_LINES = f"(SELECT lineitem.* FROM lineitem JOIN {ORDERS_OK} ON o_orderkey = l_orderkey WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09 OR NOT (l_quantity < 49 OR l_discount < 0.05)))"


@add("compose_order_items", f"SELECT '[\"' || l_orderkey || '\"]' AS parent_key, count(*)::BIGINT AS items, max(l_linenumber)::BIGINT AS last FROM {GOOD_LINES} GROUP BY 1")
def compose_order_items(spark, sf_dir):
    return children_of_orders(spark, sf_dir).groupBy("parent_key").agg(F.count(F.lit(1)).alias("items"), F.max("child.line").alias("last"))


@add(
    "composed_child_issues",
    "SELECT code, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_discount > 0.09 THEN 'E_CONSTRAINT_FAIL' WHEN NOT (l_quantity < 49 OR l_discount < 0.05) THEN 'E_INVARIANT_FAIL' END AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= DATE '1995-01-01' AND NOT (o_orderpriority = '1-URGENT' AND o_totalprice <= 1000)" + ORDER_OK + ") WHERE code IS NOT NULL GROUP BY code",
)
def composed_child_issues(spark, sf_dir):
    out = validate(order_items(spark, sf_dir), shop(), "Order", bound("Order") | {"ITEMS": "items"}, cap=2**31 - 1)  # a row's issues are as many as its children
    return issue_rows(out).filter("phase = 5").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def keyed_items(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(text("l_orderkey").alias("order_key")).agg(F.collect_list(F.struct(text("l_linenumber").alias("line_key"))).alias("lines"))
    return validate(items, items_schema(), "Bill")


@add("dup_composed_pk", "SELECT '[\"' || l_orderkey || '\"]' AS key, 'E_DUPLICATE_COMPOSED_PK' AS code, '$.lines' AS path FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_linenumber)")
def dup_composed_pk(spark, sf_dir):
    return issue_rows(keyed_items(spark, sf_dir)).select("key", "code", "path")


@add("one_cardinality", "SELECT l_orderkey::BIGINT AS k, (count(*) - 1)::BIGINT AS rejected FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def one_cardinality(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(key_string([text("l_orderkey")]).alias("parent_key"), text("l_linenumber").alias("key"), "l_orderkey")
    parents = table(spark, sf_dir, "lineitem").select(key_string([text("l_orderkey")]).alias("key")).distinct()
    _, issues = graph.attach(children, parents, items_schema(), "Order", "FIRST", ["key"])
    number = F.regexp_extract("parent_key", "([0-9]+)", 1).cast("long")
    return issues.filter("code = 'E_DUPLICATE_COMPOSED_PK'").groupBy(number.alias("k")).agg(F.count(F.lit(1)).alias("rejected"))


@add("nested_children", "SELECT 'E_CONSTRAINT_FAIL' AS code, '$.items[0].marks[1].flag' AS path, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') HAVING count(*) > 0")
def nested_children(spark, sf_dir):
    """A row per line: an order with one item, which has two marks; the second one's flag may be none of the enum's."""
    flag = lambda c: F.struct(c.alias("flag"))
    item = F.struct(F.col("l_linenumber").alias("line"), F.array(flag(F.lit("A")), flag(F.col("l_returnflag"))).alias("marks"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_key"), F.array(item).alias("items"))
    return issue_rows(validate(rows, items_schema(), "Order")).groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))


@add("late_children", "SELECT CASE WHEN o_orderkey IS NULL THEN 'E_GRAPH_PARENT_NOT_FOUND' ELSE 'attached' END AS code, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) ON o_orderkey = l_orderkey GROUP BY 1")
def late_children(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(key_string([text("l_orderkey")]).alias("parent_key"), text("l_linenumber").alias("key")).distinct()
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 0").select(key_string([text("o_orderkey")]).alias("key"))
    there, issues = graph.attach(children, parents, shop(), "Order", "ITEMS", ["key"])
    return there.select(F.lit("attached").alias("code")).unionByName(issues.select("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def conversations(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return validate(turns, shop(), "Conversation", {"conv_id": text("conv_id"), "TURNS": "turns"}, cap=1)


@add("compose_conversation_turns", "SELECT '[\"' || conv_id || '\"]' AS parent_key, count(*)::BIGINT AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING bool_and(coalesce(role IN ('user', 'assistant', 'system') AND length(text) >= 1 AND turn IS NOT NULL, false))")
def compose_conversation_turns(spark, sf_dir):
    good, _ = split(conversations(spark, sf_dir))
    turns = graph.children_of(good, shop(), "Conversation", "TURNS", {"TURNS": "turns"})
    told = F.array_sort(F.collect_list(F.struct("position", "child.role")))
    return turns.groupBy("parent_key").agg(F.count(F.lit(1)).alias("turns"), told.alias("t")).select("parent_key", "turns", F.array_join("t.role", ",").alias("roles"))


@add("validate_conversations", "SELECT conv_id::BIGINT AS k, (sum(CASE WHEN role NOT IN ('user', 'assistant', 'system') OR role IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN coalesce(length(text), 0) < 1 THEN 1 ELSE 0 END))::BIGINT AS issues FROM conversations GROUP BY 1")
def validate_conversations(spark, sf_dir):
    out = conversations(spark, sf_dir)
    return out.select(F.col("conv_id").alias("k"), (F.size("_issues") + F.col("_dropped")).cast("long").alias("issues"))


@add("explode_children", f"SELECT '[\"' || l_orderkey || '\"]' AS parent_key, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_partkey) - 1)::BIGINT AS at, l_partkey::BIGINT AS part FROM {GOOD_LINES}")
def explode_children(spark, sf_dir):
    return children_of_orders(spark, sf_dir).select("parent_key", F.col("position").cast("long").alias("at"), F.col("child.part").alias("part"))


@add("composition_not_found", "SELECT 'E_COMPOSITION_NOT_FOUND' AS code, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'E_CONSTRAINT_FAIL', count(*) FROM lineitem WHERE l_discount > 0.09")
def composition_not_found(spark, sf_dir):
    wrong = validate_children(table(spark, sf_dir, "nation"), shop(), "Order", "CUSTOMER")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.lit(1.0).alias("quantity"), F.col("l_discount").alias("discount"))
    right = validate_children(lines, shop(), "Order", "ITEMS")
    return issue_rows(wrong).unionByName(issue_rows(right)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@add("composed_key", "SELECT '[[\"' || l_orderkey || '\"],\"ITEMS\",[\"' || l_linenumber || '\"]]' AS key, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def composed_key(spark, sf_dir):
    key = graph.composed_key(key_string([text("l_orderkey")]), "ITEMS", key_string([text("l_linenumber")]))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@add("snapshot_nodes", "SELECT 'shop#Nation' AS type, '[\"' || n_nationkey || '\"]' AS key FROM nation UNION ALL SELECT 'shop#Region', '[\"' || r_regionkey || '\"]' FROM region")
def snapshot_nodes(spark, sf_dir):
    return graph.snapshot_nodes(graph_of(spark, sf_dir, "Nation", "Region").nodes)


@add("snapshot_edges", "SELECT 'shop#Nation' AS type, '[\"' || n_nationkey || '\"]' AS key, 'REGION' AS relation, 'shop#Region' AS target_type, '[\"' || n_regionkey || '\"]' AS target_key FROM nation")
def snapshot_edges(spark, sf_dir):
    return graph.snapshot_edges(graph_of(spark, sf_dir, "Nation", "Region").edges).select("type", "key", "relation", "target_type", "target_key")


@add("types_present", "SELECT 'shop#Nation' AS type UNION ALL SELECT 'shop#Region'")
def types_present(spark, sf_dir):
    return graph.types_present(graph_of(spark, sf_dir, "Nation", "Region").nodes)


@add("instance_by_key", "SELECT 'shop#Customer' AS type, '[\"42\"]' AS key FROM customer WHERE c_custkey = 42 AND c_acctbal >= 0")
def instance_by_key(spark, sf_dir):
    return graph.instance_by_key(graph_of(spark, sf_dir, "Customer").nodes, shop().type_id("Customer"), '["42"]')


# JSON in and out ------------------------------------------------------------------------------------------------------


def props_schema():
    from ..schema.load import load_string

    return load_string('schema "props" type Props { k Integer[10, 60] required  ! "even" k % 2 == 0 }', "props")


@add("json_raw_issues", "SELECT code, count(*)::BIGINT AS n FROM (SELECT CASE WHEN k IS NULL THEN 'E_MISSING_REQUIRED' WHEN k NOT BETWEEN 10 AND 60 THEN 'E_CONSTRAINT_FAIL' WHEN k % 2 <> 0 THEN 'E_INVARIANT_FAIL' END AS code FROM (SELECT (props->>'k')::BIGINT AS k FROM events)) WHERE code IS NOT NULL GROUP BY code")
def json_raw_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.try_parse_json("props").alias("obj"))
    return issue_rows(json_read.validate_raw(rows, props_schema(), "Props")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


PEOPLE = """
schema "people"
type P { id String primary  --> HOME (one) N { since Integer }  --> SEEN (many) N  *-> PHONES (_:many) Phone }
type N { id String primary }
part type Phone { no String primary  *-> CALLS (_:many) Call }
part type Call { length Integer[0, 40] required }
"""


def people(spark, sf_dir, home: str, phones: str = "cast(null as string)", seen: str = "cast(null as string)") -> DataFrame:
    """Issues of customers as JSON; home, phones and seen: SQL for the texts of these members, null for none."""
    from ..schema.load import load_string

    members = F.concat_ws(",", F.expr("""'"id":"' || c_custkey || '"'"""), F.expr(f"""'"home":' || ({home})"""), F.expr(f"""'"phones":' || ({phones})"""), F.expr(f"""'"seen":' || ({seen})"""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.try_parse_json(F.concat(F.lit("{"), members, F.lit("}"))).alias("obj"))
    return json_read.validate_raw(rows, load_string(PEOPLE, "people"), "P")


@add("json_edge_shape", "SELECT 'E_EDGE_SHAPE_MISMATCH' AS code, path, count(*)::BIGINT AS n FROM (SELECT unnest(CASE c_custkey % 4 WHEN 0 THEN ['$.home'] WHEN 1 THEN ['$.home', '$.seen'] WHEN 2 THEN ['$.seen[1]'] ELSE []::VARCHAR[] END) AS path FROM customer) GROUP BY path")
def json_edge_shape(spark, sf_dir):
    out = people(spark, sf_dir, """case c_custkey % 4 when 0 then '"text"' when 1 then 'null' else '{"_target_id":"x"}' end""", seen="""case c_custkey % 4 when 1 then '{}' when 2 then '[{"_target_id":"x"},3]' else '[]' end""")
    return issue_rows(out).groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))


@add("json_edge_unknown_field", "SELECT c_custkey::BIGINT AS k, CASE WHEN c_custkey % 3 = 0 THEN 'E_UNKNOWN_EDGE_FIELD' ELSE 'E_MISSING_FK_TARGET' END AS code, CASE WHEN c_custkey % 3 = 0 THEN '$.home.until' ELSE '$.home' END AS path FROM customer WHERE c_custkey % 3 < 2")
def json_edge_unknown_field(spark, sf_dir):
    out = people(spark, sf_dir, """case c_custkey % 3 when 0 then '{"_target_id":"x","SINCE":3,"until":4}' when 1 then '{"since":1}' else '{"_target_id":"x"}' end""")
    return out.select(F.col("c_custkey").alias("k"), F.explode("_issues").alias("i")).select("k", "i.code", "i.path")


@add("json_children", "SELECT CASE c_custkey % 4 WHEN 0 THEN 'E_CONSTRAINT_FAIL' WHEN 1 THEN 'E_DUPLICATE_COMPOSED_PK' ELSE 'E_EDGE_SHAPE_MISMATCH' END AS code, CASE c_custkey % 4 WHEN 0 THEN '$.phones[0].calls[1].length' WHEN 1 THEN '$.phones' ELSE '$.phones[0].calls' END AS path, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1, 2")
def json_children(spark, sf_dir):
    out = people(spark, sf_dir, """'{"_target_id":"x"}'""", """case c_custkey % 4 when 0 then '[{"no":"1","calls":[{"length":40},{"length":41}]}]' when 1 then '[{"no":"1"},{"no":"1"}]' when 2 then '[{"no":"1","calls":{}}]' else '[{"no":"1","calls":[]}]' end""")
    return issue_rows(out).groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))


@add("json_documents", "SELECT n_nationkey::BIGINT AS k, (length(n_name) * 100000)::BIGINT AS size, false AS broken FROM nation")
def json_documents(spark, sf_dir):
    """Documents with comments, trailing commas and strings of about a million characters."""
    body = F.concat(F.lit('{ // a comment\n "name": ["'), F.repeat("n_name", F.lit(100_000)), F.lit('",], /* ** " */ }'))
    docs = json_read.parsed(table(spark, sf_dir, "nation"), body)
    return docs.select(F.col("n_nationkey").alias("k"), F.char_length(F.try_variant_get("doc", "$.name[0]", "string")).cast("long").alias("size"), "broken")


@add("json_round_trip", "SELECT '[\"' || p_partkey || '\"]' AS key, p_name AS name, p_size::BIGINT AS size, p_retailprice AS price FROM part WHERE p_size <= 40 AND regexp_matches(p_brand, '^Brand#[0-9]$') AND (p_retailprice > 901 OR p_size < 10) AND length(p_name) BETWEEN 1 AND 25")
def json_round_trip(spark, sf_dir):
    """Valid parts written as JSON, read and validated again."""
    columns = {k: F.col(v) if isinstance(v, str) else v for k, v in bound("Part").items()}
    good, _ = split(validated(spark, sf_dir, "Part"))
    lines = json_write.rows_json(good, shop(), "Part", columns, F.col("_key")).select(F.try_parse_json("json").alias("obj"))
    again, _ = split(json_read.validate_raw(lines, shop(), "Part"))
    return again.select(F.col("_key").alias("key"), "_values.name", "_values.size", "_values.price")


@add("json_values", "SELECT event_id::BIGINT AS id, (props->>'k')::BIGINT AS k FROM events")
def json_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("obj"))
    return json_read.validate_raw(rows, props_schema(), "Props").select(F.col("event_id").alias("id"), F.col("_values.k").alias("k"))


@add("json_strange_fields", "SELECT 'E_UNKNOWN_FIELD' AS code, '$.k' AS path, count(*)::BIGINT AS n FROM events WHERE (props->>'k') IS NOT NULL")
def json_strange_fields(spark, sf_dir):
    from ..schema.load import load_string

    rows = table(spark, sf_dir, "events").select(F.try_parse_json("props").alias("obj"))
    out = json_read.validate_raw(rows, load_string('schema "x" type X { other String }', "x"), "X")
    return issue_rows(out).groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))


@add("type_tags", "SELECT tag, regexp_full_match(tag, '([A-Za-z][A-Za-z0-9_]*\\.)?[A-Z][A-Za-z0-9_]*') AND tag NOT IN ('String', 'Date') AS ok FROM (SELECT DISTINCT p_type AS tag FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'al.' || p_type FROM part UNION SELECT unnest(['String', 'List', 'Date', 'lower', 'a.b.C', '']))")
def type_tags(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    fixed = spark.createDataFrame([(t,) for t in ("String", "List", "Date", "lower", "a.b.C", "")], "tag string")
    tags = parts.select(F.col("p_type").alias("tag")).unionByName(parts.select(F.col("p_brand").alias("tag"))).unionByName(parts.select(F.concat(F.lit("al."), "p_type").alias("tag"))).unionByName(fixed)
    return tags.distinct().select("tag", json_read.valid_tag(F.col("tag")).alias("ok"))


@add("graph_json", """SELECT 'Nation' AS type, '["' || n_nationkey || '"]' AS key, '{"name":"' || n_name || '","nation_key":"' || n_nationkey || '","region":["' || n_regionkey || '"]}' AS json FROM nation""")
def graph_json(spark, sf_dir):
    columns = {k: F.col(v) if isinstance(v, str) else v for k, v in bound("Nation").items()}
    return json_write.rows_json(validated(spark, sf_dir, "Nation"), shop(), "Nation", columns, F.col("_key"))


@add("graph_json_children", """SELECT conv_id::BIGINT AS k, '{"conv_id":"' || conv_id || '","turns":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY 1, conv_id""")
def graph_json_children(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    columns = {"conv_id": text("conv_id"), "TURNS": F.col("turns")}
    return turns.select(F.col("conv_id").alias("k"), json_write.instance_json(shop(), "Conversation", columns).alias("json"))


@add("diagnostics_json", """SELECT 'unresolved' AS section, '["' || c_custkey || '"] target_missing ["' || c_nationkey || '"]' AS said FROM customer WHERE c_nationkey = 7 AND c_acctbal >= 0 UNION ALL SELECT 'duplicates', '["' || c_custkey || '"] Customer#again ' || c_name FROM customer WHERE c_custkey % 8 = 0 AND c_acctbal >= 0""")
def diagnostics_json(spark, sf_dir):
    lost = graph_of(spark, sf_dir, "Customer", "Nation", conditions={"Nation": "n_nationkey <> 7"}).unresolved.filter("relation = 'NATION'")
    rows = json_write.diagnostics_json(lost, repeated_graph(spark, sf_dir).duplicates)
    of = lambda path: F.get_json_object("json", path)
    inner = lambda field: F.get_json_object(of(f"$.{field}"), "$.name")
    return rows.select("section", F.when(F.col("section") == "unresolved", F.concat_ws(" ", of("$.key"), of("$.reason"), of("$.target_key"))).otherwise(F.concat_ws(" ", of("$.key"), inner("instance"), inner("conflict"))).alias("said"))


@add("edge_index", "SELECT '[\"' || n_nationkey || '\"]' AS key, 'REGION' AS relation, '[\"' || n_regionkey || '\"]' AS targets FROM nation")
def edge_index(spark, sf_dir):
    return json_write.edge_index(graph_of(spark, sf_dir, "Nation", "Region").edges).select("key", "relation", F.array_join("targets", "|").alias("targets"))


@add("issues_of_category", "SELECT 'E_INVARIANT_FAIL' AS code, count(*)::BIGINT AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0")
def issues_of_category(spark, sf_dir):
    return of_category(issue_rows(validated(spark, sf_dir, "Customer")), "instance").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# Metadata -------------------------------------------------------------------------------------------------------------


# What the schema's text says of each type's properties (kind, primary, optional).
MEMBERS_SQL = """SELECT * FROM (VALUES
    ('Named', 'name', 'String', false, false),
    ('Region', 'region_key', 'String', true, false), ('Region', 'name', 'String', false, false),
    ('Nation', 'nation_key', 'String', true, false), ('Nation', 'name', 'String', false, false),
    ('Customer', 'cust_key', 'String', true, false), ('Customer', 'acctbal', 'Float', false, true), ('Customer', 'segment', 'Enum', false, false), ('Customer', 'name', 'String', false, false),
    ('Part', 'part_key', 'String', true, false), ('Part', 'brand', 'Pattern', false, false), ('Part', 'size', 'Integer', false, true), ('Part', 'price', 'Float', false, false), ('Part', 'name', 'String', false, false),
    ('Order', 'order_key', 'String', true, false), ('Order', 'status', 'Enum', false, false), ('Order', 'priority', 'Enum', false, false), ('Order', 'total', 'Float', false, false), ('Order', 'order_date', 'Date', false, false),
    ('Item', 'line', 'Integer', false, false), ('Item', 'quantity', 'Float', false, false), ('Item', 'discount', 'Float', false, true),
    ('Line', 'line_key', 'String', true, false), ('Line', 'quantity', 'Float', false, false), ('Line', 'price', 'Float', false, false), ('Line', 'discount', 'Float', false, true), ('Line', 'tax', 'Float', false, true), ('Line', 'flag', 'Enum', false, false),
    ('Event', 'event_id', 'String', true, false), ('Event', 'kind', 'Enum', false, false), ('Event', 'value', 'Float', false, false), ('Event', 'at', 'Timestamp', false, false),
    ('Conversation', 'conv_id', 'String', true, false),
    ('Turn', 'turn', 'Integer', false, false), ('Turn', 'role', 'Enum', false, false), ('Turn', 'text', 'String', false, false),
    ('Embedding', 'vec_id', 'String', true, false), ('Embedding', 'embedding', 'Vector', false, false)
) AS m(type, property, kind, "primary", optional)"""


@add("schema_members", MEMBERS_SQL)
def schema_members(spark, sf_dir):
    rows = [(t.name, p.name, p.constraint.kind, p.primary, p.optional) for t in shop().types.values() for p in t.all_properties]
    return spark.createDataFrame(rows, "type string, property string, kind string, primary boolean, optional boolean")


@add("inheritance_linear", "SELECT * FROM (VALUES ('Named', '', 'Customer,Nation,Part,Region'), ('Region', 'Named', ''), ('Nation', 'Named', ''), ('Customer', 'Named', ''), ('Part', 'Named', ''), ('Order', '', ''), ('Item', '', ''), ('Line', '', ''), ('Event', '', ''), ('Conversation', '', ''), ('Turn', '', ''), ('Embedding', '', '')) AS t(type, ancestors, subtypes)")
def inheritance_linear(spark, sf_dir):
    rows = [(t.name, ",".join(t.ancestors), ",".join(shop().subtypes(t.name))) for t in shop().types.values()]
    return spark.createDataFrame(rows, "type string, ancestors string, subtypes string")


@add("schema_errors", "SELECT * FROM (VALUES ('E_INVALID_CONSTRAINT', 2), ('E_SYNTAX', 4)) AS e(code, line)")
def schema_errors(spark, sf_dir):
    from ..diag import SchemaError
    from ..schema.load import load_string

    try:
        load_string('schema "bad"\ntype A extends B { x Integer[9, 1] primary }\ntype A {}\ntype C { Vec Vector[0] }', "bad")
    except SchemaError as e:
        found = e.problems.sorted()
    return spark.createDataFrame([(p.code, p.line) for p in found], "code string, line int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' issues by code, unresolved references of the valid ones to nations among them."""
    built = graph_of(spark, sf_dir, "Customer", "Nation", conditions={"Nation": "n_nationkey <> 7"})
    lost = built.check().filter("relation = 'NATION'").select("code")
    return issue_rows(built.rejected["Customer"]).select("code").unionByName(lost).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code")


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT code, count(*)::BIGINT AS n FROM (SELECT 'E_INVARIANT_FAIL' AS code FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'E_UNRESOLVED_REQUIRED' FROM customer WHERE c_nationkey = 7 AND c_acctbal >= 0) GROUP BY code"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


