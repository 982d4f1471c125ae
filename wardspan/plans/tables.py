"""The driver's tables bound to types of a schema."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema.load import load_string
from ..schema.model import Schema

TEXT = """
schema "shop"

abstract type Named { name String[1, 25] required }

type Region extends Named { region_key String primary }
type Nation extends Named { nation_key String primary  --> REGION (one) Region }
type Customer extends Named {
    cust_key String primary
    acctbal Float[-1000, _]
    segment Enum["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"] required
    --> NATION (one) Nation
    ! "solvent" acctbal >= 0.0
    ! "named_by_key" name -> StartsWith("Customer#")
}
type Part extends Named {
    part_key String primary
    brand Pattern["^Brand#[0-9]$"] required
    size Integer[1, 40]
    price Float required
    ! "priced" price > 901.0 || size < 10
}
type Order {
    order_key String primary
    status Enum["P", "F", "O"] required
    priority Enum["1-URGENT", "2-HIGH", "3-MEDIUM"] required
    total Float[0, 450000.0] required
    order_date Date required
    --> CUSTOMER (one) Customer
    *-> ITEMS (_:many) Item
    ! "recent" order_date >= "1995-01-01"
    ! "urgent_is_dear" priority != "1-URGENT" || total > 1000.0
}
part type Item {
    line Integer[1, 7] required
    quantity Float[1, 50] required
    discount Float[0, 0.09]
    ! "not_both" quantity < 49.0 || discount < 0.05
}
type Line {
    line_key String primary
    quantity Float[1, 45] required
    price Float[0, _] required
    discount Float[0, 0.1]
    tax Float[0, 0.07]
    flag Enum["A", "N", "R"] required
    --> PART (one) Part
    ! "unit_price" price / quantity > 1000.0
    ! "fees" discount + tax < 0.16
}
type Event {
    event_id String primary
    kind Enum["click", "view", "purchase", "signup"] required
    value Float[0, 80] required
    at Timestamp required
    ! "dear_purchase" kind != "purchase" || value > 1.0
}
type Conversation { conv_id String primary  *-> TURNS (one:many) Turn }
part type Turn { turn Integer required  role Enum["user", "assistant", "system"] required  text String[1, _] required }
type Embedding { vec_id String primary  embedding Vector[64] required }
"""


@cache
def shop() -> Schema:
    return load_string(TEXT, "shop")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str) -> Column:
    return F.col(c).cast("string")


def day(c: str) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd")


def target(c: str | Column, key: str) -> Column:
    value = text(c) if isinstance(c, str) else c
    return F.when(value.isNotNull(), F.struct(value.alias(f"_target_{key}")))


#: For each type: its table and where its members are.
BINDINGS = {
    "Region": ("region", {"region_key": lambda: text("r_regionkey"), "name": "r_name"}),
    "Nation": ("nation", {"nation_key": lambda: text("n_nationkey"), "name": "n_name", "REGION": lambda: target("n_regionkey", "region_key")}),
    "Customer": ("customer", {"cust_key": lambda: text("c_custkey"), "name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "NATION": lambda: target("c_nationkey", "nation_key")}),
    "Part": ("part", {"part_key": lambda: text("p_partkey"), "name": "p_name", "brand": "p_brand", "size": lambda: F.col("p_size").cast("long"), "price": "p_retailprice"}),
    "Order": ("orders", {"order_key": lambda: text("o_orderkey"), "status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice", "order_date": lambda: day("o_orderdate"), "CUSTOMER": lambda: target("o_custkey", "cust_key")}),
    "Line": ("lineitem", {"line_key": lambda: F.concat_ws("-", text("l_orderkey"), text("l_linenumber")), "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "PART": lambda: target("l_partkey", "part_key")}),
    "Event": ("events", {"event_id": lambda: text("event_id"), "kind": "event_type", "value": "value", "at": lambda: F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")}),
    "Embedding": ("embeddings", {"vec_id": lambda: text("vec_id"), "embedding": lambda: F.col("embedding").cast("array<double>")}),
}


def bound(type_name: str) -> dict[str, str | Column]:
    return {k: v() if callable(v) else v for k, v in BINDINGS[type_name][1].items()}
