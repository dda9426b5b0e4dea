"""The star-schema tables viewed as typed trees and symbol streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = "struct<key:string,idx:int,n:int,iface:string,is_node:boolean>"
#: Variants of the enums, in ordinal order.
STATUS, FLAGS, LINE_STATUS = ["F", "O", "P"], ["A", "N", "R"], ["F", "O"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _step(key=None, idx=None, n=None, iface=None, node=False):
    lit = F.lit
    return F.struct(
        (lit(key) if key else lit(None).cast("string")).alias("key"),
        (idx if idx is not None else lit(None).cast("int")).alias("idx"),
        (n if n is not None else lit(None).cast("int")).alias("n"),
        (lit(iface) if iface else lit(None).cast("string")).alias("iface"),
        lit(node).alias("is_node"),
    )


def numbered_lines(lineitem: DataFrame) -> DataFrame:
    """Lines of an order with their array position; the line number alone isn't unique."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return lineitem.withColumn("i", (F.row_number().over(w) - 1).cast("int")).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")).cast("int"))


#: Paths of the symbols of an order, below it: fields, and fields of its lines.
_ORDER_FIELDS = {"status": "OrderStatus", "priority": "OrderPriority", "lines": "arrayLength"}
_LINE_FIELDS = {"linenumber": "uint", "returnflag": "ReturnFlag", "linestatus": "LineStatus"}
_ORDER_ROOT = [("$Root", None, None, "Order", True)]
_CUSTOMER_ROOT = [("$Root", None, None, "Customer", True), ("orders", None, None, None, False), (None, None, None, "Order", True)]
_LINE = [("lines", None, None, None, False), (None, None, None, "LineItem", True)]


def _order_values(spark: SparkSession, sf_dir: str, deep: bool):
    """(orders with the count of their lines, lines) with ``doc_id``, and (tag -> index, name, alphabet size) of either."""
    from arborlens.functions.symbols import capped_name, enum_index, length_index, uint_index

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("c"))
    o = orders.join(sizes, orders["o_orderkey"] == sizes["l_orderkey"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    o = o.withColumn("doc_id", F.col("o_custkey" if deep else "o_orderkey"))
    if deep:
        lines = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("doc_id")), lines["l_orderkey"] == F.col("o_orderkey"))
    else:
        lines = lines.withColumn("doc_id", F.col("l_orderkey"))
    length, number = length_index(F.col("c")), uint_index(F.col("l_linenumber"))
    of_order = {
        "OrderStatus": (enum_index(F.col("o_orderstatus"), STATUS), F.col("o_orderstatus"), len(STATUS)),
        "OrderPriority": (enum_index(F.col("o_orderpriority"), PRIORITY), F.col("o_orderpriority"), len(PRIORITY)),
        "arrayLength": (length, capped_name(length, 16), 17),
    }
    of_line = {
        "uint": (number, capped_name(number, 8), 9),
        "ReturnFlag": (enum_index(F.col("l_returnflag"), FLAGS), F.col("l_returnflag"), len(FLAGS)),
        "LineStatus": (enum_index(F.col("l_linestatus"), LINE_STATUS), F.col("l_linestatus"), len(LINE_STATUS)),
    }
    return o, lines, of_order, of_line


def _both(o, lines, of_order, of_line, deep, rows):
    """Symbols of orders and lines; ``rows`` makes the structs of one path, tag and symbol. Fields become rows by an explode."""
    root = _CUSTOMER_ROOT if deep else _ORDER_ROOT
    per_order = [x for f, tag in _ORDER_FIELDS.items() for x in rows([*root, (f, None, None, None, False)], tag, *of_order[tag])]
    per_line = [x for f, tag in _LINE_FIELDS.items() for x in rows([*root, *_LINE, (f, None, None, None, False)], tag, *of_line[tag])]
    parts = [df.select("doc_id", F.explode(F.array(*xs)).alias("s")) for df, xs in ((o, per_order), (lines, per_line)) if xs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "s.*")


def order_symbols(spark: SparkSession, sf_dir: str, lengths: list[int], deep: bool = False) -> DataFrame:
    """(doc_id, suffix_len, suffix, tag, sym_index, sym_name) of order trees, or with ``deep`` of customer trees that hold them.

    All documents share the paths, so a suffix is a constant per path; elements above a symbol are ``*`` whatever their place,
    so lines aren't numbered. One join of orders with the counts of their lines.
    """
    from arborlens.operators.contexts import suffix_of

    def rows(path, tag, index, name, _size):
        found = [(n, suffix_of(path, n)) for n in lengths]
        return [F.struct(F.lit(n).alias("suffix_len"), F.lit(s).alias("suffix"), F.lit(tag).alias("tag"), index.cast("int").alias("sym_index"), name.alias("sym_name")) for n, s in found if s]

    return _both(*_order_values(spark, sf_dir, deep), deep, rows)


def order_nodes(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    """Locations (doc_id, path, symbol columns) of the same trees; elements above a symbol have no place in their path."""

    def rows(path, tag, index, name, size):
        none = F.lit(None)
        steps = F.array(*(F.struct(F.lit(k).cast("string").alias("key"), F.lit(i).cast("int").alias("idx"), F.lit(n).cast("int").alias("n"), F.lit(f).cast("string").alias("iface"), F.lit(d).alias("is_node")) for k, i, n, f, d in path))
        return [
            F.struct(
                steps.cast(f"array<{STEP}>").alias("path"),
                none.cast("int").alias("type_index"), none.cast("string").alias("type_name"), F.lit(1).alias("type_set_size"),
                F.lit(tag).alias("value_tag"), index.cast("int").alias("value_index"), name.alias("value_name"), F.lit(size).alias("value_alphabet_size"),
            )
        ]

    return _both(*_order_values(spark, sf_dir, deep), deep, rows)


def event_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String references of the events: event types as identifiers, properties as raw strings."""
    e = table(spark, sf_dir, "events")
    kinds = F.array(F.struct(F.lit("ident").alias("kind"), F.col("event_type").alias("value")), F.struct(F.lit("raw").alias("kind"), F.col("props").alias("value")))
    return e.select("user_id", "ts", "event_id", F.explode(kinds).alias("r")).select("user_id", "ts", "event_id", "r.kind", "r.value").where("value is not null")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "value"))


#: The schema of events and conversations as trees.
SCHEMA = """
typedef DOMString string;
[IdentifierType=ident] typedef string Kind;
enum EventType { "click", "error", "purchase", "signup", "view" };
interface Node { };
interface Event : Node {
  attribute EventType type;
  attribute double? value;
  attribute string? props;
};
interface History : Node { attribute FrozenArray<Event> events; };
interface Turn : Node {
  attribute Kind? role;
  attribute string? text;
};
interface Conversation : Node { attribute FrozenArray<Turn> turns; };
"""


def table_schema():
    from arborlens.schema.idl import compile_idl

    return compile_idl(SCHEMA)


def event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of one tree per event."""
    from arborlens.sources.typed_trees import typed_nodes

    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), "value", "props")).alias("tree"))
    return typed_nodes(e, table_schema(), "Event", id_col="event_id", text_col="tree")


def conversation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of one tree per conversation."""
    from arborlens.sources.typed_trees import typed_nodes

    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    c = c.select("conv_id", F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("tree"))
    return typed_nodes(c, table_schema(), "Conversation", id_col="conv_id", text_col="tree")
