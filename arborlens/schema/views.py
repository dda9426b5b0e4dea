"""Schemas as Spark types and as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from arborlens.schema.types import NULL, Enum, Iface, Schema, SchemaError, Typedef, pretty

_PRIMITIVE = {"bool": T.BooleanType, "uint": T.LongType, "int": T.LongType, "f64": T.DoubleType, "str": T.StringType}


def struct_type(schema: Schema, iface: str, _above: tuple[str, ...] = ()) -> T.StructType:
    """The struct of an interface. Enums and names are strings, a type set with null is nullable. Interfaces that hold
    themselves and unions of several types have no struct: their values are kept as rows of locations."""
    if iface in _above:
        raise SchemaError(f"{iface} holds itself: {' > '.join((*_above, iface))}")

    def spark_type(t):
        real = [x for x in schema.type_set(t) if x != NULL]
        if len(real) != 1:
            raise SchemaError(f"{pretty(t)} is a union of {len(real)} types")
        kind, what = real[0]
        if kind == "iface":
            return struct_type(schema, what, (*_above, iface))
        if kind == "array":
            return T.ArrayType(spark_type(what), NULL in schema.type_set(what))
        return _PRIMITIVE[what]() if kind == "prim" else T.StringType()

    fields = []
    for name, t, lazy in schema.iface(iface).fields:
        members = schema.type_set(t)
        tags = {"lazy": lazy} | {"ident": w for k, w in members if k == "ident"} | {"enum": w for k, w in members if k == "enum"}
        fields.append(T.StructField(name, spark_type(t), NULL in members, tags))
    return T.StructType(fields)


def declarations(spark: SparkSession, schema: Schema) -> DataFrame:
    """(place, name, kind, is_node, target): a row per declaration."""
    rows = [(i, d.name, type(d).__name__.lower(), d.is_node if isinstance(d, Iface) else None, pretty(d.target) if isinstance(d, Typedef) else None) for i, d in enumerate(schema.declarations.values())]
    return spark.createDataFrame(rows, "place int, name string, kind string, is_node boolean, target string")


def fields(spark: SparkSession, schema: Schema) -> DataFrame:
    """(iface, place, name, bound, lazy): a row per field, in walk order."""
    rows = [(d.name, i, n, pretty(t), lazy) for d in schema.declarations.values() if isinstance(d, Iface) for i, (n, t, lazy) in enumerate(d.fields)]
    return spark.createDataFrame(rows, "iface string, place int, name string, bound string, lazy boolean")


def variants(spark: SparkSession, schema: Schema) -> DataFrame:
    """(enum, sym_index, name, text): a row per variant."""
    rows = [(d.name, i, v, t) for d in schema.declarations.values() if isinstance(d, Enum) for i, (v, t) in enumerate(zip(d.variants, d.texts, strict=True))]
    return spark.createDataFrame(rows, "enum string, sym_index int, name string, text string")


def alphabets(spark: SparkSession, schema: Schema) -> DataFrame:
    """(alphabet, sym_index, sym_name): the symbols of every type set and value tag. As small as the schema."""
    rows = [(a, i, s) for a, symbols in schema.alphabets.items() for i, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "alphabet string, sym_index int, sym_name string")
