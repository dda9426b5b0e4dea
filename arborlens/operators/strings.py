"""Corpus-wide string statistics: counts by kind, first-seen index, dictionary, sizes of string tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions.symbols import string_header_bytes, varuint_bits

DICTIONARY_SIZE = 4096


def kind_counts(kind: str) -> list:
    """Counts of identifiers, properties and strings."""
    return [F.count_if(F.col(kind) == k).alias(f"{k}_count") for k in ("ident", "prop", "raw")]


def global_counts(refs: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """Per string: ident_count, prop_count, raw_count, total_count. Combined map-side before the shuffle."""
    c = kind_counts(kind)
    return refs.groupBy(value).agg(*c, F.count("*").alias("total_count"))


def dictionary(counts: DataFrame, value: str = "value", total: str = "total_count", size: int = DICTIONARY_SIZE) -> DataFrame:
    """The most frequent strings (ties by string) with ids from 0: a distributed top-k, ranked after the cut."""
    from pyspark.sql.window import Window

    top = counts.select(value, total).orderBy(F.desc(total), value).limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc(total), value)) - 1).cast("long"))


def escape_references(refs: DataFrame, words: DataFrame, doc: str, value: str, order: list[str], size: int = DICTIONARY_SIZE, compat: bool = False) -> DataFrame:
    """First occurrences per document with their reference: the dictionary id, else a local id beyond the dictionary.

    The dictionary has at most ``size`` rows and is broadcast.
    """
    from pyspark.sql.window import Window

    first = refs.groupBy(doc, value).agg(F.min(F.struct(*order)).alias("first"))
    known = first.join(F.broadcast(words.select(value, "id")), value, "left")
    local = F.row_number().over(Window.partitionBy(doc, F.col("id").isNull()).orderBy("first", value)) - 1
    ref = F.coalesce("id", (local + size).cast("long"))
    return known.withColumn("ref", ref).withColumn("bits", varuint_bits(F.col("ref"), compat))


def string_table_size(refs: DataFrame, doc: str, value: str) -> DataFrame:
    """Entries and encoded bytes of the table of distinct strings per document."""
    n = F.octet_length(value)
    return refs.select(doc, value).distinct().groupBy(doc).agg(F.count("*").alias("entries"), F.sum(n + string_header_bytes(n)).cast("long").alias("total_bytes"))
