"""Entropy coding of typed trees with models from their statistics: symbols, their cost, and the coded bytes.

A location is coded by the model of its longest context: its type, unless only one is possible, then its value. Strings are coded by
their recency rank; a miss is followed by a reference to the dictionary or to the document's own strings. A symbol that
its model has no size for is coded as the model's escape and then plainly; a model that lacks is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.symbols import F64_BITS, floor_to, varuint_bits
from arborlens.operators import contexts, frequencies, range_coder, recency, strings

#: Kinds of strings and of their tables.
KINDS = {"ident": "idents", "prop": "props", "raw": "strings"}


def table_model(freq: DataFrame) -> DataFrame:
    """(model, sym_index, size, offset, total, allow_escape) from zero-filled counts (suffix, tag, sym_index, hits); a model is named suffix#tag."""
    rows = freq.select(F.concat("suffix", F.lit("#"), "tag").alias("model"), "sym_index", "hits")
    return frequencies.prob_table(rows, ["model"], "sym_index").select("model", "sym_index", "size", "offset", "total", "allow_escape")


def string_model(windows: DataFrame, window: int, compat: bool = False) -> DataFrame:
    """The same from window histograms (str_kind, window_size, index, count): ranks, then the misses as symbol ``window``.

    ``compat`` codes properties by the table of identifiers.
    """
    rows = windows.where((F.col("window_size") == window) & ~F.col("index").isin("HITS", "TOTAL"))
    rows = rows.withColumn("sym_index", F.when(F.col("index") == "MISSES", window).otherwise(F.col("index").try_cast("int")))
    if compat:
        idents = rows.where("str_kind = 'ident'")
        rows = rows.where("str_kind <> 'prop'").unionByName(idents.withColumn("str_kind", F.lit("prop")))
    rows = rows.select(F.concat(F.lit("string#"), "str_kind").alias("model"), "sym_index", F.col("count").alias("hits"))
    return frequencies.prob_table(rows, ["model"], "sym_index").select("model", "sym_index", "size", "offset", "total", "allow_escape")


def varuint_bytes(value: Column) -> Column:
    """The bytes of a variable-length unsigned integer below 2 ** 28: seven bits in a byte, low ones first, the high bit on all but the last."""
    groups = F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).otherwise(4)
    each = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex((F.call_function("shiftright", value, (i * 7).cast("int")).bitwiseAND(127) + F.when(i < groups - 1, 128).otherwise(0)).cast("long")), 2, "0"))
    return F.unhex(F.array_join(each, ""))


def symbol_rows(nodes: DataFrame, doc: str, window: int, words: DataFrame, max_len: int = 2, compat: bool = False) -> DataFrame:
    """(doc, seq, part, model, sym_index, c1, c2, c3, bits, raw): what is coded for every location, in order of (seq, part).

    Types and values have a model and an index. Misses are followed by a reference, and floats stand for themselves: those have
    ``bits`` and ``raw`` bytes. ``words`` is the dictionary (value, id). ``compat`` keeps recency over all documents in their order, and
    writes zero bytes for references and floats, as one known program does.
    """
    rows = contexts.longest_context(nodes, max_len)
    none = F.lit(None)
    text = none.cast("string")
    parts = F.array(
        F.when(F.col("type_set_size") > 1, F.struct(F.lit(0).alias("part"), F.concat("suffix", F.lit("#type")).alias("model"), F.col("type_index").alias("sym_index"), F.lit("type").alias("c1"), F.col("type_name").alias("c2"), text.alias("c3"), none.cast("double").alias("bits"), none.cast("binary").alias("raw"))),
        F.when(F.col("value_tag").isNotNull(), F.struct(F.lit(1).alias("part"), F.concat("suffix", F.lit("#"), "value_tag").alias("model"), F.col("value_index").alias("sym_index"), F.lit("value").alias("c1"), F.col("type_name").alias("c2"), text.alias("c3"), none.cast("double").alias("bits"), none.cast("binary").alias("raw"))),
        F.when((F.col("type_kind") == "prim") & (F.col("type_name") == "f64"), F.struct(F.lit(1).alias("part"), text.alias("model"), none.cast("int").alias("sym_index"), F.lit("value").alias("c1"), F.lit("f64").alias("c2"), text.alias("c3"), F.lit(float(F64_BITS)).alias("bits"), _double_bytes(F.col("num_value")).alias("raw"))),
    )
    trees = rows.select(doc, "seq", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select(doc, "seq", "p.*")
    refs = nodes.where("str_kind is not null").select(doc, "seq", "str_kind", "str_value")
    # ``compat``: recency goes on from document to document, so each kind is one ordered stream.
    ranked = recency.mtf_ranks(refs, ["str_kind"], [doc, "seq"], "str_value", window) if compat else recency.mtf_ranks(refs, [doc, "str_kind"], ["seq"], "str_value", window)
    coded = ranked.select(doc, "seq", F.lit(2).alias("part"), F.concat(F.lit("string#"), "str_kind").alias("model"), F.when(F.col("dist") < 0, window).otherwise(F.col("dist")).alias("sym_index"), F.lit("string").alias("c1"), F.col("str_kind").alias("c2"), text.alias("c3"), none.cast("double").alias("bits"), none.cast("binary").alias("raw"))
    known = strings.escape_references(ranked.where("dist < 0"), words.withColumnRenamed("value", "str_value"), doc, "str_value", ["seq"], compat=compat).select(doc, "str_value", "ref", F.col("bits").cast("double").alias("bits"))
    escapes = ranked.where("dist < 0").join(known, [doc, "str_value"]).select(doc, "seq", F.lit(3).alias("part"), text.alias("model"), none.cast("int").alias("sym_index"), F.lit("string").alias("c1"), F.lit("escape").alias("c2"), F.col("str_kind").alias("c3"), "bits", varuint_bytes(F.col("ref")).alias("raw"))
    out = trees.unionByName(coded).unionByName(escapes)
    if compat:
        out = out.withColumn("raw", F.when(F.col("raw").isNotNull(), F.unhex(F.repeat(F.lit("00"), F.ceil(F.col("bits") / 8).cast("int")))))
    return out


def _double_bytes(v: Column) -> Column:
    """The eight bytes of a double, big end first, by arithmetic."""
    size = F.abs(v)
    power = F.greatest(F.lit(-1022), F.floor(F.log2(size)).cast("int"))
    # log2 may round up to the next whole number just below a power of two.
    power = F.when(F.pow(F.lit(2.0), power) > size, power - 1).otherwise(power)
    power = F.greatest(F.lit(-1022), F.when(F.pow(F.lit(2.0), power + 1) <= size, power + 1).otherwise(power))
    scaled = size / F.pow(F.lit(2.0), power)
    normal = scaled >= 1
    bits = F.when(F.isnan(v), F.lit(0x7FF8 << 48)).when(size == float("inf"), F.lit(0x7FF0 << 48)).when(size == 0, F.lit(0)).otherwise(
        F.shiftleft((F.when(normal, power + 1023).otherwise(0)).cast("long"), 52) + ((scaled - F.when(normal, 1.0).otherwise(0.0)) * float(1 << 52)).cast("long")
    )
    return F.unhex(F.lpad(F.hex(bits.cast("long") + F.when(v < 0, F.lit(-(1 << 63))).otherwise(F.lit(0))), 16, "0"))


def costs(rows: DataFrame, model: DataFrame, compat: bool = False) -> DataFrame:
    """``rows`` with size, offset, total, and bits of every symbol; a symbol without size costs its model's escape and
    itself, coded plainly. ``compat`` refuses such a symbol. A model or symbol that lacks ends the job."""
    m = model.select("model", "sym_index", "size", "offset", "total", "allow_escape")
    plain = rows.where("model is null").withColumns({"size": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "total": F.lit(None).cast("long")})
    coded = rows.where("model is not null").join(m, ["model", "sym_index"], "left")
    missing = F.raise_error(F.concat(F.lit("no model for symbol "), F.col("sym_index").cast("string"), F.lit(" of "), F.col("model"))).cast("long")
    total = F.when(F.col("total").isNull(), missing).otherwise(F.col("total"))
    if compat:
        total = F.when(F.col("size") == 0, F.raise_error(F.concat(F.lit("no size for symbol "), F.col("sym_index").cast("string"), F.lit(" of "), F.col("model"))).cast("long")).otherwise(total)
    unseen = F.col("size") == 0
    coded = coded.withColumn("total", total)
    escape = F.when(unseen, varuint_bytes(F.col("sym_index").cast("long")))
    coded = coded.withColumns(
        {
            "bits": frequencies.symbol_cost(F.col("size"), F.col("total")) + F.when(unseen, varuint_bits(F.col("sym_index"))).otherwise(0),
            "raw": escape,
            "offset": F.when(unseen, F.col("total") - 1).otherwise(F.col("offset")),
            "size": F.when(unseen, 1).otherwise(F.col("size")),
        }
    ).drop("allow_escape")
    return coded.select(*plain.columns).unionByName(plain)


def encode(costed: DataFrame, doc: str) -> DataFrame:
    """(doc, coded, n_symbols): the bytes of every document."""
    return range_coder.encode_groups(costed, doc, ["seq", "part"])


def rollup(costed: DataFrame, doc: str) -> DataFrame:
    """(doc, label, bits, symbols, bits_per_symbol) of every prefix of sym/type/.., sym/value/.., sym/string/.., most bits first."""
    out = frequencies.category_rollup(costed, ["c1", "c2", "c3"], (doc,))
    return out.withColumn("bits_per_symbol", F.col("bits") / F.col("symbols")).orderBy(doc, F.desc("bits"), "label")


def report(rolled: DataFrame, sizes: DataFrame, tables: DataFrame, doc: str) -> DataFrame:
    """One row per document: total_bytes of the code, the other compressors' bytes and ratios, entries and bytes of its strings.

    ``sizes`` has (doc, size, gzip_bytes) and, where a compressor for it is installed, brotli_bytes.
    """
    whole = rolled.where("label = 'sym'").select(doc, (F.floor(F.col("bits") / 8) + 1).cast("long").alias("total_bytes"), F.col("bits").alias("total_bits"), F.col("symbols").alias("total_symbols"))
    out = sizes.join(whole, doc, "left").join(tables, doc, "left")
    for c in ("gzip", "brotli"):
        if f"{c}_bytes" in sizes.columns:
            out = out.withColumn(f"{c}_ratio", floor_to(F.col("total_bytes") / F.col(f"{c}_bytes"), 10000))
    return out


def report_text(rolled: DataFrame, summary: DataFrame, doc: str) -> DataFrame:
    """(doc, text): the report of every document as text."""
    per = rolled.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct((-F.col("bits")).alias("k"), "label", "symbols", "bits", "bits_per_symbol"))).alias("ls"))
    line = F.transform("ls", lambda r: F.concat(F.lit("Encoded "), r["label"], F.lit(" - "), r["symbols"].cast("string"), F.lit(" symbols in "), floor_to(r["bits"], 100).cast("string"), F.lit(" bits\n "), floor_to(r["bits_per_symbol"], 100).cast("string"), F.lit(" bits/symbol\n")))
    head = F.concat(F.lit("REPORT "), F.col("size").cast("string"), F.lit(" - "), F.col(doc).cast("string"), F.lit("\n    StringTable "), F.coalesce("entries", F.lit(0)).cast("string"), F.lit(" entries of size "), F.coalesce("string_bytes", F.lit(0)).cast("string"), F.lit("\n   [code="), F.col("total_bytes").cast("string"), F.lit("] [gzip="), F.col("gzip_bytes").cast("string"), F.lit(" // "), F.col("gzip_ratio").cast("string"), F.lit("]\n"))
    return summary.join(per, doc).select(doc, F.concat(head, F.array_join(line, "")).alias("text"))
