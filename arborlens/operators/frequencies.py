"""Conditional frequency tables over symbols, their zero-filled and ranked forms, and probability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlens.functions.symbols import PRECISION, bits, slash_count


def count_symbols(rows: DataFrame, keys: list[str], symbol: list[str]) -> DataFrame:
    """Hits per key and symbol, with the key's total: one shuffle for the counts; the window sees counts only."""
    hits = rows.groupBy(*keys, *symbol).agg(F.count("*").alias("hits"))
    return hits.withColumn("total_hits", F.sum("hits").over(Window.partitionBy(*keys)))


def count_by_doc_and_all(rows: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Counts per document and of the whole corpus in one pass, by grouping sets; ``scope`` is doc or ALL."""
    k = ", ".join(keys)
    both = f"grouping sets (({doc}{', ' if k else ''}{k}), ({k}))"
    return rows.sparkSession.sql(f"select if(grouping({doc}) = 1, 'ALL', 'doc') scope, {doc}{', ' if k else ''}{k}, count(*) hits from {{rows}} group by {both}", rows=rows)


#: Rows of an alphabet up to which it is broadcast.
ALPHABET_ROWS = 100_000


def zero_filled(freq: DataFrame, alphabet: DataFrame, keys: list[str], symbol: str = "sym_index") -> DataFrame:
    """All symbols of the alphabet for every key that occurs, zeros included. An alphabet is a small dimension: a row
    per symbol of a declared type. It is broadcast once its size is checked; a larger one is joined by a shuffle."""
    tables = freq.select(*keys).distinct()
    on = [k for k in keys if k in alphabet.columns]
    if alphabet.limit(ALPHABET_ROWS + 1).count() <= ALPHABET_ROWS:
        alphabet = F.broadcast(alphabet)
    full = tables.join(alphabet, on) if on else tables.crossJoin(alphabet)
    return full.join(freq, [*keys, symbol], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def ranked(freq: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Add prob, bits and the cumulative probability in the order of falling hits (ties by ``tie``)."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc("hits"), tie)
    p = F.col("hits") / F.sum("hits").over(w)
    out = freq.withColumn("prob", p).withColumn("bits", F.when(F.col("hits") > 0, bits(F.col("prob"))))
    return out.withColumn("accum", F.sum("hits").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("hits").over(w)).withColumn("rank", F.row_number().over(order))


def by_specificity(tables: DataFrame, suffix: str = "suffix") -> DataFrame:
    """Rank tables by the number of slices in their context, then by hits."""
    return tables.withColumn("slashes", slash_count(F.col(suffix)))


def prob_table(freq: DataFrame, keys: list[str], index: str, hits: str = "hits") -> DataFrame:
    """Integer tables that sum to about 2^18: size, offset, total and allow_escape per key and symbol.

    Zero counts anywhere in a key reserve one unit for an escape. A symbol with hits has a size of 1 at least.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy(index)
    escape = F.max((F.col(hits) == 0).cast("int")).over(w)
    out = freq.withColumn("allow_escape", escape == 1)
    scale = (F.lit(PRECISION) - F.col("allow_escape").cast("int")).cast("double") / F.sum(hits).over(w)
    out = out.withColumn("size", F.when(F.col(hits) > 0, F.greatest(F.lit(1), F.floor(F.col(hits) * scale))).otherwise(0).cast("long"))
    out = out.withColumn("offset", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return out.withColumn("total", (F.sum("size").over(w) + F.col("allow_escape").cast("int")).cast("long"))


def symbol_cost(size: Column, total: Column) -> Column:
    """Bits of a coded symbol; one without a size is coded as the escape."""
    return F.log2(total / F.greatest(size, F.lit(1)))


def category_rollup(costs: DataFrame, levels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Bits and symbols of every prefix of the label sym/level/level..., per ``keys``. A row's label ends at its first null
    level; a row counts once for each of its prefixes."""
    label = "array('sym'" + "".join(f", cast({c} as string)" for c in levels) + ")"
    known = f"slice({label}, 1, coalesce(nullif(array_position(transform({label}, x -> x is null), true), 0) - 1, {len(levels) + 1}))"
    rows = costs.select(*keys, "bits", F.expr(known).alias("_l"))
    prefixes = F.expr("transform(sequence(1, size(_l)), i -> array_join(slice(_l, 1, i), '/'))")
    return rows.select(*keys, "bits", F.explode(prefixes).alias("label")).groupBy(*keys, "label").agg(F.sum("bits").alias("bits"), F.count("*").alias("symbols"))
