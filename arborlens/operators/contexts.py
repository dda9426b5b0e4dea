"""Locations of typed trees: path suffixes and symbols.

A row of ``nodes`` is one location in pre-order: doc_id, seq, path (root to leaf), type and value symbols.
path is ARRAY<STRUCT<key STRING, idx INT, n INT, iface STRING, is_node BOOLEAN>>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SUFFIX = 3


def with_suffixes(nodes: DataFrame, max_len: int = 1) -> DataFrame:
    """One row per location and suffix length 1..max_len that its ancestors allow, with ``suffix_len`` and ``suffix``.

    A suffix holds the slices of the last nodes above the location, outermost first, joined by ``/``; a slice is
    the node's interface and the keys below it. Inner array indexes are ``*``; a record that isn't a node adds
    ``=Interface``. All in array functions, so it stays inside the scan's stage.
    """
    if not 0 <= max_len <= MAX_SUFFIX:
        raise ValueError(f"suffix length must be 0..{MAX_SUFFIX}")
    d = nodes.withColumn("_d", F.size("path")).withColumn("_anchors", F.expr("if(_d < 2, array(), filter(sequence(1, _d - 1), i -> element_at(path, i).is_node))"))
    if max_len == 0:
        return d.where("false").withColumn("suffix_len", F.lit(0)).withColumn("suffix", F.lit("")).drop("_d", "_anchors")
    d = d.where("size(_anchors) > 0").withColumn("suffix_len", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_len), F.size("_anchors")))))
    d = d.withColumn("_at", F.expr("element_at(_anchors, size(_anchors) - suffix_len + 1)"))
    leaf = "case when p.idx is null then p.key when p.n <= 4 then concat(p.idx, '-of-', p.n) when p.idx <= 4 then concat(p.idx, '-of-many') else '*' end"
    inner = "concat(coalesce(p.key, '*'), case when p.is_node then concat('/', p.iface) when p.iface is not null then concat('=', p.iface) else '' end)"
    keys = f"transform(slice(path, _at + 1, _d - _at), (p, i) -> if(i = _d - _at - 1, {leaf}, {inner}))"
    return d.withColumn("suffix", F.expr(f"concat_ws('.', concat(array(element_at(path, _at).iface), {keys}))")).drop("_d", "_anchors", "_at")


def suffix_of(path: list[tuple], length: int) -> str | None:
    """The suffix of one path (tuples as in ``path``), for paths that all documents share; None if it has too few nodes."""
    anchors = [i for i, (_, _, _, _, node) in enumerate(path[:-1]) if node]
    if len(anchors) < length:
        return None
    at = anchors[-length]
    words = [path[at][3]]
    for key, _, _, iface, node in path[at + 1 : -1]:
        words.append((key or "*") + (f"/{iface}" if node else f"={iface}" if iface else ""))
    key, i, n, _, _ = path[-1]
    words.append(key if i is None else f"{i}-of-{n}" if n <= 4 else f"{i}-of-many" if i <= 4 else "*")
    return ".".join(words)


def longest_context(nodes: DataFrame, max_len: int = 2) -> DataFrame:
    """Of each location the row with its longest available suffix; the root has none."""
    rows = with_suffixes(nodes, max_len)
    return rows.where(F.expr(f"suffix_len = least({max_len}, size(filter(slice(path, 1, size(path) - 1), p -> p.is_node)))"))


def symbols(contexts: DataFrame) -> DataFrame:
    """Explode the type symbol and the value symbol of each (location, suffix) into rows (tag, index, name, alphabet size).

    Alphabets of one symbol predict nothing and go before any aggregation.
    """
    kinds = F.array(
        F.struct(F.lit("type").alias("tag"), F.col("type_index").alias("sym_index"), F.col("type_name").alias("sym_name"), F.col("type_set_size").alias("alphabet_size")),
        F.struct(F.col("value_tag").alias("tag"), F.col("value_index").alias("sym_index"), F.col("value_name").alias("sym_name"), F.col("value_alphabet_size").alias("alphabet_size")),
    )
    rows = contexts.withColumn("_s", F.explode(kinds)).where("_s.tag is not null and _s.sym_index is not null and _s.alphabet_size > 1")
    return rows.select(*[c for c in contexts.columns], "_s.*")
