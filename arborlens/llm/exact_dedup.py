"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups. DataFrame functions only.

Rows are grouped by (md5 of the normalised text, the text itself): the hash spreads the groups and is compared
first, the text settles equality byte by byte, so a collision makes two groups. The grouping is combined
map-side: of a text with any number of copies a task sends one row. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prepared(df: DataFrame, id_col: str, text_col: str, normalize: Callable[[Column], Column] | None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalize(text) if normalize else text
    return df.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", F.unhex(F.md5("_text")))


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalize=None) -> DataFrame:
    """(_hash, _sha, keep_id, group_size), one row per distinct normalised text. ``keep``: min or max of the ids."""
    chosen = {"min": F.min, "max": F.max}[keep]
    groups = _prepared(df, id_col, text_col, normalize).groupBy("_hash", "_text").agg(chosen("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")


def mark_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalize=None) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Rows that repeat id and text share one verdict (all kept or none), for nothing tells them apart. An id of
    null is kept only if its group has no other id. No rows give no rows. Texts are read whole; other columns
    are not read. The join back carries hashes, not texts; the rows of a hot text are split by adaptive execution.
    """
    rows = _prepared(df, id_col, text_col, normalize).select("_id", "_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    groups = exact_groups(df, id_col=id_col, text_col=text_col, keep=keep, normalize=normalize)
    return rows.join(groups, ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalize=None) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: exactly one per distinct normalised text.

    Among rows that share id and text the other columns decide, in order. One shuffle, combined map-side.
    The columns must be orderable (no maps).
    """
    others = [c for c in df.columns if c != id_col]
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalize(text) if normalize else text
    # A null id loses in either direction.
    row = F.struct((F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()).alias("_known"), *(F.col(c) for c in [id_col, *others]))
    groups = df.select(F.unhex(F.md5(text)).alias("_exact_hash"), text.alias("_exact_text"), row.alias("_exact_row"))
    if normalize is None:
        # The grouping text is the column itself; don't carry it twice.
        row = F.struct(*(F.col(f"_exact_row.{c}") for c in ["_known", id_col, *(c for c in others if c != text_col)]), F.col(f"_exact_row.{text_col}").isNull().alias("_no_text"))
        kept = groups.withColumn("_exact_row", row).groupBy("_exact_hash", "_exact_text").agg(best("_exact_row").alias("r"))
        return kept.select(*(F.when(~F.col("r._no_text"), F.col("_exact_text")).alias(c) if c == text_col else F.col(f"r.{c}").alias(c) for c in df.columns))
    return groups.groupBy("_exact_hash", "_exact_text").agg(best("_exact_row").alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in df.columns))
