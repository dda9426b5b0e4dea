"""Positions in a global order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """``df`` with its position (from 0) in ``order``, which must be total: columns whose values rise.

    A sort in ranges gives cuts, one row per partition: its first key and how many rows come before that. The cuts are broadcast, and
    rows are counted from the cut they lie behind, which is looked up by the first cut of a group of cuts and then within the group. Spark
    samples the bounds of ranges and merges partitions for each read anew, so no partition is known by its number outside that one
    sort; a key with its count is true of the rows however they are dealt.
    """
    one = Window.partitionBy(F.lit(1))
    key = F.struct(*order)
    ranges = df.orderBy(*order).select(key.alias("_key"), F.shiftrightunsigned(F.monotonically_increasing_id(), 33).alias("_part"))
    ranges = ranges.groupBy("_part").agg(F.min("_key").alias("_from"), F.count("*").alias("_n"))
    w = one.orderBy("_part")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.struct("_from", F.lead("_from").over(w).alias("_to"), before.alias("_before"))
    group = F.floor((F.row_number().over(w) - 1) / F.ceil(F.sqrt(F.count("*").over(one))))
    groups = ranges.select(cut.alias("_cut"), group.alias("_group")).groupBy("_group").agg(F.min("_cut._from").alias("_from"), F.collect_list("_cut").alias("_cuts"))
    groups = groups.select("_from", F.lead("_from").over(one.orderBy("_group")).alias("_to"), "_cuts")

    def behind(x: str):
        return (F.col("_key") >= F.col(f"{x}_from")) & (F.col(f"{x}_to").isNull() | (F.col("_key") < F.col(f"{x}_to")))

    dealt = df.withColumn("_key", key).join(F.broadcast(groups), behind("")).withColumn("_cut", F.explode("_cuts")).where(behind("_cut."))
    dealt = dealt.withColumn("_before", F.col("_cut._before")).drop("_key", "_from", "_to", "_cuts", "_cut")
    within = F.row_number().over(Window.partitionBy("_before").orderBy(*order)) - 1
    return dealt.withColumn(name, (F.col("_before") + within).cast("long")).drop("_before")
