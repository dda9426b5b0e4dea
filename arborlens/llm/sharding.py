"""Sharding by extendible hashing. DataFrame functions only.

A directory is indexed by the first bits of a row's hash. It starts with one bucket of all rows; a bucket
whose bytes exceed the limit splits on its next bit, and only such a bucket does, until every shard fits.
Sizes are summed per hash prefix of ``step`` more bits at a time, so a round moves one small row per prefix
and task; rounds go on only for the buckets that are still too large.

A bucket whose rows share the whole hash (repeated ids) goes on splitting by a second hash, of the text; rows that are
equal in both are filled up one after another. A row larger than the limit stands alone in such a part. Parts of
a bucket are told apart by ``overflow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlens.llm.common import cut, forget

#: Bits of the md5 of the key that the directory can use.
HASH_BITS = 60


def hash_bits(value):
    """The first 60 bits of md5(value as text) as a number; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _first_bits(h, depth: int):
    return F.shiftright(h, HASH_BITS - depth)


def directory(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(bucket, depth, prefix, bytes) of the shards of every bucket in ``rows(bucket, hash, bytes)``; prefixes are free of one another.

    ``prefix`` is the number of the first ``depth`` bits. At the full depth a shard may exceed the limit.
    """
    leaves, depth, open_rows = None, 0, rows
    while True:
        reach = min(depth + step, HASH_BITS)
        fine = cut(open_rows.groupBy("bucket", _first_bits(F.col("hash"), reach).alias("fine")).agg(F.sum("bytes").alias("b")))
        levels = fine.select("bucket", "b", F.explode(F.sequence(F.lit(depth), F.lit(reach))).alias("depth"), "fine").withColumn("prefix", F.expr(f"shiftright(fine, {reach} - depth)"))
        sized = levels.groupBy("bucket", "depth", "prefix").agg(F.sum("b").alias("bytes"))
        # A bucket is a shard if it fits and the bucket it came from doesn't.
        parent = sized.select("bucket", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("bytes").alias("up_bytes"))
        here = sized.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["bucket", "depth", "up"], "left")
        fits = (F.col("bytes") <= limit) & ((F.col("depth") == depth) | (F.col("up_bytes") > limit))
        over = (F.col("bytes") > limit) & (F.col("depth") == reach)
        found = cut(here.where(fits | over).select("bucket", "depth", "prefix", "bytes", over.alias("over")))
        forget(fine)
        last = reach == HASH_BITS
        new = found if last else found.where("not over")
        leaves = new.drop("over") if leaves is None else leaves.unionByName(new.drop("over"))
        still = found.where("over").select(F.col("bucket").alias("b2"), F.col("prefix").alias("p2"))
        if last or still.isEmpty():
            return cut(leaves)
        open_rows = open_rows.join(still, (F.col("bucket") == F.col("b2")) & (_first_bits(F.col("hash"), reach) == F.col("p2")), "left_semi")
        depth = reach


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with depth, prefix and shard_bytes of their shard: one look-up by the first bits in the directory, and a second
    one for the few rows whose shard is deeper than it."""
    held = leaves.groupBy("depth").agg(F.count("*").alias("n")).collect()  # at most 61 rows
    total = sum(r["n"] for r in held)
    # The directory has at most about four entries per shard.
    reach = max([0, *(d for d in range(HASH_BITS + 1) if 1 << d <= 4 * total)])
    shallow = leaves.where(F.col("depth") <= reach)
    entries = shallow.withColumn("entry", F.explode(F.expr(f"sequence(shiftleft(prefix, {reach} - depth), shiftleft(prefix + 1, {reach} - depth) - 1)")))
    out = rows.join(entries.withColumnRenamed("bytes", "shard_bytes"), (rows["bucket"] == entries["bucket"]) & (_first_bits(F.col("hash"), reach) == F.col("entry")), "left").drop(entries["bucket"]).drop("entry")
    deep = sorted(r["depth"] for r in held if r["depth"] > reach)
    if not deep:
        return out
    first, rest = out.where("depth is not null"), out.where("depth is null").drop("depth", "prefix", "shard_bytes")
    rest = rest.withColumn("depth", F.explode(F.array(*map(F.lit, deep)))).withColumn("prefix", F.expr(f"shiftright(hash, {HASH_BITS} - depth)"))
    return first.unionByName(rest.join(leaves.withColumnRenamed("bytes", "shard_bytes"), ["bucket", "depth", "prefix"]).select(first.columns))


def shard(df: DataFrame, *, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, overflow, shard_bytes) for every row of ``df``.

    ``shard`` is the bit string of the bucket ('' for one shard of all). ``overflow`` is 0, and counts from 1 the parts of a bucket
    that no further bit of the key can split: its rows go on to a directory of their own by the hash of the text, and rows
    that are equal in both are filled up in turn. A row above the limit stands alone. Null texts have no bytes; an
    empty table has no shard. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(df.select(F.col(id_col).alias("_id"), F.lit(0).cast("long").alias("bucket"), hash_bits(F.col(id_col)).alias("hash"), F.octet_length(text).cast("long").alias("bytes"), hash_bits(text).alias("second")))
    placed = _placed(rows, directory(rows, limit))
    bits = F.substring(F.lpad(F.bin("prefix"), HASH_BITS, "0"), HASH_BITS - F.col("depth") + 1, HASH_BITS)
    named = F.when(F.col("depth") == 0, "").otherwise(bits)
    columns = [F.col("_id").alias(id_col), F.col("bytes").alias("n_bytes"), named.alias("shard"), F.col("depth").cast("long").alias("depth"), "overflow", F.col("shard_bytes").cast("long").alias("shard_bytes")]
    out = placed.where(F.col("shard_bytes") <= limit).withColumn("overflow", F.lit(0).cast("long")).select(*columns)
    full = placed.where(F.col("shard_bytes") > limit)
    if full.isEmpty():
        return out
    full = cut(full.select("_id", F.col("depth").alias("d0"), F.col("prefix").alias("bucket"), F.col("second").alias("hash"), "bytes"))
    inner = cut(_placed(full, directory(full, limit)).select("_id", "d0", "bucket", "bytes", F.col("depth").alias("d1"), F.col("prefix").alias("p1"), "shard_bytes"))
    # Rows equal in key and text: of one size, so as many as fit go into a part.
    alike = Window.partitionBy("bucket", "d1", "p1")
    turn = F.row_number().over(alike.orderBy("bytes")) - 1
    many = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    parts = inner.where(F.col("shard_bytes") <= limit).withColumn("p2", F.lit(0).cast("long")).unionByName(inner.where(F.col("shard_bytes") > limit).withColumn("p2", F.floor(turn / many).cast("long")))
    sizes = parts.groupBy("bucket", "d1", "p1", "p2").agg(F.sum("bytes").alias("own"))
    sizes = sizes.withColumn("overflow", F.row_number().over(Window.partitionBy("bucket").orderBy("d1", "p1", "p2")).cast("long"))
    filled = parts.drop("shard_bytes").join(sizes, ["bucket", "d1", "p1", "p2"]).select("_id", "bytes", F.col("d0").alias("depth"), F.col("bucket").alias("prefix"), "overflow", F.col("own").alias("shard_bytes"))
    return out.unionByName(filled.select(*columns))
