import random

from pyspark.sql import functions as F

from arborlens.streaming.recency import stream_counts, stream_ranks


def test_ranks_over_batches(spark, tmp_path):
    """Files come one per batch; state carries over."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.choice(["x", "y", "z", "u", None])) for i in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], "t long, s string, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("t long, s string, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_ranks(source, "s", "t", "v", limit=3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r.t: r["rank"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    fronts, want = {}, {}
    for t, s, v in rows:
        front = fronts.setdefault(s, [])
        want[t] = front.index(v) if v in front else -1
        fronts[s] = [v, *(x for x in front if x != v)][:3]
    assert got == want


def test_counts(spark, tmp_path):
    df = spark.createDataFrame([(k % 3, k * 60) for k in range(240)], "k long, s long").select("k", F.col("s").cast("timestamp").alias("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("k long, at timestamp").parquet(f"{tmp_path}/in")
    q = stream_counts(source, ["k"], "at").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hourly").agg(F.sum("hits"), F.count("*")).first()[:] == (240, 12)
