"""Move-to-front ranks: the number of distinct symbols since a symbol's previous occurrence in its stream.

One pass gives the distance; every window size is a threshold on it (rank -1 from the size on, or without a
previous occurrence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.ordering import global_index

MAX_WINDOW, DEFAULT_WINDOW = 4096, 64


def distances(values, limit: int, front: list | None = None):
    """Distances of a sequence by a bounded move-to-front list; -1 from ``limit`` on and for first occurrences. ``front`` is the list
    before the first value, the latest symbol first."""
    import numpy as np

    front = list(front or [])[:limit]
    known: set = set(front)
    out = np.empty(len(values), dtype=np.int32)
    for k, v in enumerate(values):
        if v in known:
            at = front.index(v)
            out[k] = at
            del front[at]
        else:
            out[k] = -1
            known.add(v)
            if len(front) == limit:
                known.discard(front.pop())
        front.insert(0, v)
    return out


def latest(values, limit: int) -> list:
    """The last ``limit`` distinct values, the latest first."""
    out: dict = {}
    for v in reversed(values):
        out.setdefault(v)
        if len(out) == limit:
            break
    return list(out)


def mtf_ranks(df: DataFrame, stream: list[str], order: list[str], symbol: str, limit: int = MAX_WINDOW, chunk: int | None = None) -> DataFrame:
    """``df``'s stream, order and symbol columns and ``dist``. Only these columns are shuffled. Null symbols are symbols of their own;
    rows that are equal in order are taken by symbol.

    Without ``chunk`` a stream is one group, and different streams spread over the cluster. With it rows are sorted over the
    cluster and cut into groups of ``chunk`` rows, however long a stream is: a group begins with the list that the ones before it leave, which
    is put together from the last ``limit`` symbols of each.
    """
    if not 1 <= limit <= MAX_WINDOW:
        raise ValueError(f"window size must be 1..{MAX_WINDOW}")
    src = df.select(*dict.fromkeys([*stream, *order, symbol]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    if chunk is not None:
        return _chunked(src, schema, stream, order, symbol, limit, chunk)

    def run(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in dict.fromkeys([*order, symbol])])
        return table.append_column("dist", pa.array(distances(table.column(symbol).to_pylist(), limit), pa.int32()))

    return src.groupBy(*stream).applyInArrow(run, f"{schema}, dist int")


def _chunked(src: DataFrame, schema: str, stream: list[str], order: list[str], symbol: str, limit: int, chunk: int) -> DataFrame:
    placed = global_index(src, list(dict.fromkeys([*stream, *order, symbol])), "_pos").withColumn("_chunk", F.floor(F.col("_pos") / chunk).cast("long"))
    kind = src.schema[symbol].dataType.simpleString()
    shape = f"_chunk long, _key string, _whole boolean, _front array<{kind}>"

    def keys(table) -> list[str]:
        return [repr(k) for k in zip(*(table.column(c).to_pylist() for c in stream), strict=True)]

    def tail(table):
        """Of the last stream of a chunk its latest symbols, and whether it is all of the chunk."""
        import pyarrow as pa

        table = table.sort_by("_pos")
        names = keys(table)
        first = names.index(names[-1])
        front = latest(table.column(symbol).to_pylist()[first:], limit)
        return pa.table({"_chunk": table.column("_chunk")[:1], "_key": pa.array([names[-1]]), "_whole": pa.array([first == 0]), "_front": pa.array([front], pa.list_(table.schema.field(symbol).type))})

    def heads(table):
        """The list with which each chunk begins: a row per chunk is all that meets here."""
        import pyarrow as pa

        key, front, out = None, [], []
        rows = sorted(table.to_pylist(), key=lambda r: r["_chunk"])
        for r in rows:
            out.append((r["_chunk"], key, front))
            goes_on = r["_whole"] and r["_key"] == key
            front = (r["_front"] + [x for x in front if x not in r["_front"]])[:limit] if goes_on else r["_front"]
            key = r["_key"]
        c, k, f = zip(*out, strict=True)
        return pa.table({"_chunk": pa.array(c, pa.int64()), "_key": pa.array(k, pa.string()), "_whole": pa.array([True] * len(c)), "_front": pa.array(f, table.schema.field("_front").type)})

    def run(table, head):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("_pos")
        names, values = keys(table), table.column(symbol).to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        begin = head.column("_front")[0].as_py() if head.num_rows and head.column("_key")[0].as_py() == names[0] else []
        dist = np.concatenate([distances(values[a:b], limit, begin if a == 0 else None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return table.drop_columns(["_pos", "_chunk"]).append_column("dist", pa.array(dist, pa.int32()))

    tails = placed.groupBy("_chunk").applyInArrow(tail, shape)
    begins = tails.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(lambda t: heads(t), shape)
    return placed.groupBy("_chunk").cogroup(begins.groupBy("_chunk")).applyInArrow(run, f"{schema}, dist int")


def token_ranks(df: DataFrame, doc: str, text: str, limit: int = DEFAULT_WINDOW) -> DataFrame:
    """(doc, rank, hits) of the space-separated words of each text. A text is one row, so no shuffle is needed at all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            docs, ranks, hits = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if t is None:
                    continue
                values, counts = np.unique(distances(t.split(" "), limit), return_counts=True)
                docs += [d] * len(values)
                ranks += values.tolist()
                hits += counts.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ranks, pa.int32()), pa.array(hits, pa.int64())], names=[doc, "rank", "hits"])

    return df.select(F.col(doc).cast("long").alias(doc), F.col(text)).mapInArrow(run, f"{doc} long, rank int, hits long")


def window_histograms(dists: DataFrame, sizes: list[int], keys: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Zero-filled counts of ranks per window size, with rows MISSES, HITS and TOTAL and their share of TOTAL.

    Counts are gathered into one row per key and size (W + 1 numbers at most) before ranks are filled up, so
    keys are never broadcast. ``compat`` counts the first hit of a rank twice, as one known program does.
    """
    keys = keys or []
    base = dists.groupBy(*keys, "dist").agg(F.count("*").alias("hits"))
    w = base.withColumn("window_size", F.explode(F.array(*map(F.lit, sizes))))
    w = w.withColumn("rank", F.when((F.col("dist") < 0) | (F.col("dist") >= F.col("window_size")), -1).otherwise(F.col("dist")))
    w = w.groupBy(*keys, "window_size", "rank").agg((F.sum("hits") + (1 if compat else 0)).alias("hits"))
    w = w.groupBy(*keys, "window_size").agg(F.map_from_entries(F.collect_list(F.struct("rank", "hits"))).alias("_m"), F.sum("hits").alias("_t"), F.sum(F.when(F.col("rank") >= 0, F.col("hits")).otherwise(0)).alias("_h"))
    if not keys:  # sizes without any row
        w = dists.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sizes))).alias("window_size")).join(w, "window_size", "left")
        w = w.withColumns({"_t": F.coalesce("_t", F.lit(0)), "_h": F.coalesce("_h", F.lit(0)), "_m": F.coalesce("_m", F.expr("cast(map() as map<int, bigint>)"))})
    filled = "transform(sequence(0, window_size - 1), r -> struct(cast(r as string) as index, coalesce(_m[r], 0L) as count))"
    ends = "array(struct('MISSES' as index, coalesce(_m[-1], 0L) as count), struct('HITS' as index, _h as count), struct('TOTAL' as index, _t as count))"
    rows = w.select(*keys, "window_size", "_t", F.expr(f"explode(concat({filled}, {ends}))").alias("x"))
    return rows.select(*keys, "window_size", "x.index", "x.count", F.expr("x.count / nullif(_t, 0)").alias("prob"))


def first_seen(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the rank of their first appearance. Positions are compared as structs: no global sort of rows."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    return global_index(first, ["first", value])
