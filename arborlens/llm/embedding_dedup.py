"""Near-duplicate embeddings by exact search in cells of pivots.

Every distinct vector of a label is a member of the cell of its nearest pivot. A query visits its own cell and
each other cell that can hold a partner: a member of another cell is at least as near to that cell's pivot as to
the query's own, so its distance from the query is at least the query's distance from the plane between the two
pivots, and the cell is passed over only where that exceeds the range. In a cell queries meet members by block
products in double precision. No partner is lost and each ordered pair is met once, so links are counts of pairs.

Where vectors of a label don't cluster, a query visits most cells and work grows with the square of the label.
``audit_recall`` holds a sample against brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlens.llm.common import cut, forget
from arborlens.llm.components import connected_components

#: Vectors of one cell that are wanted; pivots are chosen so that a label has about that many per cell.
SHARD = 4096
#: At most so many pivots in all: they are the only data broadcast (8192 * dimension * 8 bytes).
MAX_PIVOTS = 8192
#: Members, and queries, of a cell that one task holds; a larger cell is a grid of blocks.
BLOCK = 8192
#: Rows of one product, and what rounding may take from the bound of a cell.
ROWS, SLACK = 512, 1e-6


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, v) of the vectors that can be compared; v holds the unit vector's doubles as bytes."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null and size(v) > 0")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep, dims, units = [], [], []
            vectors = batch.column(2)
            ends, flat = np.asarray(vectors.offsets), vectors.values
            holes = np.asarray(flat.is_null())
            numbers = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                a, b = ends[i], ends[i + 1]
                x = numbers[a:b]
                top = np.abs(x).max()
                ok = np.isfinite(top) and top > 0 and not holes[a:b].any()
                keep.append(bool(ok))
                if ok:
                    x = x / top  # first, so squares neither vanish nor overflow
                    dims.append(len(x))
                    units.append((x / np.sqrt(x @ x)).tobytes())
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["id", "label", "dim", "v"])

    return rows.mapInArrow(run, f"id long, label {dict(rows.dtypes)['label']}, dim int, v binary")


def embedding_components(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Only vectors of equal labels (and dimensions) are compared. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without label or id, link with nothing. Equal vectors are searched once and
    link with each other by count. Rows that repeat an id count as one node; its links are those of all its
    vectors, summed up, to vectors of any row. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows = cut(_usable(df, id_col, vector_col, label_col))
    groups = rows.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = cut(groups.withColumn("node", F.xxhash64("label", "dim", "v")))
    counts = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()  # a row per label
    total = sum(r["n"] for r in counts)
    # Pivots: the first vectors of each label in the order of their hash, one per SHARD vectors.
    share = min(1.0 / SHARD, MAX_PIVOTS / 2 / max(total, 1))
    ask = {(r["label"], r["dim"]): max(1, round(r["n"] * share)) for r in counts}
    limits = [(r["label"], r["dim"], ask[(r["label"], r["dim"])], min(1.0, 4.0 * ask[(r["label"], r["dim"])] / r["n"] + 32.0 / r["n"])) for r in counts]
    kind = dict(nodes.dtypes)["label"]
    cutoff = nodes.join(F.broadcast(spark.createDataFrame(limits, f"label {kind}, dim int, ask long, p double")), ["label", "dim"]) if counts else None
    pivots = []
    if cutoff is not None:
        # A thin slice by hash first, so ranking a large label moves a few rows.
        thin = cutoff.where(F.shiftrightunsigned("node", 33) / float(1 << 31) <= F.col("p"))
        ranked = thin.withColumn("r", F.row_number().over(Window.partitionBy("label", "dim").orderBy("node", "rep"))).where("r <= ask")
        pivots = ranked.select("label", "dim", "r", "v").collect()  # at most about MAX_PIVOTS
    book: dict = {}
    for p in sorted(pivots, key=lambda p: (str(p["label"]), p["dim"], p["r"])):
        book.setdefault((p["label"], p["dim"]), []).append(np.frombuffer(p["v"]))
    base, shards = {}, 0
    for key, vs in book.items():
        base[key] = (shards, np.array(vs))
        shards += len(vs)
    shared = spark.sparkContext.broadcast(base)

    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            labels, dims, names, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "dim", "node", "copies"))
            vs = batch.column(batch.schema.get_field_index("v"))
            by: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                by.setdefault(key, []).append(i)
            for key, at in by.items():
                first, centres = shared.value[key]
                for k in range(0, len(at), ROWS):
                    some = np.array(at[k : k + ROWS])
                    x = np.array([np.frombuffer(vs[int(i)].as_py()) for i in some])
                    s = x @ centres.T
                    own = np.argmax(s, axis=1)
                    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[own] @ centres.T)))
                    visits = s[np.arange(len(x)), own][:, None] - s <= chord * apart + SLACK
                    row, cell = np.nonzero(visits)
                    for a in range(0, len(row), 1 << 13):  # a query may visit thousands of cells
                        r, c = row[a : a + (1 << 13)], cell[a : a + (1 << 13)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(first + c, pa.int64()), pa.array(c == own[r], pa.bool_()), pa.array([names[i] for i in some[r]], pa.int64()), pa.array([copies[i] for i in some[r]], pa.int64()), pa.array([x[i].tobytes() for i in r], pa.binary())],
                            names=["shard", "own", "node", "copies", "v"],
                        )

    dealt = nodes.select("label", "dim", "node", "copies", "v").mapInArrow(deal, "shard long, own boolean, node long, copies long, v binary")
    # A cell of more members or queries than a block (one cluster may hold a third of all vectors) is cut by hashes
    # into a grid: every part of its members meets every part of its queries once.
    held = dealt = cut(dealt)
    sizes = dealt.groupBy("shard").agg(*(F.ceil(F.greatest(F.sum(n), F.lit(1)) / BLOCK).alias(k) for k, n in (("ms", F.col("own").cast("long")), ("qs", F.lit(1)))))
    dealt = dealt.join(F.broadcast(sizes), "shard")  # a row per pivot
    dealt = dealt.withColumn("m", F.pmod(F.xxhash64("node", "v"), F.col("ms"))).withColumn("q", F.pmod(F.xxhash64("v", "node"), F.col("qs")))
    zero = F.lit(0).cast("long")
    asks = F.transform(F.sequence(zero, F.col("ms") - 1), lambda m: F.struct(m.alias("m"), F.col("q").alias("q")))
    stands = F.transform(F.sequence(zero, F.col("qs") - 1), lambda q: F.struct(F.col("m").alias("m"), q.alias("q")))
    visits = dealt.withColumn("at", F.explode(F.when(F.col("own"), F.array_union(asks, stands)).otherwise(asks)))
    visits = visits.select("shard", F.col("at.m").alias("am"), F.col("at.q").alias("aq"), "node", "copies", "v", (F.col("own") & (F.col("at.m") == F.col("m"))).alias("member"), (F.col("at.q") == F.col("q")).alias("query"))

    def search(key, table):
        import pyarrow as pa

        x = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
        node = np.array(table.column("node").to_pylist(), dtype=np.int64)
        copies = np.array(table.column("copies").to_pylist(), dtype=np.int64)
        inside = np.flatnonzero(np.array(table.column("member").to_pylist(), dtype=bool))
        queries = np.flatnonzero(np.array(table.column("query").to_pylist(), dtype=bool))
        y, y_node, y_copies = x[inside], node[inside], copies[inside]
        found_of, links, other = [], [], []
        group = np.arange(len(x))  # a name per component of the links seen so far
        for k in range(0, len(queries) if len(inside) else 0, ROWS):
            some = queries[k : k + ROWS]
            near = (x[some] @ y.T >= threshold) & (node[some][:, None] != y_node[None, :])
            total = near @ y_copies
            for row in np.flatnonzero(near.any(axis=1)):
                q = some[row]
                found_of.append(int(node[q]))
                links.append(int(total[row]))
                other.append(None)
                found = inside[near[row]]
                names = group[found]
                new = names != group[q]
                if new.any():  # a spanning forest of the task's links, not all of them
                    heads, at = np.unique(names[new], return_index=True)
                    for f in found[new][at]:
                        found_of.append(int(node[q]))
                        links.append(0)
                        other.append(int(node[f]))
                    group[np.isin(group, heads)] = group[q]
        return pa.table({"node": pa.array(found_of, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.int64())})

    found = cut(visits.groupBy("shard", "am", "aq").applyInArrow(search, "node long, links long, other long"))
    copies = cut(rows.join(nodes.select("label", "dim", "v", "node", "rep", "copies"), ["label", "dim", "v"]).select("id", "node", "rep", "copies"))
    reps = nodes.select("node", "rep")
    met = found.where("other is not null").select("node", "other").distinct().join(reps.withColumnRenamed("rep", "a"), "node")
    met = met.join(reps.select(F.col("node").alias("other"), F.col("rep").alias("b")), "other").select("a", "b")
    comps = connected_components(met.unionByName(copies.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    per = copies.join(links, "node", "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    every = df.select(F.col(id_col).alias("_own"), F.col(id_col).cast("long").alias("id"))
    out = every.join(per, "id", "left").join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
    comp = F.coalesce("component", "id")
    out = cut(out.select(F.col("_own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept")))
    for table in (rows, nodes, held, found, copies):
        forget(table)
    return out


def audit_recall(df: DataFrame, result: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, every: int = 100) -> tuple[int, int]:
    """(links found, links there) of the rows whose id is divisible by ``every``, by brute force against all rows.

    The queries are a stated set and are broadcast in blocks of at most 1000; counts alone reach the driver.
    """
    spark = df.sparkSession
    rows = cut(_usable(df, id_col, vector_col, label_col))
    queries = rows.where(F.col("id") % every == 0)
    found = there = 0
    ids = [r["id"] for r in queries.select("id").distinct().orderBy("id").toLocalIterator()]
    for at in range(0, len(ids), 1000):
        block = spark.sparkContext.broadcast([(r["id"], r["label"], np.frombuffer(r["v"])) for r in queries.where(F.col("id").isin(ids[at : at + 1000])).collect()])

        def count(batches, block=block):
            import pyarrow as pa

            for batch in batches:
                n = 0
                for i, label, v in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                    v = np.frombuffer(v)
                    n += sum(label == ql and i != q and len(v) == len(qv) and float(v @ qv) >= threshold for q, ql, qv in block.value)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        there += rows.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
        found += result.where(F.col(id_col).isin(ids[at : at + 1000])).agg(F.sum("n_links")).first()[0] or 0
    return found, there
