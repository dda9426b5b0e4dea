"""Uses of names and the scopes that bind them, as containment of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_uses(uses: DataFrame, scopes: DataFrame, bindings: DataFrame, doc: list[str]) -> DataFrame:
    """``uses`` (doc, pos, name) with the innermost scope that holds the position and binds the name, or null, and whether the
    use lies in a function inside that scope (``captured``).

    ``scopes`` (doc, scope, kind, begin, end, depth) hold begin <= pos < end; ``bindings`` are (doc, scope, name). Names are joined with
    their bindings first, so only scopes that bind a name are compared with its uses.
    """
    bound = bindings.join(scopes, [*doc, "scope"])
    held = uses.select(*doc, "pos", "name").distinct()
    met = held.join(bound, [*doc, "name"]).where("pos >= begin and pos < end")
    best = met.groupBy(*doc, "pos", "name").agg(F.max(F.struct("depth", "scope")).alias("m"))
    functions = scopes.where("kind = 'function'").select(*doc, F.col("begin").alias("fb"), F.col("end").alias("fe"), F.col("depth").alias("fd"))
    inner = F.expr("fb <= pos and pos < fe and fd > m.depth")
    cond = inner
    f = functions
    for d in doc:
        f = f.withColumnRenamed(d, f"_{d}")
        cond = cond & F.col(d).eqNullSafe(F.col(f"_{d}"))
    caught = best.join(f, cond, "left_semi").select(*doc, "pos", "name", F.lit(True).alias("captured"))
    out = uses.join(best.select(*doc, "pos", "name", F.col("m.scope").alias("scope")), [*doc, "pos", "name"], "left")
    return out.join(caught, [*doc, "pos", "name"], "left").withColumn("captured", F.coalesce("captured", F.lit(False)))
