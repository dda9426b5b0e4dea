"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Tokens are summed per cell of (source, language, topic). The cells' token weights are raked: each dimension in
turn is scaled so that its marginal meets its target, again and again until all marginals hold. A document's
rate is its cell's raked tokens over the cell's own tokens; whole parts of a rate are copies, the rest is drawn
from a hash of the id, so the sample is the same on every run and needs no shuffle of the texts.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlens.llm.common import cut, forget

#: Sweeps over all dimensions between two writes of the cells, and at most.
SWEEPS, ROUNDS = 4, 12
TOLERANCE = 1e-10
#: Cells that one partition holds; more are an error, as dimensions of so many values aren't meant.
MOST_CELLS = 1_000_000


def n_tokens(text):
    """Estimate of tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4).cast("long")


def rake(cells: DataFrame, targets: dict[str, float | dict]) -> DataFrame:
    """Add ``w`` to ``cells(dims..., tokens)``: shares that sum to 1 and meet the targets of every dimension.

    A target is a dict value -> weight, or a number alpha: the observed shares to that power. Weights are
    normalised; values that a dict lacks get none. Where targets contradict the cells that exist, the sweeps end
    after ROUNDS * SWEEPS with the last dimension met, and a warning says by how much others are missed. The cells are the combinations of dimension values, a
    table of bounded size whatever the number of documents; they are kept in one partition.
    """
    one = cells.coalesce(1)
    everything = Window.partitionBy(F.lit(1))
    one = one.withColumn("w", F.col("tokens").cast("double") / F.sum(F.col("tokens").cast("double")).over(everything))
    for d, t in targets.items():
        own = Window.partitionBy(d)
        if isinstance(t, dict):
            total = float(sum(t.values()))
            goal = F.lit(0.0)
            for value, weight in t.items():
                goal = F.when(F.col(d).eqNullSafe(F.lit(value)), F.lit(weight / total)).otherwise(goal)
            one = one.withColumn(f"_goal_{d}", goal)
        else:
            one = one.withColumn(f"_share_{d}", F.sum("w").over(own)).withColumn(f"_rank_{d}", F.row_number().over(own.orderBy(*sorted(targets))))
            raised = F.pow(F.col(f"_share_{d}"), F.lit(float(t)))
            one = one.withColumn(f"_goal_{d}", raised / F.sum(F.when(F.col(f"_rank_{d}") == 1, raised)).over(everything)).drop(f"_share_{d}", f"_rank_{d}")
    for _ in range(ROUNDS):
        for _ in range(SWEEPS):
            for d in targets:
                have = F.sum("w").over(Window.partitionBy(d))
                one = one.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"_goal_{d}") / have).otherwise(0.0))
        new = cut(one)
        one = new.coalesce(1)
        off = None
        for d in targets:
            miss = one.withColumn("_m", F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"_goal_{d}"))).agg(F.max("_m")).first()[0]
            off = max(off or 0.0, miss or 0.0)
        if off < TOLERANCE:
            break
    else:
        warnings.warn(f"targets contradict the cells: a marginal is off by {off:.3g}", stacklevel=2)
    return one.drop(*(f"_goal_{d}" for d in targets))


def fill(rates: DataFrame, budget: float) -> DataFrame:
    """Scale ``rate`` of ``rates(tokens, rate)`` by one factor, with 1 as the bound, so that ``budget`` of all tokens is drawn.

    In falling order of rates: a cell is full if the factor that the cells before it leave lifts it to 1 or more;
    the first that isn't has the factor of all that follow. Cells without tokens get the budget.
    """
    falling = Window.partitionBy(F.lit(1)).orderBy(F.desc("rate"), F.desc("tokens"))
    everything = Window.partitionBy(F.lit(1))
    tokens = F.col("tokens").cast("double")
    before = F.coalesce(F.sum(tokens).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(tokens * F.col("rate")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    left = F.greatest(F.sum(tokens).over(everything) * budget - before, F.lit(0.0))
    held = rates.withColumn("_factor", F.when(after > 0, left / after))
    open_ = F.when((F.col("tokens") > 0) & (F.col("_factor") * F.col("rate") < 1), F.col("_factor"))
    # Factors fall from cell to cell once one isn't full, so the first is the largest.
    held = held.withColumn("_factor", F.max(open_).over(everything))
    rate = F.when(F.col("tokens") == 0, F.lit(float(budget))).when(F.col("rate") > 0, F.least(F.coalesce(F.col("_factor") * F.col("rate"), F.lit(1.0)), F.lit(1.0))).otherwise(0.0)
    return held.withColumn("rate", rate).drop("_factor")


def sample_mix(df: DataFrame, targets: dict[str, float | dict], *, id_col: str = "doc_id", text_col: str = "text", budget: float = 1.0, max_copies: int = 4, whole: bool = False, seed: str = "mix") -> DataFrame:
    """``df`` with n_tokens, rate and copies; the dimensions in ``targets`` are columns of ``df``.

    ``budget`` is the wanted share of all tokens; a rate is cut at ``max_copies``. With ``whole`` copies is 0 or 1:
    cells that ask for more stop at a rate of 1, and what they leave of the budget goes to the others in proportion
    to their raked rates, so the sample keeps the budget as far as cells with a target hold it. Null dimension values are a value of their
    own. Null and empty texts have no tokens; a cell without tokens has the rate of the budget. Rows that share
    an id are drawn together; a null id is drawn as an empty one. An empty table gives an empty result.
    Columns of ``df`` named n_tokens, rate or copies are replaced.
    """
    dims = list(targets)
    rows = df.withColumn("n_tokens", n_tokens(F.col(text_col)))
    cells = cut(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    if (n := cells.count()) > MOST_CELLS:
        raise ValueError(f"{n} cells of {', '.join(dims)}; {MOST_CELLS} are the most")
    total = F.sum(F.col("tokens").cast("double")).over(Window.partitionBy(F.lit(1)))
    rate = F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(1.0)
    rates = rake(cells, targets).withColumn("rate", rate)
    if whole:
        rates = fill(rates, budget)
    else:
        rates = rates.withColumn("rate", F.least(F.col("rate") * budget, F.lit(float(max_copies))))
    rates = cut(rates.select(*(F.col(d).alias(f"_cell_{d}") for d in dims), "rate"))
    on = None
    for d in dims:
        same = F.col(d).eqNullSafe(F.col(f"_cell_{d}"))
        on = same if on is None else on & same
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = rows.drop("rate", "copies").join(rates, on)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return out.withColumn("copies", copies).drop(*(f"_cell_{d}" for d in dims))
