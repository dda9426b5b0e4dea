"""The same statistics over streams: recency ranks with a bounded list as the state of each stream, and symbol counts.

The rows of a micro-batch are taken in the order of a column; a row that comes in a later batch counts as later, however it is
stamped. State is a list of at most ``limit`` symbols per stream, kept in the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from arborlens.operators.recency import DEFAULT_WINDOW, MAX_WINDOW


def stream_ranks(df: DataFrame, stream: str, order: str, symbol: str, limit: int = DEFAULT_WINDOW) -> DataFrame:
    """(stream, order, symbol, rank) of a streaming DataFrame: the number of distinct symbols since the symbol's last occurrence,
    -1 from ``limit`` on and at first. Null symbols are symbols of their own; null streams are one stream."""
    if not 1 <= limit <= MAX_WINDOW:
        raise ValueError(f"window size must be 1..{MAX_WINDOW}")
    kinds = dict(df.dtypes)

    def run(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        front = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        ranks = []
        for value in rows[symbol].astype(object).where(rows[symbol].notna(), None):
            value = None if value is None else str(value)
            at = front.index(value) if value in front else -1
            ranks.append(at)
            if at >= 0:
                del front[at]
            front.insert(0, value)
            del front[limit:]
        state.update((json.dumps(front),))
        rows["rank"] = ranks
        yield rows[[stream, order, symbol, "rank"]]

    shape = f"{stream} {kinds[stream]}, {order} {kinds[order]}, {symbol} {kinds[symbol]}, rank int"
    return df.select(stream, order, symbol).groupBy(stream).applyInPandasWithState(run, shape, "front string", "append", GroupStateTimeout.NoTimeout)


def stream_counts(df: DataFrame, keys: list[str], time: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Hits per key, or per key and event-time window where ``time`` is given: then windows close once the watermark, ``late`` behind
    the newest row, has passed them."""
    if time is None:
        return df.groupBy(*keys).agg(F.count("*").alias("hits"))
    return df.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *keys).agg(F.count("*").alias("hits"))
