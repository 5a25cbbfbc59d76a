"""Structured Streaming variants (extensions: the reference has no stream processing).

Late rows: a watermark bounds the state; rows later than it are dropped by Spark from windowed counts, never from the
batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows (window_start, kind, n) of a stream, complete once the watermark has passed."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n")


def stream_openings(events: DataFrame, key: str, order: str, kind: str, opens: tuple[str, ...]) -> DataFrame:
    """Rows (key, order, kind, component): the running number of openings of each key, kept as state of one integer."""
    types = {c: events.schema[c].dataType.simpleString() for c in (key, order, kind)}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        component = rows[kind].isin(opens).cumsum() + at
        state.update((int(component.iloc[-1]),))
        yield rows[[key, order, kind]].assign(component=component.astype("int32"))

    out = f"{key} {types[key]}, {order} {types[order]}, {kind} {types[kind]}, component int"
    return events.select(key, order, kind).groupBy(key).applyInPandasWithState(step, out, "at int", "append", GroupStateTimeout.NoTimeout)


def deliver_once(batch: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not in the ledger yet: what foreachBatch applies, so a repeated batch is a no-op."""
    return batch.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")
