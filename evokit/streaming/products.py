"""Mergeable products as arbitrary state of a stream: sums of x, y and of their products by key, held while a key is alive.

A key's sums are state that each batch adds to and emits as they are then. A timer on event time ends a key that has had no row for ``alive``: its last sums are
emitted as final and the state is let go. Rows behind the watermark don't reach the state; ``late_rows`` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def running_products(events: DataFrame, time: str, key: str, x: str, y: str, late: str, alive_ms: int) -> DataFrame:
    """(key, n, sx, sy, sxx, sxy, syy, last_ms, final) in update mode. Rows with a null key, time, x or y take no part; a key that comes again after its end starts anew."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(time, late).where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(F.col(key), F.col(time), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    state_schema = "n double, sx double, sy double, sxx double, sxy double, syy double, last_ms long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, last = (np.array(state.get[:6], float), int(state.get[6])) if state.exists else (np.zeros(6), 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([[k[0], *sums, last, True]], columns=[key, *SUMS, "last_ms", "final"])
            return
        for g in batches:
            a, b = g["x"].to_numpy(float), g["y"].to_numpy(float)
            sums += [len(g), a.sum(), b.sum(), a @ a, a @ b, b @ b]
            last = max(last, int(g[time].max().timestamp() * 1000))
        state.update((*map(float, sums), last))
        state.setTimeoutTimestamp(max(last + alive_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[k[0], *sums, last, False]], columns=[key, *SUMS, "last_ms", "final"])

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n double, sx double, sy double, sxx double, sxy double, syy double, last_ms long, final boolean", state_schema, "update", GroupStateTimeout.EventTimeTimeout)


def late_rows(progress: list) -> int:
    """Rows that state operators have dropped as behind the watermark, from a query's ``recentProgress``."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
