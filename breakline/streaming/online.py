"""Change points of growing series: a stateful stream that keeps each series' rows since its last change point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.costs import Moment
from ..functions.partition import partition


def online_mean(stream: DataFrame, series: str, time: str, value: str, beta: float, window: int = 500, confirm: int = 20) -> DataFrame:
    """(series, position, level): a change in the mean once ``confirm`` rows after it are in.

    The state of a series is at most ``window`` values and two counters, however long it runs. Rows of a micro-batch are
    taken in order of ``time``; later micro-batches are later rows.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, [])
        new = pd.concat(list(batches)).sort_values(time)[value].astype(float).tolist()
        out = []
        kept = list(kept) + new
        seen += len(new)
        while len(kept) > 2 * confirm:
            part = kept[:window]
            cps = [c for c in partition(len(part), beta, Moment(np.array(part)[:, None], "mean"), known=True) if confirm <= c <= len(part) - confirm]
            if cps:
                out.append((key[0], seen - len(kept) + cps[0], float(np.mean(kept[: cps[0]]))))
                kept = kept[cps[0] :]
            elif len(kept) > window:
                kept = kept[window // 2 :]
            else:
                break
        state.update((seen, kept))
        yield pd.DataFrame(out, columns=[series, "position", "level"])

    kind = stream.schema[series].dataType.simpleString()
    return stream.select(series, time, value).groupBy(series).applyInPandasWithState(update, f"`{series}` {kind}, position long, level double", "seen long, kept array<double>", "append", GroupStateTimeout.NoTimeout)
