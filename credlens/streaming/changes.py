"""Change points of a stream as they happen: CUSUM and Page-Hinkley with state kept for each series.

A series' state is five numbers and the time of its last value, whatever it has seen, so that a stream may run for ever. The
level and spread that deviations are measured by come from a table (say, of last month's values); with those of a whole batch, a
stream in order gives the same statistics as the batch operator.

Values are worked on in the order of time within each micro-batch (ties by value). A value that comes with a time before the
last one of its series that was worked on is late: it is told as late, without statistics, and changes nothing. Values without
a time, and missing values, are left out. A series that has no value for `forget` (event time, by the watermark) loses its state and
begins anew. Series that the table of levels doesn't have are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changepoint import DELTA

ROWS = "series string, time timestamp, i long, x double, cusum double, ph_stat double, late boolean, alarm boolean"
#: Values so far, their sum, CUSUM, Page-Hinkley sum and its minimum, and the last time (microseconds since 1970).
STATE = "n long, total double, cusum double, ph double, low double, last long"
BEGUN = (0, 0.0, 0.0, 0.0, 0.0, -(1 << 62))


def levels(df: DataFrame, series: str, value: str) -> DataFrame:
    """series, mean and spread (population standard deviation; 10^-9 at least) of what is known before the stream."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull()).groupBy(F.col(series).cast("string").alias("series")).agg(F.avg(x).alias("mean"), F.greatest(F.stddev_pop(x), F.lit(1e-9)).alias("spread"))


def changes(stream: DataFrame, series: str, time: str, value: str, known: DataFrame, *, alarm: float = 30.0, lateness: str = "1 hour", forget: str = "30 days") -> DataFrame:
    """ROWS: a row for each value of a stream. alarm: Page-Hinkley statistics, in spreads, from which a value is told as one."""
    wait_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["time", "x"], kind="stable")  # a series' values of one micro-batch
        at = rows["time"].astype("datetime64[us]").astype("int64").to_numpy()
        x, mean, spread = rows["x"].to_numpy(), rows["mean"].to_numpy(), rows["spread"].to_numpy()
        n, total, cusum, ph, low, last = state.get if state.exists else BEGUN
        on_time = at >= last
        k = on_time.sum()
        i = n + np.arange(k)
        y, m, s = x[on_time], mean[on_time], spread[on_time]
        totals, cusums = total + np.cumsum(y), cusum + np.cumsum(y - m)
        phs = ph + np.cumsum(y - totals / (i + 1) - DELTA * s)
        lows = np.minimum(np.minimum.accumulate(phs), low)
        out = pd.DataFrame({"series": key[0], "time": rows["time"], "i": pd.array([None] * len(rows), "Int64"), "x": x, "cusum": np.nan, "ph_stat": np.nan, "late": ~on_time, "alarm": False}).reset_index(drop=True)
        place = np.flatnonzero(on_time)  # the others keep nulls
        out.loc[place, "i"] = i
        out.loc[place, "cusum"] = cusums
        out.loc[place, "ph_stat"] = phs - np.minimum(lows, 0.0)
        out.loc[place, "alarm"] = phs - np.minimum(lows, 0.0) > alarm * s
        if k:
            last = int(at[on_time][-1])
            state.update((int(n + k), float(totals[-1]), float(cusums[-1]), float(phs[-1]), float(lows[-1]), last))
        if state.exists:
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + wait_ms)
        yield out

    rows = stream.select(F.col(series).cast("string").alias("series"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("x"))
    rows = rows.where("series is not null and time is not null and x is not null").withWatermark("time", lateness)
    rows = rows.join(known.select("series", "mean", "spread"), "series")  # the stream with a table; Spark broadcasts a small one
    return rows.groupBy("series").applyInPandasWithState(step, ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
