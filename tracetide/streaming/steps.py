"""Change logs as Structured Streaming: real changes, time steps and late steps.

A stream has signal, time, seq and value (a string). State is kept per signal, so
that keys spread over the cluster; within a micro-batch a signal's changes are
taken in (time, seq) order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "signal {signal}, time bigint, seq bigint, value string"


def select_changes(stream: DataFrame, start=None, end=None, signals: list | None = None) -> DataFrame:
    """Raw changes, repeated values included, of a range of times (both ends included) and of some signals."""
    if start is not None:
        stream = stream.filter(F.col("time") >= start)
    if end is not None:
        stream = stream.filter(F.col("time") <= end)
    return stream if signals is None else stream.filter(F.col("signal").isin(signals) if signals else F.lit(False))


def real_changes(stream: DataFrame, late: str = "drop") -> DataFrame:
    """Changes to another value than the signal's last one.

    late: what happens to a change before the latest time of its signal, "drop" or "keep".
    """
    kind = stream.schema["signal"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, latest, has = state.get if state.exists else (None, None, False)
        rows = pd.concat(list(frames)).sort_values(["time", "seq"], kind="stable")
        if late == "drop" and latest is not None:
            rows = rows[rows["time"] >= latest]
        if len(rows):
            v = rows["value"].astype(object).where(rows["value"].notna(), None)
            before = v.shift(1)
            before.iloc[0] = value
            keep = ~((v == before) | (v.isna() & before.isna()))
            keep.iloc[0] = bool(keep.iloc[0]) or not has
            top = int(rows["time"].iloc[-1])
            state.update((v.iloc[-1], top if latest is None else max(top, latest), True))
            yield rows[keep][["signal", "time", "seq", "value"]]

    ordered = stream.select("signal", "time", "seq", "value")
    return ordered.groupBy("signal").applyInPandasWithState(step, CHANGES.format(signal=kind), "value string, time bigint, has boolean", "append", GroupStateTimeout.NoTimeout)


def steps_of(batch: DataFrame) -> DataFrame:
    """(time, signal, value, transitions) of a batch of real changes."""
    return batch.groupBy("time", "signal").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("transitions"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what there is, into a Parquet table, exactly once; the table so far."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def for_each_step(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls back with the time steps of each micro-batch; an exception ends the stream."""
    return stream.writeStream.foreachBatch(lambda df, n: callback(steps_of(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
