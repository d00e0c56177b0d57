"""Change logs that grow: micro-batches judged by the batch operators, small tables carried over.

A stream has file, signal, time, seq and value; seq is the order within a file, and
a row without a signal is a step without changes. Each micro-batch is one more piece
of the same logs, however the rows were cut into pieces. Four rules hold over the
whole stream, as they do in a batch query over all rows:

* a step before the latest accepted time of its file is late and dropped with its
  changes, whatever their signals; one at the latest time follows the step before it;
* a time is told once, when time has moved on, with the last value of each signal
  that changed and the number of its changes;
* a change to the value that a signal has already is none, unless it is an event;
* signals derived from bits of others follow the changes of a time, and change only
  where their value does.

Nothing of this is keyed state of a Python worker: a batch is sorted and grouped by
the same operators as a table, so that a file or a signal with most of the rows is
cut into ranges where these cut it. Carried over are the clock (a row for each file:
its latest time, and whether its last step was accepted), the changes of the time
that is still open, and the last value of each signal, of which a batch writes only
those that it changes; every MERGE batches these are merged.

A batch overwrites its own tables if it is run again, and reads those of the batch
before it, so results are exact after failures.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.operators.changelog import ChangeLog, accepted, beside, placed
from tracetide.operators.derived import evaluate_all
from tracetide.storage import exists, materialize, names

#: Batches after which the tables of last values are merged into one.
MERGE = 8
#: Rows of earlier batches sort before those of this one at the same time.
BEFORE, NOW = 0, 1


class LiveLog:
    """The results of a stream in a folder that driver and executors share.

    derived: (file, signal, pos, input, msb, lsb) as rows, the most significant part of a signal at pos 0. Without a
    column file all is one file. events: signals of which every change counts. raw: keep the changes that are not late
    too, repeated values included.
    """

    def __init__(self, stream: DataFrame, folder: str, derived: DataFrame | None = None, events: list | None = None, raw: bool = False):
        self.spark: SparkSession = stream.sparkSession
        self.folder, self.events, self.raw = folder.rstrip("/"), events, raw
        named = "file" in stream.columns
        stream = stream if named else stream.withColumn("file", F.lit(""))
        self.stream = stream.select("file", "signal", "time", "seq", F.col("value").cast("string").alias("value"))
        self.derived = None if derived is None else materialize(derived if named else derived.withColumn("file", F.lit("")), "definitions")
        kinds = {c: self.stream.schema[c].dataType.simpleString() for c in ("file", "signal", "time", "seq")}
        order = f"struct<kind:int,epoch:bigint,seq:{kinds['seq']}>"
        self.schemas = {
            "changes": f"file {kinds['file']}, signal {kinds['signal']}, time {kinds['time']}, seq {kinds['seq']}, value string",
            "clock": f"file {kinds['file']}, latest {kinds['time']}, accepted boolean",
            "open": f"file {kinds['file']}, signal {kinds['signal']}, time {kinds['time']}, seq {order}, value string",
            "last": f"file {kinds['file']}, signal {kinds['signal']}, time {kinds['time']}, value string",
            "steps": f"file {kinds['file']}, time {kinds['time']}, signal {kinds['signal']}, value string, transitions bigint",
        }

    # Tables of a batch

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, batch))
        return self._read(name, [batch])

    def _read(self, name: str, batches: list[int]) -> DataFrame:
        found = [b for b in batches if exists(self.spark, self._path(name, b))]
        if not found:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[self._path(name, b) for b in found])

    def _last(self, batch: int) -> DataFrame:
        """(file, signal, time, value): the values after a batch, from the last merge and what changed since."""
        merged = batch - (batch + 1) % MERGE
        values = self._read("last", list(range(max(merged, 0), batch + 1)))
        return values.groupBy("file", "signal").agg(F.max("time").alias("time"), F.max_by("value", "time").alias("value"))

    # One batch

    def take(self, rows: DataFrame, batch: int, callback: Callable[[DataFrame, DataFrame, int], None] | None = None) -> None:
        """Judge the next piece of the stream. Batches are numbered from 0 without a gap; one that is taken again replaces itself."""
        order = F.struct(F.lit(NOW).alias("kind"), F.lit(batch).cast("bigint").alias("epoch"), F.col("seq").alias("seq"))
        new = materialize(rows.select("file", "signal", "time", order.alias("seq"), "value"), "arrived")
        clock = self._read("clock", [batch - 1])
        # the latest time of a file is never late, so that it is known before its steps are judged
        latest = new.select("file", "time").unionByName(clock.select("file", F.col("latest").alias("time"))).groupBy("file").agg(F.max("time").alias("latest"))
        steps = in_order(new, clock)
        kept = materialize(beside(on_time(steps), latest, ["file"]), "on-time")
        clock = self._write(moved_clock(clock, steps, kept), "clock", batch)
        kept = kept.drop("__at")
        if self.raw:
            self._write(kept.filter(F.col("signal").isNotNull()).withColumn("seq", F.col("seq.seq")).drop("latest"), "changes", batch)
        still_open = beside(self._read("open", [batch - 1]), clock.select("file", "latest"), ["file"])
        arrivals = kept.filter(F.col("signal").isNotNull()).unionByName(still_open)
        self._write(arrivals.filter(F.col("time") == F.col("latest")).drop("latest"), "open", batch)
        steps = self._write(self._steps(arrivals.filter(F.col("time") < F.col("latest")).drop("latest"), batch - 1), "steps", batch)
        changed = steps.groupBy("file", "signal").agg(F.max("time").alias("time"), F.max_by("value", "time").alias("value"))
        if (batch + 1) % MERGE == 0:
            both = self._last(batch - 1).unionByName(changed)
            changed = both.groupBy("file", "signal").agg(F.max("time").alias("time"), F.max_by("value", "time").alias("value"))
        self._write(changed, "last", batch)
        if callback is not None:
            callback(steps, self._last(batch), batch)

    def _steps(self, closed: DataFrame, before: int) -> DataFrame:
        """(file, time, signal, value, transitions) of times that are over, derived signals among them."""
        key = F.struct("file", F.col("signal").alias("id"))
        last = materialize(self._last(before), "last-values")
        touched = closed.select("file", "signal").distinct()
        known = self._seam(among(last, touched, ["file", "signal"]), closed)
        log = ChangeLog(closed.unionByName(known).withColumn("signal", key))
        real = log.dedup(None if not self.events else F.col("signal.id").isin(self.events))
        real = real.df.filter(F.col("seq.kind") == NOW).select("signal.file", F.col("signal.id").alias("signal"), "time", "seq", "value")
        steps = real.groupBy("file", "time", "signal").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("transitions"))
        if self.derived is None:
            return steps
        steps = materialize(steps, "real-steps")
        return steps.unionByName(self._derived_steps(steps, last))

    def _derived_steps(self, steps: DataFrame, last: DataFrame) -> DataFrame:
        """The derived signals of which an input changed; what these were before follows from the inputs' last values."""
        key = F.struct("file", F.col("signal").alias("id")).alias("signal")
        parts = self.derived.select(key, "pos", F.struct("file", F.col("input").alias("id")).alias("input"), "msb", "lsb")
        changed = steps.select(key, "time", F.lit(0).alias("seq"), "value")
        moved = parts.join(changed.select(F.col("signal").alias("input")).distinct(), "input", "left_semi").select("signal").distinct()
        parts = materialize(parts.join(moved, "signal", "left_semi"), "moved-parts")
        inputs = parts.select(F.col("input").alias("signal")).distinct()
        both = changed.unionByName(last.select(key, "time", F.lit(0).alias("seq"), "value")).join(inputs, "signal", "left_semi")
        told = evaluate_all(ChangeLog(both), parts).select("signal.file", "time", F.col("signal.id").alias("signal"), "value", F.lit(1).cast("bigint").alias("transitions"))
        began = steps.groupBy("file").agg(F.min("time").alias("began"))  # all last values are older
        return beside(told, began, ["file"]).filter(F.col("time") >= F.col("began")).drop("began")

    def _seam(self, last: DataFrame, like: DataFrame) -> DataFrame:
        """Last values as changes before all others."""
        seq = F.struct(F.lit(BEFORE).alias("kind"), F.lit(0).cast("bigint").alias("epoch"), F.lit(None).cast(like.schema["seq"].dataType["seq"].dataType).alias("seq"))
        return last.select("file", "signal", "time", seq.alias("seq"), "value")

    # Running and reading

    def start(self, callback: Callable[[DataFrame, DataFrame, int], None] | None = None, **trigger):
        """The running query. callback(steps, values, batch): the steps that a batch closes and all values after it; an exception ends the stream."""
        taken = self.stream.writeStream.foreachBatch(lambda df, n: self.take(df, n, callback)).option("checkpointLocation", f"{self.folder}/checkpoint")
        return taken.trigger(**(trigger or {"availableNow": True})).start()

    def run(self, callback: Callable[[DataFrame, DataFrame, int], None] | None = None) -> LiveLog:
        """Take what there is, and return."""
        self.start(callback).awaitTermination()
        return self

    def batches(self) -> int:
        """How many batches are complete. The table of last values is a batch's last one; Spark marks a whole table."""
        taken = sorted(int(n.removeprefix("batch=")) for n in names(self.spark, f"{self.folder}/last"))
        return next((n + 1 for n in reversed(taken) if exists(self.spark, f"{self._path('last', n)}/_SUCCESS")), 0)

    def _told(self, name: str, n: int) -> DataFrame:
        if not n:
            return self.spark.createDataFrame([], self.schemas[name])
        told = self.spark.read.schema(f"{self.schemas[name]}, batch int").parquet(f"{self.folder}/{name}")
        return told.filter(F.col("batch") < n).drop("batch")

    def changes(self) -> DataFrame:
        """(file, signal, time, seq, value): all changes that are not late; with raw alone."""
        return self._told("changes", self.batches())

    def steps(self, open_too: bool = True) -> DataFrame:
        """(file, time, signal, value, transitions) so far; open_too: as if the stream ended here, the last time included."""
        n = self.batches()
        told = self._told("steps", n)
        return told.unionByName(self._steps(self._read("open", [n - 1]), n - 1)) if open_too else told

    def values(self, open_too: bool = True) -> DataFrame:
        """(file, signal, time, value): a snapshot of all signals."""
        n = self.batches()
        last = self._last(n - 1)
        if not open_too:
            return last
        both = last.unionByName(self._steps(self._read("open", [n - 1]), n - 1).select("file", "signal", "time", "value"))
        return both.groupBy("file", "signal").agg(F.max("time").alias("time"), F.max_by("value", "time").alias("value"))


def among(values: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows of values whose columns `by` are among the keys, nulls included."""
    found = keys.select(*[F.col(c).alias(f"__{c}") for c in by])
    same = reduce(and_, [values[c].eqNullSafe(found[f"__{c}"]) for c in by])
    return values.join(found, same, "left_semi")


def in_order(new: DataFrame, clock: DataFrame) -> DataFrame:
    """The new rows with their places. What was before stands for itself as one step, or as two if the last was late."""

    def step(time: Column, at: int) -> DataFrame:
        nothing = [F.lit(None).cast(new.schema[c].dataType).alias(c) for c in ("signal", "value")]
        seq = F.struct(F.lit(BEFORE).alias("kind"), F.lit(at).cast("bigint").alias("epoch"), F.lit(None).cast(new.schema["seq"].dataType["seq"].dataType).alias("seq"))
        return clock.select("file", "accepted", nothing[0], time.alias("time"), seq.alias("seq"), nothing[1])

    before = step(F.col("latest"), 0).unionByName(step(F.col("latest") - 1, 1).filter("not accepted")).drop("accepted")
    return placed(new.unionByName(before), within=["file"])


def on_time(steps: DataFrame) -> DataFrame:
    """The new rows of steps that are not late, with their places."""
    return accepted(steps, within=["file"]).filter(F.col("seq.kind") == NOW).drop("__part")


def moved_clock(clock: DataFrame, steps: DataFrame, kept: DataFrame) -> DataFrame:
    """The clock after a batch; the last step was accepted if its row is among those kept. Places are told apart, which needs no sort of all rows."""
    new = steps.filter(F.col("seq.kind") == NOW)
    none = F.lit(None)
    order, time = new.schema["__at"].dataType, new.schema["time"].dataType
    rows = clock.select("file", "latest", "accepted", none.cast(order).alias("end"), none.cast(order).alias("kept"))
    rows = rows.unionByName(new.select("file", none.cast(time).alias("latest"), none.cast("boolean").alias("accepted"), F.col("__at").alias("end"), none.cast(order).alias("kept")))
    rows = rows.unionByName(kept.select("file", F.col("time").alias("latest"), none.cast("boolean").alias("accepted"), none.cast(order).alias("end"), F.col("__at").alias("kept")))
    ends = rows.groupBy("file").agg(F.max("latest").alias("latest"), F.max("accepted").alias("accepted"), F.max("end").alias("end"), F.max("kept").alias("kept"))
    return ends.select("file", "latest", F.when(F.col("end").isNull(), F.col("accepted")).otherwise(F.col("end").eqNullSafe(F.col("kept"))).alias("accepted"))
