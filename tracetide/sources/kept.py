"""Change logs kept in buckets of signals and appended to without reading old rows.

A folder holds the changes as one bucketed Parquet table, and for each append a row of
the clock (latest time, whether the last step was accepted, how many times there are),
the times that it added, and the last values of the signals that it changed. An append
judges its rows by these alone: steps before the latest time are late, a change to the
value that a signal has is none, and times are numbered on. However a log was cut into
appends, it holds the same rows as if it had been written at once.

Rows carry the number of the append that wrote them, drawn at random, and count only
once its last table is complete; an append that fails leaves rows that no one reads.
One writer at a time.

Windows over signals need no exchange, a list of signals prunes buckets and row groups,
and as-of lookups shuffle only the probes.

Null signals are steps without changes, null times no steps and dropped; repeated rows are
repeated values, and so none, unless of an event; an empty append adds nothing.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.operators.changelog import ChangeLog, numbered
from tracetide.storage import exists, materialize, names
from tracetide.streaming.live import BEFORE, MERGE, NOW, among, in_order, moved_clock, on_time

COLUMNS = ("signal", "time", "seq", "value")


class KeptLog:
    """A log in a folder that create() made. events: signals of which every change counts."""

    def __init__(self, spark: SparkSession, path: str, events: list | None = None):
        self.spark, self.path, self.events = spark, path.rstrip("/"), events
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.buckets, self.kinds = meta.buckets, dict(zip(COLUMNS, meta.kinds, strict=True))
        self.name = "kept_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        columns = ", ".join(f"`{c}` {k}" for c, k in self.kinds.items())
        where = self.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, append BIGINT) USING parquet CLUSTERED BY (signal) SORTED BY (signal, time) INTO {self.buckets} BUCKETS LOCATION '{where}/changes'")
        spark.catalog.refreshTable(self.name)  # another session may have appended

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: DataFrame, buckets: int = 64, events: list | None = None) -> KeptLog:
        """An empty log for rows with the types of like. buckets is fixed: choose it by the size that the log will reach."""
        kinds = [like.schema[c].dataType.simpleString() for c in COLUMNS]
        spark.createDataFrame([(buckets, kinds)], "buckets int, kinds array<string>").write.parquet(f"{path.rstrip('/')}/meta")
        return cls(spark, path, events)

    # Tables of an append

    def _path(self, name: str, n: int) -> str:
        return f"{self.path}/{name}/n={n}"

    def _schema(self, name: str) -> str:
        time = self.kinds["time"]
        return {
            "clock": f"file string, latest {time}, accepted boolean, n_times bigint, append bigint",
            "times": f"time_idx bigint, time {time}",
            "last": f"signal {self.kinds['signal']}, time {time}, seq {self.kinds['seq']}, value {self.kinds['value']}",
        }[name]

    def _write(self, df: DataFrame, name: str, n: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, n))
        return self._read(name, [n])

    def _read(self, name: str, of: list[int]) -> DataFrame:
        if not of or of == [-1]:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*[self._path(name, n) for n in of])

    def appends(self) -> int:
        """How many appends are complete; last values are written last."""
        begun = sorted((int(x.removeprefix("n=")) for x in names(self.spark, f"{self.path}/last")), reverse=True)
        return next((n + 1 for n in begun if exists(self.spark, f"{self._path('last', n)}/_SUCCESS")), 0)

    def last(self) -> DataFrame:
        """(signal, time, seq, value): the last change of each signal."""
        return self._last(self.appends())

    def _last(self, n: int) -> DataFrame:
        """From the last merge on: each of every MERGE tables holds all signals, the others those that changed."""
        return _latest(self._read("last", list(range(n - n % MERGE - 1 if n >= MERGE else 0, n))))

    # Appending

    def append(self, rows: DataFrame) -> int:
        """Take rows (signal, time, seq, value), which follow all earlier ones in seq; returns the number of appends."""
        n = self.appends()
        order = F.struct(F.lit(NOW).alias("kind"), F.lit(n).cast("bigint").alias("epoch"), F.col("seq").alias("seq"))
        typed = rows.select(*[F.col(c).cast(k).alias(c) for c, k in self.kinds.items()]).filter(F.col("time").isNotNull())
        new = materialize(typed.select(F.lit("").alias("file"), "signal", "time", order.alias("seq"), "value"), "arrived")
        clock = self._read("clock", [n - 1])
        before = clock.first()
        steps = in_order(new, clock.select("file", "latest", "accepted"))
        kept = materialize(on_time(steps), "on-time")

        times = kept.select("time").distinct()
        if before is not None and before.latest is not None:
            times = times.filter(F.col("time") > F.lit(before.latest).cast(self.kinds["time"]))
        counted = before.n_times if before is not None else 0
        times = self._write(numbered(times, "time", "at").select((F.col("at") + counted).alias("time_idx"), "time"), "times", n)

        attempt = secrets.randbits(62)
        real = materialize(self._real(kept.filter(F.col("signal").isNotNull()).drop("file", "__at"), n), "real")
        real.withColumn("append", F.lit(attempt)).repartitionByRange("signal", "time").write.insertInto(self.name)

        moved = moved_clock(clock.select("file", "latest", "accepted"), steps, kept)
        self._write(moved.select("*", F.lit(counted + times.count()).alias("n_times"), F.lit(attempt).alias("append")) if not new.isEmpty() or before is not None else self.spark.createDataFrame([("", None, None, 0, attempt)], self._schema("clock")), "clock", n)
        changed = _latest(real)
        self._write(_latest(self._last(n).unionByName(changed)) if (n + 1) % MERGE == 0 else changed, "last", n)
        return n + 1

    def _real(self, changes: DataFrame, n: int) -> DataFrame:
        """Changes to another value than the signal has; what it has comes from the last values."""
        touched = changes.select("signal").distinct()
        epoch = F.lit(0).cast("bigint").alias("epoch")
        known = among(self._last(n), touched, ["signal"]).select("signal", "time", F.struct(F.lit(BEFORE).alias("kind"), epoch, "seq").alias("seq"), "value")
        log = ChangeLog(changes.unionByName(known)).dedup(F.col("signal").isin(self.events) if self.events else None)
        return log.df.filter(F.col("seq.kind") == NOW).select("signal", "time", F.col("seq.seq").alias("seq"), "value")

    # Reading

    def changes(self, signals: list | None = None, start=None, end=None) -> DataFrame:
        """(signal, time, seq, value); conditions reach the scan, and a list of signals names the buckets that are read."""
        written = [r.append for r in self._read("clock", list(range(self.appends()))).select("append").collect()]  # a row for each append
        df = self.spark.table(self.name).filter(F.col("append").isin(written)).drop("append")
        if signals is not None:
            df = df.filter(F.col("signal").isin(signals))
        if start is not None:
            df = df.filter(F.col("time") >= start)
        return df if end is None else df.filter(F.col("time") <= end)

    def log(self, signals: list | None = None, start=None, end=None) -> ChangeLog:
        return ChangeLog(self.changes(signals, start, end))

    def value_at(self, probes: DataFrame) -> DataFrame:
        """As ChangeLog.value_at; probes (signal, time, ...) go to the buckets, changes stay where they are."""
        to = probes.withColumn("signal", F.col("signal").cast(self.kinds["signal"])).repartition(self.buckets, "signal")
        return self.log().value_at(to)

    def time_table(self) -> DataFrame:
        """(time_idx, time) of all steps, with or without a change."""
        return self._read("times", list(range(self.appends())))


def _latest(rows: DataFrame) -> DataFrame:
    at = F.struct("time", "seq")
    return rows.groupBy("signal").agg(F.max("time").alias("time"), F.max_by("seq", at).alias("seq"), F.max_by("value", at).alias("value"))
