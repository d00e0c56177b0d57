"""Time-ordered change logs: (signal, time, seq, value) in any DataFrame.

Most operators are one window over (signal; time, seq), so that a chain of them
shares one exchange and sort. A signal that holds a large share of all rows would
put them into one task. So the rows of each signal are counted first, unless the
table is small, and signals with more than HOT_ROWS are cut at quantiles of their
own times; the operators work within (signal, slice), and carry the last value of
earlier slices over by a small table with a row for each signal and slice. With
`slices` all signals are cut at that many quantiles of all times, uncounted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracetide.storage import materialize


#: Rows of one signal that a task may sort; a signal with more is cut.
HOT_ROWS = 1 << 19
#: By Catalyst's estimate smaller tables are not counted: none of their signals can be that hot.
COUNTED_BYTES = 256 << 20
#: Bytes by Catalyst's estimate, mostly of packed Parquet, that one range of an order may hold.
RANGE_BYTES = 8 << 20
#: Estimates from here on are none.
UNKNOWN_BYTES = 1 << 50


def _ranked(df: DataFrame, slot: Column | None = None):
    keys = ["signal"] if slot is None else ["signal", slot]
    return Window.partitionBy(*keys).orderBy("time", "seq")


class ChangeLog:
    """Columns are renamed to signal, time, seq and value; seq orders changes of one signal at one time and may be a struct."""

    def __init__(self, df: DataFrame, signal: str = "signal", time: str = "time", seq: str = "seq", value: str = "value", slices: int | None = None):
        self.df = df.select(F.col(signal).alias("signal"), F.col(time).alias("time"), F.col(seq).alias("seq"), F.col(value).alias("value"))
        self.slices = slices
        self._found: dict[int, tuple[DataFrame, DataFrame | None]] = {}

    def _with(self, df: DataFrame) -> ChangeLog:
        out = object.__new__(ChangeLog)
        out.df, out.slices, out._found = df.select("signal", "time", "seq", "value"), self.slices, {}
        return out

    def like(self, df: DataFrame) -> ChangeLog:
        """Another log that is cut into slices as this one is."""
        return ChangeLog(df, slices=self.slices)

    # Slices

    def hot(self, df: DataFrame | None = None) -> DataFrame | None:
        """(hot_signal, bounds): the signals with over HOT_ROWS rows in df (default: the log) and the times that cut them; None if there are none."""
        df = self.df if df is None else df
        if id(df) not in self._found:  # counted once for a table
            self._found[id(df)] = df, self._hot(df)
        return self._found[id(df)][1]

    def _hot(self, df: DataFrame) -> DataFrame | None:
        if estimated_bytes(df) < COUNTED_BYTES:
            return None
        large = materialize(df.groupBy("signal").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS), "hot-signals")
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            return None
        parts = -(-most // HOT_ROWS)
        named = F.broadcast(large.select(F.col("signal").alias("hot_signal")))  # a row for each HOT_ROWS rows at most
        own = df.join(named, df["signal"].eqNullSafe(F.col("hot_signal")))
        at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        return materialize(own.groupBy("hot_signal").agg(F.array_distinct(F.percentile_approx("time", at, 10_000)).alias("bounds")), "cuts")

    def cut(self, df: DataFrame | None = None) -> bool:
        """Whether rows are cut into slices: as asked for, or because a signal needs it."""
        return self.hot(df) is not None if self.slices is None else self.slices > 1

    def slot_of(self, df: DataFrame) -> Column:
        """The slice of a time among all times: the number of boundaries at or below it."""
        if self.slices is None or self.slices <= 1:
            return F.lit(0)
        parts = [i / self.slices for i in range(1, self.slices)]
        bounds = sorted({b for b in df.agg(F.percentile_approx("time", F.array(*map(F.lit, parts)), 10_000)).first()[0] or []})
        return reduce(lambda a, b: a + (F.col("time") >= F.lit(b)).cast("int"), bounds, F.lit(0))

    def slotted(self, df: DataFrame) -> DataFrame:
        """df with the slice of each row's time as slot. Slices of hot signals are dealt to four times as many tasks, so that few meet in one, however many there are."""
        if self.slices is not None:
            return df.withColumn("slot", self.slot_of(df))
        found = self.hot(df)
        if found is None:
            return df.withColumn("slot", F.lit(0))
        below = F.size(F.filter("bounds", lambda b: b <= F.col("time")))
        cut = df.join(F.broadcast(found), df["signal"].eqNullSafe(F.col("hot_signal")), "left").withColumn("slot", F.when(F.col("bounds").isNull(), 0).otherwise(below)).drop("hot_signal", "bounds")
        slots = found.agg(F.sum(F.size("bounds") + 1)).first()[0]
        return cut.repartition(max(shuffle_partitions(df), 4 * slots), "signal", "slot")

    def carry(self, df: DataFrame, entries: list[str], order: Column) -> DataFrame:
        """(signal, slot, before_<entry>, ...): of each entry the last one that is not null, in earlier slices of the signal. A row for each signal and slice."""
        ends = df.groupBy("signal", "slot").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in entries])
        earlier = Window.partitionBy("signal").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select("signal", "slot", *[F.last(c, ignorenulls=True).over(earlier).alias(f"before_{c}") for c in entries])

    def held(self, df: DataFrame, entries: list[str], order: list[str]) -> DataFrame:
        """df with each entry as of its row: the last one that is not null, in order, within the signal."""
        last = Window.unboundedPreceding, 0
        if not self.cut(df):
            w = Window.partitionBy("signal").orderBy(*order).rowsBetween(*last)
            return df.select(*[c for c in df.columns if c not in entries], *[F.last(c, ignorenulls=True).over(w).alias(c) for c in entries])
        df = self.slotted(df)
        w = Window.partitionBy("signal", "slot").orderBy(*order).rowsBetween(*last)
        kept = [c for c in df.columns if c not in (*entries, "slot")]
        within = df.select(*kept, "slot", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in entries])
        joined = beside(within, self.carry(df, entries, F.struct(*order)), ["signal", "slot"])
        return joined.select(*kept, *[F.coalesce(c, f"before_{c}").alias(c) for c in entries])

    # Filters

    def between(self, start=None, end=None) -> ChangeLog:
        """Both ends included; the condition reaches the scan."""
        df = self.df
        if start is not None:
            df = df.filter(F.col("time") >= start)
        return self._with(df if end is None else df.filter(F.col("time") <= end))

    def only(self, signals: DataFrame | list) -> ChangeLog:
        """Changes of the given signals: a list, or a DataFrame whose first column names them."""
        if isinstance(signals, list):
            return self._with(self.df.filter(F.col("signal").isin(signals)) if signals else self.df.limit(0))
        keys = signals.select(F.col(signals.columns[0]).alias("signal"))
        return self._with(self.df.join(keys, "signal", "left_semi"))

    def unknown(self, signals: DataFrame) -> ChangeLog:
        """Changes of signals that are not listed."""
        return self._with(self.df.join(signals.select(F.col(signals.columns[0]).alias("signal")), "signal", "left_anti"))

    def dedup(self, is_event: Column | None = None) -> ChangeLog:
        """Without changes to the value that the signal has already; events (where is_event) are always kept."""
        same = F.col("previous.value").eqNullSafe(F.col("value"))
        if dict(self.df.dtypes)["value"] in ("double", "float"):  # -0.0 and 0.0 are different values
            same &= F.col("previous.value").cast("string").eqNullSafe(F.col("value").cast("string"))
        same = F.col("previous").isNotNull() & same
        df = self.df.withColumn("entry", F.struct("value"))
        if self.cut():
            df = self.slotted(df)
            before = self.carry(df, ["entry"], F.struct("time", "seq"))
            df = beside(df.withColumn("lagged", F.lag("entry").over(_ranked(df, F.col("slot")))), before, ["signal", "slot"]).withColumn("previous", F.coalesce("lagged", "before_entry"))
        else:
            df = df.withColumn("previous", F.lag("entry").over(_ranked(df)))
        return self._with(df.filter(~same if is_event is None else is_event | ~same))

    # Times

    def times(self) -> DataFrame:
        return self.df.select("time").distinct()

    def time_table(self, steps: DataFrame | None = None) -> DataFrame:
        """(time_idx, time): the distinct times, numbered from 0. steps: times with or without a change.

        Ranges of times are sorted side by side, and each adds the sizes of those
        before it; no task sees all times.
        """
        times = self.times() if steps is None else steps.select("time").distinct()
        return numbered(times, "time", "time_idx").select("time_idx", "time")

    def span(self) -> DataFrame:
        return self.df.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.countDistinct("time").alias("n_times"), F.count("*").alias("n_changes"))

    def first_times(self) -> DataFrame:
        return self.df.groupBy("signal").agg(F.min("time").alias("first_time"))

    # Several changes at one time

    def steps(self) -> DataFrame:
        """(signal, time, value, elements): the last value at each time and the number of changes there."""
        return self.df.groupBy("signal", "time").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("elements"))

    def elements(self, k: int | None = None) -> DataFrame:
        """Changes numbered within their time; only the k-th, if given."""
        w = Window.partitionBy("signal", "time").orderBy("seq")
        df = self.df.withColumn("element", (F.row_number().over(w) - 1).cast("long"))
        return df if k is None else df.filter(F.col("element") == k)

    # As-of lookups

    def value_at(self, probes: DataFrame, keep_missing: bool = True) -> DataFrame:
        """probes (signal, time, ...) with found_time and value of the last change at or before their time.

        One shuffle and one sort: changes and probes are tagged, united, and the
        last change is carried forward.
        """
        extra = [c for c in probes.columns if c not in ("signal", "time")]
        change = self.df.select("signal", "time", F.lit(0).alias("side"), "seq", F.struct("time", "value").alias("entry"), F.lit(None).cast(probes.select(F.struct(F.lit(1).alias("one"), *extra)).schema[0].dataType).alias("probe"))
        probe = probes.select("signal", "time", F.lit(1).alias("side"), F.lit(None).cast(self.df.schema["seq"].dataType).alias("seq"), F.lit(None).cast(change.schema["entry"].dataType).alias("entry"), F.struct(F.lit(1).alias("one"), *extra).alias("probe"))
        both = change.unionByName(probe)
        out = self.held(both, ["entry"], ["time", "side", "seq"]).withColumnRenamed("entry", "found").filter("side = 1")
        if not keep_missing:
            out = out.filter(F.col("found").isNotNull())
        return out.select("signal", "time", *[F.col(f"probe.{c}").alias(c) for c in extra], F.col("found.time").alias("found_time"), F.col("found.value").alias("value"))

    def offsets(self, probes: DataFrame) -> DataFrame:
        """probes with start (time of the last change), elements there, whether it is the probe's own time, and the time of the next change."""
        steps = self.steps()
        if self.cut(steps):
            steps = self.slotted(steps)
            firsts = steps.groupBy("signal", "slot").agg(F.min("time").alias("time"))
            after = firsts.select("signal", "slot", F.lead("time").over(Window.partitionBy("signal").orderBy("slot")).alias("after"))
            w = Window.partitionBy("signal", "slot").orderBy("time")
            steps = beside(steps.withColumn("next_time", F.lead("time").over(w)), after, ["signal", "slot"]).withColumn("next_time", F.coalesce("next_time", "after"))
        else:
            steps = steps.withColumn("next_time", F.lead("time").over(Window.partitionBy("signal").orderBy("time")))
        entries = steps.select("signal", "time", F.lit(0).alias("seq"), F.struct("value", "elements", "next_time").alias("value"))
        found = ChangeLog(entries, slices=self.slices).value_at(probes)
        first = self.first_times()
        joined = found.join(first, "signal", "left")
        next_time = F.when(F.col("found_time").isNull(), F.col("first_time")).otherwise(F.col("value.next_time"))
        return joined.select(*probes.columns, F.col("found_time").alias("start_time"), F.col("value.value").alias("value"), F.col("value.elements").alias("elements"), (F.col("found_time") == F.col("time")).alias("time_match"), next_time.alias("next_time"))

    def snapshot(self, time) -> DataFrame:
        """(signal, value): the state of all signals at a time."""
        return self.df.filter(F.col("time") <= time).groupBy("signal").agg(F.max_by("value", F.struct("time", "seq")).alias("value"))

    # Positions

    def positions(self) -> DataFrame:
        """Changes with their index among the signal's, from 0, and from the end, from -1."""
        if not self.cut():
            n = F.count("*").over(Window.partitionBy("signal"))
            at = (F.row_number().over(_ranked(self.df)) - 1).cast("long")
            return self.df.withColumn("idx", at).withColumn("from_end", at - n)
        df = self.slotted(self.df)
        signal = Window.partitionBy("signal")
        so_far = F.sum("n").over(signal.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
        sizes = df.groupBy("signal", "slot").agg(F.count("*").alias("n")).select("signal", "slot", (so_far - F.col("n")).alias("lead"), F.sum("n").over(signal).alias("all"))
        at = (F.row_number().over(_ranked(df, F.col("slot"))) - 1).cast("long")
        return beside(df.withColumn("at", at), sizes, ["signal", "slot"]).select("signal", "time", "seq", "value", (F.col("lead") + F.col("at")).alias("idx"), (F.col("lead") + F.col("at") - F.col("all")).alias("from_end"))

    def at(self, index: int) -> DataFrame:
        return self.positions().filter(F.col("idx" if index >= 0 else "from_end") == index)

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
        """As a Python slice of each signal's changes, with a positive step; an empty slice is empty."""
        if step <= 0:
            raise NotImplementedError("only positive steps")
        df = self.positions()
        n = F.col("idx") - F.col("from_end")
        low = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
        high = n if stop is None else F.lit(stop) if stop >= 0 else n + stop
        return df.filter((F.col("idx") >= low) & (F.col("idx") < high) & ((F.col("idx") - low) % step == 0))

    def lengths(self) -> DataFrame:
        return self.df.groupBy("signal").agg(F.count("*").alias("n_changes"))

    # Steps in time

    def time_steps(self, is_event: Column | None = None) -> DataFrame:
        """(time, signal, value, transitions): for each time the signals that changed and their last value."""
        return self.dedup(is_event).steps().select("time", "signal", "value", F.col("elements").alias("transitions"))

    def changed(self) -> DataFrame:
        """(time, signals): the set of signals that changed at each time."""
        return self.dedup().df.groupBy("time").agg(F.array_sort(F.collect_set("signal")).alias("signals"))

    # Whole logs

    def union(self, other: ChangeLog) -> ChangeLog:
        return self._with(self.df.unionByName(other.df))

    def difference(self, other: ChangeLog) -> DataFrame:
        """Changes that only one of two logs has, with side."""
        mine, theirs = (x.df.select("signal", "time", "value") for x in (self, other))
        return mine.exceptAll(theirs).withColumn("side", F.lit("left")).unionByName(theirs.exceptAll(mine).withColumn("side", F.lit("right")))

    def ordered_difference(self, other: ChangeLog) -> DataFrame:
        """(signal, idx, left_time, left_value, right_time, right_value): places at which two logs differ, the order of changes at one time included.

        A digest of each signal, over places, times and values, is compared first; only signals whose digests differ
        are laid side by side. A place that one log lacks is null there.
        """
        mine, theirs = self.positions(), other.positions()

        def digest(log: DataFrame) -> DataFrame:
            place = [F.col("idx"), F.col("time"), F.col("value")]
            return log.groupBy("signal").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*place)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *place)).alias("b"))

        left, right = (digest(x).select("signal", F.struct("n", "a", "b").alias("of")) for x in (mine, theirs))
        both = left.join(right.select(F.col("signal").alias("other"), F.col("of").alias("its")), F.col("signal").eqNullSafe(F.col("other")), "full")
        differ = materialize(both.filter(~F.col("of").eqNullSafe(F.col("its"))).select(F.coalesce("signal", "other").alias("odd")), "unequal-signals")
        named = lambda log, side: log.join(differ, F.col("signal").eqNullSafe(F.col("odd")), "left_semi").select(F.col("signal").alias(f"{side}_signal"), F.col("idx").alias(f"{side}_idx"), F.col("time").alias(f"{side}_time"), F.col("value").alias(f"{side}_value"))
        same = F.col("left_signal").eqNullSafe(F.col("right_signal")) & (F.col("left_idx") == F.col("right_idx"))
        sides = named(mine, "left").join(named(theirs, "right"), same, "full")
        unequal = ~(F.struct("left_idx", "left_time", "left_value").eqNullSafe(F.struct("right_idx", "right_time", "right_value")))
        found = sides.filter(unequal)
        return found.select(F.coalesce("left_signal", "right_signal").alias("signal"), F.coalesce("left_idx", "right_idx").alias("idx"), "left_time", "left_value", "right_time", "right_value")

    def equals(self, other: ChangeLog) -> bool:
        """The same changes of the same signals in the same order; how seq counts them is of no account."""
        return self.ordered_difference(other).isEmpty()

    def statistics(self) -> DataFrame:
        size = F.octet_length(F.col("value").cast("string")).cast("long")
        return self.df.groupBy("signal").agg(F.count("*").alias("n_changes"), F.countDistinct("time").alias("n_times"), F.sum(size).alias("n_bytes"), F.max(size).alias("widest"))


def estimated_bytes(df: DataFrame) -> int:
    """The size of a table as Catalyst takes it to be."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def beside(df: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of ends, which has one row for each combination of the keys, nulls included."""
    found = ends.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in ends.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(found[f"__of_{k}"]) for k in keys])
    return df.join(found, same, "left").drop(*[f"__of_{k}" for k in keys])


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its place in the order, from 0; a range of the order is a task, and adds the sizes of those before it."""
    at = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("__part")).count()  # a row for each range
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return at.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row).select(*df.columns, name)


def accepted_steps(steps: DataFrame, time: str = "time", seq: str = "seq", within: list[str] | None = None) -> DataFrame:
    """Steps in file order without those that go back in time.

    A step before the latest accepted time is dropped; an equal one keeps the state
    of the step before it. `within` names the keys of independent files; the order is
    global within one.
    """
    return accepted(placed(steps, seq, within), time, within).select(*steps.columns)


def placed(steps: DataFrame, seq: str = "seq", within: list[str] | None = None) -> DataFrame:
    """Steps with __at, a number that grows with their order within the keys, and __part, the range of the order that they lie in; as a table."""
    order = [*(within or []), seq]
    size = estimated_bytes(steps)
    n = size // RANGE_BYTES if size < UNKNOWN_BYTES else 0
    ranged = steps.repartitionByRange(n, *order) if n > shuffle_partitions(steps) else steps.repartitionByRange(*order)
    return materialize(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranged")


def accepted(df: DataFrame, time: str = "time", within: list[str] | None = None) -> DataFrame:
    """Those of placed steps that do not go back in time.

    Ranges of the order are judged side by side: the latest time and the last verdict before each come from tables with
    a row for each file and range. Places are numbers, so that these are counted without sorting.
    """
    keys = within or []
    part = [*keys, "__part"]
    columns = df.columns
    w = Window.partitionBy(*part).orderBy("__at")
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)

    tops = df.groupBy(*part).agg(F.max(time).alias("__end")).select(*part, F.max("__end").over(earlier).alias("__top"))
    n = estimated_bytes(df) // RANGE_BYTES
    df = df.repartition(n, *part) if n > shuffle_partitions(df) else df
    latest = F.greatest(F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__top"))
    flag = F.when(latest.isNull() | (F.col(time) > latest), 1).when(F.col(time) < latest, 0)
    df = beside(df, tops, part).withColumn("__flag", flag)

    ends = df.groupBy(*part).agg(F.max_by("__flag", F.when(F.col("__flag").isNotNull(), F.col("__at"))).alias("__end"))
    verdicts = ends.select(*part, F.last("__end", ignorenulls=True).over(earlier).alias("__verdict"))
    own = F.last("__flag", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return beside(df.withColumn("__kept", own), verdicts, part).filter(F.coalesce("__kept", "__verdict") == 1).select(*columns)


def delta_times(times: DataFrame) -> DataFrame:
    """(time_idx, time, delta) of distinct times: each time less the one before it; the first as it is."""
    at = materialize(numbered(times.select("time"), "time", "time_idx"), "times")
    before = at.select((F.col("time_idx") + 1).alias("time_idx"), F.col("time").alias("before"))
    return at.join(before, "time_idx", "left").select("time_idx", "time", (F.col("time") - F.coalesce("before", F.lit(0))).alias("delta"))


def undelta_times(deltas: DataFrame, order: str, span: int = 1 << 16) -> DataFrame:
    """deltas with their running sum as time; order: positions from 0. Sums run within spans of positions, and over a row for each span."""
    spans = F.floor(F.col(order) / span)
    sums = deltas.groupBy(spans.alias("__span")).agg(F.sum("delta").alias("sum"))
    lead = sums.select("__span", (F.sum("sum").over(Window.orderBy("__span")) - F.col("sum")).alias("__lead"))
    own = F.sum("delta").over(Window.partitionBy("__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return deltas.withColumn("__span", spans).withColumn("__own", own).join(F.broadcast(lead), "__span").select(*deltas.columns, (F.col("__lead") + F.col("__own")).alias("time"))
