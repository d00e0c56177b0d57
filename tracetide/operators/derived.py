"""Derived signals: slices and concatenations of bit vectors, evaluated where an input changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracetide.functions import values
from tracetide.operators.changelog import ChangeLog


@dataclass(frozen=True)
class Extract:
    """Bits msb..lsb of an input signal."""

    signal: object
    msb: int
    lsb: int

    @property
    def width(self) -> int:
        return self.msb - self.lsb + 1


class Derived:
    """Extracts side by side, the most significant first; neighbours that continue each other become one."""

    def __init__(self, parts: list[Extract]):
        self.parts: list[Extract] = []
        for p in parts:
            last = self.parts[-1] if self.parts else None
            if last and last.signal == p.signal and last.lsb - 1 == p.msb:
                self.parts[-1] = Extract(p.signal, last.msb, p.lsb)
            else:
                self.parts.append(p)

    @classmethod
    def slice(cls, signal, msb: int, lsb: int) -> Derived:
        return cls([Extract(signal, msb, lsb)])

    @classmethod
    def identity(cls, signal, width: int) -> Derived:
        return cls([Extract(signal, width - 1, 0)])

    def concat(self, right: Derived) -> Derived:
        return Derived([*self.parts, *right.parts])

    @property
    def width(self) -> int:
        return sum(p.width for p in self.parts)

    def inputs(self) -> list:
        return list(dict.fromkeys(p.signal for p in self.parts))

    def evaluate(self, log: ChangeLog) -> DataFrame:
        """(time, value) wherever the output changes; inputs without a value yet are x. At one time final values count.

        With log.slices the times are cut into that many parts; the inputs' last
        values before a part come from a table with a row for each part.
        """
        signals = self.inputs()
        if log.slices is None:  # one signal of parts, each of them held and cut by itself
            parts = log.df.sparkSession.createDataFrame([(0, i, signals.index(p.signal), p.msb, p.lsb) for i, p in enumerate(self.parts)], "signal int, pos int, input int, msb int, lsb int")
            place = F.coalesce(*[F.when(F.col("signal") == s, i) for i, s in enumerate(signals)])
            return evaluate_all(ChangeLog(log.only(signals).df.withColumn("signal", place)), parts).select("time", "value")
        last = log.only(signals).steps()
        wide = last.groupBy("time").pivot("signal", signals).agg(F.first("value"))
        inputs = [f"in{i}" for i in range(len(signals))]
        held = wide.select("time", log.slot_of(wide).alias("slot"), *[F.col(f"`{s}`").alias(c) for c, s in zip(inputs, signals, strict=True)])
        ends = held.groupBy("slot").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("time"))).alias(c) for c in inputs])
        earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
        ends = ends.select("slot", *[F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_before") for c in inputs])
        w = Window.partitionBy("slot").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        held = held.join(F.broadcast(ends), "slot").select("time", *[F.coalesce(F.last(c, ignorenulls=True).over(w), f"{c}_before").alias(c) for c in inputs])
        parts = [F.coalesce(values.slice_bits(F.col(f"in{signals.index(p.signal)}"), p.msb, p.lsb), F.lit("x" * p.width)) for p in self.parts]
        out = held.select(F.lit(0).alias("signal"), "time", F.lit(0).alias("seq"), values.concat_bits(*parts).alias("value"))
        return ChangeLog(out, slices=log.slices).dedup().df.select("time", "value")


def evaluate_all(log: ChangeLog, parts: DataFrame) -> DataFrame:
    """(signal, time, value) of many derived signals at once, wherever their values change.

    parts: (signal, pos, input, msb, lsb), with pos from 0 for the most significant. Inputs without a value yet are x;
    at one time final values count. A part is held over the times of its signal as a signal of its own, so that
    neither the number of derived signals nor that of their inputs appears in the plan.
    """
    parts = parts.select(F.col("signal").alias("of"), "pos", "input", "msb", "lsb")
    last = log.steps().select(F.col("signal").alias("input"), "time", "value")
    bits = values.slice_bits(F.col("value"), F.col("msb"), F.col("lsb"))
    met = parts.join(last, "input").groupBy("of", "time").agg(F.map_from_entries(F.collect_list(F.struct("pos", bits.alias("bits")))).alias("changed"))
    rows = met.join(parts.select("of", "pos", (F.col("msb") - F.col("lsb") + 1).alias("width")), "of")
    rows = rows.select(F.struct("of", "pos").alias("signal"), "time", F.lit(0).alias("seq"), "width", F.try_element_at("changed", F.col("pos")).alias("bits"))
    held = log.held(rows, ["bits"], ["time"])
    whole = F.sort_array(F.collect_list(F.struct("signal.pos", F.coalesce("bits", F.expr("repeat('x', width)")).alias("bits"))))
    out = held.groupBy("signal.of", "time").agg(F.array_join(whole["bits"], "").alias("value"))
    return log.like(out.select(F.col("of").alias("signal"), "time", F.lit(0).alias("seq"), "value")).dedup().df.select("signal", "time", "value")


def merge_keyed(left: ChangeLog, right: ChangeLog, left_width: int, right_width: int) -> ChangeLog:
    """For each signal the concatenation of its values in two logs, changing when either does."""
    tagged = left.steps().select("signal", "time", F.col("value").alias("l"), F.lit(None).cast("string").alias("r")).unionByName(right.steps().select("signal", "time", F.lit(None).cast("string").alias("l"), F.col("value").alias("r")))
    both = tagged.groupBy("signal", "time").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    held = left.held(both, ["l", "r"], ["time"])
    value = F.concat(values.or_unknown(F.col("l"), left_width), values.or_unknown(F.col("r"), right_width))
    return ChangeLog(held.select("signal", "time", F.lit(0).alias("seq"), value.alias("value")), slices=left.slices).dedup()


def assemble_bits(bits: DataFrame, width: int, slices: int | None = None) -> DataFrame:
    """(signal, time, value) from single bits (signal, time, seq, bit, value): each step holds the vector's state after it."""
    last = bits.groupBy("signal", "time", "bit").agg(F.max_by("value", "seq").alias("value"))
    names = [f"b{i}" for i in range(width)]
    wide = last.groupBy("signal", "time").agg(*[F.max(F.when(F.col("bit") == i, F.col("value"))).alias(b) for i, b in enumerate(names)])
    held = ChangeLog(bits, slices=slices).held(wide, names, ["time"])
    return held.select("signal", "time", F.concat(*[F.coalesce(b, F.lit("u")) for b in reversed(names)]).alias("value"))
