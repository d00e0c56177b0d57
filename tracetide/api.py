"""Waveforms as objects: names resolve to variables, variables to signals, signals to Spark queries.

Only catalogs and the rows that a caller asks for reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.functions import values
from tracetide.operators.changelog import ChangeLog
from tracetide.operators.derived import Derived, Extract
from tracetide.sources.detect import file_format
from tracetide.sources.fst import FstFiles
from tracetide.sources.ghw import GhwFiles
from tracetide.sources.saved import SavedWaves, is_saved
from tracetide.sources.vcd import VcdFiles


def open_waves(spark: SparkSession, path: str, flatten_unnamed: bool = False):
    """The reader for a file's format; a folder that save() wrote is read as tables."""
    if is_saved(spark, path):
        return SavedWaves(spark, path)
    kind = file_format(spark, path)
    if kind == "ghw":
        return GhwFiles(spark, path)
    if kind == "fst":
        return FstFiles(spark, path)
    return VcdFiles(spark, path, flatten_unnamed)  # which names what is wrong with an unknown file


class Waveform:
    """One waveform file. stream_only: signals cannot be addressed, only streamed."""

    def __init__(self, spark: SparkSession, path: str, flatten_unnamed: bool = False, stream_only: bool = False):
        self.spark, self.stream_only = spark, stream_only
        self.source = open_waves(spark, path, flatten_unnamed)
        self._scopes = [Scope(self, r) for r in self.source.table("scopes").orderBy("scope_id").collect()]
        self._vars = [Var(self, r) for r in self.source.table("vars").orderBy("var_id").collect()]
        self._children: dict[int | None, list] = {}
        for x in sorted((*self._scopes, *self._vars), key=lambda x: x.row.ord):
            self._children.setdefault(x.row.parent_id, []).append(x)
        self._signals = {r.signal_id: r for r in self.source.table("signals").collect()}
        self._loaded: dict[int, DataFrame] = {}
        self._derived: dict[int, list] = {}
        if isinstance(self.source, VcdFiles):
            for r in self.source.table("derived").orderBy("signal_id", "pos").collect():
                self._derived.setdefault(r.signal_id, []).append(r)
        self._meta = self.source.table("meta").first()

    date = property(lambda self: self._meta.date)
    version = property(lambda self: self._meta.version)
    file_format = property(lambda self: self._meta.file_format)
    timescale = property(lambda self: (self._meta.timescale_factor, self._meta.timescale_unit) if self._meta.timescale_factor is not None else None)

    def scopes(self) -> list[Scope]:
        return [s for s in self._scopes if s.row.parent_id is None]

    def vars(self) -> list[Var]:
        return [v for v in self._vars if v.row.parent_id is None]

    def first_scope(self) -> Scope | None:
        """The scope declared first at the top."""
        return min(self.scopes(), key=lambda s: s.row.ord, default=None)

    def is_derived(self, signal_id: int) -> bool:
        """The signal is put together from bits of others."""
        return signal_id in self._derived

    def derived_signals(self) -> dict[int, list[Extract]]:
        """The parts of each derived signal, the most significant first."""
        return {i: [Extract(d.input_signal_id, d.msb, d.lsb) for d in rows] for i, rows in self._derived.items()}

    def all_scopes(self) -> list[Scope]:
        return list(self._walk(None, "scopes"))

    def all_vars(self) -> list[Var]:
        return list(self._walk(None, "vars"))

    def _items(self, parent: int | None) -> list:
        return self._children.get(parent, [])

    def _walk(self, parent: int | None, kind: str) -> Iterator:
        """Depth first, leaves before the scope that holds them."""
        for x in self._items(parent):
            if isinstance(x, Scope):
                yield from self._walk(x.row.scope_id, kind)
            if isinstance(x, Scope) == (kind == "scopes"):
                yield x

    def _find(self, parent: int | None, name: str):
        """Greedy: at each level the longest name that begins the rest; a scope needs a following point, a variable any rest without one."""
        items = self._items(parent)
        best = None
        for x in items:
            rest = name[len(x.name) :] if name.startswith(x.name) else None
            if rest is None or (rest and isinstance(x, Scope) and not rest.startswith(".")) or (isinstance(x, Var) and "." in rest):
                continue
            if best is None or len(x.name) > len(best.name):
                best = x
        if best is None:
            raise KeyError(f"Failed to find {name}. Did you mean: {', '.join(x.name for x in items[:5])}")
        rest = name[len(best.name) :]
        return self._find(best.row.scope_id, rest[1:]) if isinstance(best, Scope) and rest else best

    def __getitem__(self, name: str | int):
        """A scope or variable by its full name; the variables of a signal by its id."""
        if isinstance(name, int):
            return [v for v in self._vars if v.row.signal_id == name]
        return self._find(None, name)

    def load_signals(self, ids: list[int]) -> None:
        """Keep the decoded changes of these signals, so that later questions do not read the file again."""
        new = [i for i in ids if i not in self._loaded]
        if new:
            kept = self._decoded(new).persist(StorageLevel.MEMORY_AND_DISK)
            self._loaded |= dict.fromkeys(new, kept)

    def get_signal(self, signal_id: int) -> Signal | None:
        """A signal that load_signals keeps; None for others."""
        return Signal(self, signal_id) if signal_id in self._loaded else None

    def statistics(self) -> DataFrame:
        """(signal, n_changes, n_times, n_bytes, widest) of all ground signals."""
        return self._raw([i for i in self._signals if i not in self._derived]).statistics()

    def unload_signals(self, ids: list[int]) -> None:
        """Forget them; the memory is free when none of the signals loaded together is left."""
        for i in ids:
            kept = self._loaded.pop(i, None)
            if kept is not None and all(x is not kept for x in self._loaded.values()):
                kept.unpersist()

    def log(self, signal_id: int) -> ChangeLog:
        if self.stream_only:
            raise RuntimeError("Cannot access signals in stream only mode")
        if signal_id in self._derived:
            return self._evaluated(signal_id)
        return self._raw([signal_id]).dedup(F.lit(True) if self._signals[signal_id].encoding == "event" else None)

    def _evaluated(self, signal_id: int) -> ChangeLog:
        parts = self.derived_signals()[signal_id]
        found = Derived(parts).evaluate(self._raw(sorted({p.signal for p in parts})))
        return ChangeLog(found.select(F.lit(signal_id).cast("bigint").alias("signal"), "time", F.lit(0).alias("seq"), "value"))

    def _ground(self, ids: list[int]) -> ChangeLog:
        return self._raw([i for i in ids if i not in self._derived])

    def _raw(self, ids: list[int]) -> ChangeLog:
        kept = self._loaded.get(ids[0]) if len(ids) == 1 else None
        return ChangeLog(self._decoded(ids) if kept is None else kept.filter(F.col("signal") == ids[0]))

    def _decoded(self, ids: list[int]) -> DataFrame:
        every = len(set(ids)) == len(self._signals) - len(self._derived)
        wanted = None if every else self.source.table("signals").filter(F.col("signal_id").isin(ids)).select("file", "signal_id")
        value = F.coalesce("bits", "str", F.col("real").cast("string"), F.lit(""))
        return self.source.changes(wanted).select(F.col("signal_id").alias("signal"), "time", "seq", value.alias("value"))

    def time_table(self) -> DataFrame:
        steps = self.source.steps()
        return ChangeLog(steps.select(F.lit(0).alias("signal"), "time", F.lit(0).alias("seq"), F.lit("").alias("value"))).time_table()

    def _included(self, include: list | None) -> list[int]:
        if include is None:
            return list(self._signals)
        ids = []
        for x in include:
            try:
                ids.append((self[x] if isinstance(x, str) else x).row.signal_id)
            except KeyError:
                continue  # names that resolve to nothing are ignored
        return ids

    def stream_changes(self, callback: Callable, include: list | None = None) -> None:
        """callback(time, signal_id, value) for every change in file order, repeated values included.

        A derived signal changes once in a time, after the changes of that time in the file.
        """
        ids = self._included(include)
        rows = self._ground(ids).df.select("time", "signal", "value", "seq", F.lit(False).alias("derived"))
        for i in filter(self._derived.get, ids):
            own = self._evaluated(i).df.select("time", "signal", "value", F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), F.lit(True).alias("derived"))
            rows = rows.unionByName(own)
        for r in rows.orderBy("time", "derived", "seq", "signal").toLocalIterator():
            callback(r.time, r.signal, self.value(r.signal, r.value))

    def stream_time_steps(self, callback: Callable, include: list | None = None) -> None:
        """callback(time, values, changed) for every time with a real change; values holds all latest values so far, derived ones too."""
        ids = self._included(include)
        events = F.col("signal").isin([i for i in ids if self._signals[i].encoding == "event"])
        rows = self._ground(ids).time_steps(events).select("time", "signal", "value")
        for i in filter(self._derived.get, ids):
            rows = rows.union(self._evaluated(i).df.select("time", "signal", "value"))
        steps = rows.groupBy("time").agg(F.sort_array(F.collect_list(F.struct("signal", "value"))).alias("changes"))
        latest: dict[int, object] = {}
        for r in steps.orderBy("time").toLocalIterator():
            latest |= {c.signal: self.value(c.signal, c.value) for c in r.changes}
            callback(r.time, dict(latest), [c.signal for c in r.changes])

    def value(self, signal_id: int, text: str):
        """Numbers for vectors of 0 and 1, the bits of others."""
        encoding = self._signals[signal_id].encoding
        if encoding == "real":
            return float(text)
        return int(text, 2) if encoding == "bits" and not set(text) - set("01") else text


class Offset(NamedTuple):
    start_time: int
    elements: int
    time_match: bool
    next_time: int | None


class Scope:
    def __init__(self, wave: Waveform, row):
        self.wave, self.row = wave, row
        self.name, self.full_name, self.scope_type = row.name, row.full_name, row.scope_type

    is_array = property(lambda self: self.scope_type in ("sv_array", "vhdl_array"))
    is_packed_array = property(lambda self: self.is_array and self.is_packed)
    is_unpacked_array = property(lambda self: self.is_array and not self.is_packed)
    is_packed_record = property(lambda self: self.is_record and self.is_packed)
    is_record = property(lambda self: self.scope_type in ("vhdl_record", "struct", "union"))
    is_packed = property(lambda self: self.row.pack in ("packed", "tagged_packed"))
    component = property(lambda self: self.row.component)
    source = property(lambda self: None if self.row.decl_path is None else (self.row.decl_path, self.row.decl_line))
    instance_source = property(lambda self: None if self.row.inst_path is None else (self.row.inst_path, self.row.inst_line))

    def scopes(self) -> list[Scope]:
        return [x for x in self.wave._items(self.row.scope_id) if isinstance(x, Scope)]

    def vars(self) -> list[Var]:
        return [x for x in self.wave._items(self.row.scope_id) if isinstance(x, Var)]

    def all_scopes(self) -> list[Scope]:
        return list(self.wave._walk(self.row.scope_id, "scopes"))

    def all_vars(self) -> list[Var]:
        return list(self.wave._walk(self.row.scope_id, "vars"))

    def __getitem__(self, name: str):
        return self.wave._find(self.row.scope_id, name)

    def __eq__(self, other) -> bool:
        return isinstance(other, Scope) and self.wave is other.wave and self.row.scope_id == other.row.scope_id

    def __hash__(self) -> int:
        return hash((id(self.wave), self.row.scope_id))

    def __repr__(self) -> str:
        return f"Scope({self.full_name})"


class Var:
    def __init__(self, wave: Waveform, row):
        self.wave, self.row = wave, row
        self.name, self.full_name, self.var_type, self.direction = row.name, row.full_name, row.var_type, row.direction
        self.vhdl_type_name, self.signal_id = row.vhdl_type_name, row.signal_id
        self.index = None if row.msb is None else (row.msb, row.lsb)

    encoding = property(lambda self: self.wave._signals[self.row.signal_id].encoding)
    bitwidth = property(lambda self: self.wave._signals[self.row.signal_id].width if self.encoding in ("bits", "event") else None)
    is_real = property(lambda self: self.encoding == "real")
    is_string = property(lambda self: self.encoding == "string")
    is_bit_vector = property(lambda self: self.encoding in ("bits", "event"))
    is_1bit = property(lambda self: self.bitwidth == 1)

    @property
    def enum_type(self) -> dict[str, str] | None:
        if self.row.enum_id is None:
            return None
        r = self.wave.source.table("enums").filter(F.col("enum_id") == self.row.enum_id).first()
        return {m.value: m.label for m in r.mapping}

    @property
    def signal(self) -> Signal:
        return Signal(self.wave, self.row.signal_id)

    def __getitem__(self, time: int):
        found = self.signal.value_at(time)
        if found is None:
            raise IndexError(f"No change yet at {time}")
        return found

    def __eq__(self, other) -> bool:
        return isinstance(other, Var) and self.wave is other.wave and self.row.var_id == other.row.var_id

    def __hash__(self) -> int:
        return hash((id(self.wave), self.row.var_id, "var"))

    def __repr__(self) -> str:
        return f"Var({self.full_name})"


class Signal:
    """A signal's changes as a sequence of (time, value)."""

    def __init__(self, wave: Waveform, signal_id: int):
        self.wave, self.signal_id = wave, signal_id
        self.log = wave.log(signal_id)

    def _value(self, text):
        return None if text is None else self.wave.value(self.signal_id, text)

    def value_at(self, time: int):
        """The last value at or before a time; None before the first change."""
        r = self.log.snapshot(time).first()
        return None if r is None else self._value(r.value)

    def offset(self, time: int) -> Offset | None:
        """The last change at or before a time, with the number of changes there and the time of the next; None before the first."""
        probe = self.wave.spark.range(1).select(F.lit(self.signal_id).alias("signal"), F.lit(time).alias("time"))
        log = ChangeLog(self.log.df.withColumn("signal", F.lit(self.signal_id)))
        r = log.offsets(probe).first()
        return None if r.start_time is None else Offset(r.start_time, r.elements, r.time_match, r.next_time)

    def values_at(self, time: int) -> list:
        """All values of a change's time, in order: more than one where the signal changed several times in no time."""
        rows = self.log.df.filter(F.col("time") == time).orderBy("seq").collect()
        return [self._value(r.value) for r in rows]

    def first_time(self) -> int | None:
        r = self.log.first_times().first()
        return None if r is None else r.first_time

    def max_states(self) -> int:
        """The smallest number system of all values: 0 two states, 1 four, 2 nine."""
        return self.log.df.agg(values.states_of_set(F.col("value")).alias("n")).first().n

    def __len__(self) -> int:
        return self.log.df.count()

    def __getitem__(self, index: int | slice):
        if isinstance(index, slice):
            rows = self.log.slice(index.start, index.stop, index.step or 1).orderBy("idx").collect()
            return [(r.time, self._value(r.value)) for r in rows]
        r = self.log.at(index).first()
        if r is None:
            raise IndexError(index)
        return r.time, self._value(r.value)

    def __iter__(self) -> Iterator:
        for r in self.log.df.orderBy("time", "seq").toLocalIterator():
            yield r.time, self._value(r.value)
