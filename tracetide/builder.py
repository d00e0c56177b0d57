"""Catalogs and change logs made in a program instead of read from a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide import model
from tracetide.functions import values
from tracetide.operators.changelog import accepted_steps

CHANGES = "signal_id bigint, time bigint, seq bigint, kind tinyint, bits string, str string, real double"


class HierarchyBuilder:
    def __init__(self, spark: SparkSession, name: str = "built"):
        self.spark, self.name = spark, name
        self.scopes: list[dict] = []
        self.vars: list[dict] = []
        self.signals: list[dict] = []
        self.enums: list[dict] = []
        self._stack: list[int | None] = [None]
        self._order: dict[int | None, int] = {}

    def _position(self) -> int:
        parent = self._stack[-1]
        self._order[parent] = self._order.get(parent, -1) + 1
        return self._order[parent]

    def _path(self, name: str) -> list[str]:
        parent = self._stack[-1]
        return [*(self.scopes[parent]["path"] if parent is not None else []), name]

    def push_scope(self, name: str, scope_type: str = "module") -> int:
        if scope_type not in model.SCOPE_TYPES:
            raise ValueError(f"unknown scope type: {scope_type}")
        same = next((s["scope_id"] for s in self.scopes if s["parent_id"] == self._stack[-1] and s["name"] == name), None)
        if same is None:
            same = len(self.scopes)
            path = self._path(name)
            self.scopes.append({"file": self.name, "scope_id": same, "parent_id": self._stack[-1], "ord": self._position(), "name": name, "path": path, "full_name": ".".join(path), "scope_type": scope_type})
        self._stack.append(same)
        return same

    def pop_scope(self) -> None:
        if len(self._stack) == 1:
            raise ValueError("no scope is open")
        self._stack.pop()

    def new_signal(self, encoding: str = "bits", width: int = 1) -> int:
        self.signals.append({"file": self.name, "signal_id": len(self.signals), "encoding": encoding, "width": width if encoding == "bits" else 0, "kind": "ground"})
        return len(self.signals) - 1

    def declare_enum(self, name: str, mapping: list[tuple[str, str]]) -> int:
        widths = {len(bits) for bits, _ in mapping}
        if len(widths) > 1 or any(set(bits) - set("01xzhuwl-") for bits, _ in mapping):
            raise ValueError("the values of an enum are bit strings of one width")
        self.enums.append({"file": self.name, "enum_id": len(self.enums), "name": name, "mapping": [{"value": b, "label": label} for b, label in mapping]})
        return len(self.enums) - 1

    def add_var(self, name: str, signal: int, var_type: str = "wire", msb: int | None = None, lsb: int | None = None, direction: str = "unknown", enum: int | None = None) -> int:
        s = self.signals[signal]
        lsb = msb if lsb is None else lsb
        if msb is not None and abs(msb - lsb) + 1 != s["width"]:
            raise ValueError(f"{name}[{msb}:{lsb}] is not {s['width']} bits wide")
        path = self._path(name)
        self.vars.append({"file": self.name, "var_id": len(self.vars), "parent_id": self._stack[-1], "ord": self._position(), "name": name, "path": path, "full_name": ".".join(path), "var_type": "event" if s["encoding"] == "event" else var_type, "direction": direction, "msb": msb, "lsb": lsb, "signal_id": signal, "enum_id": enum})
        return len(self.vars) - 1

    def finish(self) -> dict[str, DataFrame]:
        make = lambda rows, schema: self.spark.createDataFrame([{f.split()[0]: r.get(f.split()[0]) for f in _fields(schema)} for r in rows], schema)
        return {"scopes": make(self.scopes, model.SCOPES), "vars": make(self.vars, model.VARS), "signals": make(self.signals, model.SIGNALS), "enums": make(self.enums, model.ENUMS)}


def _fields(schema: str) -> list[str]:
    return [f for f in schema.split(", ") if f]


class Encoder:
    """Changes in order; snapshot() is what there is so far, and encoding may go on."""

    def __init__(self, spark: SparkSession, signals: list[dict]):
        self.spark, self.signals = spark, {s["signal_id"]: s for s in signals}
        self.rows: list[tuple] = []
        self.times: list[int] = []
        self.time: int | None = None
        self.skipping = False

    def time_change(self, time: int) -> None:
        """A step back in time is skipped with its changes; an equal time keeps the state."""
        latest = self.times[-1] if self.times else None
        if latest is None or time > latest:
            self.times.append(time)
            self.time, self.skipping = time, False
        elif time < latest:
            self.skipping = True

    def change(self, signal: int, value) -> None:
        if self.time is None:
            self.time_change(0)
        if self.skipping:
            return
        s = self.signals[signal]
        kind = {"event": 0, "bits": 1, "string": 2, "real": 3}[s["encoding"]]
        if kind == 1:
            value = str(value).lower()
            fill = value[0] if value[0] in "xz" else "0"
            value = value.rjust(s["width"], fill)
            if len(value) > s["width"] or set(value) - set("01xzhuwl-"):
                raise ValueError(f"{value} is no value of {s['width']} bits")
        self.rows.append((signal, self.time, len(self.rows), kind, value if kind == 1 else None, value if kind == 2 else None, float(value) if kind == 3 else None))

    def snapshot(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows), CHANGES)

    def steps(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in self.times], "time bigint")

    finish = snapshot


def encoded(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """What an Encoder makes of whole tables of changes: rows (file, signal_id, time, seq, value as text), in file order by seq, each file over the same signals.

    Steps back in time are left out; vectors are extended to their widths; a value that is none of its signal's is an error when
    its row is reached. Events and null values keep no value. Changes of signals that are not in the catalog are dropped.
    """
    kept = accepted_steps(rows, within=["file"]).join(F.broadcast(signals.select("signal_id", "encoding", "width")), "signal_id")
    value, encoding = F.col("value"), F.col("encoding")
    token = F.lower(value)
    fits = (F.length(token) <= F.col("width")) & token.rlike("^[01xzhuwl-]+$")
    wrong = F.raise_error(F.concat(value, F.lit(" is no value of "), F.col("width").cast("string"), F.lit(" bits"))).cast("string")
    bits = F.when((encoding != "bits") | value.isNull(), None).when(fits, values.extend(token, F.col("width"))).otherwise(wrong)
    kind = F.when(encoding == "event", 0).when(encoding == "bits", 1).when(encoding == "string", 2).otherwise(3).cast("tinyint")
    return kept.select("file", "signal_id", "time", "seq", kind.alias("kind"), bits.alias("bits"), F.when(encoding == "string", value).alias("str"), F.when(encoding == "real", value.cast("double")).alias("real"))
