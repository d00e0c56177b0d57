"""GHW files (GHDL waveforms) as DataFrames.

A file is one sequential stream, so that a task decodes whole files, as many small ones
as fill a split. Decoding yields plain rows: the catalog, which element of which
variable is which scalar signal, and the scalar changes. Vectors are put together
from their elements by Spark, as final values of each time step.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide import model
from tracetide.functions.values import STD_LOGIC
from tracetide.sources.vcd_source import SPLIT_BYTES, Bytes, gathered, listed, opened, packed
from tracetide.storage import materialize


class GhwError(ValueError):
    pass


# Type kinds, hierarchy kinds, and the literals of std_ulogic.
B2, E8, I32, I64, F64, P32, P64, ARRAY, RECORD, SUB_SCALAR, SUB_ARRAY, SUB_UNBOUNDED, SUB_RECORD = 22, 23, 25, 26, 27, 28, 29, 31, 32, 34, 35, 37, 38
SCOPE_KINDS = {3: "vhdl_block", 4: "vhdl_if_generate", 5: "vhdl_for_generate", 6: "vhdl_architecture", 7: "vhdl_package", 14: "ghw_generic"}
DIRECTIONS = {16: "implicit", 17: "input", 18: "output", 19: "inout", 20: "buffer", 21: "linkage"}
NINE = ["'U'", "'X'", "'0'", "'1'", "'Z'", "'W'", "'L'", "'H'", "'-'"]
MAGIC = b"GHDLwave\n\x10\x00"


def is_ghw(start: bytes) -> bool:
    return start.startswith(MAGIC) and len(start) >= 16 and start[11] <= 1 and start[12] in (1, 2)


class Cursor:
    def __init__(self, data: bytes, at: int = 0, order: str = "<"):
        self.data, self.at, self.order = data, at, order

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise GhwError("file ends early")
        self.at += n
        return out

    def u8(self) -> int:
        return self.take(1)[0]

    def number(self, form: str):
        return struct.unpack(self.order + form, self.take(struct.calcsize(form)))[0]

    def unsigned(self) -> int:
        out = shift = 0
        while True:
            b = self.u8()
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    def signed(self) -> int:
        out = shift = 0
        while True:
            b = self.u8()
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out - (1 << shift) if b & 64 else out

    def expect(self, mark: bytes) -> None:
        found = self.take(len(mark))
        if found != mark:
            raise GhwError(f"expected {mark!r}, found {found!r}")


class Type:
    """kind: enum, int, phys, float, array, record. Arrays have element and range (None: unbounded), records have fields."""

    def __init__(self, kind: str, name: str, **more):
        self.kind, self.name = kind, name
        self.literals: list[str] = more.get("literals", [])
        self.width: int = more.get("width", 0)
        self.element: Type | None = more.get("element")
        self.range: tuple[int, int] | None = more.get("range")
        self.fields: list[tuple[str, Type]] = more.get("fields", [])

    def bounded(self) -> bool:
        if self.kind == "array":
            return self.range is not None and self.element.bounded()
        return all(t.bounded() for _, t in self.fields)

    def is_nine(self) -> bool:
        return self.kind == "enum" and self.literals == NINE

    def is_bit(self) -> bool:
        return self.kind == "enum" and self.literals in (["'0'", "'1'"], ["false", "true"])

    def is_vector(self) -> bool:
        return self.kind == "array" and (self.element.is_nine() or self.element.is_bit())

    def scalar_form(self) -> str:
        if self.kind == "enum":
            return "nine" if self.is_nine() else "bit" if self.is_bit() else "byte"
        return {"int": "int", "phys": "int", "float": "real"}[self.kind]

    def named(self, name: str) -> Type:
        return Type(self.kind, name or self.name, literals=self.literals, width=self.width, element=self.element, range=self.range, fields=self.fields)


class GhwFile:
    """One decoded file."""

    def __init__(self, data: bytes):
        if not is_ghw(data):
            raise GhwError("compressed GHW files are not supported" if data[:2] in (b"\x1f\x8b", b"BZ") else "not a GHW file")
        self.version = data[11]
        self.c = Cursor(data, 16, "<" if data[12] == 1 else ">")
        self.strings: list[str] = []
        self.types: list[Type] = []
        self.scopes: list[dict] = []
        self.vars: list[dict] = []
        self.enums: list[dict] = []
        self.signals: list[dict] = []
        self.elements: list[dict] = []
        self.forms: dict[int, tuple[str, int]] = {}
        self._enum_ids: dict[int, int] = {}
        self._vectors: dict[tuple, int] = {}
        self._order: dict[int | None, int] = {}
        self._stack: list[int | None] = [None]
        while True:
            mark = self.c.take(4)
            if mark == b"EOH\0":
                break
            {b"STR\0": self._read_strings, b"TYP\0": self._read_types, b"WKT\0": self._read_known, b"HIE\0": self._read_hierarchy}.get(mark, lambda m=mark: self._unknown(m))()

    def _unknown(self, mark: bytes) -> None:
        raise GhwError(f"unexpected section {mark!r}")

    def _read_strings(self) -> None:
        c = self.c
        c.expect(bytes(4))
        n, _ = c.number("i"), c.number("i")
        self.strings, text = [""], b""
        for _ in range(n):
            start = c.at
            while 31 < (b := c.u8()) and not 128 <= b <= 159:
                pass
            text += c.data[start : c.at - 1]
            self.strings.append(text.decode("latin-1"))
            shared, shift = b & 31, 5
            while b >= 128:
                b = c.u8()
                shared |= (b & 31) << shift
                shift += 5
            text = text[:shared]
        c.expect(b"EOS\0")

    def _string(self) -> str:
        return self.strings[self.c.unsigned()]

    def _type(self) -> Type:
        return self.types[self.c.unsigned() - 1]

    def _range(self) -> tuple[int, int] | None:
        """(left, right)."""
        c = self.c
        kind = c.u8() & 127
        if kind in (B2, E8):
            return c.u8(), c.u8()
        if kind in (I32, I64, P32, P64):
            return c.signed(), c.signed()
        if kind == F64:
            c.take(16)
            return None
        raise GhwError(f"range of kind {kind}")

    def _constrain(self, base: Type) -> Type:
        """The bounded form of a type; bounds follow in the order of its parts."""
        if base.kind == "array":
            bounds = self._range()
            element = base.element if base.element.bounded() else self._constrain(base.element)
            return Type("array", base.name, element=element, range=bounds)
        if base.kind == "record":
            return Type("record", base.name, fields=[(n, t if t.bounded() else self._constrain(t)) for n, t in base.fields])
        raise GhwError(f"no bounds for {base.kind}")

    def _read_types(self) -> None:
        c = self.c
        c.expect(bytes(4))
        for _ in range(c.number("i")):
            kind, name = c.u8(), self._string()
            if kind in (B2, E8):
                made = Type("enum", name, literals=[self._string() for _ in range(c.unsigned())])
            elif kind in (I32, I64):
                made = Type("int", name, width=32 if kind == I32 else 64)
            elif kind in (P32, P64):
                for _ in range(c.unsigned() if self.version else 0):
                    self._string(), c.signed()
                made = Type("phys", name, width=32 if kind == P32 else 64)
            elif kind == F64:
                made = Type("float", name)
            elif kind == SUB_SCALAR:
                made = self._type().named(name)
                self._range()
            elif kind == ARRAY:
                element = self._type()
                if len([self._type() for _ in range(c.unsigned())]) != 1:
                    raise GhwError("arrays of several dimensions are not supported")
                made = Type("array", name, element=element)
            elif kind == RECORD:
                made = Type("record", name, fields=[(self._string(), self._type()) for _ in range(c.unsigned())])
            elif kind == SUB_UNBOUNDED:
                made = self._type().named(name)
            elif kind in (SUB_ARRAY, SUB_RECORD):
                base = self._type()
                made = (base if base.kind == "record" and base.bounded() else self._constrain(base)).named(name)
            else:
                raise GhwError(f"type of kind {kind}")
            self.types.append(made)
        c.expect(b"\0")

    def _read_known(self) -> None:
        self.c.expect(bytes(4))
        while self.c.u8():
            self._type()

    def _place(self, name: str) -> dict:
        parent = self._stack[-1]
        self._order[parent] = self._order.get(parent, -1) + 1
        path = [*(self.scopes[parent]["path"] if parent is not None else []), name]
        return {"parent_id": parent, "ord": self._order[parent], "name": name, "path": path, "full_name": ".".join(path)}

    def _open(self, name: str, scope_type: str) -> None:
        self.scopes.append(self._place(name) | {"scope_id": len(self.scopes), "scope_type": scope_type})
        self._stack.append(len(self.scopes) - 1)

    def _read_hierarchy(self) -> None:
        c = self.c
        c.expect(bytes(4))
        c.number("i"), c.number("i")
        self.count = c.number("i")
        while kind := c.u8():
            if kind == 15:
                self._stack.pop()
            elif kind == 13:
                self._string()
            elif kind in SCOPE_KINDS:
                name = self._string()
                if kind == 5:
                    t = self._type()
                    name = f"{name}({c.u8() if t.kind == 'enum' else c.number('d') if t.kind == 'float' else c.signed()})"
                self._open(name, SCOPE_KINDS[kind])
            elif kind in DIRECTIONS:
                name = self._string()
                self._variable(name, self._type(), DIRECTIONS[kind])
            else:
                raise GhwError(f"hierarchy entry of kind {kind}")

    def _variable(self, name: str, t: Type, direction: str) -> None:
        if t.is_vector():
            left, right = t.range
            ids = [self.c.unsigned() for _ in range(abs(left - right) + 1)]
            if ids:
                self._declare(name, t, direction, "std_logic_vector" if t.element.is_nine() else "bit_vector", ids, t.element, left, right)
        elif t.kind == "array":
            self._open(name, "vhdl_array")
            left, right = t.range
            for i in range(left, right + 1) if left <= right else range(left, right - 1, -1):
                self._variable(f"[{i}]", t.element, direction)
            self._stack.pop()
        elif t.kind == "record":
            self._open(name, "vhdl_record")
            for field, own in t.fields:
                self._variable(field, own, direction)
            self._stack.pop()
        else:
            form = {"nine": "std_logic", "bit": "boolean" if t.literals[:1] == ["false"] else "bit", "byte": "enum", "int": "integer", "real": "real"}[t.scalar_form()]
            self._declare(name, t, direction, form, [self.c.unsigned()], t)

    def _declare(self, name: str, t: Type, direction: str, var_type: str, ids: list[int], scalar: Type, msb: int | None = None, lsb: int | None = None) -> None:
        form, enum = scalar.scalar_form(), None
        width = max(1, (len(scalar.literals) - 1).bit_length()) if form == "byte" else scalar.width if form == "int" else len(ids)
        if form == "byte":
            enum = self._enum_ids.setdefault(id(scalar.literals), len(self.enums))
            if enum == len(self.enums):
                self.enums.append({"enum_id": enum, "name": scalar.name, "mapping": [{"value": f"{k:0{width}b}", "label": x} for k, x in enumerate(scalar.literals)]})
        for i in ids:
            self.forms[i] = (form, width)
        key = tuple(ids)
        signal = self._vectors.setdefault(key, len(self.signals))
        if signal == len(self.signals):  # variables of the same elements share a signal
            self.signals.append({"signal_id": signal, "encoding": "real" if form == "real" else "bits", "width": 0 if form == "real" else width, "kind": "ground", "id_code": str(ids[0])})
            self.elements += [{"signal_id": signal, "pos": k, "element": i} for k, i in enumerate(ids)]
        self.vars.append(self._place(name) | {"var_id": len(self.vars), "var_type": var_type, "direction": direction, "msb": msb, "lsb": lsb, "signal_id": signal, "enum_id": enum, "vhdl_type_name": t.name or None})

    def _value(self, element: int) -> tuple[str | None, float | None]:
        form, width = self.forms.get(element, ("nine", 1))
        if form == "nine":
            return STD_LOGIC[self.c.u8()], None
        if form == "bit":
            return str(self.c.u8()), None
        if form == "byte":
            return f"{self.c.u8():0{width}b}", None
        if form == "real":
            return None, struct.unpack("<d", self.c.take(8))[0]
        return f"{self.c.signed() & ((1 << width) - 1):0{width}b}", None

    def changes(self) -> Iterator[tuple[int, int, int, str | None, float | None]]:
        """(element, time, seq, bits, real) in file order; element 0 marks a time step."""
        c, seq = self.c, 0
        while True:
            mark = c.take(4)
            if mark == b"SNP\0":
                c.expect(bytes(4))
                time = c.number("q")
                yield 0, time, seq, None, None
                for e in range(1, self.count + 1):
                    seq += 1
                    yield e, time, seq, *self._value(e)
                c.expect(b"ESN\0")
            elif mark == b"CYC\0":
                time = c.number("q")
                while True:
                    yield 0, time, seq, None, None
                    e = 0
                    while step := c.unsigned():
                        e += step
                        seq += 1
                        yield e, time, seq, *self._value(e)
                    delta = c.signed()
                    if delta < 0:
                        break
                    time += delta
                c.expect(b"ECY\0")
            elif mark == b"DIR\0":
                c.expect(bytes(4))
                for _ in range(c.number("i")):
                    c.take(8)
                c.expect(b"EOD\0")
            elif mark == b"TAI\0":
                return
            else:
                self._unknown(mark)

    def signal_changes(self) -> Iterator[tuple[int | None, int, int, str | None, float | None]]:
        """(signal, time, seq, bits, real) in file order; without a signal a time step.

        A vector changes once in a step, after its last element, unless all elements
        have changed or one changes again to another value: then what it was before
        is a change too (a delta cycle).
        """
        places: dict[int, list[tuple[int, int]]] = {}
        sizes: dict[int, int] = {}
        for r in self.elements:
            places.setdefault(r["element"], []).append((r["signal_id"], r["pos"]))
            sizes[r["signal_id"]] = r["pos"] + 1
        state = {s: ["u"] * n for s, n in sizes.items() if n > 1}
        open_bits: dict[int, set[int]] = {}  # elements changed since the vector's last change of this step
        at = seq = 0
        for element, time, seq, bits, real in self.changes():
            if element == 0:
                if time != at:
                    for s in open_bits:
                        yield s, at, seq, "".join(state[s]), None
                    open_bits = {}
                at = time
                yield None, time, seq, None, None
                continue
            for s, pos in places.get(element, ()):
                if sizes[s] == 1:
                    yield s, time, seq, bits, real
                    continue
                changed = open_bits.setdefault(s, set())
                if pos in changed and state[s][pos] != bits:
                    yield s, time, seq, "".join(state[s]), None
                    changed.clear()
                state[s][pos] = bits
                changed.add(pos)
                if len(changed) == sizes[s]:
                    yield s, time, seq, "".join(state[s]), None
                    del open_bits[s]
        for s in open_bits:
            yield s, at, seq + 1, "".join(state[s]), None

    def rows(self) -> Iterator[tuple[str, dict]]:
        yield "meta", {"file_format": "ghw", "timescale_factor": 1, "timescale_unit": "fs", "timescale_exponent": -15, "comments": []}
        for kind, found in (("scopes", self.scopes), ("vars", self.vars), ("signals", self.signals), ("enums", self.enums), ("elements", self.elements)):
            for r in found:
                yield kind, r


TABLES = {"meta": model.META, "scopes": model.SCOPES, "vars": model.VARS, "signals": model.SIGNALS, "enums": model.ENUMS, "elements": "file string, signal_id bigint, pos int, element bigint"}
DECODED = "file string, signal_id bigint, time bigint, seq bigint, bits string, real double"
ROWS = 1 << 16


class GhwFiles:
    """All GHW files of a path; every table has the file as its first column."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._catalog: DataFrame | None = None
        self._decoded: DataFrame | None = None

    def _files(self) -> DataFrame:
        """(files): the files that one task reads, a row for each task. Tasks grow with bytes and not with files."""
        sizes = sorted(listed(self.path).items())
        tasks = [[r.file for r in p.ranges] for p in packed((Bytes(f, 0, n, n, True) for f, n in sizes), SPLIT_BYTES)]
        return self.spark.createDataFrame(self.spark.sparkContext.parallelize([(t,) for t in tasks], len(tasks) or 1), "files array<string>")

    def table(self, name: str) -> DataFrame:
        """meta, scopes, vars, signals, enums or elements (which scalar is which bit of a signal, from the most significant)."""
        if self._catalog is None:

            def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for file, data in contents(batches):
                    for some in batched(GhwFile(data).rows(), ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array([k for k, _ in some]), pa.array([json.dumps(r) for _, r in some])], ["file", "kind", "row"])

            self._catalog = materialize(self._files().mapInArrow(lambda batches: gathered(parse(batches)), "file string, kind string, row string"), "catalog")
        schema = TABLES[name].removeprefix("file string, ")
        return self._catalog.filter(F.col("kind") == name).select("file", F.from_json("row", schema).alias("r")).select("file", "r.*")

    def decoded(self) -> DataFrame:
        """All changes as they stand in the files; rows without a signal are the time steps."""
        if self._decoded is None:

            def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names = [f.split()[0] for f in DECODED.split(", ")]
                for file, data in contents(batches):
                    for some in batched(GhwFile(data).signal_changes(), ROWS):
                        yield _batch([(file, *row) for row in some], names)

            self._decoded = materialize(self._files().mapInArrow(lambda batches: gathered(decode(batches)), DECODED), "decoded")
        return self._decoded

    def steps(self) -> DataFrame:
        return self.decoded().filter("signal_id is null").select("file", "time").distinct()

    def changes(self, signals: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """(file, signal_id, time, seq, kind, bits, str, real), delta cycles included. start and end are included."""
        out = self.decoded().filter("signal_id is not null")
        if start is not None:
            out = out.filter(F.col("time") >= start)
        if end is not None:
            out = out.filter(F.col("time") <= end)
        if signals is not None:
            out = out.join(signals.select("file", "signal_id"), ["file", "signal_id"], "left_semi")
        kind = F.when(F.col("real").isNotNull(), 3).otherwise(1).cast("tinyint")
        return out.select("file", "signal_id", "time", "seq", kind.alias("kind"), "bits", F.lit(None).cast("string").alias("str"), "real")


def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(file, its bytes), one after another."""
    for b in batches:
        for file in (f for files in b.column(0).to_pylist() for f in files):
            fs, path = opened(file)
            with fs.open_input_file(path) as f:
                yield file, f.read()


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
