"""FST files as DataFrames, after the published description of the format.

Value-change blocks are independent: a task decodes one block, and blocks of a file
(and files) are spread over tasks. The header, geometry and hierarchy blocks make the
catalog. A block begins with the state of all signals, which gives the changes of the
first block's start; later blocks repeat known state, which de-duplication drops.

Blocks: 0 header, 1, 5 and 8 value changes, 3 geometry, 4, 6 and 7 hierarchy, 254 a
gzip-wrapped file. Files that lack their hierarchy take it from `<file>.hier`.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide import model
from tracetide.sources.ghw import Cursor
from tracetide.storage import materialize


class FstError(ValueError):
    pass


# Codes of the format, in their order.
SCOPE_CODES = "module task function begin fork generate struct union class interface package program vhdl_architecture vhdl_procedure vhdl_function vhdl_record vhdl_process vhdl_block vhdl_for_generate vhdl_if_generate vhdl_generate vhdl_package".split()
VAR_CODES = "event integer parameter real real_parameter reg supply0 supply1 time tri triand trior trireg tri0 tri1 wand wire wor port sparray realtime string bit logic int shortint longint byte enum shortreal".split()
DIRECTION_CODES = "implicit input output inout buffer linkage".split()
ODD_STATES = "xzhuwl-?"
HEADER, GEOMETRY, WRAPPED = 0, 3, 254
CHANGES = (1, 5, 8)
HIERARCHY = (4, 6, 7)
ATTRIBUTE_BEGIN, ATTRIBUTE_END, SCOPE, UPSCOPE = 252, 253, 254, 255
SYNC = 2.7182818284590452354


def lz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def fastlz(data: bytes, size: int) -> bytes:
    """Literal runs and back references; the first byte's upper bits are the level."""
    out, at, n = bytearray(), 0, len(data)
    level = (data[0] >> 5) + 1 if data else 1
    first = True
    while at < n:
        op = data[at] & 31 if first else data[at]
        first, at = False, at + 1
        length, distance = op >> 5, (op & 31) << 8
        if op < 32:
            out += data[at : at + op + 1]
            at += op + 1
            continue
        length -= 1
        if length == 6:
            while True:
                length += data[at]
                at += 1
                if level == 1 or data[at - 1] != 255:
                    break
        low = data[at]
        at += 1
        if level == 2 and low == 255 and distance == 31 << 8:
            distance = (data[at] << 8) + data[at + 1] + 8191
            at += 2
        else:
            distance += low
        start = len(out) - distance - 1
        for k in range(length + 3):
            out.append(out[start + k])
    if len(out) != size:
        raise FstError("a packed block has another size than it says")
    return bytes(out)


def unpack(kind: str, data: bytes, size: int) -> bytes:
    return {"4": lz4, "F": fastlz}[kind](data, size) if kind in "4F" else zlib.decompress(data)


def inflate(data: bytes, size: int) -> bytes:
    return data if len(data) == size else zlib.decompress(data)


def sections(data: bytes) -> list[tuple[int, int, int]]:
    """(type, start, end) of each block's contents, after its length."""
    out, at = [], 0
    while at + 9 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 9], "big")
        if size < 8 or at + 1 + size > len(data):
            break  # an unfinished block
        out.append((data[at], at + 9, at + 1 + size))
        at += 1 + size
    return out


def opened(data: bytes) -> bytes:
    if data[:1] == bytes([WRAPPED]):
        return gzip.decompress(data[17:])
    return data


class FstFile:
    """The catalog of a file and where its blocks are."""

    def __init__(self, data: bytes, hierarchy: bytes | None = None):
        self.data = data = opened(data)
        self.blocks = sections(data)
        if not self.blocks or self.blocks[0][0] != HEADER:
            raise FstError("not an FST file")
        self._header(Cursor(data, self.blocks[0][1], ">"))
        self.lengths: list[int] = []  # by signal: bits; -1 real, 0 string or event
        self.scopes: list[dict] = []
        self.vars: list[dict] = []
        self.enums: list[dict] = []
        for kind, a, b in self.blocks:
            if kind == GEOMETRY:
                self._geometry(a, b)
        found = next(((k, a, b) for k, a, b in self.blocks if k in HIERARCHY), None)
        if found:
            kind, a, b = found
            size, raw = int.from_bytes(data[a : a + 8], "big"), data[a + 8 : b]
            if kind == 4:
                hierarchy = gzip.decompress(raw)
            elif kind == 6:
                hierarchy = lz4(raw, size)
            else:
                c = Cursor(raw)
                middle = c.unsigned()
                hierarchy = lz4(lz4(raw[c.at :], middle), size)
        if hierarchy is None:
            raise FstError("no hierarchy block, and no .hier file beside it")
        self._hierarchy(hierarchy)

    def _header(self, c: Cursor) -> None:
        self.start, self.end = c.number("Q"), c.number("Q")
        raw = c.take(8)
        self.reals = "<" if struct.unpack("<d", raw)[0] == SYNC else ">"
        c.take(8 * 5)
        self.exponent = c.number("b")
        text = lambda n: c.take(n).split(b"\0", 1)[0].decode("latin-1").strip()
        self.version, self.date = text(128), text(26)
        c.take(93 + 1)
        self.zero = c.number("q")

    def _geometry(self, a: int, b: int) -> None:
        c = Cursor(self.data, a, ">")
        size, count = c.number("Q"), c.number("Q")
        g = Cursor(inflate(self.data[c.at : b], size))
        for _ in range(count):
            n = g.unsigned()
            self.lengths.append(-1 if n == 0 else 0 if n == 0xFFFFFFFF else n)

    def _hierarchy(self, data: bytes) -> None:
        c, stack, order, handle = Cursor(data), [None], {}, 0
        attributes: dict = {}
        paths: dict[int, str] = {}
        tables: dict[int, int] = {}

        def text() -> str:
            end = data.index(b"\0", c.at)
            out = data[c.at : end].decode("latin-1")
            c.at = end + 1
            return out

        def place(name: str) -> dict:
            parent = stack[-1]
            order[parent] = order.get(parent, -1) + 1
            path = [*(self.scopes[parent]["path"] if parent is not None else []), name]
            return {"parent_id": parent, "ord": order[parent], "name": name, "path": path, "full_name": ".".join(path)}

        while c.at < len(data):
            tag = c.u8()
            if tag == SCOPE:
                code, name, component = c.u8(), text(), text()
                decl, inst = attributes.get("decl", (None, None)), attributes.get("inst", (None, None))
                self.scopes.append(place(name) | {"scope_id": len(self.scopes), "scope_type": SCOPE_CODES[code] if code < len(SCOPE_CODES) else "unknown", "component": component or None, "decl_path": decl[0], "decl_line": decl[1], "inst_path": inst[0], "inst_line": inst[1]})
                stack.append(len(self.scopes) - 1)
                attributes = {}
            elif tag == UPSCOPE:
                if len(stack) > 1:
                    stack.pop()
            elif tag == ATTRIBUTE_BEGIN:
                kind, sub, name, arg = c.u8(), c.u8(), text(), c.unsigned()
                if kind == 0 and sub == 2:  # VHDL type
                    attributes["vhdl"] = (name, arg >> 10, arg & 1023)
                elif kind == 0 and sub == 3:  # a path's number
                    paths[arg] = name
                elif kind == 0 and sub in (4, 5):  # source line; the name is a path's number
                    attributes["decl" if sub == 4 else "inst"] = (paths.get(int.from_bytes(name.encode("latin-1"), "little") if not name.isdigit() else int(name)), arg)
                elif kind == 0 and sub == 7:  # enum table, or a reference to one
                    words = name.split()
                    if words:
                        n = int(words[1])
                        tables[arg] = len(self.enums)
                        self.enums.append({"enum_id": len(self.enums), "name": words[0], "mapping": [{"value": v, "label": x} for x, v in zip(words[2 : 2 + n], words[2 + n : 2 + 2 * n], strict=True)]})
                    else:
                        attributes["enum"] = tables.get(arg)
            elif tag == ATTRIBUTE_END:
                pass
            elif tag < len(VAR_CODES):
                direction, name, _, alias = c.u8(), text(), c.unsigned(), c.unsigned()
                if not alias:
                    handle += 1
                signal = (alias or handle) - 1
                base, _, suffix = name.partition(" ")
                msb = lsb = None
                if suffix.startswith("[") and suffix.endswith("]"):
                    hi, _, lo = suffix[1:-1].partition(":")
                    if hi.lstrip("-").isdigit():
                        name, msb, lsb = base, int(hi), int(lo or hi)
                vhdl = attributes.get("vhdl")
                var_type = model.VHDL_DATA_TYPES.get(vhdl[2], VAR_CODES[tag]) if vhdl else VAR_CODES[tag]
                self.vars.append(place(name) | {"var_id": len(self.vars), "var_type": var_type, "direction": DIRECTION_CODES[direction] if direction < len(DIRECTION_CODES) else "unknown", "msb": msb, "lsb": lsb, "signal_id": signal, "enum_id": attributes.get("enum"), "vhdl_type_name": vhdl[0] if vhdl else None, "event": VAR_CODES[tag] == "event"})
                attributes = {}
            else:
                raise FstError(f"hierarchy entry {tag}")

    def rows(self) -> Iterator[tuple[str, dict]]:
        factor, unit = 10 ** (self.exponent % 3), self.exponent - self.exponent % 3
        names = {e: n for n, e in model.TIME_UNITS.items()}
        yield "meta", {"file_format": "fst", "date": self.date, "version": self.version, "timescale_factor": factor, "timescale_unit": names.get(unit, "unknown"), "timescale_exponent": unit if unit in names else None, "comments": []}
        events = {v["signal_id"] for v in self.vars if v["event"]}
        for i, n in enumerate(self.lengths):
            encoding = "event" if i in events else "real" if n == -1 else "string" if n == 0 else "bits"
            yield "signals", {"signal_id": i, "encoding": encoding, "width": n if encoding == "bits" else 0, "kind": "ground", "id_code": str(i + 1)}
        for kind, found in (("scopes", self.scopes), ("vars", self.vars), ("enums", self.enums)):
            for r in found:
                yield kind, r
        for k, (kind, a, b) in enumerate(x for x in self.blocks if x[0] in CHANGES):
            yield "blocks", {"block": k, "block_type": kind, "first": a, "last": b}


def block_changes(kind: int, data: bytes, lengths: list[int], reals: str, first_block: bool, wanted: set[int] | None = None) -> Iterator[tuple[int, int, int, str | None, float | None]]:
    """(signal, time, seq, text, real) of one value-change block; signal -1 marks a time. Chains of signals that are not wanted stay packed."""
    c = Cursor(data, 0, ">")
    begin, _, _ = c.number("Q"), c.number("Q"), c.number("Q")
    size, packed, count = c.unsigned(), c.unsigned(), c.unsigned()
    frame = Cursor(inflate(c.take(packed), size))

    def value(n: int, raw: bytes) -> tuple[str | None, float | None]:
        if n == -1:
            return None, struct.unpack(reals + "d", raw)[0]
        return raw.decode("latin-1").lower() if n else raw.decode("latin-1"), None

    if first_block:
        yield -1, begin, -1, None, None
    for i in range(count):
        n = lengths[i]
        if n:
            found = value(n, frame.take(8 if n == -1 else n))
            if first_block and (wanted is None or i in wanted):
                yield i, begin, -1, *found
    signals, pack = c.unsigned(), chr(c.u8())
    base = c.at - 1

    tail = Cursor(data, len(data) - 24, ">")
    time_size, time_packed, time_count = tail.number("Q"), tail.number("Q"), tail.number("Q")
    times_at = len(data) - 24 - time_packed
    t = Cursor(inflate(data[times_at : len(data) - 24], time_size))
    times, now = [], 0
    for _ in range(time_count):
        now += t.unsigned()
        times.append(now)
    yield from ((-1, x, -1, None, None) for x in times)

    chain_size = int.from_bytes(data[times_at - 8 : times_at], "big")
    p = Cursor(data, times_at - 8 - chain_size)
    starts: list[int] = []  # 0: no changes; negative: as another signal
    at = alias = 0
    while len(starts) < signals and p.at < times_at - 8:
        if kind == 8:
            if data[p.at] & 1:
                step = p.signed() >> 1
                if step > 0:
                    at += step
                    starts.append(at)
                else:
                    alias = step or alias
                    starts.append(alias)
            else:
                starts += [0] * (p.unsigned() >> 1)
        else:
            v = p.unsigned()
            if v == 0:
                starts.append(-p.unsigned())
            elif v & 1:
                at += v >> 1
                starts.append(at)
            else:
                starts += [0] * (v >> 1)
    stops = dict(zip(own := [s for s in starts if s > 0], [*own[1:], times_at - 8 - chain_size - base], strict=True))
    for i, s in enumerate(starts):
        s = starts[-s - 1] if s < 0 else s
        if s <= 0 or (wanted is not None and i not in wanted):
            continue
        v = Cursor(data, base + s)
        size = v.unsigned()
        raw = data[v.at : base + stops[s]]
        yield from chain(i, lengths[i], unpack(pack, raw, size) if size else raw, times, value)


def chain(signal: int, n: int, raw: bytes, times: list[int], value) -> Iterator[tuple[int, int, int, str | None, float | None]]:
    """The changes of one signal in a block."""
    v, at, seq = Cursor(raw), 0, 0
    while v.at < len(raw):
        head = v.unsigned()
        if n == 1:
            odd = head & 1
            at += head >> (4 if odd else 2)
            found: tuple = (ODD_STATES[(head >> 1) & 7] if odd else str((head >> 1) & 1), None)
        elif n == 0:
            at += head >> 1
            found = value(0, v.take(v.unsigned()))
        elif head & 1 or n == -1:
            at += head >> 1
            found = value(n, v.take(8 if n == -1 else n))
        else:
            at += head >> 1
            found = (f"{int.from_bytes(v.take((n + 7) // 8), 'big') >> (-n % 8):0{n}b}", None)
        yield signal, times[at], seq, *found
        seq += 1


TABLES = {"meta": model.META, "scopes": model.SCOPES, "vars": model.VARS, "signals": model.SIGNALS, "enums": model.ENUMS, "blocks": "file string, block int, block_type int, first bigint, last bigint"}
RAW = "file string, block int, signal_id bigint, time bigint, seq bigint, text string, real double"
ROWS = 1 << 16


BLOCK = "file string, block int, kind int, first bigint, last bigint, content binary, lengths array<int>, reals string"


class FstFiles:
    """All FST files of a path; every table has the file as its first column."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._catalog: DataFrame | None = None
        self._cut: DataFrame | None = None

    def _files(self) -> DataFrame:
        """(file, content, hier): hier is the content of a .hier file beside it, if there is one."""
        found = self.spark.read.format("binaryFile").load(self.path.rstrip("/") + "{,.hier}")
        own = found.filter(~F.col("path").endswith(".hier")).select(F.col("path").alias("file"), "content")
        beside = found.filter(F.col("path").endswith(".hier")).select(F.regexp_replace("path", r"\.hier$", "").alias("file"), F.col("content").alias("hier"))
        return own.join(beside, "file", "left").select("file", "content", "hier")

    def table(self, name: str) -> DataFrame:
        if self._catalog is None:

            def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for file, data, hier in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                        found = list(parsed(data, hier).rows())
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array([k for k, _ in found]), pa.array([json.dumps(r) for _, r in found])], ["file", "kind", "row"])

            self._catalog = materialize(self._files().mapInArrow(parse, "file string, kind string, row string"), "catalog")
        schema = TABLES[name].removeprefix("file string, ")
        return self._catalog.filter(F.col("kind") == name).select("file", F.from_json("row", schema).alias("r")).select("file", "r.*")

    def _blocks(self) -> DataFrame:
        """The value-change blocks, cut out of their files but still packed, with their first and last times."""
        if self._cut is None:

            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for file, data, hier in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                        f = parsed(data, hier)
                        for k, (kind, a, z) in enumerate(x for x in f.blocks if x[0] in CHANGES):
                            span = [pa.array([t], pa.int64()) for t in struct.unpack_from(">QQ", f.data, a)]
                            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int32()), pa.array([kind], pa.int32()), *span, pa.array([f.data[a:z]], pa.binary()), pa.array([f.lengths], pa.list_(pa.int32())), pa.array([f.reals])], names_of(BLOCK))

            self._cut = materialize(self._files().mapInArrow(cut, BLOCK), "blocks")
        return self._cut

    def _raw(self, blocks: DataFrame) -> DataFrame:
        """Changes in the blocks, which have a column wanted (signals, or null for all of them), a task for each block; signal -1 marks the times."""

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]

            def send(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names_of(RAW))

            for b in batches:
                for file, block, kind, data, lengths, reals, wanted in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                    held: list[tuple] = []
                    for row in block_changes(kind, data, lengths, reals, block == 0, None if wanted is None else set(wanted)):
                        held.append((file, block, *row))
                        if len(held) == ROWS:
                            yield send(held)
                            held = []
                    if held:
                        yield send(held)

        packed = blocks.select("file", "block", "kind", "content", "lengths", "reals", "wanted")
        return packed.repartition("file", "block").mapInArrow(decode, RAW)

    def steps(self) -> DataFrame:
        none = F.array().cast("array<bigint>").alias("wanted")
        return self._raw(self._blocks().select("*", none)).filter("signal_id = -1").select("file", "time").distinct()

    def changes(self, signals: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """(file, signal_id, time, seq, kind, bits, str, real); seq orders the changes of a signal. start and end are included.

        Blocks outside the times are not read, and signals that are not asked for are not unpacked.
        """
        known, blocks = self.table("signals"), self._blocks()
        if signals is None:
            blocks = blocks.withColumn("wanted", F.lit(None).cast("array<bigint>"))
        else:
            known = known.join(signals.select("file", "signal_id"), ["file", "signal_id"], "left_semi")
            # no longer than lengths, which each block has anyway
            blocks = blocks.join(known.groupBy("file").agg(F.collect_set("signal_id").alias("wanted")), "file")
        if start is not None:
            blocks = blocks.filter(F.col("last") >= start)
        if end is not None:
            blocks = blocks.filter(F.col("first") <= end)
        raw = self._raw(blocks).filter("signal_id >= 0")
        if start is not None:
            raw = raw.filter(F.col("time") >= start)
        if end is not None:
            raw = raw.filter(F.col("time") <= end)
        found = raw.join(known, ["file", "signal_id"])
        encoding = F.col("encoding")
        kind = F.when(encoding == "event", 0).when(encoding == "bits", 1).when(encoding == "string", 2).otherwise(3).cast("tinyint")
        return found.select("file", "signal_id", "time", F.struct("block", "seq").alias("seq"), kind.alias("kind"), F.when(encoding == "bits", F.col("text")).alias("bits"), F.when(encoding == "string", F.col("text")).alias("str"), "real")


def parsed(data: bytes, hier: bytes | None) -> FstFile:
    return FstFile(data, gzip.decompress(hier) if hier and hier[:2] == b"\x1f\x8b" else hier)


def names_of(schema: str) -> list[str]:
    return re.findall(r"(\w+) [a-z]", schema)
