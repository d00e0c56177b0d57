"""VCD files as DataFrames.

The body is read by Spark's splittable text source with a record for each line
that begins with #. A first look, by built-in functions, finds where each file's
header ends and which splits begin inside a comment. The header is parsed once
into catalog tables. The body is then tokenised in order, a split at a time, and
its values are decoded by built-in expressions. Steps that go back in time are
dropped with their changes: each split decides for itself, but for steps at or
before the latest time of the splits above it, of which there is one row each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracetide import model
from tracetide.functions import values
from tracetide.storage import materialize


class VcdError(ValueError):
    pass


COMMANDS = frozenset("date timescale var scope upscope comment version enddefinitions attrbegin attrend".split())
COMMAND = re.compile(r"\$(\S+)\s*(.*?)\s*\$end(?=\s|\Z)", re.S)
SPACE = re.compile(r"\s*")
SUFFIX = re.compile(r"^(.*?)\s*\[\s*(-?\d+)\s*(?::\s*(-?\d+)\s*)?\]$", re.S)


def is_vcd(start: str) -> bool:
    """The text begins with a complete header command."""
    m = COMMAND.match(start.lstrip())
    return bool(m) and m[1] in COMMANDS


def split_name(raw: str, width: int) -> tuple[str, int | None, int | None, list[str]]:
    """(name, msb, lsb, scopes of an array): an index counts as bits only if it covers the declared width."""
    name, msb, lsb = raw, None, None
    if m := SUFFIX.match(raw):
        hi, lo = int(m[2]), int(m[3] if m[3] is not None else m[2])
        if abs(hi - lo) + 1 == width:
            name, msb, lsb = m[1], hi, lo
    parts: list[str] = []
    while name.endswith("]") and "[" in name[1:]:
        at = name.rindex("[")
        parts.append(name[at:])
        name = name[:at].rstrip(" ")
    if not parts:
        return name, msb, lsb, []
    return parts[0], msb, lsb, [name, *parts[:0:-1]]


class Header:
    """The catalog of one file."""

    def __init__(self, text: str, flatten_unnamed: bool = False):
        self.flatten = flatten_unnamed
        self.meta: dict = {"date": None, "version": None, "timescale_factor": None, "timescale_unit": None, "timescale_exponent": None, "comments": []}
        self.scopes: list[dict] = []
        self.vars: list[dict] = []
        self.signals: dict[str, dict] = {}
        self.derived: list[dict] = []
        self.enums: list[dict] = []
        self._children: dict[tuple, int] = {}
        self._order: dict[int | None, int] = {}
        self._stack: list[int | None] = [None]
        self._attributes: list[tuple] = []
        self._paths: dict[int, str] = {}
        self._tables: dict[int, int] = {}
        self._extra = 0
        self.end = self._read(text)
        self._merge_bits()

    def _read(self, text: str) -> int:
        at = 0
        while True:
            at = SPACE.match(text, at).end()
            m = COMMAND.match(text, at)
            if not m:
                raise VcdError("header ends without $enddefinitions" if text[at : at + 1] in ("", "$") else f"unknown or invalid command: {text[at : at + 30]!r}")
            at = m.end()
            word, body = m[1], m[2]
            if word not in COMMANDS:
                raise VcdError(f"unknown or invalid command: {word}")
            if word == "enddefinitions":
                return at
            getattr(self, f"_{word}")(body)

    def _once(self, key: str, value) -> None:
        if self.meta[key] is not None:
            raise VcdError(f"a second ${key.removesuffix('_factor')}")
        self.meta[key] = value

    def _date(self, body: str) -> None:
        self._once("date", body)

    def _version(self, body: str) -> None:
        self._once("version", body)

    def _comment(self, body: str) -> None:
        self.meta["comments"].append(body)

    def _timescale(self, body: str) -> None:
        m = re.fullmatch(r"(\d+)\s*(\S*)", body)
        if not m:
            raise VcdError(f"timescale: {body!r}")
        self._once("timescale_factor", int(m[1]))
        known = m[2] in model.TIME_UNITS
        self.meta |= {"timescale_unit": m[2] if known else "unknown", "timescale_exponent": model.TIME_UNITS.get(m[2])}

    def _attrend(self, body: str) -> None:
        pass

    def _attrbegin(self, body: str) -> None:
        t = body.split()
        if not t or t[0] != "misc" or len(t) < 4:
            raise VcdError(f"attribute: {body!r}")
        kind, args = t[1], t[2:]
        if kind == "02" and len(args) == 2:
            self._attributes.append(("vhdl", args[0], int(args[1]) >> 10, int(args[1]) & 1023))
        elif kind == "03" and len(args) == 2:
            self._paths[int(args[1])] = args[0]
        elif kind in ("04", "05") and len(args) == 2:
            self._attributes.append(("decl" if kind == "04" else "inst", self._paths[int(args[0])], int(args[1])))
        elif kind == "07" and args[0] == '""' and len(args) == 2:
            self._attributes.append(("enum", self._tables[int(args[1])]))
        elif kind == "07" and len(args) == 3 + 2 * int(args[1]):
            n = int(args[1])
            self._tables[int(args[-1])] = len(self.enums)
            self.enums.append({"enum_id": len(self.enums), "name": args[0], "mapping": [{"value": v, "label": x} for x, v in zip(args[2 : 2 + n], args[2 + n : 2 + 2 * n], strict=True)]})
        else:
            raise VcdError(f"unsupported attribute: {body!r}")

    def _taken(self) -> dict:
        found: dict = {}
        for kind, *rest in self._attributes:
            found[kind] = rest
        self._attributes = []
        return found

    def _position(self, parent: int | None) -> int:
        self._order[parent] = self._order.get(parent, -1) + 1
        return self._order[parent]

    def _open(self, parent: int | None, name: str, scope_type: str, attributes: dict) -> int:
        """A second scope of one name under one parent is the first."""
        found = self._children.get((parent, name))
        if found is None:
            found = self._children[parent, name] = len(self.scopes)
            path = [*(self.scopes[parent]["path"] if parent is not None else []), name]
            decl, inst = attributes.get("decl", (None, None)), attributes.get("inst", (None, None))
            self.scopes.append({"scope_id": found, "parent_id": parent, "ord": self._position(parent), "name": name, "path": path, "scope_type": scope_type, "decl_path": decl[0], "decl_line": decl[1], "inst_path": inst[0], "inst_line": inst[1]})
        return found

    def _scope(self, body: str) -> None:
        kind, _, name = body.partition(" ")
        kind, name = kind.strip(), name.strip()
        if kind not in model.SCOPE_TYPES:
            raise VcdError(f"unknown scope type: {kind}")
        attributes = self._taken()
        if not name and self.flatten:
            self._stack.append(self._stack[-1])
        else:
            self._stack.append(self._open(self._stack[-1], name, kind, attributes))

    def _upscope(self, body: str) -> None:
        if len(self._stack) > 1:
            self._stack.pop()

    def _var(self, body: str) -> None:
        t = body.split(None, 3)
        if len(t) < 4:
            raise VcdError(f"variable: {body!r}")
        kind, size, code, raw = t
        if kind not in model.VAR_TYPES:
            raise VcdError(f"unknown variable type: {kind}")
        width = int(size)
        encoding = "string" if kind == "string" else "real" if kind in model.REAL_TYPES else "event" if kind == "event" or width == 0 else "bits"
        width = width if encoding == "bits" else 0
        attributes = self._taken()
        name, msb, lsb, arrays = split_name(raw, width) if not raw.startswith("[") else (raw, None, None, [])
        parent = self._stack[-1]
        if arrays and parent is not None and self.scopes[parent]["name"] == arrays[0]:
            arrays = arrays[1:]  # elements declared inside their array's scope repeat its name
        for a in arrays:
            parent = self._open(parent, a, "sv_array", {})
        signal = self.signals.setdefault(code, {"signal_id": len(self.signals), "encoding": encoding, "width": width, "kind": "ground", "id_code": code})
        vhdl = attributes.get("vhdl")
        var_type = model.VHDL_DATA_TYPES.get(vhdl[2], kind) if vhdl else kind
        if encoding == "event":
            var_type = "event_parameter" if kind == "parameter" else "event"
        self.vars.append({"parent_id": parent, "ord": self._position(parent), "name": name, "var_type": var_type, "direction": "unknown", "msb": msb, "lsb": lsb, "signal_id": signal["signal_id"], "enum_id": attributes["enum"][0] if "enum" in attributes else None, "vhdl_type_name": vhdl[0] if vhdl else None, "encoding": encoding, "width": width, "array": bool(arrays)})

    def _merge_bits(self) -> None:
        """Neighbouring bit vectors of one name in one scope whose indexes continue each other become one derived variable."""
        out: list[dict] = []
        for v in self.vars:
            last = out[-1] if out else None
            if last and last["parent_id"] == v["parent_id"] is not None and last["name"] == v["name"] and last["encoding"] == v["encoding"] == "bits" and None not in (last["lsb"], v["msb"]) and last["ord"] + len(last["parts"]) == v["ord"] and last["lsb"] - 1 == v["msb"] and last["msb"] >= last["lsb"] and v["msb"] >= v["lsb"]:
                last["parts"].append(v)
                last["lsb"] = v["lsb"]
            else:
                out.append(v | {"parts": [v]})
        made: dict[tuple, int] = {}
        for i, v in enumerate(out):
            parts = v.pop("parts")
            if len(parts) > 1:
                definition = tuple((p["signal_id"], p["width"]) for p in parts)
                if definition not in made:
                    made[definition] = len(self.signals) + len(made)
                    self.derived += [{"signal_id": made[definition], "pos": k, "input_signal_id": s, "msb": w - 1, "lsb": 0} for k, (s, w) in enumerate(definition)]
                v["signal_id"], v["width"] = made[definition], sum(w for _, w in definition)
            v["var_id"] = i
            v["path"] = [*(self.scopes[v["parent_id"]]["path"] if v["parent_id"] is not None else []), v["name"]]
        self.vars = out
        self._made = made

    def rows(self) -> Iterator[tuple[str, dict]]:
        yield "meta", self.meta | {"file_format": "vcd"}
        for kind, found in (("scopes", self.scopes), ("vars", self.vars)):
            for r in found:
                yield kind, r | {"full_name": ".".join(r["path"])}
        for r in self.signals.values():
            yield "signals", r
        for definition, i in self._made.items():
            yield "signals", {"signal_id": i, "encoding": "bits", "width": sum(w for _, w in definition), "kind": "derived", "id_code": None}
        for r in self.derived:
            yield "derived", r
        for r in self.enums:
            yield "enums", r


TABLES = {"meta": model.META, "scopes": model.SCOPES, "vars": model.VARS, "signals": model.SIGNALS, "derived": model.DERIVED, "enums": model.ENUMS}

TIME = re.compile(r"(\d+)(?:\.0*)?")
LONG, SCALAR = frozenset("bBrRsS"), frozenset("01xXzZhHuUwWlL-")
IGNORED = frozenset(("$dumpvars", "$dumpon", "$dumpoff", "$end"))
TOKENS = "split bigint, pos bigint, time bigint, own boolean, first boolean, letter string, code string, rest string"
NAMES = [c.split()[0] for c in TOKENS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string()]
ROWS = 1 << 16
NEVER = np.iinfo(np.int64).min


def flags(letters) -> np.ndarray:
    """Whether a byte is one of these."""
    found = np.zeros(256, bool)
    found[[ord(c) for c in letters]] = True
    return found


IS_SPACE, IS_LONG, IS_SCALAR = flags([chr(i) for i in range(128) if chr(i).isspace()]), flags(LONG), flags(SCALAR)


def pieces(data: bytes, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[begin:end], in order and without overlap, cut in one go."""
    n = len(begin)
    if not n:
        return pa.array([], pa.string())
    bounds = np.empty(2 * n, np.int32)
    bounds[::2], bounds[1::2] = begin, end
    both = pa.StringArray.from_buffers(2 * n - 1, pa.py_buffer(bounds), pa.py_buffer(data))  # the gaps between them too
    return both.take(pa.array(np.arange(0, 2 * n, 2)))


class Scanner:
    """The tokens of one split, record by record.

    A step (a time with the changes up to the next one) is `own` if the split by itself
    accepts it: it is later than all before, or at the latest time and follows an accepted
    step. It is `first` if all steps up to it have one time.
    """

    def __init__(self, inside: bool):
        self.inside = inside  # a comment
        self.pos = 0
        self.time = self.latest = self.lowest = None
        self.own = self.first = True

    def _text_time(self, text: str) -> int:
        if text.isdecimal() and text.isascii():
            return int(text)
        m = TIME.fullmatch(text)
        if not m:
            raise VcdError(f"cannot parse an integer time: {text}" if text else "unknown or invalid command: #")
        return int(m[1])

    def step(self, time: int) -> None:
        if self.latest is None or time > self.latest:
            self.own, self.first, self.latest = True, self.latest is None, time
        elif time < self.latest:
            self.own = self.first = False
        self.time = time

    def record(self, text: str, begins_with_time: bool, out: list, start: int | None, end: int | None) -> None:
        """Adds (pos, time, own, first, letter, code, rest) for each step, with no letter, and each change."""
        words = iter(text.split())
        if begins_with_time and not self.inside:
            time = next(words, "") if text[:1].strip() else ""
            self.pos += 1
            self.step(self._text_time(time))
            if (start is None or self.time >= start) and (end is None or self.time <= end):
                out.append((self.pos, self.time, self.own, self.first, None, None, None))
        for word in words:
            if self.inside:
                self.inside = not word.endswith("$end")
                continue
            self.pos += 1
            letter = word[0]
            if letter == "#" or word == "$dumpall":
                self.step(self._text_time(word[1:]) if letter == "#" else 0)
                if (start is None or self.time >= start) and (end is None or self.time <= end):
                    out.append((self.pos, self.time, self.own, self.first, None, None, None))
                continue
            if letter == "$":
                if word == "$comment":
                    self.inside = True
                elif word not in IGNORED:
                    raise VcdError(f"unknown or invalid command: {word}")
                continue
            if letter in SCALAR:
                code, rest = word[1:], ""
            elif letter in LONG:
                code, rest = next(words, ""), word[1:]
            else:
                raise VcdError(f"unknown or invalid command: {word}")
            if not code:
                raise VcdError(f"expected an id: {word}")
            if self.time is None:  # changes before the first time are at 0
                self.step(0)
                if (start is None or start <= 0) and (end is None or end >= 0):
                    out.append((self.pos, 0, True, True, None, None, None))
                self.pos += 1
            if (start is None or self.time >= start) and (end is None or self.time <= end):
                out.append((self.pos, self.time, self.own, self.first, letter, code, rest))

    def _times(self, data: bytes, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - begin
        if not len(length) or length.min() == 0 or length.max() > 18:
            return np.array([self._text_time(data[a:b].decode()) for a, b in zip(begin, end, strict=True)], np.int64)
        time, plain = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
        for k in range(int(length.max())):
            digit = buf[np.minimum(begin + k, len(buf) - 1)].astype(np.int64) - 48
            here = k < length
            plain &= ~here | ((digit >= 0) & (digit <= 9))
            time = np.where(here, time * 10 + digit, time)
        for i in np.flatnonzero(~plain):
            time[i] = self._text_time(data[begin[i] : end[i]].decode())
        return time

    def many(self, data: bytes, start: int | None, end: int | None, want: str) -> list | None:
        """record() for ASCII text of many records at once: columns of steps, of changes, of all, or (neither: nothing) of none.

        None, with nothing done, where the text needs record(): comments, dumps at time 0 and changes before any time.
        """
        if self.inside or not data.isascii() or b"$comment" in data or b"$dumpall" in data:
            return None
        buf = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(~IS_SPACE[buf], prepend=False, append=False))
        begin, finish = edges[::2], edges[1::2]
        n = len(begin)
        if not n:
            return [pa.array([], k) for k in KINDS]
        letter, at = buf[begin], np.arange(n)
        # what follows a long change is its code, whatever it looks like; in a run of such letters that is every second word
        long = IS_LONG[letter]
        opens = long & ((at - np.maximum.accumulate(np.where(long, -1, at))) % 2 == 1)
        code = np.concatenate(([False], opens[:-1]))
        step, command, scalar = (~code & x for x in (letter == ord("#"), letter == ord("$"), IS_SCALAR[letter]))
        change = scalar | opens
        if self.time is None and change.any() and not step[: int(change.argmax())].any():
            return None

        def word(i: int) -> str:
            return data[begin[i] : finish[i]].decode()

        lost = scalar & (finish - begin == 1)
        lost[:-1] |= (code & (letter == ord("#")) & (buf[begin - 1] == ord("\n")))[1:]  # the next record, not a code
        lost[-1] |= opens[-1]
        unknown = ~(code | step | command | change)
        for i in np.flatnonzero(command):
            unknown[i] = word(i) not in IGNORED
        if unknown.any():
            raise VcdError(f"unknown or invalid command: {word(int(unknown.argmax()))}")
        if lost.any():
            raise VcdError(f"expected an id: {word(int(lost.argmax()))}")

        time = self._times(data, buf, begin[step] + 1, finish[step])
        before = np.maximum.accumulate(np.concatenate(([NEVER if self.latest is None else self.latest], time)))
        decided = np.maximum.accumulate(np.where(time == before[:-1], -1, np.arange(len(time))))
        own = np.where(decided >= 0, (time > before[:-1])[decided], self.own) if len(time) else np.zeros(0, bool)
        first = self.first & np.logical_and.accumulate(time == (time[:1] if self.latest is None else self.latest))
        # with the state that the text begins in, for changes before its first step
        time, own, first = np.concatenate(([self.time or 0], time)), np.concatenate(([self.own], own)), np.concatenate(([self.first], first))
        pos, of = self.pos + np.cumsum(~code), np.cumsum(step)
        self.pos = int(pos[-1])
        if len(time) > 1:
            self.time, self.latest, self.own, self.first = int(time[-1]), int(before[-1]), bool(own[-1]), bool(first[-1])

        i = np.flatnonzero({"changes": change, "steps": step, "all": change | step}[want]) if want else np.zeros(0, np.int64)
        if start is not None:
            i = i[time[of[i]] >= start]
        if end is not None:
            i = i[time[of[i]] <= end]
        columns = [pa.array(pos[i]), *(pa.array(x[of[i]]) for x in (time, own, first))]
        if want not in ("changes", "all"):
            return [*columns, *(pa.nulls(len(i), pa.string()) for _ in range(3))]
        two, after = opens[i], np.minimum(i + 1, n - 1)
        codes = pieces(data, np.where(two, begin[after], begin[i] + 1), np.where(two, finish[after], finish[i]))
        told = [pieces(data, begin[i], begin[i] + 1), codes, pieces(data, begin[i] + 1, np.where(two, finish[i], begin[i] + 1))]
        return [*columns, *(told if want == "changes" else [pc.if_else(pa.array(step[i]), pa.scalar(None, pa.string()), x) for x in told])]


class VcdFiles:
    """All VCD files of a path (a file, a folder, a pattern); every table has the file as its first column."""

    def __init__(self, spark: SparkSession, path: str, flatten_unnamed: bool = False):
        self.spark, self.path, self.flatten = spark, path, flatten_unnamed
        self._text: DataFrame | None = None
        self._catalog: DataFrame | None = None
        self._found: DataFrame | None = None

    def _records(self) -> DataFrame:
        """One row for each stretch of text up to a line that begins with #, in order within a split."""
        if self._text is None:  # the files are listed once
            self._text = self.spark.read.option("lineSep", "\n#").text(self.path)
        return self._text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")

    def _splits(self) -> DataFrame:
        """(split, file, block, inside, end_block, end_row): whether the split begins inside a comment, and the record in which the file's header ends."""
        if self._found is None:
            # what follows the last $end of a record tells whether it ends inside a comment, wherever it began
            marked = F.col("value").contains("$comment") | F.col("value").contains("$end")
            opened = F.when(marked, F.element_at(F.split("value", r"\$end(?=\s|$)"), -1).contains("$comment"))
            found = self._records().groupBy("file", "block").agg(
                F.max_by(opened, F.when(marked, F.col("row"))).alias("opened"), F.min(F.when(F.col("value").contains("$enddefinitions"), F.col("row"))).alias("end_row"), F.min("row").alias("first_row")
            )
            found = materialize(found, "splits")
            above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each split
            ends = found.groupBy("file").agg(F.min(F.when(F.col("end_row").isNotNull(), F.struct("block", "end_row"))).alias("end"), F.min(F.struct("block", F.col("first_row").alias("end_row"))).alias("begin"))
            ends = ends.select("file", F.coalesce("end", "begin").alias("end")).select("file", F.col("end.block").alias("end_block"), F.col("end.end_row").alias("end_row"))
            inside = found.select("file", "block", F.coalesce(F.last("opened", ignorenulls=True).over(above), F.lit(False)).alias("inside"))
            self._found = materialize(inside.join(ends, "file").withColumn("split", F.monotonically_increasing_id()), "splits")
        return self._found

    def _catalog_rows(self) -> DataFrame:
        if self._catalog is None:
            flatten = self.flatten
            # a header is one record, but for comments in it with lines that begin with #
            head = self._records().join(F.broadcast(self._splits()), ["file", "block"]).filter((F.col("block") < F.col("end_block")) | ((F.col("block") == F.col("end_block")) & (F.col("row") <= F.col("end_row"))))
            parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
            first = head.groupBy("file").agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x["value"], F.lit(""))), "\n#").alias("value"))

            def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        found = list(Header(text, flatten).rows())
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array([k for k, _ in found]), pa.array([json.dumps(r) for _, r in found])], ["file", "kind", "row"])

            self._catalog = materialize(first.select("file", "value").mapInArrow(parse, "file string, kind string, row string"), "catalog")
        return self._catalog

    def table(self, name: str) -> DataFrame:
        """meta, scopes, vars, signals, derived or enums."""
        schema = TABLES[name].removeprefix("file string, ")
        return self._catalog_rows().filter(F.col("kind") == name).select("file", F.from_json("row", schema).alias("r")).select("file", "r.*")

    def _scanned(self, start: int | None, end: int | None, want: str) -> DataFrame:
        """The steps or changes of all splits; with neither wanted, one row for each split: its last step and in pos its latest time."""
        splits = F.broadcast(self._splits())  # one row for each split that is read
        text = F.col("value")
        ends = (F.col("block") == F.col("end_block")) & (F.col("row") == F.col("end_row"))
        body = F.when(ends, F.regexp_replace(text, r"(?s)^.*?\$enddefinitions\s+\$end[^\n]*", "")).otherwise(text)
        after = (F.col("block") > F.col("end_block")) | ((F.col("block") == F.col("end_block")) & (F.col("row") >= F.col("end_row")))
        rows = self._records().join(splits, ["file", "block"]).filter(after).select("split", "inside", ends.alias("ends"), body.alias("value"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, scanner = None, None

            def send(columns: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), at, np.int64)), *columns], NAMES)

            def send_rows(out: list) -> pa.RecordBatch:
                return send([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)])

            def summary() -> Iterator[pa.RecordBatch]:
                if not want and scanner is not None and scanner.time is not None:
                    yield send_rows([(scanner.latest, scanner.time, scanner.own, scanner.first, None, None, None)])

            for b in batches:
                split, value = b.column(0).to_numpy(), b.column(3)
                cuts = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if low == high:
                        continue
                    is_end = b.column(2)[low].as_py()  # such a record is the first of its split
                    if split[low] != at:
                        yield from summary()
                        at, scanner = int(split[low]), Scanner(b.column(1)[low].as_py() and not is_end)
                    part = value.slice(low, high - low)
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), part), pa.scalar("\n#", value.type))[0].as_buffer().to_pybytes()
                    columns = scanner.many(joined if is_end else b"#" + joined, start, end, want)
                    if columns is not None:
                        if len(columns[0]):
                            yield send(columns)
                        continue
                    out: list = []
                    for k, text in enumerate(part.to_pylist()):
                        scanner.record(text, not is_end or k > 0, out, start, end)
                        if len(out) >= ROWS or not want:
                            if want:
                                yield send_rows(out)
                            out = []
                    if out:
                        yield send_rows(out)
            yield from summary()

        found = rows.mapInArrow(run, TOKENS)
        return found.filter(f"letter is {'not ' if want == 'changes' else ''}null")

    def _tokens(self, want: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """(file, block, pos, time, letter, code, rest) of accepted steps, which have no letter, or of their changes.

        A step is accepted if it is later than all before it, or at the latest time and follows an accepted one.
        """
        tokens, places = self._scanned(start, end, want), self._splits().select("split", "file", "block")
        if self._splits().groupBy("file").count().filter("count > 1").isEmpty():
            return tokens.filter("own").drop("own", "first").join(F.broadcast(places), "split").drop("split")
        splits = materialize(self._scanned(None, None, "").join(F.broadcast(places), "split"), "split-times")
        above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each split
        splits = splits.withColumn("reached", F.max("pos").over(above))
        # the last step's state, where it does not hang on the splits above
        state = F.when(F.col("reached").isNull() | (F.col("time") > F.col("reached")), F.col("own")).when((F.col("time") < F.col("reached")) | ~F.col("first"), False)
        splits = splits.withColumn("carried", F.last(state, ignorenulls=True).over(above)).select("split", "file", "block", "reached", "carried")
        joined = tokens.join(F.broadcast(splits), "split")
        kept = F.when(F.col("reached").isNull() | (F.col("time") > F.col("reached")), F.col("own")).when(F.col("time") < F.col("reached"), False).otherwise(F.col("first") & F.col("carried"))
        return joined.filter(kept).drop("split", "own", "first", "reached", "carried")

    def steps(self) -> DataFrame:
        """(file, time): all accepted times, with or without changes."""
        return self._tokens("steps").select("file", "time").distinct()

    def changes(self, signals: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """(file, signal_id, time, seq, kind, bits, str, real), in file order by seq; of all ground signals or of (file, signal_id) given.

        start and end are included; they drop tokens before these are decoded.
        """
        named = self._tokens("changes", start, end).select("file", F.struct("block", "pos").alias("seq"), "time", "letter", F.col("code").alias("id_code"), "rest")
        wanted = self.table("signals").filter("kind = 'ground'")
        if signals is not None:
            wanted = wanted.join(signals.select("file", "signal_id"), ["file", "signal_id"], "left_semi")
        return decoded_columns(named.join(wanted, ["file", "id_code"])).select("file", "signal_id", "time", "seq", "kind", "bits", "str", "real")


def decoded_columns(found: DataFrame) -> DataFrame:
    """found (letter, rest, encoding, width, ...) with kind, bits, str and real."""
    letter, encoding, width = F.lower("letter"), F.col("encoding"), F.col("width")
    bits = F.when(encoding == "bits", F.when(letter == "b", values.from_vcd(F.col("rest"), width)).when((width == 1) & letter.isin("0", "1", "x", "z"), letter).otherwise(values.extend(letter, width)))
    kind = F.when(encoding == "event", 0).when(encoding == "bits", 1).when(encoding == "string", 2).otherwise(3).cast("tinyint")
    text, real = F.when(encoding == "string", values.unescape(F.col("rest"))), F.when(encoding == "real", F.col("rest").cast("double"))
    return found.select("*", kind.alias("__kind"), bits.alias("bits"), text.alias("str"), real.alias("real")).drop("kind").withColumnRenamed("__kind", "kind")


def decoded(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """rows (file, seq, time, id_code, letter, rest) as (file, signal, time, seq, value): the values as text, steps with neither signal nor value.

    Codes that are no ground signal are dropped.
    """
    ground = signals.filter("kind = 'ground'").select("file", "id_code", "signal_id", "encoding", "width")
    found = rows.join(ground, ["file", "id_code"], "left").filter(F.col("id_code").isNull() | F.col("signal_id").isNotNull())
    value = F.coalesce("bits", "str", F.col("real").cast("string"), F.lit(""))
    return decoded_columns(found.withColumn("kind", F.lit(0))).select("file", F.col("signal_id").alias("signal"), "time", "seq", F.when(F.col("signal_id").isNotNull(), value).alias("value"))
