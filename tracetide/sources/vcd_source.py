"""VCD as a registered Spark source: spark.read.format("vcd") and spark.readStream.format("vcd").

The default table holds a row for each change and each step of the body, in file
order by seq: (file, seq, time, code, letter, rest); a step has no code. Steps that
go back in time are in it: `accepted_steps` and `LiveLog` judge them, over all files
at once. option("table", ...) gives the catalog instead, of which only the files'
heads are read. Files are cut into ranges of bytes; a task reads one, or many of small
files one after another, so that tasks grow with bytes and not with files. Conditions
on time and code are pushed down: of a range, only the records of wanted times are made
into tokens.

As a stream, a file that is still being written is followed. An offset is a byte
position for each file, at the # that begins its last record: what stands before it
is complete and never read again, so that any offset is a snapshot between two
steps. option("complete", "true") takes the last records too, of dumps that have
ended. A comment in the body must not hold a line that begins with #.

Paths are opened by pyarrow.fs: local ones on any machine that runs tasks, or those
of an object store or HDFS.
"""

from __future__ import annotations

import fnmatch
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracetide.sources.vcd import COMMAND, KINDS, SPACE, TABLES, Header, Scanner, VcdError, decoded

CHANGES = "file string, seq bigint, time bigint, code string, letter string, rest string"
COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
BLOCK = 1 << 16
SPLIT_BYTES = 32 << 20
#: What the opening of a file costs, in bytes: as many small files make a task.
OPEN_BYTES = 128 << 10
#: Heads that the driver reads at once, where the opening of a file takes more than SLOW seconds.
READERS = 16
SLOW = 0.002
#: A time inside a record: such text is read as a whole, whatever times are wanted.
INNER = re.compile(rb"[ \t\r\n\v\f]#\d")


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def listed(path: str) -> dict[str, int]:
    """The sizes of the files of a path: a file, a folder with all that is below it, or a pattern for names in a folder."""
    fs, p = opened(path)
    if any(c in p for c in "*?["):
        folder = p.split("*")[0].split("?")[0].split("[")[0].rpartition("/")[0]
        found = fs.get_file_info(arrow_fs.FileSelector(folder, recursive=True, allow_not_found=True))
        found = [x for x in found if fnmatch.fnmatchcase(x.path, p) and x.path.count("/") == p.count("/")]
    else:
        info = fs.get_file_info(p)
        found = [info] if info.type == arrow_fs.FileType.File else fs.get_file_info(arrow_fs.FileSelector(p, recursive=True, allow_not_found=True))
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    hidden = lambda x: any(part.startswith(("_", ".")) for part in x.path.removeprefix(p.rstrip("/")).split("/"))
    return {scheme + x.path: x.size for x in found if x.type == arrow_fs.FileType.File and not hidden(x)}


def made(folder: str) -> None:
    """Make a folder, with those above it."""
    fs, p = opened(folder)
    fs.create_dir(p, recursive=True)


def put(path: str, pieces: Iterable[bytes]) -> None:
    """A file, moved to its name once it is whole: another attempt of a task writes the same."""
    fs, p = opened(path)
    above, _, name = p.rpartition("/")
    hidden = f"{above}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        for x in pieces:
            f.write(x)
    fs.move(hidden, p)


def stretches(keys: pa.Array) -> Iterator[tuple[int, int]]:
    """Where the stretches of equal keys begin and end."""
    n = len(keys)
    if n:
        cuts = [0, *(pc.indices_nonzero(pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True)).to_numpy() + 1).tolist(), n]
        yield from zip(cuts, cuts[1:], strict=False)


def runs(keys: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    """(key, text) of the stretches of equal keys; the texts of one are put together."""
    for a, b in stretches(keys):
        yield keys[a].as_py(), "".join(texts[a:b].to_pylist())


def header_end(text: str) -> int | None:
    """Where the header of a text ends; None if it isn't whole yet."""
    at = 0
    while True:
        m = COMMAND.match(text, SPACE.match(text, at).end())
        if not m:
            return None
        at = m.end()
        if m[1] == "enddefinitions":
            return at


def head(path: str, size: int) -> tuple[bytes, int | None]:
    """The start of a file with its header, and where that ends (None: not in the file)."""
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        want = BLOCK
        while True:
            data = f.read_at(min(want, size), 0)
            end = header_end(data.decode("latin-1")) if b"$enddefinitions" in data else None
            if end is not None or len(data) >= size:
                return data, end
            want *= 4


def header_ends(sizes: dict[str, int]) -> list[int | None]:
    """Where the headers of files end (None: not in the file), in their order. Only slow openings are worth threads: else these wait for each other."""
    files, end = list(sizes), lambda f: head(f, sizes[f])[1]
    began = time.perf_counter()
    first = [end(f) for f in files[:READERS]]
    if time.perf_counter() - began <= SLOW * len(first):
        return [*first, *map(end, files[READERS:])]
    with ThreadPoolExecutor(READERS) as pool:
        return [*first, *pool.map(end, files[READERS:])]


def last_record(path: str, low: int, high: int) -> int:
    """The position of the last # of low..high that begins a line, at least low; it is looked for from the end."""
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        end = high
        while end > low:
            begin = max(low - 1, end - BLOCK, 0)
            found = f.read_at(min(end + 1, high) - begin, begin).rfind(b"\n#")
            if found >= 0 and begin + found + 1 >= low:
                return begin + found + 1
            end = begin if begin > low - 1 else low
    return low


@dataclass
class Bytes:
    """Records that begin in begin..end-1; with header: the file's text from its start."""

    file: str
    begin: int
    end: int
    size: int
    header: bool


@dataclass
class Several(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Bytes]

    @property
    def size(self) -> int:
        return sum(r.end - r.begin for r in self.ranges)


@dataclass
class Heads(InputPartition):
    files: list


def ranges(file: str, begin: int, end: int, size: int, split: int) -> list[Bytes]:
    """A header stays in one range, with what follows it in its last split."""
    cuts = list(range(begin, end, split))
    if begin == 0 and len(cuts) > 1:
        after = head(file, size)[1] or size
        cuts = [0, *[c for c in cuts if c > after]]
    return [Bytes(file, a, b, size, a == 0) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]


def packed(found: Iterable[Bytes], split: int) -> list[Several]:
    """Ranges in their order, put together while they and the openings of their files stay within a split."""
    out, room = [], 0
    for r in found:
        cost = r.end - r.begin + OPEN_BYTES
        if not out or cost > room:
            out.append(Several([]))
            room = split
        out[-1].ranges.append(r)
        room -= cost
    return out


class Wanted:
    """The conditions that the reader itself sees to: times, both ends included, and codes."""

    def __init__(self):
        self.start: int | None = None
        self.end: int | None = None
        self.codes: set | None = None

    def take(self, f: Filter) -> bool:
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if column == ("time",) and isinstance(value, int):
            if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                low = value + isinstance(f, GreaterThan)
                self.start = low if self.start is None else max(low, self.start)
            if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                high = value - isinstance(f, LessThan)
                self.end = high if self.end is None else min(high, self.end)
            return isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo | LessThan | LessThanOrEqual)
        if column == ("code",) and isinstance(f, EqualTo | In):
            found = {value} if isinstance(f, EqualTo) else set(value)
            self.codes = found if self.codes is None else self.codes & found
            return True
        return False


def text_of(p: Bytes) -> tuple[bytes, bool]:
    """The records that begin in a range, and whether the first begins with its #; a record that begins here may end beyond."""
    fs, path = opened(p.file)
    with fs.open_input_file(path) as f:
        low = max(0, p.begin - 1)
        data = f.read_at(p.end - low, low)
        if not p.header:
            first = data.find(b"\n#")
            if first < 0:
                return b"", True
            data = data[first + 1 :]
        at = p.end
        while at < p.size:  # up to the next record
            seen = len(data)
            more = f.read_at(min(BLOCK, p.size - at), at)
            data, at = data + more, at + len(more)
            next_ = data.find(b"\n#", max(0, seen - 1))
            if next_ >= 0:
                return data[:next_], not p.header
    return data, not p.header


def records_in(data: bytes, start: int | None, end: int | None) -> list[bytes]:
    """The stretches of records whose times may lie in start..end; text with times inside records is one stretch."""
    if (start is None and end is None) or INNER.search(data.replace(b"\n#", b"\n\n")) or b"$dumpall" in data:
        return [data]
    cuts = [0, *(m.start() + 1 for m in re.finditer(rb"\n#", data)), len(data)]
    out, fits_before = [], False
    for a, b in zip(cuts, cuts[1:], strict=False):
        m = re.match(rb"#(\d+)(?=[\s.]|\Z)", data[a : a + 32])
        fits = m is None or ((start is None or int(m[1]) >= start) and (end is None or int(m[1]) <= end))
        if fits and fits_before:
            out[-1] = (out[-1][0], b)
        elif fits:
            out.append((a, b))
        fits_before = fits
    return [data[a:b] for a, b in out]


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches put together to about this many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def tokens(p: Bytes, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    data, begins_with_time = text_of(p)
    if p.header:
        end = header_end(data.decode("latin-1"))
        if end is None:
            raise VcdError(f"{p.file}: header ends without $enddefinitions")
        data = data[end:]
        newline = data.find(b"\n")
        data = data[newline + 1 :] if newline >= 0 and not data[:newline].strip() else data
    scanner = Scanner(False)
    scanner.pos = p.begin
    stretches = records_in(data, wanted.start, wanted.end) if begins_with_time else [data]
    for text in stretches:
        for piece in pieces_of(text, 1 << 22):
            yield from _batches(scanner, piece, wanted, p.file)


def pieces_of(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about this size, cut where records begin."""
    at = 0
    while at < len(text):
        cut = text.find(b"\n#", at + size)
        cut = len(text) if cut < 0 else cut + 1
        yield text[at:cut]
        at = cut


def _batches(scanner: Scanner, data: bytes, wanted: Wanted, file: str) -> Iterator[pa.RecordBatch]:
    columns = scanner.many(data, wanted.start, wanted.end, "all")
    if columns is None:
        out: list = []
        for k, text in enumerate(data.decode().split("\n#")):
            begins_with_time = k > 0 or text.startswith("#")
            scanner.record(text.removeprefix("#") if k == 0 else text, begins_with_time, out, wanted.start, wanted.end)
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(KINDS), KINDS, strict=True)]
    pos, time, _, _, letter, code, rest = columns
    batch = pa.RecordBatch.from_arrays([pa.array([file] * len(pos), pa.string()), pos, time, code, letter, rest], COLUMNS)
    if wanted.codes is not None:
        batch = batch.filter(pc.is_in(batch.column("code"), pa.array(list(wanted.codes), pa.string())))
    if len(batch):
        yield batch


class ChangeReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.wanted = path, split, Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Several]:
        return packed((r for file, size in sorted(listed(self.path).items()) for r in ranges(file, 0, size, size, self.split)), self.split)

    def read(self, partition: Several) -> Iterator[pa.RecordBatch]:
        return gathered(b for r in partition.ranges for b in tokens(r, self.wanted))


class TableReader(DataSourceReader):
    """The catalog, from the files' heads: a task for each few files."""

    def __init__(self, path: str, table: str, schema: StructType, flatten: bool):
        self.path, self.table, self.schema, self.flatten = path, table, schema, flatten

    def partitions(self) -> list[Heads]:
        files = sorted(listed(self.path).items())
        return [Heads(files[i : i + 256]) for i in range(0, len(files), 256)]

    def read(self, partition: Heads) -> Iterator[pa.RecordBatch]:
        schema, rows = to_arrow_schema(self.schema), []
        for file, size in partition.files:
            data, _ = head(file, size)
            rows += [r | {"file": file} for kind, r in Header(data.decode(), self.flatten).rows() if kind == self.table]
            if len(rows) >= 1 << 12:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int, complete: bool):
        self.path, self.split, self.complete = path, split, complete
        self.heads: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out, sizes = {}, listed(self.path)
        new = {f: size for f, size in sizes.items() if f not in self.heads}
        self.heads |= {f: end for f, end in zip(new, header_ends(new), strict=True) if end is not None}
        for file, size in sizes.items():
            if file not in self.heads:
                continue  # the header is still being written
            end = size if self.complete else last_record(file, self.heads[file], size)
            if end > self.heads[file] or self.complete:  # a first record is needed: what stands before it goes with it
                out[file] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Several]:
        grown = [(f, start.get(f, 0), e) for f, e in sorted(end.items()) if e > start.get(f, 0)]
        return packed((r for file, a, b in grown for r in ranges(file, a, b, b, self.split)), self.split)

    def read(self, partition: Several) -> Iterator[pa.RecordBatch]:
        return gathered(b for r in partition.ranges for b in tokens(r, Wanted()))


class VcdSource(DataSource):
    """Options: path; table (changes, meta, scopes, vars, signals, derived, enums); splitBytes; flattenUnnamed; complete."""

    @classmethod
    def name(cls) -> str:
        return "vcd"

    def _table(self) -> str:
        return self.options.get("table", "changes")

    def schema(self) -> str:
        return CHANGES if self._table() == "changes" else TABLES[self._table()]

    def _split(self) -> int:
        return int(self.options.get("splitBytes", str(SPLIT_BYTES)))

    def _on(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        if self._table() == "changes":
            return ChangeReader(self.options["path"], self._split())
        return TableReader(self.options["path"], self._table(), schema, self._on("flattenUnnamed"))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if self._table() != "changes":
            raise VcdError("only changes can be streamed")
        return GrowingReader(self.options["path"], self._split(), self._on("complete"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed down."""
    spark.dataSource.register(VcdSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def valued(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows of the source (batch or stream) as a log: (file, signal, time, seq, value); steps without change have no signal."""
    return decoded(rows.withColumnRenamed("code", "id_code"), signals)
