"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `length` bytes. The first digit is
the window's minimizer: the leftmost smallest hash of the `gram`-byte strings in
it. Equal windows have equal minimizers at equal offsets, so suffixes of
different first digits need no comparison, and neighbouring suffixes with the
same minimizer travel as one run of bytes (a run of k suffixes is k + length - 1
bytes). The passes:

1. Minimizers of all documents are counted. Those that occur once have no equal
   window anywhere and are done. Where a task meets one in over a 512th of its
   runs, it sends their number instead of them, and they go on as hot.
2. The runs of the others are sent to the bucket of their digit. A digit that
   occurs more than `hot` times takes a further digit first: its suffixes travel
   one by one, by a hash of the whole window. Equal runs of a task are sent once.
3. Each bucket settles equal runs, then refines the rest by most-significant
   digits of eight bytes until `length`; groups that shrink to one suffix leave.
   Every suffix of a final group but the earliest is a repeat.

Documents are ordered by id (null first) in the id's own type, rows with one id by
a hash of id and text. Ids that are no integers are numbered in their order first.
Rows equal in id and text are the same document and give equal results;
they are no repeats of each other. Null texts are empty. Texts shorter than
`length` have no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetide.llm.common import document_key, materialize, require, shuffle_partitions, text_bytes, utf8
from tracetide.operators.changelog import numbered

LENGTH, GRAM = 100, 24
#: Low bits of a minimizer's sort key hold its position in the segment, the others its hash.
POSITION_BITS = 24
SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CODES = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_ID = -(1 << 63)
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(BASE, SEGMENT + 1), _powers(INVERSE, SEGMENT + 1)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of `size` bytes; data is at most a segment."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * UP[: len(data)], out=total[1:])
    h = (total[size:] - total[:-size]) * DOWN[: len(data) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, anchor, digit) of the runs of neighbouring windows that share a minimizer."""
    h = rolling(data, gram)
    span = length - gram + 1
    low = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return start, np.diff(np.append(start, len(anchor))), anchor[start], h[anchor[start]]


def _segments(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Pieces of a text so that each window lies in exactly one."""
    for at in range(0, n - length + 1, SEGMENT - length + 1):
        yield at, min(n, at + SEGMENT)


def text_runs(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    parts = []
    for a, b in _segments(len(text), length):
        start, count, anchor, digit = runs(text[a:b], length, gram)
        parts.append((start + a, count, anchor + a, digit))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def batch_runs(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, count, anchor, digit) of all runs of a batch of texts; anchor counts from the run's start.

    Short texts are taken together; windows that cross from one to the next are dropped.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= SEGMENT:
            j += 1
        if offsets[j] - offsets[i] > SEGMENT:
            start, count, anchor, digit = text_runs(data[offsets[i] : offsets[j]], length, gram)
            yield np.full(len(start), i), start, count, anchor - start, digit
        elif offsets[j] - offsets[i] >= length:
            start, count, anchor, digit = runs(data[offsets[i] : offsets[j]], length, gram)
            own = offsets[i : j + 1] - offsets[i]
            # a run that spans texts is cut at each text's first window, and loses those that cross
            cuts = np.unique(np.concatenate([start, own[:-1][own[:-1] < start[-1] + count[-1]]]))
            of = np.searchsorted(start, cuts, "right") - 1
            ends = np.minimum(np.append(cuts[1:], start[-1] + count[-1]), start[of] + count[of])
            row = np.searchsorted(own, cuts, "right") - 1
            ends = np.minimum(ends, own[row + 1] - length + 1)
            ok = ends > cuts
            yield row[ok] + i, (cuts - own[row])[ok], (ends - cuts)[ok], (anchor[of] - cuts)[ok], digit[of][ok]
        i = j


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)


def counted_runs(keyed: DataFrame, length: int, gram: int, buckets: int, share: int = 512, least: int = 64) -> DataFrame:
    """(bucket, digit, key, start): the runs of a task for each bucket, packed as 4, 8 and 4 bytes a run.

    A digit with over `least` runs and over a `share`-th of those that a task sends together is repeated and
    hot for all: the task sends one row with its number to the bucket, start -1, and its runs past the
    counting, to buckets from `buckets` on, by document.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            key, start, digit = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket, digit = (digit % np.uint64(buckets)).astype(np.int64), (digit // np.uint64(buckets)).astype(np.uint32)
            found, of, number = np.unique((bucket << 32) | digit, return_inverse=True, return_counts=True)
            many = number > max(least, len(key) // share)
            bucket = np.where(many[of], buckets + key % buckets, bucket)
            found, number = found[many], number[many]
            bucket, digit = np.append(bucket, found >> 32), np.append(digit, (found & 0xFFFFFFFF).astype(np.uint32))
            key, start = np.append(key, number), np.append(start, np.full(len(found), -1)).astype(np.int32)
            parts = list(_by_bucket(bucket))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), *(pa.array([x[w].tobytes() for _, w in parts], pa.binary()) for x in (digit, key, start))], ["bucket", "digit", "key", "start"])

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            offsets, data = utf8(b.column(1))
            for row, start, _, _, digit in batch_runs(offsets, data, length, gram):
                held.append((key[row], start, digit))
                size += len(row)
                if size >= 1 << 20:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return keyed.select("key", "text").mapInArrow(scan, "bucket bigint, digit binary, key binary, start binary")


def repeated_digits(keyed: DataFrame, length: int, gram: int, hot: int, buckets: int) -> DataFrame:
    """(key, start, hot) of the runs whose digit occurs in more than one run. keyed: key, text.

    Within a bucket 32 bits tell digits apart; two that agree in them are taken for repeated,
    which later passes put right.
    """

    def count(key: tuple, group: pa.Table) -> pa.Table:
        digit, owner, start = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("digit", np.uint32), ("key", np.int64), ("start", np.int32)))
        if key[0].as_py() >= buckets:
            return pa.table({"key": owner, "start": start, "hot": np.ones(len(owner), bool)})
        order = np.argsort(digit)
        digit, owner, start = digit[order], owner[order], start[order]
        first = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
        summed = start < 0
        size = np.add.reduceat(np.where(summed, owner, 1), first)
        is_hot = (size > hot) | np.logical_or.reduceat(summed, first)
        rows = np.diff(np.append(first, len(order)))
        keep = np.repeat(size > 1, rows) & ~summed
        return pa.table({"key": owner[keep], "start": start[keep], "hot": np.repeat(is_hot, rows)[keep]})

    return counted_runs(keyed, length, gram, buckets).groupBy("bucket").applyInArrow(count, "key bigint, start int, hot boolean")


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of spans that overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.append(new[1:], len(end)) - 1]


def refine(group: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over suffixes of data at `at`, which begin in groups.

    Returns (index, group) of those that still share their group after `length` bytes.
    """
    index = np.arange(len(at))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    shifts = np.arange(56, -8, -8).astype(np.uint64)
    for depth in range(-8, length, 8):
        if depth < 0:
            order, same = np.argsort(group, kind="stable"), None
        else:
            digit = np.zeros(len(index), np.uint64)
            for k in range(min(8, length - depth)):
                digit |= padded[at[index] + depth + k].astype(np.uint64) << shifts[k]
            order = np.lexsort((digit, group))
            digit = digit[order]
            same = digit[1:] == digit[:-1]
        group, index = group[order], index[order]
        equal = group[1:] == group[:-1]
        if same is not None:
            equal &= same
        edge = np.concatenate([[False], equal, [False]])
        keep = edge[:-1] | edge[1:]
        group, index = np.cumsum(~edge[:-1])[keep], index[keep]
        if not len(index):
            break
    return index, group


def repeats(digit: np.ndarray, ids: np.ndarray, keys: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, start, end) of the bytes covered by windows of these runs that occur earlier in them.

    A run without contents is known to occur earlier.
    """
    known = np.array([c is None for c in contents], bool)
    order = np.lexsort((start, keys, ids))
    edge = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])])
    docs = np.empty(len(order), np.int64)  # documents of the group in their order, from 0
    docs[order] = np.cumsum(edge) - 1
    names = order[edge]
    order = order[~known[order]]
    seen: dict[bytes, int] = {}
    whole, own = np.flatnonzero(known).tolist(), []
    for i in order.tolist():
        first = seen.setdefault(contents[i], i)
        if first == i:
            own.append(i)
        elif (docs[first], start[first]) != (docs[i], start[i]):
            whole.append(i)
    out = [(docs[whole], start[whole].astype(np.int64), start[whole] + count[whole] + (length - 1))]

    own = np.array(own, np.int64)
    _, digits = np.unique(digit[own], return_inverse=True)
    own = own[np.bincount(digits)[digits] > 1] if len(own) else own
    if len(own):
        data = np.frombuffer(b"".join([contents[i] for i in own.tolist()]), np.uint8)
        sizes = count[own] + (length - 1)
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(own)), count[own])
        step = np.arange(len(of)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        # windows of one digit can only be equal if the minimizer lies at the same offset in them
        offset = anchor[own][of] - step
        _, digits = np.unique(digit[own], return_inverse=True)
        index, group = refine(digits[of] * (length + 1) + offset, begin[of] + step, data, length)
        if len(index):
            # the earliest of a group is a place, which two runs may hold
            run = own[of[index]]
            doc, at = docs[run], start[run] + step[index]
            order = np.lexsort((at, doc, group))
            group, doc, at = group[order], doc[order], at[order]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
            late = (doc != doc[head]) | (at != at[head])
            out.append((doc[late], at[late], at[late] + length))
    doc, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(doc):
        a, b = _merge(a + (doc << 40), b + (doc << 40))
    of = names[a >> 40] if len(doc) else np.zeros(0, np.int64)
    return ids[of], keys[of], a & ((1 << 40) - 1), b & ((1 << 40) - 1)


RUNS = "bucket bigint, digit bigint, id bigint, key bigint, start int, count int, anchor int, content binary"


def spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 20_000, buckets: int | None = None) -> DataFrame:
    """(id, key, start, end) of covered bytes; spans of one document may overlap. keyed: key, id, text.

    Documents are told apart by id and key. Counting knows keys only: where two documents share one, a run
    that is asked for both as hot and as not travels both ways.
    """
    spark = keyed.sparkSession
    buckets = buckets or max(64, 4 * shuffle_partitions(spark))
    asked = repeated_digits(keyed, length, gram, hot, buckets).groupBy("key").agg(F.collect_set(F.struct("start", "hot")).alias("asked"))
    joined = keyed.join(asked, "key").select("key", "id", "text", "asked")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[bytes, tuple[int, int, int]] = {}  # of the runs that this task has sent
        for b in filter(len, batches):
            keys = b.column(0).to_numpy(zero_copy_only=False)
            ids = b.column(1).to_numpy(zero_copy_only=False)
            offsets, data = utf8(b.column(2))
            asked = b.column(3)
            flat, bounds = asked.flatten(), np.append(0, np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False)))
            wanted = np.repeat(np.arange(b.num_rows), np.diff(bounds)) * (1 << 32) + flat.field(0).to_numpy(zero_copy_only=False)
            is_hot = flat.field(1).to_numpy(zero_copy_only=False)
            wanted = [np.sort(wanted[~is_hot]), np.sort(wanted[is_hot])]
            for row, start, count, anchor, digit in batch_runs(offsets, data, length, gram):
                cold, heated = (np.flatnonzero(_among(row * (1 << 32) + start, x)) for x in wanted)
                taken, warm = np.append(cold, heated), np.repeat([False, True], [len(cold), len(heated)])
                row, start, count, anchor, digit = (x[taken] for x in (row, start, count, anchor, digit))
                if warm.any():  # one more digit: windows travel one by one
                    times = np.where(warm, count, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, start, digit, count, anchor, warm = (np.repeat(x, times) for x in (row, start, digit, count, anchor, warm))
                    start, anchor, count = start + step, anchor - step, np.where(warm, 1, count)
                begin = offsets[row] + start
                contents = [data[a:z].tobytes() for a, z in zip(begin.tolist(), (begin + count + (length - 1)).tolist(), strict=True)]
                # a run of which the task has sent an equal one that starts earlier is settled: what such
                # runs cover travels as spans, by document, so that a hot digit's task does not see them
                for i, mine in enumerate(zip(ids[row].tolist(), keys[row].tolist(), start.tolist(), strict=True)):
                    sent = earliest.get(contents[i])
                    if sent is None or mine < sent:
                        earliest[contents[i]] = mine
                    elif mine > sent:
                        contents[i] = None
                known = np.array([c is None for c in contents], bool)
                if known.any():
                    at, a, z = (x[known] for x in (row, start, start + count + (length - 1)))
                    a, z = _merge(a + (at << 40), z + (at << 40))
                    at, a, z = a >> 40, a & ((1 << 40) - 1), z & ((1 << 40) - 1)
                    none = np.zeros(len(at), np.int64)
                    yield batch(keys[at].view(np.uint64) % np.uint64(buckets), none, ids[at], keys[at], a, z - a - (length - 1), none, pa.nulls(len(at), pa.binary()))
                row, start, count, anchor, digit, warm = (x[~known] for x in (row, start, count, anchor, digit, warm))
                contents = [c for c in contents if c is not None]
                bucket = digit % np.uint64(buckets)
                if warm.any():
                    mix = np.fromiter((hash_bytes(c) if w else 0 for c, w in zip(contents, warm.tolist(), strict=True)), np.uint64, len(contents))
                    bucket = np.where(warm, mix % np.uint64(buckets), bucket)
                yield batch(bucket, digit.view(np.int64), ids[row], keys[row], start, count, anchor, pa.array(contents, pa.binary()))

    def batch(bucket: np.ndarray, digit: np.ndarray, *columns) -> pa.RecordBatch:
        *numbers, content = columns
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x).astype(np.int64)).cast(k) for x, k in zip((bucket, digit, *numbers), kinds, strict=True)), content], [c.split()[0] for c in RUNS.split(", ")])

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        number = lambda c: group.column(c).to_numpy()
        ids, keys, a, b = repeats(number("digit"), number("id"), number("key"), number("start").astype(np.int64), number("count").astype(np.int64), number("anchor").astype(np.int64), group.column("content").to_pylist(), length)
        return pa.table({"id": ids, "key": keys, "start": a.astype(np.int32), "end": b.astype(np.int32)})

    return joined.mapInArrow(send, RUNS).groupBy("bucket").applyInArrow(settle, "id bigint, key bigint, start int, end int")


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted list."""
    if not len(listed):
        return np.zeros(len(x), bool)
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x


def hash_bytes(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big")


def keyed_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, id, text, own): id is a long in the order of the documents' own ids, NO_ID for null."""
    require(docs, doc_id, text)
    rows = docs.select(document_key(doc_id, text).alias("key"), F.col(doc_id).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if dict(rows.dtypes)["own"] in INTEGERS:
        return rows.select("key", F.coalesce(F.col("own").cast("long"), F.lit(NO_ID)).alias("id"), "text", "own")
    places = materialize(numbered(rows.select("own").filter(F.col("own").isNotNull()).distinct(), "own", "place"), "places")
    return rows.join(places, "own", "left").select("key", F.coalesce("place", F.lit(NO_ID)).alias("id"), "text", "own")


def _found_spans(keyed: DataFrame, options: dict) -> DataFrame:
    """(key, spans of (id, start, end)): by key alone, so that the texts' exchange by key serves again."""
    return spans(keyed.select("key", "id", "text"), **options).groupBy("key").agg(F.collect_list(F.struct("id", "start", "end")).alias("spans"))


def _own_spans(spans: str, id: Column) -> Column:
    """The (start, end) of one document among those of its key; null where there are none."""
    return F.transform(F.filter(spans, lambda x: x["id"] == id), lambda x: F.struct(x["start"], x["end"]))


def cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed, and of maximal removed runs."""
    if not len(start):
        return text, 0, 0
    start, end = _merge(start, end)
    edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((end - start).sum()), len(start)


def _spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    flat = column.flatten()
    a, z = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    for i, j in zip(n[:-1], n[1:], strict=True):
        yield a[i:j], z[i:j]


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """docs with repeated windows taken out of its texts; n_chars, if there is such a column, is counted anew.

    Bytes of a character that is cut in two are dropped with it. Null texts stay null.
    """
    keyed = keyed_documents(docs, doc_id, text)
    found = _found_spans(keyed, options).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    if dict(docs.dtypes)[doc_id] in INTEGERS:
        rows = docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)))
    else:
        places = keyed.filter(F.col("own").isNotNull()).select(F.col("own").alias("__own"), F.col("id").alias("__id")).distinct()
        rows = docs.join(places, F.col(doc_id) == F.col("__own"), "left").withColumn("__id", F.coalesce("__id", F.lit(NO_ID)))
    joined = rows.withColumn("__key", document_key(doc_id, text)).join(found, "__key", "left").select(*docs.columns, _own_spans("__spans", F.col("__id")).alias("__spans"))
    at, out = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            texts, spans_of = b.column(at).cast(pa.large_binary()).to_pylist(), _spans_of(b.column(len(out)))
            kept = [t if t is None else cut(t, *x)[0].decode("utf-8", "ignore") if len(x[0]) else t.decode("utf-8", "ignore") for t, x in zip(texts, spans_of, strict=True)]
            columns = [pa.array(kept, pa.string()) if i == at else b.column(i) for i in range(len(out))]
            if n_chars in out.names:
                i = out.names.index(n_chars)
                columns[i] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(b.column(i).type)
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return joined.mapInArrow(run, out)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes; a row for each row of docs.

    Integer ids are longs, and NO_ID for null; others keep their type, and null.
    """
    keyed = keyed_documents(docs, doc_id, text)
    own = "id" if dict(docs.dtypes)[doc_id] in INTEGERS else "own"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            texts = text_bytes(b.column(2))
            kept = [cut(t, *x) for t, x in zip(texts, _spans_of(b.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [k[1] for k in kept], [k[2] for k in kept])), pa.array([k[0] for k in kept], pa.binary())], ["key", "id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(_found_spans(keyed, options), "key", "left").select("key", own, "text", _own_spans("spans", F.col("id")).alias("spans"))
    return joined.mapInArrow(run, f"key bigint, id {dict(joined.dtypes)[own]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
