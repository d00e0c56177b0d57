"""Packing of tokenised documents into fixed-length sequences along a Hilbert curve.

A document's vector is the sum of random signs of its hashed words, which is a
random projection of its hashed bag of words to `DIMS` dimensions. Vectors are
scaled by the root of the number of words and quantised; their Hilbert index is
the sort key. A range shuffle by (key, id) lays neighbouring documents side by
side, equal keys are split by id, and each partition packs its own stretch of
the curve: documents are cut freely at every `length` tokens, so that no
sequence but a partition's last is short. That tail is cut at powers of two,
which need no padding.

Null and empty texts are the separator alone. Rows with equal ids are packed
one by one like any others; a null id is packed first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracetide.llm.common import require, text_bytes, utf8

DIMS, LEVELS = 3, 10
CODES = np.random.default_rng(7).integers(1, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text hashed at a time.
BLOCK = 1 << 20
# Fixed value: the pattern by which byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space that the pattern's engine cannot look ahead over is cut out; the class is Unicode's White_Space.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


class Encoder:
    """A fast encoder with the vocabulary, merges and special tokens of a byte-level BPE file of `tokenizers`.

    A long run of white space is one piece by the pattern, without its last
    character where a word follows; it is encoded as one piece here, so that the
    pattern never looks ahead over it.
    """

    def __init__(self, name: str, ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        self.special = set(special)
        self.plain = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.piece = tiktoken.Encoding(f"{name} whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text):
            ends_part = run.end() == len(text) or any(text.startswith(s, run.end()) for s in self.special)
            end = run.end() - (not ends_part)
            parts += [self.plain.encode_to_numpy(text[at : run.start()], allowed_special=self.special), self.piece.encode_to_numpy(text[run.start() : end], allowed_special=set())]
            at = end
        rest = self.plain.encode_to_numpy(text[at:], allowed_special=self.special)
        return np.concatenate([*parts, rest]) if parts else rest


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return Encoder(path, ranks, special)


def vectors(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of DIMS scaled projections for each text."""
    n = len(offsets) - 1
    total, words = np.zeros((n, DIMS)), np.zeros(n)
    for a in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        z = min(a + BLOCK, int(offsets[-1]))
        part = data[a:z]
        solid = part > 32
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        cuts = offsets[(offsets > a) & (offsets < z)] - a
        start[cuts] = solid[cuts]
        first = np.flatnonzero(start)
        if not len(first):
            continue
        at = np.flatnonzero(solid)
        word = np.cumsum(start)[at] - 1
        h = np.add.reduceat(CODES[(at - first[word]) & 63, part[at]], np.searchsorted(at, first))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        row = np.searchsorted(offsets, first + a, "right") - 1
        words += np.bincount(row, minlength=n)
        for d in range(DIMS):
            total[:, d] += np.bincount(row, ((h >> np.uint64(40 + d)) & np.uint64(1)).astype(float) * 2 - 1, minlength=n)
    return total / np.sqrt(np.maximum(words, 1))[:, None]


def hilbert(points: np.ndarray, levels: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with `levels` bits in each dimension."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (levels - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for level in range(levels - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    v = vectors(offsets, data)
    side = 1 << LEVELS
    return hilbert(np.clip((np.tanh(v / 8) + 1) * (side / 2), 0, side - 1), LEVELS)


@F.arrow_udf(LongType())
def curve_key(text: pa.Array) -> pa.Array:
    return pa.array(curve_keys(*utf8(text)))


class Packer:
    """Cuts a stream of documents into sequences of `length` tokens; rows() are finished pieces."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.fill, self.open, self.out = 0, [], []

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.out.append((doc, start, len(ids), zlib.crc32(ids), total, self.sequence, offset))
            offset += len(ids)
        self.sequence, self.fill, self.open = self.sequence + 1, 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.fill]
            self.open.append((doc, at, part, len(ids)))
            self.fill, at = self.fill + len(part), at + len(part)
            if self.fill == self.length:
                self._close()

    def finish(self) -> None:
        """The tail becomes sequences of powers of two, the longest first."""
        rest, left, room = self.open, self.fill, 0
        self.open, self.fill = [], 0
        for doc, start, ids, total in rest:
            while len(ids):
                room = room or 1 << (left.bit_length() - 1)
                part, ids = ids[:room], ids[room:]
                self.open.append((doc, start, part, total))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if not room:
                    self._close()

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 1024, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    require(docs, doc_id, text)
    ids_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(length, TaskContext.get().partitionId() << 40)

        def send(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*packer.rows(), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", *PIECES])

        kind = None
        for b in batches:
            kind = b.column(0).type
            for doc, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                packer.add(doc, np.append(encode.ids(t.decode()).astype("<u4"), np.array([separator], "<u4")))
            yield send(kind)
        if kind is not None:
            packer.finish()
            yield send(kind)

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", curve_key("text"))
    along = keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", F.xxhash64("text"))
    return along.select("doc_id", "text").mapInArrow(run, f"doc_id {ids_type}, " + ", ".join(f"{c} bigint" for c in PIECES))
