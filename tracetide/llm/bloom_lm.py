"""Language-model scores from a log-frequency Bloom filter.

Training tokens are counted in two kinds: words exactly, word pairs in a Bloom
filter that holds the quantised count of each: counts are rounded down to 1, 2,
3, 4, 6, 8, 12, 16 and so on, a pair is entered under the levels up to its own,
and a probe asks for level after level until one is missing. The filter is built
in segments, one for each bucket of pairs, and holds all pairs at every size. Up to `filter_bytes` it is broadcast;
beyond, its segments stay a table. Word counts grow with the corpus and are not
broadcast: each batch of documents asks the buckets for the counts of its words,
and beyond `filter_bytes` for the levels of its pairs.

The probability of a word w after another v is
(pair(v, w) + prior * share(w)) / (count(v) + prior), where pair is the filter's
count and share the add-one share of the word. Pairs are rounded down, so that
the probabilities after v sum to at most one, but for the filter's false answers:
a pair that never occurred is answered with a count of one in about one of 100
cases (10 bits an entry, 5 probes), which adds 1 / (count(v) + prior). A text's
first word follows a begin mark, its last token is an end mark. Words and pairs are told apart by 64-bit
hashes (pairs by 32 bits within a bucket). Null and empty texts are an end mark.
Every row gives a row; rows with a null id are training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetide.llm.common import document_key, materialize, require, shuffle_partitions, text_bytes

# Marks are no words: words hold no white space.
BEGIN, END = (xxhash.xxh3_64_intdigest(x) for x in (b"\n", b"\t"))
PROBES = 5
#: Tokens counted by a task before it sends them on.
HELD = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, one after another, and the number of tokens of each."""
    digest = xxhash.xxh3_64_intdigest
    out, sizes = [], []
    for t in texts:
        words = t.lower().split()
        h = np.fromiter(map(digest, words), np.uint64, len(words))
        out += [h, np.array([END], np.uint64)]
        sizes.append(len(words) + 1)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def contexts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return before


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + h * np.uint64(0xC2B2AE3D27D4EB4F))


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the buckets (highest bits) in sorted keys."""
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]


def _remainder(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Number of the largest of 1, 2, 3, 4, 6, 8, 12, ... that is at most the count."""
    e = np.frexp(np.maximum(counts, 1))[1].astype(np.int64) - 1
    return np.maximum(1, 2 * e + (counts >= 1.5 * 2.0**e))


def level_counts(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for pairs that are not held."""
    e = np.maximum(level, 2) // 2
    return np.where(level < 2, level, np.where(level % 2, 1.5, 1.0) * 2.0**e)


def _places(bucket: np.ndarray, remainder: np.ndarray, level: np.ndarray | int, size: np.ndarray) -> Iterator[np.ndarray]:
    z = mixed((bucket.astype(np.uint64) << np.uint64(40)) ^ (remainder.astype(np.uint64) << np.uint64(8)) ^ np.asarray(level, np.uint64))
    step = mixed(z) | np.uint64(1)
    for i in range(PROBES):
        yield (z + np.uint64(i) * step) % size


def segment(bucket: int, remainder: np.ndarray, counts: np.ndarray, bits_each: int) -> bytes:
    """The Bloom filter of one bucket of pairs."""
    levels = levels_of(counts)
    size = 8 * -(-max(64, int(levels.sum()) * bits_each) // 8)
    on = np.zeros(size, np.uint8)
    which = np.repeat(remainder, levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    for at in _places(np.full(len(which), bucket), which, level, np.uint64(size)):
        on[at] = 1
    return np.packbits(on).tobytes()


class Filter:
    """Segments of the buckets from `first` on; level() finds the quantised counts of pairs."""

    def __init__(self, data: bytes, sizes: list[int], bits: int, first: int = 0):
        self.bits, self.first = bits, first
        self.data = np.frombuffer(data, np.uint8)
        sizes = np.array(sizes, np.uint64)
        self.size, self.begin = sizes * np.uint64(8), (np.cumsum(sizes) - sizes) * np.uint64(8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        return self.levels((keys >> np.uint64(64 - self.bits)).astype(np.int64), _remainder(keys, self.bits))

    def levels(self, bucket: np.ndarray, remainder: np.ndarray) -> np.ndarray:
        found, alive, level = np.zeros(len(bucket), np.int64), np.arange(len(bucket)), 0
        while len(alive):
            level += 1
            b = bucket[alive]
            own = b - self.first
            ok = np.ones(len(alive), bool)
            for at in _places(b, remainder[alive], level, self.size[own]):
                at = self.begin[own] + at
                ok &= (self.data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            alive = alive[ok]
            found[alive] = level
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return level_counts(self.level(keys))


def word_probability(count: np.ndarray, before: np.ndarray, total: int, distinct: int, pair_counts: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(add-one share, probability after the word before); no pair is more frequent than its words, whatever the filter answers."""
    share = (count + 1.0) / (total + distinct + 1.0)
    pair = np.minimum(pair_counts, np.minimum(count, before))
    return share, (pair + prior * share) / (before + prior)


def text_scores(h: np.ndarray, sizes: np.ndarray, count: np.ndarray, before: np.ndarray, total: int, distinct: int, pair_counts: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, score, known) of each text; count and before: training counts of each token and of the one before it."""
    first = np.cumsum(sizes) - sizes
    share, p = word_probability(count, before, total, distinct, pair_counts, prior)
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
    return add(np.log10(share)), add(np.log10(p)), add((count > 0).astype(np.int64))


def _gathered(counted: DataFrame, bits: int) -> tuple[bytearray, list[int]]:
    """The filter and the sizes of its segments: room is made by their lengths, then they come a partition at a time, so that the driver holds them once."""
    found = {r.bucket: r.size for r in counted.select("bucket", F.length("bloom").alias("size")).collect()}
    sizes = [found.get(b, 8) for b in range(1 << bits)]
    starts = np.cumsum([0, *sizes])
    whole = bytearray(int(starts[-1]))
    for r in counted.select("bucket", "bloom").toLocalIterator():
        whole[starts[r.bucket] : starts[r.bucket + 1]] = r.bloom
    return whole, sizes


def score(docs: DataFrame, is_held_out, doc_id: str = "doc_id", text: str = "text", prior: float = 100.0, bits_each: int = 10, filter_bytes: int = 96 << 20, batch_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learnt from rows that are not held out.

    is_held_out: a boolean column. filter_bytes bounds the broadcast, not the filter. score is a log10 probability of the text.
    """
    require(docs, doc_id, text)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), document_key(doc_id, text).alias("key"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = max(shuffle_partitions(spark), -(-size // batch_bytes))
    bits = max(6, (2 * batches - 1).bit_length())
    ids = docs.schema[doc_id].dataType.simpleString()

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def send() -> pa.RecordBatch:
            h, g = (np.concatenate(x) for x in zip(*held, strict=True))
            columns: list[list[bytes]] = []
            for keys, kind in ((h, np.uint64), (g, np.uint32)):
                keys, counts = np.unique(keys, return_counts=True)
                cuts = _cuts(keys, bits)
                keys = keys if kind is np.uint64 else _remainder(keys, bits)
                columns += [[x[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)] for x in (keys, counts.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(range(1 << bits), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "w", "wc", "g", "gc"])

        for b in arrow:
            texts = text_bytes(b.column(0))
            for k in range(0, len(texts), 500):
                h, sizes = tokens(texts[k : k + 500])
                held.append((h, pairs(contexts(h, sizes), h)))
                n += len(h)
                if n >= HELD:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        w, wc, g, gc = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("w", np.uint64), ("wc", np.uint32), ("g", np.uint32), ("gc", np.uint32)))
        w, wc = _summed(w, wc.astype(np.int64))
        g, gc = _summed(g, gc.astype(np.int64))
        bloom = segment(bucket, g, gc, bits_each)
        ends = int(wc[np.searchsorted(w, np.uint64(END))]) if END in w else 0
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "w": pa.array([w.tobytes()], pa.binary()), "wc": pa.array([wc.tobytes()], pa.binary()), "total": [int(wc.sum())], "words": [len(w)], "ends": [ends], "bloom": pa.array([bloom], pa.binary())})

    sent = rows.filter(~F.col("held_out")).select("text").mapInArrow(count, "bucket int, w binary, wc binary, g binary, gc binary")
    counted = materialize(sent.groupBy("bucket").applyInArrow(reduce, "bucket int, w binary, wc binary, total bigint, words bigint, ends bigint, bloom binary"), "counts")
    sums = counted.agg(F.sum("total"), F.sum("words"), F.sum("ends"), F.sum(F.length("bloom").cast("long"))).first()
    total, distinct, texts_seen, filtered = (x or 0 for x in sums)
    shared = None
    if filtered <= filter_bytes:
        shared = spark.sparkContext.broadcast(_gathered(counted, bits))
    ask_pairs = shared is None

    batched = rows.select("doc_id", "held_out", "text", F.pmod("key", F.lit(batches)).cast("int").alias("batch"))

    def asked_for(made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of a batch, and its distinct pairs where they are asked for."""
        words = np.unique(np.concatenate([np.unique(h) for h, _ in made]))
        asked = [np.unique(pairs(contexts(h, sizes), h)) for h, sizes in made] if ask_pairs else []
        return words, np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.uint64)

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        texts = text_bytes(group.column("text"))
        h, g = asked_for([tokens(texts[k : k + 500]) for k in range(0, len(texts), 500)])
        n = 1 << bits
        w, p = ([x[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)] for x, cuts in ((h, _cuts(h, bits)), (_remainder(g, bits), _cuts(g, bits))))
        return pa.table({"bucket": pa.array(range(n), pa.int32()), "batch": pa.array([key[0].as_py()] * n, pa.int32()), "w": pa.array(w, pa.binary()), "p": pa.array(p, pa.binary())})

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        w, c = (np.frombuffer(b"".join(known.column(x).to_pylist()), t) for x, t in (("w", np.uint64), ("wc", np.int64)))
        w, c = np.append(w, np.uint64((1 << 64) - 1)), np.append(c, 0)

        def counts(blob: bytes) -> bytes:
            q = np.frombuffer(blob, np.uint64)
            at = np.searchsorted(w[:-1], q)
            return np.where(w[at] == q, c[at], 0).astype(np.int64).tobytes()

        segments = known.column("bloom").to_pylist() if ask_pairs else []
        bloom = Filter(segments[0], [len(segments[0])], bits, key[0].as_py()) if segments else None

        def levels(blob: bytes) -> bytes:
            q = np.frombuffer(blob, np.uint32)
            return (bloom.levels(np.full(len(q), key[0].as_py()), q) if bloom else np.zeros(len(q))).astype(np.int8).tobytes()

        return pa.table({"batch": asked.column("batch"), "bucket": asked.column("bucket"), "c": pa.array([counts(x) for x in asked.column("w").to_pylist()], pa.binary()), "l": pa.array([levels(x) for x in asked.column("p").to_pylist()], pa.binary())})

    def settle(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        bloom = None if ask_pairs else Filter(*shared.value, bits)
        answers = sorted(zip(*(answers.column(x).to_pylist() for x in ("bucket", "c", "l")), strict=True))
        c, level = (np.frombuffer(b"".join(x[i] for x in answers), t) for i, t in ((1, np.int64), (2, np.int8)))
        texts = text_bytes(group.column("text"))
        made = [tokens(texts[k : k + 500]) for k in range(0, len(texts), 500)]
        words, asked = asked_for(made)
        parts = []
        for h, sizes in made:
            before = contexts(h, sizes)
            count = c[np.searchsorted(words, h)]
            preceding = np.empty_like(count)
            preceding[1:] = count[:-1]
            preceding[np.cumsum(sizes) - sizes] = texts_seen
            g = pairs(before, h)
            g = level_counts(level[np.searchsorted(asked, g)].astype(np.int64)) if ask_pairs else bloom.counts(g)
            parts.append((*text_scores(h, sizes, count, preceding, total, distinct, g, prior), sizes))
        base, found, known, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(sizes), total), "base_score": base, "score": found})

    asked = batched.groupBy("batch").applyInArrow(ask, "bucket int, batch int, w binary, p binary")
    answers = asked.groupBy("bucket").cogroup(counted.select("bucket", "w", "wc", *(["bloom"] if ask_pairs else [])).groupBy("bucket")).applyInArrow(answer, "batch int, bucket int, c binary, l binary")
    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(settle, f"doc_id {ids}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
