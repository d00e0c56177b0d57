"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet in the middle: some variant lies within
one bit of one and within two bits of the other. Bits at odd distance have
unequal parity, so it is enough that fingerprints of even parity emit the ball
of radius two (2,081 variants) and those of odd parity the ball of radius one
(65). Variants are shuffled by a prefix: a fingerprint is sent once to each prefix
that its ball reaches, and the task that owns a prefix enumerates the variants
inside it. Prefixes have so many bits that about `most` fingerprints reach one;
one that more than `most` reach is split by eight further bits, again and again.
A variant that is within one bit of some
fingerprint links every fingerprint that emits it to that one, so that groups
cost a star of links and never all pairs. Links are verified, reduced to a
forest in each task, and joined to components by min-label rounds over tables.

Fingerprints are made distinct first: any number of equal texts costs one.
A document without words (null, empty) has fingerprint zero, linked like any
other. Every row gives a row; a null id is never the smallest of its group, and
a group with no other id has a null component_id. Of rows with one id, the one
with the smallest hash of id and text comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetide.llm.common import document_key, materialize, require, text_bytes

BITS = 64
#: Shingles that are hashed and summed at a time, which bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the shingle hashes; shingles count as often as they occur."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest, total = partial(xxhash.xxh64_intdigest, seed=seed), np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b]) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp): key is a hash of id and text, fp the fingerprint as a signed long."""
    require(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, size, seed) for t in text_bytes(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_signed(found))], ["doc_id", "key", "fp"])

    ids = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), document_key(doc_id, text).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {ids}, key bigint, fp bigint")


def prefixes(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprint goes to which prefix: indexes into fps, and the prefixes."""
    one = [1 << i for i in range(bits)]
    near = np.array([0, *one], np.int64)
    far = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])], np.int64)
    own = (fps >> np.uint64(BITS - bits)).astype(np.int64)
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    index, sent = [], []
    for which, ball in ((np.flatnonzero(odd), near), (np.flatnonzero(~odd), far)):
        index.append(np.repeat(which, len(ball)))
        sent.append((own[which][:, None] ^ ball[None, :]).ravel())
    return np.concatenate(index), np.concatenate(sent)


def deeper(prefix: np.ndarray, fps: np.ndarray, bits: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """Which (prefix of `bits`, fingerprint) goes to which prefix of `more` further bits: indexes, and the longer prefixes."""
    top = (fps >> np.uint64(BITS - bits)).astype(np.int64)
    left = np.where(np.bitwise_count(fps) & 1, 1, 2) - np.bitwise_count(top ^ prefix).astype(np.int64)
    own = (fps >> np.uint64(BITS - bits - more)).astype(np.int64) & ((1 << more) - 1)
    one = [1 << i for i in range(more)]
    balls = [[0], [0, *one], [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]]
    index, sent = [], []
    for radius, ball in enumerate(balls):
        which, ball = np.flatnonzero(left == radius), np.array(ball, np.int64)
        index.append(np.repeat(which, len(ball)))
        sent.append(((prefix[which] << more)[:, None] | (own[which][:, None] ^ ball[None, :])).ravel())
    return np.concatenate(index), np.concatenate(sent)


def bits_for(fingerprints: int, most: int) -> int:
    """Bits of prefixes that about `most` of so many fingerprints reach, 10 at least."""
    return next(b for b in range(10, 49) if fingerprints * (2 + 2 * b + b * (b - 1) // 2) / 2 <= most * 2**b or b == 48)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same groups as a-b do, at most one per fingerprint, each to the group's smallest."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def links_within(fps: np.ndarray, prefix: int, bits: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant under this prefix."""
    rest = np.uint64(1) << np.arange(BITS - bits, dtype=np.uint64)
    shift = np.uint64(BITS - bits)
    delta = (fps >> shift) ^ np.uint64(prefix)
    crossed = np.bitwise_count(delta)
    even = (np.bitwise_count(fps) & 1) == 0
    base = fps ^ (delta << shift)  # moved under the prefix, at the cost of `crossed` flips

    inside, edge = np.flatnonzero(crossed == 0), np.flatnonzero(crossed == 1)
    near = np.concatenate([base[inside], (base[inside][:, None] ^ rest[None, :]).ravel(), base[edge]])
    owner = np.concatenate([fps[inside], np.repeat(fps[inside], len(rest)), fps[edge]])
    if not len(near):
        return near, near
    order = np.lexsort((owner, near))
    near, owner = near[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
    variants, head = near[first], owner[first]
    out_a, out_b = [owner], [np.repeat(head, np.diff(np.append(first, len(near))))]

    mask = np.zeros(1 << 22, bool)
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    mask[slot(variants)] = True

    def match(z: np.ndarray, who: np.ndarray) -> None:
        hit = np.flatnonzero(mask[slot(z)])
        z, who = z[hit], who[hit]
        at = np.minimum(np.searchsorted(variants, z), len(variants) - 1)
        ok = variants[at] == z
        out_a.append(who[ok])
        out_b.append(head[at[ok]])

    i, j = np.triu_indices(len(rest), 1)
    two = rest[i] | rest[j]
    for which, flips in (((crossed == 0) & even, two), ((crossed == 1) & even, rest), ((crossed == 2) & even, np.zeros(1, np.uint64))):
        mine = np.flatnonzero(which)
        for k in range(0, len(mine), block):
            part = mine[k : k + block]
            match((base[part][:, None] ^ flips[None, :]).ravel(), np.repeat(fps[part], len(flips)))
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    keep = (a != b) & (np.bitwise_count(a ^ b) <= 3)  # verified
    pairs = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0)
    return _forest(pairs[:, 0], pairs[:, 1]) if len(pairs) else (pairs[:, 0], pairs[:, 1])


SENT = "bits int, prefix bigint, fp bigint"
#: Bits that a prefix takes more where too many fingerprints reach it, and the most bits it can have.
FURTHER, DEEPEST = 8, 56


def _sent(bits: int, prefix: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(prefix), bits, np.int32)), pa.array(prefix), pa.array(_signed(fps))], ["bits", "prefix", "fp"])


def links(distinct: DataFrame, prefix_bits: int | None = None, most: int = 1 << 18) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose groups are those of all links within three bits.

    No group that a task takes holds more than about `most` fingerprints.
    """
    count = distinct.count()
    first = prefix_bits or bits_for(count, most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 1 << 14):
                part = fps[k : k + (1 << 14)]
                index, sent = prefixes(part, first)
                yield _sent(first, sent, part[index])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            prefix, fps = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = b.column(0)[0].as_py()
            for k in range(0, len(fps), 1 << 14):
                index, sent = deeper(prefix[k : k + (1 << 14)], fps[k : k + (1 << 14)], bits, FURTHER)
                yield _sent(bits + FURTHER, sent, fps[k : k + (1 << 14)][index])

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy().view(np.uint64))
        a, b = links_within(fps, key[1].as_py(), key[0].as_py())
        return pa.table({"a": _signed(a), "b": _signed(b)})

    sent = distinct.select("fp").mapInArrow(emit, SENT)
    bits = first
    settled = None
    while count > most and bits + FURTHER <= DEEPEST:  # a prefix is reached by no more than all of them
        full = materialize(sent.groupBy("prefix").count().filter(F.col("count") > most).select("prefix"), "full")
        if full.isEmpty():
            break
        cool = sent.join(F.broadcast(full), "prefix", "left_anti").select("bits", "prefix", "fp")  # full: one row for `most` of those sent
        settled = cool if settled is None else settled.union(cool)
        hot = sent.join(F.broadcast(full), "prefix", "left_semi").select("bits", "prefix", "fp")
        sent, bits = materialize(hot.mapInArrow(split, SENT), "split"), bits + FURTHER
    sent = sent if settled is None else settled.union(sent)
    return sent.groupBy("bits", "prefix").applyInArrow(meet, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60, hub: int = 1_000_000) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on a link (a, b).

    Alternating large-star and small-star rounds; each round is a written table.
    A node's neighbours are reduced by min before the shuffle. The links of a node
    with more than `hub` of them are spread over several keys when they meet that min.
    """

    def meet(links: DataFrame, count: int) -> DataFrame:
        low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if count <= hub:  # no node has more
            return links.join(low.select("u", F.least("u", "m").alias("m")), "u")
        salts = F.ceil(F.col("n") / hub)
        hubs = F.broadcast(low.filter(F.col("n") > hub).select("u", salts.alias("salts")))  # at most count / hub rows
        salted = links.join(hubs, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1)))).drop("salts")
        return salted.join(low.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt")), ["u", "salt"]).drop("salt")

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        large = meet(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "links")
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(meet(large, 2 * before[0]).select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _grouped(docs: DataFrame, doc_id: str, text: str, size: int, seed: int, **options) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and (fp, first) for each distinct one: first is (no id, id, key) of the group's first row."""
    made = materialize(fingerprints(docs, doc_id, text, size, seed), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = materialize(made.groupBy("fp").agg(F.min(row).alias("first")), "nodes")
    found = components(links(nodes, **options))
    found = materialize(nodes.join(found, F.col("fp") == F.col("node")).select("fp", "first", "component"), "members")
    lowest = materialize(found.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    linked = found.join(lowest, "component").select("fp", "lowest")
    return made, materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("first")), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, **options) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id in the document's group."""
    made, first = _grouped(docs, doc_id, text, size, seed, **options)
    return made.join(first, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, **options) -> DataFrame:
    """One row of each group: the one with the smallest id (null after all others), of rows with that id the one with the smallest hash of id and text.

    Of rows equal in both, any one stays. Rows of other groups stay, whatever their ids.
    """
    _, first = _grouped(docs, doc_id, text, size, seed, **options)
    kept = first.select(F.col("first.key").alias("__kept"), F.col("first.doc_id").alias("__id")).distinct()
    keyed = docs.withColumn("__key", document_key(doc_id, text))
    # ids are compared once keys have met, not as join keys, so that one shuffle by key serves the last step too
    same = (F.col("__key") == F.col("__kept")) & F.coalesce(F.col(doc_id) == F.col("__id"), F.col(doc_id).isNull() & F.col("__id").isNull())
    return keyed.join(kept, same, "left_semi").dropDuplicates([doc_id, "__key"]).drop("__key")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

