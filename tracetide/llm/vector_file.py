"""Hard negatives by a vector-approximation file.

Components become integers, so that scores (inner products) are exact. Rows are
dealt into blocks; within one, each dimension is quantised into cells of about
equal counts, and a row is approximated by its cells. For an anchor, a table per
dimension holds the least and the greatest product of its component with each
cell; sums of looked-up entries bound a row's score from below and above. Only
rows whose bounds leave them a chance are scored exactly.

Two passes over the blocks: the first finds an anchor's positives (its best rows
of the same label), where a row has a chance if its upper bound reaches the k-th
greatest lower bound; the second finds, for each window of scores that a positive
opens, the best rows of other labels, where bounds must also reach the window, and
only rows that lie in it for certain set the bar. Each block answers with an
anchor's best few, and these are merged.

A label with many rows has blocks of its own, among which its rows are dealt by
hash; the others are pooled. The first pass sends an anchor to the blocks of its
label, the second to all others. So every anchor meets every row of other labels
in some block, a block is bounded, and a label with a third of all rows is no
group. What is sent grows with anchors times rows over `block` rows.

Rows with a null label, a null vector or null or non-finite components take no
part; others all do, repeated rows each by themselves. Rows without an id are
last among ties and no anchors. No row of an anchor's own id is among its
positives. Vectors of different lengths are never compared. Rows of an id that are
equal are one anchor, others are different ones. Components so large that a score
may not fit a long are an error. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracetide.llm.common import materialize, require, shuffle_partitions

NO_ID = np.iinfo(np.int64).max
ROWS = "vec_id bigint, label bigint, anchor boolean, dim int, cells binary"
#: Rows whose bounds are worked out at a time for up to ANCHORS anchors.
CHUNK, ANCHORS = 8192, 32


def integers(scale: int):
    """(vec_id, label, anchor, v) to rows that take part, with floor(scale * component) as int16 or int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            v = b.column(3)
            lengths = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = v.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            bad = bad | ~np.isfinite(x)
            ends = np.cumsum(np.maximum(lengths, 0))
            wrong = np.concatenate(([0], np.cumsum(bad)))
            with np.errstate(over="ignore"):
                x = np.floor(scale * np.where(bad, 0.0, x))
            rows, cells = [], []
            for i in np.flatnonzero((lengths >= 0) & b.column(1).is_valid().to_numpy(zero_copy_only=False)):
                begin, end = ends[i] - lengths[i], ends[i]
                if wrong[end] > wrong[begin]:
                    continue
                own = x[begin:end]
                reach = np.abs(own).max(initial=0.0)
                if reach * reach * max(1, len(own)) >= 2.0**62 or reach >= 2.0**31:
                    raise ArithmeticError(f"row {b.column(0)[i]}: a component of {reach:g} may give scores that fit no long")
                rows.append(i)
                cells.append(own.astype(np.int16 if reach < 32_768 else np.int32).tobytes())
            at = pa.array(np.array(rows, np.int64))
            ids = b.column(0).fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays([ids.take(at), b.column(1).take(at), b.column(2).take(at), pa.array(lengths[rows].astype(np.int32) if rows else np.zeros(0, np.int32)), pa.array(cells, pa.binary())], [c.split()[0] for c in ROWS.split(", ")])

    return run


def decoded(cells: list[bytes], dim: int) -> np.ndarray:
    """The rows as a matrix of long."""
    out = np.zeros((len(cells), dim), np.int64)
    if dim:
        for width, kind in ((2, np.int16), (4, np.int32)):
            rows = [i for i, c in enumerate(cells) if len(c) == width * dim]
            if rows:
                out[rows] = np.frombuffer(b"".join(cells[i] for i in rows), kind).reshape(len(rows), dim)
    return out


class VectorFile:
    """Rows of one length, sorted by label, with their approximations."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, bits: int):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        n, dim = self.x.shape
        self.codes = np.zeros((dim, n), np.intp)
        self.least, self.greatest = [], []
        places = np.linspace(0, n, 1 << bits, endpoint=False).astype(np.int64)[1:]
        ranked = np.sort(self.x, axis=0)
        for j in range(dim):
            marks = np.unique(ranked[places, j])  # a cell begins at each mark, and one below the first
            self.codes[j] = np.searchsorted(marks, self.x[:, j], "right")
            self.least.append(np.concatenate((ranked[:1, j], marks)))
            self.greatest.append(np.concatenate((np.maximum(marks - 1, ranked[0, j]), ranked[-1:, j])))

    def span(self, label: int) -> tuple[int, int]:
        """The rows of a label stand together."""
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def bounds(self, q: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors (rows of q) with the rows first..last-1."""
        m, dim = q.shape
        tables = []
        reach = 0
        for j in range(dim):
            a, b = q[:, j : j + 1] * self.least[j], q[:, j : j + 1] * self.greatest[j]
            both = np.stack((np.minimum(a, b), np.maximum(a, b)), axis=2)
            tables.append(both)
            reach += int(np.abs(both).max(initial=0))
        kind = np.int32 if reach < 1 << 31 else np.int64
        low, high = (np.empty((m, last - first), kind) for _ in range(2))
        tables = [t.astype(kind) for t in tables]
        for at in range(first, last, CHUNK):
            end = min(at + CHUNK, last)
            total = np.zeros((m, end - at, 2), kind)
            for j, t in enumerate(tables):
                total += t[:, self.codes[j, at:end]]
            low[:, at - first : end - first], high[:, at - first : end - first] = total[..., 0], total[..., 1]
        return low, high

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.x[rows] @ q

    def best(self, score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best of scored rows: higher first, ties by smaller id."""
        return np.lexsort((self.ids[rows], -score))[:k]


def kth_greatest(x: np.ndarray, k: int):
    """The k-th greatest, or None if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def positives(file: VectorFile, q: np.ndarray, own: int, label: int, first: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(0, id, score) of the k best rows of the anchor's label in the block, by bounds of these rows."""
    ids = file.ids[first : first + len(low)]
    other = ids != own if own != NO_ID else np.ones(len(ids), bool)
    bar = kth_greatest(low[other], k)
    rows = first + np.flatnonzero(other if bar is None else other & (high >= bar))
    score = file.scores(q, rows)
    best = file.best(score, rows, k)
    return [(0, int(i), int(s)) for i, s in zip(file.ids[rows[best]], score[best], strict=True)]


def in_windows(file: VectorFile, q: np.ndarray, windows: list[tuple[int, int, int]], low: np.ndarray, high: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(window, id, score) of the k best of rows within each window (name, least, greatest)."""
    chance = []
    for _, least, greatest in windows:
        may = (high >= least) & (low <= greatest)
        bar = kth_greatest(low[(low >= least) & (high <= greatest)], k)
        chance.append(may if bar is None else may & (high >= bar))
    some = np.flatnonzero(np.logical_or.reduce(chance)) if chance else np.zeros(0, np.int64)
    score = file.scores(q, rows[some])
    out = []
    for name, least, greatest in windows:
        fits = np.flatnonzero((score >= least) & (score <= greatest))
        best = fits[file.best(score[fits], rows[some[fits]], k)]
        out += [(name, int(i), int(s)) for i, s in zip(file.ids[rows[some[best]]], score[best], strict=True)]
    return out


def window(positive: int, low: int, high: int) -> tuple[int, int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive."""
    return positive, -(-low * positive // 100), high * positive // 100


FOUND = "asker bigint, positive_score bigint, vec_id bigint, score bigint"
SENT = "block long, asks boolean, asker bigint, vec_id bigint, label bigint, dim int, cells binary, scores array<bigint>"


def searcher(find_positives: bool, k: int, low: int, high: int, bits: int):
    """A pass over partitions sorted by (block, asks): a block's rows come first and are held, the anchors that visit it follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, files = None, [], None

        def opened() -> dict[int, VectorFile]:
            found: dict[int, VectorFile] = {}
            if held:
                rows = pa.Table.from_batches(held)
                dims = rows.column("dim").to_numpy()
                ids, labels, cells = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), rows.column("cells").to_pylist()
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    found[d] = VectorFile(ids[at], labels[at], decoded([cells[i] for i in at], d), bits)
            return found

        def answers(asks: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
            asker, own, label, dims = (asks.column(c).to_numpy() for c in ("asker", "vec_id", "label", "dim"))
            cells, scores = asks.column("cells"), asks.column("scores")
            for d in np.unique(dims).tolist():
                file = files.get(d)
                if file is None:
                    continue
                mine = np.flatnonzero(dims == d)
                mine = mine[np.argsort(label[mine], kind="stable")]
                for at in range(0, len(mine), ANCHORS):
                    part = mine[at : at + ANCHORS]
                    q = decoded([cells[i].as_py() for i in part.tolist()], d)
                    if find_positives:
                        for own_label in np.unique(label[part]).tolist():
                            first, last = file.span(own_label)
                            here = np.flatnonzero(label[part] == own_label)
                            if first == last:
                                continue
                            lower, upper = file.bounds(q[here], first, last)
                            for n, i in enumerate(here):
                                for row in positives(file, q[i], int(own[part[i]]), own_label, first, lower[n], upper[n], k):
                                    yield int(asker[part[i]]), *row
                    else:
                        lower, upper = file.bounds(q, 0, len(file.ids))
                        for n, i in enumerate(part.tolist()):
                            first, last = file.span(int(label[i]))
                            rows = np.concatenate((np.arange(first), np.arange(last, len(file.ids))))
                            windows = [window(s, low, high) for s in scores[i].as_py()]
                            for row in in_windows(file, q[n], windows, lower[n][rows], upper[n][rows], rows, k):
                                yield int(asker[i]), *row

        for b in filter(len, batches):
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                part = b.slice(begin, end - begin)
                if part.column(0)[0].as_py() != block:
                    block, held, files = part.column(0)[0].as_py(), [], None
                if not part.column(1)[0].as_py():
                    held.append(part)
                    continue
                if files is None:
                    files, held = opened(), []
                columns = list(zip(*answers(part), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    return run


def layout(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int, int]:
    """(dim, label, start, parts) of labels with blocks of their own, at most four for each block_rows rows; the number of these blocks and of the pooled ones."""
    sizes = materialize(rows.groupBy("dim", "label").agg(F.count("*").alias("n")), "label-sizes")
    own = F.col("n") * 4 >= block_rows
    total, pooled = sizes.agg(F.coalesce(F.sum(F.when(own, F.ceil(F.col("n") / block_rows))), F.lit(0)), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0))).first()
    parts = F.ceil(F.col("n") / block_rows).cast("bigint")
    start = F.coalesce(F.sum("parts").over(Window.orderBy("dim", "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = materialize(sizes.filter(own).select("dim", "label", parts.alias("parts")).select("dim", "label", start.alias("start"), "parts"), "large-labels")
    pools = max(1, -(-int(pooled) // block_rows))
    return large, int(total), pools


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, bits: int = 6, block_rows: int = 1 << 17, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition over vectors. For each anchor and each of its `positives` best rows of the same label, the
    `negatives` best rows of other labels of which the score s holds low * p <= 100 * s <= high * p for the positive's
    score p. block_rows: rows of a block at most, about; there are at least as many blocks as shuffle partitions.
    """
    require(vectors, vec_id, embedding, label)
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.coalesce(anchors & F.col(vec_id).isNotNull(), F.lit(False)).alias("anchor"), F.col(embedding).alias("v"))
    rows = materialize(given.mapInArrow(integers(scale), ROWS), "integers")
    count = rows.count()  # of a written table: file metadata
    size = max(1, min(block_rows, -(-count // shuffle_partitions(spark))))
    large, own_blocks, pools = layout(rows, size)
    blocks = own_blocks + pools
    large = F.broadcast(large)  # at most four rows for each `size` rows
    pool = F.lit(own_blocks) + F.pmod(F.xxhash64("dim", "label"), F.lit(pools))
    own = F.coalesce(F.col("start") + F.pmod(F.xxhash64("vec_id", "cells"), F.col("parts")), pool)
    sent = [c.split()[0] for c in SENT.split(", ")]
    none = F.lit(None).cast("array<bigint>").alias("scores")
    dealt = rows.join(large, ["dim", "label"], "left").select(own.alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("asker"), "vec_id", "label", "dim", "cells", none).select(sent)
    asking = rows.filter("anchor").select("vec_id", "label", "dim", "cells").distinct().join(large, ["dim", "label"], "left")
    asking = materialize(asking.withColumn("asker", F.monotonically_increasing_id()), "anchors")

    def visit(asks: DataFrame, first: bool, k: int) -> DataFrame:
        both = dealt.unionByName(asks.withColumn("asks", F.lit(True)).select(sent))
        by_block = both.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "asks")
        return by_block.mapInArrow(searcher(first, k, low, high, bits), FOUND)

    def top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    to_own = F.when(F.col("start").isNull(), F.array(pool)).otherwise(F.sequence(F.col("start"), F.col("start") + F.col("parts") - 1))
    near = visit(asking.withColumn("block", F.explode(to_own)).withColumn("scores", none), True, positives)
    near = materialize(top(near, ["asker"], positives).select("asker", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # a positive with a negative score opens no window
    opened = near.filter(F.col("positive_score") * (high - low) >= 0).groupBy("asker").agg(F.collect_set("positive_score").alias("scores"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    away = F.explode(F.filter(everywhere, lambda b: F.col("start").isNull() | (b < F.col("start")) | (b >= F.col("start") + F.col("parts"))))
    far = visit(asking.join(opened, "asker").withColumn("block", away), False, negatives)
    far = top(far, ["asker", "positive_score"], negatives)
    pairs = near.join(far, ["asker", "positive_score"]).join(asking.select("asker", F.col("vec_id").alias("anchor_id")), "asker")
    own_id = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return pairs.select("anchor_id", own_id("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), own_id("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
