"""Approximate nearest neighbours by cross-polytope hashing.

Each table applies `hashes` pseudo-rotations (three rounds of random signs and a
fast Hadamard transform) and assigns a unit vector to the nearest signed axis of
each. Vectors go to one bucket per table; a query probes the `probes` buckets
(times 4 * `probes` for each further hash, which keeps the recall of one hash)
whose axes are nearest. Queries meet the vectors of a bucket in one group, where
cosines are computed in double precision on the original vectors, and each group
returns only a query's best `k`. The number of hashes grows with the number of
vectors of a length, so that buckets keep about the same size. Buckets over
`block` rows are split among several groups, each of which the queries visit, so
that no group is unbounded. Queries that find fewer than `k` this way are compared
with all vectors of their length, in blocks.

Equal vectors are hashed once, with their `k + 1` smallest ids: no other id of
that vector can be among a query's best. Null ids and vectors that are null,
empty, zero or hold null or non-finite components take no part; vectors of
different length are never compared. Of several rows with one id the nearest
counts. No query is its own candidate, by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracetide.llm.common import materialize, require


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


class Hashes:
    """Pseudo-rotations of `tables` tables with `hashes` each, for vectors of `dim` components."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int):
        self.dim, self.tables, self.hashes = dim, tables, hashes
        self.width = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def rotated(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for signs in self.signs[table, which]:
            y = hadamard(y * signs)
        return y

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The `count` nearest buckets of each row, the nearest first."""
        buckets = cost = None
        for which in range(self.hashes):
            y = self.rotated(x, table, which)
            signed = np.concatenate([y, -y], axis=1)
            m = min(count, signed.shape[1])
            axes = np.argsort(-signed, axis=1, kind="stable")[:, :m]
            near = np.take_along_axis(signed, axes, axis=1)
            penalty = (near[:, :1] - near) ** 2
            if buckets is None:
                buckets, cost = axes, penalty
            else:
                # both are sorted: at least (i + 1) * (j + 1) pairs cost no more than the pair (i, j)
                i, j = np.nonzero(np.outer(np.arange(1, cost.shape[1] + 1), np.arange(1, m + 1)) <= count)
                buckets = buckets[:, i] * signed.shape[1] + axes[:, j]
                cost = cost[:, i] + penalty[:, j]
                best = np.argsort(cost, axis=1, kind="stable")[:, :count]
                buckets, cost = (np.take_along_axis(v, best, axis=1) for v in (buckets, cost))
        return buckets


def hashes_for(rows: int, dim: int, bucket: int = 1024) -> int:
    """Hashes per table so that buckets hold about `bucket` rows at most."""
    n, side = 1, 2 * max(2, dim)
    while rows > bucket * side**n:
        n += 1
    return n


def probes_for(probes: int, hashes: int) -> int:
    """Buckets a query probes in a table: further hashes split near vectors too, so probes**hashes would lose a fifth of them."""
    return probes * (4 * probes) ** (hashes - 1)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision; equal rows give equal results wherever they stand.

    Rows are scaled by powers of two first, which keeps squares finite and alters no digit.
    """
    q, v = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (q, v))
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def best_of(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: list[list[int]], k: int, rows: int = 256) -> Iterator[tuple[int, int, float]]:
    """(query row, id, cosine) of at least the k nearest of v for each query."""
    uv, sizes = _units(v), np.array([len(x) for x in ids])
    for at in range(0, len(q), rows):
        part = q[at : at + rows]
        s = _units(part) @ uv.T
        m = min(len(v), k + 1)  # one may be the query itself
        least = np.partition(s, len(v) - m, axis=1)[:, len(v) - m]
        i, j = np.nonzero(s >= least[:, None] - 1e-9)
        score = cosines(part[i], v[j])
        i, score, found = np.repeat(i, sizes[j]), np.repeat(score, sizes[j]), np.array([x for y in j for x in ids[y]], np.int64)
        other = found != own[at + i]
        i, score, found = i[other], score[other], found[other]
        order = np.lexsort((found, -score, i))
        i, score, found = i[order], score[order], found[order]
        first = np.searchsorted(i, i, "left")
        keep = np.arange(len(i)) - first < k
        yield from zip((i[keep] + at).tolist(), found[keep].tolist(), score[keep].tolist(), strict=True)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): rows that take part."""
    require(df, vec_id, embedding)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


#: Rows sent on at a time, which bounds memory when a query probes many buckets.
SENT_ROWS = 1 << 16
SENT = "tbl int, bucket bigint, part int, query boolean, ids array<bigint>, v {v}"


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = 10, probes: int = 8, block: int = 1024, seed: int = 11, bucket: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of `vectors` for each row of `queries`.

    bucket: rows per bucket from which on a table gets one more hash.
    """
    rows = usable(vectors, vec_id, embedding)
    kind = rows.schema["v"].dataType.simpleString()
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    distinct = materialize(numbered.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    # lengths whose vectors need more than one hash; few, as each has thousands of vectors
    counts = {r.n: r["count"] for r in distinct.groupBy(F.size("v").alias("n")).count().filter(F.col("count") > 4 * bucket).collect()}
    sought = usable(queries, vec_id, embedding).distinct()

    def sender(is_query: bool):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in filter(len, batches):
                for r, x in _matrix(b.column(1)):
                    dim = x.shape[1]
                    h, u = Hashes(dim, tables, hashes_for(counts.get(dim, 0), dim, bucket), seed), _units(x)
                    wanted = probes_for(probes, h.hashes) if is_query else 1
                    step = max(1, SENT_ROWS // wanted)
                    for t, k in ((t, k) for t in range(tables) for k in range(0, len(r), step)):
                        found = h.probes(u[k : k + step], t, wanted)
                        at = pa.array(np.repeat(r[k : k + step], found.shape[1]))
                        n = len(at)
                        place = found.ravel() * 65_536 + dim  # lengths do not share buckets
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(place), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, is_query)), b.column(0).take(at), b.column(1).take(at)], ["tbl", "bucket", "part", "query", "ids", "v"])

        return send

    schema = SENT.format(v=kind)
    indexed = distinct.select("ids", "v").mapInArrow(sender(False), schema)
    probing = sought.select(F.array("vec_id").alias("ids"), "v").mapInArrow(sender(True), schema)
    sizes = indexed.groupBy("tbl", "bucket").count().filter(F.col("count") > block).select("tbl", "bucket", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    sizes = materialize(sizes, "large")  # the few buckets over `block` rows
    parts = F.coalesce(F.col("parts"), F.lit(1))
    indexed = indexed.join(sizes, ["tbl", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), parts).cast("int")).drop("parts")
    probing = probing.join(sizes, ["tbl", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    columns = ["tbl", "bucket", "part", "query", "ids", "v"]

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        asks = group.column("query").to_numpy()
        out: list[tuple[int, int, float]] = []
        if asks.any() and not asks.all():
            ids = group.column("ids").to_pylist()
            (_, x), *_ = _matrix(group.column("v").combine_chunks())
            own = np.array([ids[i][0] for i in np.flatnonzero(asks)])
            given = np.flatnonzero(~asks)
            out = [(int(own[i]), j, s) for i, j, s in best_of(x[asks], own, x[given], [ids[i] for i in given], k)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    met = indexed.select(columns).union(probing.select(columns)).groupBy("tbl", "bucket", "part").applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    found = materialize(met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "neighbours")
    few = sought.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).filter(F.col("n") >= k), "vec_id", "left_anti")
    few = materialize(few, "few")
    asking = {r.n: r["count"] for r in few.groupBy(F.size("v").alias("n")).count().collect()}  # lengths, not rows
    if asking:
        found = found.union(exhaustive(distinct, few, asking, meet, block))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exhaustive(distinct: DataFrame, few: DataFrame, asking: dict[int, int], meet, block: int) -> DataFrame:
    """The given queries against all vectors of their length: blocks of vectors meet blocks of queries."""
    spark = distinct.sparkSession
    per = spark.createDataFrame([(d, -(-n // block)) for d, n in asking.items()], "n int, q_parts bigint")
    vectors = distinct.withColumn("n", F.size("v")).join(F.broadcast(per), "n")
    v_parts = F.broadcast(vectors.groupBy("n", "q_parts").agg(F.ceil(F.count("*") / block).cast("bigint").alias("v_parts")))
    own = lambda parts: F.pmod(F.xxhash64("v"), parts)
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    vectors = vectors.join(v_parts, ["n", "q_parts"]).select(F.col("n").alias("tbl"), F.lit(False).alias("query"), "ids", "v", own(F.col("v_parts")).alias("bucket"), every(F.col("q_parts")).alias("part"))
    asks = few.withColumn("n", F.size("v")).join(v_parts, "n").select(F.col("n").alias("tbl"), F.lit(True).alias("query"), F.array("vec_id").alias("ids"), "v", every(F.col("v_parts")).alias("bucket"), own(F.col("q_parts")).alias("part"))
    return asks.unionByName(vectors).groupBy("tbl", "bucket", "part").applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
