import numpy as np
import pytest

from tracetide.llm import cross_polytope as cp


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            best = {}
            for i, v in good:
                if i != q and len(v) == len(x):
                    a, b = (np.ldexp(y, -np.frexp(np.abs(y).max())[1]) for y in (x, v))
                    s = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                    best[i] = max(best.get(i, -2), s)
            out[q] = [(i, s) for s, i in sorted(((s, i) for i, s in best.items()), key=lambda t: (-t[0], t[1]))[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_transform_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    h = cp.Hashes(60, 2, 1, 3)
    assert np.allclose(np.linalg.norm(h.rotated(x[:, :60], 1, 0), axis=1), np.linalg.norm(x[:, :60], axis=1))


def test_probes_of_several_hashes_are_the_cheapest():
    h = cp.Hashes(8, 1, 2, 3)
    x = cp._units(np.random.default_rng(1).normal(size=(4, 8)))
    a, b = (np.concatenate([y, -y], axis=1) for y in (h.rotated(x, 0, 0), h.rotated(x, 0, 1)))
    cost = (((a.max(axis=1)[:, None] - a) ** 2)[:, :, None] + ((b.max(axis=1)[:, None] - b) ** 2)[:, None, :]).reshape(4, -1)
    assert (h.probes(x, 0, 6) == np.argsort(cost, axis=1, kind="stable")[:, :6]).all()


@pytest.mark.parametrize("block", [16, 1024])
def test_recall_and_exact_scores(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(60)]  # more equal vectors than ranks
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    queries = {i for i, _ in rows if i % 50 == 0} | {3}
    got = result(cp.search(df, df.filter("vec_id % 50 = 0 or vec_id = 3"), block=block))
    want = brute(rows, queries, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q in queries for i, s in brute(rows, {q}, 10**6)[q]}
    assert all(exact[q, i] == s for q in got for i, s in got[q])
    assert [i for i, _ in got[3]] == [2000, 2001, 2002, 2003, 2004]


def test_recall_with_two_hashes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(6000, 64)))]
    assert cp.hashes_for(len(rows), 64, 4) == 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = result(cp.search(df, df.filter("vec_id % 100 = 0"), bucket=4))
    x = cp._units(np.array([v for _, v in rows]))
    s = x[::100] @ x.T
    s[np.arange(60), np.arange(0, 6000, 100)] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    assert sum(len({i for i, _ in got[100 * q]} & set(want[q].tolist())) for q in range(60)) >= 0.9 * 5 * 60


def test_recall_with_three_hashes(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 16)))]
    assert cp.hashes_for(len(rows), 16, 1) == 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = set(range(0, 2000, 400))
    got, want = result(cp.search(df, df.filter("vec_id % 400 = 0"), bucket=1)), brute(rows, queries, 5)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries) >= 0.9 * 5 * len(queries)


def test_all_candidates_if_fewer(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(4)]
    rows += [(100 + i, [float(x) for x in rng.normal(size=48)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for options in ({}, {"tables": 1, "probes": 1, "block": 3}):
        got, want = result(cp.search(df, df.filter("vec_id = 2 or vec_id >= 100"), **options)), brute(rows, {2, *range(100, 140)}, 5)
        assert got[2] == want[2] and len(got[2]) == 3
        assert all(len(got[q]) == 5 for q in range(100, 140))


def test_repeated_query_ids_and_extreme_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1e-170, 1e-170]), (2, [1e200, 1e199]), (3, [1e-310, 3e-310]), (4, [0.5, 0.25]), (5, [1e308, -1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(cp.search(df, df.filter("vec_id % 50 = 0"), tables=20))
    want = {}
    for q in ([1.0, 0.0], [0.0, 1.0]):
        for i, s in brute([(0, q), *rows[2:]], {0}, 9)[0]:
            want[i] = max(s, want.get(i, -2))
    assert got[0] == sorted(want.items(), key=lambda t: (-t[1], t[0]))[:5]
    assert all(-1 <= s <= 1 + 1e-12 for _, s in got[0])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e300, 1e299]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(cp.search(df, df.filter("vec_id % 100 = 0"), tables=30))
    assert [i for i, _ in got[0]] == [100, 1, 9] and [i for i, _ in got[100]] == [0, 1, 9]
    assert cp.search(df.limit(0), df.limit(0)).count() == 0
