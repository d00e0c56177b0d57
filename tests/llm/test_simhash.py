import numpy as np
import pytest
import xxhash

from tracetide.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    label = {i: i for i, _ in rows}
    change = True
    while change:
        change = False
        for i, a in rows:
            for j, b in rows:
                if (a ^ b).bit_count() <= 3 and label[i] > label[j]:
                    label[i], change = label[j], True
    return label


@pytest.mark.parametrize("text", ["", " \t\n", "one", "Two WORDS", "a b c", "É é A a\x0bb\x0cc\rd  e", "x " * 500, None])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = [0, 1, 7, 15, (1 << 64) - 1]
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(6):
            fps.append(x)
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(fps))]
    signed = [(i, x - (1 << 64) if x >= 1 << 63 else x) for i, x in rows]
    df = spark.createDataFrame(signed, "id long, fp long")
    for bits, most, hub in ((4, 1 << 18, 10**6), (10, 1 << 18, 5), (10, 3, 2)):
        got = {r.node: r.component for r in simhash.components(simhash.links(df, bits, most), hub=hub).collect()}
        want = brute_components(rows)
        by_fp = {f: i for i, f in signed}
        groups = {}
        for i, f in signed:
            groups.setdefault(got.get(f, f), set()).add(i)
        expected = {}
        for i in want:
            expected.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())) and by_fp


def test_near_duplicates_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(3, base, "x"), (1, base + " tail", "x"), (2, "", "x"), (5, None, "x"), (7, "other words entirely here", "x"), (7, "other words entirely here", "x"), (None, base, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    fp = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert (fp[1] ^ fp[3]).bit_count() <= 3
    assert got == [(-1, 1), (1, 1), (2, 2), (3, 1), (5, 2), (7, 7), (7, 7)]
    kept = sorted((r.doc_id or -1) for r in simhash.keep_first(df).collect())
    assert kept == [1, 2, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bits_grow_with_the_fingerprints():
    assert simhash.bits_for(0, 1 << 18) == simhash.bits_for(10**6, 1 << 18) == 10
    for n in (10**8, 10**10):
        b = simhash.bits_for(n, 1 << 18)
        index, _ = simhash.prefixes(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), b)
        assert n * len(index) / 1000 / 2**b < 1.1 * (1 << 18)


def test_splitting_a_prefix_reaches_what_longer_prefixes_reach():
    fps = np.random.default_rng(2).integers(0, 1 << 63, 200, dtype=np.uint64)
    index, short = simhash.prefixes(fps, 6)
    again, long = simhash.deeper(short, fps[index], 6, 8)
    want_index, want = simhash.prefixes(fps, 14)
    assert sorted(zip(index[again].tolist(), long.tolist())) == sorted(zip(want_index.tolist(), want.tolist()))


def test_one_row_of_each_group_stays_when_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (None, b + " end", "s"), (None, c, "t"), (None, c, "t"), (5, None, "u"), (5, b, "r"), (9, "x " * 100_000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __other string").repartition(3)
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.keep_first(df).collect() if r.text)
    assert kept == sorted([(1, a), (5, b), (-1, c), (9, "x " * 100_000)])
    assert simhash.keep_first(df).columns == df.columns and simhash.keep_first(df).count() == 5
    assert simhash.keep_first(df.limit(0)).count() == 0
