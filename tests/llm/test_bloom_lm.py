import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracetide.llm import bloom_lm


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [None]


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    counts = rng.geometric(0.05, len(keys))
    bits = 2
    bucket, rest = (keys >> np.uint64(62)).astype(int), bloom_lm._remainder(keys, bits)
    segments = [bloom_lm.segment(b, rest[bucket == b], counts[bucket == b], 12) for b in range(4)]
    level = bloom_lm.Filter(b"".join(segments), [len(s) for s in segments], bits).level(keys)
    want = bloom_lm.levels_of(counts)
    assert (level >= want).all() and (level == want).mean() > 0.97
    other = bloom_lm.Filter(b"".join(segments), [len(s) for s in segments], bits).level(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (other > 0).mean() < 0.03


def test_levels_round_down():
    c = np.arange(1, 5000)
    level = bloom_lm.levels_of(c)
    held = bloom_lm.level_counts(level)
    steps = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096])
    assert (held == steps[np.searchsorted(steps, c, "right") - 1]).all() and (steps[level - 1] == held).all()
    assert bloom_lm.level_counts(np.array([0]))[0] == 0


def model(rows, is_held):
    """Counts of words, pairs and words before others, as dictionaries."""
    words, both, before = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if not is_held(i):
            tokens = split(t)
            words.update(tokens)
            for a, b in zip(["<", *tokens], tokens):
                both[a, b] += 1
                before[a] += 1
    return words, both, before


def down(c):
    return max((x for k in range(20) for x in (2**k, 3 * 2**k) if x <= c), default=0)


def test_probabilities_after_a_word_sum_to_at_most_one():
    rows = [(i, " ".join(random.Random(i).choices("a b c d e f g".split(), k=40))) for i in range(60)]
    words, both, before = model(rows, lambda i: False)
    n, v = sum(words.values()), len(words)
    for w, c in before.items():
        known = list(words)
        pairs = np.array([down(both[w, x]) for x in known], float)
        _, p = bloom_lm.word_probability(np.array([words[x] for x in known] + [0]), np.full(v + 1, c), n, v, np.append(pairs, 0), 100.0)
        assert 0.8 < p.sum() <= 1 + 1e-12


def test_scores_against_brute_force(spark):
    r = random.Random(6)
    vocabulary = ["Alpha", "beta", "É", "gamma.", "delta"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        words = [r.choice(vocabulary[: r.choice([5, 50, 305])]) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words), "x"))
    rows += [(399, "delta beta " * 60_000, "x"), (400, None, "x"), (401, "", "x"), (402, "unseen words only", "x"), (403, "beta beta", "x"), (403, "beta beta", "x"), (None, "alpha", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {}
    for x in bloom_lm.score(df, held, batch_bytes=2000).collect():
        got.setdefault(x.doc_id, []).append(x)
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t, _ in rows if not is_held(i) for w in split(t))
    n, v = sum(train.values()), len(train)
    _, both, before = model(rows, is_held)
    excess = []
    for i, t, _ in rows:
        x = got[i][0]
        tokens = split(t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (is_held(i), len(tokens), sum(w in train for w in tokens), n)
        assert math.isclose(x.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        want = 0.0
        for a, b in zip(["<", *tokens], tokens):
            want += math.log10((down(both[a, b]) + 100 * (train[b] + 1) / (n + v + 1)) / (before[a] + 100))
        assert x.score >= want * (1 + 1e-9)  # false answers of the filter only add
        excess.append((x.score - want) / len(tokens))
    assert sum(excess) / len(excess) < 0.02
    assert len(got[403]) == 2 and sum(map(len, got.values())) == len(rows)
    assert bloom_lm.score(df.limit(0), held).count() == 0


def test_a_filter_over_the_broadcast_bound_loses_no_pairs(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(0, 80))) or None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    whole, asked = (sorted(map(tuple, bloom_lm.score(df, held, filter_bytes=n, batch_bytes=2000).collect())) for n in (128 << 20, 4096))
    assert asked == whole
