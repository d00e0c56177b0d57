import hashlib
import random

import numpy as np

from tracetide.llm import suffixes


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0]):
        mark = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(t, mark) if not m)
        spans = bytes(mark).replace(b"\0", b" ").split()
        out[i] = (len(t), sum(mark), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def rows_of(seed, n=60):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh é€😀 "][seed % 2]
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [word(r.randint(80, 400)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else word(r.randint(0, 150)) for _ in range(r.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(n * 3 + 1, rows[2][1]), (n * 3 + 2, "z" * 350), (n * 3 + 3, "y" + "z" * 150), (n * 3 + 4, None), (n * 3 + 5, ""), (n * 3 + 6, "q" * 99), (n * 3 + 7, "q" * 100)]
    return rows


def result(df, **options):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.removed(df, **options).collect()}


def test_against_brute_force(spark):
    for seed in range(2):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = brute(rows, 100)
        assert result(df) == want
        assert result(df, hot=3) == want  # digits that occur often travel window by window


def test_edge_cases(spark):
    r = random.Random(3)
    t = "".join(r.choice("abc") for _ in range(300))
    df = spark.createDataFrame([(1, t, "k"), (1, t, "k"), (None, t, "k"), (2, None, None)], "doc_id long, text string, key string")
    got = sorted(tuple(r)[1:5] for r in suffixes.removed(df).select("key", "id", "n_bytes", "n_removed", "n_spans").collect())
    assert got == [(suffixes.NO_ID, 300, 0, 0), (1, 300, 300, 1), (1, 300, 300, 1), (2, 0, 0, 0)]
    assert suffixes.removed(df.limit(0)).count() == 0
    cleaned = sorted((r.doc_id or -1, r.text, r.key) for r in suffixes.deduplicate(df).collect() if r.text is not None)
    assert cleaned == [(-1, t, "k"), (1, "", "k"), (1, "", "k")]


def test_long_texts_in_segments():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, suffixes.SEGMENT + 5000).astype(np.uint8)
    start, count, _, _ = suffixes.text_runs(text, 100, 24)
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(text) - 99


def test_ids_of_other_types_are_ordered_as_they_are(spark):
    rows = rows_of(0, 30)
    named = [(f"d{1000 + i}", t, "k") for i, t in rows]
    df = spark.createDataFrame([*named, (None, rows[3][1], "k"), (None, None, "k")], "doc_id string, text string, id string").repartition(4)
    want = brute([("", rows[3][1]), *[(i, t) for i, t, _ in named]], 100)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.removed(df).collect() if r.id or r.n_bytes}
    assert got == {i or None: x for i, x in want.items()}
    kept = {r.doc_id: r.text for r in suffixes.deduplicate(df).collect() if r.doc_id or r.text}
    assert {i: len((t or "").encode()) for i, t in kept.items()} == {i or None: n - m for i, (n, m, _, _) in want.items()}
    assert suffixes.deduplicate(df.limit(0)).count() == 0


def test_documents_of_one_hash_keep_to_their_own_spans(spark, monkeypatch):
    rows = rows_of(0, 30)
    monkeypatch.setattr(suffixes, "document_key", lambda *_: suffixes.F.lit(5).cast("long"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows, 100)
    assert result(df, hot=3) == brute(rows, 100)
    cleaned = {r.doc_id: len((r.text or "").encode()) for r in suffixes.deduplicate(df).collect()}
    assert cleaned == {i: n - m for i, (n, m, _, _) in brute(rows, 100).items()}


def test_runs_of_a_digit_that_is_everywhere_are_not_counted_in_one_task(spark):
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    line = word(140)
    rows = [(i, line + word(60) if i % 3 == 0 else word(200)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = suffixes.keyed_documents(df, "doc_id", "text")
    digits = suffixes.repeated_digits(keyed, 100, 24, 20_000, 16)
    assert digits.filter("start < 0").count() == 0 and digits.filter("hot").select("key").distinct().count() == 1000
    assert result(df) == brute(rows, 100)
    sent = suffixes.counted_runs(keyed, 100, 24, 16, 512, 64)
    biggest = max(len(r.start) // 4 for r in sent.filter("bucket < 16").collect())
    assert biggest < 1000  # 1,000 runs of the line in each of its digits, 250 to a task
