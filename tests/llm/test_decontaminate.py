import random
import re

import pytest

from tracetide.llm import decontaminate as d


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, n=13):
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            b = split(text)
            k = min(n, len(b))
            wins = {tuple(b[s : s + k]) for s in range(len(b) - k + 1)} if b else set()
            for s in range(len(w) - k + 1 if wins else 0):
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s + 1, s + k + 1))
                    found.add(str(item))
        out[i] = (len(w), hit, sorted(found))
    return out


def tables(spark):
    r = random.Random(11)
    vocabulary = ["Alpha", "BETA", "gamma", "Été", "été", "x1", "Σας", "İx", "ﬁ", "z"] + [f"w{i}" for i in range(30)]
    prose = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(1, prose(30)), (2, prose(13)), (3, "Alpha beta"), (4, "w3"), (5, prose(9)), (6, None), (7, "..."), (8, prose(14)), (12, prose(40))]
    rows = [(i, prose(r.randint(0, 60))) for i in range(60)]
    for i in range(60, 120):
        piece = r.choice(items)[1] or ""
        words = piece.split(" ")
        a = r.randint(0, max(0, len(words) - 1))
        rows.append((i, prose(r.randint(0, 20)) + " ".join(words[a : a + r.randint(1, 40)]).upper() + " " + prose(r.randint(0, 20))))
    rows += [(200, None), (201, ""), (202, items[0][1] * 200)]
    return rows, items, spark.createDataFrame([(*x, "c", "c") for x in rows], "doc_id long, text string, items string, win string").repartition(3), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, length int")


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_report_against_brute_force(spark, broadcast_bytes):
    rows, items, docs, bench = tables(spark)
    want = brute(rows, items)
    got = {r.doc_id: r for r in d.report(docs, bench, broadcast_bytes=broadcast_bytes).collect()}
    assert got.keys() == want.keys()
    for i, (n, hit, found) in want.items():
        assert (got[i].n_words, set(got[i].positions), sorted(got[i].items)) == (n, hit, found), i
        assert got[i].contaminated == (bool(hit) and 20 * len(hit) >= n)


def test_removal(spark):
    rows, items, docs, bench = tables(spark)
    want = brute(rows, items)
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, hit, _) in want.items() if not hit or 20 * len(hit) < n}
    texts = dict(rows)
    for r in d.decontaminate(docs, bench, remove="spans").collect():
        n, hit, _ = want[r.doc_id]
        assert split(r.text) == [w for k, w in enumerate(split(texts[r.doc_id])) if k + 1 not in hit]
        assert hit or r.text == texts[r.doc_id]
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, remove="all")


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b"), (None, "c")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit) for r in d.report(docs, bench).collect())
    assert got == [(-1, 0, 0), (-1, 2, 2), (1, 1, 1), (1, 2, 2), (1, 2, 2)]
    assert {tuple(r["items"]) for r in d.report(docs, bench).filter("n_words = 1").collect()} == {()}
    assert sorted(r.text for r in d.decontaminate(docs, bench, remove="spans").filter("doc_id = 1").collect()) == ["", " ", " "]
    assert d.report(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in d.report(docs, bench.limit(0)).collect())
