import random

from tracetide.llm import line_dedup as ld

WHITE = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    small = lambda i: (i is not None, i or 0)
    keeper = {k: max(v, key=small) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *map(str, r)))


def prose(rng, n):
    return "".join(rng.choice("abcdeÄéXYZ ſK") for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = [prose(rng, rng.randint(36, 60)) for _ in range(25)]
    vary = lambda s: rng.choice(["", " ", "\t", "\x0b\f"]) + (s.swapcase() if s.isascii() and rng.random() < 0.5 else s) + rng.choice(["", "\r", "  "])
    rows = [(i, "\n".join(vary(rng.choice(shared[: 1 + i % 25])) if rng.random() < 0.6 else prose(rng, rng.randint(0, 50)) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    return rows + [(i, "\n".join([shared[0]] * 3)) for i in range(200, 300)]


def test_report_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert order(map(tuple, ld.report(docs).collect())) == order(brute(rows))
    assert order(map(tuple, ld.report(docs, min_chars=3, min_docs=2).collect())) == order(brute(rows, 3, 2))


def test_thresholds_count_code_points_and_documents(spark):
    line = "é" * 40
    rows = [(i, f"{line}\n{line}\n{'é' * 39}\n{'X' * 40 if i < 4 else ''}") for i in range(5)]
    got = order(map(tuple, ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == order(brute(rows)) and [r[2] for r in got] == [2, 2, 2, 2, 0]


def test_nulls_repeats_and_clashing_columns(spark):
    line = "The same line in every document, of over forty."
    rows = [(None, line), (None, f"a\n{line}"), (1, line), (1, line), (1, "b\n\n" + line.upper()), (2, line), (3, f"{line}\n{line}\nend"), (9, f"x\n {line}\r"), (9, f"y\n{line}"), (4, None), (5, ""), (6, "\n")]
    docs = spark.createDataFrame([(*r, 1, "k", [0]) for r in rows], "doc_id long, text string, pos int, line_key string, cuts array<int>")
    assert order(map(tuple, ld.report(docs).collect())) == order(brute(rows))
    kept = ld.deduplicate(docs)
    assert kept.schema == docs.schema
    want = [(i, None if t is None else k) for (i, t), (_, _, _, k) in zip(rows, brute(rows), strict=True)]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert order(got) == order(want) and {(r.pos, r.line_key, tuple(r.cuts)) for r in kept.collect()} == {(1, "k", (0,))}
    assert ld.report(docs.limit(0)).count() == 0 and ld.deduplicate(docs.limit(0)).columns == docs.columns
    named = docs.select(docs.doc_id.cast("string").alias("id"), docs.text.alias("body"))
    assert sum(r.n_dropped for r in ld.report(named, text="body", id_col="id").collect()) == sum(r[2] for r in brute(rows))


def test_long_text_is_linear(spark):
    line, n = "one line that a long text repeats very many times", 60_000
    rows = [(i, f"{line}\nother {i}") for i in range(6)] + [(-1, "\n".join([line, "kept"] * n))]
    got = {r.doc_id: r for r in ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[-1].n_dropped == n and got[-1].kept == "\n".join(["kept"] * n)
    assert got[5].n_dropped == 0 and got[4].kept == "other 4"


def test_hot_lines_are_broadcast_and_the_rest_is_shuffled(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (1, 1 << 40):  # none is hot; all are
        monkeypatch.setattr(ld, "HOT", hot)
        assert order(map(tuple, ld.report(docs).collect())) == order(brute(rows))
