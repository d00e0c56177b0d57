import random

import pytest
from pyspark.sql import functions as F

from tracetide.operators.changelog import ChangeLog, accepted_steps
from tracetide.operators.derived import Derived, Extract, evaluate_all
from tracetide.streaming import live as live_module
from tracetide.streaming.live import LiveLog

SCHEMA = "file string, signal long, time long, seq long, value string"


def log(rng, files=2, n=160):
    """Rows in file order: times mostly go on, repeat, and sometimes go back; some steps have no change."""
    rows = []
    for f in range(files):
        time, seq = 0, 0
        while seq < n:
            time = max(0, time + rng.choice([0, 1, 1, 2, 5, -1, -4]))
            for _ in range(rng.randint(0, 4)):
                rows.append((f"f{f}", rng.randint(0, 4), time, seq, rng.choice(["0", "1", "01", "10"])))
                seq += 1
            rows.append((f"f{f}", None, time, seq, None))
            seq += 1
    return rows


def brute(rows, events=()):
    """Steps by file, one row after the other: (file, time, signal) to (value, transitions); and the rows that are not late."""
    steps, kept = {}, []
    for f in sorted({r[0] for r in rows}):
        latest, late, value = None, False, {}
        for _, s, t, q, v in sorted((r for r in rows if r[0] == f), key=lambda r: r[3]):
            if latest is None or t > latest:
                latest, late = t, False
            elif t < latest:
                late = True
            if late or s is None:
                continue
            kept.append((f, s, t, q, v))
            if s not in value or value[s] != v or s in events:
                value[s] = v
                steps[f, t, s] = (v, steps.get((f, t, s), (None, 0))[1] + 1)
    return steps, sorted(kept)


def cut(rng, rows, n):
    """Pieces in file order, each of its own size in each file."""
    pieces = [[] for _ in range(n)]
    for f in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: r[3])
        at = sorted(rng.randint(0, len(mine)) for _ in range(n - 1))
        for k, (a, b) in enumerate(zip([0, *at], [*at, len(mine)], strict=True)):
            pieces[k] += mine[a:b]
    return pieces


def told(df):
    return {(r.file, r.time, r.signal): (r.value, r.transitions) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [1, 6])
def test_any_cut_gives_the_steps_of_the_whole(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(live_module, "MERGE", 4)
    rng = random.Random(n)
    rows = log(rng, n=90)
    steps, kept = brute(rows, events=[4])
    live = LiveLog(frame(spark, rows), str(tmp_path / "live"), events=[4], raw=True)
    for k, piece in enumerate(cut(rng, rows, n)):
        live.take(frame(spark, piece), k)
    assert told(live.steps()) == steps and live.steps().count() == len(steps)
    assert sorted(map(tuple, live.changes().collect())) == kept
    last = {}
    for (f, t, s), (v, _) in sorted(steps.items()):
        last[f, s] = (t, v)
    assert {(r.file, r.signal): (r.time, r.value) for r in live.values().collect()} == last
    closed = told(live.steps(open_too=False))
    tops = {f: max(t for g, _, t, *_ in rows if g == f) for f in ("f0", "f1")}
    assert closed == {k: v for k, v in steps.items() if k[1] < tops[k[0]]}


def test_a_batch_taken_again_replaces_itself(spark, tmp_path):
    rng = random.Random(5)
    rows = log(rng, files=1, n=60)
    live = LiveLog(frame(spark, rows), str(tmp_path / "live"), raw=True)
    a, b, c = cut(rng, rows, 3)
    live.take(frame(spark, a), 0)
    with pytest.raises(ZeroDivisionError):
        live.take(frame(spark, b), 1, lambda *_: 1 / 0)
    live.take(frame(spark, b), 1)
    live.take(frame(spark, c), 2)
    assert told(live.steps()) == brute(rows)[0] and live.changes().count() == len(brute(rows)[1])


def test_a_running_stream_and_its_callback(spark, tmp_path):
    rng = random.Random(9)
    rows = log(rng, n=60)
    folder = str(tmp_path / "in")
    pieces, seen = cut(rng, rows, 3), []
    frame(spark, pieces[0]).coalesce(1).write.parquet(folder)
    live = LiveLog(spark.readStream.schema(SCHEMA).parquet(folder), str(tmp_path / "live"))
    note = lambda steps, values, n: seen.append((n, told(steps), values.count()))
    live.run(note)
    for piece in pieces[1:]:
        frame(spark, piece).repartition(3).write.mode("append").parquet(folder)
        live.run(note)  # begins where the last run ended
    assert [n for n, *_ in seen] == [0, 1, 2]
    every = [k for _, steps, _ in seen for k in steps]
    assert len(every) == len(set(every))  # a time is told once
    assert told(live.steps()) == brute(rows)[0]


def test_without_file_and_empty_pieces(spark, tmp_path):
    rows = [(1, 20, 0, "1"), (2, 15, 1, "1"), (2, 20, 2, "0"), (2, 21, 3, "0"), (1, 21, 4, "1")]
    df = spark.createDataFrame(rows, "signal int, time long, seq int, value string")
    live = LiveLog(df, str(tmp_path / "live"))
    assert live.steps().count() == 0 and live.values().count() == 0
    parts = [df.filter("seq < 1"), df.limit(0), df.filter("seq >= 1")]
    for k, p in enumerate(parts):
        live.take(p.withColumn("file", F.lit("")), k)
    # time 15 is late though its signal has no change yet, and what follows it at time 20 is dropped too
    assert told(live.steps()) == {("", 20, 1): ("1", 1), ("", 21, 2): ("0", 1)}


DERIVED = [("f0", 10, 0, 0, 1, 1), ("f0", 10, 1, 1, 1, 0), ("f0", 11, 0, 0, 0, 0), ("f1", 10, 0, 2, 1, 0)]


@pytest.mark.parametrize("n", [1, 4])
def test_derived_signals_over_any_cut(spark, tmp_path, n):
    rng = random.Random(20 + n)
    rows = [(f, s, t, q, v and v.zfill(2)) for f, s, t, q, v in log(rng, n=80)]
    parts = spark.createDataFrame(DERIVED, "file string, signal long, pos int, input long, msb int, lsb int")
    live = LiveLog(frame(spark, rows), str(tmp_path / "live"), derived=parts)
    for k, piece in enumerate(cut(rng, rows, n)):
        live.take(frame(spark, piece), k)
    found = told(live.steps())
    ground = brute(rows)[0]
    assert {k: v for k, v in found.items() if k[2] < 10} == ground
    for f, out in {(d[0], d[1]) for d in DERIVED}:
        own = [Extract(i, msb, lsb) for g, s, _, i, msb, lsb in DERIVED if (g, s) == (f, out)]
        real = ChangeLog(spark.createDataFrame([(s, t, 0, v) for (g, t, s), (v, _) in ground.items() if g == f], "signal long, time long, seq int, value string"))
        want = {r.time: r.value for r in Derived(own).evaluate(real).collect()}
        assert {k[1]: v[0] for k, v in found.items() if k[0] == f and k[2] == out} == want


@pytest.mark.parametrize("slices", [1, 3])
def test_evaluate_all_equals_one_at_a_time(spark, slices):
    rng = random.Random(2)
    rows = [(s, t, 0, f"{rng.randint(0, 15):04b}") for t in range(60) for s in range(5) if rng.random() < 0.4]
    changes = ChangeLog(spark.createDataFrame(rows, "signal int, time long, seq int, value string"), slices=slices)
    parts = [(100 + k, p, rng.randint(0, 4), *sorted((rng.randint(0, 3), rng.randint(0, 3)), reverse=True)) for k in range(6) for p in range(1 + k % 3)]
    got = evaluate_all(changes, spark.createDataFrame(parts, "signal int, pos int, input int, msb int, lsb int"))
    want = {(s, r.time, r.value) for s in {p[0] for p in parts} for r in Derived([Extract(*p[2:]) for p in parts if p[0] == s]).evaluate(changes).collect()}
    assert {tuple(r) for r in got.collect()} == want


def test_accepted_steps_agree(spark):
    rows = log(random.Random(1), n=100)
    kept = accepted_steps(frame(spark, rows), within=["file"]).filter("signal is not null")
    assert sorted(map(tuple, kept.select("file", "signal", "time", "seq", "value").collect())) == brute(rows)[1]
