import random

import pytest
from pyspark.sql import functions as F

from tracetide.operators.changelog import ChangeLog, accepted_steps
from tracetide.sources.kept import KeptLog

SCHEMA = "signal int, time long, seq long, value string"


def plain(rows, events=()):
    """(changes, times) by a loop over the rows in order."""
    latest, ok, held, out, times = None, None, {}, [], []
    for signal, time, seq, value in rows:
        if time is None:
            continue
        if latest is None or time > latest:
            latest, ok = time, True
            times.append(time)
        elif time < latest:
            ok = False
        if ok and signal is not None:
            if signal in events or signal not in held or held[signal] != value:
                out.append((signal, time, seq, value))
            held[signal] = value
    return sorted(out), list(enumerate(times))


def random_rows(seed, n=300):
    r, at, out = random.Random(seed), 0, []
    for seq in range(n):
        at += r.choice([0, 0, 1, 2, -3 if r.random() < 0.3 else 0])
        out.append((r.choice([None, 0, 0, 0, 1, 2, 3]), None if r.random() < 0.02 else at, seq, r.choice(["0", "1", "1", None])))
    return out


def kept(log):
    return sorted(tuple(r) for r in log.changes().collect()), sorted(tuple(r) for r in log.time_table().collect())


@pytest.mark.parametrize("seed, pieces", [(1, 3), (2, 10)])
def test_any_cut_into_appends_gives_the_rows_of_one_write(spark, tmp_path, seed, pieces):
    rows = random_rows(seed)
    cuts = sorted(random.Random(seed).sample(range(len(rows)), pieces - 1))
    log = KeptLog.create(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA), buckets=4, events=[3])
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        log.append(spark.createDataFrame(rows[a:b], SCHEMA))
    assert kept(log) == plain(rows, [3])
    assert log.appends() == pieces
    again = KeptLog(spark, f"{tmp_path}/log", events=[3])
    assert kept(again) == plain(rows, [3])
    accepted = plain([x for x in rows if x[1] is not None], [0, 1, 2, 3])[0]
    assert {r.signal: (r.time, r.seq, r.value) for r in again.last().collect()}.keys() == {s for s, *_ in accepted}


def test_appends_equal_the_batch_operators(spark, tmp_path):
    rows = spark.createDataFrame([x for x in random_rows(5) if x[0] is not None and x[1] is not None], SCHEMA)
    log = KeptLog.create(spark, f"{tmp_path}/log", rows, buckets=4)
    log.append(rows.filter("seq < 120"))
    log.append(rows.filter("seq >= 120"))
    want = ChangeLog(accepted_steps(rows)).dedup().df.collect()
    assert kept(log)[0] == sorted(tuple(r) for r in want)


def test_edge_cases(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    log = KeptLog.create(spark, f"{tmp_path}/log", empty, buckets=2)
    assert kept(log) == ([], []) and log.last().count() == 0 and log.appends() == 0
    log.append(empty)
    log.append(spark.createDataFrame([(1, None, 1, "a"), (None, 4, 2, None)], SCHEMA))
    log.append(empty)
    log.append(spark.createDataFrame([(1, 4, 3, "a", "x"), (1, 4, 3, "a", "x"), (2, 3, 4, "b", "x"), (1, 7, 5, "y" * 200_000, "x")], SCHEMA + ", file string"))
    assert kept(log) == ([(1, 4, 3, "a"), (1, 7, 5, "y" * 200_000)], [(0, 4), (1, 7)])


def test_rows_of_a_failed_append_are_not_read(spark, tmp_path, monkeypatch):
    log = KeptLog.create(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA), buckets=2)
    log.append(spark.createDataFrame([(1, 1, 1, "a")], SCHEMA))
    write = KeptLog._write

    def torn(self, df, name, n):
        if name == "last":
            raise OSError("lost")
        return write(self, df, name, n)

    more = spark.createDataFrame([(1, 2, 2, "b"), (2, 3, 3, "c")], SCHEMA)
    monkeypatch.setattr(KeptLog, "_write", torn)
    with pytest.raises(OSError):
        log.append(more)
    monkeypatch.undo()
    assert spark.table(log.name).count() == 3 and kept(log) == ([(1, 1, 1, "a")], [(0, 1)])
    log.append(more)
    assert kept(log) == ([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 3, 3, "c")], [(0, 1), (1, 2), (2, 3)])


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_plans_read_the_buckets_asked_for_and_move_only_probes(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 40).cast("int").alias("signal"), F.col("id").alias("time"), F.col("id").alias("seq"), F.col("id").cast("string").alias("value"))
    log = KeptLog.create(spark, f"{tmp_path}/log", rows, buckets=8)
    log.append(rows.filter("time < 2500"))
    log.append(rows.filter("time >= 2500"))
    asked = log.changes([3], start=100, end=3000)
    told = [spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") for df in (asked, log.log([3]).dedup().df)]
    assert "GreaterThanOrEqual(time,100)" in told[0].split("PushedFilters")[1] and "SelectedBucketsCount: 1 out of 8" in told[1]
    assert "Exchange" not in plan(log.log().dedup().df) and "Exchange" not in plan(log.log().positions())
    probes = spark.createDataFrame([(i % 50, i * 37) for i in range(100)], "signal long, time long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = log.value_at(probes)
    assert plan(found).count("Exchange") == 1
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = ChangeLog(rows).value_at(probes.withColumn("signal", F.col("signal").cast("int")))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    own = {r[0].rsplit("/", 1)[1] for r in asked.select(F.input_file_name()).distinct().collect()}
    others = [f for f in (tmp_path / "log" / "changes").glob("*.parquet") if f.name not in own]
    asked = log.changes([3], start=100, end=3000)
    for f in others:  # files that are not read need not be there
        f.unlink()
    assert others and asked.count() == len(range(123, 3001, 40))
