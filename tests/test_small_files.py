"""Many small files: a task reads many of them, and every row of each."""

import os
import re
import threading

import pyarrow as pa
from pyspark.sql import functions as F

from tracetide.plans import catalog
from tracetide.sources import vcd_source as vs
from tracetide.sources import writers
from tracetide.sources.ghw import GhwFiles
from tracetide.sources.vcd import VcdFiles

N = 600


def folder(tmp_path) -> dict[str, int]:
    """The numbers of steps of the files; every tenth has none."""
    steps = {}
    for i in range(N):
        steps[f"{tmp_path}/signal={i}.txt"] = n = i % 10
        (tmp_path / f"signal={i}.txt").write_text("$scope module t $end\n$var wire 1 ! a $end\n$upscope $end\n$enddefinitions $end\n" + "".join(f"#{t}\n{t % 2}!\n" for t in range(n)))
    return steps


def test_a_task_reads_many_files(spark, tmp_path):
    steps = folder(tmp_path)
    vs.register(spark)
    df = spark.read.format("vcd").load(str(tmp_path))
    assert df.rdd.getNumPartitions() <= N // 100
    found = df.filter("code = '!'").groupBy("file").agg(F.count("*").alias("n"), F.max("time").alias("t")).collect()
    assert {r.file: (r.n, r.t) for r in found} == {f: (n, n - 1) for f, n in steps.items() if n}
    assert spark.read.format("vcd").option("table", "signals").load(str(tmp_path)).select("file").distinct().count() == N


def test_a_stream_reads_many_files_in_a_task(spark, tmp_path):
    steps = folder(tmp_path)
    reader = vs.GrowingReader(str(tmp_path), vs.SPLIT_BYTES, True)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= N // 100 and sorted(r.file for p in parts for r in p.ranges) == sorted(steps)
    assert sum(len(b) for p in parts for b in reader.read(p)) == 2 * sum(steps.values())


def test_heads_are_read_by_threads_only_where_opening_is_slow(tmp_path, monkeypatch):
    steps = folder(tmp_path)
    sizes, read, used = vs.listed(str(tmp_path)), vs.head, set()

    def noted(path, size):
        used.add(threading.get_ident())
        return read(path, size)

    monkeypatch.setattr(vs, "head", noted)
    monkeypatch.setattr(vs, "SLOW", 10.0)
    offset = vs.GrowingReader(str(tmp_path), vs.SPLIT_BYTES, True).latestOffset()
    assert offset == sizes and len(offset) == len(steps) and used == {threading.get_ident()}
    monkeypatch.setattr(vs, "SLOW", 0.0)
    assert vs.GrowingReader(str(tmp_path), vs.SPLIT_BYTES, True).latestOffset() == sizes and len(used) > 1


def test_large_ranges_stay_tasks_of_their_own():
    parts = vs.packed([vs.Bytes("a", 0, 100, 250, True), vs.Bytes("a", 100, 200, 250, False), vs.Bytes("b", 0, 50, 50, True)], 100)
    assert [p.size for p in parts] == [100, 100, 50]


def test_written_files_lie_in_one_folder_and_are_listed_once(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 40).alias("signal"), F.col("id").alias("time"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "1").otherwise("0").alias("value"))
    catalog.write_vcd(catalog.vcd_text(rows), f"file:{tmp_path}/in")
    files = sorted((tmp_path / "in").iterdir())
    assert {f.name for f in files} == {f"signal={s}.txt" for s in range(40)} and all(f.is_file() for f in files)
    assert (tmp_path / "in" / "signal=7.txt").read_text() == catalog.HEADER + "\n" + "".join(f"#{t}\n{int(t % 3 == 0)}!\n" for t in range(7, 3000, 40))
    read = VcdFiles(spark, f"{tmp_path}/in")
    assert read.changes().count() == 3000
    listed = read._text
    read.steps()
    assert read._text is listed


def test_runs_of_keys():
    keys, texts = pa.array([None, None, 1, 1, 2, 1]), pa.array(list("abcdef"))
    assert list(vs.runs(keys, texts)) == [(None, "a"), (None, "b"), (1, "cd"), (2, "e"), (1, "f")]
    assert list(vs.runs(keys[:0], texts[:0])) == []


def test_ghw_files_are_read_many_to_a_task(spark, tmp_path):
    for i in range(N):
        (tmp_path / f"{i}.ghw").write_bytes(writers.ghw("s", "b", "v", 2, [(t, [(0, "1")]) for t in range(1, i % 5 + 2)]))
    files = GhwFiles(spark, str(tmp_path))
    assert files._files().rdd.getNumPartitions() <= N // 100
    bits = files.table("vars").filter("name = 'b'").select("file", "signal_id")
    assert bits.count() == N
    found = files.changes(bits).filter("bits = '1'").groupBy("file").count().collect()
    assert sorted((re.search(r"(\d+)\.ghw", r.file)[0], r["count"]) for r in found) == sorted((f"{i}.ghw", i % 5 + 1) for i in range(N))


def test_keys_of_several_arrow_batches_are_one_file(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("signal"), (-F.col("id")).alias("time"), F.col("id").alias("seq"), F.lit("1").alias("value"))
    made = catalog.written(spark, rows, "signal", "txt", lambda times, seqs, values: f"{len(values)} {times == sorted(times)} {times == [-s for s in seqs]}".encode())
    assert sorted(f"{name} {open(f'{made}/{name}').read()}" for name in os.listdir(made)) == [f"{k}.txt 20000 True True" for k in range(3)]
