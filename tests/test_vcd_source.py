import random

import pytest
from pyspark.sql import functions as F

from tracetide.operators.changelog import ChangeLog, accepted_steps
from tracetide.sources import vcd_source as vs
from tracetide.sources.vcd import Scanner, VcdFiles
from tracetide.streaming.live import LiveLog

HEAD = "$date\n#1 not a step, $enddefinitions too\n$end\n$timescale 1ns $end\n$scope module top $end\n$var wire 1 ! a $end\n$var wire 4 # b [3:0] $end\n$var real 64 %1 r $end\n$var string 0 s s $end\n$upscope $end\n$enddefinitions $end\n"


def body(rng, n, back=False):
    time, out = 0, ["$dumpvars\n0!\nbx #\n$end\n" if rng.random() < 0.5 else ""]
    for _ in range(n):
        time = max(0, time + rng.choice([0, 1, 2, 3] + ([-2] if back else [])))
        out.append(f"#{time}\n" + "".join(rng.choice(["0!", "1!", f"b{rng.randint(0, 15):b} #", f"r{rng.random()} %1", r"sh\x20i s", "$comment no step $end"]) + "\n" for _ in range(rng.randint(0, 3))))
    return "".join(out)


@pytest.fixture(scope="module")
def session(spark):
    vs.register(spark)
    return spark


def load(session, path, **options):
    return session.read.format("vcd").options(**options).load(str(path))


def plain(df):
    return sorted(map(tuple, df.select("signal", "time", "value").collect()), key=str)


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_rows_equal_the_text_reader(session, tmp_path, split):
    rng = random.Random(split)
    for k in range(3):
        (tmp_path / f"{k}.vcd").write_text(HEAD + body(rng, 60, back=True))
    log = vs.valued(load(session, tmp_path, splitBytes=str(split)), load(session, tmp_path, table="signals"))
    kept = accepted_steps(log, within=["file"]).filter("signal is not null")
    files = VcdFiles(session, str(tmp_path))
    value = F.coalesce("bits", "str", F.col("real").cast("string"))
    want = files.changes().select(F.substring_index("file", "/", -1).alias("file"), F.col("signal_id").alias("signal"), "time", value.alias("value"))
    got = kept.select(F.substring_index("file", "/", -1).alias("file"), "signal", "time", "value")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [r.time for r in log.filter("file like '%0.vcd' and value is not null").orderBy("seq").collect()][:2] == [r.time for r in files.changes().filter("file like '%0.vcd'").orderBy("seq").limit(2).collect()]


@pytest.mark.parametrize("table", ["meta", "scopes", "vars", "signals", "derived", "enums"])
def test_catalog_tables(session, tmp_path, table):
    (tmp_path / "x.vcd").write_text(HEAD + "#0\n1!\n")
    got, want = load(session, tmp_path / "*.vcd", table=table), VcdFiles(session, str(tmp_path)).table(table)
    assert got.drop("file").dtypes == want.drop("file").dtypes
    assert sorted(map(str, got.drop("file").collect())) == sorted(map(str, want.drop("file").collect()))


def test_conditions_are_pushed_down(session, tmp_path, monkeypatch):
    (tmp_path / "x.vcd").write_text(HEAD + "".join(f"#{t}\n{t & 1}!\nb{t & 15:b} #\n" for t in range(500)))
    df = load(session, tmp_path, splitBytes="256").filter("time >= 100 and time < 120 and code = '!'")
    assert [(r.time, r.rest) for r in df.orderBy("seq").collect()] == [(t, "") for t in range(100, 120)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan vcd" in plan and ">= 100" not in plan and "< 120" not in plan
    # of all ranges, only those with wanted times become tokens
    seen = []
    many = Scanner.many
    monkeypatch.setattr(Scanner, "many", lambda self, data, *a: seen.append(len(data)) or many(self, data, *a))
    reader = vs.ChangeReader(str(tmp_path), 256)
    assert list(reader.pushFilters([vs.GreaterThan(("time",), 99), vs.LessThanOrEqual(("time",), 119), vs.EqualTo(("code",), "#"), vs.EqualTo(("rest",), "x")])) == [vs.EqualTo(("rest",), "x")]
    ranges = reader.partitions()
    times = [t for p in ranges for b in reader.read(p) for t in b.column("time").to_pylist()]
    assert times == list(range(100, 120)) and len(ranges) > 20
    assert sum(seen) < (tmp_path / "x.vcd").stat().st_size / 5


def grow(path, text, rng):
    """Appends a piece of any length."""
    n = rng.randint(1, len(text))
    with open(path, "a") as f:
        f.write(text[:n])
    return text[n:]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_file_that_is_still_written(session, tmp_path, seed):
    rng = random.Random(seed)
    folder = tmp_path / "dumps"
    folder.mkdir()
    rest = {k: HEAD + body(rng, 25, back=True) for k in "ab"}
    whole = dict(rest)

    def run(**more):
        stream = session.readStream.format("vcd").options(splitBytes="200", **more).load(str(folder))
        return LiveLog(vs.valued(stream, load(session, folder, table="signals")), str(tmp_path / "live"), raw=True).run()

    (folder / "a.vcd").write_text(HEAD)
    rest["a"] = rest["a"][len(HEAD) :]
    while any(rest.values()):
        for k in "ab":
            if rest[k]:
                if k == "b" and not (folder / "b.vcd").exists():
                    (folder / "b.vcd").write_text(HEAD)
                    rest["b"] = rest["b"][len(HEAD) :]
                rest[k] = grow(folder / f"{k}.vcd", rest[k], rng)
        live = run()
    live = run(complete="true")
    assert {k: (folder / f"{k}.vcd").read_text() for k in "ab"} == whole
    log = vs.valued(load(session, folder), load(session, folder, table="signals"))
    want = accepted_steps(log, within=["file"]).filter("signal is not null")
    in_order = lambda df: [(r.file, r.signal, r.time, r.value) for r in df.orderBy("file", "seq").collect()]
    assert in_order(live.changes()) == in_order(want)
    for k in "ab":
        own = ChangeLog(want.filter(F.col("file").endswith(f"{k}.vcd"))).time_steps()
        got = live.steps().filter(F.col("file").endswith(f"{k}.vcd"))
        assert sorted(map(tuple, got.select("time", "signal", "value", "transitions").collect())) == sorted(map(tuple, own.select("time", "signal", "value", "transitions").collect()))


def test_offsets_end_between_steps(tmp_path):
    path = tmp_path / "x.vcd"
    reader = vs.GrowingReader(str(tmp_path), 1 << 20, False)
    path.write_text(HEAD[:100])
    assert reader.latestOffset() == {}
    path.write_text(HEAD + "0!\n#5")
    assert reader.latestOffset() == {str(path): len(HEAD) + 3}
    path.write_text(HEAD + "0!\n#5\n1!\n" + "#")
    assert reader.latestOffset() == {str(path): len(HEAD) + 9}
    (first,) = reader.partitions({}, reader.latestOffset())
    assert [r for b in reader.read(first) for r in b.column("time").to_pylist()] == [0, 0, 5, 5]
    path.write_text(HEAD + "0!\n#5\n1!\n#6\n" + "0!\n" * 50_000 + "#7")
    assert vs.last_record(str(path), len(HEAD), path.stat().st_size) == path.stat().st_size - 2
    complete = vs.GrowingReader(str(tmp_path), 1 << 20, True)
    assert complete.latestOffset() == {str(path): path.stat().st_size}
    (tmp_path / "bad.vcd").write_text("no header")
    assert str(tmp_path / "bad.vcd") not in complete.latestOffset()
