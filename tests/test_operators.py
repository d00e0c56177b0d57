import random

import pytest
from pyspark.sql import functions as F

from tracetide.builder import Encoder, HierarchyBuilder, encoded
from tracetide.functions import values
from tracetide.operators import derived, hierarchy
from tracetide.operators.changelog import ChangeLog, accepted_steps, delta_times, undelta_times
from tracetide.operators.derived import Derived, Extract
from tracetide.streaming import steps


def log_of(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = [(0 if r.random() < 0.4 else r.randint(1, 5), t // 3, t, r.choice(["0", "1", "x", None])) for t in range(n)]
    return rows, ChangeLog(spark.createDataFrame(rows, "signal long, time long, seq long, value string"))


def brute_dedup(rows):
    last, out = {}, []
    for s, t, q, v in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if s not in last or last[s] != v:
            out.append((s, t, q, v))
        last[s] = v
    return out


@pytest.mark.parametrize("slices", [1, 7])
def test_dedup_and_lookup(spark, slices):
    rows, log = log_of(spark)
    log.slices = slices
    assert sorted(map(tuple, log.dedup().df.collect()), key=str) == sorted(brute_dedup(rows), key=str)
    probes = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate((s, t) for s in range(7) for t in range(-2, 140, 5))], "signal long, time long, id long")
    for r in log.value_at(probes).collect():
        found = [(t, q, v) for s, t, q, v in rows if s == r.signal and t <= r.time]
        assert (r.found_time, r.value) == ((max(found)[0], max(found, key=lambda x: x[:2])[2]) if found else (None, None))


def test_time_table_and_slices(spark):
    rows, log = log_of(spark)
    times = sorted({r[1] for r in rows})
    assert sorted(map(tuple, log.time_table().collect())) == list(enumerate(times))
    mine = [(t, q) for s, t, q, _ in sorted(rows) if s == 0]
    for a, b, c in ((None, None, 1), (2, -3, 2), (-5, None, 1), (5, 2, 1), (0, 100000, 3)):
        got = [(r.time, r.seq) for r in log.slice(a, b, c).filter("signal = 0").orderBy("idx").collect()]
        assert got == mine[a:b:c]


def test_accepted_steps(spark):
    df = spark.createDataFrame(list(enumerate([4, 1, 4, 4, 5, 2, 5, 6, 6])), "seq long, time long")
    assert [r.seq for r in accepted_steps(df).orderBy("seq").collect()] == [0, 4, 7, 8]


def test_derived(spark):
    rows = [(1, 0, 0, "0101"), (2, 2, 1, "11"), (1, 5, 2, "1101"), (1, 7, 3, "1100")]
    log = ChangeLog(spark.createDataFrame(rows, "signal long, time long, seq long, value string"))
    d = Derived([Extract(1, 3, 2), Extract(1, 1, 1), Extract(2, 0, 0)])
    assert [p.width for p in d.parts] == [3, 1] and d.width == 4
    assert sorted(map(tuple, d.evaluate(log).collect())) == [(0, "010x"), (2, "0101"), (5, "1101")]


@pytest.mark.parametrize("slices", [1, 5])
def test_derived_against_brute_force(spark, slices):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3]), t // 2, t, f"{r.randint(0, 3):02b}") for t in range(20, 200)]
    log = ChangeLog(spark.createDataFrame(rows, "signal long, time long, seq long, value string"), slices=slices)
    held, by_time = {}, {}
    for s, t, _, v in rows:
        held[s] = v
        by_time[t] = held.get(1, "xx") + held.get(2, "xx")[1]
    want, last = [], None
    for t, v in sorted(by_time.items()):
        if v != last:
            want.append((t, v))
        last = v
    assert sorted(map(tuple, Derived([Extract(1, 1, 0), Extract(2, 0, 0)]).evaluate(log).collect())) == want


def test_delta_round_trip(spark):
    times = sorted(random.Random(5).sample(range(10_000), 500))
    df = delta_times(spark.createDataFrame([(t,) for t in times], "time long"))
    assert [r.delta for r in df.orderBy("time_idx").collect()] == [b - a for a, b in zip([0, *times], times)]
    back = undelta_times(df.drop("time"), "time_idx", span=7)
    assert [(r.time_idx, r.time) for r in back.orderBy("time_idx").collect()] == list(enumerate(times))
    assert delta_times(df.select("time").limit(0)).count() == 0


def test_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(values.extend(F.lit("z1"), 4)) == "zzz1"
    for wrong in ("h1", "01010"):
        with pytest.raises(Exception, match="cannot extend"):
            one(values.extend(F.lit(wrong), 4))
    assert one(values.from_vcd(F.lit(""), 1)) == "0" and one(values.from_int(F.lit(5), 6)) == "000101"
    assert one(values.get_bit(F.lit("100"), 2)) == "1" and one(values.get_bit(F.lit("100"), 3)) is None and one(values.set_bit(F.lit("100"), 0, "x")) == "10x"
    assert int(one(values.to_long(F.lit("1" * 70)))) == 2**64 - 1 and one(values.to_long(F.lit("1x"))) is None
    assert one(values.to_real(F.lit("1" * 60))) is None and one(values.to_real(F.lit("0" * 80 + "11"))) == 3.0
    assert bytes(one(values.be_bytes(F.lit("1" * 70)))) == (2**70 - 1).to_bytes(9, "big") and one(values.be_bytes(F.lit("1x"))) is None
    assert [int(one(values.id_number(F.lit(c)))) for c in ("!", "#", "*", "c", "#%")] == [0, 2, 9, 66, 472]
    for text, want in ((r"foo\040bar", "foo bar"), (r"hex\x20space", "hex space"), (r"\12not", r"\12not"), (r"\\n\n", "\\n\n"), (r"\351\xE9", "éé"), (r"end\\", "end\\"), ("plain", "plain"), (r"\q\"", '\\q"')):
        assert one(values.unescape(F.lit(text))) == want, text
    with pytest.raises(Exception, match="does not fit"):
        one(values.from_int(F.lit(9), 3))


def test_builder_and_snapshot(spark):
    b = HierarchyBuilder(spark)
    b.push_scope("top")
    a, e = b.new_signal("bits", 4), b.new_signal("event")
    b.add_var("a", a, msb=3, lsb=0)
    b.add_var("e", e)
    with pytest.raises(ValueError):
        b.add_var("bad", a, msb=1, lsb=0)
    tables = b.finish()
    assert [r.full_name for r in tables["vars"].orderBy("var_id").collect()] == ["top.a", "top.e"]
    enc = Encoder(spark, b.signals)
    for t, v in ((0, "1"), (2, "x"), (1, "0"), (2, "z"), (3, "101")):
        enc.time_change(t)
        enc.change(a, v)
    assert [(r.time, r.bits) for r in enc.snapshot().orderBy("seq").collect()] == [(0, "0001"), (2, "xxxx"), (3, "0101")]


def test_stream_equals_batch(spark, tmp_path):
    rows, log = log_of(spark)
    for i in range(4):  # four micro-batches
        part = [r for r in rows if r[2] * 4 // len(rows) == i]
        spark.createDataFrame(part, "signal long, time long, seq long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("signal long, time long, seq long, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = steps.run_available(steps.real_changes(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute_dedup(rows), key=str)
    assert steps.select_changes(log.df, 10, 20, [1]).filter("signal <> 1 or time < 10 or time > 20").count() == 0 and steps.select_changes(log.df, signals=[]).count() == 0


def test_slices_change_nothing(spark):
    _, log = log_of(spark, 9)
    probes = spark.createDataFrame([(s, t) for s in range(7) for t in range(-2, 140, 5)], "signal long, time long")
    rows = lambda df: sorted(map(str, df.collect()))
    bits = log.df.select("signal", "time", "seq", (F.col("seq") % 3).alias("bit"), F.coalesce("value", F.lit("z")).alias("value"))
    other = ChangeLog(log.df.withColumn("time", F.col("time") * 2))
    found = []
    for log.slices in (1, 2, 7):
        found.append([rows(log.positions()), rows(log.slice(1, -2, 3)), rows(log.at(-1)), rows(log.offsets(probes)), rows(derived.merge_keyed(log, other, 1, 1).df), rows(derived.assemble_bits(bits, 3, log.slices))])
    assert found[0] == found[1] == found[2] and all(found[0])


@pytest.mark.parametrize("seed", range(3))
def test_accepted_steps_over_ranges(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), q, r.randint(0, 3) + q // 20) for q in range(300)]
    want, latest, kept = [], {}, {}
    for f, q, t in rows:
        if f not in latest or t > latest[f]:
            latest[f], kept[f] = t, True
        elif t < latest[f]:
            kept[f] = False
        if kept[f]:
            want.append((f, q, t))
    df = spark.createDataFrame(rows, "file string, seq long, time long")
    assert sorted(map(str, map(tuple, accepted_steps(df, within=["file"]).collect()))) == sorted(map(str, want))


def test_numbers_of_any_width(spark):
    rng = random.Random(8)
    texts = ["", "0", "000", "1", "x1", "1" * 53, "1" * 54, "1" * 64, "1" + "0" * 80, "1" + "0" * 64 + "1", "1" + "0" * 1023, "1" * 1024, "1" + "0" * 1024, "0" * 300 + "101", "1" * 53 + "01", "1" + "0" * 52 + "1", "1" + "0" * 51 + "11"]
    texts += ["".join(rng.choice("01") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in rows.select("t", values.decimal_text(t).alias("d"), values.number_text(t).alias("n"), values.to_real(t).alias("r"), values.to_nearest(t).alias("f")).collect():
        if not r.t or set(r.t) - set("01"):
            assert r.d is None and r.n == r.t and r.r is None and r.f is None
            continue
        whole = int(r.t, 2)
        assert r.d == r.n == str(whole)
        try:
            near = float(whole)
        except OverflowError:
            near = float("inf")
        assert r.f == near, r.t
        assert r.r == (near if near != float("inf") and int(near) == whole else None), r.t


def test_ordered_difference(spark):
    schema = "signal int, time long, seq int, value string"
    rows = [(1, 5, 0, "a"), (1, 5, 1, "b"), (1, 9, 2, "a"), (2, 1, 0, "x"), (None, 1, 0, "n"), (None, 2, 0, None)]
    log = ChangeLog(spark.createDataFrame(rows, schema))
    recounted = ChangeLog(spark.createDataFrame([(s, t, 10 * q + 3, v) for s, t, q, v in rows], schema))
    assert log.equals(recounted) and recounted.equals(log)
    swapped = ChangeLog(spark.createDataFrame([(s, t, {0: 1, 1: 0}.get(q, q) if s == 1 else q, v) for s, t, q, v in rows if (s, t) != (2, 1)] + [(3, 1, 0, None)], schema))
    assert log.difference(swapped).count() == 2
    got = {tuple(r) for r in log.ordered_difference(swapped).collect()}
    assert got == {(1, 0, 5, "a", 5, "b"), (1, 1, 5, "b", 5, "a"), (2, 0, 1, "x", None, None), (3, 0, None, None, 1, None)}
    assert not log.equals(ChangeLog(log.df.limit(0))) and log.equals(log)


def test_resolve_equals_one_name_at_a_time(spark):
    items = [(0, None, 0, "top", "scope"), (1, None, 1, "top.sub", "scope"), (2, 0, 0, "out", "var"), (3, 0, 1, "out[1]", "var"), (4, 0, 2, "sub", "scope"), (5, 4, 0, "o", "var"), (6, 1, 0, "o", "var"), (7, 0, 3, "sub", "var"), (8, None, 2, "clk", "var"), (9, 4, 1, "very", "scope"), (10, 9, 0, "deep.name", "var")]

    def one(name, parent=None):
        level = [x for x in items if x[1] == parent]
        best = None
        for x in level:
            after = name[len(x[3]) :]
            fits = name.startswith(x[3]) and (after == "" or after[0] == "." if x[4] == "scope" else "." not in after)
            if fits and (best is None or len(x[3]) > len(best[3])):
                best = x
        if best is None:
            return None, None, [x[3] for x in level][:5]
        after = name[len(best[3]) :]
        return one(after[1:], best[0]) if best[4] == "scope" and after else (best[0], best[4], None)

    names = ["top", "top.out", "top.out[1:0]", "top.out[1]x", "top.outXYZ", "top.sub", "top.sub.o", "top.sub.very.deep.name", "top.sub.very", "top.", "", "clk", "clk[3]", "clk.x", "nowhere", "topx.out", "top.out.x", "top.sub.o.p", "top.subX"]
    got = hierarchy.resolve(spark.createDataFrame([(n,) for n in [*names, "top"]], "name string"), spark.createDataFrame(items, "id long, parent_id long, ord int, name string, kind string"))
    assert {r["name"]: (r["id"], r["kind"], r["hints"]) for r in got.collect()} == {n: one(n) for n in names}
    assert got.count() == len(names)


@pytest.mark.parametrize("bytes_", [0, 1 << 70])
def test_hot_signals_are_cut_by_themselves(spark, monkeypatch, bytes_):
    from tracetide.operators import changelog

    rng = random.Random(6)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.randint(0, 80), i, rng.choice("ab")) for i in range(600)]
    df = spark.createDataFrame(rows, "signal int, time long, seq int, value string")
    probes = spark.createDataFrame([(s, t) for s in (0, 1, 2, 9) for t in range(-1, 85, 7)], "signal int, time long")
    fixed, auto = ChangeLog(df, slices=1), ChangeLog(df)
    monkeypatch.setattr(changelog, "HOT_ROWS", 40)
    monkeypatch.setattr(changelog, "COUNTED_BYTES", bytes_)
    assert auto.cut() == (bytes_ == 0)
    if bytes_ == 0:
        cuts = {r.hot_signal: len(r.bounds) for r in auto.hot().collect()}
        assert set(cuts) == {0, 1, 2, None} and cuts[0] > 3
        assert auto.slotted(df).groupBy("signal", "slot").count().agg({"count": "max"}).first()[0] < 120
    same = lambda f: sorted(map(str, f(auto).collect())) == sorted(map(str, f(fixed).collect()))
    assert same(lambda x: x.dedup().df) and same(lambda x: x.positions().select("signal", "time", "seq", "value", "idx", "from_end"))
    assert same(lambda x: x.value_at(probes)) and same(lambda x: x.offsets(probes)) and same(lambda x: x.time_steps())
    bits = ChangeLog(df.withColumn("value", F.when(F.col("value") == "a", "10").otherwise("01")))
    plain = ChangeLog(bits.df, slices=1)
    parts = Derived([Extract(0, 1, 0), Extract(1, 0, 0)])
    assert sorted(map(str, parts.evaluate(bits).collect())) == sorted(map(str, parts.evaluate(plain).collect()))
    assert "SinglePartition" not in parts.evaluate(bits)._jdf.queryExecution().executedPlan().toString()


def test_encoded_tables_equal_the_encoder(spark):
    """Late steps, widths and kinds as in an Encoder; unknown signals and null values; values that do not fit are errors."""
    b = HierarchyBuilder(spark)
    for encoding, width in (("bits", 4), ("string", 0), ("real", 0), ("event", 0)):
        b.new_signal(encoding, width)
    changes = [(3, 0, "X"), (3, 1, "a b"), (5, 2, "1.5"), (4, 0, "1"), (5, 0, "101"), (5, 3, ""), (6, 0, "z1")]
    enc = Encoder(spark, b.signals)
    for t, signal, value in changes:
        enc.time_change(t)
        enc.change(signal, value)
    schema = "file string, signal_id bigint, time bigint, seq bigint, value string"
    rows = [(f, s, t, k, v) for f in "ab" for k, (t, s, v) in enumerate(changes)]
    signals = b.finish()["signals"]
    columns = ["signal_id", "time", "kind", "bits", "str", "real"]
    want = [tuple(r) for r in enc.snapshot().orderBy("seq").select(columns).collect()]
    got = encoded(spark.createDataFrame([*rows, ("a", 9, 7, 99, "1"), ("b", 0, 8, 99, None)], schema), signals)
    assert [tuple(r) for r in got.filter("file = 'a'").orderBy("seq").select(columns).collect()] == want
    assert [tuple(r) for r in got.filter("file = 'b'").orderBy("seq").select(columns).collect()] == [*want, (0, 8, 1, None, None, None)]
    assert encoded(spark.createDataFrame([], schema), signals).collect() == []
    with pytest.raises(Exception, match="is no value of 4 bits"):
        encoded(spark.createDataFrame([("a", 0, 1, 0, "10101")], schema), signals).collect()
