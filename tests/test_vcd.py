import random
import time

import pytest

from tracetide.api import Waveform
from tracetide.sources.vcd import Header, Scanner, VcdError, VcdFiles, is_vcd, split_name

HEAD = "$timescale 1ns $end\n$scope module top $end\n{vars}$upscope $end\n$enddefinitions $end\n"


def write(tmp_path, body, vars="$var wire 1 ! a $end\n", name="x.vcd"):
    path = tmp_path / name
    path.write_bytes((HEAD.format(vars=vars) + body).encode())
    return str(path)


def read(spark, path, column="bits"):
    v = VcdFiles(spark, path)
    rows = sorted((tuple(r.seq), r.time, r[column]) for r in v.changes().collect())
    return [(t, x) for _, t, x in rows], sorted(r.time for r in v.steps().collect())


def lines(text):
    return text.replace(" ", "\n") + "\n"


@pytest.mark.parametrize(
    "body, changes, times",
    [
        (lines("#0 0! #10 1! #20 0!"), [(0, "0"), (10, "1"), (20, "0")], [0, 10, 20]),
        ("#0 0! #10 1! #20 0!", [(0, "0"), (10, "1"), (20, "0")], [0, 10, 20]),
        (lines("#4 0! #1 0! #5 1! #2"), [(4, "0"), (5, "1")], [4, 5]),
        (lines("#4 0! #1 1! #4 1! #5 1!"), [(4, "0"), (5, "1")], [4, 5]),
        (lines("#0 0! 1!"), [(0, "0"), (0, "1")], [0]),
        (lines("0! #5 1!"), [(0, "0"), (5, "1")], [0, 5]),
        ("#3.0\n1!\n", [(3, "1")], [3]),
        ("#0\r\n1!\r\n#5\r\n0!\r\n", [(0, "1"), (5, "0")], [0, 5]),
        ("$dumpvars 0! $end\n#1\n1!\n", [(0, "0"), (1, "1")], [0, 1]),
        ("#1\n$comment skip 1! $end\n0!\n", [(1, "0")], [1]),
        ("#1\n$comment\n# notes\n#7 1!\n$end 0!\n#2\n1!\n", [(1, "0"), (2, "1")], [1, 2]),
    ],
)
def test_bodies(spark, tmp_path, body, changes, times):
    assert read(spark, write(tmp_path, body)) == (changes, times)


def test_vectors_reals_strings(spark, tmp_path):
    decl = "$var wire 8 ! v $end\n$var real 64 \" r $end\n$var string 1 $ s $end\n"
    path = write(tmp_path, "#0\nb1 !\n#1\nbx !\n#2\nbz1 !\n#3\nb0b101 !\nr1.5 \"\nsfoo\\040bar $\n", decl)
    rows = sorted((tuple(r.seq), r.bits, r.str, r.real) for r in VcdFiles(spark, path).changes().collect())
    assert [r[1:] for r in rows] == [("00000001", None, None), ("xxxxxxxx", None, None), ("zzzzzzz1", None, None), ("00000101", None, None), (None, None, 1.5), (None, "foo bar", None)]


@pytest.mark.parametrize("body, message", [("#3.2\n1!\n", "integer time"), ("#0\n1 \n", "expected an id"), ("#0\nq!\n", "unknown or invalid command")])
def test_errors(spark, tmp_path, body, message):
    with pytest.raises(Exception, match=message):
        read(spark, write(tmp_path, body))


def test_headers():
    with pytest.raises(VcdError, match="enddefinitions"):
        Header("$date x $end\n")
    with pytest.raises(VcdError, match="unknown or invalid command"):
        Header("$crash x $end\n$enddefinitions $end\n")
    assert is_vcd("  $date\n now $end\n") and not is_vcd("GHDLwave") and not is_vcd("$other x $end")
    assert split_name("test[3][2][0]", 1) == ("[2]", 0, 0, ["test", "[3]"])
    assert split_name("test[0][3][2][0]", 32) == ("[0]", None, None, ["test", "[0]", "[3]", "[2]"])
    assert split_name("a [7:-8]", 16) == ("a", 7, -8, []) and split_name("plain", 1) == ("plain", None, None, [])
    h = Header(HEAD.format(vars="$var event 1 ! e [0] $end\n$var event 1 # e [1] $end\n$var wire 1 % q [1] $end\n$var wire 1 & q [0] $end\n"))
    assert [(v["name"], v["msb"], v["lsb"]) for v in h.vars][-1] == ("q", 1, 0) and len(h.vars) == 3 and len(h.derived) == 2
    inside = Header("$scope module v $end $var wire 1 ! v[2] $end $var wire 8 # v[3] $end $upscope $end $enddefinitions $end")
    assert [(v["name"], v["path"]) for v in inside.vars] == [("v", ["v", "v"]), ("[3]", ["v", "[3]"])]
    twice = Header("$scope module tb $end $upscope $end $scope module tb $end $scope module $end $upscope $end $upscope $end $enddefinitions $end", True)
    assert [s["name"] for s in twice.scopes] == ["tb"]
    enum = Header('$attrbegin misc 07 swap_t 2 a b 00 01 1 $end $attrbegin misc 07 "" 1 $end $var wire 2 ! x $end $enddefinitions $end')
    assert enum.vars[0]["enum_id"] == 0 and enum.enums[0]["mapping"][1] == {"value": "b", "label": "01"} or enum.enums[0]["mapping"][1] == {"value": "01", "label": "b"}


def test_small_splits_give_the_same(spark, tmp_path):
    body = "".join(f"#{i * 3 % 1000 if i % 50 else 5}\n{i % 2}!\n" for i in range(3000))
    path = write(tmp_path, body)
    want = read(spark, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert read(spark, path)[1] == want[1]
        assert sorted(read(spark, path)[0]) == sorted(want[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_objects(spark, tmp_path):
    decl = "$var wire 2 ! out [1:0] $end\n$scope module sub $end\n$var reg 1 # c $end\n$var wire 1 % q [1] $end\n$var wire 1 & q [0] $end\n$upscope $end\n"
    w = Waveform(spark, write(tmp_path, "#0\nbx !\n0#\n1%\n0&\n#2\nb0 !\n#6\nb1 !\n1&\n#8\nb1 !\n#9\n1#\n", decl))
    assert w.timescale == (1, "ns") and w.file_format == "vcd"
    out = w["top.out"]
    assert (out.full_name, out.index, out.bitwidth, w["top.out[1:0]"]) == ("top.out", (1, 0), 2, out)
    assert [v.full_name for v in w.all_vars()] == ["top.out", "top.sub.c", "top.sub.q"] and [s.name for s in w.all_scopes()] == ["sub", "top"]
    s = out.signal
    assert len(s) == 3 and list(s) == [(0, "xx"), (2, 0), (6, 1)] and s[-1] == (6, 1) and s[0:3:2] == [(0, "xx"), (6, 1)]
    assert s.value_at(1) == "xx" and s.value_at(7) == 1 and out[25] == 1
    assert list(w["top"]["sub.q"].signal) == [(0, 2), (6, 3)]
    with pytest.raises(KeyError):
        w["top.none.x"]
    with pytest.raises(IndexError):
        s[7]
    w.load_signals([out.signal_id])
    assert len(out.signal) == 3 and w[out.signal_id] == [out]
    assert len(w.get_signal(out.signal_id)) == 3 and w.get_signal(out.signal_id + 1) is None
    assert s.offset(1) == (0, 1, False, 2) and s.offset(6) == (6, 1, True, None) and s.offset(-1) is None
    assert s.values_at(6) == [1] and s.first_time() == 0 and s.max_states() == 1
    assert {r.signal: r.n_changes for r in w.statistics().collect()}[out.signal_id] == 4
    w.unload_signals([out.signal_id])
    assert sorted(r.time for r in w.source.changes(start=2, end=8).collect()) == [2, 6, 6, 8]
    assert not w["top"].is_array and w["top"].source is None
    seen = []
    w.stream_changes(lambda t, i, v: seen.append((t, v)), ["top.out", "missing"])
    assert seen == [(0, "xx"), (2, 0), (6, 1), (8, 1)]
    steps = []
    w.stream_time_steps(lambda t, values, changed: steps.append((t, len(changed))), ["top.out", w["top.sub.c"]])
    assert steps == [(0, 2), (2, 1), (6, 1), (9, 1)]


def test_comments_with_lines_that_begin_with_a_time(spark, tmp_path):
    path = tmp_path / "c.vcd"
    body = "".join(f"#{i}\n{i % 2}!\n" + ("$comment\n# a\n#3\n0! $end\n" if i % 5 == 0 else "") for i in range(2000))
    path.write_text("$comment\n# made by hand\n#1\n$end\n$scope module top $end\n$var wire 1 ! a $end\n$upscope $end\n$enddefinitions $end\n" + body)
    v = VcdFiles(spark, str(path))
    assert v.table("meta").first().comments == ["# made by hand\n#1"]
    want = [(i, str(i % 2)) for i in range(2000)]
    assert read(spark, str(path))[0] == want
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert read(spark, str(path))[0] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_a_header_of_many_variables_is_read_in_linear_time():
    took = []
    for n in (4_000, 40_000):
        began = time.process_time()
        Header("$scope module a $end\n" + "".join(f"$var wire 1 {i} v{i} $end\n" for i in range(n)) + "$upscope $end $enddefinitions $end")
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.05)


def test_many_records_at_once_are_scanned_as_one_by_one():
    chance = random.Random(5)
    usual = ["0!", "1#", "x$", "b101 !", "b1 b1", "bx #5", "r1.5 b", "sfoo $end", "$dumpvars", "$end", "#7", "bz b b1 0b"]
    other = ["$comment hi $end", "$dumpall", "b $comment", "1", "q", "b1", "$foo", "#", "#x", "#3.0", "sé !"]

    def one_by_one(scanner, texts, want):
        out = []
        for text in texts:
            scanner.record(text, True, out, 2, 7)
        return [r for r in out if (r[4] is not None) == (want == "changes")]

    at_once = 0
    for _ in range(1500):
        want, texts = chance.choice(["changes", "steps"]), []
        for _ in range(chance.randint(1, 6)):
            words = [str(chance.randint(0, 9))] + [chance.choice(usual if chance.random() < 0.97 else other) for _ in range(chance.randint(0, 5))]
            texts.append((chance.choice(" \n\t").join(words) + chance.choice(["", "\n", " "])).replace("\n#", " #"))
        found = []
        for quick in (False, True):
            scanner, rows = Scanner(False), []
            try:
                for _ in range(2):  # the state is carried
                    columns = scanner.many(b"#" + "\n#".join(texts).encode(), 2, 7, want) if quick else None
                    at_once += columns is not None
                    rows += one_by_one(scanner, texts, want) if columns is None else list(zip(*[c.to_pylist() for c in columns], strict=True))
                found.append((rows, vars(scanner)))
            except VcdError:
                found.append("error")
        assert found[0] == found[1], texts
    assert at_once > 1000
