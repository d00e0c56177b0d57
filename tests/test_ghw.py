import struct

import pytest

from tracetide.sources.ghw import GhwError, GhwFile, GhwFiles, is_ghw

STRINGS = ["std_ulogic", "'U'", "'X'", "'0'", "'1'", "'Z'", "'W'", "'L'", "'H'", "'-'", "integer", "real", "state", "idle", "run", "stop", "vec", "vec4", "rec", "a", "b", "top", "clk", "q", "n", "r", "s", "p", "gen"]


def uleb(n):
    out = b""
    while True:
        n, b = n >> 7, n & 127
        out += bytes([b | (128 if n else 0)])
        if not n:
            return out


def sleb(n):
    out = b""
    while True:
        b, n = n & 127, n >> 7
        done = (n == 0 and not b & 64) or (n == -1 and b & 64)
        out += bytes([b | (0 if done else 128)])
        if done:
            return out


def name(s):
    return uleb(STRINGS.index(s) + 1) if s else uleb(0)


def ghw(order="<"):
    i32, i64 = (lambda n: struct.pack(order + "i", n)), (lambda n: struct.pack(order + "q", n))
    strings = b"".join(s.encode() + b"\0" for s in STRINGS)
    out = b"GHDLwave\n\x10\0\x01" + bytes([1 if order == "<" else 2, 4, 1, 0])
    out += b"STR\0" + bytes(4) + i32(len(STRINGS)) + i32(0) + strings + b"EOS\0"
    nine = bytes([23]) + name("std_ulogic") + uleb(9) + b"".join(map(name, STRINGS[1:10]))  # 1
    types = [nine, bytes([25]) + name("integer"), bytes([27]) + name("real"), bytes([23]) + name("state") + uleb(3) + name("idle") + name("run") + name("stop")]  # 1-4
    types += [bytes([31]) + name("vec") + uleb(1) + uleb(1) + uleb(2), bytes([35]) + name("vec4") + uleb(5) + bytes([25 | 128]) + sleb(3) + sleb(0)]  # 5, 6
    types += [bytes([32]) + name("rec") + uleb(2) + name("a") + uleb(1) + name("b") + uleb(6)]  # 7
    out += b"TYP\0" + bytes(4) + i32(len(types)) + b"".join(types) + b"\0" + b"WKT\0" + bytes(4) + b"\x03" + uleb(1) + b"\0"
    hie = bytes([6]) + name("top") + bytes([17]) + name("clk") + uleb(1) + uleb(1) + bytes([16]) + name("q") + uleb(6) + b"".join(map(uleb, (2, 3, 4, 5)))
    hie += bytes([16]) + name("n") + uleb(2) + uleb(6) + bytes([16]) + name("r") + uleb(3) + uleb(7) + bytes([16]) + name("s") + uleb(4) + uleb(8)
    hie += bytes([5]) + name("gen") + uleb(2) + sleb(-2) + bytes([16]) + name("p") + uleb(7) + b"".join(map(uleb, (1, 2, 3, 4, 5))) + bytes([15, 15, 0])
    out += b"HIE\0" + bytes(4) + i32(2) + i32(6) + i32(8) + hie + b"EOH\0"
    out += b"SNP\0" + bytes(4) + i64(0) + bytes([0, 2, 2, 2, 0]) + sleb(-1) + struct.pack("<d", 1.5) + bytes([0]) + b"ESN\0"
    cycle = uleb(1) + bytes([3]) + uleb(1) + bytes([3]) + uleb(0) + sleb(10)  # at 5: clk 1, q(3) 1
    cycle += uleb(5) + bytes([4]) + uleb(1) + sleb(7) + uleb(2) + bytes([2]) + uleb(0) + sleb(0)  # at 15: q(0) Z, n 7, s stop
    cycle += uleb(5) + bytes([2]) + uleb(0) + sleb(-1)  # a delta cycle: q(0) 0
    return out + b"CYC\0" + i64(5) + cycle + b"ECY\0" + b"TAI\0" + bytes(8)


@pytest.mark.parametrize("order", ["<", ">"])
def test_catalog_and_changes(spark, tmp_path, order):
    path = tmp_path / "x.ghw"
    path.write_bytes(ghw(order))
    f = GhwFiles(spark, str(path))
    assert [(r.full_name, r.var_type, r.direction, r.msb, r.lsb) for r in f.table("vars").orderBy("var_id").collect()] == [
        ("top.clk", "std_logic", "input", None, None), ("top.q", "std_logic_vector", "implicit", 3, 0), ("top.n", "integer", "implicit", None, None), ("top.r", "real", "implicit", None, None),
        ("top.s", "enum", "implicit", None, None), ("top.gen(-2).p.a", "std_logic", "implicit", None, None), ("top.gen(-2).p.b", "std_logic_vector", "implicit", 3, 0),
    ]
    assert [(s.name, s.scope_type) for s in f.table("scopes").orderBy("scope_id").collect()] == [("top", "vhdl_architecture"), ("gen(-2)", "vhdl_for_generate"), ("p", "vhdl_record")]
    assert [(m.value, m.label) for m in f.table("enums").first().mapping] == [("00", "idle"), ("01", "run"), ("10", "stop")]
    ids = {r.full_name: r.signal_id for r in f.table("vars").collect()}
    assert ids["top.clk"] == ids["top.gen(-2).p.a"] and ids["top.q"] == ids["top.gen(-2).p.b"]
    got = {}
    for r in f.changes().orderBy("time", "seq").collect():
        got.setdefault(r.signal_id, []).append((r.time, r.bits if r.real is None else r.real))
    assert got[ids["top.clk"]] == [(0, "u"), (5, "1")]
    assert got[ids["top.q"]] == [(0, "000u"), (5, "100u"), (15, "100z"), (15, "1000")]
    assert got[ids["top.n"]] == [(0, "1" * 32), (15, f"{7:032b}")] and got[ids["top.r"]] == [(0, 1.5)] and got[ids["top.s"]] == [(0, "00"), (15, "10")]
    assert sorted(r.time for r in f.steps().collect()) == [0, 5, 15]


def test_detection():
    assert is_ghw(ghw()) and not is_ghw(b"$date")
    with pytest.raises(GhwError, match="compressed"):
        GhwFile(b"\x1f\x8b rest of a zip")
    with pytest.raises(GhwError):
        list(GhwFile(ghw()[:-40]).changes())
