import gzip
import struct
import zlib

import pyarrow as pa
import pytest

from tests.test_ghw import sleb, uleb
from tracetide.sources.detect import detect
from tracetide.sources.fst import FstError, FstFile, FstFiles, fastlz


def block(kind, body):
    return bytes([kind]) + struct.pack(">Q", len(body) + 8) + body


def packed(raw, pack):
    """A chain: its unpacked size (0: as it is) and its bytes."""
    if pack is None:
        return uleb(0) + raw
    return uleb(len(raw)) + (zlib.compress(raw) if pack == "Z" else pa.Codec("lz4_raw").compress(raw, asbytes=True))


LENGTHS = [1, 8, -1, 0, 1]


def changes(begin, end, frame, chains, times, pack="4", small=()):
    """chains: raw bytes by signal, None for no change, or an int for the signal whose chain it shares."""
    body = struct.pack(">QQQ", begin, end, 0) + uleb(len(frame)) + uleb(len(frame)) + uleb(len(LENGTHS)) + frame
    data, places, at = b"", b"", 0
    for i, ch in enumerate(chains):
        if ch is None:
            places += uleb(1 << 1)
        elif isinstance(ch, int):
            places += sleb(((-ch - 1) << 1) | 1)
        else:
            start = 1 + len(data)
            places += sleb(((start - at) << 1) | 1)
            at = start
            data += packed(ch, None if i in small else pack)
    body += uleb(len(chains)) + pack.encode() + data + places + struct.pack(">Q", len(places))
    deltas = b"".join(uleb(b - a) for a, b in zip([0, *times], times))
    return block(8, body + zlib.compress(deltas) + struct.pack(">QQQ", len(deltas), len(zlib.compress(deltas)), len(times)))


def fst(pack="4", with_hierarchy=True, order="<"):
    head = struct.pack(">QQ", 0, 30) + struct.pack(order + "d", 2.7182818284590452354) + struct.pack(">QQQQQ", 0, 2, 6, 5, 2) + struct.pack("b", -10)
    head += b"a tool".ljust(128, b"\0") + b"a day".ljust(26, b"\0") + bytes(93) + b"\0" + struct.pack(">q", 0)
    geometry = b"".join(uleb(n) for n in (1, 8, 0, 0xFFFFFFFF, 1))
    var = lambda kind, direction, name, length, alias=0: bytes([kind, direction]) + name.encode() + b"\0" + uleb(length) + uleb(alias)
    hier = b"\xfc\x00\x03/src/x.v\0" + uleb(1) + b"\xfc\x00\x041\0" + uleb(12)
    hier += b"\xfe\x00top\0tb\0" + var(16, 1, "clk", 1) + var(5, 0, "q [7:0]", 8) + var(3, 0, "r", 8) + var(21, 0, "s", 0) + var(16, 0, "copy", 1)
    hier += b"\xfe\x00sub\0\0" + var(16, 2, "clk", 1, 1) + b"\xff\xff"
    frame = b"x" + b"0000000z" + struct.pack(order + "d", 0.5) + b"x"
    bit = b"".join(uleb(x) for x in ((0 << 2) | (1 << 1), (1 << 2) | 0, (1 << 4) | (1 << 1) | 1))  # 1 at 0, 0 at 10, z at 20
    vector = uleb(1 << 1) + bytes([5]) + uleb((1 << 1) | 1) + b"0000000x"
    real = uleb((2 << 1) | 1) + struct.pack(order + "d", 2.5)
    text = uleb(1 << 1) + uleb(3) + b"ab\xe9"
    first = changes(0, 20, frame, [bit, vector, real, text, 0], [0, 10, 20], pack, small={3})
    second = changes(20, 30, frame, [uleb((0 << 2) | 0), None, None, None, None], [30], pack)
    out = block(0, head) + first + second + block(3, struct.pack(">QQ", len(geometry), 5) + geometry)
    return out + (block(4, struct.pack(">Q", len(hier)) + gzip.compress(hier)) if with_hierarchy else b""), hier


@pytest.mark.parametrize("pack, order, hier", [("4", "<", True), ("Z", ">", True), ("4", "<", False)])
def test_catalog_and_changes(spark, tmp_path, pack, order, hier):
    data, hierarchy = fst(pack, hier, order)
    (tmp_path / "x.fst").write_bytes(data)
    if not hier:
        (tmp_path / "x.fst.hier").write_bytes(hierarchy)
    f = FstFiles(spark, str(tmp_path / "x.fst"))
    assert sorted(map(str, FstFiles(spark, str(tmp_path)).table("vars").collect())) == sorted(map(str, f.table("vars").collect()))
    meta = f.table("meta").first()
    assert (meta.version, meta.date, meta.timescale_factor, meta.timescale_unit) == ("a tool", "a day", 100, "ps")
    assert [(v.full_name, v.var_type, v.direction, v.msb, v.lsb, v.signal_id) for v in f.table("vars").orderBy("var_id").collect()] == [
        ("top.clk", "wire", "input", None, None, 0), ("top.q", "reg", "implicit", 7, 0, 1), ("top.r", "real", "implicit", None, None, 2), ("top.s", "string", "implicit", None, None, 3),
        ("top.copy", "wire", "implicit", None, None, 4), ("top.sub.clk", "wire", "output", None, None, 0),
    ]
    top = f.table("scopes").orderBy("scope_id").first()
    assert (top.component, top.decl_path, top.decl_line) == ("tb", "/src/x.v", 12)
    got = {}
    for r in f.changes().orderBy("signal_id", "seq").collect():
        got.setdefault(r.signal_id, []).append((r.time, r.bits if r.kind == 1 else r.real if r.kind == 3 else r.str))
    clk = [(0, "x"), (0, "1"), (10, "0"), (20, "z"), (30, "0")]
    assert got == {0: clk, 1: [(0, "0000000z"), (10, "00000101"), (20, "0000000x")], 2: [(0, 0.5), (20, 2.5)], 3: [(10, "abé")], 4: clk[:-1]}
    assert sorted(r.time for r in f.steps().collect()) == [0, 10, 20, 30]
    assert {r.time for r in f.changes(start=10, end=20).collect()} == {10, 20}
    some = f.table("signals").filter("signal_id in (1, 4)")
    assert sorted((r.signal_id, r.time) for r in f.changes(some, start=5).collect()) == [(1, 10), (1, 20), (4, 10), (4, 20)]
    assert f.changes(start=25)._jdf.queryExecution().executedPlan().toString().count("GreaterThanOrEqual(last,25)") == 1


def test_detection_and_errors():
    data, _ = fst()
    assert detect(data[:64]) == "fst" and detect(b"PAR1") == "unknown" and detect(b"$date\n x $end") == "vcd"
    with pytest.raises(FstError):
        FstFile(fst(with_hierarchy=False)[0])
    with pytest.raises(FstError):
        FstFile(b"nothing of the kind")
    wrapped = b"\xfe" + struct.pack(">QQ", 0, len(data)) + gzip.compress(data)
    assert len(FstFile(wrapped).vars) == 6
    assert fastlz(b"\x02abc\x60\x02", 8) == b"abcabcab"  # three literals, then five from three back
