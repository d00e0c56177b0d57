"""Small writers of GHW and FST files, for round trips of tables through the formats."""

from __future__ import annotations

import struct
import zlib

# The nine states as GHW numbers them.
STATES = "ux01zwlh-"


def unsigned(n: int) -> bytes:
    """A number in groups of seven bits, the lowest first."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def signed(n: int) -> bytes:
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n & 127])


def ghw(scope: str, bit: str, vector: str, width: int, steps: list[tuple[int, list[tuple[int, str]]]]) -> bytes:
    """A file with one std_ulogic and one vector of them; element 0 is the bit, 1 the vector's most significant.

    steps: (time, changes) in order, changes as (element, state); a time may come again.
    """
    strings = ["std_ulogic", *(f"'{c.upper()}'" for c in STATES), "integer", "vec", scope, bit, vector]
    name = lambda s: unsigned(strings.index(s) + 1)
    i32 = lambda n: struct.pack("<i", n)
    out = b"GHDLwave\n\x10\0\x01\x01\x04\x01\0STR\0" + bytes(4) + i32(len(strings)) + i32(0) + b"".join(s.encode() + b"\0" for s in strings) + b"EOS\0"
    types = [bytes([23]) + name("std_ulogic") + unsigned(9) + b"".join(name(s) for s in strings[1:10]), bytes([25]) + name("integer")]
    types += [bytes([31]) + name("vec") + unsigned(1) + unsigned(1) + unsigned(2), bytes([35]) + name("vec") + unsigned(3) + bytes([25 | 128]) + signed(width - 1) + signed(0)]
    out += b"TYP\0" + bytes(4) + i32(len(types)) + b"".join(types) + b"\0WKT\0" + bytes(4) + b"\0"
    hierarchy = bytes([6]) + name(scope) + bytes([16]) + name(bit) + unsigned(1) + unsigned(1) + bytes([16]) + name(vector) + unsigned(4) + b"".join(unsigned(i + 2) for i in range(width))
    out += b"HIE\0" + bytes(4) + i32(1) + i32(2) + i32(width + 1) + hierarchy + bytes([15, 0]) + b"EOH\0"
    begin = steps[0][0]
    out += b"SNP\0" + bytes(4) + struct.pack("<q", begin) + bytes(width + 1) + b"ESN\0CYC\0" + struct.pack("<q", begin)
    for k, (time, changes) in enumerate(steps):
        at = -1
        for element, value in sorted(changes):
            out += unsigned(element - at) + bytes([STATES.index(value)])
            at = element
        out += unsigned(0) + signed(steps[k + 1][0] - time if k + 1 < len(steps) else -1)
    return out + b"ECY\0TAI\0" + bytes(8)


def fst(scope: str, variables: list[str], times: list[int], changes: list[list[tuple[int, int]]]) -> bytes:
    """A file of one-bit signals in one block; changes: for each variable (index of the time, 0 or 1) in order."""
    block = lambda kind, body: bytes([kind]) + struct.pack(">Q", len(body) + 8) + body
    head = struct.pack(">QQ", times[0], times[-1]) + struct.pack("<d", 2.7182818284590452354) + struct.pack(">QQQQQ", 0, 1, len(variables), len(variables), 1)
    head += struct.pack("b", -6) + bytes(128 + 26 + 93) + b"\0" + struct.pack(">q", 0)
    n = len(variables)
    body = struct.pack(">QQQ", times[0], times[-1], 0) + unsigned(n) + unsigned(n) + unsigned(n) + b"x" * n
    data = places = b""
    at = 0
    for own in changes:
        start, before = 1 + len(data), 0
        chain = b""
        for k, value in own:
            chain += unsigned((k - before) << 2 | value << 1)
            before = k
        data += unsigned(0) + chain
        places += signed((start - at) << 1 | 1)
        at = start
    deltas = b"".join(unsigned(b - a) for a, b in zip([0, *times[:-1]], times, strict=True))
    body += unsigned(n) + b"4" + data + places + struct.pack(">Q", len(places)) + zlib.compress(deltas) + struct.pack(">QQQ", len(deltas), len(zlib.compress(deltas)), len(times))
    geometry = b"".join(unsigned(1) for _ in range(n))
    tree = b"\xfe\x00" + scope.encode() + b"\0\0" + b"".join(bytes([16, 0]) + v.encode() + b"\0" + unsigned(1) + unsigned(0) for v in variables) + b"\xff"
    packed = zlib.compressobj(wbits=31)
    return block(0, head) + block(8, body) + block(3, struct.pack(">QQ", len(geometry), n) + geometry) + block(4, struct.pack(">Q", len(tree)) + packed.compress(tree) + packed.flush())
