"""Signal values as Column expressions.

A bit vector is a lower-case string, most significant bit first, of the nine
characters 0 1 x z h u w l -. All functions are built-in expressions, so that
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine states, and the order in which GHDL numbers them.
STATES = "01xzhuwl-"
STD_LOGIC = "ux01zwlh-"
#: Femtoseconds per unit; None: finer than that.
UNITS = {"zs": -21, "as": -18, "fs": -15, "ps": -12, "ns": -9, "us": -6, "ms": -3, "s": 0}
ID_FIRST, ID_COUNT = 33, 94


def canonical(bits: Column) -> Column:
    """Lower case, or null where a character is no state."""
    low = F.translate(bits, "XZHUWL", "xzhuwl")
    return F.when(low.rlike("^[01xzhuwl-]*$"), low)


def states(bits: Column) -> Column:
    """The smallest number system that holds the value: 0 two states, 1 four, 2 nine."""
    return F.when(bits.rlike("[huwl-]"), 2).when(bits.rlike("[xz]"), 1).otherwise(0)


def states_of_set(bits: Column) -> Column:
    """The number system that holds all values of a group (an aggregate); nine states for no values."""
    return F.coalesce(F.max(states(bits)), F.lit(2))


def from_int(value: Column, width: int) -> Column:
    """The lowest `width` bits of a non-negative long; an error if it does not fit."""
    digits = F.bin(value)
    fits = (value >= 0) & (F.length(digits) <= width)
    return F.when(fits, F.lpad(digits, width, "0")).when(value.isNotNull(), F.raise_error(F.concat(value.cast("string"), F.lit(f" does not fit into {width} bits"))))


def leading(value: Column, width: int) -> Column:
    """The digits of a non-negative long, filled with 0 up to `width`; of more digits the first `width`, as SQL's lpad has it."""
    return F.when(value >= 0, F.lpad(F.bin(value), width, "0")).when(value.isNotNull(), F.raise_error(F.concat(value.cast("string"), F.lit(" is negative"))))


def side_by_side(value: Column, width: int, times: int) -> Column:
    """The bits of value * (1 + 2**width + ...), of `times` terms: a number of up to `width` bits beside itself; what wider ones (up to 62 bits) have more is added to the next."""
    parts, rest = [], value
    for _ in range(times - 1):
        parts.append(F.lpad(F.bin(rest.bitwiseAND((1 << width) - 1)), width, "0"))
        rest = F.shiftright(rest, width) + value
    digits = F.bin(rest)
    whole = F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")), *reversed(parts))
    wrong = F.raise_error(F.concat(value.cast("string"), F.lit(" is negative or has over 62 bits")))
    return F.when(value.between(0, (1 << 62) - 1), whole).when(value.isNotNull(), wrong)


def repeat(state: str, width: int) -> Column:
    return F.lit(state * width)


def extend(bits: Column, width: Column | int) -> Column:
    """To `width` bits: x and z fill with themselves, 0 and 1 with 0; another first state, or too many bits, is an error."""
    width = F.lit(width) if isinstance(width, int) else width
    lead = F.lower(F.substring(bits, 1, 1))
    fill = F.when(lead.isin("x", "z"), lead).when(lead.isin("0", "1"), F.lit("0"))
    short = width - F.length(bits)
    wrong = F.raise_error(F.concat(F.lit("cannot extend "), bits, F.lit(" to "), width.cast("string"), F.lit(" bits")))
    return F.when(short == 0, canonical(bits)).when((short > 0) & fill.isNotNull(), canonical(F.concat(F.repeat(fill, short), bits))).when(bits.isNotNull(), wrong)


def from_vcd(token: Column, width: Column | int) -> Column:
    """A vector as it stands in a VCD body after its letter is gone: an extra 0b is dropped, one-bit signals keep the last character."""
    width = F.lit(width) if isinstance(width, int) else width
    body = F.when((F.length(token) > 2) & F.substring(token, 1, 2).isin("0b", "0B"), F.substring(token, 3, 1 << 30)).otherwise(token)
    last = F.when(F.length(body) == 0, F.lit("0")).otherwise(F.right(body, F.lit(1)))
    # most tokens are plain: one look at their characters is enough for these
    lead = F.substring(token, 1, 1)
    fill = F.when(lead.isin("x", "z"), lead).otherwise(F.lit("0"))
    plain = (F.length(token) <= width) & token.rlike("^[01xz]+$")
    return F.when(plain, F.lpad(token, width, fill)).when(width == 1, canonical(last)).otherwise(extend(body, width))


def slice_bits(bits: Column, msb: int, lsb: int) -> Column:
    """Bits msb..lsb, where 0 is the least significant."""
    return F.substring(bits, F.length(bits) - msb, F.lit(msb - lsb + 1))


def get_bit(bits: Column, index: Column | int) -> Column:
    """Bit `index`, where 0 is the least significant; null outside."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.when((index >= 0) & (index < F.length(bits)), F.substring(bits, F.length(bits) - index, F.lit(1)))


def set_bit(bits: Column, index: int, state: str) -> Column:
    return F.overlay(bits, F.lit(state), F.length(bits) - index, F.lit(1))


def concat_bits(*parts: Column) -> Column:
    """Parts side by side, the most significant first."""
    return F.concat(*parts)


def or_unknown(bits: Column, width: int) -> Column:
    """The value, or x in every bit before the first change."""
    return F.coalesce(bits, F.lit("x" * width))


def to_long(bits: Column) -> Column:
    """The lowest 64 bits as a decimal number; null with any state but 0 and 1."""
    return F.when(bits.rlike("^[01]+$"), F.conv(F.right(bits, F.lit(64)), 2, 10).cast("decimal(20,0)"))


def to_bool(bits: Column) -> Column:
    return F.when(bits.isin("1", "true"), True).when(bits.isin("0", "false"), False)


def to_real(bits: Column) -> Column:
    """As a double, if it holds the number without loss: at most 53 bits from the first 1 to the last, and none over 2**1024. Null otherwise."""
    short = F.ltrim(bits, F.lit("0"))
    core = F.rtrim(short, F.lit("0"))
    exact = F.conv(core, 2, 10).cast("double") * F.pow(F.lit(2.0), F.length(short) - F.length(core))
    fits = (F.length(core) <= 53) & (F.length(short) <= 1024)
    return F.when(bits.rlike("^0+$"), 0.0).when(bits.rlike("^[01]+$") & fits, exact)


def to_nearest(bits: Column) -> Column:
    """The double nearest to a two-state vector of any width, ties to even; infinity from 2**1024 on. Null with other states."""
    short = F.ltrim(bits, F.lit("0"))
    n = F.length(short)
    lead = F.conv(F.substring(short, 1, 53), 2, 10).cast("bigint")
    half, rest = F.substring(short, 54, 1) == "1", F.contains(F.substring(short, 55, 1 << 30), F.lit("1"))
    up = half & (rest | (lead % 2 == 1))
    scaled = (lead + F.when(up, 1).otherwise(0)).cast("double") * F.pow(F.lit(2.0), n - 53)
    large = F.when(n > 1024, F.lit(float("inf"))).otherwise(scaled)
    return F.when(bits.rlike("^0+$"), 0.0).when(bits.rlike("^[01]+$"), F.when(n <= 53, lead.cast("double")).otherwise(large))


#: Decimal digits of a limb and bits taken at a time: a limb times 2**LIMB_BITS and a carry fit a long.
LIMB, LIMB_BITS = 9, 30


def decimal_text(bits: Column) -> Column:
    """The decimal number of a two-state vector of any width, as text; null with other states.

    Bits are taken LIMB_BITS at a time from the most significant on; each time all limbs (of LIMB decimal digits, the
    least significant first) are multiplied, the bits are added, and the carry goes from limb to limb.
    """
    base = 10**LIMB
    short = F.ltrim(bits, F.lit("0"))
    n = F.length(short)
    none = F.array().cast("array<bigint>")
    first = F.pmod(n - 1, F.lit(LIMB_BITS)) + 1
    begins = F.when(n > first, F.sequence(first + 1, n, F.lit(LIMB_BITS))).otherwise(F.array().cast("array<int>"))
    groups = F.concat(F.array(F.substring(short, F.lit(1), first)), F.transform(begins, lambda i: F.substring(short, i, F.lit(LIMB_BITS))))

    def over(x: Column) -> Column:
        return F.call_function("div", x, F.lit(base).cast("bigint"))

    def multiplied(a: Column, limb: Column) -> Column:
        whole = limb * F.lit(1 << LIMB_BITS).cast("bigint") + a["carry"]
        return F.struct(F.concat(a["done"], F.array(whole % base)).alias("done"), over(whole).alias("carry"))

    def closed(a: Column) -> Column:
        carry = a["carry"]
        return F.concat(a["done"], F.when(carry == 0, none).when(carry < base, F.array(carry)).otherwise(F.array(carry % base, over(carry))))

    def step(limbs: Column, group: Column) -> Column:
        return F.aggregate(limbs, F.struct(none.alias("done"), F.conv(group, 2, 10).cast("bigint").alias("carry")), multiplied, closed)

    limbs = F.aggregate(groups, none, step)
    digits = F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), LIMB, "0"))
    text = F.ltrim(F.array_join(digits, ""), F.lit("0"))
    return F.when(bits.rlike("^0+$"), F.lit("0")).when(bits.rlike("^[01]+$"), text)


def number_text(bits: Column) -> Column:
    """What a Python caller sees: the decimal number of two-state vectors of any width, the bits of others."""
    return F.when(bits.rlike("^[01]{1,63}$"), F.conv(bits, 2, 10)).otherwise(F.coalesce(decimal_text(bits), bits))


def be_bytes(bits: Column) -> Column:
    """The bytes of a two-state vector of any width, the most significant first; null with other states."""
    whole = F.lpad(bits, (F.floor((F.length(bits) + 7) / 8) * 8).cast("int"), F.lit("0"))
    digits = F.transform(F.sequence(F.lit(1), F.length(whole), F.lit(4)), lambda i: F.conv(F.substring(whole, i, F.lit(4)), 2, 16))
    return F.when(bits.rlike("^[01]+$"), F.unhex(F.array_join(digits, "")))


def std_logic(index: Column) -> Column:
    """State of GHDL's code 0..8."""
    return F.translate(index.cast("string"), "012345678", STD_LOGIC)


def id_number(code: Column) -> Column:
    """The number of a VCD identifier code: bijective base 94, the first character least significant."""
    digits = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: (F.ascii(F.substring(code, i, F.lit(1))) - (ID_FIRST - 1)).cast("decimal(38,0)"))
    return F.when(F.length(code) > 0, (F.aggregate(F.reverse(digits), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a * ID_COUNT + d).cast("decimal(38,0)")) - 1).cast("decimal(38,0)"))


def timescale(exponent: Column) -> tuple[Column, Column]:
    """(factor, unit) of a power of ten of a second."""
    unit = F.floor(exponent / 3) * 3
    names = F.create_map(*[F.lit(x) for name, e in UNITS.items() for x in (e, name)])
    return F.pow(F.lit(10), exponent - unit).cast("int"), F.coalesce(F.element_at(names, unit.cast("int")), F.lit("unknown"))


# What stands after a backslash for one character.
ESCAPES = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b", '"': '"', "'": "'", "\\": "\\", "?": "?"}
PIECE = r"\\x[0-9A-Fa-f]{2}|\\[0-7]{3}|\\[abfnrtv\"'\\?]|[^\\]+|\\"


def unescape(text: Column) -> Column:
    """Backslash escapes of VCD strings: two hexadecimal or three octal digits, or a letter; others stay as they are. Bytes are Latin-1."""
    named = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def one(p: Column) -> Column:
        code = F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.conv(F.substring(p, 3, 2), 16, 10)).when(p.rlike(r"^\\[0-7]{3}$"), F.conv(F.substring(p, 2, 3), 8, 10))
        return F.coalesce(F.chr(code.cast("int")), F.when(F.length(p) == 2, F.when(F.substring(p, 1, 1) == "\\", F.element_at(named, F.substring(p, 2, 1)))), p)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)" + PIECE), F.lit(0)), one), "")).otherwise(text)


def scalar_name(name: Column) -> tuple[Column, Column, Column]:
    """(base, msb, lsb) of a name with a trailing [msb:lsb] or [index]; null indexes without one."""
    pattern = r"^(.*?)\s*\[\s*(-?\d+)\s*(?::\s*(-?\d+)\s*)?\]$"
    found = name.rlike(pattern)
    msb = F.when(found, F.regexp_extract(name, pattern, 2).cast("long"))
    lsb = F.when(found, F.regexp_extract(name, pattern, 3))
    return F.when(found, F.regexp_extract(name, pattern, 1)).otherwise(name), msb, F.when(found, F.when(lsb == "", msb).otherwise(lsb.try_cast("long")))
