"""Integer and bit helpers, lane masks, and numeric limits as Column expressions on BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 32
# Identities and limits of 32-bit types.
FLT_MAX = 3.4028234663852886e38
LIMITS = {"float": (0.0, 1.0, -FLT_MAX, FLT_MAX), "int": (0, 1, -2147483648, 2147483647), "uint": (0, 1, 0, 4294967295)}


def _long(x: Column | str | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("bigint")


def _shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n) if isinstance(n, int) else n.cast("int"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def div_up(a, b) -> Column:
    """a / b, rounded up, for non-negative a and positive b."""
    return _div(_long(a) + _long(b) - 1, _long(b))


def round_up(a, b) -> Column:
    return div_up(a, b) * _long(b)


def round_down(a, b) -> Column:
    return _div(_long(a), _long(b)) * _long(b)


def log2_floor(v) -> Column:
    """Floor of log2; 0 for 1 and below."""
    return F.when(_long(v) <= 1, F.lit(0)).otherwise(F.length(F.bin(_long(v))) - 1).cast("bigint")


def is_power_of_2(v) -> Column:
    return (_long(v) > 0) & (F.bit_count(_long(v)) == 1)


def next_power_of_2(v) -> Column:
    """The smallest power of two above v, never v itself."""
    return _shl(F.lit(1).cast("bigint"), log2_floor(v) + 1)


def get_bits(v, pos: int, length: int) -> Column:
    """``length`` bits of v from bit ``pos``, length below 64."""
    return F.shiftrightunsigned(_long(v), pos).bitwiseAND(F.lit((1 << length) - 1))


def set_bits(v, bits, pos: int, length: int) -> Column:
    """v with ``length`` bits from bit ``pos`` replaced."""
    mask = (1 << length) - 1
    clear = ~(mask << pos) & 0xFFFFFFFFFFFFFFFF
    clear -= (clear >> 63) << 64
    return _long(v).bitwiseAND(F.lit(clear)).bitwiseOR(_shl(_long(bits).bitwiseAND(F.lit(mask)), pos))


def popcount(v) -> Column:
    return F.bit_count(_long(v))


def lane(v) -> Column:
    """The lane, 0 to 31, of a row number."""
    return F.pmod(_long(v), F.lit(LANES))


def lane_masks(v) -> dict[str, Column]:
    """For a lane the 32-bit masks of the lanes below, up to, above and from it."""
    one, full, n = F.lit(1).cast("bigint"), F.lit((1 << LANES) - 1), lane(v)
    lt, le = _shl(one, n) - 1, _shl(one, n + 1) - 1
    return {"lt": lt, "le": le, "gt": full.bitwiseXOR(le), "ge": full.bitwiseXOR(lt)}


def round_half_away(x: Column | str) -> Column:
    """The nearest integer, halves away from zero."""
    return F.round(F.col(x) if isinstance(x, str) else x).cast("int")


def choose(test: Column, x: Column, y: Column) -> Column:
    """x where the test holds, else y (predicated move; exchanging needs both orders)."""
    return F.when(test, x).otherwise(y)


def pair(key: Column, value: Column) -> Column:
    """A (key, value) pair; structs compare by key, then by value."""
    return F.struct(key.alias("k"), value.alias("v"))
