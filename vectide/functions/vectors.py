"""Element-wise arithmetic and reductions on vector columns (arrays of equal length).

Every function takes column names or Columns and returns a Column. Operands that
are Python numbers, or Columns wrapped in :func:`scalar`, apply to every element.
Arithmetic is done in double; null operands give null, null elements null elements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str
UINT = 4294967296


@dataclass(frozen=True)
class Scalar:
    column: Column


def scalar(x: Column | str | float) -> Scalar:
    """Marks a number as an operand for every element."""
    return Scalar(F.lit(x) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x)


def _of(x: Vector) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x: Column) -> Column:
    return x.cast("double")


def _apply(a: Vector | Scalar | float, b: Vector | Scalar | float, f: Callable[[Column, Column], Column]) -> Column:
    a, b = (scalar(x) if isinstance(x, (int, float)) else x for x in (a, b))
    if isinstance(a, Scalar) and isinstance(b, Scalar):
        return f(_d(a.column), _d(b.column))
    if isinstance(b, Scalar):
        return F.transform(_of(a), lambda x: f(_d(x), _d(b.column)))
    if isinstance(a, Scalar):
        return F.transform(_of(b), lambda y: f(_d(a.column), _d(y)))
    return F.zip_with(_of(a), _of(b), lambda x, y: f(_d(x), _d(y)))


def _each(a: Vector, f: Callable[[Column], Column]) -> Column:
    return F.transform(_of(a), lambda x: f(_d(x)))


# --- construction ---------------------------------------------------------


def splat(x: Column | str | float, n: int) -> Column:
    """n copies of a number."""
    return F.array_repeat(scalar(x).column, n)


def truncated(a: Vector, n: int) -> Column:
    """The first n elements."""
    return F.slice(_of(a), 1, n)


def widened(a: Vector, last: float | Column = 0.0) -> Column:
    """The vector with one more element, 0 or the one given."""
    return F.concat(_of(a), F.array(F.lit(last)))


def to_int(a: Vector) -> Column:
    """Elements without their fraction (rounded to zero) as integers."""
    return _each(a, lambda x: x.cast("int"))


def to_float(a: Vector) -> Column:
    return F.transform(_of(a), lambda x: x.cast("float"))


def to_uint(a: Vector) -> Column:
    """Integers modulo 2**32, as an unsigned 32-bit machine word holds them."""
    return F.transform(_of(a), lambda x: F.pmod(x.cast("bigint"), F.lit(UINT)))


# --- arithmetic -----------------------------------------------------------


def negate(a: Vector) -> Column:
    return _each(a, lambda x: -x)


def add(a, b) -> Column:
    return _apply(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _apply(a, b, lambda x, y: x - y)


def multiply(a, b) -> Column:
    """Element by element."""
    return _apply(a, b, lambda x, y: x * y)


def divide(a, b) -> Column:
    """Element by element; x / 0 is infinite with the sign of x, and 0 / 0 is NaN."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return _apply(a, b, lambda x, y: F.when(y != 0, F.try_divide(x, y)).when((x == 0) | F.isnan(x), nan).when(y.isNull() | x.isNull(), F.lit(None)).otherwise(F.signum(x) * inf))


def minimum(a, b) -> Column:
    """Element-wise minimum; the second operand where either is NaN."""
    return _apply(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), y).otherwise(F.least(x, y)))


def maximum(a, b) -> Column:
    """Element-wise maximum; the second operand where either is NaN."""
    return _apply(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), y).otherwise(F.greatest(x, y)))


def clamp(a: Vector, low, high) -> Column:
    """Elements held within [low, high], each a number or a vector."""
    return maximum(low, minimum(a, high)) if not isinstance(low, (int, float)) else maximum(minimum(a, high), low)


def lerp(a, b, t) -> Column:
    """a + t * (b - a)."""
    return add(a, multiply(t, subtract(b, a)))


def floor(a: Vector) -> Column:
    return _each(a, lambda x: F.floor(x).cast("double"))


def frac(a: Vector) -> Column:
    """x - floor(x), never negative."""
    return _each(a, lambda x: x - F.floor(x))


def fmod(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return _apply(a, b, lambda x, y: F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x, y)))


def absolute(a: Vector) -> Column:
    return _each(a, F.abs)


def smoothstep(a, b, x) -> Column:
    """3 y**2 - 2 y**3 of y, the place of x between a and b held within [0, 1]."""
    width = b - a if isinstance(a, (int, float)) and isinstance(b, (int, float)) else subtract(b, a)
    y = clamp(divide(subtract(x, a), width), 0.0, 1.0)
    return F.transform(y, lambda v: v * v * (3.0 - 2.0 * v))


# --- reductions and geometry ---------------------------------------------


def sumc(a: Vector) -> Column:
    """The sum of the elements, in order; 0 for an empty vector."""
    return F.aggregate(_of(a), F.lit(0.0), lambda s, x: s + _d(x))


def dot(a: Vector, b: Vector) -> Column:
    return sumc(multiply(a, b))


def squared_norm(a: Vector) -> Column:
    return F.aggregate(_of(a), F.lit(0.0), lambda s, x: s + _d(x) * _d(x))


def norm(a: Vector) -> Column:
    return F.sqrt(squared_norm(a))


def normalized(a: Vector) -> Column:
    """The vector at length 1; null elements for the zero vector."""
    n = norm(a)
    return F.transform(_of(a), lambda x: _d(x) / F.nullif(n, F.lit(0.0)))


def reflect(i: Vector, n: Vector) -> Column:
    """i mirrored at the plane with normal n: i - 2 n (n . i)."""
    d = dot(n, i)
    return F.zip_with(_of(i), _of(n), lambda x, y: _d(x) - 2.0 * _d(y) * d)


def cross(a: Vector, b: Vector) -> Column:
    """The cross product of two vectors of three elements."""
    x, y = ([_d(_of(v)[k]) for k in range(3)] for v in (a, b))
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def squared_distance(a: Vector, b: Vector) -> Column:
    """The sum of squared differences: squared L2 distance."""
    return F.aggregate(F.zip_with(_of(a), _of(b), lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0), lambda s, x: s + x)


def relative_distance(query: Vector, base: Vector, base_norm2: Column | None = None) -> Column:
    """|b|**2 - 2 q . b: the squared distance but for |q|**2, so it ranks alike; it may be negative."""
    return (squared_norm(base) if base_norm2 is None else base_norm2) - 2.0 * dot(query, base)


def expanded_distance(query: Vector, base: Vector, base_norm2: Column | None = None, query_norm2: Column | None = None) -> Column:
    """The squared distance from norms and the product, never below 0."""
    return F.greatest(F.lit(0.0), relative_distance(query, base, base_norm2) + (squared_norm(query) if query_norm2 is None else query_norm2))
