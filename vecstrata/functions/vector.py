"""Column functions over dense vectors held as ``array<float>``.

All arithmetic is in double precision.  Every function is a composition of
built-in higher-order functions, so plans stay on the JVM side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_MAX = 255


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a variable that holds ``value``, which is evaluated once for a row: written into an inner function it
    would be evaluated again for every component, also where a filter is moved before the columns it reads."""
    return F.transform(F.array(value), f)[0]


def dim(v: Column) -> Column:
    """Number of components; NULL for a NULL vector."""
    return F.size(v).cast("long")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, a left-to-right sum in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def is_finite(v: Column) -> Column:
    """True when the vector is not NULL, not empty and every component is a finite number."""
    bad = lambda u: F.exists(u, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return bound(v, lambda u: u.isNotNull() & (F.size(u) > 0) & ~F.coalesce(bad(u), F.lit(True)))


def quantize(v: Column) -> Column:
    """Affine 8-bit code: ``struct(q_min, q_delta, q_codes)``.

    delta = (max - min) / 255 and code = floor((x - min) / delta + 1/2).  A
    constant vector has delta 0 and codes 0, which decode to the constant.
    """
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.struct(lo.alias("q_min"), ((hi - lo) / F.lit(float(CODE_MAX))).alias("q_delta"))
    code = lambda s: lambda x: F.when(s["q_delta"] == 0, F.lit(0)).otherwise(
        F.least(F.lit(CODE_MAX), F.floor((x.cast("double") - s["q_min"]) / F.nullif(s["q_delta"], F.lit(0.0)) + F.lit(0.5)).cast("int"))
    )
    return bound(scale, lambda s: F.struct(s["q_min"].alias("q_min"), s["q_delta"].alias("q_delta"), F.transform(v, code(s)).alias("q_codes")))


def dequantize(q_min: Column, q_delta: Column, q_codes: Column) -> Column:
    parts = F.struct(q_min.alias("q_min"), q_delta.alias("q_delta"), q_codes.alias("q_codes"))
    return bound(parts, lambda s: F.transform(s["q_codes"], lambda c: c.cast("double") * s["q_delta"] + s["q_min"]))


def hashed_unit(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone, alike in any SQL engine."""
    return (F.pmod(key * F.lit(2654435761) + F.lit(12345), F.lit(4294967296)).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def random_vector(key: Column, width: int) -> Column:
    """Components in [0, 1) derived from an integer key, independent of partitioning."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: (F.pmod((key * F.lit(width) + i) * F.lit(2654435761) + F.lit(97), F.lit(4294967296)).cast("double") / F.lit(4294967296.0)).cast("float"),
    )


def draw_level(key: Column, m: int) -> Column:
    """floor(-ln(u) / ln(m)) with u hashed from the key."""
    import math

    return F.floor(-F.log(hashed_unit(key)) / F.lit(math.log(m))).cast("int")
