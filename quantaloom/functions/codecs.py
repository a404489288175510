"""Scalar codecs as column expressions: floats of fewer bits, shared exponents, roundings.

Single precision is followed step by step where a format asks for it: FLOAT products
and sums stay FLOAT, quotients are cast back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

E2M1_MAX, E4M3_MAX, E5M2_MAX = 6.0, 448.0, 57344.0
#: E2M1: (largest magnitude that rounds down to the value, value); fixed values of the format.
E2M1 = [(0.25, 0.0), (0.75, 0.5), (1.25, 1.0), (1.75, 1.5), (2.5, 2.0), (3.5, 3.0), (5.0, 4.0)]


def lit32(x: float) -> Column:
    return F.lit(x).cast("float")


def f32(x: Column) -> Column:
    return x.cast("float")


def exp2(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def exponent(x: Column) -> Column:
    """floor(log2 |x|); x is not 0."""
    return F.floor(F.log2(F.abs(x.cast("double"))))


def half_away(x: Column) -> Column:
    """Round half away from zero, as double."""
    d = x.cast("double")
    return F.signum(d) * F.floor(F.abs(d) + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x.cast("double"))


def truncated(x: Column) -> Column:
    """Towards zero, as int."""
    return x.cast("int")


def _minifloat(x: Column, low: int, mantissa: int, top: float, saturate: bool = True) -> Column:
    """The nearest value (half to even) of a float of that lowest exponent and mantissa; beyond top, top or infinity."""
    d = x.cast("double")
    unit = exp2(F.greatest(exponent(d), F.lit(low)) - F.lit(mantissa))
    near = F.rint(F.abs(d) / unit) * unit
    near = F.when(near > top, F.lit(top if saturate else float("inf"))).otherwise(near)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.signum(d) * near)


def f16(x: Column) -> Column:
    """To half precision and back; what rounds above 65504 is infinite."""
    return f32(_minifloat(x, -14, 10, 65504.0, saturate=False))


def bf16(x: Column) -> Column:
    return f32(_minifloat(x, -126, 7, 3.3895313892515355e38, saturate=False))


def e4m3(x: Column) -> Column:
    return f32(_minifloat(x, -6, 3, E4M3_MAX))


def e5m2(x: Column) -> Column:
    return f32(_minifloat(x, -14, 2, E5M2_MAX))


def e2m1(x: Column) -> Column:
    """Nearest of 0, .5, 1, 1.5, 2, 3, 4, 6; a tie goes to the smaller magnitude."""
    size = F.abs(x)
    out = F.lit(E2M1_MAX)
    for cut, value in reversed(E2M1):
        out = F.when(size <= lit32(cut), F.lit(value)).otherwise(out)
    return f32(F.when(x < 0, -out).otherwise(out))


def e8m0(x: Column) -> Column:
    """The power of two at or below x as a biased code; 0 for what is not positive."""
    return F.when(x > 0, F.least(F.greatest(exponent(x) + 127, F.lit(0)), F.lit(254))).otherwise(F.lit(0)).cast("int")


def e8m0_value(code: Column) -> Column:
    return exp2(code - F.lit(127))
