"""Blocked round trips of tensor rows, in column expressions.

A row keeps its values as one array, blocks are slices of it, and a block never
leaves its row: nothing is exploded and nothing is shuffled before the sums by tensor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import codecs as c
from quantaloom.functions.formats import BLOCK


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def amax(b: Column) -> Column:
    return F.aggregate(b, c.lit32(0.0), lambda a, x: F.greatest(a, F.abs(x)))


def signed_max(b: Column) -> Column:
    """The value of largest magnitude; the first on a tie."""
    return F.aggregate(b, c.lit32(0.0), lambda a, x: F.when(F.abs(x) > F.abs(a), x).otherwise(a))


def _inverse(d: Column) -> Column:
    return F.when(d != 0, c.f32(c.lit32(1.0) / d)).otherwise(c.lit32(0.0))


def _coded(b: Column, code: Callable, value: Callable) -> Column:
    return F.transform(b, lambda x: _let(code(x).cast("int"), lambda q: F.struct(x.alias("x"), q.alias("q"), c.f32(value(q, x)).alias("v"))))


def _scaled(b: Column, scale: Column, code: Callable, value: Callable) -> Column:
    """code(x, d, 1/d) and value(q, d) for one scale d."""
    return _let(scale, lambda d: _let(F.struct(d.alias("d"), _inverse(d).alias("i")), lambda s: _coded(b, lambda x: code(x, s["d"], s["i"]), lambda q, x: value(q, s["d"]))))


def _affine(b: Column, levels: int, clamp: bool) -> Column:
    low, high = F.array_min(b), F.array_max(b)
    code = lambda x, s: c.truncated((x - s["m"]) * s["i"] + c.lit32(0.5))
    bounds = F.struct(low.alias("m"), c.f32((high - low) / c.lit32(float(levels))).alias("d"))
    return _let(
        bounds,
        lambda t: _let(
            F.struct(t["m"].alias("m"), t["d"].alias("d"), _inverse(t["d"]).alias("i")),
            lambda s: _coded(b, lambda x: F.least(code(x, s), F.lit(levels)) if clamp else code(x, s), lambda q, x: c.f32(q) * c.f16(s["d"]) + c.f16(s["m"])),
        ),
    )


def _legacy(b: Column, half: int) -> Column:
    return _scaled(b, c.f32(signed_max(b) / c.lit32(-float(half))), lambda x, d, i: F.least(c.truncated(x * i + c.lit32(half + 0.5)), F.lit(2 * half - 1)), lambda q, d: c.f32(q - half) * c.f16(d))


def _eight(b: Column) -> Column:
    return _scaled(b, c.f32(amax(b) / c.lit32(127.0)), lambda x, d, i: c.half_away(x * i), lambda q, d: c.f32(q) * c.f16(d))


def _ternary(b: Column, top: int) -> Column:
    return _scaled(b, amax(b), lambda x, d, i: F.least(F.greatest(c.half_away(x * i) + 1, F.lit(0)), F.lit(top)), lambda q, d: c.f32(q - 1) * c.f16(d))


def _q1(b: Column) -> Column:
    mean = c.f32(F.aggregate(b, c.lit32(0.0), lambda a, x: c.f32(a + F.abs(x))) / c.lit32(float(BLOCK["Q1_0"][0])))
    return _scaled(b, mean, lambda x, d, i: (x >= 0).cast("int"), lambda q, d: c.f32(2 * q - 1) * c.f16(d))


def _q8k(b: Column) -> Column:
    scale = F.when(signed_max(b) != 0, c.f32(c.lit32(-127.0) / signed_max(b))).otherwise(c.lit32(0.0))
    return _scaled(b, scale, lambda x, d, i: F.least(c.half_even(d * x), F.lit(127)), lambda q, d: _inverse(d) * c.f32(q))


def _shared(b: Column, drop: int, element: Callable, steps: float) -> Column:
    """Elements of a small float under a shared power of two; q counts steps of the element."""
    code = F.greatest(c.e8m0(amax(b)) - F.lit(drop), F.lit(0))
    scale = F.when(amax(b) > 0, c.f32(c.e8m0_value(code))).otherwise(c.f32(c.e8m0_value(F.lit(0))))
    return _let(scale, lambda s: F.transform(b, lambda x: _let(element(x * c.f32(c.lit32(1.0) / s)), lambda e: F.struct(x.alias("x"), (e * F.lit(steps)).cast("int").alias("q"), (e * s).alias("v")))))


def _float(b: Column, codec: Callable) -> Column:
    return F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(0).alias("q"), codec(x).alias("v")))


def fp8_scaled(b: Column, scale: Column, codec: Callable, steps: float) -> Column:
    """Dense FP8 under a given scale."""
    return _let(scale, lambda s: F.transform(b, lambda x: _let(codec(x * c.f32(c.lit32(1.0) / s)), lambda e: F.struct(x.alias("x"), (e * F.lit(steps)).cast("long").alias("q"), (e * s).alias("v")))))


TINY = 1.1754943508222875e-38


def fp8_scale(top: Column, limit: float) -> Column:
    return F.greatest(c.f32(top / c.lit32(limit)), c.lit32(TINY))


#: Format -> array of (x, q, v) for one block.
BLOCKS: dict[str, Callable[[Column], Column]] = {
    "Q1_0": _q1,
    "Q2_0": lambda b: _ternary(b, 3),
    "Q4_0": lambda b: _legacy(b, 8),
    "Q4_1": lambda b: _affine(b, 15, True),
    "Q5_0": lambda b: _legacy(b, 16),
    "Q5_1": lambda b: _affine(b, 31, False),
    "Q8_0": _eight,
    "Q8_1": _eight,
    "Q8_K": _q8k,
    "TQ1_0": lambda b: _ternary(b, 2),
    "TQ2_0": lambda b: _ternary(b, 2),
    "MXFP4": lambda b: _shared(b, 2, c.e2m1, 2.0),
    "MXFP4_OCP": lambda b: _shared(b, 2, c.e2m1, 2.0),
    "MXFP8": lambda b: _shared(b, 8, c.e4m3, 512.0),
    "F16": lambda b: _float(b, c.f16),
    "BF16": lambda b: _float(b, c.bf16),
    "F32": lambda b: _float(b, lambda x: x),
}
#: Dense FP8 formats: codec, largest value, steps per unit.
DENSE = {"FP8_E4M3": (c.e4m3, c.E4M3_MAX, 512.0), "FP8_E5M2": (c.e5m2, c.E5M2_MAX, 65536.0)}


def _by_block(x: Column, block: int, one: Callable[[Column], Column]) -> Column:
    if block == 1:
        return one(x)
    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(x) / block).cast("int") - 1), lambda i: one(F.slice(x, i * block + 1, block))))


def roundtrip(rows: DataFrame, name: str) -> DataFrame:
    """rows (tensor, row, x array<float>) with `e`, an array of (x, q, v): value, code, value after the round trip.

    Rows that the format's block does not divide raise, as they do when packing.
    """
    block, _ = BLOCK[name]
    whole = F.when(F.size("x") % block == 0, F.col("x")).otherwise(F.raise_error(F.format_string(f"{name}: a row of %d values is not whole blocks of {block}", F.size("x"))).cast("array<float>"))
    if name in DENSE:
        codec, limit, steps = DENSE[name]
        return rows.withColumn("e", fp8_scaled(whole, fp8_scale(amax(F.col("x")), limit), codec, steps))
    if name == "NVFP4":
        return _nvfp4(rows.withColumn("x", whole))
    return rows.withColumn("e", _by_block(whole, block, BLOCKS[name]))


def roundtrip_blocks(rows: DataFrame, name: str) -> DataFrame:
    """rows (tensor, row, blocks array<array<float>>) with `e` as of roundtrip. A short block is scaled as if zeros filled it up."""
    return rows.withColumn("e", F.flatten(F.transform("blocks", BLOCKS[name])))


def _nvfp4(rows: DataFrame) -> DataFrame:
    """Two levels of scale: one per tensor, and an E4M3 one per 16 values."""
    top = rows.groupBy("tensor").agg(F.max(amax(F.col("x"))).alias("_top"))
    scale = F.when(F.col("_top") > 0, c.f32(F.col("_top") / c.lit32(c.E2M1_MAX * c.E4M3_MAX))).otherwise(c.lit32(1.0))

    def one(b: Column) -> Column:
        local = c.e4m3(c.f32(c.f32(amax(b) / c.lit32(c.E2M1_MAX)) / F.col("_g")))
        return _let(c.f32(local * F.col("_g")), lambda s: F.transform(b, lambda x: _let(c.e2m1(x * _inverse(s)), lambda e: F.struct(x.alias("x"), (e * F.lit(2.0)).cast("int").alias("q"), (e * s).alias("v")))))

    return rows.join(top.withColumn("_g", scale).drop("_top"), "tensor").withColumn("e", _by_block(F.col("x"), 16, one)).drop("_g")


def fp8_tiles(rows: DataFrame, height: int, width: int, name: str = "FP8_E4M3") -> DataFrame:
    """Dense FP8 with one scale per tile of height rows and width columns."""
    codec, limit, steps = DENSE[name]
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("x") / width).cast("int") - 1), lambda i: F.slice("x", i * width + 1, width))
    tops = rows.select("tensor", F.expr(f"row div {height}").alias("band"), F.transform(parts, amax).alias("tops"))
    best = tops.select("tensor", "band", F.posexplode("tops").alias("tile", "top")).groupBy("tensor", "band", "tile").agg(F.max("top").alias("top"))
    scales = best.groupBy("tensor", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "top"))), lambda t: fp8_scale(t["top"], limit)).alias("_s"))
    joined = rows.withColumn("band", F.expr(f"row div {height}")).join(scales, ["tensor", "band"])
    one = F.zip_with(parts, F.col("_s"), lambda b, s: F.transform(b, lambda x: _let(codec(c.f32(x / s)), lambda e: F.struct(x.alias("x"), (e * F.lit(steps)).cast("int").alias("q"), (e * s).alias("v")))))
    return joined.withColumn("e", F.flatten(one)).drop("band", "_s")


def error_report(coded: DataFrame, name: str) -> DataFrame:
    """By tensor: values, bytes, sums of codes, squared error and energy."""
    block, size = BLOCK[name]
    e = F.col("e")
    total = lambda f, zero: F.aggregate(e, zero, lambda a, y: a + f(y))
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    d = lambda v: v.cast("double")
    rows = coded.select(
        "tensor",
        F.size(e).cast("long").alias("n"),
        total(lambda y: y["q"].cast("long"), zero).alias("code_sum"),
        total(lambda y: F.abs(y["q"]).cast("long"), zero).alias("code_abs"),
        total(lambda y: (d(y["x"]) - d(y["v"])) * (d(y["x"]) - d(y["v"])), none).alias("sq_err"),
        total(lambda y: d(y["x"]) * d(y["x"]), none).alias("energy"),
    )
    out = rows.groupBy("tensor").agg(*(F.sum(k).alias(k) for k in ("n", "code_sum", "code_abs", "sq_err", "energy")))
    return out.select("tensor", "n", F.expr(f"(n div {block}) * {size}").alias("bytes"), "code_sum", "code_abs", F.round("sq_err", 6).alias("sq_err"), F.round("energy", 6).alias("energy"))
