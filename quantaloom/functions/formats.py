"""Storage formats as a small dimension table, and arithmetic over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: id, name, elements per block, bytes per block.
# Ids from 0x8000 on are internal and never stand in a GGUF file.
FORMATS = [
    (0, "F32", 1, 4),
    (1, "F16", 1, 2),
    (2, "Q4_0", 32, 18),
    (3, "Q4_1", 32, 20),
    (6, "Q5_0", 32, 22),
    (7, "Q5_1", 32, 24),
    (8, "Q8_0", 32, 34),
    (9, "Q8_1", 32, 36),
    (10, "Q2_K", 256, 84),
    (11, "Q3_K", 256, 110),
    (12, "Q4_K", 256, 144),
    (13, "Q5_K", 256, 176),
    (14, "Q6_K", 256, 210),
    (15, "Q8_K", 256, 292),
    (16, "IQ2_XXS", 256, 66),
    (17, "IQ2_XS", 256, 74),
    (18, "IQ3_XXS", 256, 98),
    (19, "IQ1_S", 256, 50),
    (20, "IQ4_NL", 32, 18),
    (21, "IQ3_S", 256, 110),
    (22, "IQ2_S", 256, 82),
    (23, "IQ4_XS", 256, 136),
    (29, "IQ1_M", 256, 56),
    (30, "BF16", 1, 2),
    (34, "TQ1_0", 256, 54),
    (35, "TQ2_0", 256, 66),
    (39, "MXFP4", 32, 17),
    (40, "NVFP4_GGUF", 64, 36),
    (41, "Q1_0", 128, 18),
    (42, "Q2_0", 64, 18),
    (0x8000, "NVFP4", 16, 9),
    (0x8001, "FP8_E4M3", 1, 1),
    (0x8002, "FP8_E5M2", 1, 1),
    (0x8003, "MXFP8", 32, 33),
    (0x8004, "MXFP4_OCP", 32, 17),
]
# Fixed second names.
ALIASES = {"FP16": "F16", "FP32": "F32", "FP8": "FP8_E4M3", "GGML_NVFP4": "NVFP4_GGUF", "RAW": "F32"}
# Fixed fallbacks of formats whose block does not divide a row; any other goes to F16.
FALLBACKS = {
    "Q4_0": ["Q2_K", "Q3_K", "TQ1_0", "TQ2_0", "Q1_0", "Q2_0"],
    "Q5_0": ["Q4_K"],
    "Q5_1": ["Q5_K"],
    "Q8_0": ["Q6_K", "Q8_K", "NVFP4_GGUF"],
    "IQ4_NL": ["IQ2_XXS", "IQ2_XS", "IQ3_XXS", "IQ1_S", "IQ3_S", "IQ2_S", "IQ4_XS", "IQ1_M"],
    "FP8_E4M3": ["MXFP4_OCP", "NVFP4", "MXFP8"],
}
# Fixed ladders, cheapest first.
LADDERS = {
    "kquant": ["Q2_K", "Q3_K", "Q4_K", "Q5_K", "Q6_K", "Q8_0"],
    "iquant": ["IQ1_S", "IQ1_M", "IQ2_XXS", "IQ2_XS", "IQ2_S", "IQ3_XXS", "IQ3_S", "IQ4_XS", "IQ4_NL"],
    "full": ["Q1_0", "IQ1_S", "TQ1_0", "IQ1_M", "IQ2_XXS", "TQ2_0", "Q2_0", "IQ2_XS", "IQ2_S", "Q2_K", "IQ3_XXS", "IQ3_S", "Q3_K", "IQ4_XS", "Q4_K", "IQ4_NL", "Q5_K", "Q6_K", "Q8_0"],
    "blockfloat": ["MXFP4", "NVFP4", "FP8_E4M3", "MXFP8"],
}
FLOATS = ("F32", "F16", "BF16")
FP4 = ("MXFP4", "MXFP4_OCP", "NVFP4", "NVFP4_GGUF")
FP8 = ("FP8_E4M3", "FP8_E5M2", "MXFP8")
INTERNAL = 0x8000

ID = {name: i for i, name, _, _ in FORMATS}
NAME = {i: name for i, name, _, _ in FORMATS}
BLOCK = {name: (block, size) for _, name, block, size in FORMATS}
PRIMARY = {name: goal for goal, names in FALLBACKS.items() for name in names}

SCHEMA = "type_id int, type_name string, block int, block_bytes int, primary_id int, is_float boolean, is_fp4 boolean, is_fp8 boolean, is_gguf boolean"


def rows() -> list[tuple]:
    return [(i, name, block, size, ID[PRIMARY.get(name, "F16")], name in FLOATS, name in FP4, name in FP8, i < INTERNAL) for i, name, block, size in FORMATS]


def formats(spark: SparkSession) -> DataFrame:
    """The format table: some thirty rows, so it may be broadcast anywhere."""
    return F.broadcast(spark.createDataFrame(rows(), SCHEMA))


def values() -> str:
    """The same table as SQL VALUES, for the DuckDB side."""
    cells = ", ".join("(" + ", ".join(repr(v).lower() if isinstance(v, bool) else repr(v) for v in row) + ")" for row in rows())
    return f"(VALUES {cells}) AS formats(type_id, type_name, block, block_bytes, primary_id, is_float, is_fp4, is_fp8, is_gguf)"


def canonical(name: str) -> str:
    """A format's own name from any accepted spelling."""
    found = ALIASES.get(name.upper(), name.upper())
    if found not in ID:
        raise ValueError(f"unknown format {name!r}")
    return found


def ladder(names: str | list[str]) -> list[str]:
    """A preset, or a list stably sorted by bits per weight."""
    if isinstance(names, str):
        if names in LADDERS:
            return LADDERS[names]
        names = names.split(",")
    return sorted(map(canonical, (n.strip() for n in names)), key=lambda n: BLOCK[n][1] * 8 / BLOCK[n][0])


def type_name(type_id: Column, name: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("type"), type_id.cast("string")))


def bits_per_weight(block: Column, size: Column) -> Column:
    return size * F.lit(8.0) / block


def packed_bytes(elements: Column, block: Column, size: Column) -> Column:
    """Null where the block does not divide the elements."""
    return F.when(elements % block == 0, F.expr("1") * (elements / block).cast("long") * size)


def with_fallback(tensors: DataFrame, target: str = "type_id", cols: str = "cols") -> DataFrame:
    """tensors with actual_id, actual_name, block geometry and whether it fell back."""
    spark = tensors.sparkSession
    f = formats(spark).select(F.col("type_id").alias("_t"), F.col("block").alias("_tb"), "primary_id")
    p = formats(spark).select(F.col("type_id").alias("_p"), F.col("block").alias("_pb"))
    known = tensors.join(f, F.col(target) == F.col("_t"), "left").join(p, F.col("primary_id") == F.col("_p"), "left")
    fits = F.col(cols) % F.col("_tb") == 0
    actual = F.when(fits, F.col(target)).when(F.col(cols) % F.col("_pb") == 0, F.col("primary_id")).otherwise(F.lit(ID["F16"]))
    out = known.withColumn("actual_id", actual).withColumn("fell_back", F.coalesce(~fits, F.lit(True))).drop("_t", "_tb", "_p", "_pb", "primary_id")
    g = formats(spark).select(F.col("type_id").alias("actual_id"), F.col("type_name").alias("actual_name"), F.col("block").alias("actual_block"), F.col("block_bytes").alias("actual_block_bytes"))
    return out.join(g, "actual_id", "left")
