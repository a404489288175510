"""Recipes: precision rules where the last match wins, and floors no rule may cross."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm

# Fixed default policy, in order: role patterns, depth, format.
DEFAULT_RULES = [
    (["router"], None, "F16"),
    (["lm_head", "norm"], None, "F16"),
    (["embedding"], None, "Q8_0"),
    (["attn_q", "attn_k", "attn_v", "attn_o", "attn_qkv", "attn_mla"], None, "Q5_K"),
    (["ssm"], None, "Q5_K"),
    (["shared_expert"], None, "Q5_K"),
    (["ffn_down"], None, "Q5_K"),
    (["routed_expert"], None, "Q4_K"),
    (["routed_expert.down"], ">= 0.75", "Q5_K"),
]
DEFAULT = {"defaults": {"bits": "Q4_K", "imatrix": True}, "rule": [{"role": roles, "layer": depth, "bits": bits} for roles, depth, bits in DEFAULT_RULES]}

RULES = "idx int, roles array<string>, names array<string>, depth_lo double, lo_open boolean, depth_hi double, hi_open boolean, expert_lo long, expert_hi long, bits string, imatrix boolean"
SLACK = 1e-9


def read(text: str) -> dict:
    """A recipe from TOML text."""
    return tomllib.loads(text)


def depth_bounds(text: str | None) -> tuple[float | None, bool, float | None, bool]:
    """(low, open, high, open) of '*', '>= x', '> x', '<= x', '< x', 'a..b' (both ends inclusive)."""
    text = (text or "*").strip()
    if text in ("*", ""):
        return None, False, None, False
    if m := re.fullmatch(r"(>=|>|<=|<)\s*([0-9.eE+-]+)", text):
        value, is_open = float(m[2]), len(m[1]) == 1
        return (value, is_open, None, False) if m[1][0] == ">" else (None, False, value, is_open)
    if m := re.fullmatch(r"([0-9.]+?)\s*\.\.=?\s*([0-9.]+)", text):
        return float(m[1]), False, float(m[2]), False
    raise ValueError(f"unreadable depth {text!r}")


def expert_bounds(text: str | None) -> tuple[int | None, int | None]:
    """(low, high) of '*', '>= n', 'a..b', 'a..=b' (inclusive); (None, None) matches all."""
    text = (text or "*").strip()
    if text in ("*", ""):
        return None, None
    if m := re.fullmatch(r">=\s*([0-9]+)", text):
        return int(m[1]), None
    if m := re.fullmatch(r"([0-9]+)\s*\.\.=?\s*([0-9]+)", text):
        return int(m[1]), int(m[2])
    raise ValueError(f"unreadable expert range {text!r}")


def rule_rows(recipe: dict) -> list[tuple]:
    listed = lambda x: None if x is None else [x] if isinstance(x, str) else list(x)
    return [(i, listed(r.get("role")), listed(r.get("name")), *depth_bounds(r.get("layer")), *expert_bounds(r.get("expert")), fm.canonical(r["bits"]), r.get("imatrix", True)) for i, r in enumerate(recipe.get("rule", []))]


def rules(spark: SparkSession, recipe: dict) -> DataFrame:
    """The recipe's rules: as many rows as the recipe has."""
    return F.broadcast(spark.createDataFrame(rule_rows(recipe), RULES))


def role_matches(pattern: Column, role: Column) -> Column:
    """Exact; `x.*` and a bare family match x and any x.part."""
    family = F.regexp_replace(pattern, r"\.\*$", "")
    wide = pattern.endswith(".*") | ~pattern.contains(".")
    return (pattern == role) | (wide & ((role == family) | role.startswith(F.concat(family, F.lit(".")))))


def resolve(tensors: DataFrame, recipe: dict) -> DataFrame:
    """tensors (name, role, depth, expert, packed_expert, quantizable) with bits, imatrix, target_id, copy_unchanged.

    The rules join on their conditions, each absent one matching all, and the last match wins.
    A tensor of packed experts counts as expert 0; others never match an expert range.
    """
    spark = tensors.sparkSession
    r = rules(spark, recipe).select(*(F.col(c).alias(f"r_{c}") for c in ("idx", "roles", "names", "depth_lo", "lo_open", "depth_hi", "hi_open", "expert_lo", "expert_hi", "bits", "imatrix")))
    expert = F.when(F.col("packed_expert"), F.lit(0).cast("long")).otherwise(F.col("expert"))
    f32 = lambda c: c.cast("float").cast("double")
    condition = (
        (F.col("r_roles").isNull() | F.exists("r_roles", lambda p: role_matches(p, F.col("role"))))
        & (F.col("r_names").isNull() | F.array_contains("r_names", F.col("name")))
        & (F.col("r_depth_lo").isNull() | (F.col("depth") > f32(F.col("r_depth_lo"))) | (~F.col("r_lo_open") & (F.col("depth") == f32(F.col("r_depth_lo")))))
        & (F.col("r_depth_hi").isNull() | (F.col("depth") < f32(F.col("r_depth_hi"))) | (~F.col("r_hi_open") & (F.col("depth") == f32(F.col("r_depth_hi")))))
        & ((F.col("r_expert_lo").isNull() & F.col("r_expert_hi").isNull()) | F.coalesce((expert >= F.col("r_expert_lo")) & (F.col("r_expert_hi").isNull() | (expert <= F.col("r_expert_hi"))), F.lit(False)))
    )
    defaults = recipe.get("defaults", {})
    names = [c for c in tensors.columns]
    matched = tensors.join(r, condition, "left").groupBy(*names).agg(F.max_by(F.struct("r_bits", "r_imatrix"), "r_idx").alias("_m"))
    out = matched.withColumns({"bits": F.coalesce("_m.r_bits", F.lit(fm.canonical(defaults.get("bits", "Q4_K")))), "imatrix": F.coalesce("_m.r_imatrix", F.lit(defaults.get("imatrix", True)))}).drop("_m")
    f = fm.formats(spark).select(F.col("type_name").alias("bits"), F.col("type_id").alias("target_id"), fm.bits_per_weight(F.col("block"), F.col("block_bytes")).alias("target_bpw"))
    return out.join(f, "bits", "left").withColumn("copy_unchanged", ~F.col("quantizable"))


def violations(policies: DataFrame, recipe: dict) -> DataFrame:
    """Quantizable tensors below their floor: name, role, bits, target_bpw, floor, floor_bpw."""
    floors = recipe.get("floors", {})
    bpw = lambda name: fm.BLOCK[name][1] * 8 / fm.BLOCK[name][0]
    router, dense = fm.canonical(floors.get("router", "F16")), floors.get("dense_path")
    checks = [(F.col("role") == "router", router)]
    if dense:
        checks.append((F.col("dense_path"), fm.canonical(dense)))
    parts = [policies.where(F.col("quantizable") & rule & (F.col("target_bpw").isNull() | (F.col("target_bpw") + F.lit(SLACK) < F.lit(bpw(floor))))).select("name", "role", "bits", "target_bpw", F.lit(floor).alias("floor"), F.lit(bpw(floor)).alias("floor_bpw")) for rule, floor in checks]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def enforce(policies: DataFrame, recipe: dict) -> DataFrame:
    """policies, or an error that names a tensor below its floor."""
    found = violations(policies, recipe).orderBy("name").limit(3).collect()
    if found:
        raise ValueError("below the floor: " + "; ".join(f"{r['name']} ({r['bits']} under {r['floor']})" for r in found))
    return policies
