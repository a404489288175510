"""Conversion plans: inference packing, dense-to-expert splitting, shard packing, audits."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm


#: What packing leaves as it is, by role.
KEPT_ROLES = ("vector", "vision", "router", "shared_expert", "conv1d")


def pack_role(name: Column, rank: Column) -> Column:
    """A tensor's part in packing, by the first rule that holds. Names are matched at their ends or between dots."""
    return (
        F.when(rank < 2, "vector")
        .when(name.startswith("model.visual.") | name.contains(".visual."), "vision")
        .when(name.endswith("mlp.gate.weight"), "router")
        .when(name.contains(".shared_expert."), "shared_expert")
        .when(name.endswith("conv1d.weight"), "conv1d")
        .when(name.endswith("mlp.experts.gate_up_proj") | name.endswith("mlp.experts.down_proj"), "expert")
        .when(name.endswith("embed_tokens.weight") | name.endswith("lm_head.weight"), "embed_head")
        .otherwise("attention")
    )


def pack_plan(tensors: DataFrame, expert: str = "Q4_K", other: str = "Q6_K", head: str = "Q6_K") -> DataFrame:
    """tensors (name, dims, type_id) with role, class, rows, cols, target, actual format after fallback and packed bytes.

    Leading dimensions fold into rows; what is not a float is passed through and marked.
    """
    from quantaloom.operators.catalog import with_bytes, with_sizes

    sized = with_bytes(with_sizes(tensors))
    role = pack_role(F.col("name"), F.size("dims"))
    floats = F.col("type_name").isin(*fm.FLOATS)
    kept = role.isin(*KEPT_ROLES)
    sized = sized.withColumns({"pack_role": role, "pack_class": F.when(kept | ~floats, "passthrough").otherwise(role), "warning": ~floats & ~kept})
    target = F.when(F.col("pack_class") == "expert", fm.ID[expert]).when(F.col("pack_class") == "embed_head", fm.ID[head]).when(F.col("pack_class") == "attention", fm.ID[other]).otherwise(F.col("type_id"))
    placed = fm.with_fallback(sized.withColumn("target_id", target), "target_id")
    packed = F.when(F.col("pack_class") == "passthrough", F.col("nbytes")).otherwise(fm.packed_bytes(F.col("n_elems"), F.col("actual_block"), F.col("actual_block_bytes")))
    return placed.withColumn("packed_bytes", packed)


def pack_report(plan: DataFrame) -> DataFrame:
    """By class: tensors, source and packed bytes, ratio and a histogram of formats."""
    by_type = plan.groupBy("pack_class", "actual_name").agg(F.count(F.lit(1)).alias("n"), F.sum("nbytes").alias("source"), F.sum("packed_bytes").alias("packed"), F.count_if("fell_back").alias("fell"))
    hist = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("actual_name", "n")))))
    out = by_type.groupBy("pack_class").agg(F.sum("n").alias("tensors"), F.sum("source").alias("source_bytes"), F.sum("packed").alias("packed_bytes"), F.sum("fell").alias("fell_back"), hist.alias("formats"))
    return out.withColumn("ratio", F.round(F.col("packed_bytes") / F.col("source_bytes"), 6))


def pack_totals(plan: DataFrame) -> DataFrame:
    """One row: tensors, source and packed bytes, how many times smaller, and the bytes a text-only reader touches."""
    touched = F.sum(F.when(F.col("pack_role") != "vision", F.col("packed_bytes")).otherwise(F.lit(0)))
    out = plan.agg(F.count(F.lit(1)).alias("tensors"), F.sum("nbytes").alias("source_bytes"), F.sum("packed_bytes").alias("packed_bytes"), touched.alias("resident_bytes"))
    return out.withColumn("smaller", F.round(F.col("source_bytes") / F.col("packed_bytes"), 6))


def pack_fallbacks(plan: DataFrame) -> DataFrame:
    """Tensors whose width did not fit their format's blocks, by width and the format taken."""
    return plan.where(F.col("fell_back") & (F.col("pack_class") != "passthrough")).groupBy("cols", "actual_name").agg(F.count(F.lit(1)).alias("tensors"))


def shard_plan(tensors: DataFrame, limit: int) -> DataFrame:
    """pos, name, bytes with the shard each goes to: a new one when the next would pass limit and the shard is not empty.

    The fold runs over a catalog (one row per tensor), in the order of pos.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")[["pos", "name", "bytes"]]
        shard, filled, empty, out = 0, 0, True, []
        for size in pdf["bytes"]:
            if not empty and filled + size > limit:
                shard, filled, empty = shard + 1, 0, True
            filled, empty = filled + size, False
            out.append(shard)
        return pdf.assign(shard=out)

    return tensors.select("pos", "name", "bytes", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(fold, "pos long, name string, bytes long, shard int")


def offsets(tensors: DataFrame, alignment: int = 32) -> DataFrame:
    """pos, name, bytes with each payload's aligned offset."""
    from pyspark.sql import Window

    padded = F.expr(f"((bytes + {alignment - 1}) div {alignment}) * {alignment}")
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a catalog
    return tensors.withColumn("offset", F.coalesce(F.sum(padded).over(before), F.lit(0)))


def split_experts(rows: DataFrame, experts: int, width: int, down: bool, scale: float = 1.0) -> DataFrame:
    """A dense matrix's rows (tensor, row, x) as expert matrices (tensor, expert, row, x).

    gate/up: the expert owns a range of `width` rows. down: it owns a range of `width` columns, scaled.
    """
    if not down:
        return rows.select("tensor", F.expr(f"row div {width}").alias("expert"), (F.col("row") % width).alias("row"), "x")
    parts = F.transform(F.sequence(F.lit(0), F.lit(experts - 1)), lambda e: F.struct(e.cast("long").alias("expert"), F.transform(F.slice("x", e * width + 1, width), lambda v: (v * F.lit(scale).cast("float")).cast("float")).alias("x")))
    return rows.select("tensor", "row", F.explode(parts).alias("p")).select("tensor", F.col("p.expert").alias("expert"), "row", F.col("p.x").alias("x"))


def fnv1a(text: str) -> int:
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return h


def router_values(prefix: str, n: int, amplitude: float) -> np.ndarray:
    """Deterministic values in [-amplitude, amplitude] by xorshift64, seeded by the layer's prefix."""
    state, out = max(fnv1a(prefix), 1), np.empty(n, np.float32)
    for i in range(n):
        state ^= state << 13 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 7
        state ^= state << 17 & 0xFFFFFFFFFFFFFFFF
        unit = np.float32(state >> 40) / np.float32((1 << 24) - 1)
        out[i] = (unit * np.float32(2) - np.float32(1)) * np.float32(amplitude)
    return out


def text_part(config: dict) -> dict:
    """The part of a config that describes the language model: itself, or its text_config."""
    return config["text_config"] if isinstance(config.get("text_config"), dict) else config


def _positive(text: dict, key: str) -> int:
    value = text.get(key)
    if not isinstance(value, int) or value <= 0:
        raise ValueError(f"{key} must be a positive integer")
    return value


def migrate_config(config: dict, experts: int, used: int, family: str, moe_family: str) -> dict:
    """A dense model's config (plain, or with text_config and vision_config) as that of an expert model; others are refused."""
    if "quantization_config" in config:
        raise ValueError("a quantized model cannot be converted")
    if config.get("model_type") != family:
        raise ValueError(f"model_type is {config.get('model_type')!r}, not {family!r}")
    out = json.loads(json.dumps(config))
    text = text_part(out)
    if text is not out:
        vision = out.get("vision_config")
        if text.get("model_type") != f"{family}_text":
            raise ValueError(f"text_config is of {text.get('model_type')!r}, not {family}_text")
        if not isinstance(vision, dict) or vision.get("model_type") not in (family, f"{family}_vision"):
            raise ValueError("vision_config is missing or of another family")
        vision["model_type"] = moe_family
        text["model_type"] = f"{moe_family}_text"
    out["model_type"] = moe_family
    layers, width = _positive(text, "num_hidden_layers"), _positive(text, "intermediate_size")
    _positive(text, "hidden_size")
    spread = text.get("initializer_range", 0.02)
    if not 0 < spread < float("inf"):
        raise ValueError("initializer_range must be positive and finite")
    kinds = text.get("layer_types")
    if kinds is not None and (len(kinds) != layers or not set(kinds) <= {"full_attention", "linear_attention"}):
        raise ValueError(f"layer_types does not name the attention of {layers} layers")
    if width % experts:
        raise ValueError(f"{experts} experts do not divide {width} units")
    del text["intermediate_size"]
    text |= {"num_experts": experts, "num_experts_per_tok": used, "moe_intermediate_size": width // experts, "shared_expert_intermediate_size": 1, "output_router_logits": True, "router_aux_loss_coef": 0.001}
    if "architectures" in out:
        out["architectures"] = [a if "Moe" in a else a.replace("For", "MoeFor", 1) for a in out["architectures"]]
    return out


def moe_plan(tensors: DataFrame, experts: int, hidden: int, width: int) -> DataFrame:
    """Output tensors of a conversion, with dims and action.

    Copies, and per layer packed gate_up and down, a new router, and a shared expert of one unit and its gate, all zero.
    """
    pattern = r"^(.*layers\.([0-9]+)\.mlp)\.(gate|up|down)_proj\.weight$"
    stem = F.regexp_extract("name", pattern, 1)
    dense = tensors.where(F.col("name").rlike(pattern)).select(stem.alias("stem"), F.regexp_extract("name", pattern, 3).alias("part"), "dims", "type_id")
    by = dense.groupBy("stem").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("type_id").alias("types"), F.min("type_id").alias("type_id"))
    sound = F.when((F.col("parts") == 3) & (F.col("types") == 1), F.col("stem")).otherwise(F.raise_error(F.format_string("%s lacks a part or mixes types", F.col("stem"))))
    small = width // experts
    made = by.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.concat(sound, F.lit(end)).alias("name"), F.array(*(F.lit(d).cast("long") for d in dims)).alias("dims"), F.col("type_id").alias("type_id"), F.lit(action).alias("action"))
                    for end, dims, action in ((".experts.gate_up_proj", (experts, 2 * small, hidden), "split_rows"), (".experts.down_proj", (experts, hidden, small), "split_cols"), (".gate.weight", (experts, hidden), "router"),
                        (".shared_expert.gate_proj.weight", (1, hidden), "zeros"), (".shared_expert.up_proj.weight", (1, hidden), "zeros"), (".shared_expert.down_proj.weight", (hidden, 1), "zeros"), (".shared_expert_gate.weight", (1, hidden), "zeros"))
                )
            )
        ).alias("t")
    ).select("t.*")
    copies = tensors.where(~F.col("name").rlike(pattern)).select("name", "dims", "type_id", F.lit("copy").alias("action"))
    return copies.unionByName(made)


def audit(source: DataFrame, output: DataFrame, replaced: DataFrame) -> DataFrame:
    """Problems of a conversion: missing, changed, left over or repeated names; empty when sound."""
    s = source.select("name", F.to_json(F.struct("dims", "type_id")).alias("s")).join(replaced.select("name", F.lit(True).alias("gone")), "name", "left")
    o = output.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_json(F.struct("dims", "type_id"))).alias("o"))
    both = s.join(o, "name", "full_outer")
    problem = F.when(F.col("n") > 1, "repeated").when(F.col("s").isNotNull() & F.col("gone").isNull() & F.col("o").isNull(), "missing").when(F.col("gone") & F.col("o").isNotNull(), "left over").when(F.col("gone").isNull() & F.col("s").isNotNull() & (F.col("s") != F.col("o")), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def attention_layout(names: DataFrame, n_layers: int, declared: list[str]) -> DataFrame:
    """Per layer which attention it has and whether that is exactly the declared one."""
    spark = names.sparkSession
    want = spark.createDataFrame(list(enumerate(declared)), "layer long, declared string")
    layer = F.regexp_extract("name", r"layers\.([0-9]+)\.", 1)
    found = names.where(layer != "").groupBy(layer.cast("long").alias("layer")).agg(F.bool_or(F.col("name").contains("self_attn.")).alias("full"), F.bool_or(F.col("name").contains("linear_attn.")).alias("linear"))
    out = spark.range(n_layers).withColumnRenamed("id", "layer").join(found, "layer", "left").join(want, "layer", "left")
    full, linear = F.coalesce("full", F.lit(False)), F.coalesce("linear", F.lit(False))
    kind = F.when(full & ~linear, "full_attention").when(linear & ~full, "linear_attention").otherwise("invalid")
    return out.select("layer", kind.alias("found"), "declared", (kind == F.col("declared")).alias("sound"))


def manifest(plan: DataFrame) -> DataFrame:
    """One row of JSON: every packed tensor with format, id, shape and bytes."""
    one = F.struct(F.col("actual_name").alias("format"), F.col("actual_id").alias("type_id"), F.col("dims").alias("shape"), "rows", "cols", F.expr("packed_bytes div rows").alias("row_bytes"), F.col("packed_bytes").alias("nbytes"))
    return plan.where("pack_class <> 'passthrough'").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", one))))).alias("manifest"))
