"""The tensor catalog: sizes, roles, layout, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm
from quantaloom.functions.text import human_bytes

# Fixed names: whole tensors, and suffixes after `blk.N.`, by role. Names end in
# .weight here; a .bias of the same name has the same role where `bias` says so.
WHOLE = {"token_embd": "embedding", "output": "lm_head", "output_norm": "norm"}
SUFFIXES = {
    "attn_q": ["attn_q"],
    "attn_k": ["attn_k"],
    "attn_v": ["attn_v"],
    "attn_o": ["attn_o", "attn_output"],
    "attn_qkv": ["attn_qkv"],
    "attn_mla.q_a": ["attn_q_a"],
    "attn_mla.q_b": ["attn_q_b"],
    "attn_mla.kv_a": ["attn_kv_a"],
    "attn_mla.kv_a_mqa": ["attn_kv_a_mqa"],
    "attn_mla.kv_b": ["attn_kv_b"],
    "router": ["ffn_gate_inp"],
    "ffn_gate": ["ffn_gate"],
    "ffn_up": ["ffn_up"],
    "ffn_down": ["ffn_down"],
    "ssm_param": ["ssm_a", "ssm_dt", "ssm_d", "ssm_alpha", "ssm_beta", "ssm_ba"],
    "ssm": ["ssm_in", "ssm_out", "ssm_x", "ssm_conv1d", "ssm_f", "ssm_g", "ssm_b", "ssm_c"],
}
WEIGHT_ONLY = {
    "shared_expert.gate": ["ffn_gate_shexp"],
    "shared_expert.up": ["ffn_up_shexp"],
    "shared_expert.down": ["ffn_down_shexp"],
    "routed_expert.gate": ["ffn_gate_exps"],
    "routed_expert.up": ["ffn_up_exps"],
    "routed_expert.down": ["ffn_down_exps"],
}
OFF_DENSE_PATH = ["routed_expert.gate", "routed_expert.up", "routed_expert.down", "ssm_param", "unknown"]


def role_rows() -> list[tuple[str, str]]:
    """Every exact suffix with its role."""
    found = [(f"{base}.{end}", role) for role, bases in SUFFIXES.items() for base in bases for end in ("weight", "bias")]
    return found + [(f"{base}.weight", role) for role, bases in WEIGHT_ONLY.items() for base in bases]


def with_sizes(tensors: DataFrame, dims: str = "dims") -> DataFrame:
    """n_elems, rows and cols of array<long> dims (outermost first); leading dimensions fold into rows."""
    d = F.col(dims)
    total = F.aggregate(d, F.lit(1).cast("long"), lambda a, x: a * x)
    cols = F.when(F.size(d) == 0, F.lit(1).cast("long")).otherwise(F.element_at(d, -1))
    return tensors.withColumns({"n_elems": total, "cols": cols, "rows": F.when(cols == 0, F.lit(0).cast("long")).otherwise(F.expr("1") * (total / cols).cast("long"))})


def is_norm(name: Column) -> Column:
    """The name without .weight or .bias ends in _norm, or its first _norm_ is followed by digits alone."""
    base = F.regexp_replace(name, r"\.(weight|bias)$", "")
    return base.rlike("_norm$") | base.rlike("^(?:(?!_norm_).)*_norm_[0-9]+$")


def with_roles(tensors: DataFrame, n_layers: Column | int, name: str = "name") -> DataFrame:
    """role, depth, expert (index of a split expert), packed_expert and quantizable for every tensor name."""
    spark = tensors.sparkSession
    table = F.broadcast(spark.createDataFrame(role_rows(), "_suffix string, _exact string"))
    n = F.col(name)
    layers = F.greatest(n_layers if isinstance(n_layers, Column) else F.lit(n_layers), F.lit(1))
    blk = F.regexp_extract(n, r"^blk\.([0-9]+)\.(.+)$", 1)
    inside = blk != ""
    suffix = F.regexp_extract(n, r"^blk\.([0-9]+)\.(.+)$", 2)
    out = tensors.withColumn("_suffix", suffix).join(table, "_suffix", "left")
    suffix, exact = F.col("_suffix"), F.col("_exact")
    expert = F.regexp_extract(suffix, r"^ffn_(gate|up|down)\.([0-9]+)\.weight$", 2)
    part = F.regexp_extract(suffix, r"^ffn_(gate|up|down)\.([0-9]+)\.weight$", 1)
    bias, norm = n.endswith(".bias"), is_norm(n)
    whole = F.regexp_extract(n, r"^(token_embd|output|output_norm)\.(weight|bias)$", 1)
    rope = n.startswith("rope_freqs")
    mtp = suffix.startswith("nextn.")
    split = expert != ""
    role = (
        F.when(whole != "", F.element_at(F.create_map(*(F.lit(x) for pair in WHOLE.items() for x in pair)), whole))
        .when(rope | ~inside, "unknown")
        .when(mtp, "mtp")
        .when(norm & exact.isNull() & ~split, "norm")
        .when(exact.isNotNull(), exact)
        .when(split, F.concat(F.lit("routed_expert."), part))
        .otherwise("unknown")
    )
    idx = F.when(inside, blk.cast("long"))
    depth = F.when(whole.isin("output", "output_norm"), F.lit(1.0)).when(inside & (whole == ""), (idx / layers).cast("float").cast("double")).otherwise(F.lit(0.0))
    able = F.when(whole == "token_embd", ~bias).when(whole == "output", ~bias).when(rope, False).when(inside & mtp, ~(suffix.contains("norm") | bias)).when(exact == "ssm_param", False).otherwise(~norm & ~bias)
    out = out.withColumns({"role": role, "depth": depth, "expert": F.when(split & inside, expert.cast("long")), "packed_expert": F.coalesce(exact.startswith("routed_expert"), F.lit(False)), "quantizable": able})
    return out.withColumn("dense_path", ~F.col("role").isin(OFF_DENSE_PATH)).drop("_suffix", "_exact")


def layout(kv: DataFrame) -> DataFrame:
    """One row (arch, n_layers, expert_count, expert_used, shared_count, is_moe) from key-value metadata (key, value).

    `{arch}.key` goes before the bare key; a model without block_count is an error.
    """
    arch = F.max(F.when(F.col("key") == "general.architecture", F.col("value")))
    keyed = kv.crossJoin(F.broadcast(kv.agg(arch.alias("arch"))))  # one row

    def pick(key: str) -> Column:
        own = F.max(F.when(F.col("key") == F.concat_ws(".", "arch", F.lit(key)), F.col("value")))
        return F.coalesce(own, F.max(F.when(F.col("key") == key, F.col("value")))).cast("long")

    out = keyed.groupBy("arch").agg(pick("block_count").alias("n_layers"), *(F.coalesce(pick(k), F.lit(0)).alias(a) for k, a in (("expert_count", "expert_count"), ("expert_used_count", "expert_used"), ("expert_shared_count", "shared_count"))))
    checked = F.when(F.col("n_layers").isNull(), F.raise_error(F.lit("block_count is missing"))).otherwise(F.col("n_layers")).cast("long")
    return out.withColumn("n_layers", checked).withColumn("is_moe", F.col("expert_count") > 0)


def with_bytes(tensors: DataFrame, type_id: str = "type_id") -> DataFrame:
    """type_name, nbytes and bpw by format; nbytes is null where the block does not divide."""
    f = fm.formats(tensors.sparkSession).select(F.col("type_id").alias("_t"), F.col("type_name").alias("_n"), F.col("block").alias("_b"), F.col("block_bytes").alias("_s"))
    out = tensors.join(f, F.col(type_id) == F.col("_t"), "left")
    return out.withColumns({"type_name": fm.type_name(F.col(type_id), F.col("_n")), "nbytes": fm.packed_bytes(F.col("n_elems"), F.col("_b"), F.col("_s")), "bpw": fm.bits_per_weight(F.col("_b"), F.col("_s"))}).drop("_t", "_n", "_b", "_s")


def role_report(tensors: DataFrame) -> DataFrame:
    """Count, bytes, parameters and bits per weight by role, with a total row (role 'TOTAL')."""
    by = tensors.rollup("role").agg(F.count(F.lit(1)).alias("tensors"), F.sum("nbytes").alias("bytes"), F.sum("n_elems").alias("params"))
    return by.select(F.coalesce("role", F.lit("TOTAL")).alias("role"), "tensors", "bytes", "params", (F.col("bytes") * 8.0 / F.col("params")).alias("bpw"), human_bytes(F.col("bytes")).alias("size"))


def type_report(tensors: DataFrame) -> DataFrame:
    return tensors.groupBy("type_name").agg(F.sum("nbytes").alias("bytes"), F.count(F.lit(1)).alias("tensors"))


def dominant_type(tensors: DataFrame) -> DataFrame:
    """The type of most bytes; the largest id on a tie."""
    by = tensors.groupBy("type_id").agg(F.sum("nbytes").alias("bytes"))
    return by.agg(F.max_by("type_id", F.struct("bytes", "type_id")).alias("type_id"), F.max("bytes").alias("bytes"))


def inspect(spark: SparkSession, tensors: DataFrame, kv: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tensor, role and layout tables of a model's catalog (name, dims, type_id) and metadata."""
    shape = layout(kv)
    sized = with_bytes(with_sizes(tensors))
    tagged = with_roles(sized.crossJoin(F.broadcast(shape.select("n_layers"))), F.col("n_layers")).drop("n_layers")
    return tagged, role_report(tagged), shape
