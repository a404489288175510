"""Model-like relations derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.operators import catalog
from quantaloom.runtime import table

LAYERS = 24
#: Tensor names by part key: every branch of the role rules.
PARTS = [
    "attn_q.weight", "attn_k.weight", "attn_v.weight", "attn_output.weight", "attn_qkv.weight", "attn_q_a.weight", "attn_kv_b.weight", "attn_q.bias", "attn_norm.weight", "attn_norm_2.weight",
    "ffn_gate.weight", "ffn_up.weight", "ffn_down.weight", "ffn_norm.weight", "ffn_gate_inp.weight", "ffn_gate_shexp.weight", "ffn_up_exps.weight", "ffn_down_exps.weight", "ffn_gate.3.weight", "ffn_down.11.weight",
    "ssm_a.weight", "ssm_in.weight", "ssm_zeta.weight", "nextn.enorm.weight", "nextn.eh_proj.weight", "ffn_down.bias", "odd_norm_x.weight",
]
WHOLES = ["token_embd.weight", "output.weight", "output_norm.weight", "rope_freqs.weight", "mystery.weight"]
COLS = [64, 96, 256, 288, 544, 896, 5120]
SOURCES = [0, 1, 30]


def tensor_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, name, rows, cols, n_elems, type_id from `part`."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    blk = F.concat(F.lit("blk."), (k % LAYERS).cast("string"), F.lit("."), pick(PARTS))
    name = F.when(k % 41 == 0, pick(WHOLES)).otherwise(blk)
    out = table(spark, sf_dir, "part").select(k.alias("pos"), name.alias("name"), F.col("p_size").cast("long").alias("rows"), pick(COLS).cast("long").alias("cols"), pick(SOURCES).alias("type_id"))
    return out.withColumn("n_elems", F.col("rows") * F.col("cols"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_roles(tensor_catalog(spark, sf_dir), LAYERS)


def weights64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor, row, x from `embeddings`: one tensor per label."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("emb."), F.col("label").cast("string")).alias("tensor"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<float>").alias("x"))


def _fours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor, row, p: the vectors of a row and their places in it."""
    part = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("row"), F.struct((F.col("vec_id") % 4).alias("i"), F.col("embedding").cast("array<float>").alias("x")).alias("p"))
    rows = part.groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select(F.concat(F.lit("emb."), (F.col("row") % 10).cast("string")).alias("tensor"), "row", "p")


def weights256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors side by side as one row, or as many of the four as there are."""
    return _fours(spark, sf_dir).select("tensor", "row", F.flatten(F.transform("p", lambda p: p["x"])).alias("x"))


def blocks256(spark: SparkSession, sf_dir: str, block: int) -> DataFrame:
    """The same rows as arrays of blocks, each vector in the block of its place: where vectors are missing a block is short or left out."""
    own = lambda b: F.flatten(F.transform(F.filter("p", lambda p: F.floor(p["i"] * 64 / block) == b), lambda p: p["x"]))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(256 // block - 1)), own)
    return _fours(spark, sf_dir).select("tensor", "row", F.filter(blocks, lambda b: F.size(b) > 0).alias("blocks"))


def imatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor, ncall, g: sums of squares by input channel."""
    rows = weights64(spark, sf_dir).select("tensor", F.posexplode("x").alias("col", "v"))
    by = rows.groupBy("tensor", "col").agg(F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("g"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("tensor").agg(F.max("n").alias("ncall"), F.transform(F.array_sort(F.collect_list(F.struct("col", "g"))), lambda p: p["g"]).alias("g"))


def rules() -> dict:
    from quantaloom.operators.recipe import DEFAULT

    extra = [
        {"role": ["routed_expert"], "expert": "2..=9", "bits": "IQ3_S", "imatrix": False},
        {"role": ["attn_mla.*"], "layer": "0.25..0.5", "bits": "Q6_K"},
        {"role": ["ffn_gate"], "layer": "< 0.25", "bits": "Q3_K"},
        {"name": ["blk.3.attn_q.weight", "blk.5.ffn_up.weight"], "bits": "FP8"},
    ]
    return {"defaults": DEFAULT["defaults"], "rule": DEFAULT["rule"] + extra, "floors": {"router": "F16", "dense_path": "Q5_K"}}
