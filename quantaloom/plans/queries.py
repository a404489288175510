"""Queries over the supplied tables: each operator on relations derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm
from quantaloom.functions.text import candidate_id, human_bytes
from quantaloom.operators import alloc, blocks, catalog, convert, metrics, recipe, sensitivity
from quantaloom.plans import inputs
from quantaloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def fmt_packed_size(spark, d):
    t = catalog.with_bytes(inputs.tensor_catalog(spark, d))
    return t.select("pos", "name", "type_name", "n_elems", "nbytes", F.round("bpw", 6).alias("bpw"), human_bytes(F.col("nbytes")).alias("size"))


@query
def fmt_fallback(spark, d):
    ladder = F.broadcast(spark.createDataFrame([(fm.ID[n],) for n in fm.LADDERS["full"] + fm.LADDERS["blockfloat"]], "target_id int"))
    placed = fm.with_fallback(inputs.tensor_catalog(spark, d).select("pos", "n_elems", "cols").crossJoin(ladder), "target_id")
    return placed.select("pos", "target_id", "actual_id", "actual_name", "fell_back", fm.packed_bytes(F.col("n_elems"), F.col("actual_block"), F.col("actual_block_bytes")).alias("nbytes"))


@query
def role_tag(spark, d):
    return inputs.tagged(spark, d).select("pos", "name", "role", F.round("depth", 6).alias("depth"), "expert", "packed_expert", "quantizable", "dense_path")


@query
def role_report(spark, d):
    return catalog.role_report(catalog.with_bytes(inputs.tagged(spark, d))).select("role", "tensors", "bytes", "params", F.round("bpw", 6).alias("bpw"), "size")


@query
def type_report(spark, d):
    return catalog.type_report(catalog.with_bytes(inputs.tagged(spark, d)))


@query
def dominant_type(spark, d):
    return catalog.dominant_type(catalog.with_bytes(inputs.tagged(spark, d)))


@query
def layout_parse(spark, d):
    t = table(spark, d, "part").agg(F.max("p_size").alias("n")).select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("general.architecture", F.lit("loom")), ("loom.block_count", F.col("n").cast("string")), ("block_count", F.lit("3")), ("expert_count", F.lit("8")), ("loom.expert_used_count", F.lit("2")))))).alias("x"))
    return catalog.layout(t.select("x.*"))


@query
def recipe_resolve(spark, d):
    return recipe.resolve(inputs.tagged(spark, d).select("pos", "name", "role", "depth", "expert", "packed_expert", "quantizable", "dense_path"), inputs.rules()).select("pos", "name", "bits", "imatrix", "target_id", "copy_unchanged")


@query
def floor_violations(spark, d):
    t = inputs.tagged(spark, d).select("pos", "name", "role", "depth", "expert", "packed_expert", "quantizable", "dense_path")
    found = recipe.violations(recipe.resolve(t, inputs.rules()), inputs.rules())
    return found.groupBy("name", "role", "bits", "floor").agg(F.count(F.lit(1)).alias("tensors"))


def _round_trip(name: str, wide: bool) -> Callable:
    def run(spark, d):
        coded = blocks.roundtrip_blocks(inputs.blocks256(spark, d, fm.BLOCK[name][0]), name) if wide else blocks.roundtrip(inputs.weights64(spark, d), name)
        return blocks.error_report(coded, name)

    return run


ROUND_TRIPS = {"Q8_0": 64, "Q8_1": 64, "Q4_0": 64, "Q4_1": 64, "Q5_0": 64, "Q5_1": 64, "Q2_0": 64, "MXFP4": 64, "MXFP8": 64, "NVFP4": 64, "F16": 64, "BF16": 64, "FP8_E4M3": 64, "FP8_E5M2": 64, "Q1_0": 256, "TQ1_0": 256, "TQ2_0": 256, "Q8_K": 256}
for _name, _width in ROUND_TRIPS.items():
    QUERIES[f"rt_{_name.lower()}"] = _round_trip(_name, _width == 256)


@query
def rt_fp8_tile(spark, d):
    return blocks.error_report(blocks.fp8_tiles(inputs.weights64(spark, d), 16, 32), "FP8_E4M3")


@query
def imatrix_build(spark, d):
    g = inputs.imatrix(spark, d)
    r = lambda c: F.round(c, 6)
    return g.select("tensor", "ncall", F.size("g").alias("channels"), r(F.array_min("g")).alias("low"), r(F.array_max("g")).alias("high"), F.size(F.filter("g", lambda x: (x <= 0) | F.isnan(x))).alias("unusable"))


@query
def imatrix_coverage(spark, d):
    t = inputs.tagged(spark, d).where("quantizable")
    known = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("blk."), (F.col("p_partkey") % inputs.LAYERS).cast("string"), F.lit(".attn_q.weight")).alias("name")).distinct()
    hit = t.join(known, "name", "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    return hit.crossJoin(F.broadcast(t.join(known, "name", "left_anti").agg(F.count(F.lit(1)).alias("missing"))))


def _cost(spark, d, name, g=None):
    return metrics.proxy_cost(blocks.roundtrip(inputs.weights64(spark, d), name), g)


@query
def proxy_cost_abs(spark, d):
    return _cost(spark, d, "Q4_0", inputs.imatrix(spark, d)).select("tensor", F.round("energy", 6).alias("energy"), F.round("cost_abs", 6).alias("cost"))


@query
def proxy_cost_rel(spark, d):
    return _cost(spark, d, "Q4_0").select("tensor", F.round("cost_rel", 6).alias("cost"))


def _curves(spark, d, rungs=("Q2_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1", "Q8_0")):
    """One curve per embeddings tensor: bytes and rounded cost by rung."""
    out = None
    for name in rungs:
        one = _cost(spark, d, name).select(F.col("tensor").alias("name"), F.lit(name).alias("bits"), F.round(F.col("cost_abs") * 1000).cast("long").alias("c"))
        n = inputs.weights64(spark, d).groupBy(F.col("tensor").alias("name")).agg(F.sum(F.size("x")).alias("n"))
        block, size = fm.BLOCK[name]
        part = one.join(n, "name").select("name", "bits", F.expr(f"(n div {block}) * {size}").alias("bytes"), F.col("c").cast("double").alias("cost"))
        out = part if out is None else out.unionAll(part)
    return out


def _synthetic(spark, d):
    """Curves from part: a tensor per brand and size band, seven uneven rungs."""
    k = F.col("p_partkey")
    return table(spark, d, "part").groupBy(F.concat_ws(".", "p_brand", (F.col("p_size") % 5).cast("string")).alias("name"), (k % 7).alias("rung")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("s")).select("name", F.concat(F.lit("r"), F.col("rung").cast("string")).alias("bits"), (F.lit(100) * (F.col("rung") + 1) + F.col("s") % 40).cast("long").alias("bytes"), (F.lit(64) / (F.col("rung") + 1) + F.col("n") % 9).cast("long").cast("double").alias("cost"))


@query
def curve_points(spark, d):
    t = inputs.tagged(spark, d).where("quantizable").groupBy(F.concat_ws("@", "name", F.col("cols").cast("string")).alias("name"), "cols").agg(F.max("n_elems").alias("n_elems")).withColumn("floor_bits", F.lit("Q4_K"))
    return alloc.ladder_points(t, fm.LADDERS["full"]).select("name", "n_elems", "cols", "rung", "actual_id", "bytes")


@query
def curve_normalize(spark, d):
    return alloc.normalise(_synthetic(spark, d))


@query
def curve_hull(spark, d):
    return alloc.hull(alloc.normalise(_synthetic(spark, d))).select("name", "lvl", "bits", "bytes", "cost")


@query
def curve_steps(spark, d):
    return alloc.steps(alloc.hull(alloc.normalise(_synthetic(spark, d)))).select("name", "lvl", "bits", "gain", "delta", F.round("ratio", 9).alias("ratio"))


@query
def embedding_curves(spark, d):
    return alloc.normalise(_curves(spark, d))


@query
def pareto_front(spark, d):
    return alloc.pareto(alloc.normalise(_synthetic(spark, d)), 1000)


@query
def greedy_alloc(spark, d):
    curve = alloc.normalise(_synthetic(spark, d))
    return alloc.allocate(curve, 40_000, 1000)


def _captures(spark, d):
    """Reference and candidate captures: embeddings rows and their Q4_0 round trip as logits."""
    rows = inputs.weights64(spark, d)
    target = (F.col("row") % 64).cast("int")
    ref = rows.select(F.col("row").alias("pos"), F.when(F.col("row") % 10 != 3, target).alias("target"), F.transform("x", lambda v: v.cast("double") * 8.0).alias("logits"))
    coded = blocks.roundtrip(rows, "Q4_0")
    cand = coded.select(F.col("row").alias("pos"), target.alias("target"), F.transform("e", lambda y: y["v"].cast("double") * 8.0).alias("logits"))
    return ref, cand


@query
def kl_dense(spark, d):
    rows = metrics.divergence(*_captures(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("pos", r("kl"), "same_top", r("lp_ref"), r("lp_cand"))


@query
def kl_stats(spark, d):
    rows = metrics.divergence(*_captures(spark, d)).withColumn("kl", F.round("kl", 9))
    return metrics.kl_stats(rows).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p99", "max", "rms", "top1", "ppl_ref", "ppl_cand")))


@query
def topk_logits(spark, d):
    ref, _ = _captures(spark, d)
    return metrics.top_k(ref, 5).select("pos", "target", F.array_join("ids", ",").alias("ids"), F.round("lse", 6).alias("lse"))


@query
def kl_sparse(spark, d):
    ref, cand = _captures(spark, d)
    return metrics.sparse_kl(metrics.top_k(ref, 16), metrics.top_k(cand, 16), 64).select("pos", F.round("kl", 6).alias("kl"))


@query
def top1_agreement(spark, d):
    return metrics.divergence(*_captures(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.count_if("same_top").alias("same"))


@query
def perplexity(spark, d):
    rows = metrics.divergence(*_captures(spark, d)).agg(F.count("lp_ref").alias("n"), F.exp(-F.avg("lp_ref")).alias("a"), F.exp(-F.avg("lp_cand")).alias("b"))
    p = metrics.ppl_delta(F.col("a"), F.lit(0.5), F.col("b"), F.lit(0.5))
    return rows.select("n", F.round("a", 6).alias("ppl_ref"), F.round("b", 6).alias("ppl_cand"), F.round(p["delta"], 6).alias("delta"), F.round(p["percent"], 5).alias("percent"), p["within_noise"].alias("within_noise"))


@query
def sensitivity_groups(spark, d):
    g = sensitivity.groups(inputs.tagged(spark, d), "role_depth", 4)
    return g.select("key", "members", "source_bytes", F.round("depth", 6).alias("depth"), F.sha2(F.array_join("names", ","), 256).alias("names"))


@query
def candidates(spark, d):
    c = sensitivity.candidates(inputs.tagged(spark, d), fm.LADDERS["kquant"], "role", cap=500)
    return c.select("id", "key", "rung", "bytes", "members", "fell_back", F.array_join("actual", ",").alias("actual"))


def _entries(spark, d):
    """Measured curves: one per role, and one per tensor for a few."""
    t = catalog.with_bytes(inputs.tagged(spark, d)).where("quantizable")
    role = t.groupBy(F.col("role").alias("key")).agg(F.sum("nbytes").alias("source_bytes"), (F.min("pos") * 2).alias("pos")).withColumn("members", F.array().cast("array<string>"))
    some = t.where("pos % 7 = 0").groupBy(F.concat(F.lit("set."), F.col("role")).alias("key")).agg(F.sum("nbytes").alias("source_bytes"), (F.min("pos") * 2 + 1).alias("pos"), F.array_sort(F.collect_set("name")).alias("members"))
    both = role.select("pos", "key", "members", "source_bytes").unionAll(some.select("pos", "key", "members", "source_bytes"))
    points = F.array(*(F.struct(F.lit(b).alias("bits"), (F.lit(k) * (1 + F.col("pos") % 5)).alias("kl")) for b, k in (("Q4_K", 0.02), ("Q6_K", 0.004))))
    return both.withColumn("points", points)


@query
def sens_lookup(spark, d):
    t = inputs.tagged(spark, d).where("quantizable").select("name", "role").distinct()
    return sensitivity.lookup(t, _entries(spark, d)).select("name", "role", "level", "entry_key", "source_bytes")


@query
def sens_apply(spark, d):
    t = catalog.with_bytes(inputs.tagged(spark, d)).where("quantizable").groupBy("name", "role").agg(F.sum("nbytes").alias("source_bytes"))
    points = t.select("name", "role", "source_bytes", F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), (F.expr(f"source_bytes div {k}")).alias("bytes"), F.lit(c).alias("cost")) for b, k, c in (("Q3_K", 5, 0.3), ("Q4_K", 4, 0.2), ("Q6_K", 2, 0.05))))).alias("p")).select("name", "role", "source_bytes", "p.*")
    return sensitivity.apply_measured(points, _entries(spark, d)).select("name", "role", "bits", "bytes", F.round("cost", 6).alias("cost"), "matched")


def _hf(spark, d):
    k = F.col("p_partkey")
    part = F.element_at(F.array(*map(F.lit, ["self_attn.q_proj.weight", "mlp.experts.gate_up_proj", "mlp.experts.down_proj", "mlp.gate.weight", "input_layernorm.weight", "linear_attn.conv1d.weight", "mlp.shared_expert.up_proj.weight", "mlp.shared_expert_gate.weight"])), (k % 8 + 1).cast("int"))
    name = F.when(k % 29 == 0, "lm_head.weight").when(k % 31 == 0, F.concat(F.lit("model.visual.blocks."), k.cast("string"), F.lit(".proj.weight"))).otherwise(F.concat(F.lit("model.layers."), (k % 24).cast("string"), F.lit("."), part))
    rows, cols = F.col("p_size").cast("long"), F.element_at(F.array(*map(F.lit, inputs.COLS)), (k % 5 + 3).cast("int")).cast("long")
    dims = F.when(name.contains("layernorm"), F.array(cols)).when(name.contains("experts"), F.array(F.lit(4).cast("long"), rows, cols)).otherwise(F.array(rows, cols))
    return table(spark, d, "part").select(k.alias("pos"), name.alias("name"), dims.alias("dims"), F.when(k % 37 == 0, F.lit(8)).otherwise(F.lit(30)).alias("type_id"))


@query
def pack_plan(spark, d):
    p = convert.pack_plan(_hf(spark, d))
    return p.select("pos", "name", "pack_role", "pack_class", "rows", "cols", "actual_name", "fell_back", "packed_bytes", "warning")


@query
def pack_report(spark, d):
    return convert.pack_report(convert.pack_plan(_hf(spark, d)))


@query
def pack_totals(spark, d):
    return convert.pack_totals(convert.pack_plan(_hf(spark, d)))


@query
def pack_fallbacks(spark, d):
    return convert.pack_fallbacks(convert.pack_plan(_hf(spark, d)))


@query
def shard_plan(spark, d):
    t = catalog.with_bytes(inputs.tensor_catalog(spark, d)).select("pos", "name", F.col("nbytes").alias("bytes"))
    return convert.shard_plan(t, 2_000_000).groupBy("shard").agg(F.count(F.lit(1)).alias("tensors"), F.sum("bytes").alias("bytes"), F.min("pos").alias("first"))


@query
def aligned_offsets(spark, d):
    return convert.offsets(catalog.with_bytes(inputs.tensor_catalog(spark, d)).select("pos", "name", F.col("nbytes").alias("bytes")))


@query
def moe_split(spark, d):
    rows = inputs.weights64(spark, d)
    down = convert.split_experts(rows, 4, 16, True, 0.5)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return down.groupBy("tensor", "expert").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(total), 6).alias("energy"))


@query
def moe_audit(spark, d):
    source = _hf(spark, d).select("name", "dims", "type_id", "pos").groupBy("name").agg(F.min("dims").alias("dims"), F.min("type_id").alias("type_id"), F.min("pos").alias("pos"))
    output = source.where("pos % 11 <> 0").withColumn("type_id", F.when(F.col("pos") % 13 == 0, F.lit(0)).otherwise(F.col("type_id"))).unionAll(source.where("pos % 17 = 0"))
    replaced = source.where("pos % 5 = 0").select("name")
    return convert.audit(source, output, replaced)


@query
def attention_layout(spark, d):
    declared = ["full_attention" if i % 4 == 3 else "linear_attention" for i in range(24)]
    return convert.attention_layout(_hf(spark, d).select("name"), 24, declared)


@query
def candidate_names(spark, d):
    return table(spark, d, "part").select("p_partkey", candidate_id(F.concat_ws("/", "p_name", "p_type")).alias("id"))


@query
def event_blocks(spark, d):
    """Values of events, by type and in order of id, as rows of 64, through Q8_0; the ragged tail is left out."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("bin", F.expr("event_id div 4096"))
    # places by counts of bins of ids, so that no task ranks a whole type
    bins = e.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = bins.select("event_type", "bin", F.coalesce(F.sum("n").over(Window.partitionBy("event_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    e = e.join(before, ["event_type", "bin"])
    i = F.col("before") + F.row_number().over(Window.partitionBy("event_type", "bin").orderBy("event_id")) - 1
    rows = e.select(F.col("event_type").alias("tensor"), i.alias("i"), F.col("value").cast("float").alias("v")).withColumn("row", F.expr("cast(i div 64 as bigint)"))
    packed = rows.groupBy("tensor", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("x")).where(F.size("x") == 64)
    return blocks.error_report(blocks.roundtrip(packed, "Q8_0"), "Q8_0").select("tensor", "n", "bytes", "code_sum", "code_abs")
