"""The entry points: inspect, quantize, search, sensitivity, calibration, evaluation, conversion, packing."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm
from quantaloom.operators import alloc, catalog, convert, metrics, packing, recipe, sensitivity
from quantaloom.sources import calibration, gguf


def inspect(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tensor, role and layout tables of a GGUF file or folder."""
    tensors = gguf.read(spark, path).select("name", "dims", "type_id")
    kv = gguf.read(spark, path, "kv").select("key", "value")
    return catalog.inspect(spark, tensors, kv)


def plan(tagged: DataFrame, rules: dict) -> DataFrame:
    """What quantizing does with each tensor: action and actual format.

    copy: not quantizable, or already there; convert: to a float type; quantize from a float source;
    recode from another. A format that stands in no GGUF file is an error, as is a floor violation.
    """
    policies = recipe.enforce(recipe.resolve(tagged, rules), rules)
    placed = fm.with_fallback(policies, "target_id")
    legal = F.when(placed["quantizable"] & (F.col("actual_id") >= fm.INTERNAL), F.raise_error(F.concat(F.col("name"), F.lit(": the format stands in no GGUF file"))).cast("int")).otherwise(F.col("actual_id"))
    source_float, goal_float = F.col("type_id").isin(*(fm.ID[n] for n in fm.FLOATS)), F.col("actual_name").isin(*fm.FLOATS)
    action = F.when(~F.col("quantizable") | (legal == F.col("type_id")), "copy").when(goal_float, "convert").when(source_float, "quantize").otherwise("recode")
    out = placed.withColumns({"action": action, "warning": F.col("type_id").isin(*(fm.ID[n] for n in fm.FP4))})
    return out.withColumns({"out_id": F.when(F.col("action") == "copy", F.col("type_id")).otherwise(F.col("actual_id")), "out_name": F.when(F.col("action") == "copy", F.lit(None)).otherwise(F.col("actual_name"))})


def quantize(spark: SparkSession, source: str, target: str, rules: dict | None = None, imatrix: DataFrame | None = None, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Rewrite a GGUF file under a recipe; returns the plan. Rows spread over the cluster, the file is streamed."""
    rules = rules or recipe.DEFAULT
    header = gguf.read_header(source)
    rows = [(i, t.name, t.dims, t.type_id) for i, t in enumerate(header.tensors)]
    listed = spark.createDataFrame(rows, "pos int, name string, dims array<long>, type_id int")
    layers = next((v for k, _, v in header.kv if k.endswith("block_count")), 1)
    done = plan(catalog.with_roles(catalog.with_sizes(listed), int(layers)), rules)
    if dry_run:
        return done
    chosen = {r["name"]: r for r in done.collect()}  # a catalog: one row per tensor
    moved = [t.name for t in header.tensors if chosen[t.name]["action"] != "copy"]
    copies = gguf.read(spark, source, "rows", [t.name for t in header.tensors if t.name not in moved]).select("name", "row", "raw") if len(moved) < len(header.tensors) else None
    packed = None
    if moved:
        goals = done.where("action <> 'copy'").select(F.col("name").alias("tensor"), F.col("out_name").alias("fmt"), F.col("imatrix").alias("use"))
        x = gguf.read(spark, source, "values", moved).select(F.col("name").alias("tensor"), "row", "x").join(goals, "tensor")
        if imatrix is not None:
            x = x.join(imatrix.select("tensor", F.col("g").alias("g_")), "tensor", "left").withColumn("g", F.when(F.col("use"), F.col("g_")))
        packed = packing.pack(x).select(F.col("tensor").alias("name"), "row", "raw")
    every = packed if copies is None else copies if packed is None else copies.unionByName(packed)
    tensors = [gguf.Tensor(t.name, t.dims, chosen[t.name]["out_id"]) for t in header.tensors]
    default = fm.ID[fm.canonical(rules.get("defaults", {}).get("bits", "Q4_K"))]
    gguf.save(every, tensors, gguf.passthrough(header.kv, default), target, overwrite=overwrite)
    return done


def curves(spark: SparkSession, source: str, rungs: list[str], rules: dict | None = None, imatrix: DataFrame | None = None, relative: bool = False) -> tuple[DataFrame, int]:
    """Normalised cost curves of a file's searchable tensors, and the bytes of the others."""
    rules = rules or recipe.DEFAULT
    tagged, _, _ = inspect(spark, source)
    base = recipe.resolve(tagged, rules).withColumn("searchable", F.col("quantizable") & ~F.col("bits").isin(*fm.FLOATS) & (F.col("cols") > 0))
    fixed = base.where(~F.col("searchable")).agg(F.sum("nbytes").alias("n")).first()["n"] or 0
    names = [r["name"] for r in base.where("searchable").select("name").collect()]
    x = gguf.read(spark, source, "values", names).select(F.col("name").alias("tensor"), "row", "x")
    if imatrix is not None:
        x = x.join(imatrix.select("tensor", "g"), "tensor", "left")
    steps = alloc.ladder_points(base.where("searchable").select("name", "cols", "n_elems", F.col("bits").alias("floor_bits")), rungs).select("name", F.col("actual_name").alias("bits"), "bytes")
    found = packing.costs(x, sorted({*rungs, *fm.PRIMARY.values(), "F16"})).select(F.col("tensor").alias("name"), F.col("fmt").alias("bits"), F.col("cost_rel" if relative else "err").alias("cost"))
    return alloc.normalise(steps.join(found, ["name", "bits"]).where("bytes is not null")), int(fixed)


def search(spark: SparkSession, source: str, budget: int, rungs: str | list[str] = "kquant", rules: dict | None = None, imatrix: DataFrame | None = None, measured: DataFrame | None = None, fill: bool = True) -> tuple[DataFrame, str]:
    """The best choice under a budget for the whole file, and its recipe."""
    points, fixed = curves(spark, source, fm.ladder(rungs), rules, imatrix)
    if measured is not None:
        tagged, _, _ = inspect(spark, source)
        own = points.join(tagged.select("name", "role", F.col("nbytes").alias("source_bytes")), "name")
        points = alloc.normalise(sensitivity.apply_measured(own.select("name", "role", "source_bytes", "bits", "bytes", "cost"), measured).select("name", "bits", "bytes", "cost"))
    chosen = alloc.allocate(points, budget, fixed, fill)
    return chosen, alloc.emit_recipe(chosen)


def pareto(spark: SparkSession, source: str, rungs: str | list[str] = "kquant", rules: dict | None = None) -> DataFrame:
    points, fixed = curves(spark, source, fm.ladder(rungs), rules)
    return alloc.pareto(points, fixed)


class Evaluator(Protocol):
    """Scores a candidate against a reference."""

    name: str

    def prepare(self, spark: SparkSession) -> None: ...

    def score(self, spark: SparkSession, candidate: str) -> DataFrame: ...


class DumpEvaluator:
    """Scores captures that another program wrote, one file per candidate id, in two explicit phases."""

    name = "dump"

    def __init__(self, folder: str, reference: str = "reference.rqlg") -> None:
        self.folder, self.reference = folder.rstrip("/"), reference
        self._ref: DataFrame | None = None

    def prepare(self, spark: SparkSession) -> None:
        self._ref = calibration.read_logits(spark, f"{self.folder}/{self.reference}")

    def score(self, spark: SparkSession, candidate: str) -> DataFrame:
        if self._ref is None:
            self.prepare(spark)
        return kl_stats(self._ref, calibration.read_logits(spark, f"{self.folder}/{candidate}.rqlg"))


def score_all(spark: SparkSession, evaluator: Evaluator, candidates: DataFrame) -> DataFrame:
    """Points (key, bits, bytes, kl) of all candidates in one plan."""
    out = None
    for r in candidates.select("id", "key", "rung_name", "bytes").collect():  # capped by the enumeration
        one = evaluator.score(spark, r["id"]).select(F.lit(r["key"]).alias("key"), F.lit(r["rung_name"]).alias("bits"), F.lit(r["bytes"]).alias("bytes"), F.col("mean").alias("kl"))
        out = one if out is None else out.unionAll(one)
    return sensitivity.collect_scores(out)


def kl_stats(ref: DataFrame, cand: DataFrame) -> DataFrame:
    return metrics.kl_stats(metrics.divergence(ref, cand))


def ppl_compare(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """ref, cand with delta, percent, sigma and whether the change is within noise."""
    both = ref.select(F.col("ppl").alias("ref"), F.coalesce("err", F.lit(0.0)).alias("re")).crossJoin(cand.select(F.col("ppl").alias("cand"), F.coalesce("err", F.lit(0.0)).alias("ce")))  # one row each
    return both.select("ref", "cand", metrics.ppl_delta(F.col("ref"), F.col("re"), F.col("cand"), F.col("ce")).alias("d")).select("ref", "cand", "d.*")


def imatrix_coverage(tensors: DataFrame, imatrix: DataFrame) -> DataFrame:
    """Quantizable tensors with and without a calibration vector."""
    known = imatrix.select(F.col("tensor").alias("name"), F.lit(1).alias("hit"))
    return tensors.where("quantizable").join(known, "name", "left").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("missing"))


def pack(spark: SparkSession, tensors: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inference packing of (tensor, row, x): plan, packed rows and manifest."""
    planned = convert.pack_plan(tensors)
    goals = planned.where("pack_class <> 'passthrough'").select(F.col("name").alias("tensor"), F.col("actual_name").alias("fmt"))
    return planned, packing.pack(rows.join(goals, "tensor")), convert.manifest(planned)
