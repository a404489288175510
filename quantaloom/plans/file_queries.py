"""Queries through the file formats: derived relations are written, read again and summed up.

The files go to the shared checkpoint folder. Each report has the same figures as the relation it was written from.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm
from quantaloom.operators import packing
from quantaloom.plans import api, inputs
from quantaloom.plans.queries import _entries, query
from quantaloom.runtime import checkpoint_dir
from quantaloom.sources import calibration, gguf, safetensors
from quantaloom.sources.files import resolve

KERNELS = ["Q2_K", "Q3_K", "Q4_K", "Q5_K", "Q6_K", "Q8_K", "IQ4_NL", "IQ4_XS"]
BLOCKS = ["F32", "F16", "BF16", "Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1"]


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    folder = folder.replace("file:///", "/").replace("file:/", "/")
    system, inner = resolve(folder)
    system.create_dir(inner, recursive=True)
    return f"{folder}/{name}"


def _ranked(rows: DataFrame) -> DataFrame:
    """tensor, row, x with rows numbered from 0 within their tensor."""
    from pyspark.sql import Window

    return rows.withColumn("row", (F.row_number().over(Window.partitionBy("tensor").orderBy("row")) - 1).cast("long"))


def _container(spark: SparkSession, d: str, formats: list[str], layers: bool = False) -> tuple[str, list[gguf.Tensor]]:
    """A GGUF file of the embeddings, its tensors in the given formats by turns; named as layers' matrices if wanted."""
    rows = _ranked(inputs.weights64(spark, d))
    if layers:
        rows = rows.withColumn("tensor", F.concat(F.lit("blk."), F.substring("tensor", 5, 9), F.lit(".ffn_up.weight")))
    sizes = rows.groupBy("tensor").agg(F.count(F.lit(1)).alias("n")).orderBy("tensor").collect()  # a catalog
    chosen = {r["tensor"]: formats[i % len(formats)] for i, r in enumerate(sizes)}
    tensors = [gguf.Tensor(r["tensor"], [r["n"], 64], fm.ID[chosen[r["tensor"]]]) for r in sizes]
    goals = spark.createDataFrame(list(chosen.items()), "tensor string, fmt string")
    packed = packing.pack(rows.join(F.broadcast(goals), "tensor")).select(F.col("tensor").alias("name"), "row", "raw")
    path = _place(spark, "model.gguf")
    kv = [("general.architecture", "String", "loom"), ("loom.block_count", "U32", len(sizes)), ("loom.big", "U64", 2**63 + 1), ("loom.names", "Array<String>", [r["tensor"] for r in sizes])]
    gguf.save(packed, tensors, kv, path)
    return path, tensors


def _summed(values: DataFrame) -> DataFrame:
    v = lambda x: x.cast("double")
    energy = F.aggregate("x", F.lit(0.0), lambda a, x: a + v(x) * v(x))
    return values.groupBy(F.col("name").alias("tensor")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(energy), 5).alias("energy"))


@query
def gguf_tensors(spark, d):
    path, _ = _container(spark, d, BLOCKS)
    return gguf.read(spark, path).select("pos", "name", F.element_at("dims", 1).alias("rows"), F.element_at("dims", 2).alias("cols"), "type_name", "nbytes", (F.col("offset") % 32).alias("misaligned"))


@query
def gguf_kv(spark, d):
    path, _ = _container(spark, d, BLOCKS)
    return gguf.read(spark, path, "kv").select("pos", "key", "vtype", "value")


def _values(spark, d, fmt):
    path, _ = _container(spark, d, [fmt])
    return _summed(gguf.read(spark, path, "values"))


def _through(fmt: str):
    def run(spark, d):
        return _values(spark, d, fmt)

    run.__name__ = f"gguf_{fmt.lower()}"
    return run


for _fmt in BLOCKS:
    query(_through(_fmt))


def _kernel(fmt: str):
    """Round trip of a searched format: no SQL restates the search, so only its error is reported.

    A short row, as the last one may be, is packed with zeros up to whole blocks; its own values count.
    """

    def run(spark, d):
        rows = inputs.weights256(spark, d).withColumn("fmt", F.lit(fmt))
        whole = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size("x"), F.lit(256)))))
        block, size = fm.BLOCK[fmt]
        coded = packing.pack(whole).withColumns({"fmt": F.lit(fmt), "cols": F.expr(f"octet_length(raw) div {size} * {block}")})
        back = packing.unpack(coded).withColumnRenamed("x", "y")
        both = rows.join(back, ["tensor", "row"]).withColumn("p", F.arrays_zip("x", F.slice("y", 1, F.size("x")).alias("y")))
        square = lambda f: F.aggregate("p", F.lit(0.0), lambda a, p: a + f(p["x"].cast("double"), p["y"].cast("double")))
        return both.groupBy("tensor").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(square(lambda x, y: (x - y) * (x - y))) / F.sum(square(lambda x, y: x * x)), 4).alias("error"))

    run.__name__ = f"kernel_{fmt.lower()}"
    return run


for _fmt in KERNELS:
    query(_kernel(_fmt))


def _folder(spark: SparkSession, d: str) -> str:
    """Shards of the embeddings: one F32 tensor per label."""
    rows = _ranked(inputs.weights64(spark, d)).orderBy("tensor", "row").select("tensor", "x").collect()  # a fixture of some MB
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["tensor"], []).append(r["x"])
    folder = _place(spark, "shards")
    tensors = [(name, "F32", [len(x), 64], lambda x=x: np.array(x, "<f4").tobytes()) for name, x in by.items()]
    safetensors.write(folder, tensors, 300_000, {"format": "pt"})
    return folder


@query
def safetensors_values(spark, d):
    return _summed(safetensors.read(spark, _folder(spark, d), "values"))


@query
def safetensors_tensors(spark, d):
    out = safetensors.read(spark, _folder(spark, d))
    shard = F.regexp_extract("path", "model-([0-9]+)-of", 1).cast("int")
    return out.select("name", "dtype", F.element_at("dims", 1).alias("rows"), F.element_at("dims", 2).alias("cols"), "nbytes", shard.alias("shard"))


def _calibrated(spark: SparkSession, d: str) -> str:
    path = _place(spark, "imatrix.dat")
    rows = inputs.imatrix(spark, d).orderBy("tensor").collect()  # one row per tensor
    calibration.write_imatrix(path, [(r["tensor"], r["ncall"], r["g"]) for r in rows])
    return path


@query
def imatrix_file(spark, d):
    out = calibration.read_imatrix(spark, _calibrated(spark, d))
    return out.select("tensor", F.col("ncall").cast("long").alias("ncall"), F.size("g").cast("long").alias("n"), F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"))


@query
def logits_file(spark, d):
    capture = inputs.weights64(spark, d).where("row < 200").select(F.col("row").cast("int").alias("pos"), F.when(F.col("row") % 10 != 3, F.col("row") % 64).cast("int").alias("target"), F.col("x").alias("logits"))
    path = _place(spark, "capture.rqlg")
    calibration.write_logits(path, capture, 64)
    back = calibration.read_logits(spark, path)
    return back.select(F.col("pos").cast("long").alias("pos"), F.col("target").cast("long").alias("target"), F.round(F.aggregate("logits", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query
def sensitivity_file(spark, d):
    path = _place(spark, "sensitivity.json")
    entries = _entries(spark, d)
    calibration.write_sensitivity(path, entries.select(F.col("pos").cast("int").alias("pos"), "key", "members", "source_bytes", F.expr("transform(points, (p, i) -> named_struct('bits', p.bits, 'bytes', source_bytes div (i + 2), 'kl', cast(p.kl as double)))").alias("points")))
    back = calibration.read_sensitivity(spark, path)
    return back.select("key", F.size("members").cast("long").alias("members"), "source_bytes", F.element_at("points", 1)["bits"].alias("bits"), F.element_at("points", 1)["bytes"].alias("bytes"), F.round(F.element_at("points", 2)["kl"], 6).alias("kl"))


@query
def quantize_plan(spark, d):
    path, _ = _container(spark, d, ["F32"], layers=True)
    return api.quantize(spark, path, _place(spark, "out.gguf")).select("name", "action", "out_name")


@query
def quantize_values(spark, d):
    path, _ = _container(spark, d, ["F32"], layers=True)
    target = _place(spark, "out.gguf")
    api.quantize(spark, path, target, {"defaults": {"bits": "Q8_0"}, "rule": []})
    return _summed(gguf.read(spark, target, "values"))
