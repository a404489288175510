"""Rows of weights through the block kernels, as Arrow batches: pack, unpack, round trip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import codebooks, kernels
from quantaloom.runtime import ship


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Places of equal keys in a batch."""
    listed = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(listed):
        places.setdefault(key, []).append(i)
    for key, at in places.items():
        yield key, np.array(at)


def _matrix(column: pa.Array, at: np.ndarray) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def pack(rows: DataFrame) -> DataFrame:
    """tensor, row, raw from (tensor, row, x, fmt) and, if there, g: the importances of the tensor's columns.

    A row is one unit of work, so a tensor of any size spreads over all tasks; rows of one tensor and
    format in a batch go through the kernel together.
    """
    ship(rows.sparkSession)
    has_g = "g" in rows.columns
    frame = rows.select("tensor", "row", F.col("x").cast("array<float>").alias("x"), "fmt", *([F.col("g").cast("array<float>").alias("g")] if has_g else []))

    grids = codebooks.given()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks.take(grids)
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            sized = batch.append_column("width", batch.column("x").value_lengths())
            for (_, fmt, _), at in _groups(sized, ["tensor", "fmt", "width"]):
                g = batch.column("g")[int(at[0])].as_py() if has_g else None
                packed = kernels.quantize(fmt, _matrix(batch.column("x"), at), None if g is None else np.array(g, np.float32))
                for i, raw in zip(at.tolist(), packed, strict=True):
                    out[i] = raw.tobytes()
            yield pa.record_batch([batch.column("tensor"), batch.column("row"), pa.array(out, pa.binary())], ["tensor", "row", "raw"])

    return frame.mapInArrow(run, "tensor string, row long, raw binary")


def unpack(rows: DataFrame) -> DataFrame:
    """tensor, row, x from (tensor, row, raw, fmt, cols)."""
    ship(rows.sparkSession)

    grids = codebooks.given()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks.take(grids)
        for batch in batches:
            out: list = [None] * batch.num_rows
            for (fmt, cols), at in _groups(batch, ["fmt", "cols"]):
                raw = np.frombuffer(b"".join(batch.column("raw")[int(i)].as_py() for i in at), np.uint8).reshape(len(at), -1)
                for i, x in zip(at.tolist(), kernels.dequantize(fmt, raw, cols), strict=True):
                    out[i] = x
            yield pa.record_batch([batch.column("tensor"), batch.column("row"), pa.array(out, pa.list_(pa.float32()))], ["tensor", "row", "x"])

    return rows.select("tensor", "row", "raw", "fmt", F.col("cols").cast("int").alias("cols")).mapInArrow(run, "tensor string, row long, x array<float>")


def costs(rows: DataFrame, rungs: list[str]) -> DataFrame:
    """tensor, fmt, bytes, energy, err of round trips of rows (tensor, row, x[, g]) under every rung that fits them.

    Rungs that need importances are left out where there are none, and codebook rungs where no grid is given.
    """
    ship(rows.sparkSession)
    has_g = "g" in rows.columns
    frame = rows.select("tensor", F.col("x").cast("array<float>").alias("x"), *([F.col("g").cast("array<float>").alias("g")] if has_g else []))

    grids = codebooks.given()
    rungs = [fmt for fmt in rungs if fmt not in codebooks.SHAPES or fmt in grids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quantaloom.functions.formats import BLOCK

        codebooks.take(grids)
        for batch in batches:
            out = []
            widths = pa.array([len(v) for v in batch.column("x")], pa.int32())
            sized = pa.record_batch([*batch.columns, widths], [*batch.schema.names, "width"])
            for (tensor, width), at in _groups(sized, ["tensor", "width"]):
                x = _matrix(batch.column("x"), at)
                listed = batch.column("g")[int(at[0])].as_py() if has_g else None
                g = None if listed is None else np.array(listed, np.float32)
                w = np.ones(width) if g is None else np.maximum(g, 1e-12).astype(np.float64)
                energy = float((w * x.astype(np.float64) ** 2).sum())
                for fmt in rungs:
                    block, size = BLOCK[fmt]
                    if width == 0 or width % block or (g is None and fmt in kernels.NEEDS_IMPORTANCE):
                        continue
                    d = x.astype(np.float64) - kernels.roundtrip(fmt, x, g)
                    out.append((tensor, fmt, len(at) * width // block * size, energy, float((w * d * d).sum())))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["tensor", "fmt", "bytes", "energy", "err"])

    parts = frame.mapInArrow(run, "tensor string, fmt string, bytes long, energy double, err double")
    sums = parts.groupBy("tensor", "fmt").agg(*(F.sum(c).alias(c) for c in ("bytes", "energy", "err")))
    return sums.withColumn("cost_rel", F.sqrt(F.col("err") / F.greatest("energy", F.lit(1e-12))))
