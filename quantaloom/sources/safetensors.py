"""safetensors containers, single or sharded: catalog, rows, block-scaled layers, and a sharded writer."""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantaloom.functions import kernels
from quantaloom.sources.files import BATCH, binary_rows, listed, listed_rows, opened, refuse_existing, resolve, size

INDEX = "model.safetensors.index.json"
SPLIT = 64 << 20
# Fixed element types and sizes.
SIZES = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E5M2": 1, "F8_E4M3": 1, "F8_E8M0": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "F64": 8, "I64": 8, "U64": 8}


@dataclass
class Entry:
    name: str
    dtype: str
    shape: list[int]
    start: int
    end: int
    path: str = ""

    @property
    def cols(self) -> int:
        return math.prod(self.shape[1:]) if len(self.shape) > 1 else (self.shape[0] if self.shape else 1)

    @property
    def rows(self) -> int:
        return self.shape[0] if len(self.shape) > 1 else 1


def read_header(path: str) -> tuple[list[Entry], dict, int]:
    """Entries in name order, metadata, and where data starts."""
    total = size(path)
    with opened(path) as f:
        raw = f.read(8)
        if len(raw) != 8 or (n := struct.unpack("<Q", raw)[0]) > total - 8:
            raise ValueError(f"{path}: header out of bounds")
        header = json.loads(f.read(n))
    meta = header.pop("__metadata__", {})
    entries = []
    for name, e in sorted(header.items()):
        start, end = e["data_offsets"]
        if e["dtype"] not in SIZES or not 0 <= start <= end <= total - 8 - n or end - start != math.prod(e["shape"]) * SIZES[e["dtype"]]:
            raise ValueError(f"{path}: {name} has offsets {start}..{end} that do not fit")
        entries.append(Entry(name, e["dtype"], e["shape"], start, end, path))
    return entries, meta, 8 + n


def shards(path: str) -> list[str]:
    """The shard files of a folder: those its index names, else all, sorted; or the file itself."""
    if path.endswith(".safetensors"):
        return [path]
    index = f"{path.rstrip('/')}/{INDEX}"
    system, inner = resolve(index)
    if system.get_file_info(inner).is_file:
        with opened(index) as f:
            return [f"{path.rstrip('/')}/{s}" for s in sorted(set(json.loads(f.read())["weight_map"].values()))]
    return listed(path, ".safetensors")


def catalog(path: str) -> list[Entry]:
    """All entries of all shards; of a repeated name the later shard's stands."""
    found = {e.name: e for shard in shards(path) for e in read_header(shard)[0]}
    return sorted(found.values(), key=lambda e: e.name)


def widen(raw: bytes, dtype: str) -> np.ndarray:
    """Float types as single precision; the eight-bit ones with scale 1."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)
    if dtype in ("F8_E4M3", "F8_E5M2"):
        return kernels.decode_mini(np.frombuffer(raw, np.uint8), kernels.E4M3 if dtype == "F8_E4M3" else kernels.E5M2)
    if dtype in ("F16", "F32", "F64"):
        return np.frombuffer(raw, {"F16": "<f2", "F32": "<f4", "F64": "<f8"}[dtype]).astype(np.float32)
    raise ValueError(f"{dtype} is no float type")


def payload(entry: Entry) -> bytes:
    with opened(entry.path) as f:
        f.seek(read_header(entry.path)[2] + entry.start)
        return f.read(entry.end - entry.start)


SCHEMAS = {"tensors": "name string, dtype string, dims array<long>, nbytes long, path string", "rows": "name string, row long, raw binary", "values": "name string, row long, x array<float>"}


@dataclass
class Part(InputPartition):
    entry: Entry | None
    start: int = 0
    stop: int = 0


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table, self.names = options["path"], options.get("table", "tensors"), options.get("names")

    def partitions(self) -> list[Part]:
        if self.table == "tensors":
            return [Part(None)]
        wanted = set(self.names.split(",")) if self.names else None
        out = []
        for e in catalog(self.path):
            if wanted is None or e.name in wanted:
                step = max(1, SPLIT // max(e.cols * SIZES[e.dtype], 1))
                out += [Part(e, r, min(r + step, e.rows)) for r in range(0, e.rows, step)]
        return out

    def read(self, part: Part) -> Iterator[tuple | pa.RecordBatch]:
        if part.entry is None:
            for e in catalog(self.path):
                yield e.name, e.dtype, e.shape, e.end - e.start, e.path
            return
        e = part.entry
        width = e.cols * SIZES[e.dtype]
        with opened(e.path) as f:
            f.seek(read_header(e.path)[2] + e.start + part.start * width)
            step = max(1, BATCH // max(width, 1))
            for row in range(part.start, part.stop, step):
                n = min(step, part.stop - row)
                raw = f.read(n * width)
                if len(raw) != n * width:
                    raise ValueError(f"{e.name}: truncated")
                names, rows = pa.array([e.name] * n), pa.array(range(row, row + n), pa.int64())
                if self.table == "rows":
                    yield pa.record_batch([names, rows, binary_rows(raw, n)], ["name", "row", "raw"])
                else:
                    yield pa.record_batch([names, rows, listed_rows(widen(raw, e.dtype).reshape(n, -1))], ["name", "row", "x"])


class SafetensorsDataSource(DataSource):
    """spark.read.format("safetensors").option("table", "tensors" | "rows" | "values").load(file or folder)"""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "tensors")]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, table: str = "tensors", names: list[str] | None = None) -> DataFrame:
    from quantaloom.runtime import ship

    ship(spark)
    spark.dataSource.register(SafetensorsDataSource)
    reader = spark.read.format("safetensors").option("table", table)
    return (reader.option("names", ",".join(names)) if names else reader).load(path)


def scaled_layers(tensors: DataFrame) -> DataFrame:
    """Layers with scales beside them: prefix, weight, its dims, and the scale each has (name, dims, granularity).

    weight_scale_inv goes before weight_scale; none is scale 1. Granularity: unit, tensor, row or tile.
    """
    stem = lambda end: F.regexp_extract("name", rf"^(.*)\.{end}$", 1)
    w = tensors.where(F.col("name").endswith(".weight")).select(stem("weight").alias("prefix"), F.col("name").alias("weight"), "dtype", "dims")
    s = lambda end: tensors.where(F.col("name").endswith(f".{end}")).select(stem(end).alias("prefix"), F.col("name").alias(end), F.col("dims").alias(f"{end}_dims"))
    j = w
    for end in ("weight_scale_inv", "weight_scale", "weight_scale_2"):
        j = j.join(s(end), "prefix", "left")
    dims = F.coalesce("weight_scale_inv_dims", "weight_scale_dims")
    n = F.aggregate(dims, F.lit(1).cast("long"), lambda a, d: a * d)
    rows = F.element_at("dims", 1)
    kind = F.when(dims.isNull(), "unit").when(n == 1, "tensor").when((F.size(dims) == 2) & (F.element_at(dims, 1) != rows), "tile").when(n == rows, "row").otherwise("tile")
    return j.select("prefix", "weight", "dtype", "dims", F.coalesce("weight_scale_inv", "weight_scale").alias("scale"), dims.alias("scale_dims"), kind.alias("granularity"), F.col("weight_scale_2").alias("global_scale"))


def load_nvfp4(path: str, prefix: str) -> np.ndarray:
    """A layer of packed FP4 weights [out, in/2] with E4M3 scales and an optional global scale."""
    by = {e.name: e for e in catalog(path)}
    w = by.get(f"{prefix}.weight")
    if w is None or len(w.shape) != 2:
        raise ValueError(f"{prefix}.weight must be two-dimensional")
    rows, cols = w.shape[0], w.shape[1] * 2
    codes = np.frombuffer(payload(w), np.uint8).reshape(rows, cols // 16, 8)
    scales = np.frombuffer(payload(by[f"{prefix}.weight_scale"]), np.uint8).reshape(rows, cols // 16, 1)
    g = by.get(f"{prefix}.weight_scale_2")
    top = float(widen(payload(g), g.dtype)[0]) if g else 1.0
    return kernels.nvfp4_values(np.concatenate([codes, scales], axis=2).reshape(rows, -1), top)


def load_fp8(path: str, prefix: str) -> np.ndarray:
    """A layer of FP8 weights under unit, tensor, row or tile scales; a tile outside the table has scale 1."""
    by = {e.name: e for e in catalog(path)}
    w = by[f"{prefix}.weight"]
    x = widen(payload(w), w.dtype).reshape(w.rows, w.cols)
    s = by.get(f"{prefix}.weight_scale_inv") or by.get(f"{prefix}.weight_scale")
    if s is None:
        return x
    scale = widen(payload(s), s.dtype)
    if scale.size == 1:
        return x * scale[0]
    if scale.size == w.rows and not (len(s.shape) == 2 and s.shape[0] != w.rows):
        return x * scale[:, None]
    table = scale.reshape(s.shape if len(s.shape) == 2 else (1, -1))
    bh, bw = -(-w.rows // table.shape[0]), -(-w.cols // table.shape[1])
    full = np.ones((w.rows, w.cols), np.float32)
    tiled = np.repeat(np.repeat(table, bh, axis=0), bw, axis=1)[: w.rows, : w.cols]
    full[: tiled.shape[0], : tiled.shape[1]] = tiled
    return x * full


def write(folder: str, tensors: list[tuple[str, str, list[int], Callable[[], bytes]]], limit: int, metadata: dict | None = None, overwrite: bool = False, dry_run: bool = False) -> dict:
    """Shards of at most limit bytes (a larger tensor has one alone) and their index; each shard appears under its name when whole."""
    groups: list[list] = []
    filled = 0
    for t in tensors:
        n = math.prod(t[2]) * SIZES[t[1]]
        if not groups or filled + n > limit:
            groups.append([])
            filled = 0
        groups[-1].append(t)
        filled += n
    names = [f"model-{i + 1:05d}-of-{len(groups):05d}.safetensors" for i in range(len(groups))]
    total = sum(math.prod(t[2]) * SIZES[t[1]] for t in tensors)
    index = {"metadata": {"total_size": total}, "weight_map": {t[0]: n for n, g in zip(names, groups, strict=True) for t in g}}
    if dry_run:
        return index
    refuse_existing(f"{folder}/{INDEX}", overwrite)
    os.makedirs(folder, exist_ok=True)
    for name, group in zip(names, groups, strict=True):
        header, at = ({"__metadata__": metadata} if metadata else {}), 0
        for tensor, dtype, shape, _ in group:
            n = math.prod(shape) * SIZES[dtype]
            header[tensor] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + n]}
            at += n
        raw = json.dumps(header, separators=(",", ":")).encode()
        raw += b" " * (-len(raw) % 8)
        partial = f"{folder}/{name}.partial"
        with open(partial, "wb") as out:
            out.write(struct.pack("<Q", len(raw)) + raw)
            for tensor, dtype, shape, produce in group:
                data = produce()
                if len(data) != math.prod(shape) * SIZES[dtype]:
                    raise ValueError(f"{tensor}: {len(data)} bytes do not fit {dtype} {shape}")
                out.write(data)
        os.replace(partial, f"{folder}/{name}")
    with open(f"{folder}/{INDEX}", "w") as out:
        json.dump(index, out, indent=2, sort_keys=True)
    return index
