"""GGUF containers: header, metadata and tensors as tables, rows as partitions, and a streaming writer."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantaloom.functions import codebooks, kernels
from quantaloom.functions.formats import BLOCK, ID, INTERNAL, NAME
from quantaloom.sources.files import BATCH, binary_rows, listed, listed_rows, opened, refuse_existing, resolve

MAGIC = b"GGUF"
ALIGNMENT_KEY = "general.alignment"
#: Bytes of one partition of rows.
SPLIT = 64 << 20
# Fixed ids of metadata types, with struct codes of the scalars.
TYPES = {0: ("U8", "B"), 1: ("I8", "b"), 2: ("U16", "H"), 3: ("I16", "h"), 4: ("U32", "I"), 5: ("I32", "i"), 6: ("F32", "f"), 7: ("Bool", "?"), 8: ("String", None), 9: ("Array", None), 10: ("U64", "Q"), 11: ("I64", "q"), 12: ("F64", "d")}
TYPE_ID = {name: i for i, (name, _) in TYPES.items()}


def aligned(n: int, to: int) -> int:
    return -(-n // to) * to


@dataclass
class Tensor:
    name: str
    dims: list[int]
    type_id: int
    offset: int = 0

    @property
    def elements(self) -> int:
        return math.prod(self.dims)

    @property
    def shape(self) -> tuple[int, int]:
        """(rows, cols); leading dimensions fold into rows."""
        cols = self.dims[-1] if self.dims else 1
        return (self.elements // cols if cols else 0), cols

    @property
    def row_bytes(self) -> int:
        if self.type_id not in NAME:
            raise ValueError(f"{self.name}: unsupported type {self.type_id}")
        block, size = BLOCK[NAME[self.type_id]]
        cols = self.shape[1]
        if cols % block:
            raise ValueError(f"{self.name}: {cols} columns are not whole blocks of {block}")
        return cols // block * size

    @property
    def nbytes(self) -> int:
        return self.shape[0] * self.row_bytes


@dataclass
class Header:
    version: int
    kv: list[tuple[str, str, object]] = field(default_factory=list)
    tensors: list[Tensor] = field(default_factory=list)
    data_start: int = 0


class _Cursor:
    def __init__(self, f) -> None:
        self.f = f

    def take(self, n: int) -> bytes:
        raw = self.f.read(n)
        if len(raw) != n:
            raise ValueError("truncated file")
        return raw

    def one(self, code: str):
        return struct.unpack(f"<{code}", self.take(struct.calcsize(f"<{code}")))[0]

    def text(self) -> str:
        return self.take(self.one("Q")).decode("utf-8")

    def value(self, kind: int):
        if kind not in TYPES:
            raise ValueError(f"unknown metadata type {kind}")
        name, code = TYPES[kind]
        if name == "String":
            return self.text()
        if name == "Array":
            inner, n = self.one("I"), self.one("Q")
            return [self.value(inner) for _ in range(n)] if inner in (8, 9) else self.many(inner, n)
        return self.one(code)

    def many(self, kind: int, n: int) -> list:
        code = TYPES[kind][1]
        return list(struct.unpack(f"<{n}{code}", self.take(n * struct.calcsize(f"<{code}"))))


def _kind(kind: int, cursor: _Cursor) -> tuple[str, object]:
    """Type name (nested as Array<...>) and value."""
    if kind != 9:
        return TYPES[kind][0], cursor.value(kind)
    inner, n = cursor.one("I"), cursor.one("Q")
    if inner == 9:
        items = [_kind(9, cursor) for _ in range(n)]
        return f"Array<{items[0][0] if items else 'Array'}>", [v for _, v in items]
    return f"Array<{TYPES[inner][0]}>", [cursor.text() for _ in range(n)] if inner == 8 else cursor.many(inner, n)


def read_header(path: str) -> Header:
    with opened(path) as f:
        c = _Cursor(f)
        if c.take(4) != MAGIC:
            raise ValueError(f"{path} is no GGUF file")
        header = Header(c.one("I"))
        if header.version not in (2, 3):
            raise ValueError(f"unsupported GGUF version {header.version}")
        n_tensors, n_kv = c.one("Q"), c.one("Q")
        for _ in range(n_kv):
            key = c.text()
            header.kv.append((key, *_kind(c.one("I"), c)))
        for _ in range(n_tensors):
            name, rank = c.text(), c.one("I")
            dims = [c.one("Q") for _ in range(rank)][::-1]
            header.tensors.append(Tensor(name, dims, c.one("I"), c.one("Q")))
        alignment = next((v for k, _, v in header.kv if k == ALIGNMENT_KEY), 32)
        header.data_start = aligned(f.tell(), max(int(alignment), 1))
    return header


def _spell(kind: str, value: object) -> bytes:
    if kind == "String":
        raw = value.encode()
        return struct.pack("<Q", len(raw)) + raw
    if kind.startswith("Array<"):
        inner = kind[6:-1]
        base = inner.split("<")[0]
        return struct.pack("<IQ", TYPE_ID[base], len(value)) + b"".join(_spell(inner, v) for v in value)
    return struct.pack(f"<{TYPES[TYPE_ID[kind]][1]}", value)


def write(path: str, kv: list[tuple[str, str, object]], tensors: list[Tensor], payloads: Iterable[bytes], alignment: int = 32, overwrite: bool = False) -> int:
    """Stream a file: the header from the plan alone, then chunks of payload, one tensor after another.

    payloads yields each tensor's bytes in chunks, None after each tensor. The key of alignment is the
    writer's own. Returns the file's size; a tensor of the wrong size or an internal type is an error.
    """
    refuse_existing(path, overwrite)
    if bad := next((t for t in tensors if t.type_id >= INTERNAL), None):
        raise ValueError(f"{bad.name}: type {bad.type_id} never stands in a GGUF file")
    kv = [x for x in kv if x[0] != ALIGNMENT_KEY] + ([(ALIGNMENT_KEY, "U32", alignment)] if alignment != 32 else [])
    head = bytearray(MAGIC + struct.pack("<IQQ", 3, len(tensors), len(kv)))
    for key, kind, value in kv:
        head += _spell("String", key) + struct.pack("<I", TYPE_ID[kind.split("<")[0]]) + _spell(kind, value)
    offset = 0
    for t in tensors:
        t.offset = offset
        offset += aligned(t.nbytes, alignment)
        head += _spell("String", t.name) + struct.pack(f"<I{len(t.dims)}QIQ", len(t.dims), *t.dims[::-1], t.type_id, t.offset)
    head += bytes(aligned(len(head), alignment) - len(head))
    system, inner = resolve(path)
    chunks = iter(payloads)
    with system.open_output_stream(inner) as out:
        out.write(bytes(head))
        for t in tensors:
            n = 0
            for chunk in chunks:
                if chunk is None:
                    break
                out.write(chunk)
                n += len(chunk)
            if n != t.nbytes:
                raise ValueError(f"{t.name}: {n} bytes instead of {t.nbytes}")
            out.write(bytes(aligned(n, alignment) - n))
    return len(head) + offset


def passthrough(kv: list[tuple[str, str, object]], default_type: int | None = None) -> list[tuple[str, str, object]]:
    """Metadata for a rewritten file: without alignment; with a default type, the file type is set anew."""
    out = [x for x in kv if x[0] != ALIGNMENT_KEY and not (default_type is not None and x[0] == "general.file_type")]
    return out if default_type is None else [*out, ("general.file_type", "U32", default_type)]


SCHEMAS = {
    "kv": "path string, pos int, key string, vtype string, value string",
    "tensors": "path string, pos int, name string, dims array<long>, type_id int, type_name string, offset long, nbytes long",
    "rows": "path string, name string, row long, raw binary",
    "values": "name string, row long, x array<float>",
}


@dataclass
class Part(InputPartition):
    path: str
    pos: int
    start: int
    stop: int


class GgufReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table, self.names = options.get("table", "tensors"), options.get("names")
        self.paths = listed(options["path"], ".gguf")
        self.grids = codebooks.given()

    def partitions(self) -> list[Part]:
        if self.table in ("kv", "tensors"):
            return [Part(p, -1, 0, 0) for p in self.paths]
        wanted = set(self.names.split(",")) if self.names else None
        out = []
        for path in self.paths:
            for pos, t in enumerate(read_header(path).tensors):
                if wanted is None or t.name in wanted:
                    step = max(1, SPLIT // max(t.row_bytes, 1))
                    out += [Part(path, pos, r, min(r + step, t.shape[0])) for r in range(0, t.shape[0], step)]
        return out

    def read(self, part: Part) -> Iterator[tuple | pa.RecordBatch]:
        header = read_header(part.path)
        if self.table == "kv":
            for i, (key, kind, value) in enumerate(header.kv):
                yield part.path, i, key, kind, value if kind == "String" else json.dumps(value)
        elif self.table == "tensors":
            for i, t in enumerate(header.tensors):
                yield part.path, i, t.name, t.dims, t.type_id, NAME.get(t.type_id, f"type{t.type_id}"), header.data_start + t.offset, t.nbytes
        else:
            codebooks.take(self.grids)
            t = header.tensors[part.pos]
            step = max(1, BATCH // max(t.row_bytes, 1))
            with opened(part.path) as f:
                f.seek(header.data_start + t.offset + part.start * t.row_bytes)
                for row in range(part.start, part.stop, step):
                    n = min(step, part.stop - row)
                    raw = f.read(n * t.row_bytes)
                    if len(raw) != n * t.row_bytes:
                        raise ValueError(f"{t.name}: truncated")
                    names, rows = pa.array([t.name] * n), pa.array(range(row, row + n), pa.int64())
                    if self.table == "rows":
                        yield pa.record_batch([pa.array([part.path] * n), names, rows, binary_rows(raw, n)], ["path", "name", "row", "raw"])
                    else:
                        values = kernels.dequantize(NAME[t.type_id], np.frombuffer(raw, np.uint8).reshape(n, -1), t.shape[1])
                        yield pa.record_batch([names, rows, listed_rows(values)], ["name", "row", "x"])


class GgufDataSource(DataSource):
    """spark.read.format("gguf").option("table", "kv" | "tensors" | "rows" | "values").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "tensors")]

    def reader(self, schema) -> GgufReader:
        return GgufReader(dict(self.options))


def read(spark: SparkSession, path: str, table: str = "tensors", names: list[str] | None = None) -> DataFrame:
    from quantaloom.runtime import ship

    ship(spark)
    spark.dataSource.register(GgufDataSource)
    reader = spark.read.format("gguf").option("table", table)
    return (reader.option("names", ",".join(names)) if names else reader).load(path)


def save(rows: DataFrame, tensors: list[Tensor], kv: list[tuple[str, str, object]], path: str, alignment: int = 32, overwrite: bool = False) -> int:
    """Write packed rows (name, row, raw) in the order of tensors. One file has one order, so partitions stream to it one at a time."""
    order = {t.name: i for i, t in enumerate(tensors)}
    ranked = rows.sparkSession.createDataFrame(list(order.items()), "name string, _pos int")
    stream = rows.join(ranked, "name").orderBy("_pos", "row").select("_pos", "raw").toLocalIterator(prefetchPartitions=True)

    def chunks() -> Iterator[bytes | None]:
        now = 0
        for r in stream:
            while now < r["_pos"]:
                yield None
                now += 1
            yield bytes(r["raw"])
        while now < len(tensors):
            yield None
            now += 1

    return write(path, kv, tensors, chunks(), alignment, overwrite)


TYPE_IDS = ID
