"""Calibration vectors (two file forms), logit captures, measured curves, and text reports."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.sources import gguf
from quantaloom.sources.files import opened, refuse_existing, resolve

IMATRIX = "tensor string, ncall int, g array<float>"
CAPTURE = "pos long, target int, logits array<float>"
SPARSE = "pos long, target int, ids array<int>, logits array<float>, lse double"
LOGITS, NO_TARGET = b"RQLG", 2**32 - 1
MOST_TENSORS, LONGEST_NAME, MOST_VALUES = 1_000_000, 4096, 1 << 28


def _whole(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def _flat(raw: bytes) -> Iterator[tuple[str, int, list[float]]]:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(raw):
            raise ValueError("truncated calibration file")
        at += n
        return raw[at - n : at]

    integer = lambda: struct.unpack("<i", take(4))[0]
    count = integer()
    if not 0 <= count <= MOST_TENSORS:
        raise ValueError("no calibration file")
    for _ in range(count):
        size = integer()
        if not 0 <= size <= LONGEST_NAME:
            raise ValueError("implausible name")
        name, calls, n = take(size).decode(), integer(), integer()
        if not 0 <= n <= MOST_VALUES:
            raise ValueError("implausible length")
        yield name, calls, np.frombuffer(take(4 * n), "<f4").tolist()


def _container(spark: SparkSession, path: str) -> DataFrame:
    """Tensors *.in_sum2 with the first value of *.counts (0 without one)."""
    values = gguf.read(spark, path, "values")
    stem = lambda end: F.regexp_extract("name", rf"^(.*)\.{end}$", 1)
    sums = values.where(F.col("name").endswith(".in_sum2")).groupBy(stem("in_sum2").alias("tensor")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", "x"))), lambda r: r["x"])).alias("g"))
    counts = values.where(F.col("name").endswith(".counts") & (F.col("row") == 0)).select(stem("counts").alias("tensor"), F.get("x", F.lit(0)).cast("int").alias("ncall"))
    return sums.join(counts, "tensor", "left").select("tensor", F.coalesce("ncall", F.lit(0)).alias("ncall"), "g")


def read_imatrix(spark: SparkSession, path: str) -> DataFrame:
    """tensor, ncall, g of either form; a file without vectors is an error."""
    with opened(path) as f:
        magic = f.read(4)
    if magic == gguf.MAGIC:
        if not any(t.name.endswith(".in_sum2") for t in gguf.read_header(path).tensors):
            raise ValueError(f"{path} has no calibration vectors")
        return _container(spark, path)
    return spark.createDataFrame(list(_flat(_whole(path))), IMATRIX)


def imatrix_summary(imatrix: DataFrame) -> DataFrame:
    bad = F.size(F.filter("g", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)))
    return imatrix.select("tensor", "ncall", F.size("g").alias("channels"), F.array_min("g").alias("low"), F.array_max("g").alias("high"), bad.alias("unusable"))


def write_imatrix(path: str, entries: list[tuple[str, int, list[float]]], overwrite: bool = False) -> None:
    refuse_existing(path, overwrite)
    system, inner = resolve(path)
    with system.open_output_stream(inner) as out:
        out.write(struct.pack("<i", len(entries)))
        for name, calls, values in entries:
            raw = name.encode()
            out.write(struct.pack("<i", len(raw)) + raw + struct.pack("<ii", calls, len(values)) + np.asarray(values, "<f4").tobytes())


def read_logits(spark: SparkSession, path: str) -> DataFrame:
    """A capture store: dense rows (pos, target, logits), or top-k rows with ids and log-sum-exp."""
    raw = _whole(path)
    if raw[:4] != LOGITS or len(raw) < 32:
        raise ValueError(f"{path} is no capture")
    version, vocab, k, n, _ = struct.unpack("<IIIQQ", raw[4:32])
    if version != 1:
        raise ValueError(f"capture version {version}")
    targets = np.frombuffer(raw, "<u4", n, 32)
    named = [None if t == NO_TARGET else int(t) for t in targets.tolist()]
    at = 32 + 4 * n
    if k == 0:
        rows = np.frombuffer(raw, "<f4", n * vocab, at).reshape(n, vocab)
        return spark.createDataFrame([(i, named[i], rows[i].tolist()) for i in range(n)], CAPTURE)
    one = np.dtype([("ids", "<i4", (k,)), ("logits", "<f4", (k,)), ("lse", "<f8")])
    rows = np.frombuffer(raw, one, n, at)
    return spark.createDataFrame([(i, named[i], r["ids"].tolist(), r["logits"].tolist(), float(r["lse"])) for i, r in enumerate(rows)], SPARSE)


def write_logits(path: str, capture: DataFrame, vocab: int, top_k: int = 0, overwrite: bool = False) -> None:
    """Rows in order of pos; a row whose width is not the store's is an error."""
    refuse_existing(path, overwrite)
    n = capture.count()
    width = vocab if top_k == 0 else top_k
    if (top_k == 0) != ("ids" not in capture.columns):
        raise ValueError("a store is dense if and only if top_k is 0")
    ordered = capture.orderBy("pos")
    system, inner = resolve(path)
    with system.open_output_stream(inner) as out:
        out.write(LOGITS + struct.pack("<IIIQQ", 1, vocab, top_k, n, 0))
        for r in ordered.select("target").toLocalIterator():
            out.write(struct.pack("<I", NO_TARGET if r["target"] is None else r["target"]))
        for r in ordered.toLocalIterator():
            if len(r["logits"]) != width:
                raise ValueError(f"row {r['pos']} has {len(r['logits'])} values, not {width}")
            if top_k:
                out.write(np.asarray(r["ids"], "<i4").tobytes() + np.asarray(r["logits"], "<f4").tobytes() + struct.pack("<d", r["lse"]))
            else:
                out.write(np.asarray(r["logits"], "<f4").tobytes())


def read_raw_logits(spark: SparkSession, path: str, vocab: int, targets: list[int] | None = None) -> DataFrame:
    """A dump of singles; its length must be whole rows, and targets as many."""
    raw = np.frombuffer(_whole(path), "<f4")
    if raw.size % vocab or (targets is not None and len(targets) != raw.size // vocab):
        raise ValueError("the dump is not whole rows, or targets do not fit")
    rows = raw.reshape(-1, vocab)
    return spark.createDataFrame([(i, None if targets is None else targets[i], r.tolist()) for i, r in enumerate(rows)], CAPTURE)


def read_sensitivity(spark: SparkSession, path: str) -> DataFrame:
    """pos, key, members, source_bytes, points(bits, bytes, kl); schema version 1 only."""
    table = json.loads(_whole(path))
    if table.get("schema") != 1:
        raise ValueError(f"sensitivity schema {table.get('schema')}")
    rows = [(i, e["key"], e.get("members", []), e.get("source_bytes", 0), [(p["bits"], p["bytes"], p["kl"]) for p in e["points"]]) for i, e in enumerate(table["entries"])]
    return spark.createDataFrame(rows, "pos int, key string, members array<string>, source_bytes long, points array<struct<bits:string,bytes:long,kl:double>>")


def write_sensitivity(path: str, entries: DataFrame, overwrite: bool = False) -> None:
    """A measured table has one entry per group; it is written whole."""
    refuse_existing(path, overwrite)
    listed = [{"key": r["key"], "members": r["members"], "source_bytes": r["source_bytes"], "points": [p.asDict() for p in r["points"]]} for r in entries.orderBy("pos").toLocalIterator()]
    system, inner = resolve(path)
    with system.open_output_stream(inner) as out:
        out.write(json.dumps({"schema": 1, "entries": listed}, indent=2).encode())


_NUMBER = r"([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line of whole text files; a report is small, and its place is its line number."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))


def read_ppl(spark: SparkSession, path: str) -> DataFrame:
    """ppl and its error from the last line that names one; none is an error."""
    line = F.trim("line")
    found = F.regexp_extract(line, rf"(?:PPL =|ppl =|perplexity:)\s*{_NUMBER}", 1)
    err = F.regexp_extract(line, rf"(?:PPL =|ppl =|perplexity:).*?(?:\+/-|±)\s*{_NUMBER}", 1)
    rows = _lines(spark, path).where(found != "").select("place", found.cast("double").alias("ppl"), F.nullif(err, F.lit("")).cast("double").alias("err"))
    last = rows.agg(F.max_by(F.struct("ppl", "err"), "place").alias("m"))
    return last.select(F.coalesce("m.ppl", F.raise_error(F.lit("no perplexity line")).cast("double")).alias("ppl"), F.col("m.err").alias("err"))


def read_kl_report(spark: SparkSession, path: str) -> DataFrame:
    """mean, median, p90, p99, max, top1 of a divergence report; rms is unknown; no such line is an error."""
    line = F.trim("line")
    key = F.lower(F.trim(F.regexp_extract(line, r"^(.*?)KLD:", 1)))
    value = F.nullif(F.regexp_extract(line, rf"KLD:\s*{_NUMBER}", 1), F.lit("")).cast("double")
    top = F.nullif(F.regexp_extract(line, rf"^Same top p:\s*{_NUMBER}", 1), F.lit("")).cast("double") / 100
    rows = _lines(spark, path).select(key.alias("k"), value.alias("v"), top.alias("t"))
    pick = lambda cond: F.max(F.when(cond & F.col("v").isNotNull(), F.col("v")))
    k = F.col("k")
    out = rows.agg(F.count("v").alias("_n"), F.count("t").alias("_t"), pick(k.startswith("mean")).alias("mean"), pick(k.startswith("median")).alias("median"), pick(k.startswith("90.0") | (k == "90%")).alias("p90"), pick(k.startswith("99.0") | (k == "99%")).alias("p99"), pick(k.startswith("max")).alias("max"), F.max("t").alias("top1"))
    checked = F.when(F.col("_n") + F.col("_t") == 0, F.raise_error(F.lit("no divergence statistics")).cast("double")).otherwise(F.col("mean"))
    return out.select(checked.alias("mean"), "median", "p90", "p99", "max", F.lit(None).cast("double").alias("rms"), "top1")
