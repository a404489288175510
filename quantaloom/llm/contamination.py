"""Benchmark decontamination with suffix arrays of the training text.

Every block of training text is turned into word hashes and a suffix array of
it: the word positions where a test suffix can begin (those whose first few words
begin some test window; all others cannot match), sorted by the words that follow, never past
the document's end. Every test suffix is binary-searched in the array of each
block. Neighbouring matches on one diagonal join into the longest verbatim match.
The benchmark is read in blocks of bounded bytes; each block passes over all
documents without a shuffle, so neither side is ever gathered as a whole.

Words: A-Z lower-cased, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A window is
13 consecutive words of an item; an item of fewer words is one window, an item
without words (null, empty) has none. Null or empty documents have no words and
are never contaminated. Repeated document rows are judged one by one; benchmark rows with
the same item_id count as one item, and a null item_id reads as ''. Extra columns, whatever their names, stay in
what `keep_clean` returns and are ignored elsewhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.llm._bytes import ALNUM, flat, pieces, words
from quantaloom.llm._rows import ROW, unwrapped, wrapped
from quantaloom.runtime import ship

WINDOW = 13
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Words of a window that must begin a known window before a position enters the suffix array.
LEAD = 4

_LEAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _keys(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Fixed-width byte strings that order positions by the next length words."""
    return np.ascontiguousarray(hashes[at[:, None] + np.arange(length)].astype(">u8")).view(f"S{8 * length}").ravel()


def _lead(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the first words at every position with so many words left."""
    k = min(LEAD, length)
    size = len(hashes) - k + 1
    total = hashes[:size] * _LEAD[0]
    for i in range(1, k):
        total += hashes[i : i + size] * _LEAD[i]
    return total >> np.uint64(32)


class Tests:
    """The windows of one benchmark block, by length."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        leads: dict[int, list[np.ndarray]] = defaultdict(list)
        self.where: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for item, text in rows:
            data, offsets = flat(pa.array([text or ""], pa.string()))
            _, _, hashes, _ = words(data, offsets, ALNUM)
            if not len(hashes):
                continue
            length = min(window, len(hashes))
            name = "" if item is None else str(item)
            starts = np.arange(len(hashes) - length + 1)
            raw = hashes[starts[:, None] + np.arange(length)].astype(">u8")
            for i, row in enumerate(raw):
                key = row.tobytes()
                found[length][key].add(name)
                self.where[key].append((name, i))
            leads[length].append(_lead(hashes, length)[: len(starts)])
        self.lengths = []
        for length, windows in sorted(found.items()):
            keys = np.frombuffer(b"".join(sorted(windows)), f"S{8 * length}")
            lead = np.unique(np.concatenate(leads[length]))
            bits = max(16, int(len(lead) * 32).bit_length())
            table = np.zeros(1 << bits, bool)
            table[lead & np.uint64((1 << bits) - 1)] = True
            self.lengths.append((length, keys, [sorted(windows[k]) for k in sorted(windows)], table, np.uint64((1 << bits) - 1), sorted(windows)))

    def search(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[str]], list[bytes]]]:
        """Per window length: positions that match and which window each matches."""
        for length, keys, items, table, low, raw in self.lengths:
            if len(hashes) < length:
                continue
            lead = _lead(hashes, length)[: len(hashes) - length + 1]
            at = np.flatnonzero(table[lead & low])
            ends = first[np.searchsorted(first, at, "right")]
            at = at[at + length <= ends]
            if not len(at):
                continue
            suffixes = _keys(hashes, at, length)
            order = np.argsort(suffixes, kind="stable")
            suffixes = suffixes[order]
            low_end, high_end = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            count = high_end - low_end
            which = np.repeat(np.arange(len(keys)), count)
            if len(which):
                spot = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low_end, count)
                yield length, at[order[spot]], which, items, raw


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's rows in blocks of about BLOCK_BYTES, one at a time on the driver."""
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = 1 + total // BLOCK_BYTES
    for i in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield [tuple(row) for row in part.collect()]


def _scan(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Wrapped docs with n_words, spans (flat start, end pairs of words) and items."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    text = docs.columns.index("text")
    frame = wrapped(docs, n_words=F.lit(0).cast("long"), spans=F.array().cast("array<long>"), items=F.array().cast("array<string>"))
    schema = frame.schema
    for rows in _blocks(benchmark):
        shared = context.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = Tests(shared.value, window)
            for batch in batches:
                filled = pa.record_batch([pc.struct_field(batch.column(0), [text]).cast(pa.string()).fill_null("")], ["text"])
                done = 0
                for piece in pieces(filled, 0):
                    own = batch.slice(done, piece.num_rows)
                    done += piece.num_rows
                    yield _mark(own, piece, tests)

        frame = frame.mapInArrow(run, schema)
    return frame


def _mark(own: pa.RecordBatch, piece: pa.RecordBatch, tests: Tests) -> pa.RecordBatch:
    data, offsets = flat(piece.column(0))
    _, _, hashes, first = words(data, offsets, ALNUM)
    edges = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    spans, listed = own.column(own.num_columns - 2).to_pylist(), own.column(own.num_columns - 1).to_pylist()
    for length, at, which, names, _ in tests.search(hashes, first):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
        doc = np.searchsorted(first, at, "right") - 1
        for pair in np.unique(doc * len(names) + which):
            items[int(pair) // len(names)].update(names[int(pair) % len(names)])
    for i, before in enumerate(spans):
        for j in range(0, len(before), 2):
            edges[first[i] + before[j]] += 1
            edges[first[i] + before[j + 1]] -= 1
    # a run never crosses a document, but two may touch where documents meet
    inside = np.cumsum(edges[:-1]) > 0
    for i in {*items, *(k for k, x in enumerate(spans) if x)}:
        covered = np.concatenate(([False], inside[first[i] : first[i + 1]], [False]))
        spans[i] = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
        listed[i] = sorted({*listed[i], *items.get(i, ())})
    columns = [own.column(0), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.string()))]
    return pa.record_batch([c.cast(f.type) for c, f in zip(columns, own.schema, strict=True)], schema=own.schema)


def _judged(marked: DataFrame) -> DataFrame:
    pairs = F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items found (count and digest of their ids) and the verdict."""
    return _judged(_scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)).select(
        F.col(ROW).getField("doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return unwrapped(_judged(_scan(docs, benchmark, window)).where(~F.col("contaminated")), docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every longest verbatim match: doc_id, item_id, doc_word, item_word, n_words.

    A match that spans several windows is one row; items of fewer words than a
    window match as a whole.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id string, doc_word long, item_word long, n_words long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frames = []
    for rows in _blocks(benchmark):
        shared = context.broadcast(rows)
        frames.append(source.mapInArrow(_matcher(shared, window), schema))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def _matcher(shared, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(shared.value, window)
        for batch in batches:
            for piece in pieces(batch, 1):
                data, offsets = flat(piece.column(1))
                _, _, hashes, first = words(data, offsets, ALNUM)
                spots = []
                for length, at, which, _, raw in tests.search(hashes, first):
                    doc = np.searchsorted(first, at, "right") - 1
                    for p, d, w in zip(at.tolist(), doc.tolist(), which.tolist(), strict=True):
                        spots += [(d, item, p - int(first[d]) - q, q, length) for item, q in tests.where[raw[w]]]
                joined: list[list] = []
                for d, item, diagonal, q, length in sorted(set(spots)):
                    last = joined[-1] if joined else None
                    if last and last[:3] == [d, item, diagonal] and q <= last[3] + last[4] - length + 1:
                        last[4] = q + length - last[3]
                    else:
                        joined.append([d, item, diagonal, q, length])
                ids = piece.column(0)
                yield pa.record_batch(
                    [ids.take(pa.array([x[0] for x in joined], pa.int64())), pa.array([x[1] for x in joined], pa.string()), pa.array([x[2] + x[3] for x in joined], pa.int64()), pa.array([x[3] for x in joined], pa.int64()), pa.array([x[4] for x in joined], pa.int64())],
                    ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
                )

    return run
