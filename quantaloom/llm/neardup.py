"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two
permutations make the whole signature: sigma scatters a shingle over 2**32
places, and coordinate k is the minimum of pi over the places shifted circularly
by k. Eight coordinates make a band; documents that agree on a band meet in its bucket.

Equal sets collapse to one representative first. In each bucket every member is
screened by its signature against the bucket's smallest id, and verified on full
shingle sets where it could reach the threshold. Buckets
whose members then still lie in several components are looked at again: there all
pairs across components are compared by their signatures, block by block inside
the tasks, and those that could reach the threshold are verified as well. So no
bucket is capped, no group's pairs are all emitted, and members already known to
be connected are not compared again.

The signature test lets a pair go if its estimated similarity is under SCREEN, about four
standard deviations below the threshold: it loses a pair at 0.850 with probability 7e-5, at 0.86
with 2e-6, unless other links connect the two; bands miss a pair at the threshold
with probability 3e-6. A test measures what both find of many pairs just above it.

Words are runs of [^\\x20\\x09-\\x0D] after lower-casing A-Z. With under five
words the whole sequence is the one shingle; without words (null, empty) the
set is empty and the document is linked with nothing. Rows that share a doc_id
count as one document and must share a text; each is returned. Rows without
doc_id are linked with nothing, have no component and are kept. Extra columns
stay in what `keep_one` returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.llm._bytes import NOT_SPACE, flat, mix, packed_texts, pieces, words
from quantaloom.llm._graph import components
from quantaloom.runtime import save, ship

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 40, 8
#: Coordinates of a signature: the first BANDS * ROWS make bands, all of them estimate.
COORDINATES = 640
SCREEN = 0.795
#: Members of a bucket that are compared with one another in one task.
BLOCK = 1024
#: Members verified against one centre in one task.
STAR = 256

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_OTHER, _SIGMA = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LANE = 1 << 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    _, _, hashes, first = words(data, offsets, NOT_SPACE)
    rolled = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        rolled += hashes[i : i + len(rolled)] * _MULTIPLY[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            few = hashes[a:b] * _MULTIPLY[: b - a]
            out.append(mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def _pi(x: np.ndarray) -> None:
    """A permutation of 32-bit places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte per coordinate for every non-empty set."""
    out = np.empty((len(sets), COORDINATES), np.uint8)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _LANE):
            size += len(sets[end])
            end += 1
        place = (mix(np.concatenate(sets[at:end]) ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        lows = np.empty((COORDINATES, end - at), np.uint32)
        shifted = np.empty_like(place)
        for k in range(COORDINATES):
            np.add(place, np.uint32(k), out=shifted)
            _pi(shifted)
            lows[k] = np.minimum.reduceat(shifted, starts)
        _pi(lows)
        out[at:end] = (lows >> np.uint32(24)).T
        at = end
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its signature."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, 2 << 20):
                sets = shingle_sets(*flat(piece.column(1)))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                signed: list[bytes | None] = [None] * len(sets)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    one[full] = np.add.reduceat(mix(every), starts)
                    two[full] = np.add.reduceat(mix(every ^ _OTHER), starts)
                    for i, row in zip(full.tolist(), signatures([sets[i] for i in full]), strict=True):
                        signed[i] = row.tobytes()
                yield pa.record_batch([piece.column(0), pa.array(sizes, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(signed, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold; one task holds one b and up to STAR of its a."""
    stars = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts"))
    salted = pairs.join(stars, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    # whole texts travel packed; the same plan at every size
    wanted = salted.select(F.col("a").alias("id"), "b", "salt", F.lit(True).alias("member")).unionAll(salted.select(F.col("b").alias("id"), "b", "salt", F.lit(False).alias("member")).distinct())
    rows = wanted.join(texts.withColumnRenamed("doc_id", "id").hint("merge"), "id").select("b", "salt", "member", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                linked: list[tuple[int, int]] = []
                for b, salt, member, doc_id, packed in zip(*(piece.column(i).to_pylist() for i in range(5)), strict=True):
                    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
                    found = shingle_sets(data, np.array([0, len(data)]))[0]
                    if not member:
                        centre, own = (b, salt), found
                        continue
                    if centre != (b, salt):
                        raise ValueError(f"no text for document {b}")
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * both >= PERCENT * (len(own) + len(found) - both):
                        linked.append((doc_id, b))
                yield pa.record_batch([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], ["a", "b"])

    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member").mapInArrow(run, "a long, b long")


def _starred(members: DataFrame) -> DataFrame:
    """Pairs (member, smallest id) of each bucket that could reach the threshold.

    The smallest id goes to every task that holds some of a large bucket's members.
    """
    salts = F.ceil(F.col("size") / STAR)
    dealt = members.select("key", F.explode(F.when(F.col("id") == F.col("b"), F.sequence(F.lit(0).cast("long"), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), salts)))).alias("salt"), (F.col("id") != F.col("b")).alias("member"), "id", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            signed = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
            heads = ~batch.column(2).to_numpy(zero_copy_only=False)
            if centre is not None:
                ids, sizes, heads = (np.append(x, y) for x, y in zip(centre[:3], (ids, sizes, heads), strict=True))
                signed = np.concatenate([centre[3], signed])
            own = np.maximum.accumulate(np.where(heads, np.arange(len(ids)), 0))
            last = own[-1]
            centre = [x[last : last + 1] for x in (ids, sizes, heads, signed)]
            near = ~heads & (100 * np.minimum(sizes, sizes[own]) >= PERCENT * np.maximum(sizes, sizes[own]))
            at = np.flatnonzero(near)
            at = at[(signed[at] == signed[own[at]]).sum(axis=1) >= SCREEN * COORDINATES]
            yield pa.record_batch([pa.array(ids[at], pa.int64()), pa.array(ids[own[at]], pa.int64())], ["a", "b"])

    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "member").mapInArrow(run, "a long, b long")


def _screened(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of different components in one bucket that could reach the threshold.

    members: key, size, id, n, comp, band, sig. A bucket is dealt in pairs of blocks, and a pair
    counts in the first band that it shares.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "comp", "band", "sig")

    def pairs(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(group)
        own, low, high, ids, sizes, comps = (rows.column(name).to_numpy() for name in ("own", "low", "high", "id", "n", "comp"))
        band = rows.column("band")[0].as_py()
        signed = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
        bands = np.ascontiguousarray(signed[:, : BANDS * ROWS]).view(np.uint64)
        within = low[0] == high[0]
        lefts = np.arange(len(ids)) if within else np.flatnonzero(own == low[0])
        rights = lefts if within else np.flatnonzero(own == high[0])
        found = []
        for i in lefts.tolist():
            js = rights[rights > i] if within else rights
            js = js[(comps[js] != comps[i]) & (100 * np.minimum(sizes[js], sizes[i]) >= PERCENT * np.maximum(sizes[js], sizes[i]))]
            if len(js):
                js = js[(signed[js] == signed[i]).sum(axis=1) >= SCREEN * COORDINATES]
            if len(js) and band:
                js = js[~(bands[js, :band] == bands[i, :band]).any(axis=1)]
            found += [(max(ids[i], ids[j]), min(ids[i], ids[j])) for j in js]
        return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a].tolist())
                if key != open_key and held:
                    yield pairs(held)
                    held = []
                open_key = key
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(held)

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long")


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    sketches = save(sketch(docs))
    sets = sketches.where("n > 0 and doc_id is not null")
    # one representative for each set: the smallest id
    same = save(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS)), i).alias("key")))
    keyed = same.select("id", "n", F.explode(band).alias("x")).select("id", "n", F.col("x.band").cast("long").alias("band"), F.col("x.key").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keyed.join(heads, "key")
    buckets = save(met.join(same.select("id", "sig"), "id").select("key", "size", "id", "n", "band", "b", "sig"))
    members = buckets.select(F.col("id").alias("doc_id")).distinct()
    texts = save(packed_texts(_texts(docs)).join(members.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    links = save(_verified(save(_starred(buckets).distinct()), texts))
    labels = components(links)
    # buckets of three or more whose members are still apart: all that meets there is screened and verified
    wide = buckets.where("size > 2").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    apart = wide.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    again = wide.join(apart, "key", "left_semi").select("key", "size", "id", "n", "comp", "band", "sig")
    later = save(_verified(save(_screened(again).distinct()), texts))
    if not later.isEmpty():
        labels = components(links.unionAll(later))
    whole = sketches.select("doc_id", "n", "h1", "h2").join(same.select("h1", "h2", "id"), ["h1", "h2"], "left").join(labels, "id", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component (the one of smallest id), with all columns."""
    gone = decide(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
