"""Vectorised reading of whole UTF-8 texts from Arrow batches: words and their hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Words up to so many bytes are hashed in bulk, longer ones one by one.
LONG_WORD = 256
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19

_random = np.random.default_rng(20240611)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, LONG_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows in them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about size bytes of text each; no row is cut."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes (never 0) of all words, and each row's first word (one more than rows)."""
    if lower:
        data = LOWER[data]
    mask = is_word[data]
    size = len(data)
    edge = offsets[offsets < size]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    first[edge] = mask[edge]
    edge = edge[edge > 0] - 1
    last[edge] = mask[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), np.uint64)
    if len(start):
        lengths = end - start
        cuts = np.unique(np.append(np.searchsorted(start, np.arange(start[0], end[-1], CHUNK)), len(start)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, low = lengths[a:b], start[a]
            if own.max() > LONG_WORD:
                keep = own <= LONG_WORD
                for i in np.flatnonzero(~keep) + a:
                    hashes[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
                if not keep.any():
                    continue
                inside = np.repeat(start[a:b][keep], own[keep])
                offset = np.cumsum(own[keep]) - own[keep]
                place = np.arange(len(inside)) - np.repeat(offset, own[keep])
                hashes[a:b][keep] = np.add.reduceat(_BYTE[data[inside + place]] * _PLACE[place], offset)
                continue
            chars = data[low : end[b - 1]][mask[low : end[b - 1]]]
            offset = np.cumsum(own) - own
            place = np.arange(len(chars)) - np.repeat(offset, own)
            hashes[a:b] = np.add.reduceat(_BYTE[chars] * _PLACE[place], offset)
        hashes = mix(hashes + lengths.astype(np.uint64))
        hashes[hashes == 0] = 1
    return start, end, hashes, np.searchsorted(start, offsets)


def portion(total: int, least: int) -> int:
    """Bytes of text behind one shard or bucket: fixed for small corpora, growing with the root of large ones.

    So a shard's share of a bucket, which travels as one packed value, never shrinks to single entries.
    """
    return max(least, min(int((total * 600) ** 0.5), 256 << 20))


def packed_texts(docs):
    """doc_id and zstd-compressed text of (doc_id, text): what is shuffled of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece in pieces(batch, 1, 1 << 20):
                yield pa.record_batch([piece.column(0), pa.array([pack(text.as_buffer()) for text in piece.column(1)], pa.binary())], ["doc_id", "text"])

    return docs.mapInArrow(run, "doc_id long, text binary")
