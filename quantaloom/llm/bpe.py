"""Byte-level BPE by backtracking over longest matches.

A piece's bytes are read as Latin-1 text and run through one Aho-Corasick
automaton over all tokens, which gives the longest token at every start. From
left to right the longest token is taken; a token may follow its neighbour only
if the two, encoded alone, stay those two tokens (memoised). Where it may not,
the next shorter prefix token is tried, and a start that admits none is dead and
never visited again. Each start is entered a bounded number of times, so the
work is linear in the piece, and the tokens are those of the exact merges.

Null texts count as empty; an empty text has no tokens. Repeated rows and equal
texts are encoded alike; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.runtime import ship

#: Pieces remembered in one worker; beyond this many the memory starts anew.
MEMORY = 400_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64

OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Maps a piece (text) to its tuple of ids; acts as its own bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token that its own bytes do not merge into occurs only as a whole piece.
        self.made = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.merge(token) == [rank]}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.made.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            for end in range(len(token) - 1, 0, -1):
                if (prefix := self.made.get(token[:end])) is not None:
                    self.shorter[rank] = prefix
                    break
        self.automaton.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """The defining rule: merge the leftmost pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[part] for part in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged on their own, stay as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        sizes, pairs, size = self.sizes, self.pairs, len(data)
        longest = [0] * size
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[rank]] = rank  # ends ascend, so the longest stays
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while True:
            end = at + sizes[token]
            if end not in dead and (not out or pairs.get((out[-1], token)) or self.fits(out[-1], token)):
                out.append(token)
                if end == size:
                    return tuple(out)
                at, token = end, longest[end]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece.encode())
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        ids = self.encode(text)
        listed = ",".join(map(self.names.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file; built once per process."""
    key = path, pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id with its list of ids (``ids array<int>``) for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [own.encode(text) for text in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text; per document the counts and digests of both."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, listed, decoded = [], [], []
            for text in batch.column(1):
                n, ids, back = own.digest(text.as_py())
                counts.append(n)
                listed.append(ids)
                decoded.append(back)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, OUTPUT)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
