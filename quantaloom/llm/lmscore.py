"""Language-model scoring by cross-entropy difference.

Two bigram models, matched in all but their text, share one vocabulary: all words of
all documents. The background model counts every document, the target model the
chosen ones. A document's score is its loss per token under the target
model less that under the background model; low scores resemble the target.

    p(w | h) = L * c(h, w) / c(h) + (1 - L) * (c(w) + 1) / (N + V)

A first word, and a word after an otherwise unseen history, has the unigram term alone.
A document's own counts are taken out of each model that holds it, so no
document is scored by a model that has read it.

Documents are dealt to shards by their id. A shard counts its distinct words and
word pairs, sorts them by hash and sends each bucket of hashes one packed list; a
bucket adds up all shards' lists and answers each in its order. So all counts cover all
documents, a word that everyone uses is one entry per shard, and no model is ever
gathered in one place. Words and pairs count as equal if their 64-bit hashes are.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. Null or
empty texts have no tokens, losses and score 0. Repeated rows are scored and
counted each. Rows without doc_id belong to no target. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.llm._bytes import ALNUM, flat, mix, packed_texts, portion, words
from quantaloom.runtime import save, ship

#: Weight of the bigram term.
LAMBDA = 0.6
SHARD = 8 << 20

_LISTED = "bucket long, shard long, data binary"
_TOTALS = "shard long, bucket long, data binary, words long, target long, background long"
_SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


class Shard:
    """The tokens of a shard's documents, its distinct words and pairs."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column("doc_id")
        hashes, sizes = [], []
        texts = table.column("text")
        at = 0
        while at < len(texts):
            raw, size = [], 0
            while at < len(texts) and (not raw or size < 2 << 20):
                raw.append(zstandard.decompress(texts[at].as_py()))
                size += len(raw[-1])
                at += 1
            _, _, found, first = words(*flat(pa.array(raw, pa.large_binary()).cast(pa.large_string())), ALNUM)
            hashes.append(found)
            sizes.append(np.diff(first))
        tokens = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.words, self.word = np.unique(tokens, return_inverse=True)
        # a pair stands at its second token
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        pairs = mix(tokens[self.second - 1] * np.uint64(0x9E3779B97F4A7C15) + tokens[self.second])
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def parts(self, keys: np.ndarray, buckets: int) -> list[np.ndarray]:
        """The places of each bucket's keys, in the keys' order."""
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def _squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<i8").tobytes() for c in columns))


def _loosen(raw: bytes, columns: int) -> list[np.ndarray]:
    return list(np.frombuffer(zstandard.decompress(raw), "<i8").reshape(columns, -1)) if raw else [np.zeros(0, np.int64)] * columns


def _two(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(8, "little") + first + second


def _untwo(raw: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(raw[:8], "little")
    return raw[8 : 8 + n], raw[8 + n :]


def _counter(buckets: int):
    def run(key: tuple, docs: pa.Table, target: pa.Table) -> pa.Table:
        shard = Shard(docs)
        chosen = np.isin(np.array(shard.ids.to_pylist(), dtype=object).astype(str), np.array(target.column("doc_id").to_pylist(), dtype=object).astype(str)) if target.num_rows else np.zeros(docs.num_rows, bool)
        lists = []
        for keys, which, doc in ((shard.words, shard.word, shard.doc), (shard.pairs, shard.pair, shard.doc[shard.second])):
            every = np.bincount(which, minlength=len(keys))
            good = np.bincount(which[chosen[doc]], minlength=len(keys))
            lists.append([_squeeze(np.diff(keys[at].view(np.int64), prepend=0), good[at], every[at]) if len(at) else b"" for at in shard.parts(keys, buckets)])
        rows = [(b, _two(one, two)) for b, (one, two) in enumerate(zip(*lists, strict=True)) if one or two]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), key[0].as_py()), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "shard", "data"])

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of a bucket, answered to every shard in the order of its own keys."""
    lists = [_untwo(raw.as_py()) for raw in table.column("data")]
    answers, stats = [], []
    for kind in range(2):
        parts = [_loosen(pair[kind], 3) for pair in lists]
        keys = np.concatenate([np.cumsum(p[0]) for p in parts])
        distinct, at = np.unique(keys, return_inverse=True)
        good, every = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(good, at, np.concatenate([p[1] for p in parts]))
        np.add.at(every, at, np.concatenate([p[2] for p in parts]))
        ends = np.cumsum([len(p[0]) for p in parts])
        answers.append([_squeeze(good[own], every[own]) for own in np.split(at, ends[:-1])])
        stats.append((len(distinct), int(good.sum()), int(every.sum())))
    n = table.num_rows
    once = [pa.array([x, *[0] * (n - 1)], pa.int64()) for x in stats[0]]
    return pa.table([table.column("shard").combine_chunks(), pa.array(np.full(n, key[0].as_py()), pa.int64()), pa.array([_two(*x) for x in zip(*answers, strict=True)], pa.binary()), *once], ["shard", "bucket", "data", "words", "target", "background"])


def _scorer(buckets: int, vocabulary: int, sums: tuple[int, int], weight: float):
    def run(key: tuple, docs: pa.Table, totals: pa.Table, target: np.ndarray | None = None) -> pa.Table:
        shard = Shard(docs)
        answer = dict(zip(totals.column("bucket").to_pylist(), (_untwo(x.as_py()) for x in totals.column("data")), strict=True))
        counts = []
        for kind, keys in enumerate((shard.words, shard.pairs)):
            found = np.zeros((2, len(keys)), np.int64)
            for b, at in enumerate(shard.parts(keys, buckets)):
                if len(at):
                    found[:, at] = _loosen(answer[b][kind], 2)
            counts.append(found)
        member = np.array(docs.column("chosen").to_pylist(), bool)
        n = len(shard.sizes)
        width = max(len(shard.words), 1)
        own_key, own = np.unique(shard.doc * width + shard.word, return_counts=True)
        own_of = lambda doc, word: own[np.searchsorted(own_key, doc * width + word)]
        doc2, last = shard.doc[shard.second], shard.word[shard.second]
        before = shard.word[shard.second - 1]
        pair_key, at, times = np.unique(doc2 * max(len(shard.pairs), 1) + shard.pair, return_index=True, return_counts=True)
        doc2, last, before, pair = doc2[at], last[at], before[at], shard.pair[at]
        first = np.flatnonzero(np.append(True, shard.doc[1:] != shard.doc[:-1])) if len(shard.doc) else np.zeros(0, np.int64)
        doc1, word1 = shard.doc[first], shard.word[first]
        losses = []
        for model in range(2):
            inside = member if model == 0 else np.ones(n, bool)
            one, two = counts[0][model], counts[1][model]

            def unigram(doc, word, one=one, inside=inside, total=sums[model]):
                return (one[word] - own_of(doc, word) * inside[doc] + 1) / (total - shard.sizes[doc] * inside[doc] + vocabulary)

            lone = unigram(doc2, last)
            history = one[before] - own_of(doc2, before) * inside[doc2]
            seen = np.maximum(two[pair] - times * inside[doc2], 0)
            p = np.where(history > 0, weight * seen / np.maximum(history, 1) + (1 - weight) * lone, lone)
            loss = np.bincount(doc2, -np.log(p) * times, minlength=n) + np.bincount(doc1, -np.log(unigram(doc1, word1)), minlength=n)
            losses.append(loss / np.maximum(shard.sizes, 1))
        return pa.table([shard.ids.combine_chunks(), pa.array(shard.sizes, pa.int64()), *(pa.array(x, pa.float64()) for x in (losses[0], losses[1], losses[0] - losses[1]))], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return run


def score(docs: DataFrame, target: DataFrame, weight: float = LAMBDA) -> DataFrame:
    """Scores of all docs by a model of those whose doc_id is in target."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(total / portion(total, SHARD)))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("shard")
    dealt = packed_texts(docs).select("doc_id", "text", shard)
    chosen = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", shard)
    listed = dealt.groupBy("shard").cogroup(chosen.groupBy("shard")).applyInArrow(_counter(buckets), _LISTED)
    totals = save(listed.groupBy("bucket").applyInArrow(_add, _TOTALS))
    sums = totals.agg(*(F.sum(c).alias(c) for c in ("words", "target", "background"))).first()
    run = _scorer(buckets, sums["words"] or 0, (sums["target"] or 0, sums["background"] or 0), weight)
    # the chosen ids and the totals of a shard come to its texts as one stream
    marks = chosen.select("shard", F.col("doc_id"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"))
    answers = totals.select("shard", F.lit(None).cast("long").alias("doc_id"), "bucket", "data")

    def scored(key: tuple, own: pa.Table, rest: pa.Table) -> pa.Table:
        if not own.num_rows:
            return run(key, own.append_column("chosen", pa.array([], pa.bool_())), rest.slice(0, 0))
        ids = rest.column("doc_id")
        known = {x for x in ids.to_pylist() if x is not None}
        member = pa.array([x in known for x in own.column("doc_id").to_pylist()], pa.bool_())
        return run(key, own.append_column("chosen", member), rest.filter(rest.column("bucket").is_valid()))

    return dealt.groupBy("shard").cogroup(marks.unionAll(answers).groupBy("shard")).applyInArrow(scored, _SCORES)
