import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quantaloom.llm import sharding


def check(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("rows", None)}


def cut_links(rows, got):
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    return sum(len(x) > 1 for x in where.values())


@pytest.mark.parametrize("bin_rows", [10_000, 20])
def test_law_and_links(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(sharding, "BIN_ROWS", bin_rows)
    rng = random.Random(1)
    rows = [(i, f"text {i} é") for i in range(500)]
    for g in range(120):
        rows += [(1000 + 10 * g + k, f"copy {g}") for k in range(rng.randint(2, 6))]
    rows += [(5000 + i, "giant") for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, size int, grp string").repartition(5)
    got = sharding.assign(docs, 7).collect()
    check(rows, got, 7)
    assert cut_links(rows, got) <= 7  # the giant, which is larger than a shard, and one at each cut at most
    none = sharding.assign(docs, 7, rounds=0).collect()
    check(rows, none, 7)
    assert cut_links(rows, got) < 0.3 * cut_links(rows, none)


def test_large_groups_gather(spark):
    rows, shards = [(i, f"text {i}") for i in range(600)], 12
    sizes = {"small": 40, "half": 150, "whole": 300, "giant": 1100, "twin": 1100}
    for text, n in sizes.items():
        rows += [(len(rows) + k, text) for k in range(n)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards).collect()
    check(rows, got, shards)
    text, where = dict(rows), defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    for name, n in sizes.items():
        assert len(where[name]) <= -(-n * shards // len(rows)) + 1, (name, where[name])
        assert max(where[name]) - min(where[name]) < len(where[name])


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, None), (None, ""), (None, "x"), (2, "x"), (2, "x"), (2, "x")], [(i, "same") for i in range(50)]])
def test_small(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.assign(docs).collect(), sharding.SHARDS)


def least_cuts(sizes, singles, shards):
    """By trying all ways: how few groups are split where counts are at most one apart."""
    rows = sum(sizes) + singles
    cap = [rows // shards + (i < rows % shards) for i in range(shards)]
    best = len(sizes)
    for homes in itertools.product(range(shards + 1), repeat=len(sizes)):  # the last means: split
        held = [sum(n for n, h in zip(sizes, homes, strict=True) if h == i) for i in range(shards)]
        if all(h <= c for h, c in zip(held, cap, strict=True)):
            best = min(best, homes.count(shards))
    return best


def test_cuts_against_brute_force(spark):
    rng = random.Random(11)
    for shards, singles in ((2, 30), (3, 40), (3, 12)):
        sizes = [rng.randint(2, 5) for _ in range(6)]
        rows = [(i, f"own {i}") for i in range(singles)] + [(1000 + 100 * g + k, f"group {g}") for g, n in enumerate(sizes) for k in range(n)]
        got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        check(rows, got, shards)
        assert cut_links(rows, got) <= least_cuts(sizes, singles, shards) + 1
        ordered = sorted(rows, key=lambda r: zlib.crc32(r[1].encode()))
        plain = defaultdict(set)
        for k, (_, text) in enumerate(ordered):
            plain[text].add(k * shards // len(rows))
        assert cut_links(rows, got) <= sum(len(x) > 1 for x in plain.values()) + 1


def test_many_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 20)
    rows = [(None, "same")] * 300 + [(7, "twice")] * 100 + [(i, f"t{i}") for i in range(100)]
    check(rows, sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect(), 5)
