import random
import re

import numpy as np

from quantaloom.llm import neardup


def shingles(text):
    w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in rows), key=str)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}é" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.randint(3, 160)) for _ in range(40)]
    rows, n = [], 100
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(copy)))
            n -= 1 if n < 90 else -1
    rows = list({i: (i, t) for i, t in rows}.values())
    big = rng.choices(vocabulary, k=120)
    for i in range(1000, 1300):
        copy = list(big)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(i, "same text five words here") for i in range(2000, 2050)]
    return [*rows, (3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE two"), (3005, "two one"), (3006, "É a b c d"), (3007, "é a b c d"), (None, "one two"), (3008, " ".join(f"x{i}" for i in range(30_000))), (3009, " ".join(f"x{i}" for i in range(29_000)))]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, id string").repartition(5)
    got = sorted(map(tuple, neardup.decide(docs).collect()), key=str)
    assert got == brute(rows)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "STAR", 8)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in brute(rows) if r[3]), key=str)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.decide(docs).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert neardup.decide(docs.limit(0)).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85):
        both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        rest = [rng.integers(0, 2**63, (2000 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        a, b = neardup.signatures([np.concatenate([both, r]) for r in rest])
        assert abs((a == b).mean() - share) < 0.1


def test_recall_just_above_the_threshold():
    """Of 4000 pairs at a similarity of 0.85 to 0.87, next to all share a band and pass the screen."""
    rng = np.random.default_rng(21)
    found = passed = near = 0
    for _ in range(40):
        sets = []
        for _ in range(100):
            size = int(rng.integers(60, 400))
            only = int(size * 0.15 / 1.85)  # a pair of equal sets with so many own shingles each
            common = rng.integers(1, 2**63, size - only, dtype=np.uint64)
            sets += [np.unique(np.concatenate([common, rng.integers(1, 2**63, only, dtype=np.uint64)])) for _ in range(2)]
        signed = neardup.signatures(sets)
        bands = np.ascontiguousarray(signed[:, : neardup.BANDS * neardup.ROWS]).view(np.uint64)
        for i in range(0, len(sets), 2):
            both = len(np.intersect1d(sets[i], sets[i + 1]))
            similar = both / (len(sets[i]) + len(sets[i + 1]) - both)
            if 0.85 <= similar < 0.87:
                near += 1
                shared = bool((bands[i] == bands[i + 1]).any())
                found += shared
                passed += shared and (signed[i] == signed[i + 1]).sum() >= neardup.SCREEN * neardup.COORDINATES
    assert near > 2000 and passed >= found - 2 and found >= near - 1
