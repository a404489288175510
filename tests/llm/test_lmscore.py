import math
import random
import re
from collections import Counter

import pytest

from quantaloom.llm import lmscore

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, target, weight=lmscore.LAMBDA):
    docs = [(i, split(t)) for i, t in rows]
    models = []
    for inside in (lambda i: i in target, lambda i: True):
        one, two = Counter(), Counter()
        for i, w in docs:
            if inside(i):
                one.update(w)
                two.update(zip(w, w[1:], strict=False))
        models.append((inside, one, two))
    v = len(models[1][1])
    for i, w in docs:
        own1, own2 = Counter(w), Counter(zip(w, w[1:], strict=False))
        losses = []
        for inside, one, two in models:
            k = int(inside(i))
            n = sum(one.values()) - k * len(w)
            loss = 0.0
            for j, x in enumerate(w):
                p = (one[x] - k * own1[x] + 1) / (n + v)
                if j and (h := one[w[j - 1]] - k * own1[w[j - 1]]) > 0:
                    p = weight * max(two[w[j - 1], x] - k * own2[w[j - 1], x], 0) / h + (1 - weight) * p
                loss -= math.log(p)
            losses.append(loss / max(len(w), 1))
        yield i, len(w), *losses, losses[0] - losses[1]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lmscore, "portion", lambda total, least: 1500)
    rng = random.Random(7)
    vocabulary = [f"W{i}é" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(150)] + [(500, None), (501, ""), (502, "W1é"), (3, "w1é w2é"), (None, "w1é w1é w1é")]
    target = {i for i in range(0, 150, 4)} | {502}
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, shard int, chosen boolean")
    chosen = spark.createDataFrame([(i,) for i in [*target, None, 9999, 4]], "doc_id long")
    got = sorted(map(tuple, lmscore.score(docs, chosen).collect()), key=str)
    want = sorted(brute(rows, target), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices((a, b)[i % 2] + a[:20] + b[:20], k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, chosen).collect()}
    held = range(200, 400)
    assert sum((got[i] < 0) == (i % 2 == 0) for i in held) / len(held) > 0.97


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "doc_id long")
    assert lmscore.score(docs, target).collect() == []
    one = spark.createDataFrame([(1, "a b")], docs.schema)
    assert lmscore.score(one, target).first()["n_tokens"] == 2
