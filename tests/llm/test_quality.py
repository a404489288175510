import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quantaloom.llm import quality

WORD = re.compile("[^ \t-\r]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(6)
    out = [None, "", " \t\n\v\f\r ", "a", "# b\n# b\n\n\n # b", "é " * 19, "é " * 20, "x y z " * 7, "😀 " * 25]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "cc", "é", "#"]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))))
    block = " ".join(f"w{i}" for i in range(9))
    out += [f"{block} q {' '.join(f'u{i}' for i in range(k))} {block}" for k in range(0, 90, 7)]
    out.append(" ".join(str(i % 4999) for i in range(30_000)))
    return out


def test_measures_against_brute_force(spark):
    rows = [(i, t, "en", 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[12]], "doc_id long, text string, lang string, n_words int").repartition(8)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, quality.report(docs, labels).collect()))
    want = [(i, *brute(t), not brute(t)[-1]) for i, t, *_ in [*rows, rows[12]]]
    assert got == sorted(want)


def good(i):
    return " ".join(f"v{(i * 31 + j * j) % 977}" for j in range(40))


def test_cutoffs_hold_the_bound(spark):
    rows = [(i, good(i), "en") for i in range(1500)] + [(i, " ".join(w + "$$" for w in good(i).split()), "en") for i in range(1500, 1700)] + [(i, good(i) + " #", "xx") for i in range(1700, 1730)]
    docs = spark.createDataFrame([*rows, (9000, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(not 1500 <= i < 1700), 0) for i in range(1730)], "doc_id long, quality int, toxic int")
    measured = quality.measure(docs)
    cuts = {r["stratum"]: r for r in quality.cutoffs(measured, labels).collect()}
    assert cuts["en"]["_cut_symbols"] == min(quality.LADDERS["symbols"])
    assert cuts["xx"]["_cut_symbols"] is None  # 30 labels prove nothing
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(1500), *range(1700, 1730)]


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (200, 3, 0.02), (1000, 25, 0.01), (5, 5, 0.3), (0, 0, 0.1)])
def test_binomial_tail(spark, n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), F.lit(p)).alias("x")).first()["x"]
    assert got == pytest.approx(want, rel=1e-9)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.report(docs, labels).collect() == []
    one = spark.createDataFrame([(1, good(1), None)], docs.schema)
    assert quality.report(one, labels).first()["kept"] is True


def test_names_clash(spark):
    names = ["_kept", "_m_row", "_m_words", "_stratum", "_quality_n_words", "_row", "n_words", "_cut_symbols"]
    docs = spark.createDataFrame([(1, good(1), "en", *range(len(names))), (2, "short", "en", *range(len(names)))], f"doc_id long, text string, lang string, {', '.join(f'{n} long' for n in names)}")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, good(1), "en", *range(len(names)))]


def test_repeated_rows_are_one_trial(spark):
    rows = [(i, good(i), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    once, often = (quality.cutoffs(quality.measure(spark.createDataFrame(x, "doc_id long, text string, lang string")), labels).collect() for x in (rows, rows * 8))
    assert once == often and once[0]["_cut_symbols"] is None


def test_long_tail_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "TERMS", 7)
    test_binomial_tail(spark, 1000, 25, 0.01)
    test_binomial_tail(spark, 200, 3, 0.02)
