import hashlib
import random
import re

from quantaloom.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        if n:
            windows += [("" if item is None else str(item), w[i : i + n]) for i in range(len(w) - n + 1)]
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture():
    rng = random.Random(4)
    vocabulary = ["a", "B", "éß", "x1", "the", "Ünd", "-", "\n", "c's"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(12)] + [(90, "the"), (91, None), (92, "..."), (None, "x1 x1 x1"), (3, "b b"), (3, "b b")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(30)]
    for i in range(30, 60):
        passage = (rng.choice(items)[1] or "").upper()
        docs.append((i, f"{' '.join(rng.choices(vocabulary, k=rng.randint(0, 200)))} {passage}  q {passage[:50]}"))
    return [*docs, (60, None), (61, ""), (62, "!!"), (5, docs[5][1]), (63, "q " * 30_000 + (items[0][1] or "")), (64, "w" * 5000 + " the")], items


def test_against_brute_force(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, _n_words int, n_hit int")
    tests = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, contamination.report(frame, tests).collect()))
    assert got == sorted(brute(docs, items))


def test_blocks_and_keep(spark, monkeypatch):
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 400)
    want = sorted(brute(docs, items))
    assert sorted(map(tuple, contamination.report(frame, tests).collect())) == want
    clean = contamination.keep_clean(frame, tests)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in want if not r[-1])


def test_longest_matches(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"u v {passage} z"), (2, "u v")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, passage), (8, "u v")], "item_id long, text string")
    got = sorted(map(tuple, contamination.longest_matches(docs, tests).collect()))
    assert got == [(1, "7", 2, 0, 40), (1, "8", 0, 0, 2), (2, "8", 0, 0, 2)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tests = spark.createDataFrame([], "item_id long, text string")
    assert contamination.report(docs, tests).collect()[0]["contaminated"] is False
    assert contamination.report(docs.limit(0), tests).collect() == []


def test_names_clash(spark):
    docs, items = fixture()
    names = ["_n_words", "_spans", "_items", "_n_hit", "_contaminated", "_row", "n_words", "spans", "contaminated"]
    frame = spark.createDataFrame([(i, t, *range(len(names))) for i, t in docs], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    clean = contamination.keep_clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == frame.columns
    got = clean.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in brute(docs, items) if not r[-1])
    assert {tuple(r)[2:] for r in got} == {tuple(range(len(names)))}
