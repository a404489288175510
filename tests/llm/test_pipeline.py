import hashlib
import random

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from test_contamination import brute as contaminated
from test_neardup import brute as grouped
from test_pii import brute as spans
from test_quality import brute as measured

from quantaloom.llm.bpe import load_ranks


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(900)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(prose(30))) for i in range(5)]
    rows = []
    for i in range(60):
        w = prose(rng.randint(5, 90))
        if i % 7 == 0:
            w.insert(3, f"joe{i}@mail.org")
        if i % 9 == 0:
            w = w + items[i % 5][1].split()
        rows.append((i, " ".join(w)))
    for i in range(60, 80):
        w = rows[i % 25][1].split()
        w[-1] = "other"
        rows.append((i, " ".join(w)))
    return [*rows, (80, None), (81, ""), (82, "x " * 100)], items


def test_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [(i, t) for i, t in rows if not measured(t)[-1]]  # ten labels prove no cutoff
    kept = {r[0] for r in grouped(left) if r[3]}
    left = [(i, t) for i, t in left if i in kept]
    clean = {r[0] for r in contaminated(left, items) if not r[-1]}
    left = [(i, t) for i, t in left if i in clean]
    assert 10 < len(left) < len(kept) < 60
    kinds = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in left:
        for s, k, e in reversed(spans(t)):
            t = t[:s] + kinds[k] + t[e:]
        ids = other.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(want)


def test_stages_keep_columns_and_empty_input(spark, tmp_path):
    _, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        if name != "encoding":
            assert out.columns == docs.columns
