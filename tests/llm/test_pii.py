import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex
import xxhash

from quantaloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(spans)


def row(doc_id, text):
    spans = brute(text)
    listed = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)
    return doc_id, *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f-g", "@", ".", "1.2.3.4", "300.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+4", "é😀", " ", "\n", "%", "-", "7", "55", "x.y", "1.2"]
    out = [None, "", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "1" * 14, "0" * 16, "😀 +1 (555) 010-2030."]
    out += ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(600)]
    out += ["9" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "x." * 20_000 + "@b" + ".c" * 20_000, "1.2.3.4 é " * 3_000, "+1 " + "(" * 30_000]
    return out


def test_base_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "a@b.c")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int").repartition(6)
    got = {r["doc_id"]: r for r in pii._based(docs).select("doc_id", "_b_all").collect() if r["doc_id"] != 3}
    for doc_id, text in rows:
        if doc_id != 3:
            assert [tuple(x) for x in got[doc_id]["_b_all"]] == brute(text), text
    few = [x for x in rows if x[0] < 40 or x[0] > 605]
    out = pii.report(spark.createDataFrame(few, "doc_id long, text string"))
    want = sorted(row(*x) for x in few)
    assert [tuple(x)[:-1] for x in sorted(map(tuple, out.collect()))] == [x[:-1] for x in want]


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("ana", "eve", "ilo", "oru")]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(200)]
    for i in range(200, 206):
        rows.append((i, f"{' '.join(rng.choices(words, k=10))} Zebulon wrote zeb@x.org {' '.join(rng.choices(words, k=10))}"))
    copied = f"{' '.join(rng.choices(words, k=10))} Quixote asked qui@x.org {' '.join(rng.choices(words, k=10))}"
    rows += [(210 + i, copied + f" {words[i]}") for i in range(20)]  # near copies are one context
    return [*rows, (300, "only zebulon here"), (301, None)]


def test_terms_disclose(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing(docs).collect()}
    assert {"zebulon", "wrote"} <= terms and not terms & {"quixote", "asked"}, terms
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[300] == "only [TERM] here" and clean[301] is None
    assert "[TERM] [TERM] [EMAIL]" in clean[200] and len(clean) == len(corpus())
    spans = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert spans[300]["spans"] == "term:5:12" and spans[300]["n_email"] == 0
    s = spans[200]["spans"].split(",")
    assert len(s) >= 3 and s[2].startswith("email:") and spans[200]["base_sha256"] == hashlib.sha256(s[2].encode()).hexdigest()


def test_copies_take_no_support(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("ana", "eve", "ilo", "oru")]
    some = lambda: " ".join(rng.choices(words, k=8))
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(1200)]
    texts += [f"{some()} Ottoline asked ott@x.org {some()}"] * 50
    texts += [f"{some()} Ottoline ott@x.org {some()}" for _ in range(10)]
    texts += [f"{some()} Peregrine asked per@x.org {some()}"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing(docs).collect()}
    assert "ottoline" in terms and "peregrine" not in terms, terms


def test_entities_together_do_not_compete(spark):
    rng = random.Random(10)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("ana", "eve", "ilo", "oru")]
    some = lambda: " ".join(rng.choices(words, k=8))
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(400)]
    signed = "Marlowe mar@x.org +1 (555) 010-2030, 4111 1111 1111 1111"
    texts += [f"{some()} {signed} {some()}" for _ in range(10)]
    # places are not documents: three in one document name an entity once
    texts += [f"{some()} Isolde iso@x.org, Isolde iso@x.org, Isolde iso@x.org {some()}" for _ in range(4)] + [f"{some()} Isolde {some()}" for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["term"], r["entity"]): r for r in pii.disclosing(docs).collect() if r["term"] in ("marlowe", "isolde")}
    assert set(found) == {("marlowe", x) for x in ("mar@x.org", "+1 (555) 010-2030", "4111 1111 1111 1111")}, found
    assert all(r["n_both"] == r["n_term"] == 10 for r in found.values()), found


def test_sanitise_overlaps(spark):
    rows = [(1, "x 4111 1111 1111 1111 y 1.2.3.4", "k"), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    assert pii.sanitise(docs).columns == docs.columns
    got = sorted((r["doc_id"], r["text"]) for r in pii.sanitise(docs).collect())
    assert got == [(1, "x [CARD] y [IP]"), (2, ""), (2, "")]
    assert pii.report(docs.limit(0)).collect() == []


def _signed(term):
    value = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def _split(text):
    found = [x for x in regex.split(r"[^\p{L}]+", text.lower()) if len(x) >= 3]
    return list(dict.fromkeys(found))


def brute_disclosing(texts):
    """Every (term, entity) with its counts and what of the term is kept, by plain counting."""
    both, companies, entity_docs, term_docs = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for doc, text in enumerate(texts):
        text = text or ""
        for term in _split(text):
            term_docs[term].add(doc)
        for s, _, e in brute(text):
            entity = text[s:e].lower()
            entity_docs[entity].add(doc)
            low = max(s - pii.CONTEXT, 0)
            before, after = text[low:s], text[e : e + pii.CONTEXT]
            before = regex.sub(r"^\p{L}+", "", before) if low else before
            after = regex.sub(r"(?<!\p{L})\p{L}+$", "", after) if e + pii.CONTEXT < len(text) else after
            terms = _split(f"{before} {after}")
            for term in terms:
                others = sorted((x for x in terms if x != term), key=_signed)[:2]
                both[term, entity].add(doc)
                companies[term, entity].add(tuple(others))
    out = {}
    for (term, entity), docs in both.items():
        p = min(len(docs) / len(term_docs[term]), 1)
        bits = math.log2(p * len(texts) / len(entity_docs[entity]))
        if len(companies[term, entity]) >= pii.SUPPORT and p >= pii.SHARE and bits >= pii.BITS:
            out[term, entity] = (len(docs), len(term_docs[term]), round(bits, 6))
    keep = {}
    for term in {t for t, _ in out}:
        most = max(len(entity_docs[e]) for t, e in out if t == term)
        sizes = [i for i in range(1, len(term)) if (top := max(len(d) for x, d in term_docs.items() if len(x) > i and x.startswith(term[:i]))) * pii.SHARE > most and math.log2(len(texts) / top) < pii.BITS]
        keep[term] = max(sizes, default=0)
    return {(*k, *v, keep[k[0]]) for k, v in out.items()}


def crowd():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("ana", "eve", "ilo", "oru")]
    some = lambda n: " ".join(rng.choices(words, k=n))
    texts = [some(rng.randint(0, 60)) for _ in range(300)]
    for i in range(12):
        name, mail = (f"Person{chr(97 + i)}x" if i % 2 else f"Zy{chr(97 + i)}q"), f"p{i}@x.org"
        texts += [f"{some(rng.randint(0, 15))} {name} {rng.choice(['met', 'asked', ''])} {mail}, +1 (555) 010-20{i:02} {some(rng.randint(0, 15))}" for _ in range(rng.randint(1, 6))]
        texts += [f"{some(3)} {name} again"] * rng.randint(0, 3)
    # every other document has a word that begins like one disclosing name
    texts += [f"persona {some(5)}" for _ in range(120)] + [None, "", texts[310]]
    return texts


@pytest.mark.parametrize("few", [True, False])
def test_disclosing_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(pii, "BROADCAST_TERMS", 1)
    texts = crowd()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["term"], r["entity"], r["n_both"], r["n_term"], round(r["bits"], 6), r["keep"]) for r in pii.disclosing(docs).collect()}
    want = brute_disclosing(texts)
    assert got == want and len({w[0] for w in want}) > 5 and {w[-1] for w in want} > {0}
    keep = {w[0]: min(x[-1] for x in want if x[0] == w[0]) for w in want}
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, text in enumerate(texts):
        own = [(m.start(), m.end()) for m in regex.finditer(r"\p{L}+", text or "") if m[0].lower() in keep]
        terms = [x for x in spans[i].split(",") if x.startswith("term:")]
        assert terms == [f"term:{s}:{e}" for s, e in own]
        if text and not brute(text):
            assert clean[i] == regex.sub(r"\p{L}+", lambda m: m[0] if m[0].lower() not in keep else f"{m[0][: keep[m[0].lower()]]}*" if keep[m[0].lower()] else "[TERM]", text)


def test_names_clash(spark):
    names = ["_h", "_t", "_spans", "_row", "_b_all", "_b_email", "term", "keep", "n_term"]
    texts = crowd()
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(texts)], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    plain = {r["doc_id"]: r["text"] for r in pii.sanitise(docs.select("doc_id", "text")).collect()}
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert tuple(r)[2:] == tuple(range(len(names))) and r["text"] == plain[r["doc_id"]]
