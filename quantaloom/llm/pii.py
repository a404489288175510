r"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are the fixed kinds email, ip, card and phone. Beyond them, corpus
co-occurrence estimates how strongly a term gives a protected entity (the value of a
base span) away: over all documents, n(t) documents hold term t, n(t, e) of them hold it
within CONTEXT code points of entity e, and the disclosure of e by t is
log2(p(e | t) / p(e)). A term counts if it stands beside one entity in at least
SUPPORT independent contexts, names it with p(e | t) >= SHARE and discloses at least
BITS; all counts are of documents, so entities that stand together do not compete. Contexts are as many as
the different companies of the term beside the entity, so a group of copies is one context
and takes nothing from the others; a near copy is one more only where it changes the
term's company. Such terms are spans of kind `term` wherever they occur.

Sanitising generalises a term to its longest prefix that discloses no entity beyond the
thresholds (written `pre*`), and removes it if there is none; the other spans become
their kind in brackets. Overlapping spans merge into one under the first.

Patterns are written so that Java's matcher neither recurses nor rescans: runs
are possessive, and a match starts a run or where the last match ended, which
changes no leftmost match. Offsets are code points, ends exclusive.

Null and empty texts have no spans. Repeated rows and equal texts have equal
spans; each row is returned. Extra columns, whatever their names, stay in what `sanitise` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.llm._rows import ROW, unwrapped, wrapped
from quantaloom.runtime import save

CONTEXT = 60
SUPPORT = 2
SHARE = 0.5
BITS = 4.0
#: Up to so many disclosing terms stand as a set in the expression; more are joined by a shuffle.
BROADCAST_TERMS = 20_000

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: kind -> (cheap test, pattern)
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*PATTERNS, "term"]
_WORD = r"\p{L}++"
_SPANS = "array<struct<s:long,k:int,e:long>>"
_TERMS = "array<struct<term:string,keep:int>>"
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(numbers: Column) -> Column:
    """Sums of all earlier elements, by blocks: no step copies more than a block or the list of blocks."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def scan(part: Column) -> Column:
        start = F.struct(zero.alias("t"), none.alias("o"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["o"], F.array(a["t"])).alias("o")))

    def whole(all_of: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(all_of) - 1).cast("int"), F.lit(0)), F.lit(_BLOCK)), lambda i: scan(F.slice(all_of, i + 1, _BLOCK)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, lambda x: x["t"]))["o"], lambda x, before: F.transform(x["o"], lambda y: y + before))))

    return _let(numbers, whole)


def _found(text: Column, pattern: str) -> Column:
    """Every match as struct(s, hit), s its start in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(both: Column) -> Column:
        sizes = F.flatten(F.zip_with(both["g"], both["h"], lambda g, h: F.array(F.length(g).cast("long"), F.coalesce(F.length(h), F.lit(0)).cast("long"))))
        starts = _running(sizes)
        return _let(starts, lambda at: F.filter(F.transform(both["h"], lambda h, i: F.struct(F.get(at, 2 * i + 1).alias("s"), h.alias("hit"))), lambda x: x["hit"].isNotNull()))

    return _let(F.struct(gaps.alias("g"), hits.alias("h")), place)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """14 to 19 digits whose Luhn sum ends in 0."""

    def total(digits: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int")
            return a + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        size = F.length(digits)
        return F.when(size.between(14, 19), F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return _let(F.reverse(_digits(hit)), total)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _kind(text: Column, kind: str) -> Column:
    cheap, pattern = PATTERNS[kind]
    present = text.contains(cheap) if kind == "email" else text.rlike(cheap)
    spans = F.transform(
        F.filter(_found(text, pattern), lambda x: _valid(kind, x["hit"])),
        lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), (x["s"] + F.length(x["hit"])).cast("long").alias("e")),
    )
    return F.when(present, spans).otherwise(F.array().cast(_SPANS))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _based(docs: DataFrame) -> DataFrame:
    """docs with the base spans of each kind (_b_kind) and all of them in order (_b_all)."""
    out = docs.withColumns({f"_b_{kind}": _kind(_text(), kind) for kind in PATTERNS})
    return out.withColumn("_b_all", F.sort_array(F.concat(*(F.col(f"_b_{kind}") for kind in PATTERNS))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]++"), lambda x: F.length(x) >= 3))


def _company(context: Column) -> Column:
    """Each term of a context with its company: a hash of the two other terms of least hash.

    Near copies of one text mostly keep a term's company, independent texts do not.
    """

    def with_company(terms: Column) -> Column:
        ranked = F.sort_array(F.transform(terms, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("term"))))
        few = F.slice(ranked, 1, 3)
        return _let(few, lambda low: F.transform(terms, lambda x: F.struct(x.alias("term"), F.xxhash64(F.transform(F.slice(F.filter(low, lambda y: y["term"] != x), 1, 2), lambda y: y["term"])).alias("company"))))

    return _let(_terms(context), with_company)


def _frequencies(docs: DataFrame) -> DataFrame:
    """How many documents hold each term: partial counts meet, never the texts."""
    return docs.select(F.explode(_terms(_text())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """The terms that give an entity away: term, entity, n_both, n_term, bits, keep. Counts cover all documents."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    # Contexts of entities first: one row for each place of an entity, under its document's number.
    spans = _based(docs).where(F.size("_b_all") > 0)
    text = _text()

    def around(x: Column) -> Column:
        low = F.greatest(x["s"] - F.lit(CONTEXT), F.lit(0)).cast("int")
        before = F.substring(text, low + 1, (x["s"] - low).cast("int"))
        after = F.substring(text, (x["e"] + 1).cast("int"), F.lit(CONTEXT))
        # a term cut by the window's edge is no term
        before = F.when(low > 0, F.regexp_replace(before, r"^\p{L}++", "")).otherwise(before)
        after = F.when(x["e"] + CONTEXT < F.length(text), F.regexp_replace(after, r"(?<!\p{L})\p{L}++$", "")).otherwise(after)
        entity = F.lower(F.substring(text, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")))
        return F.struct(entity.alias("entity"), F.concat_ws(" ", before, after).alias("context"))

    # numbered below the explode, where a row is a document, and saved, so that all counts see the same numbers
    numbered = spans.select(F.monotonically_increasing_id().alias("doc"), F.transform(F.col("_b_all"), around).alias("_c"))
    beside = save(numbered.select("doc", F.explode("_c").alias("c")).select("doc", "c.entity", "c.context"))
    pairs = beside.select("doc", "entity", F.explode(_company(F.col("context"))).alias("t")).select("doc", "entity", "t.term", "t.company")
    # distinct rows are counted by partial aggregates, so hot entities and terms meet no single task
    both = pairs.groupBy("entity", "term").agg(F.count_distinct("doc").alias("n_both"), F.count_distinct("company").alias("contexts"))
    candidates = save(both.where(F.col("contexts") >= support).drop("contexts"))
    none = "term string, entity string, n_both long, n_term long, bits double, keep int"
    if candidates.isEmpty():
        return docs.sparkSession.createDataFrame([], none)
    known = save(_frequencies(docs))
    held = beside.select("doc", "entity").join(candidates.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.count_distinct("doc").alias("n_entity"))
    n_all = F.lit(docs.count())
    p = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))
    strength = F.log2(p * n_all / F.col("n_entity"))
    rated = candidates.join(known, "term").join(held, "entity").withColumn("bits", strength).where((p >= share) & (F.col("bits") >= bits))
    rated = save(rated)
    # A prefix names at least the documents of its most frequent term, so it discloses an entity by these shares at most.
    starts = rated.groupBy("term").agg(F.max("n_entity").alias("n_entity")).withColumn("size", F.explode(F.sequence(F.lit(1), F.length("term") - 1)))
    starts = starts.withColumn("start", F.substring(F.col("term"), F.lit(1), F.col("size")))
    every = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substring(F.col("term"), F.lit(1), i))).alias("start"), "n_term")
    common = every.groupBy("start").agg(F.max("n_term").alias("n_start"))
    general = starts.join(common, "start").where((F.col("n_entity") < F.lit(share) * F.col("n_start")) & (F.log2(n_all / F.col("n_start")) < bits))
    kept = general.groupBy("term").agg(F.max("size").alias("keep"))
    return rated.join(kept, "term", "left").select("term", "entity", "n_both", "n_term", "bits", F.coalesce("keep", F.lit(0)).cast("int").alias("keep"))


def _marked(docs: DataFrame) -> DataFrame:
    """Wrapped docs with base spans, `_t` (their disclosing terms, and how many letters of each stay) and `_spans`."""
    terms = save(disclosing(docs).groupBy("term").agg(F.min("keep").alias("keep")))
    rows = wrapped(docs, text=F.col("text").cast("string"))
    few = terms.limit(BROADCAST_TERMS + 1).collect()
    if len(few) <= BROADCAST_TERMS:
        # the terms are a set of bounded size inside the expression: no text moves
        sizes = sorted({r["keep"] for r in few})
        sets = [(n, [r["term"] for r in few if r["keep"] == n]) for n in sizes]

        def lookup(term: Column) -> Column:
            return F.coalesce(*(F.when(term.isin(own), F.lit(n)) for n, own in sets)) if sets else F.lit(None).cast("int")

        own = F.filter(F.transform(_terms(_text()), lambda x: F.struct(x.alias("term"), lookup(x).alias("keep"))), lambda x: x["keep"].isNotNull())
        out = rows.withColumn("_t", own if sets else F.array().cast(_TERMS))
    else:
        rows = rows.withColumn("_h", F.sha2("text", 256))
        held = rows.select("_h", F.explode(_terms(_text())).alias("term")).distinct().join(terms, "term").groupBy("_h").agg(F.collect_list(F.struct("term", "keep")).alias("_t"))
        out = rows.join(held, "_h", "left").withColumn("_t", F.coalesce("_t", F.array().cast(_TERMS)))
    places = F.transform(_found(_text(), _WORD), lambda x: F.struct(x["s"].alias("s"), x["hit"].alias("hit"), F.get(F.filter("_t", lambda t: t["term"] == F.lower(x["hit"])), F.lit(0)).alias("t")))
    spans = F.transform(F.filter(places, lambda x: x["t"].isNotNull()), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("term")).alias("k"), (x["s"] + F.length(x["hit"])).cast("long").alias("e"), x["t"]["keep"].alias("keep")))
    base = F.transform("_b_all", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(0).alias("keep")))
    return _based(out).withColumn("_spans", F.when(F.size("_t") > 0, F.sort_array(F.concat(base, spans))).otherwise(base))


def report(docs: DataFrame) -> DataFrame:
    """Per document: base counts and digest, and all spans."""
    out = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select(
        F.col(ROW).getField("doc_id").alias("doc_id"),
        *(F.size(f"_b_{kind}").cast("long").alias(f"n_{kind}") for kind in PATTERNS),
        F.sha2(_listed(F.col("_b_all")), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
    )


def _cleaned(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first, or by what is kept of a term."""
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))

    def instead(x: Column) -> Column:
        start = F.substring(text, (x["s"] + 1).cast("int"), x["keep"])
        return F.when(x["keep"] > 0, F.concat(start, F.lit("*"))).otherwise(F.get(names, x["k"]))

    def block(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(x["s"] - a["at"], F.lit(0)).cast("int"))
            covered = (x["s"] < a["at"]) & (a["out"] != "")
            return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(covered, a["out"]).otherwise(F.concat(a["out"], gap, instead(x))).alias("out"))

        return F.aggregate(part, start, step)

    done = block(spans)
    return _let(done, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets, or by a general prefix of the term; all columns stay."""
    out = _marked(docs)
    text = F.when(F.size("_spans") > 0, _cleaned(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return unwrapped(out, docs.columns, text=text)
