"""Risk-controlled quality rules, in DataFrame functions only.

Every text is measured once. A document fails the base rules if it has under 20
words or more than 30 % of its words lie in repeated 8-word windows. Beyond
these, each rule rejects documents whose measure exceeds a cutoff. Cutoffs are
chosen per stratum (language) on the labelled holdout: a ladder of cutoffs is
walked from the mildest to the harshest, and a cutoff stands while the exact
binomial test rejects "more than ALPHA / rules of the good documents would be
lost". The walk ends at its first failure (fixed-sequence testing, so the ladder
needs no correction); strata times rules are corrected by Bonferroni. All rules
together then lose at most ALPHA of a stratum's good documents with confidence
1 - DELTA. A stratum with too few good labels gets no cutoff, so nothing more is
rejected there.

Null and empty texts have no words and fail. A null language is the stratum ''.
Several labels of one document count as its lowest quality; null labels are
ignored. Repeated document rows are judged one by one, and count once, with their highest
measures, where cutoffs are chosen. Extra columns, whatever their names, stay in what `keep_good` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantaloom.llm._rows import unwrapped, wrapped
from quantaloom.runtime import cut, save

#: Share of a stratum's good documents that all rules together may reject, and the risk of being wrong.
ALPHA, DELTA = 0.03, 0.05
#: Strata beyond so many are joined by a shuffle and not by a broadcast.
BROADCAST_STRATA = 10_000
#: Terms of a binomial tail that are listed at once.
TERMS = 100_000

SPACE = r"[ \t-\r]"
WINDOW = 8

#: Rule -> its cutoffs from the mildest to the harshest; a document above the cutoff is rejected.
LADDERS = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_lines": [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5],
    "shouting": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
}


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _joined(hashes: Column, by: int) -> Column:
    """Element i joined with element i + by; as many fewer elements."""
    n = F.greatest(F.size(hashes) - F.lit(by), F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_OWN = ["_m_words", "_m_lines", "_m_hash", "_m_two", "_m_four", "_m_eight", "_m_sorted", "_m_starts"]


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the five measures (and prefix + n_lines, n_upper) of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns(
        {
            "_m_words": F.filter(F.split(text, SPACE + "+"), lambda x: x != ""),
            "_m_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]")),
        }
    )
    out = out.withColumn("_m_hash", F.transform("_m_words", lambda x: F.xxhash64(x)))
    for source, target, by in (("_m_hash", "_m_two", 1), ("_m_two", "_m_four", 2), ("_m_four", "_m_eight", 4)):
        out = out.withColumn(target, _joined(F.col(source), by))
    eight = F.col("_m_eight")
    # most texts repeat no window: only the others are sorted
    out = out.withColumn(
        "_m_sorted",
        F.when(F.size(F.array_distinct(eight)) < F.size(eight), F.sort_array(F.transform(eight, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    more = F.size("_m_sorted") - 1
    twins = F.zip_with(F.slice("_m_sorted", F.lit(1), more), F.slice("_m_sorted", F.lit(2), more), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("_m_starts", F.when(F.col("_m_sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))))
    starts, rest = F.col("_m_starts"), F.size("_m_starts") - 1
    covered = F.zip_with(F.slice(starts, F.lit(1), rest), F.slice(starts, F.lit(2), rest), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    return out.withColumns(
        {
            f"{prefix}n_words": F.size("_m_words").cast("long"),
            f"{prefix}word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            f"{prefix}n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            f"{prefix}n_dup_lines": (F.size("_m_lines") - F.size(F.array_distinct("_m_lines"))).cast("long"),
            f"{prefix}n_repeat_words": F.when(F.size(starts) > 0, _sum(covered) + F.lit(WINDOW)).otherwise(F.lit(0)).cast("long"),
            f"{prefix}n_lines": F.size("_m_lines").cast("long"),
            f"{prefix}n_upper": F.regexp_count(text, F.lit(r"[A-Z!]{2}")).cast("long"),
        }
    ).drop(*_OWN)


def _failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 20) | (F.lit(100) * F.col(f"{prefix}n_repeat_words") > F.lit(30) * words)


def _rules(prefix: str = "") -> dict[str, Column]:
    col = lambda name: F.col(prefix + name)
    return {
        "symbols": _ratio(col("n_symbols"), col("word_chars")),
        "dup_lines": _ratio(col("n_dup_lines"), col("n_lines")),
        "shouting": _ratio(col("n_upper"), col("word_chars")),
    }


def binomial_tail(lost: Column, good: Column, rate: Column) -> Column:
    """P(X <= lost) for X ~ Binomial(good, rate), by the logarithms of all its terms, TERMS of them at a time.

    Far above the mean the tail is 1 to the last digit and its terms are not summed.
    """
    odds = F.log(rate / (F.lit(1.0) - rate))
    start = F.struct((good * F.log1p(-rate)).alias("t"), (good * F.log1p(-rate)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((good - i + 1) / i) + odds
        top = F.greatest(t, a["s"])
        return F.struct(t.alias("t"), (top + F.log(F.exp(t - top) + F.exp(a["s"] - top))).alias("s"))

    def block(a: Column, low: Column) -> Column:
        return F.aggregate(F.sequence(low, F.least(low + (TERMS - 1), lost)), a, step)

    blocks = F.sequence(F.lit(1).cast("long"), F.greatest(lost, F.lit(1)), F.lit(TERMS).cast("long"))
    tail = F.exp(F.when(lost < 1, start["s"]).otherwise(F.aggregate(blocks, start, block)["s"]))
    return F.when((good <= 0) | (lost > 4 * good * rate + 100), F.lit(1.0)).otherwise(tail)


def cutoffs(measured: DataFrame, labels: DataFrame, prefix: str = "", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Stratum -> one cutoff per rule (null: none is safe), from documents with measures and labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    rows = measured.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), _failed(prefix).alias("failed"), *(v.alias(k) for k, v in _rules(prefix).items()))
    # a document is one trial however often its row stands there
    rows = rows.join(known.where("_quality = 1"), "doc_id").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.bool_or("failed").alias("failed"), *(F.max(rule).alias(rule) for rule in LADDERS))
    good = rows.where("not failed")
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *(F.count_if(F.col(rule) > level).alias(f"{rule}_{i}") for rule, ladder in LADDERS.items() for i, level in enumerate(ladder)))
    strata = F.count(F.lit(1)).over(_everything())
    counts = counts.withColumn("strata", strata)
    rate = F.lit(alpha / len(LADDERS))
    risk = F.lit(delta) / (F.col("strata") * len(LADDERS))
    chosen = []
    for rule, ladder in LADDERS.items():
        safe = F.array(*(binomial_tail(F.col(f"{rule}_{i}"), F.col("good"), rate) <= risk for i in range(len(ladder))))
        steps = F.coalesce(F.nullif(F.array_position(safe, False), F.lit(0)) - 1, F.lit(len(ladder)))
        chosen.append(F.when(steps > 0, F.get(F.array(*map(F.lit, ladder)), (steps - 1).cast("int"))).alias(f"_cut_{rule}"))
    return counts.select("stratum", *chosen)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def _judged(measured: DataFrame, chosen: DataFrame, prefix: str = "") -> DataFrame:
    """measured with _kept."""
    rows = chosen.limit(BROADCAST_STRATA + 1).collect()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in chosen.schema])
    small = F.broadcast(chosen.sparkSession.createDataFrame(rows, schema)) if len(rows) <= BROADCAST_STRATA else chosen
    joined = measured.withColumn("_stratum", F.coalesce(F.col("lang"), F.lit(""))).join(small.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    above = [F.coalesce(value > F.col(f"_cut_{rule}"), F.lit(False)) for rule, value in _rules(prefix).items()]
    rejected = _failed(prefix)
    for one in above:
        rejected = rejected | one
    return joined.withColumn("_kept", ~rejected).drop("_stratum", *(f"_cut_{rule}" for rule in LADDERS))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the measures, the base verdict and the final one."""
    measured = cut(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")).drop("text"))
    judged = _judged(measured, cutoffs(measured, labels))
    return judged.select("doc_id", *MEASURES, _failed().alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured once and written beside their measures."""
    measured = save(measure(wrapped(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"), lang=F.col("lang"))).drop("text"))
    return unwrapped(_judged(measured, cutoffs(measured, labels)).where("_kept"), docs.columns)
