"""Error, divergence and perplexity measures over arrays and joins of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.runtime import cut

FLOOR = 1e-12


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def weighted(x: Column, g: Column) -> Column:
    """sum of max(g, 1e-12) x^2 with g repeated along x; x and g are arrays of double."""
    return _sum(F.transform(x, lambda v, i: F.greatest(F.get(g, i % F.size(g)), F.lit(FLOOR)) * v * v))


def proxy_cost(coded: DataFrame, imatrix: DataFrame | None = None) -> DataFrame:
    """tensor, energy, err, cost_abs, cost_rel of round trips (tensor, row, e), weighted by channel where an imatrix (tensor, g) is known.

    Absolute cost is the weighted squared error, relative cost the root of its share of the weighted energy.
    """
    rows = coded.select("tensor", F.transform("e", lambda y: y["x"].cast("double")).alias("x"), F.transform("e", lambda y: y["x"].cast("double") - y["v"].cast("double")).alias("d"))
    ones = F.array(F.lit(1.0))
    g = ones if imatrix is None else F.coalesce("g", ones)
    joined = rows if imatrix is None else rows.join(imatrix.select("tensor", "g"), "tensor", "left")
    sums = joined.select("tensor", weighted(F.col("x"), g).alias("energy"), weighted(F.col("d"), g).alias("err"))
    out = sums.groupBy("tensor").agg(F.greatest(F.sum("energy"), F.lit(FLOOR)).alias("energy"), F.sum("err").alias("err"))
    return out.withColumns({"cost_abs": F.col("err"), "cost_rel": F.sqrt(F.col("err") / F.col("energy"))})


def log_sum_exp(x: Column) -> Column:
    """Shifted by the largest; minus infinity if that is not finite."""
    top = F.array_max(x)
    return F.when(F.abs(top) == float("inf"), F.lit(float("-inf"))).otherwise(top + F.log(_sum(F.transform(x, lambda v: F.exp(v - F.array_max(x))))))


def log_softmax(x: Column) -> Column:
    return _let(log_sum_exp(x), lambda s: F.transform(x, lambda v: v - s))


def kl(p: Column, q: Column) -> Column:
    """KL of two arrays of log probabilities, at least 0."""
    return F.greatest(_sum(F.zip_with(p, q, lambda a, b: F.when(F.exp(a) > 0, F.exp(a) * (a - b)).otherwise(F.lit(0.0)))), F.lit(0.0))


def argmax(x: Column) -> Column:
    """Place of the largest value, the first on a tie, from 0."""
    return F.array_position(x, F.array_max(x)) - 1


def paired(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Captures (pos, target, logits) joined by position; different sizes are errors raised in the plan."""
    joined = ref.select("pos", "target", F.col("logits").alias("r")).join(cand.select("pos", F.col("target").alias("ctarget"), F.col("logits").alias("c")), "pos", "full_outer")
    odd = F.col("r").isNull() | F.col("c").isNull() | (F.size("r") != F.size("c"))
    return joined.withColumn("r", F.when(odd, F.raise_error(F.lit("captures differ in rows or vocabulary")).cast("array<double>")).otherwise(F.col("r")))


def divergence(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """pos, kl, same_top, lp_ref, lp_cand (log probabilities of a target that both rows name)."""
    both = paired(ref, cand).select("pos", "target", "ctarget", log_softmax(F.col("r").cast("array<double>")).alias("p"), log_softmax(F.col("c").cast("array<double>")).alias("q"))
    named = F.col("target").isNotNull() & F.col("ctarget").isNotNull()
    at = lambda a: F.when(named, F.get(a, F.col("target")))
    return both.select("pos", kl(F.col("p"), F.col("q")).alias("kl"), (argmax(F.col("p")) == argmax(F.col("q"))).alias("same_top"), at(F.col("p")).alias("lp_ref"), at(F.col("q")).alias("lp_cand"))


def sparse_kl(ref: DataFrame, cand: DataFrame, vocab: int) -> DataFrame:
    """KL of top-k captures (pos, ids, logits, lse): an id that one side lacks has an even share of its tail."""
    tiny = F.lit(2.2250738585072014e-308)

    def tail(lp: Column) -> Column:
        return F.greatest((F.lit(1.0) - _sum(F.transform(lp, F.exp))) / F.greatest(F.lit(vocab) - F.size(lp), F.lit(1)), tiny)

    joined = ref.select("pos", F.col("ids").alias("ri"), F.transform("logits", lambda x: x - F.col("lse")).alias("rl")).join(cand.select("pos", F.col("ids").alias("ci"), F.transform("logits", lambda x: x - F.col("lse")).alias("cl")), "pos")
    table = joined.withColumn("m", F.map_from_arrays("ci", "cl"))
    other = lambda i: F.coalesce(F.try_element_at("m", i), F.log(tail(F.col("cl"))))
    total = _sum(F.zip_with("ri", "rl", lambda i, lp: F.exp(lp) * (lp - other(i))))
    # reference ids are its k largest; what it lacks is left out on its side
    return table.select("pos", F.greatest(total, F.lit(0.0)).alias("kl"))


def top_k(capture: DataFrame, k: int) -> DataFrame:
    """The k largest logits of each row (smaller id on a tie) and the full log-sum-exp."""
    pairs = F.transform(F.col("logits").cast("array<double>"), lambda v, i: F.struct((-v).alias("v"), i.alias("id")))
    kept = capture.select("pos", "target", F.slice(F.array_sort(pairs), 1, k).alias("t"), log_sum_exp(F.col("logits").cast("array<double>")).alias("lse"))
    return kept.select("pos", "target", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: -x["v"]).alias("logits"), "lse")


#: Half the band of ranks around a quantile that is looked at exactly.
BAND = 0.002
#: Groups up to so many are broadcast to their rows (some 100 bytes each), more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def _beside(rows: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with the columns of their group; groups is materialised, so counting it reads no rows again."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups.hint("merge"), list(by))


def quantiles(rows: DataFrame, value: str, points: dict[str, float], *by: str) -> DataFrame:
    """Exact nearest-rank quantiles (rank round((n - 1) q), halves up) by group, one column per point.

    A sketch bounds each quantile by a narrow band; rows under the band are counted, and only those
    inside it, some thousandths of a group, are ranked. No group is sorted or gathered as a whole.
    """
    from pyspark.sql import Window

    bands = [F.percentile_approx(value, [max(q - BAND, 0.0), min(q + BAND, 1.0)], 10_000).alias(f"_b{i}") for i, q in enumerate(points.values())]
    bounds = cut(rows.groupBy(*by).agg(F.count(value).alias("_n"), *bands))
    near = _beside(rows, bounds, by)
    under = near.groupBy(*by).agg(*(F.count_if(F.col(value) < F.col(f"_b{i}")[0]).alias(f"_u{i}") for i in range(len(points))), F.max("_n").alias("_n"))
    under = cut(under)
    inside = F.array(*(F.when(F.col(value).between(F.col(f"_b{i}")[0], F.col(f"_b{i}")[1]), F.lit(i)) for i in range(len(points))))
    some = near.select(*by, value, F.explode(F.array_compact(inside)).alias("_i"))
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_i").orderBy(value)) - 1)
    joined = _beside(ranked, under, by)
    target = lambda q: F.floor((F.col("_n") - 1) * F.lit(q) + 0.5)
    return joined.groupBy(*by).agg(*(F.max(F.when((F.col("_i") == i) & (F.col("_r") + F.col(f"_u{i}") == target(q)), F.col(value))).alias(name) for i, (name, q) in enumerate(points.items())))


def kl_stats(rows: DataFrame, *by: str) -> DataFrame:
    """n, mean, median, p90, p99, max, rms, top1, perplexities of `divergence` rows, by group; quantiles of nearest rank."""
    # four passes follow: the divergence itself is computed once
    rows = cut(rows.select(*by, "kl", "same_top", "lp_ref", "lp_cand"))
    n = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("kl").alias("mean"), F.max("kl").alias("max"), F.sqrt(F.avg(F.col("kl") * F.col("kl"))).alias("rms"), F.avg(F.col("same_top").cast("double")).alias("top1"),
        F.exp(-F.avg("lp_ref")).alias("ppl_ref"), F.exp(-F.avg("lp_cand")).alias("ppl_cand"),
    )
    points = quantiles(rows, "kl", {"median": 0.5, "p90": 0.9, "p99": 0.99}, *by)
    both = n.join(points, list(by)) if by else n.crossJoin(F.broadcast(points))  # one row each
    return both.select(*by, "n", "mean", "median", "p90", "p99", "max", "rms", "top1", "ppl_ref", "ppl_cand")


def ppl_delta(ref: Column, ref_err: Column, cand: Column, cand_err: Column) -> Column:
    """struct(delta, percent, sigma, within_noise) of two perplexities with errors."""
    delta, sigma = cand - ref, F.sqrt(ref_err * ref_err + cand_err * cand_err)
    return F.struct(delta.alias("delta"), (delta / ref * 100).alias("percent"), sigma.alias("sigma"), (F.abs(delta) <= sigma).alias("within_noise"))
