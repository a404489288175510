"""Choosing one format per tensor under a byte budget: curves, hulls, steps, allocation, Pareto front."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm


def ladder_points(tensors: DataFrame, rungs: list[str], floor_bits: str = "floor_bits") -> DataFrame:
    """tensors x rungs at or above the floor's bits per weight; the first rung of each actual format stays.

    Returns tensor columns with rung, actual_id, actual_name, bytes.
    """
    spark = tensors.sparkSession
    rows = [(i, fm.ID[name], fm.BLOCK[name][1] * 8 / fm.BLOCK[name][0]) for i, name in enumerate(rungs)]
    ladder = F.broadcast(spark.createDataFrame(rows, "rung int, rung_id int, rung_bpw double"))  # a ladder has some twenty rungs
    f = fm.formats(spark).select(F.col("type_name").alias(floor_bits), fm.bits_per_weight(F.col("block"), F.col("block_bytes")).alias("_floor"))
    above = tensors.join(f, floor_bits, "left").join(ladder, F.col("rung_bpw") + 1e-9 >= F.coalesce("_floor", F.lit(0.0))).drop("_floor")
    placed = fm.with_fallback(above, "rung_id")
    first = placed.withColumn("_r", F.row_number().over(Window.partitionBy("name", "actual_id").orderBy("rung"))).where("_r = 1")
    return first.withColumn("bytes", fm.packed_bytes(F.col("n_elems"), F.col("actual_block"), F.col("actual_block_bytes"))).drop("_r", "rung_id", "rung_bpw", "fell_back", "actual_block", "actual_block_bytes")


def normalise(points: DataFrame) -> DataFrame:
    """Points (name, bits, bytes, cost) whose cost falls as bytes grow, with lvl from 0; the cheapest always stays."""
    by = Window.partitionBy("name")
    first = points.withColumn("_r", F.row_number().over(Window.partitionBy("name", "bytes").orderBy("cost", "bits"))).where("_r = 1").drop("_r")
    best = F.min("cost").over(by.orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("_b", best).where(F.col("_b").isNull() | (F.col("cost") < F.col("_b"))).drop("_b")
    return kept.withColumn("lvl", (F.row_number().over(by.orderBy("bytes")) - 1).cast("int"))


def hull(curve: DataFrame) -> DataFrame:
    """The lower convex hull of normalised curves: a point goes if a chord between others runs at or below it.

    Equi-joins within a curve, which has a ladder's length at most.
    """
    p = lambda s: curve.select("name", *(F.col(c).alias(f"{s}_{c}") for c in ("lvl", "bytes", "cost")))
    a, j, k = p("a"), p("j"), p("k")
    slope = lambda x, y: (F.col(f"{x}_cost") - F.col(f"{y}_cost")) / (F.col(f"{y}_bytes") - F.col(f"{x}_bytes"))
    under = j.join(a, "name").where("a_lvl < j_lvl").join(k, "name").where("k_lvl > j_lvl").where(slope("a", "j") <= slope("a", "k"))
    return curve.join(under.select("name", F.col("j_lvl").alias("lvl")).distinct(), ["name", "lvl"], "left_anti")


def steps(hulls: DataFrame) -> DataFrame:
    """Each hull step with its gain in cost, extra bytes and their ratio; only gains."""
    by = Window.partitionBy("name").orderBy("bytes")
    moved = hulls.withColumns({"gain": F.lag("cost").over(by) - F.col("cost"), "delta": F.col("bytes") - F.lag("bytes").over(by)})
    return moved.where((F.col("gain") > 0) & (F.col("delta") > 0)).withColumn("ratio", F.col("gain") / F.col("delta")).select("name", "lvl", "bits", "bytes", "cost", "gain", "delta", "ratio")


def pareto(curve: DataFrame, fixed_bytes: int = 0) -> DataFrame:
    """Total bytes and cost after all hull steps of at least each ratio, cheapest first, from the floors up."""
    hulls = hull(curve)
    taken = steps(hulls).groupBy("ratio").agg(F.sum("delta").alias("delta"), F.sum("gain").alias("gain"))
    # one row per distinct ratio of all curves: tensors times rungs, not elements
    running = Window.orderBy(F.col("ratio").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    floor = hulls.where("lvl = 0").agg(F.sum("bytes").alias("fb"), F.sum("cost").alias("fc"))
    after = taken.select("ratio", F.sum("delta").over(running).alias("d"), F.sum("gain").over(running).alias("g")).crossJoin(F.broadcast(floor))
    points = after.select((F.col("fb") + F.col("d") + fixed_bytes).alias("bytes"), (F.col("fc") - F.col("g")).alias("cost")).unionAll(floor.select((F.col("fb") + fixed_bytes).alias("bytes"), F.col("fc").alias("cost")))
    return points.groupBy("bytes").agg(F.min("cost").alias("cost"))


def choose(points: list[tuple[str, int, int, float]], hull_points: set[tuple[str, int]], budget: int, fill: bool = True) -> tuple[dict[str, int], int, int]:
    """Level per curve, upgrades and bytes for (name, lvl, bytes, cost) under a budget for the curves.

    Hull steps are taken by falling ratio (first name on a tie); a step that does not fit ends its curve.
    Then, if asked, the best remaining upgrade that fits is taken until none does.
    """
    curves: dict[str, list[tuple[int, int, float]]] = {}
    for name, lvl, size, cost in sorted(points, key=lambda p: (p[0], p[1])):
        curves.setdefault(name, []).append((lvl, size, cost))
    at = {name: 0 for name in curves}
    used = sum(c[0][1] for c in curves.values())
    chains = {name: [p for p in curve if (name, p[0]) in hull_points] for name, curve in curves.items()}

    def ratio(a, b):
        return (a[2] - b[2]) / (b[1] - a[1])

    heap = [(-ratio(c[0], c[1]), name, 1) for name, c in chains.items() if len(c) > 1 and c[0][2] > c[1][2]]
    heapq.heapify(heap)
    upgrades = 0
    while heap:
        _, name, i = heapq.heappop(heap)
        before, step = chains[name][i - 1], chains[name][i]
        if used + step[1] - before[1] > budget:
            continue
        used += step[1] - before[1]
        at[name] = step[0]
        upgrades += 1
        if i + 1 < len(chains[name]) and step[2] > chains[name][i + 1][2]:
            heapq.heappush(heap, (-ratio(step, chains[name][i + 1]), name, i + 1))
    while fill:
        best = None
        for name in sorted(curves):
            now = curves[name][at[name]]
            for lvl, size, cost in curves[name][at[name] + 1 :]:
                if cost < now[2] and size > now[1] and used + size - now[1] <= budget:
                    score = (now[2] - cost) / (size - now[1])
                    if best is None or score > best[0]:
                        best = score, name, lvl, size - now[1]
        if best is None:
            break
        at[best[1]] = best[2]
        used += best[3]
        upgrades += 1
    return at, upgrades, used


def allocate(curve: DataFrame, budget: int, fixed_bytes: int = 0, fill: bool = True) -> DataFrame:
    """name, lvl, bits, bytes, cost, over_budget of the chosen points.

    The fold is sequential, over one row per tensor and rung (a model has thousands), never over weights.
    """
    marked = curve.join(hull(curve).select("name", "lvl", F.lit(True).alias("on_hull")), ["name", "lvl"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        points = list(zip(pdf["name"], pdf["lvl"], pdf["bytes"], pdf["cost"], strict=True))
        on = {(n, k) for n, k, h in zip(pdf["name"], pdf["lvl"], pdf["on_hull"], strict=True) if h is True or h == True}  # noqa: E712
        at, _, used = choose(points, on, budget - fixed_bytes, fill)
        out = pdf[[at[n] == k for n, k in zip(pdf["name"], pdf["lvl"], strict=True)]][["name", "lvl", "bits", "bytes", "cost"]].copy()
        out["over_budget"] = bool(used + fixed_bytes > budget)
        return out

    return marked.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fold, "name string, lvl int, bits string, bytes long, cost double, over_budget boolean")


def totals(chosen: DataFrame, fixed_bytes: int = 0) -> DataFrame:
    return chosen.agg((F.sum("bytes") + fixed_bytes).alias("bytes"), F.sum("bytes").alias("searchable_bytes"), F.sum("cost").alias("cost"), F.lit(fixed_bytes).cast("long").alias("fixed_bytes"))


def emit_recipe(chosen: DataFrame, default: str = "Q4_K") -> str:
    """A recipe that names every chosen tensor, by format, as TOML text."""
    groups = chosen.groupBy("bits").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy("bits").collect()
    lines = ["[defaults]", f'bits = "{default}"', "imatrix = true", ""]
    for g in groups:
        quoted = ", ".join(f'"{n}"' for n in g["names"])
        lines += ["[[rule]]", f"name = [{quoted}]", f'bits = "{g["bits"]}"', ""]
    return "\n".join(lines)
