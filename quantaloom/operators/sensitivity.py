"""Sensitivity: grouping tensors, enumerating candidates, joining measured curves onto proxy curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import formats as fm
from quantaloom.functions.text import candidate_id

CAP = 256


def group_key(how: str, bands: int = 4) -> Column:
    """'tensor', 'role', or 'role_depth': role@d{band}/{bands}."""
    if how == "tensor":
        return F.col("name")
    if how == "role":
        return F.col("role")
    band = F.least(F.floor(F.col("depth").cast("float").cast("double") * bands).cast("int"), F.lit(bands - 1))
    return F.concat(F.col("role"), F.lit("@d"), band.cast("string"), F.lit(f"/{bands}"))


def groups(tagged: DataFrame, how: str = "role", bands: int = 4, roles: list[str] | None = None) -> DataFrame:
    """key, members, member count, source bytes and mean depth of quantizable tensors of float source."""
    from quantaloom.operators.catalog import with_bytes

    sized = with_bytes(tagged).where(F.col("quantizable") & F.col("type_name").isin(*fm.FLOATS))
    if roles:
        sized = sized.where(F.col("role").isin(*roles))
    return sized.groupBy(group_key(how, bands).alias("key")).agg(F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list("name")).alias("names"), F.sum("nbytes").alias("source_bytes"), F.avg("depth").alias("depth"))


def candidates(tagged: DataFrame, rungs: list[str], how: str = "role", bands: int = 4, cap: int | None = CAP) -> DataFrame:
    """key x rung with the group's bytes, each member by its own actual format; more than cap raise."""
    from quantaloom.operators.catalog import with_bytes

    spark = tagged.sparkSession
    ladder = F.broadcast(spark.createDataFrame([(i, fm.ID[n], n) for i, n in enumerate(rungs)], "rung int, rung_id int, rung_name string"))
    sized = with_bytes(tagged).where(F.col("quantizable") & F.col("type_name").isin(*fm.FLOATS)).withColumn("key", group_key(how, bands))
    placed = fm.with_fallback(sized.crossJoin(ladder), "rung_id")  # a ladder is bounded
    packed = placed.withColumn("_bytes", fm.packed_bytes(F.col("n_elems"), F.col("actual_block"), F.col("actual_block_bytes")))
    out = packed.groupBy("key", "rung", "rung_name").agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("fell_back")).alias("fell_back"), F.array_sort(F.collect_set("actual_name")).alias("actual"))
    out = out.withColumn("id", candidate_id(F.concat_ws("__", "key", "rung_name")))
    if cap is not None:
        over = out.groupBy().agg(F.count(F.lit(1)).alias("_n"))
        out = out.crossJoin(F.broadcast(over)).withColumn("bytes", F.when(F.col("_n") > cap, F.raise_error(F.format_string(f"%d candidates, the cap is {cap}", F.col("_n"))).cast("long")).otherwise(F.col("bytes"))).drop("_n")
    return out


def collect_scores(scored: DataFrame) -> DataFrame:
    """key with its points (bytes, bits, kl) in order of bytes."""
    return scored.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("bytes", "bits", "kl"))).alias("points"))


def lookup(tensors: DataFrame, entries: DataFrame) -> DataFrame:
    """tensors (name, role) with the entry (pos, key, members) that measures each: by name, as a member, or by role; the first wins."""
    by_name = entries.select(F.col("key").alias("_n"), F.lit(0).alias("level"), "pos")
    by_member = entries.select(F.explode("members").alias("_n"), F.lit(1).alias("level"), "pos")
    own = tensors.join(by_name.unionAll(by_member), F.col("name") == F.col("_n"), "left").select(*tensors.columns, "level", "pos")
    role = tensors.join(entries.select(F.col("key").alias("_r"), F.lit(2).alias("level"), "pos"), F.col("role") == F.col("_r"), "left").select(*tensors.columns, "level", "pos")
    best = own.unionAll(role).groupBy(*tensors.columns).agg(F.min(F.when(F.col("pos").isNotNull(), F.struct("level", "pos"))).alias("_m"))
    keyed = entries.select(F.col("pos").alias("_p"), F.col("key").alias("entry_key"), "source_bytes")
    return best.join(keyed, F.col("_m.pos") == F.col("_p"), "left").select(*tensors.columns, F.col("_m.level").alias("level"), "entry_key", "source_bytes")


def apply_measured(points: DataFrame, entries: DataFrame) -> DataFrame:
    """Curve points (name, role, source_bytes, bits, bytes, cost) with measured costs where known.

    entries: pos, key, members, source_bytes, points(bits, kl). A measured point costs its group's
    KL times the tensor's share of the group's bytes; the others are scaled by the ratio of measured to proxy
    cost over all matched points (1 if either is not positive).
    """
    tensors = points.select("name", "role", F.col("source_bytes").alias("own_bytes")).distinct()
    found = lookup(tensors, entries)
    curves = entries.select(F.col("key").alias("entry_key"), F.explode("points").alias("p")).select("entry_key", F.col("p.bits").alias("bits"), F.col("p.kl").alias("kl"))
    share = F.when(F.col("source_bytes") > 0, F.least(F.col("own_bytes") / F.col("source_bytes"), F.lit(1.0))).otherwise(F.lit(1.0))
    joined = points.join(found.select("name", "entry_key", "own_bytes", F.col("source_bytes").alias("_g")), "name").withColumnRenamed("source_bytes", "_own").withColumnRenamed("_g", "source_bytes")
    matched = joined.join(curves, ["entry_key", "bits"], "left").withColumn("measured", F.col("kl") * share)
    ratio = matched.agg((F.sum("measured") / F.sum(F.when(F.col("measured").isNotNull(), F.col("cost")))).alias("r"), F.sum("measured").alias("a"))
    scale = F.broadcast(ratio.select(F.when((F.col("a") > 0) & (F.col("r") > 0) & (F.col("r") < float("inf")), F.col("r")).otherwise(F.lit(1.0)).alias("scale")))
    out = matched.crossJoin(scale).withColumn("new_cost", F.coalesce("measured", F.col("cost") * F.col("scale")))
    return out.select("name", "role", F.col("_own").alias("source_bytes"), "bits", "bytes", F.col("new_cost").alias("cost"), F.col("measured").isNotNull().alias("matched"))
