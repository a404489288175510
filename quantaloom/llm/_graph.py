"""Connected components by joins: labels fall to the smallest id, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.runtime import save


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of the edges (a, b); comp is the smallest id reachable.

    Each round takes the least label of the neighbours and then the label of that
    label. Every join is a plain equi-join, so a hub's rows can be split.
    """
    both = save(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        after = save(lower.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        labels = after.select("id", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
