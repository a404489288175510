"""Divergence of captures that arrive as a stream: running statistics by batch, and by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.operators import metrics


def running(stream: DataFrame, reference: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window of `ts`: rows, mean, largest and rms divergence of streamed rows (ts, pos, target, logits) from a fixed reference.

    Late rows are taken up to `delay`; the state is one row of sums per open window.
    """
    ref = reference.select("pos", F.col("logits").alias("r"))
    joined = stream.withWatermark("ts", delay).join(ref, "pos")
    kl = metrics.kl(metrics.log_softmax(F.col("r").cast("array<double>")), metrics.log_softmax(F.col("logits").cast("array<double>")))
    return joined.select("ts", kl.alias("kl")).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.avg("kl").alias("mean"), F.max("kl").alias("max"), F.sqrt(F.avg(F.col("kl") * F.col("kl"))).alias("rms"))


def event_totals(stream: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Per window and event type: events and sum of values."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))
