"""Session helpers shared by the whole package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark from wherever sf_dir points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per Spark context)."""
    context = spark.sparkContext
    if getattr(context, "_quantaloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "quantaloom_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._quantaloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only on one machine, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantaloom-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of a query as it ends; otherwise they stay until the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(frame: DataFrame, release: bool = False) -> DataFrame:
    """Write a frame as compressed Parquet into the shared checkpoint folder and read it back: its lineage ends there.

    With release the shuffle files behind it go as soon as it is written.
    """
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    conf = frame.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true" if release else before)
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(RELEASE, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
