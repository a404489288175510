"""Frames whose rows travel as one struct, so that an operator's own columns clash with no name of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row of docs as the struct ROW, and the given columns of it."""
    every = F.struct(*(F.col(f"`{name}`").alias(name) for name in docs.columns))
    return docs.select(every.alias(ROW), *(value.alias(name) for name, value in columns.items()))


def unwrapped(frame: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The rows' own columns, with the given ones in place of those of their name or added."""
    own = [columns.pop(name, F.col(ROW).getField(name)).alias(name) for name in names]
    return frame.select(*own, *(value.alias(name) for name, value in columns.items()))
