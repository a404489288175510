"""Human-readable sizes, size parsing, names of candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(value: Column, unit: float, names: list[str], plain: str) -> Column:
    out = F.format_string(plain, value.cast("long"))
    for i, name in enumerate(names, 1):
        out = F.when(value >= F.lit(float(unit**i)), F.format_string(f"%.2f{name}", F.rint(value / F.lit(float(unit**i)) * 100) / 100)).otherwise(out)
    return out


def human_bytes(value: Column) -> Column:
    return _scaled(value, 1024, [" KiB", " MiB", " GiB", " TiB"], "%d B")


def human_count(value: Column) -> Column:
    return _scaled(value, 1000, ["K", "M", "B"], "%d")


def human_shape(dims: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(dims, lambda d: d.cast("string")), ", "), F.lit("]"))


def parse_size(text: str) -> int:
    """Bytes of '450M', '1.5 GiB', '300000' and the like (units of 1024)."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?\s*", text, re.I)
    if not m:
        raise ValueError(f"unreadable size {text!r}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2].lower() or " "))


def candidate_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
