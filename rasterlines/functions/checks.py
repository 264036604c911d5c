"""Many checks of a row in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(d: DataFrame, keep: list[str], checks: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """``keep`` and a check's texts, for each row and each check whose condition is true of it; all checks have the same names."""
    found = [F.when(F.coalesce(condition, F.lit(False)), F.struct(*(v.cast("string").alias(n) for n, v in texts.items()))) for condition, texts in checks]
    return d.select(*keep, F.inline(F.array_compact(F.array(*found))))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for d in tables[1:]:
        out = out.unionByName(d)
    return out
