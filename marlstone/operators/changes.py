"""Inserts, updates and deletes as DataFrames: what a table holds afterwards, by copy on write."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and ``rows``; columns that ``rows`` lacks are null, those that ``table`` lacks are left out."""
    known = [c for c in rows.columns if c in table.columns]
    own = rows.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in known))
    return table.unionByName(own, allowMissingColumns=True).select(*table.columns)


def updated(table: DataFrame, values: dict[str, Any], where: Column | None = None) -> DataFrame:
    """``table`` with ``values`` set in the rows where ``where`` is true, or in all."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(table.schema[c].dataType) for c, v in values.items()}
    return table.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns))


def deleted(table: DataFrame, where: Column | None = None) -> DataFrame:
    """``table`` without the rows where ``where`` is true, or without any."""
    return table.filter(F.lit(False) if where is None else ~F.coalesce(where, F.lit(False)))
