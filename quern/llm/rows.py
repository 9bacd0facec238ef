"""Whole rows that travel beside what an operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(columns: list[str] | None) -> Column:
    """The named columns as one struct ``row``, so that their names cannot clash with others; a struct needs a field, so without columns it has one."""
    return F.struct(*(F.col(f"`{c}`") for c in columns) if columns else [F.lit(True).alias("_")]).alias("row")


def released(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row`` as they were."""
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
