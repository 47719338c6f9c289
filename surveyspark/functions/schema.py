"""Column contracts checked on the plan, without running a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def with_default_columns(df: DataFrame, **defaults: tuple[object, str]) -> DataFrame:
    """Add absent columns as (value, type) literals."""
    added = {n: F.lit(v).cast(t) for n, (v, t) in defaults.items() if n not in df.columns}
    return df.withColumns(added) if added else df


def first_present_column(df: DataFrame, names: Sequence[str]) -> str:
    """The first listed column the table has, or its only column."""
    for name in names:
        if name in df.columns:
            return name
    if len(df.columns) == 1:
        return df.columns[0]
    raise ValueError(f"none of {list(names)} among {df.columns}")


def finite(column):
    """NaN and infinities as null."""
    value = column.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
