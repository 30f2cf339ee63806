"""Schemas of group functions' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def extended(df: DataFrame, *doubles: str) -> StructType:
    """The frame's schema with further columns of doubles."""
    return StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in doubles)])
