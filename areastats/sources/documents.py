"""Result rows as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_documents(df: DataFrame) -> DataFrame:
    """One JSON document per row in column ``data``; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("data"))
