"""Reading the text tables and joining them by id without moving texts that no answer needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import require_columns, small


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under names of its own, so that no other name clashes."""
    require_columns(docs, id_col, text_col, *more)
    return docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(c) for c in more]
    )


def only_ids(df: DataFrame, ids: DataFrame, count: int, how: str = "left_semi") -> DataFrame:
    """Rows whose ``doc_id`` is (or, by ``left_anti``, is not) among ``count`` counted ids.

    Few ids are broadcast, so the wide rows stay where they are; many are joined by shuffle.
    """
    return df.join(small(ids.select("doc_id"), count, 1), "doc_id", how)


def null_key(name: str):
    """A text key that keeps nulls apart from every real value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))
