"""Quality of predictions as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import require_columns


def r2_column(sse: Column, sst: Column) -> Column:
    """``1 - sse / sst``; null where the labels do not vary."""
    return F.when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0)))


def regression_metrics(
    df: DataFrame,
    by: str | None = None,
    through_origin: bool = False,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Root mean squared error and r2 of ``(label, prediction)`` pairs, per ``by`` if named.

    Pairs with a null are left out.  One pass with partial aggregation, whatever the group sizes.
    """
    require_columns(df, label, prediction, *([by] if by else []))
    pairs = df.na.drop(subset=[label, prediction])
    error = F.col(label) - F.col(prediction)
    if through_origin:
        total = F.sum(F.col(label) * F.col(label))
    else:
        total = F.count(label) * F.var_pop(label)
    sums = pairs.groupBy(*([by] if by else [])).agg(
        F.count(label).alias("n"), F.sum(error * error).alias("_sse"), total.alias("_sst")
    )
    return sums.select(
        *([by] if by else []),
        "n",
        F.sqrt(F.col("_sse") / F.nullif(F.col("n"), F.lit(0))).alias("rmse"),
        r2_column(F.col("_sse"), F.col("_sst")).alias("r2"),
    )
