"""Feature preparation for the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import require_columns
from .rows import drop_nulls, project


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Add a vector of the feature columns; a null among them is an error."""
    require_columns(df, *features)
    return VectorAssembler(
        inputCols=list(features), outputCol=output, handleInvalid="error"
    ).transform(df)


def _scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``features``, the feature columns as one vector scaled to [0, 1]."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        MinMaxScaler(inputCol="_raw", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_raw")


def min_max_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Replace every feature by its value scaled to [0, 1]; a constant feature becomes 0.5."""
    require_columns(df, *features)
    others = [name for name in df.columns if name not in features]
    scaled = _scaled(df, features).withColumn("_scaled", vector_to_array("features"))
    return scaled.select(
        *others, *(F.get("_scaled", F.lit(i)).alias(name) for i, name in enumerate(features))
    )


def clustering_features(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Key and scaled feature vector of the rows that have no null: ``(key, features)``."""
    return _scaled(drop_nulls(project(df, key, features)), features).select(key, "features")


def split_bucket(id_cols: Sequence[str], seed: int) -> Column:
    """A row's place in 0..9999, decided by its id columns and the seed."""
    text = F.concat_ws("|", *(F.col(name).cast("string") for name in id_cols), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10000


def train_test_split(
    df: DataFrame, frac: float = 0.8, id_cols: Sequence[str] = (), seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split rows by a hash of their id columns, all columns by default.

    The same row always falls on the same side, whatever the partitioning; rows with equal ids
    fall on one side together.
    """
    if not 0 < frac < 1:
        raise ValueError("the training fraction lies between 0 and 1")
    ids = list(id_cols) or df.columns
    require_columns(df, *ids)
    in_train = split_bucket(ids, seed) < round(frac * 10000)
    return df.filter(in_train), df.filter(~in_train)
