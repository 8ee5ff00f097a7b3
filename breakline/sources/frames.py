"""Series from memory and from files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def from_matrix(spark: SparkSession, data, series_id: str = "0") -> DataFrame:
    """(series_id, t, v0, v1, ...) from a list or array of one or two dimensions, a row per step."""
    x = np.asarray(data, float)
    if x.ndim not in (1, 2):
        raise ValueError("data must have one or two dimensions")
    x = x.reshape(len(x), -1)
    columns = {"series_id": series_id, "t": np.arange(len(x)), **{f"v{j}": x[:, j] for j in range(x.shape[1])}}
    schema = "series_id string, t long, " + ", ".join(f"v{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(pd.DataFrame(columns), schema)


def read_series(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any table that Spark reads; projection and filters reach the files."""
    return spark.read.format(format).options(**options).load(path)
