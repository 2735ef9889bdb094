"""Nearest rows by vector distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import squared_l2


def nearest(rows: DataFrame, vector: str, probe: Sequence[float], k: int, tie: str, max_squared_distance: float | None = None, where: Column | None = None) -> DataFrame:
    """The k rows nearest to probe, with squared_distance; ties by the tie column. Exact: a bounded heap per task.

    where filters before distances are computed; max_squared_distance is inclusive.
    """
    some = rows if where is None else rows.where(where)
    target = F.array(*(F.lit(float(x)).cast("float") for x in probe))
    found = some.withColumn("squared_distance", squared_l2(F.col(vector), target))
    if max_squared_distance is not None:
        found = found.where(F.col("squared_distance") <= max_squared_distance)
    return found.orderBy("squared_distance", tie).limit(k)
