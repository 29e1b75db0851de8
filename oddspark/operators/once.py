"""Columns that are costly to compute and used more than once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, whatever reads them.

    A filter on a projected column is pushed below the projection, where the column's expression
    is written out once more for each use. A one-row ``stack`` is not looked through.
    """
    values = list(columns.values())
    return df.select("*", F.stack(F.lit(1), *values).alias(*columns.keys()))
