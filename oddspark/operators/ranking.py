"""Orders and top-k, always with a tie-break."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_by_ic(signals: DataFrame) -> DataFrame:
    """Highest information component first, names as the tie-break."""
    names = [F.col(c).asc() for c in ("drug_key", "event_pt") if c in signals.columns]
    return signals.orderBy(F.desc_nulls_last("ic"), *names)


def top_n(df: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """The n rows with the highest ``by``; ``name`` breaks ties."""
    return df.orderBy(F.desc(by), F.asc(name)).limit(n)


def top_n_per(df: DataFrame, group: str, by: str, n: int, name: str) -> DataFrame:
    """The n rows with the highest ``by`` in each group, with their ``rank``.

    Each task keeps its own n best of a group before the shuffle, so a large group moves n rows
    per task.
    """
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), F.asc(name))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def forest_rows(ranked: DataFrame, n: int = 20) -> DataFrame:
    """The rows of a forest plot: the n best by information component, by rising odds ratio."""
    return rank_by_ic(ranked).limit(n).orderBy("ror", "event_pt")
