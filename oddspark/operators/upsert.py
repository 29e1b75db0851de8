"""Results of keyed inserts, as plain DataFrames."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(
    df: DataFrame, key: list[str], order: list[str], pick: Callable[[Column], Column]
) -> DataFrame:
    """The least or greatest row of each key by ``order``, then by all other columns.

    So the choice among duplicates does not depend on the order in which tasks finish.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(key)
    ranks = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    row = pick(F.struct(*ranks, *rest)).alias("_row")
    chosen = df.groupBy(*key).agg(row).select(*key, *[F.col("_row")[c].alias(c) for c in rest])
    return chosen.select(*df.columns)


def _by_key(df: DataFrame, others: DataFrame, key: list[str], how: str) -> DataFrame:
    keys = others.select(*[F.col(c).alias(f"_other{i}") for i, c in enumerate(key)])
    found = [F.col(c).eqNullSafe(F.col(f"_other{i}")) for i, c in enumerate(key)]
    # Both sides may be large whatever their files' size says: keys of loads compress to a small part of it.
    return df.join(keys.hint("merge"), reduce(Column.__and__, found), how)


def without_keys(df: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not among the others'. A null is a value like any other, so that a row with a
    null key is found again."""
    return _by_key(df, others, key, "left_anti")


def with_keys(df: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is among the others', nulls included."""
    return _by_key(df, others, key, "left_semi")


def new_rows(
    existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """Incoming rows whose key is not there yet, the first of each key."""
    first = one_per_key(incoming, key, order or [], F.min)
    return without_keys(first, existing, key)


def insert_ignore(
    existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """The table after inserting and leaving present keys alone."""
    return existing.unionByName(new_rows(existing, incoming, key, order).select(*existing.columns))


def upsert_by_key(
    existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """The table after inserting or replacing by key; of several incoming rows the last one wins."""
    latest = one_per_key(incoming, key, order or [], F.max)
    return without_keys(existing, latest, key).unionByName(latest.select(*existing.columns))
