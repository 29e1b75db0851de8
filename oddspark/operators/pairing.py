"""Joins within a report that stay balanced when one report is very large."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one side that one cell of a report may hold.
CELL_ROWS = 1000


def join_within(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    left_item: str,
    right_item: str,
    cell_rows: int = CELL_ROWS,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join of two many-rows-per-key tables.

    A key with m left and n right rows gives m x n results. Keys with at most ``cell_rows`` rows a
    side are joined directly, on the key alone. The rows of a larger key are dealt by hash into a
    grid of about (m / cell_rows) x (n / cell_rows) cells, and the join runs on key and cell, so
    that it spreads over as many tasks as it has cells. The table of large keys has at most one row
    per ``cell_rows`` input rows; where there are none, that half of the plan ends at run time. Neither side is
    ever broadcast, and tables stored by the key are joined without a shuffle.

    ``per_key`` holds one row for each key to keep; its columns are added to the result.
    """
    cells = _cells_of_large_keys(left, right, key, cell_rows).hint("merge")
    placed = left.join(cells, key, "left")
    if per_key is not None:
        placed = placed.join(per_key.hint("merge"), key)
    direct = placed.filter("_cells is null").drop("_cells").join(right.hint("merge"), key)
    dealt_left = (
        placed.filter("_cells is not null")
        .withColumn("_left_cell", _deal(left_item, 0))
        .withColumn("_right_cell", _each(1))
        .drop("_cells")
    )
    dealt_right = (
        right.join(cells, key)
        .withColumn("_right_cell", _deal(right_item, 1))
        .withColumn("_left_cell", _each(0))
        .drop("_cells")
    )
    dealt = dealt_left.join(dealt_right.hint("merge"), [*key, "_left_cell", "_right_cell"])
    return direct.unionByName(dealt.drop("_left_cell", "_right_cell"))


def _cells_of_large_keys(
    left: DataFrame, right: DataFrame, key: list[str], cell_rows: int
) -> DataFrame:
    """``_cells``, how many there are per side, for every key found on both sides that needs more than one.

    Each side is counted by itself, so tables stored by the key are counted where they lie. The few rows are
    dealt by key once, for all that read them; where there are none, the planner knows then.
    """
    def rows(df: DataFrame, count: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(count))

    def cells(count: str) -> Column:
        return F.ceil(F.col(count) / cell_rows).cast("int")

    sizes = rows(left, "n_left").join(rows(right, "n_right").hint("merge"), key)
    large = sizes.filter(f"greatest(n_left, n_right) > {cell_rows:d}")
    return large.select(*key, F.array(cells("n_left"), cells("n_right")).alias("_cells")).hint("rebalance", *key)


def _deal(item: str, side: int) -> Column:
    return F.pmod(F.xxhash64(item), F.col("_cells")[side]).cast("int")


def _each(side: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("_cells")[side] - 1))
