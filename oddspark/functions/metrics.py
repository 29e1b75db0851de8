"""Disproportionality of a 2x2 table: PRR, Yates chi-square, ROR with interval, IC, two flags."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark import fixed_values as V

METRICS = ["prr", "prr_chi2", "ror", "ror_ci_low", "ror_ci_high", "ic", "ic_ci_low"]
FLAGS = ["is_signal_ema", "is_signal_bcpnn"]
CELLS = ["a", "b", "c", "d"]


def contingency_cells(n_both: Column, n_drug: Column, n_event: Column, n_all: Column) -> dict:
    """The four cells from the count of both, the two margins and the number of reports."""
    return {
        "a": n_both,
        "b": n_drug - n_both,
        "c": n_event - n_both,
        "d": n_all - n_drug - n_event + n_both,
    }


def prr(a: Column, c: Column, with_drug: Column, without_drug: Column) -> Column:
    """Proportional reporting ratio; 0 when a row is empty or ``c`` is 0."""
    return F.coalesce(
        F.try_divide(F.try_divide(a, with_drug), F.try_divide(c, without_drug)), F.lit(0.0)
    )


def yates_chi2(cross: Column, n: Column, rows: list[Column], columns: list[Column]) -> Column:
    """Yates-corrected chi-square, not clamped; 0 on an empty margin.

    The margins are doubles before they are multiplied: their product leaves a long behind.
    """
    margins = rows[0] * rows[1] * columns[0] * columns[1]
    return F.coalesce(F.try_divide(n * F.pow(F.abs(cross) - n / 2, 2), margins), F.lit(0.0))


def _with_half(cell: Column) -> Column:
    return cell + F.lit(0.5)


def log_ror_se(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.sqrt(1 / _with_half(a) + 1 / _with_half(b) + 1 / _with_half(c) + 1 / _with_half(d))


def ror(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Reporting odds ratio with a half added to every cell."""
    return (_with_half(a) * _with_half(d)) / (_with_half(b) * _with_half(c))


def information_component(a: Column, expected: Column) -> Column:
    return F.coalesce(F.log2(_with_half(a) / _with_half(expected)), F.lit(0.0))


def ic_variance(a: Column, with_drug: Column, with_event: Column, n: Column) -> Column:
    def part(count: Column) -> Column:
        return (n - count + 0.5) / (_with_half(count) * (n + 1))

    return F.lit((1 / math.log(2)) ** 2) * (part(a) + part(with_drug) + part(with_event))


def disproportionality(df: DataFrame) -> DataFrame:
    """Add the seven metrics and the two flags to rows that hold ``a, b, c, d``.

    The steps are separate projections, so that each margin is computed once; they run in one
    generated stage. ``ad - bc`` is exact in decimal and becomes a double once.
    """
    whole = {name: F.col(name).cast("decimal(19,0)") for name in CELLS}
    cell = {name: F.col(f"_{name}") for name in CELLS}
    margins = df.withColumns({
        **{f"_{name}": F.col(name).cast("double") for name in CELLS},
        "_cross": (whole["a"] * whole["d"] - whole["b"] * whole["c"]).cast("double"),
    }).withColumns({
        "_drug": cell["a"] + cell["b"],
        "_rest": cell["c"] + cell["d"],
        "_event": cell["a"] + cell["c"],
        "_other": cell["b"] + cell["d"],
        "_n": cell["a"] + cell["b"] + cell["c"] + cell["d"],
    })
    drug, rest, event, other, n = (
        F.col(c) for c in ("_drug", "_rest", "_event", "_other", "_n")
    )
    steps = margins.withColumns({
        "prr": prr(cell["a"], cell["c"], drug, rest),
        "prr_chi2": yates_chi2(F.col("_cross"), n, [drug, rest], [event, other]),
        "ror": ror(**cell),
        "_margin": F.lit(V.Z_95) * log_ror_se(**cell),
        "_expected": F.try_divide(drug, n) * F.try_divide(event, n) * n,
        "_ic_margin": F.lit(V.Z_95)
        * F.sqrt(F.greatest(ic_variance(cell["a"], drug, event, n), F.lit(0.0))),
    }).withColumns({
        "ror_ci_low": F.exp(F.ln("ror") - F.col("_margin")),
        "ror_ci_high": F.exp(F.ln("ror") + F.col("_margin")),
        "ic": information_component(cell["a"], F.col("_expected")),
    }).withColumns({
        "ic_ci_low": F.when(n > 0, F.col("ic") - F.col("_ic_margin")).otherwise(0.0),
    })
    flagged = steps.withColumns(signal_flags())
    kept = [c for c in df.columns if c not in METRICS + FLAGS]
    return flagged.select(*kept, *METRICS, *FLAGS)


def signal_flags() -> dict[str, Column]:
    """The EMA and BCPNN criteria over the metric columns."""
    return {
        "is_signal_ema": (F.col("prr") >= V.EMA_MIN_PRR)
        & (F.col("prr_chi2") >= V.EMA_MIN_CHI2)
        & (F.col("a") >= V.EMA_MIN_CASES),
        "is_signal_bcpnn": F.col("ic_ci_low") > 0,
    }


def ci_error_bars() -> dict[str, Column]:
    """Distances from the odds ratio to the ends of its interval."""
    return {
        "error_plus": F.col("ror_ci_high") - F.col("ror"),
        "error_minus": F.col("ror") - F.col("ror_ci_low"),
    }


def rounded(columns: list[str], places: int = 3) -> list[Column]:
    """The columns for display, rounded."""
    return [F.round(c, places).alias(c) for c in columns]
