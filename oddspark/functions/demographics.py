"""Ages, lenient casts and the bands used for demographic counts."""

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddspark import fixed_values as V


def lenient_cast(value: Column, kind: str) -> Column:
    """``value`` as ``kind``, null where it does not parse.

    Numbers must be written as such: a cast alone takes the suffixes of Java literals (``12d``).
    """
    if kind in ("double", "float"):
        value = F.when(value.rlike(V.PLAIN_NUMBER), value)
    return value.try_cast(kind)


def lenient_date(text: Column) -> Column:
    """``YYYYMMDD`` text as a date; partial, impossible and empty dates become null."""
    return F.try_to_date(F.when(text.rlike("^[0-9]{8}$"), text), "yyyyMMdd")


def age_to_years(age: Column, unit: Column) -> Column:
    """An age in years; a missing unit means years and an unknown one changes nothing."""
    factors = F.create_map(*[F.lit(x) for pair in V.YEARS_PER_UNIT.items() for x in pair])
    known_unit = F.upper(F.coalesce(F.nullif(unit, F.lit("")), F.lit("YR")))
    return age * F.coalesce(F.try_element_at(factors, known_unit), F.lit(1.0))


def age_band(age: Column) -> Column:
    """Five bands and 'Unknown'."""
    return (
        F.when(age < 18, "<18")
        .when(age < 40, "18-39")
        .when(age < 60, "40-59")
        .when(age < 75, "60-74")
        .when(age >= 75, "75+")
        .otherwise("Unknown")
    )


def or_unknown(value: Column) -> Column:
    """Null becomes 'Unknown'."""
    return F.coalesce(value, F.lit("Unknown"))


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of the given conditions, true when there are none."""
    return reduce(and_, conditions, F.lit(True))


def in_range(value: Column, low: float | None, high: float | None) -> list[Column]:
    """Inclusive bounds, only those given. A null value meets no bound."""
    bounds = []
    if low is not None:
        bounds.append(value >= F.lit(low))
    if high is not None:
        bounds.append(value <= F.lit(high))
    return bounds


def any_of(value: Column, wanted: list | None) -> list[Column]:
    """Membership in a list; an empty or missing list is no condition."""
    return [value.isin(list(wanted))] if wanted else []


def like_contains_ci(columns: list[Column], key: str | None) -> list[Column]:
    """Case-insensitive ``LIKE %key%`` on any of the columns; no key is no condition.

    ``%`` and ``_`` in the key stay wildcards; a backslash stands for itself.
    """
    if not key:
        return []
    pattern = "%" + key.lower().replace("\\", "\\\\") + "%"
    hits = [F.lower(c).like(pattern) for c in columns]
    return [reduce(lambda x, y: x | y, hits)]


def split_trim_list(text: Column, trim: bool = True) -> Column:
    """Items of a comma list without empty ones, trimmed unless told otherwise."""
    items = F.split(text, ",", -1)
    if trim:
        items = F.transform(items, lambda item: F.trim(item))
    return F.filter(items, lambda item: item != "")
