import datetime

import pytest
from pyspark.sql import functions as F

from oddspark.functions import demographics as D


def test_age_units(spark):
    cases = [("YR", 40.0), ("DEC", 400.0), ("mon", 40 * (1 / 12)), ("WK", 40 * (1 / 52)),
             ("DY", 40 * (1 / 365)), ("HR", 40 * (1 / 8760)), ("", 40.0), (None, 40.0),
             ("??", 40.0)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    found = df.orderBy("i").select(D.age_to_years(F.lit(40.0), F.col("u"))).collect()
    assert [r[0] for r in found] == [want for _, want in cases]
    none = df.select(D.age_to_years(F.lit(None).cast("double"), F.col("u"))).first()
    assert none[0] is None


def test_lenient_dates(spark):
    texts = ["20240131", "20240231", "202401", "2024", "", None, "2024013a", "20241301"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(D.lenient_date(F.col("t"))).collect()]
    assert found == [datetime.date(2024, 1, 31)] + [None] * 7


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("x",), ("",), (None,)], "t string")
    found = [r[0] for r in df.select(D.lenient_cast(F.col("t"), "double")).collect()]
    assert found == [12.0, 1.5, None, None, None]


@pytest.mark.parametrize("age,band", [(0, "<18"), (17.9, "<18"), (18, "18-39"), (40, "40-59"),
                                      (60, "60-74"), (74.9, "60-74"), (75, "75+"),
                                      (None, "Unknown")])
def test_bands(spark, age, band):
    value = F.lit(age).cast("double")
    assert spark.range(1).select(D.age_band(value)).first()[0] == band


def test_optional_conditions(spark):
    df = spark.createDataFrame([(1, "A_b"), (2, "axb"), (3, None), (4, "zz")], "n int, t string")

    def ids(conditions):
        return [r[0] for r in df.filter(D.all_of(conditions)).orderBy("n").collect()]

    assert ids([]) == [1, 2, 3, 4]
    assert ids(D.any_of(F.col("n"), []) + D.any_of(F.col("n"), None)) == [1, 2, 3, 4]
    assert ids(D.any_of(F.col("n"), [1, 3])) == [1, 3]
    assert ids(D.in_range(F.col("n"), 2, 3)) == [2, 3]
    assert ids(D.in_range(F.col("n"), None, 1)) == [1]
    assert ids(D.like_contains_ci([F.col("t")], "a_B")) == [1, 2]
    assert ids(D.like_contains_ci([F.col("t")], "")) == [1, 2, 3, 4]


def test_lists(spark):
    df = spark.createDataFrame([(" a, b ,,c",), ("",)], "t string")
    found = [r[0] for r in df.select(D.split_trim_list(F.col("t"))).collect()]
    assert found == [["a", "b", "c"], []]
    raw = df.select(D.split_trim_list(F.col("t"), trim=False)).first()[0]
    assert raw == [" a", " b ", "c"]
