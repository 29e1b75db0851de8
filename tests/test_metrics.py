import math

import pytest
from pyspark.sql import functions as F

from oddspark.functions import metrics as M

# a, b, c, d -> prr, chi2, ror, low, high, ic, ic low, ema, bcpnn
GOLDEN = [
    ((25, 1000, 50, 100000), (48.804878, 749.114302, 50.470067, 31.223523, 81.580405, 4.338345,
                              3.684874), True, True),
    ((10, 990, 100, 9900), (1.0, 0.027778, 1.044301, 0.551187, 1.978576, 0.0, -0.916338), False,
     False),
    ((2, 100, 5, 100000), (392.176471, 312.810945, 452.286296, 100.137426, 2042.821561, 2.301494,
                           0.217702), False, True),
    ((0, 0, 0, 0), (0.0, 0.0, 1.0, 0.003912, 255.626441, 0.0, 0.0), False, False),
    ((5, 95, 0, 1000), (0.0, 39.785845, 115.240838, 6.323747, 2100.092059, 2.526546, 0.804532),
     False, True),
    ((0, 0, 120, 9880), (0.0, 0.0, 81.995851, 1.620208, 4149.66326, 0.0, -5.661016), False, False),
    ((3, 0, 0, 0), (0.0, 0.0, 7.0, 0.051402, 953.262399, 0.0, -0.925576), False, False),
    ((3, 7, 2, 988), (148.5, 121.871986, 184.52, 31.2756, 1088.632358, 2.669851, 0.554236), True,
     True),
]


def test_golden_rows(spark):
    cells = spark.createDataFrame(
        [(i, *row[0]) for i, row in enumerate(GOLDEN)], "i int, a long, b long, c long, d long"
    )
    found = M.disproportionality(cells).orderBy("i").collect()
    for row, (_, values, ema, bcpnn) in zip(found, GOLDEN, strict=True):
        assert [row[m] for m in M.METRICS] == pytest.approx(list(values), rel=1e-6, abs=1e-6)
        assert (row["is_signal_ema"], row["is_signal_bcpnn"]) == (ema, bcpnn)


def test_large_counts_do_not_overflow(spark):
    n = 10**12
    row = M.disproportionality(
        spark.createDataFrame([(n, 2 * n, 3 * n, 4 * n)], "a long, b long, c long, d long")
    ).first()
    assert row["prr"] == pytest.approx((1 / 3) / (3 / 7))
    assert row["ror"] == pytest.approx(4 / 6)
    assert math.isfinite(row["prr_chi2"])
    assert row["ror_ci_low"] <= row["ror"] <= row["ror_ci_high"]


def test_cells_from_margins(spark):
    cells = M.contingency_cells(F.lit(3), F.lit(10), F.lit(5), F.lit(100))
    row = spark.range(1).select(*[c.alias(k) for k, c in cells.items()]).first()
    assert tuple(row) == (3, 7, 2, 88)


def test_input_columns_stay(spark):
    df = spark.createDataFrame([("x", 1, 2, 3, 4)], "k string, a long, b long, c long, d long")
    assert M.disproportionality(df).columns == ["k", "a", "b", "c", "d", *M.METRICS, *M.FLAGS]
