import math
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.functions import rounding


def found(spark, values, digits):
    x = F.col("x")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", rounding.exact(x, digits).alias("e"), rounding.scaled(x, digits).alias("s")).collect()
    return [(r["e"], r["s"]) for r in sorted(rows)]


def decimal(x, digits):
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def test_published_examples(spark):
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 1e15 + 0.3, 0.0, math.nan, 2.5, 1e-9, 123456.785]
    rows = found(spark, values, 2)
    assert [r[0] for r in rows[:6]] == [2.67, 0.12, 0.38, 1.0, -2.67, -0.12] and [r[1] for r in rows[:2]] == [2.68, 0.12]
    for v, (e, s) in zip(values, rows):
        assert math.isnan(e) if math.isnan(v) else (e == round(v, 2) and s == float(np.round(np.float64(v), 2)))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e9, 1e9), st.integers(-(10**8), 10**8).map(lambda i: i / 1000 + 0.0005), st.integers(-(10**6), 10**6).map(lambda i: i / 8)), min_size=1, max_size=60), st.sampled_from([2, 4, 6]))
def test_rounding_is_exact(spark, values, digits):
    for v, (e, s) in zip(values, found(spark, values, digits)):
        assert e == decimal(v, digits) == round(v, digits) and s == float(np.round(np.float64(v), digits))
