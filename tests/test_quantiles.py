"""Radix selection against sorted values: signs, ties, infinities, many distinct values, several partitions."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from semweave.functions.stats import exact_quantiles, from_bits, order_statistics, ordered_bits


@given(st.lists(st.floats(allow_nan=False), min_size=1))
def test_bits_keep_the_order_and_the_values(xs):
    a = np.array(xs)
    k = ordered_bits(a)
    assert (np.sort(k) == k[np.argsort(a, kind="stable")]).all()
    assert [from_bits(int(b)) for b in k] == [x + 0.0 for x in xs]


def test_order_statistics_equal_a_sort(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=5000), np.repeat(0.25, 700), -rng.random(300) * 1e-300, [np.inf, -np.inf, 0.0, -0.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(6)
    ranks = [0, 1, 17, 2500, 3000, len(x) - 2, len(x) - 1]
    got = order_statistics(df, ranks)
    assert [got[r] for r in ranks] == [np.sort(x)[r] for r in ranks]
    with pytest.raises(ValueError):
        order_statistics(df, [len(x)])


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=4001)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    assert np.allclose(exact_quantiles(df, "v", qs), np.percentile(x, [100 * q for q in qs]), rtol=1e-15)
    assert exact_quantiles(df.where("v is null"), "v", [0.5, 0.9]) == [None, None]
    assert exact_quantiles(spark.range(7).toDF("v"), "v", [0.5]) == [3.0]
