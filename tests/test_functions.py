"""Distribution functions and expressions against known values and numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions import special


@pytest.mark.parametrize(
    ("got", "expected"),
    [
        (special.t_two_sided(2.228138851964939, 10), 0.05),
        (special.t_two_sided(12.706204736432095, 1), 0.05),
        (special.t_upper(-1.0, 3), 0.8044988905221148),
        (special.chi2_upper(3.841458820694124, 1), 0.05),
        (special.chi2_upper(18.307038053275146, 10), 0.05),
        (special.f_upper(4.964602743730711, 1, 10), 0.05),
        (special.f_upper(2.978237016082321, 10, 10), 0.05),
        (special.normal_upper(1.959963984540054), 0.025),
        (special.log_gamma(0.5), math.log(math.sqrt(math.pi))),
        (special.beta_regularised(2.0, 3.0, 0.4), 0.5248),
    ],
)
def test_known_values(got, expected):
    assert abs(float(got) - expected) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.floats(0.1, 60), st.floats(0.01, 90))
def test_gamma_and_chi_squared(a, x):
    assert abs(float(special.log_gamma(a)) - math.lgamma(a)) < 1e-8 * max(1, abs(math.lgamma(a)))
    steps = np.linspace(0, x, 200_001)[1:] if a >= 1 else None
    if steps is not None:  # the density integrated
        density = np.exp((a - 1) * np.log(steps) - steps - math.lgamma(a))
        assert abs(1 - density.sum() * x / 200_000 - float(special.gamma_upper(a, x))) < 2e-3
    assert 0 <= float(special.gamma_upper(a, x)) <= 1


@settings(max_examples=60, deadline=None)
@given(st.floats(-20, 20), st.integers(1, 200))
def test_t_is_symmetric_and_f_is_its_square(t, df):
    assert abs(float(special.t_upper(t, df)) + float(special.t_upper(-t, df)) - 1) < 1e-12
    assert abs(float(special.t_two_sided(t, df)) - float(special.f_upper(t * t, 1, df))) < 1e-10


def test_missing_and_statistics(spark):
    rows = [(1.0, 2.0), (2.0, None), (4.0, float("nan")), (9.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = df.agg(X.mean("a").alias("ma"), X.mean("b").alias("mb"), X.mean("b", True).alias("mbr"), X.total("b", True).alias("tb"), X.median("a").alias("med"), X.unique_values("b").alias("u"), X.geometric_mean("a").alias("g"), X.skewness("a").alias("s"), X.kurtosis("a").alias("k"), X.quantile("a", 0.25).alias("q")).first()
    a = np.array([1.0, 2, 4, 9])
    sd = a.std(ddof=1)
    assert (r.ma, r.mb, r.mbr, r.tb, r.med, r.u) == (4.0, None, 2.5, 5.0, 3.0, 4)
    assert np.isclose(r.g, np.exp(np.log(a).mean())) and np.isclose(r.q, np.quantile(a, 0.25))
    assert np.isclose(r.s, ((a - 4) ** 3).sum() / (3 * sd**3)) and np.isclose(r.k, ((a - 4) ** 4).sum() / (3 * sd**4))
    empty = df.filter("a > 100").agg(X.total("a", True).alias("t"), X.mean("a", True).alias("m")).first()
    assert (empty.t, empty.m) == (0.0, None)


def test_divide_and_modulus(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(X.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf and got[3] == 1.5
    y = [r[0] for r in df.select(X.modulus("a", 2.0)).collect()]
    assert np.allclose(y, [1.5, 0, -1.5, 7.5])
