"""Column expressions: missing values, robust statistics, moments and power transforms.

Missing means NULL or NaN. Unless ``na_rm`` is set, a statistic of a column with a missing value is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: A normal distribution's MAD over its standard deviation, and the factor that undoes it.
MAD_SCALE, MOD_Z = 1.4826, 0.6745


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    return col(c).cast("double")


def missing(c: Column | str) -> Column:
    return number(c).isNull() | F.isnan(number(c))


def known(c: Column | str) -> Column:
    """The column with NaN as NULL, which aggregates leave out."""
    return F.when(~F.isnan(number(c)), number(c))


def infinite(c: Column | str) -> Column:
    return F.coalesce(F.abs(number(c)) == F.lit(INF), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: 0/0 is NaN and x/0 an infinity, rather than an error."""
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def whole_or(c: Column | str, value: Column, na_rm: bool) -> Column:
    """``value``, an aggregate of the known values; NULL if some are missing and ``na_rm`` isn't set."""
    return value if na_rm else F.when(F.count(known(c)) == F.count(F.lit(1)), value)


def mean(c: Column | str, na_rm: bool = False) -> Column:
    return whole_or(c, F.avg(known(c)), na_rm)


def total(c: Column | str, na_rm: bool = False) -> Column:
    """The sum; that of no value is 0."""
    return whole_or(c, F.coalesce(F.sum(known(c)), F.lit(0.0)), na_rm)


def median(c: Column | str, na_rm: bool = False) -> Column:
    return whole_or(c, F.median(known(c)), na_rm)


def var_known(c: Column | str) -> Column:
    """The sample variance; exactly zero where all values are the same, which merged partial sums may miss by a little."""
    x = known(c)
    return F.when(F.min(x) == F.max(x), F.when(F.count(x) > 1, F.lit(0.0))).otherwise(F.var_samp(x))


def variance(c: Column | str, na_rm: bool = False) -> Column:
    return whole_or(c, var_known(c), na_rm)


def sd(c: Column | str, na_rm: bool = False) -> Column:
    return whole_or(c, F.sqrt(var_known(c)), na_rm)


def quantile(c: Column | str, p: float | list[float]) -> Column:
    """Exact quantiles of the known values with linear interpolation."""
    return F.percentile(known(c), F.array(*map(F.lit, p)) if isinstance(p, list) else F.lit(p))


def skewness(c: Column | str) -> Column:
    """Third central moment over n - 1 and the cube of the sample standard deviation."""
    n = F.count(known(c)).cast("double")
    return F.when(n > 1, F.skewness(known(c)) * F.sqrt(F.try_divide(n - 1, n)))


def kurtosis(c: Column | str) -> Column:
    """Fourth central moment over n - 1 and the fourth power of the sample standard deviation; not the excess."""
    n = F.count(known(c)).cast("double")
    return F.when(n > 1, (F.kurtosis(known(c)) + 3) * F.try_divide(n - 1, n))


def geometric_mean(c: Column | str) -> Column:
    """exp of the summed logs of the positive values over the number of all rows."""
    x = known(c)
    return F.exp(F.try_divide(F.coalesce(F.sum(F.when(x > 0, F.ln(x))), F.lit(0.0)), F.count(F.lit(1)).cast("double")))


def unique_values(c: Column | str) -> Column:
    """Different values; NULL and NaN are one each."""
    x = number(c)
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))


def coefficient_of_variation(c: Column | str) -> Column:
    return F.abs(F.try_divide(F.sqrt(var_known(c)), F.avg(known(c))))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


# --- power transforms -------------------------------------------------------------------------------------------------
def modulus(y: Column | str, lam: float | Column) -> Column:
    """sign(y) ((|y| + 1)^lambda - 1) / lambda; for lambda zero sign(y) log(|y| + 1)."""
    y, lam = number(y), lam if isinstance(lam, Column) else F.lit(float(lam))
    grown = F.try_divide(F.pow(F.abs(y) + 1, lam) - 1, lam)
    return F.signum(y) * F.when(F.abs(lam) < 1e-9, F.log1p(F.abs(y))).otherwise(grown)


def modulus_standard(y: Column | str, lam: float | Column, gm: float | Column) -> Column:
    """``modulus`` scaled by a power of the geometric mean of |y| + 1, so that likelihoods compare."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    gm = gm if isinstance(gm, Column) else F.lit(float(gm))
    return modulus(y, lam) * F.pow(gm, 1 - lam)


def boxcox_standard(y: Column | str, lam: float | Column) -> Column:
    """(y^lambda - 1) / lambda for y over its geometric mean; a series in log(y) near lambda zero."""
    y, lam = number(y), lam if isinstance(lam, Column) else F.lit(float(lam))
    log = F.ln(y)
    near = log * (1 + lam * log / 2 * (1 + lam * log / 3 * (1 + lam * log / 4)))
    return F.when(F.abs(lam) > 0.02, F.try_divide(F.pow(y, lam) - 1, lam)).otherwise(near)


def hex_to_rgb(code: Column | str) -> Column:
    """``[r, g, b]`` from 0 to 1 of a colour such as ``#ff8000``."""
    digits = F.regexp_replace(col(code), "#", "")
    return F.array(*(F.conv(F.substring(digits, at, 2), 16, 10).cast("double") / 255 for at in (1, 3, 5)))


def well_row(well: Column | str) -> Column:
    """1 for row A of a plate."""
    return F.ascii(F.substring(col(well), 1, 1)) - 64


def well_column(well: Column | str) -> Column:
    return F.substring(col(well), 2, 2).try_cast("int")


# --- wide aggregates --------------------------------------------------------------------------------------------------
def agg_wide(df: DataFrame, keys: list[str], aggregates: list[Column], width: int = 240) -> DataFrame:
    """One row a group with many aggregates, in several passes of bounded width where they are very many."""
    if not aggregates:
        return df.select(*map(col, keys)).distinct() if keys else df.sparkSession.range(1).select()
    parts = [df.groupBy(*map(col, keys)).agg(*aggregates[at : at + width]) for at in range(0, len(aggregates), width)]

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        if not keys:
            return a.crossJoin(b)  # a row each
        b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
        return a.join(b, all_of([col(k).eqNullSafe(col(f"_{k}")) for k in keys])).drop(*(f"_{k}" for k in keys))

    return reduce(both, parts)


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with what ``groups`` has for its keys. Without keys ``groups`` is one row; its size is known and it is broadcast."""
    return df.join(groups, keys, "left") if keys else df.crossJoin(F.broadcast(groups))


def to_long(df: DataFrame, keys: list[str], features: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each object and feature."""
    wide = df.select(*map(col, keys), *(number(f).alias(f) for f in features))
    return wide.unpivot([col(k) for k in keys], [col(f) for f in features], name, value)
