"""The tables behind plots: no drawing, only what would be drawn."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions.exprs import col, number
from plateloom.model import OBJECT
from plateloom.operators.stats import cor_test
from plateloom.operators.transform import fast_colscale


def make_ident_labels(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Where the label of each class goes: the mean position."""
    return df.groupBy(col(label)).agg(F.avg(X.known(x)).alias("x"), F.avg(X.known(y)).alias("y"))


def execution_time(images: DataFrame, pattern: str = "ExecutionTime_", percent: bool = False) -> DataFrame:
    """``(module, value)``: the mean of each timing column, or its share of all, largest first."""
    names = [c for c in images.columns if c.startswith(pattern)]
    means = images.agg(*(F.avg(X.known(c)).alias(c) for c in names))
    long = means.unpivot([], [col(c) for c in names], "module", "value").withColumn("module", F.replace("module", F.lit(pattern), F.lit("")))
    if percent:
        long = long.withColumn("value", 100 * F.col("value") / F.sum("value").over(Window.partitionBy(F.lit(0))))
    return long.orderBy(F.desc("value"), "module")


def hex_bins(df: DataFrame, x: str, y: str, width: float, height: float | None = None) -> DataFrame:
    """``df`` with the centre ``hx, hy`` of each row's hexagon.

    Hexagons stand on two grids of rectangles that are half a step apart; a point belongs to the nearer centre.
    """
    dx, dy = float(width), float(height or width) * math.sqrt(3)
    u, v = number(x) / dx, number(y) / dy
    r1, s1 = F.rint(u), F.rint(v)
    r2, s2 = F.floor(u) + 0.5, F.floor(v) + 0.5
    near = (u - r1) * (u - r1) + 3 * (v - s1) * (v - s1) <= (u - r2) * (u - r2) + 3 * (v - s2) * (v - s2)
    return df.withColumns({"hx": F.when(near, r1).otherwise(r2) * dx, "hy": F.when(near, s1).otherwise(s2) * dy})


def hex_counts(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    return hex_bins(df.filter(~X.missing(x) & ~X.missing(y)), x, y, width).groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("n"))


def location_hex(df: DataFrame, x: str, y: str, z: str, width: float, func=F.avg, log2: bool = False, thresh: float | None = None, divide_mean: bool = False, scale: bool = False, min_count: int = 10) -> DataFrame:
    """``(hx, hy, value, n)``: an aggregate of ``z`` by hexagon, missing where there are ``min_count`` rows or fewer.

    In order: logarithm, rows with a modified z-score of ``thresh`` or more go, division by the mean, z-scores.
    """
    rows = df.filter(~X.missing(x) & ~X.missing(y)).select(number(x).alias("x"), number(y).alias("y"), number(z).alias("z"))
    if log2:
        rows = rows.withColumn("z", F.log2("z"))
    if thresh is not None:
        scored = fast_colscale(rows, ["z"], na_rm=True, scale_method="median", prefix="_m_")
        rows = scored.filter(F.abs("_m_z") < thresh).drop("_m_z")
    if divide_mean:
        rows = X.join_groups(rows, rows.agg(F.avg(X.known("z")).alias("_a")), []).withColumn("z", X.divide(F.col("z"), F.col("_a"))).drop("_a")
    if scale:
        rows = fast_colscale(rows, ["z"], na_rm=True)
    binned = hex_bins(rows, "x", "y", width).groupBy("hx", "hy").agg(func(X.known("z")).alias("value"), F.count(F.lit(1)).alias("n"))
    return binned.withColumn("value", F.when(F.col("n") > min_count, F.col("value")))


def histogram(df: DataFrame, value: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """``(group, bin, lower, upper, n, median)``: counts in equal bins over the whole range, and the median of all rows."""
    rows = df.filter(~X.missing(value) & ~X.infinite(value)).select(*([col(group).alias("group")] if group else [F.lit("all").alias("group")]), number(value).alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.median("v").alias("median"))
    both = rows.crossJoin(F.broadcast(ends))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    counted = both.groupBy("group", at.alias("bin"), "lo", "hi", "median").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("group", "bin", (F.col("lo") + F.col("bin") * step).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"), "n", "median")


def boxplot_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(group, n, lower, q1, median, q3, upper)``; whiskers end at the last values within 1.5 times the quartiles' distance."""
    rows = df.filter(~X.missing(value)).select(col(group).alias("group"), number(value).alias("v"))
    q = rows.groupBy("group").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    reach = 1.5 * (F.get("q", 2) - F.get("q", 0))
    inside = (F.col("v") >= F.get("q", 0) - reach) & (F.col("v") <= F.get("q", 2) + reach)
    ends = rows.join(q, "group").filter(inside).groupBy("group").agg(F.min("v").alias("lower"), F.max("v").alias("upper"))
    return q.join(ends, "group").select("group", "n", "lower", F.get("q", 0).alias("q1"), F.get("q", 1).alias("median"), F.get("q", 2).alias("q3"), "upper")


def mean_sd(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*map(col, keys)).agg(F.avg(X.known(value)).alias("mean"), F.stddev_samp(X.known(value)).alias("sd"))


def plot_xy(df: DataFrame, x: str, y: str, groups: list[str] | None = None, p_values: bool = True) -> DataFrame:
    """The correlation in a scatter plot's title."""
    return cor_test(df, x, y, groups, p_values)


def dimplot(scores: DataFrame, ident: DataFrame, dims: tuple[str, str], label: str, downsample: int | None = None, most_labels: int = 50) -> tuple[DataFrame, DataFrame | None]:
    """Points ``(object_id, x, y, ident)`` and, for few enough classes, where their labels go."""
    rows = scores.join(ident.select(OBJECT, col(label)), OBJECT).select(OBJECT, number(dims[0]).alias("x"), number(dims[1]).alias("y"), col(label).alias("ident"))
    rows = rows.filter(~(X.missing("x") & X.missing("y")))
    if downsample is not None:
        rows = rows.orderBy(F.xxhash64(OBJECT)).limit(downsample)
    few = rows.select("ident").distinct().limit(most_labels + 1).count() <= most_labels
    return rows, make_ident_labels(rows, "x", "y", "ident") if few else None


def heatmap_breaks(df: DataFrame, features: list[str], n: int = 100, limits: tuple[float, float] | None = None, symmetric: bool = False, absolute: bool = False) -> list[float]:
    """The limits between colours: given, or what the values span, around zero or from zero if so asked."""
    if limits is None:
        row = df.agg(*(f(X.known(c)).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("a", F.min), ("b", F.max)))).first()
        lo = min(row[f"a{i}"] for i in range(len(features)))
        hi = max(row[f"b{i}"] for i in range(len(features)))
    else:
        lo, hi = limits
    if symmetric:
        hi = max(abs(lo), abs(hi))
        lo = -hi
    if absolute:
        lo, hi = 0.0, max(abs(lo), abs(hi))
    return [lo + (hi - lo) * k / n for k in range(n + 1)]


def heatmap(df: DataFrame, features: list[str], limits: tuple[float, float] | None = None, absolute: bool = False) -> DataFrame:
    """Values clipped to the limits, or their amounts."""
    def shown(c: str) -> Column:
        x = F.abs(number(c)) if absolute else number(c)
        return (F.greatest(F.lit(float(limits[0])), F.least(F.lit(float(limits[1])), x)) if limits else x).alias(c)

    return df.select(*(shown(c) if c in features else col(c) for c in df.columns))


def downsampled(df: DataFrame, n: int, key: str = OBJECT) -> DataFrame:
    return df.orderBy(F.xxhash64(col(key))).limit(n)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
