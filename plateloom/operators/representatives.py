"""Representative objects: nearest to a statistic, to quantiles, or to a group's centre."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions.exprs import col, known, number
from plateloom.model import OBJECT

QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _statistic(metric: str, value: str, q: float | None) -> Column:
    made = {"mean": F.avg(known(value)), "median": F.median(known(value)), "upper.q": X.quantile(value, 0.75 if q is None else q), "lower.q": X.quantile(value, 0.25 if q is None else q)}
    if metric not in made:
        raise ValueError(f"no metric {metric}")
    return made[metric]


def _around(df: DataFrame, value: str, key: str, target: Column, n: int) -> DataFrame:
    """The row nearest to a statistic and the ``n`` before and behind it in order of value, found without sorting all rows.

    The rows next to the nearest one by value are those of highest value below it and of lowest above it.
    """
    rows = df.filter(~X.missing(value)).select(col(key), number(value).alias("value"))
    goal = rows.agg(target.alias("goal"))
    near = rows.crossJoin(F.broadcast(goal)).agg(F.min(F.struct(F.abs(F.col("value") - F.col("goal")).alias("d"), "value", col(key).alias("id"))).alias("c")).select("c.value", "c.id")
    near = near.select(F.col("value").alias("cv"), F.col("id").alias("cid"))
    marked = rows.crossJoin(F.broadcast(near)).withColumn("side", F.when((F.col("value") < F.col("cv")) | ((F.col("value") == F.col("cv")) & (col(key) < F.col("cid"))), -1).when((F.col("value") == F.col("cv")) & (col(key) == F.col("cid")), 0).otherwise(1)).drop("cv", "cid")
    parts = [marked.filter("side = 0").select(col(key), "value", F.lit(0).alias("offset"))]
    if n:
        for side, order in ((-1, [F.desc("value"), F.desc(key)]), (1, [F.asc("value"), F.asc(key)])):
            own = marked.filter(F.col("side") == side).orderBy(*order).limit(n)
            parts.append(own.select(col(key), "value", (F.row_number().over(Window.orderBy(*order)) * side).cast("int").alias("offset")))
    return reduce(DataFrame.union, parts)


def fetch_representative_object(df: DataFrame, feature: str, metric: str = "mean", n: int = 0, q: float | None = None, subset: Column | None = None, key: str = OBJECT) -> DataFrame:
    """``(object_id, value, offset)``: the object nearest to the mean, median or a quantile, and ``n`` on either side of it."""
    rows = df if subset is None else df.filter(subset)
    return _around(rows, feature, key, _statistic(metric, "value", q), n)


def fetch_representative_object_quantiles(df: DataFrame, feature: str, n: int = 1, name: str = "", key: str = OBJECT) -> DataFrame:
    """``fetch_representative_object`` for seven quantiles, labelled ``q10 - name`` and so on."""
    parts = []
    for q in QUANTILES:
        label = f"q{round(100 * q)} - {name or feature}"
        parts.append(_around(df, feature, key, X.quantile("value", q), n).withColumn("label", F.lit(label)))
    return reduce(DataFrame.union, parts)


def fetch_representative_object_nn(df: DataFrame, group: str, dims: list[str], n: int = 0, key: str = OBJECT) -> DataFrame:
    """``(group, object_id, dist, rank)``: the object of each group nearest to its centre; with ``n``, its n nearest, itself first."""
    if df.schema[group].dataType.simpleString() in ("double", "float"):
        raise TypeError("groups can't be numbers with fractions")
    rows = df.select(col(group).alias("g"), col(key).alias("id"), *(number(d).alias(d) for d in dims)).filter("g is not null")
    centres = rows.groupBy("g").agg(*(F.avg(d).alias(f"_c_{d}") for d in dims))
    apart = lambda a, b: F.sqrt(reduce(lambda s, t: s + t, [F.pow(col(a(d)) - col(b(d)), F.lit(2.0)) for d in dims]))
    away = rows.join(centres, "g").withColumn("dist", apart(lambda d: d, lambda d: f"_c_{d}"))
    first = away.groupBy("g").agg(F.min_by(F.struct("id", "dist", *dims), F.struct("dist", "id")).alias("r"))
    if not n:
        return first.select(F.col("g").alias(group), F.col("r.id").alias(key), F.col("r.dist").alias("dist"), F.lit(1).alias("rank"))
    seeds = first.select("g", *(F.col(f"r.{d}").alias(f"_s_{d}") for d in dims))
    near = rows.join(seeds, "g").withColumn("dist", apart(lambda d: d, lambda d: f"_s_{d}"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("dist", "id")))
    return ranked.filter(F.col("rank") <= n).select(F.col("g").alias(group), F.col("id").alias(key), "dist", "rank")
