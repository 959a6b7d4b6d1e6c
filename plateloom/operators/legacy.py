"""Older forms of the operators that some analyses still use."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions import special
from plateloom.functions.exprs import col, known, number
from plateloom.model import OBJECT
from plateloom.operators.linmodel import _tables, fit_table, lm_matrix, model_matrix, residuals
from plateloom.operators.transform import grouped_scale, power_transform


def normalize(df: DataFrame, features: list[str], method: str = "z", grouping: str | None = None) -> tuple[DataFrame, list[str]]:
    """Scaled features, and those that can't be scaled: with missing values or no variance."""
    row = X.agg_wide(df, [], [a for f in features for a in (F.max(X.missing(f).cast("int")).alias(f"m|{f}"), X.var_known(f).alias(f"v|{f}"))]).first()
    bad = [f for f in features if row[f"m|{f}"] or not row[f"v|{f}"]]
    return grouped_scale(df, [f for f in features if f not in bad], grouping, method).drop(*bad), bad


def median_by_group(df: DataFrame, features: list[str], group: str) -> DataFrame:
    return X.agg_wide(df, [group], [F.median(known(f)).alias(f) for f in features], 64)


def correct(df: DataFrame, features: list[str], covariates: list[str], group: str | None = None, key: str = OBJECT) -> DataFrame:
    """Residuals on covariates; within groups the intercept of the group is added back."""
    design = model_matrix(df, None, covariates)
    fits = lm_matrix(df, features, design, group=group)
    if not group:
        return residuals(df, design, fits, keep=[key])
    parts = []
    for g, fit in fits.items():
        own = residuals(df.filter(col(group).cast("string") == g), design, fit, keep=[key])
        at = fit.terms.index("(Intercept)")
        parts.append(own.select(col(key), *((number(f) + float(fit.coef[at, j])).alias(f) for j, f in enumerate(fit.responses))))
    return reduce(DataFrame.unionByName, parts)


def transform_bc(df: DataFrame, feature: str, lam: float, fudge: float = 0.1) -> DataFrame:
    """A column under a Box-Cox exponent, taken for 0 or 1 if it is nearer than ``fudge``."""
    snapped = 0.0 if abs(lam) < fudge else 1.0 if abs(lam - 1) < fudge else lam
    return df.withColumn(feature, power_transform(feature, snapped))


def association(df: DataFrame, features: list[str], formula: str, cook: float | None = None) -> DataFrame:
    """Coefficients of all features on a design, and for each feature how many objects have a large Cook's distance.

    The limit is 4 over the number of objects, or ``cook``.
    """
    design = model_matrix(df, formula)
    fit = lm_matrix(df, features, design)
    rows, names = _tables(df, design, features)
    kept = [names[k] for k in fit.kept]
    leverage = reduce(lambda a, b: a + b, [number(a) * number(b) * float(fit.cov_unscaled[i, j]) for i, a in enumerate(kept) for j, b in enumerate(kept)])
    limit = cook if cook is not None else 4 / fit.n
    made = []
    for j, f in enumerate(features):
        left = reduce(lambda a, b: a - b, [number(f), *(number(a) * float(fit.coef[i, j]) for i, a in enumerate(kept))])
        distance = F.try_divide(left * left, F.lit(float(len(kept) * fit.mse[j]))) * F.try_divide(leverage, (1 - leverage) * (1 - leverage))
        made.append(F.sum((distance > limit).cast("int")).alias(f))
    counts = rows.agg(*made).first()
    spark = df.sparkSession
    extra = spark.createDataFrame([(f, counts[f]) for f in features], "feature string, n_influential long")
    return fit_table(spark, fit).join(extra, "feature")


def association_two_steps(df: DataFrame, features: list[str], covariates: list[str], formula: str, key: str = OBJECT) -> DataFrame:
    """Residuals on covariates first, then their association with a design."""
    fixed = correct(df, features, covariates, key=key)
    return association(df.drop(*features).join(fixed, key), features, formula)


def f_test(r2: float, k: int, n: int) -> float:
    """The p-value of an R2 of ``k`` effects over ``n`` rows."""
    f = (r2 / k) / ((1 - r2) / (n - k - 1))
    return float(special.f_upper(np.array([f]), np.array([float(k)]), np.array([float(n - k - 1)]))[0])


def prune_relationships(orl: DataFrame, objects: DataFrame, columns: tuple[str, str] = ("First_ObjectNumber_Global", "Second_ObjectNumber_Global")) -> DataFrame:
    """Relationships whose both ends are among the objects."""
    ids = objects.select(col(OBJECT).alias("_id"))
    for c in columns:
        orl = orl.join(ids, col(c) == F.col("_id"), "left_semi")
    return orl
