"""Operators that need no state, on a stream of objects: filters by value, transforms and scaling with frozen statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.functions.exprs import col
from plateloom.model import FilterSpec, columns_but
from plateloom.operators.filters import calculate_object_filters
from plateloom.operators.transform import column_stats, fast_colscale, power_transform


def freeze(df: DataFrame, features: list[str], grouping: str | None = None, **how) -> DataFrame:
    """Scaling statistics of a batch, for ``scaled``."""
    return column_stats(df, features, [grouping] if grouping else [], **how)


def scaled(stream: DataFrame, stats: DataFrame, features: list[str], grouping: str | None = None, scale_method: str = "mean") -> DataFrame:
    return fast_colscale(stream, features, grouping=grouping, stats=stats, scale_method=scale_method)


def passing(stream: DataFrame, filters: list[FilterSpec], key: str) -> DataFrame:
    """Rows of a stream that pass row filters and transposed column filters."""
    features = [c for c in columns_but(stream, key)]
    wide = stream.withColumn("_row", F.struct(*map(col, stream.columns)))
    found = calculate_object_filters(wide.withColumn("_key", F.col("_row")), filters, features=features, key="_key")
    kept = found.filter(" and ".join(f"`{f.name}`" for f in filters) or "true")
    return kept.select("_key.*")


def transformed(stream: DataFrame, lambdas: dict[str, float], shifts: dict[str, float] | None = None) -> DataFrame:
    """Features under known Box-Cox exponents."""
    made = {f: power_transform(f, lam, (shifts or {}).get(f, 0.0)) for f, lam in lambdas.items()}
    return stream.select(*((made[c].alias(c) if c in made else col(c)) for c in stream.columns))
