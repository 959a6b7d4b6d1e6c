"""Quality filters: predicates by name, tables of filters over features and objects, and their application.

Every filter says what to keep. Row filters look at each value (or at all columns of a row), column filters at a whole
column; transposed, a column filter looks at all columns of a row.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions.exprs import col, known, missing, number
from plateloom.model import IMAGE, OBJECT, Assay, Dataset, FilterSpec, columns_but
from plateloom.operators.transform import grouped_scale

# --- values of a row --------------------------------------------------------------------------------------------------


def filter_vec_min(c: Column | str, threshold: float) -> Column:
    """Missing values give NULL."""
    return known(c) >= threshold


def filter_vec_max(c: Column | str, threshold: float) -> Column:
    return known(c) <= threshold


def filter_sum(columns: list, threshold: float, func: Callable[[Column | str, float], Column]) -> Column:
    """Whether all columns pass; missing values do."""
    if not columns:
        raise ValueError("no columns")
    return X.all_of([F.coalesce(func(c, threshold), F.lit(True)) for c in columns])


def filter_vec_min_sum(columns: list, threshold: float) -> Column:
    return filter_sum(columns, threshold, filter_vec_min)


def filter_vec_max_sum(columns: list, threshold: float) -> Column:
    return filter_sum(columns, threshold, filter_vec_max)


def scaled_within(df: DataFrame, columns: list[str], threshold: float, grouping: str | None = None, absolute: bool = True, method: str = "mod.z") -> DataFrame:
    """``df`` with a boolean ``_z_<column>`` for each column: whether its (modified) z-score is below the threshold."""
    scaled = grouped_scale(df, columns, grouping, method, prefix="_z_")
    return scaled.withColumns({f"_z_{c}": F.when(~missing(f"_z_{c}"), (F.abs(col(f"_z_{c}")) if absolute else col(f"_z_{c}")) < threshold) for c in columns})


def filter_vec_mod_z(df: DataFrame, column: str, threshold: float, grouping: str | None = None, absolute: bool = True, method: str = "mod.z", out: str = "keep") -> DataFrame:
    return scaled_within(df, [column], threshold, grouping, absolute, method).withColumnRenamed(f"_z_{column}", out)


def filter_vec_mod_z_sum(df: DataFrame, columns: list[str], threshold: float, grouping: str | None = None, out: str = "keep", **how) -> DataFrame:
    """Whether all columns of a row pass; missing scores do."""
    found = scaled_within(df, columns, threshold, grouping, **how)
    return found.withColumn(out, X.all_of([F.coalesce(col(f"_z_{c}"), F.lit(True)) for c in columns])).drop(*(f"_z_{c}" for c in columns))


def filter_vec_mod_z_perc(df: DataFrame, columns: list[str], threshold: float, share: float, grouping: str | None = None, out: str = "keep", **how) -> DataFrame:
    """Whether at least ``share`` of the columns pass; missing scores don't."""
    found = scaled_within(df, columns, threshold, grouping, **how)
    passed = reduce(lambda a, b: a + b, [F.when(col(f"_z_{c}"), 1).otherwise(0) for c in columns])
    return found.withColumn(out, passed / len(columns) >= share).drop(*(f"_z_{c}" for c in columns))


# --- whole columns ----------------------------------------------------------------------------------------------------


def filter_agg_na(c: Column | str, threshold: float) -> Column:
    return F.avg(missing(c).cast("double")) <= threshold


def filter_agg_zero_var(c: Column | str, threshold: float | None = 0.0) -> Column:
    return X.var_known(c) > (threshold or 0.0)


def filter_agg_coef_var(c: Column | str, threshold: float) -> Column:
    return X.coefficient_of_variation(c) > threshold


def filter_agg_skewness(c: Column | str, threshold: float) -> Column:
    return F.abs(X.skewness(c)) > threshold


def filter_agg_kurtosis(c: Column | str, threshold: float) -> Column:
    return F.abs(X.kurtosis(c)) > threshold


def filter_agg_unique_val(c: Column | str, threshold: float) -> Column:
    return X.unique_values(c) > threshold


def filter_agg_inf_median(c: Column | str, threshold: float | None = None) -> Column:
    """Whether the median is finite; that of no value is."""
    return F.coalesce(F.abs(F.median(known(c))) != F.lit(X.INF), F.lit(True))


def filter_agg_inf(c: Column | str, threshold: float) -> Column:
    return F.sum(X.infinite(c).cast("int")) <= threshold


def filter_agg_blacklist(c: Column | str, threshold: float | None = None) -> Column:
    """Nothing passes."""
    return F.count(col(c)) < 0


def filter_near_zero_var(df: DataFrame, column: str, freq_ratio: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """One row ``keep``: unless the most common value outnumbers the second ``freq_ratio`` times and few values differ."""
    counts = df.filter(~missing(column)).groupBy(number(column).alias("v")).count()
    top = counts.agg(F.max("count").alias("first"), F.count(F.lit(1)).alias("different"), F.sum("count").alias("n"), F.max_by("v", F.struct("count", "v")).alias("mode"))
    second = counts.crossJoin(F.broadcast(top)).filter("v <> mode").agg(F.max("count").alias("second"))
    both = top.crossJoin(second)
    few = 100 * F.col("different") / F.col("n") <= unique_cut
    return both.select((~((F.coalesce(F.col("first") / F.col("second"), F.lit(X.INF)) > freq_ratio) & few) & (F.col("different") > 1)).alias("keep"))


def filter_multicol(columns: list[str], threshold: float | None, func: Callable) -> list[Column]:
    """A column filter for each of many columns, named by them."""
    return [func(c, threshold).alias(c) for c in columns]


def _multicol(func: Callable) -> Callable:
    return lambda columns, threshold=None: filter_multicol(columns, threshold, func)


filter_agg_na_multicol = _multicol(filter_agg_na)
filter_agg_zero_var_multicol = _multicol(filter_agg_zero_var)
filter_agg_coef_var_multicol = _multicol(filter_agg_coef_var)
filter_agg_skewness_multicol = _multicol(filter_agg_skewness)
filter_agg_kurtosis_multicol = _multicol(filter_agg_kurtosis)
filter_agg_unique_val_multicol = _multicol(filter_agg_unique_val)
filter_agg_inf_multicol = _multicol(filter_agg_inf)


def filter_agg_inf_median_sum(columns: list[str], threshold: float | None = None) -> Column:
    return X.all_of([filter_agg_inf_median(c) for c in columns])


# --- column filters over the columns of a row -------------------------------------------------------------------------


def _power_sum(xs: Column, centre: Column, power: int) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.pow(x - centre, F.lit(float(power))))


def row_statistics(columns: list[str]) -> dict[str, Column]:
    """Statistics over the columns of a row, with higher-order functions."""
    everything = F.array(*map(number, columns))
    xs = F.filter(everything, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(xs).cast("double")
    centre = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x), n)
    var = F.when(n > 1, F.try_divide(_power_sum(xs, centre, 2), n - 1))
    dev = F.sqrt(var)
    ordered = F.array_sort(xs)
    half = F.floor((F.size(xs) - 1) / 2).cast("int")
    mid = (F.get(ordered, half) + F.get(ordered, F.floor(F.size(xs) / 2).cast("int"))) / 2
    return {
        "missing": 1 - n / len(columns),
        "var": var,
        "cv": F.abs(F.try_divide(dev, centre)),
        "skewness": F.try_divide(_power_sum(xs, centre, 3), (n - 1) * F.pow(dev, F.lit(3.0))),
        "kurtosis": F.try_divide(_power_sum(xs, centre, 4), (n - 1) * F.pow(dev, F.lit(4.0))),
        "unique": F.size(F.array_distinct(everything)),
        "infinite": F.size(F.filter(xs, lambda x: F.abs(x) == F.lit(X.INF))),
        "median": F.when(F.size(xs) > 0, mid),
    }


#: Transposed column filters, from the statistics of a row and a threshold.
_TRANSPOSED: dict[str, Callable[[dict[str, Column], float | None], Column]] = {
    "filter_agg_na": lambda s, t: s["missing"] <= t,
    "filter_agg_zero_var": lambda s, t: s["var"] > (t or 0.0),
    "filter_agg_coef_var": lambda s, t: s["cv"] > t,
    "filter_agg_skewness": lambda s, t: F.abs(s["skewness"]) > t,
    "filter_agg_kurtosis": lambda s, t: F.abs(s["kurtosis"]) > t,
    "filter_agg_unique_val": lambda s, t: s["unique"] > t,
    "filter_agg_inf": lambda s, t: s["infinite"] <= t,
    "filter_agg_inf_median": lambda s, t: F.coalesce(F.abs(s["median"]) != F.lit(X.INF), F.lit(True)),
    "filter_agg_blacklist": lambda s, t: F.lit(False),
}

#: Filters by name. Users may add their own: column filters take a column and a threshold, and so do row filters.
AGGREGATE_FILTERS: dict[str, Callable] = {n: globals()[n] for n in _TRANSPOSED}
ROW_FILTERS: dict[str, Callable] = {"filter_vec_min": filter_vec_min, "filter_vec_max": filter_vec_max}
SCALED_FILTERS = ("filter_vec_mod_z", "filter_vec_mod_z_sum", "filter_vec_mod_z_perc")


def base_name(func: str) -> str:
    return re.sub(r"_(multicol|sum)$", "", func)


def check_filter_list(filters: list[FilterSpec]) -> None:
    for f in filters:
        if base_name(f.func) not in {*AGGREGATE_FILTERS, *ROW_FILTERS, *SCALED_FILTERS}:
            raise ValueError(f"no filter function {f.func}")


def filters_from_table(table: DataFrame, name: str = "name", pattern: str = "column_pattern", func: str = "type", threshold: str = "value", transpose: str | None = "transpose", active: str | None = "active") -> list[FilterSpec]:
    """Filter declarations from the rows of a small table."""
    out = []
    for r in table.collect():
        own = r.asDict()
        out.append(FilterSpec(own[name], own[pattern], own[func], own[threshold], bool(own.get(transpose)) if transpose else False, own.get(active) is not False if active else True, own.get("value2"), own.get("metadata_group")))
    check_filter_list(out)
    return out


def matching(pattern: str, columns: list[str]) -> list[str]:
    return list(columns) if pattern == "all" else [c for c in columns if re.search(pattern, c)]


def calculate_feature_filters(data: DataFrame, filters: list[FilterSpec], features: list[str] | None = None, na_fail: bool = True) -> DataFrame:
    """``(feature, <filter>...)``: a boolean for each feature and filter, from one pass over the data.

    Inactive filters and columns that a filter doesn't concern pass.
    """
    check_filter_list(filters)
    features = features or columns_but(data, OBJECT)
    aggregates = [AGGREGATE_FILTERS[base_name(f.func)](c, f.threshold).alias(f"{k}|{c}") for k, f in enumerate(filters) if f.active for c in matching(f.column_pattern, features)]
    row = X.agg_wide(data, [], aggregates) if aggregates else None
    has = set(row.columns) if row is not None else set()

    def result(k: int, c: str) -> Column:
        if f"{k}|{c}" not in has:
            return F.lit(True)
        return F.coalesce(col(f"{k}|{c}"), F.lit(False)) if na_fail else col(f"{k}|{c}")

    rows = F.array(*(F.struct(F.lit(c).alias("feature"), *(result(k, c).alias(f.name) for k, f in enumerate(filters))) for c in features))
    source = row if row is not None else data.sparkSession.range(1)
    return source.select(F.explode(rows).alias("r")).select("r.*")


def calculate_object_filters(data: DataFrame, filters: list[FilterSpec], grouping: str | None = None, features: list[str] | None = None, na_fail: bool = True, key: str = OBJECT) -> DataFrame:
    """``(object_id, <filter>...)``: a boolean for each object and filter. Filters don't depend on each other.

    Filters of scaled values are grouped by their own ``metadata_group``, a column of ``data``, or else by ``grouping``.
    """
    check_filter_list(filters)
    groupings = {grouping, *(f.metadata_group for f in filters)}
    features = features or [c for c in columns_but(data, key, IMAGE) if c not in groupings]
    out, made = data, {}
    for k, f in enumerate(filters):
        own, name = matching(f.column_pattern, features), f"_f{k}"
        if not f.active or not own:
            if f.active:
                warnings.warn(f"no column matches {f.column_pattern}", stacklevel=2)
            made[f.name] = F.lit(True)
            continue
        by, own_group = base_name(f.func), f.metadata_group or grouping
        if by in SCALED_FILTERS:
            if by == "filter_vec_mod_z_perc":
                out = filter_vec_mod_z_perc(out, own, f.threshold, f.threshold2 if f.threshold2 is not None else 1.0, own_group, out=name)
            else:
                out = filter_vec_mod_z_sum(out, own, f.threshold, own_group, out=name)
            made[f.name] = col(name)
        elif by in ROW_FILTERS:
            made[f.name] = filter_sum(own, f.threshold, ROW_FILTERS[by]) if len(own) > 1 or f.func.endswith("_sum") else ROW_FILTERS[by](own[0], f.threshold)
        else:
            made[f.name] = _TRANSPOSED[by](row_statistics(own), f.threshold)
    return out.select(col(key), *((F.coalesce(x, F.lit(False)) if na_fail else x).alias(n) for n, x in made.items()))


def passing(results: DataFrame, key: str) -> DataFrame:
    """Keys that pass all filters; missing results fail."""
    return results.filter(X.all_of([F.coalesce(col(c), F.lit(False)) for c in columns_but(results, key)])).select(col(key))


def apply_feature_filters(dataset: Dataset, results: DataFrame, assays: list[str] | None = None) -> Dataset:
    """Assays with the features that pass; features without a result go as well."""
    keep = {r.feature for r in passing(results, "feature").collect()}
    changed = {n: a.select([c for c in a.feature_names if c in keep]) if assays is None or n in assays else a for n, a in dataset.assays.items()}
    return replace(dataset, assays=changed)


def apply_image_filters(dataset: Dataset, results: DataFrame) -> Dataset:
    """The images that pass, and their objects."""
    images = dataset.images.join(passing(results, IMAGE), IMAGE, "left_semi")
    return dataset.where(dataset.objects.join(images.select(IMAGE), IMAGE, "left_semi"))


def apply_object_filters(dataset: Dataset, results: DataFrame) -> Dataset:
    return dataset.where(passing(results, OBJECT))


def filtered_assay(assay: Assay, results: DataFrame) -> Assay:
    keep = {r.feature for r in passing(results, "feature").collect()}
    return assay.select([c for c in assay.feature_names if c in keep])
