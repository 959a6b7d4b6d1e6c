"""Aggregation of features and metadata by group, image column or plate layout."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateloom.functions import exprs as X
from plateloom.functions.exprs import col, known
from plateloom.model import IMAGE, OBJECT, Assay, Dataset, columns_but
from plateloom.operators.transform import fast_colscale

METHODS: dict[str, Callable[[Column | str, bool], Column]] = {"mean": X.mean, "median": X.median, "sum": X.total}
#: Rows and columns of plate formats.
PLATES = {"384": (16, 24), "96": (8, 12)}


def aggregate_matrix(df: DataFrame, features: list[str], grouping: str | list[str], method: str | Callable = "mean", na_rm: bool = True) -> DataFrame:
    """The mean, median or sum, or a user's aggregate, of every feature by group."""
    keys = [grouping] if isinstance(grouping, str) else list(grouping)
    if isinstance(method, str):
        if method not in METHODS:
            raise ValueError(f"method {method} is none of {', '.join(METHODS)}")
        made = [METHODS[method](f, na_rm).alias(f) for f in features]
    else:
        made = [method(known(f)).alias(f) for f in features]
    return X.agg_wide(df, keys, made, 64 if method == "median" else 240)


def aggregate_assay(assay: Assay, groups: DataFrame, grouping: str, method: str = "mean", na_rm: bool = True) -> Assay:
    """Both slots by group; the scaled one is scaled again. ``groups`` has the group of each object."""
    features = assay.feature_names

    def by_group(table: DataFrame) -> DataFrame:
        rows = aggregate_matrix(table.join(groups.select(OBJECT, col(grouping).alias("_g")), OBJECT), features, "_g", method, na_rm)
        return rows.select(col("_g").cast("string").alias(OBJECT), *map(col, features))

    scaled = None if assay.scale_data is None else fast_colscale(by_group(assay.scale_data), features, na_rm=na_rm)
    return Assay(by_group(assay.data), scaled, assay.features)


def aggregate_metadata(df: DataFrame, grouping: str, method: str = "mean", na_rm: bool = True, drop_multival_string: bool = True, drop_na_col: bool = True, sep: str = "; ", factors: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Metadata by group: numbers by ``method``; text and booleans if they are the same throughout.

    Text that differs is missing or, without ``drop_multival_string`` and for ``factors`` always, its different values in
    order of first appearance (by ``order``). A missing value counts as one. Columns without any value go.
    """
    names = columns_but(df, grouping)
    place = col(order) if order else F.lit(0)
    made = []
    for c in names:
        kind = df.schema[c].dataType
        single = F.count_distinct(col(c)) + F.max(col(c).isNull().cast("int")) == 1
        if isinstance(kind, T.NumericType):
            made.append(METHODS[method](c, na_rm).alias(c))
        elif isinstance(kind, T.BooleanType) or (drop_multival_string and c not in factors):
            made.append(F.when(single, F.first(col(c), ignorenulls=True)).alias(c))
        else:
            seen = F.array_sort(F.collect_set(F.struct(place.alias("p"), F.coalesce(col(c).cast("string"), F.lit("NA")).alias("v"))))
            made.append(F.array_join(F.array_distinct(F.transform(seen, lambda s: s["v"])), sep).alias(c))
    out = X.agg_wide(df, [grouping], made)
    if drop_na_col and names:
        row = out.agg(*(F.count(col(c)).alias(c) for c in names)).first()
        out = out.drop(*(c for c in names if not row[c]))
    return out


def aggregate_by_imagecol(dataset: Dataset, grouping: str, method: str = "mean", na_rm: bool = True, **how) -> Dataset:
    """A dataset whose objects and images are the values of a column of the images. Reductions and graph go."""
    if grouping not in columns_but(dataset.images, IMAGE):
        raise ValueError(f"{grouping} is no column of the images")
    images = dataset.images.withColumn("_g", col(grouping).cast("string"))
    groups = dataset.objects.select(OBJECT, IMAGE).join(images.select(IMAGE, "_g"), IMAGE, "left")
    objects = aggregate_metadata(dataset.objects.join(images.select(IMAGE, "_g"), IMAGE, "left").drop(OBJECT, IMAGE), "_g", method, na_rm, **how)
    assays = {n: aggregate_assay(a, groups, "_g", method, na_rm) for n, a in dataset.assays.items()}
    image_assays = {}
    for n, table in dataset.image_assays.items():
        rows = table.join(images.select(IMAGE, "_g"), IMAGE)
        image_assays[n] = aggregate_matrix(rows, columns_but(table, IMAGE), "_g", method, na_rm).withColumnRenamed("_g", IMAGE)
    own = aggregate_metadata(images.drop(IMAGE), "_g", method, na_rm, **how).withColumnRenamed("_g", IMAGE)
    named = objects.withColumn(OBJECT, col("_g")).withColumnRenamed("_g", IMAGE)
    return replace(dataset, objects=named, images=own, assays=assays, image_assays=image_assays, reductions={}, graph=None)


# --- plates -----------------------------------------------------------------------------------------------------------


def new_plate(spark, fmt: str = "384") -> DataFrame:
    """``(row, column, well)`` of an empty plate."""
    rows, columns = PLATES[fmt]
    grid = spark.range(rows * columns).select((F.floor(F.col("id") / columns) + 1).cast("int").alias("row"), (F.col("id") % columns + 1).cast("int").alias("column"))
    return grid.withColumn("well", F.concat(F.char(F.col("row") + 64), F.lpad(F.col("column").cast("string"), 2, "0")))


def well_to_index(df: DataFrame, well: str = "well") -> DataFrame:
    return df.withColumns({"row": X.well_row(well).cast("int"), "column": X.well_column(well)})


def aggregate_to_plate(df: DataFrame, feature: str, well: str = "well", plate: str = "plate", fmt: str = "384", method: str | Callable = "mean", na_rm: bool = True, wide: bool = False) -> DataFrame:
    """A value for each well of each plate: an aggregate of numbers, the only value of text; wells without rows are missing.

    ``wide`` lays a plate out with a column for each of its columns.
    """
    if isinstance(df.schema[feature].dataType, T.StringType):
        value = F.when(F.count_distinct(col(feature)) == 1, F.first(col(feature), ignorenulls=True))
    else:
        value = METHODS[method](feature, na_rm) if isinstance(method, str) else method(known(feature))
    values = df.groupBy(col(plate), col(well)).agg(value.alias("value"))
    grid = new_plate(df.sparkSession, fmt)
    # every plate has every well: the grid's size is fixed
    full = values.select(col(plate)).distinct().crossJoin(F.broadcast(grid))
    out = full.join(values.select(col(plate), col(well).alias("well"), "value"), [plate, "well"], "left").select(col(plate), "well", "row", "column", "value")
    if not wide:
        return out
    return out.groupBy(col(plate), "row").pivot("column", list(range(1, PLATES[fmt][1] + 1))).agg(F.first("value", ignorenulls=True))


def child_rollup(parents: DataFrame, children: DataFrame, parent_keys: list[str], child_keys: list[str], features: list[str], prefix: str, na_rm: bool = False) -> DataFrame:
    """``parents`` with the mean of each feature of their children and the number of these; NULL without any."""
    own = children.filter(X.all_of([col(k).isNotNull() for k in child_keys]) & (col(child_keys[-1]) != 0))
    rolled = own.groupBy(*(col(c).alias(p) for c, p in zip(child_keys, parent_keys))).agg(*(X.mean(f, na_rm).alias(f"{prefix}_{f}") for f in features), F.count(F.lit(1)).alias(f"{prefix}_QC_Object_Count"))
    return parents.join(rolled, parent_keys, "left")
