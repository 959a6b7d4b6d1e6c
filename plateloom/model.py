"""The data model: objects, the images they are in, assays of features, reductions, a neighbour graph.

Rows have no order; tables are aligned by ``object_id`` and ``image_id``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.functions.exprs import col

OBJECT, IMAGE = "object_id", "image_id"
SLOTS = ("data", "scale_data")
IMAGE_ASSAYS = ("image.data", "image.data.trans", "image.data.norm")


def columns_but(df: DataFrame, *keys: str) -> list[str]:
    return [c for c in df.columns if c not in keys]


def feature_matrix(df: DataFrame, key: str = OBJECT) -> DataFrame:
    """``df`` checked to be a key and numeric features, which become doubles."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    bad = [f.name for f in df.schema if f.name != key and f.dataType.typeName() not in ("double", "float", "integer", "long", "short", "byte", "decimal", "boolean", "void")]
    if bad:
        raise TypeError(f"features must be numeric: {', '.join(bad)}")
    return df.select(col(key).cast("string").alias(key), *(col(c).cast("double").alias(c) for c in columns_but(df, key)))


@dataclass(frozen=True)
class Assay:
    """Features of objects, as measured and scaled, and a table about the features with a row for each."""

    data: DataFrame
    scale_data: DataFrame | None = None
    features: DataFrame | None = None

    @property
    def feature_names(self) -> list[str]:
        return columns_but(self.data, OBJECT)

    def slot(self, name: str = "data") -> DataFrame:
        if name not in SLOTS:
            raise ValueError(f"slot {name} is none of {', '.join(SLOTS)}")
        found = getattr(self, name)
        if found is None:
            raise ValueError(f"the assay has no {name}")
        return found

    def feature_table(self) -> DataFrame:
        if self.features is not None:
            return self.features
        spark = self.data.sparkSession
        return spark.createDataFrame([(c, True) for c in self.feature_names], "id string, analyze boolean")

    def select(self, features: list[str]) -> Assay:
        table = None if self.features is None else self.features.filter(F.col("id").isin(features))
        pick = lambda df: df.select(OBJECT, *map(col, features))
        return Assay(pick(self.data), pick(self.scale_data) if self.scale_data is not None else None, table)

    def where(self, ids: DataFrame) -> Assay:
        """The objects that ``ids`` has."""
        pick = lambda df: df.join(ids.select(OBJECT), OBJECT, "left_semi")
        return replace(self, data=pick(self.data), scale_data=pick(self.scale_data) if self.scale_data is not None else None)

    def __getitem__(self, feature: str) -> dict[str, DataFrame]:
        """A feature as measured and scaled."""
        return {s: getattr(self, s).select(OBJECT, col(feature)) for s in SLOTS if getattr(self, s) is not None}

    def __repr__(self) -> str:
        return f"Assay with {len(self.feature_names)} features" + (", scaled" if self.scale_data is not None else "")


@dataclass(frozen=True)
class Reduction:
    """Scores of objects in few dimensions, the variance of each, that of all, and loadings (feature by dimension)."""

    scores: DataFrame
    var: list[float]
    var_total: float | None = None
    loadings: dict | None = None

    @property
    def dims(self) -> list[str]:
        return columns_but(self.scores, OBJECT)

    def where(self, ids: DataFrame) -> Reduction:
        return replace(self, scores=self.scores.join(ids.select(OBJECT), OBJECT, "left_semi"))


@dataclass(frozen=True)
class FilterSpec:
    """A declared filter: which columns (a regular expression, or all), which function by name, and its threshold."""

    name: str
    column_pattern: str
    func: str
    threshold: float | None = None
    transpose: bool = False
    active: bool = True
    threshold2: float | None = None
    metadata_group: str | None = None


@dataclass(frozen=True)
class FeatureLocation:
    """Where a column is: in an assay's slot, or, with neither, in the metadata."""

    column: str
    assay: str | None = None
    slot: str | None = None

    def __post_init__(self) -> None:
        if (self.assay is None) != (self.slot is None):
            raise ValueError("assay and slot are set both or not at all")


@dataclass(frozen=True)
class FeatureMap:
    """Which columns hold position, plate, well and field."""

    x: FeatureLocation | None = None
    y: FeatureLocation | None = None
    z: FeatureLocation | None = None
    plate: FeatureLocation | None = None
    well: FeatureLocation | None = None
    field: FeatureLocation | None = None


@dataclass(frozen=True)
class Graph:
    """Neighbour edges ``(src, dst, dist)`` and what they were made with."""

    edges: DataFrame
    k: int
    reduction: str
    exact: bool


@dataclass(frozen=True)
class Dataset:
    """Objects with metadata and their image, images with metadata, assays of either, reductions and a graph."""

    objects: DataFrame
    images: DataFrame
    assays: dict[str, Assay]
    image_assays: dict[str, DataFrame] = field(default_factory=dict)
    reductions: dict[str, Reduction] = field(default_factory=dict)
    graph: Graph | None = None
    active_assay: str | None = None
    feature_map: FeatureMap | None = None

    def assay(self, name: str | None = None) -> Assay:
        name = name or self.active_assay or next(iter(self.assays))
        if name not in self.assays:
            raise KeyError(f"no assay {name}; there are {', '.join(self.assays)}")
        return self.assays[name]

    def with_assay(self, name: str, assay: Assay) -> Dataset:
        return replace(self, assays={**self.assays, name: assay})

    def with_meta(self, columns: DataFrame) -> Dataset:
        """More object metadata, from a table with ``object_id``; columns of the same name are replaced."""
        own = self.objects.drop(*columns_but(columns, OBJECT))
        return replace(self, objects=own.join(columns, OBJECT, "left"))

    @property
    def meta_names(self) -> list[str]:
        return columns_but(self.objects, OBJECT, IMAGE)

    def object_ids(self) -> DataFrame:
        return self.objects.select(OBJECT)

    def with_object_ids(self, mapping: DataFrame) -> Dataset:
        """Objects renamed by ``mapping(object_id, new_id)``, which must name every object, and no two the same."""
        row = self.objects.select(OBJECT).join(mapping, OBJECT, "left").agg(F.count("new_id"), F.count_distinct("new_id"), F.count(F.lit(1))).first()
        if len(set(row)) != 1:
            raise ValueError("new ids must be as many as the objects, and unique")
        swap = lambda df: df.join(mapping, OBJECT).drop(OBJECT).withColumnRenamed("new_id", OBJECT).select(OBJECT, *map(col, columns_but(df, OBJECT)))
        assays = {n: replace(a, data=swap(a.data), scale_data=None if a.scale_data is None else swap(a.scale_data)) for n, a in self.assays.items()}
        return replace(self, objects=swap(self.objects), assays=assays, reductions={n: replace(r, scores=swap(r.scores)) for n, r in self.reductions.items()}, graph=None)

    def where(self, condition: Column | DataFrame) -> Dataset:
        """The objects that meet a condition on their metadata, or that a table of ids has; then the images they are in."""
        kept = self.objects.filter(condition) if isinstance(condition, Column) else self.objects.join(condition.select(OBJECT), OBJECT, "left_semi")
        if self.graph is not None:
            warnings.warn("the neighbour graph doesn't fit a subset and goes", stacklevel=2)
        ids = kept.select(OBJECT)
        images = self.images.join(kept.select(IMAGE).distinct(), IMAGE, "left_semi")
        return replace(
            self,
            objects=kept,
            images=images,
            assays={n: a.where(ids) for n, a in self.assays.items()},
            image_assays={n: a.join(images.select(IMAGE), IMAGE, "left_semi") for n, a in self.image_assays.items()},
            reductions={n: r.where(ids) for n, r in self.reductions.items()},
            graph=None,
        )

    def select(self, features: list[str]) -> Dataset:
        """The assays with these features only; each keeps those it has."""
        return replace(self, assays={n: a.select([f for f in features if f in a.feature_names]) for n, a in self.assays.items()})

    def __getitem__(self, name: str) -> DataFrame:
        """A column of the objects' metadata with their ids."""
        return self.objects.select(OBJECT, col(name))

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *self.meta_names})

    def nrow(self) -> int:
        return self.objects.count()

    def ncol(self, assay: str | None = None) -> int:
        return len(self.assay(assay).feature_names)

    def __repr__(self) -> str:
        parts = [f"assays {', '.join(f'{n} ({len(a.feature_names)})' for n, a in self.assays.items())}", f"{len(self.meta_names)} columns of metadata"]
        return "Dataset: " + "; ".join([*parts, *([f"reductions {', '.join(self.reductions)}"] if self.reductions else []), *(["graph"] if self.graph else [])])


# --- constructors -----------------------------------------------------------------------------------------------------
def assay_from_matrix(data: DataFrame, scale_data: DataFrame | None = None, features: DataFrame | None = None) -> Assay:
    own = feature_matrix(data)
    scaled = None if scale_data is None else feature_matrix(scale_data)
    if scaled is not None and set(scaled.columns) != set(own.columns):
        raise ValueError("scaled features differ from the measured ones")
    return Assay(own, scaled, features)


def assay_from_list(cells: DataFrame, feature_columns: list[str], features: DataFrame | None = None, object_column: str = OBJECT) -> Assay:
    own = cells.select(col(object_column).alias(OBJECT), *map(col, feature_columns))
    table = features or cells.sparkSession.createDataFrame([(c,) for c in feature_columns], "id string")
    return Assay(feature_matrix(own), None, table if "analyze" in table.columns else table.withColumn("analyze", F.lit(True)))


def dataset_from_matrices(data: DataFrame, meta: DataFrame | None = None, images: DataFrame | None = None, assay: str = "raw", image_data: DataFrame | None = None) -> Dataset:
    """A dataset of one assay. Without metadata every object is its own image."""
    objects = meta if meta is not None else data.select(OBJECT)
    if IMAGE not in objects.columns:
        objects = objects.withColumn(IMAGE, F.col(OBJECT))
    images = images if images is not None else objects.select(IMAGE).distinct()
    return Dataset(objects, images, {assay: assay_from_matrix(data)}, {} if image_data is None else {"image.data": feature_matrix(image_data, IMAGE)}, active_assay=assay)


def dataset_from_list(output: dict[str, DataFrame], assay: str = "raw", meta_patterns: tuple[str, ...] = ("ImageNumber", "ObjectNumber", "Object_Number", "Parent_", "Number_Object"), img_feature_patterns: tuple[str, ...] = ("^AreaOccupied", "^ImageQuality", "^Granularity"), col_object: str = "cell_ObjectNumber_Global", col_img_id: str = "Image_ImageNumber_Global", col_meta_img_id: str = "ImageNumber_Global") -> Dataset:
    """What a reader returns (cells, meta, features) as a dataset.

    Columns of cells that match a metadata pattern are metadata, the numeric rest features. Columns of images that match
    a feature pattern are image features; if none does, there is one, all zero.
    """
    import re

    cells, meta = output["cells"], output["meta"]
    matching = lambda names, patterns: [n for n in names if any(re.search(p, n) for p in patterns)]
    own_meta = matching(cells.columns, meta_patterns)
    features = [c for c in cells.columns if c not in own_meta]
    objects = cells.select(col(col_object).alias(OBJECT), col(col_img_id).alias(IMAGE), *(col(c) for c in own_meta))
    images = meta.withColumn(IMAGE, col(col_meta_img_id))
    image_features = matching(meta.columns, img_feature_patterns)
    data = images.select(IMAGE, *(col(c) for c in image_features)) if image_features else images.select(IMAGE, F.lit(0.0).alias("dummy"))
    return Dataset(objects, images.drop(*image_features), {assay: assay_from_list(cells.withColumn(OBJECT, col(col_object)), features, output.get("features"))}, {"image.data": feature_matrix(data, IMAGE)}, active_assay=assay)


UserAggregate = Callable[[Column], Column]
