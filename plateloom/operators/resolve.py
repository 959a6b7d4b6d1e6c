"""Finding columns by name: in images, object metadata, or an assay; and lookups between them."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.functions.exprs import col, number
from plateloom.model import IMAGE, IMAGE_ASSAYS, OBJECT, SLOTS, Assay, Dataset, columns_but


def image_columns(dataset: Dataset, assay_image: str | None = None) -> list[str]:
    names = columns_but(dataset.images, IMAGE)
    chosen = dataset.image_assays.get(assay_image or "image.data")
    return names + ([c for c in columns_but(chosen, IMAGE) if c not in names] if chosen is not None else [])


def is_available(dataset: Dataset, names: list[str], assay: str | None = None, return_names: bool = False):
    """For each name the containers that have it, in the order in which names are resolved; or whether all are found."""
    own = dataset.assays.get(assay or dataset.active_assay or "", None)
    where = {"image": image_columns(dataset), "meta": dataset.meta_names, "assay": own.feature_names if own else []}
    found = {n: [k for k, has in where.items() if n in has] for n in names}
    for n, places in found.items():
        if len(places) > 1:
            warnings.warn(f"{n} is in {', '.join(places)}; the first is used", stacklevel=2)
    return found if return_names else all(found.values())


def get_image_data(dataset: Dataset, names: list[str], assay_image: str | None = None) -> DataFrame:
    """Columns of images, from their metadata or else an image assay, by ``image_id``."""
    own = columns_but(dataset.images, IMAGE)
    extra = [n for n in names if n not in own]
    if not extra:
        return dataset.images.select(IMAGE, *map(col, names))
    table = dataset.image_assays[assay_image or "image.data"]
    joined = dataset.images.select(IMAGE, *(col(n) for n in names if n in own)).join(table.select(IMAGE, *map(col, extra)), IMAGE, "left")
    return joined.select(IMAGE, *map(col, names))


def get_image_data_by_object(dataset: Dataset, names: list[str], assay_image: str | None = None) -> DataFrame:
    """Columns of images repeated for each of their objects. Spark broadcasts the images if their size allows it."""
    return dataset.objects.select(OBJECT, IMAGE).join(get_image_data(dataset, names, assay_image), IMAGE, "left").select(OBJECT, *map(col, names))


def get_data_by_object(dataset: Dataset, names: list[str], assay: str | None = None, assay_image: str | None = None, slot: str = "data") -> DataFrame:
    """Columns by object id, in the order of ``names``, each from images, else object metadata, else the assay."""
    from_images = [n for n in names if n in image_columns(dataset, assay_image)]
    from_meta = [n for n in names if n not in from_images and n in dataset.meta_names]
    rest = [n for n in names if n not in from_images and n not in from_meta]
    out = dataset.objects.select(OBJECT, *([IMAGE] if from_images else []), *map(col, from_meta))
    if from_images:
        out = out.join(get_image_data(dataset, from_images, assay_image), IMAGE, "left")
    if rest:
        if assay is None:
            raise ValueError(f"an assay must be named for {', '.join(rest)}")
        table = dataset.assay(assay).slot(slot)
        lacking = [n for n in rest if n not in table.columns]
        if lacking:
            raise KeyError(f"no column {', '.join(lacking)}")
        out = out.join(table.select(OBJECT, *map(col, rest)), OBJECT, "left")
    return out.select(OBJECT, *map(col, names))


def add_features_to_assay(assay: Assay, features: DataFrame, slot: str = "data", meta: DataFrame | None = None, preserve_other: bool = False) -> Assay:
    """New features, from a table with ``object_id``, in one slot; the other slot gets empty columns, or stays."""
    new = columns_but(features, OBJECT)
    clash = set(new) & set(assay.feature_names)
    if clash:
        raise ValueError(f"features exist already: {', '.join(sorted(clash))}")
    grown = assay.slot(slot).join(features, OBJECT, "left")
    other = SLOTS[1 - SLOTS.index(slot)]
    table = getattr(assay, other)
    if table is not None and not preserve_other:
        table = table.withColumns({n: F.lit(None).cast("double") for n in new})
    listed = assay.feature_table()
    extra = meta if meta is not None else listed.sparkSession.createDataFrame([(n,) for n in new], "id string")
    return replace(assay, **{slot: grown, other: table, "features": listed.unionByName(extra, allowMissingColumns=True)})


def feature_meta_from_names(features: DataFrame, name: str = "id") -> DataFrame:
    """``object_category_rest`` names taken apart: object, measurement (all after it), category and name."""
    parts = F.split(col(name), "_")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return features.select(
        col(name).alias("id"),
        F.get(parts, 0).alias("object"),
        F.array_join(rest, "_").alias("measurement"),
        F.get(parts, 1).alias("category"),
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "_").alias("name"),
    )


def nearest_index(df: DataFrame, value: float | Column, x: str, index: str) -> DataFrame:
    """The index of the row whose ``x`` is nearest to ``value``, the first of equals."""
    target = value if isinstance(value, Column) else F.lit(float(value))
    return df.agg(F.min_by(col(index), F.struct(F.abs(number(x) - target), col(index))).alias("nearest"))


def list_has_overlap(lists: list[list]) -> bool:
    """Whether any two of the lists share an element."""
    seen: set = set()
    for own in map(set, lists):
        if own & seen:
            return True
        seen |= own
    return False


def check_dataset_assay_slot(dataset: Dataset, assay: str, slot: str) -> None:
    if not isinstance(dataset, Dataset):
        raise TypeError("a Dataset is needed")
    if assay in IMAGE_ASSAYS:
        if assay not in dataset.image_assays:
            raise KeyError(f"no image assay {assay}")
        return
    dataset.assay(assay).slot(slot)


def check_package(name: str) -> None:
    """An error that says which package is missing."""
    import importlib.util

    if importlib.util.find_spec(name) is None:
        raise ImportError(f"package {name} is needed here")
