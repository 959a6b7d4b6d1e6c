"""Integrity constraints of a dataset as tables of violations."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.functions.exprs import col
from plateloom.model import IMAGE, OBJECT, Assay, Dataset


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of ``child`` that ``parent`` doesn't have."""
    return child.select(col(key)).distinct().join(parent.select(col(key)), key, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(col(key)).count().filter("count > 1").select(col(key))


def _named(df: DataFrame, key: str, what: str) -> DataFrame:
    return df.select(F.lit(what).alias("violation"), col(key).cast("string").alias("key"))


def violations(dataset: Dataset) -> DataFrame:
    """``(violation, key)``: ids that are null, repeated, or missing in a table that should have them."""
    found = [
        _named(dataset.objects.filter(F.col(OBJECT).isNull()), OBJECT, "object without id"),
        _named(duplicates(dataset.objects, OBJECT), OBJECT, "object id repeated"),
        _named(duplicates(dataset.images, IMAGE), IMAGE, "image id repeated"),
        _named(orphans(dataset.objects, dataset.images, IMAGE), IMAGE, "object in an unknown image"),
        _named(orphans(dataset.images, dataset.objects, IMAGE), IMAGE, "image without objects"),
    ]
    for name, assay in dataset.assays.items():
        for slot, table in (("data", assay.data), ("scale_data", assay.scale_data)):
            if table is not None:
                found += [_named(orphans(a, b, OBJECT), OBJECT, f"{what} {name} {slot}") for a, b, what in ((table, dataset.objects, "unknown object in"), (dataset.objects, table, "object missing in"))]
    for name, table in dataset.image_assays.items():
        found += [_named(orphans(a, b, IMAGE), IMAGE, f"{what} {name}") for a, b, what in ((table, dataset.images, "unknown image in"), (dataset.images, table, "image missing in"))]
    for name, r in dataset.reductions.items():
        found.append(_named(orphans(r.scores, dataset.objects, OBJECT), OBJECT, f"unknown object in reduction {name}"))
    return reduce(DataFrame.union, found)


def assay_violations(assay: Assay) -> list[str]:
    """What is wrong with the columns of an assay and its feature table."""
    own, listed = set(assay.feature_names), {r.id for r in assay.feature_table().select("id").collect()}
    out = [f"feature {c} isn't listed" for c in sorted(own - listed)] + [f"listed feature {c} isn't there" for c in sorted(listed - own)]
    if assay.scale_data is not None and set(assay.scale_data.columns) != set(assay.data.columns):
        out.append("scaled features differ from the measured ones")
    return out


def is_valid(dataset: Dataset) -> bool:
    """Whether no constraint is violated; warns about the first that is."""
    if not dataset.assays:
        warnings.warn("there is no assay", stacklevel=2)
        return False
    first = violations(dataset).head()
    wrong = [f"{first.violation}: {first.key}"] if first else [f"{n}: {w}" for n, a in dataset.assays.items() for w in assay_violations(a)]
    if wrong:
        warnings.warn(wrong[0], stacklevel=2)
    return not wrong
