"""Image stacks as rows: ``object_id, dims array<int> (y, x, channel, plane), data array<double>`` with y fastest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.functions.exprs import col
from plateloom.model import OBJECT

PIXELS = f"{OBJECT} string, dims array<int>, data array<double>"


def to_array(dims: list[int], data) -> np.ndarray:
    return np.asarray(data, float).reshape(dims, order="F")


def to_row(x: np.ndarray) -> tuple[list[int], list[float]]:
    return list(x.shape), x.ravel(order="F").tolist()


def map_images(images: DataFrame, change) -> DataFrame:
    """Each stack under a function of its array."""

    def run(batches):
        for batch in batches:
            out = [to_row(change(to_array(d.as_py(), x.as_py()))) for d, x in zip(batch.column("dims"), batch.column("data"))]
            yield pa.RecordBatch.from_arrays([batch.column(OBJECT), pa.array([d for d, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out], pa.list_(pa.float64()))], names=[OBJECT, "dims", "data"])

    return images.select(col(OBJECT).cast("string").alias(OBJECT), "dims", F.col("data").cast("array<double>").alias("data")).mapInArrow(run, PIXELS)


def pixels(images: DataFrame) -> DataFrame:
    """``(object_id, y, x, channel, plane, value)``, a row for each pixel, counted from 0."""
    rows = images.select(OBJECT, "dims", F.posexplode("data").alias("at", "value"))
    size = lambda k: F.coalesce(F.get("dims", k), F.lit(1))
    steps: list[Column] = [F.lit(1), size(0), size(0) * size(1), size(0) * size(1) * size(2)]
    return rows.select(OBJECT, *((F.floor(F.col("at") / s) % size(k)).cast("int").alias(n) for k, (n, s) in enumerate(zip(("y", "x", "channel", "plane"), steps))), "value")


def img_apply_color(images: DataFrame, color: tuple[float, float, float]) -> DataFrame:
    """Three channels, each times its part of a colour; a grey image is put into all three."""

    def change(x: np.ndarray) -> np.ndarray:
        x = x[:, :, None] if x.ndim == 2 else x
        x = np.repeat(x, 3, 2) if x.shape[2] == 1 else x
        return x * np.asarray(color).reshape(1, 1, 3, *[1] * (x.ndim - 3))

    return map_images(images, change)


def img_composite(images: DataFrame, colors: list[tuple[float, float, float]], group: str = "group", order: str = "channel") -> DataFrame:
    """``(object_id, dims, data)``: the grey 2-D images of a group, in order, each in its colour, averaged."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        stacks = [to_array(d.as_py(), x.as_py()) for d, x in zip(table.column("dims"), table.column("data"))]
        if any(s.ndim != 2 for s in stacks) or len(stacks) > len(colors):
            raise ValueError("grey 2-D images are needed, and a colour for each")
        out = np.mean([s[:, :, None] * np.asarray(c) for s, c in zip(stacks, colors)], 0)
        dims, data = to_row(out)
        return pa.table({OBJECT: [str(table.column(group)[0].as_py())], "dims": pa.array([dims], pa.list_(pa.int32())), "data": pa.array([data], pa.list_(pa.float64()))})

    return images.select(col(group), col(order), "dims", F.col("data").cast("array<double>").alias("data")).groupBy(group).applyInArrow(run, PIXELS)


def img_max_per_channel(images: DataFrame, q: float = 1.0) -> DataFrame:
    """``(channel, factor)``: the largest, over images, of a quantile of each channel (the third dimension)."""
    own = pixels(images).groupBy(OBJECT, "channel").agg(F.percentile("value", F.lit(float(q))).alias("v"))
    return own.groupBy("channel").agg(F.max("v").alias("factor"))


def img_norm(images: DataFrame, factors: list[float] | None = None, q: float = 1.0) -> DataFrame:
    """Channels divided by their factors, by default those of ``img_max_per_channel``."""
    if factors is None:
        factors = [r.factor for r in img_max_per_channel(images, q).orderBy("channel").collect()]
    by = np.asarray(factors, float)

    def change(x: np.ndarray) -> np.ndarray:
        return x / by[0] if x.ndim == 2 else x / by.reshape(1, 1, -1, *[1] * (x.ndim - 3))

    return map_images(images, change)


def img_max_project(images: DataFrame) -> DataFrame:
    """The largest value over planes (the fourth dimension)."""
    return map_images(images, lambda x: x.max(3) if x.ndim == 4 else x)


def crop(x: np.ndarray, centre_x: float, centre_y: float, window: int = 75) -> np.ndarray:
    """The part within ``window`` pixels of a position, cut at the borders."""
    cx, cy = round(centre_x), round(centre_y)
    return x[max(cy - window, 0) : cy + window + 1, max(cx - window, 0) : cx + window + 1]
