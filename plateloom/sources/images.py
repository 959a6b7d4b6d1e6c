"""Image files: an index by plate, well and field, crops around objects, registration matrices."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateloom.functions.exprs import col, number
from plateloom.model import OBJECT, Dataset
from plateloom.operators.image import PIXELS, crop, to_row
from plateloom.operators.resolve import get_data_by_object


def index_from_paths(paths: DataFrame, pattern: str = r"([^/]+)/([A-Z])/(\d+)/([^/]+)\.ome\.tiff?$") -> DataFrame:
    """``(path, plate, row, column, well, field, key)`` of paths such as ``<plate>/<row>/<column>/<field>.ome.tiff``."""
    part = lambda k: F.regexp_extract("path", pattern, k)
    rows = paths.filter(F.col("path").rlike(pattern)).select("path", part(1).alias("plate"), part(2).alias("row"), part(3).cast("int").alias("column"), part(4).alias("field"))
    rows = rows.withColumn("well", F.concat("row", F.lpad(F.col("column").cast("string"), 2, "0")))
    return rows.withColumn("key", F.concat_ws(":", "plate", "well", "field"))


def build_img_index(spark: SparkSession, path: str, plate_filter: list[str] | None = None, pattern: str = r"([^/]+)/([A-Z])/(\d+)/([^/]+)\.ome\.tiff?$") -> DataFrame:
    """The index of all images under a folder; only paths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = index_from_paths(files, pattern)
    return found if plate_filter is None else found.filter(F.col("plate").isin(plate_filter))


def binmat_bytes(x: np.ndarray) -> bytes:
    """A matrix as two 32-bit dimensions and doubles, column by column."""
    return struct.pack("<ii", *x.shape) + np.asarray(x, "<f8").tobytes(order="F")


def parse_binmat(data: bytes) -> np.ndarray:
    rows, columns = struct.unpack("<ii", data[:8])
    if len(data) < 8 + 8 * rows * columns:
        raise ValueError("the matrix ends early")
    return np.frombuffer(data, "<f8", rows * columns, 8).reshape((rows, columns), order="F")


def read_binmat(spark: SparkSession, path: str) -> DataFrame:
    """``(path, matrix array<array<double>>)``, the rows of each matrix file."""

    def run(batches):
        for batch in batches:
            made = [parse_binmat(x.as_py()).tolist() for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.list_(pa.list_(pa.float64())))], names=["path", "matrix"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, matrix array<array<double>>")


def decode_npy(data: bytes) -> np.ndarray:
    """The decoder in use without an imaging library: numpy's own format (y, x, channel, plane)."""
    import io

    return np.load(io.BytesIO(data), allow_pickle=False)


def shift_registered(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A stack under an affine transform of (x, y), by the nearest pixel; what comes from outside is 0."""
    ys, xs = np.mgrid[0 : x.shape[0], 0 : x.shape[1]]
    source = np.tensordot(np.linalg.inv(np.vstack([matrix[:2, :3], [0, 0, 1]]))[:2], np.stack([xs, ys, np.ones_like(xs)]), 1)
    sx, sy = np.rint(source).astype(int)
    inside = (sx >= 0) & (sx < x.shape[1]) & (sy >= 0) & (sy < x.shape[0])
    out = np.zeros_like(x)
    out[inside] = x[sy[inside], sx[inside]]
    return out


def object_positions(dataset: Dataset, x: str, y: str, group_col: str, assay: str | None = None) -> DataFrame:
    """``(object_id, x, y, key)``: where each object is, and in which image of the index."""
    return get_data_by_object(dataset, [x, y, group_col], assay).select(OBJECT, number(x).alias("x"), number(y).alias("y"), col(group_col).alias("key"))


def read_imgs(positions: DataFrame, index: DataFrame, window: int = 75, channels: list[int] | None = None, planes: list[int] | None = None, max_project: bool = False, decoder: Callable[[bytes], np.ndarray] = decode_npy, further: list[tuple[DataFrame, DataFrame | None]] = ()) -> DataFrame:
    """``(object_id, dims, data)``: the pixels around each object of ``positions(object_id, x, y, key)``.

    Image files are decoded by the tasks that hold their objects, once for all objects in an image. ``further`` cycles are
    (index, matrices): their images of the same key, moved by their matrix if there is one, follow as channels.
    """
    spark = positions.sparkSession
    wanted = positions.groupBy("key").agg(F.collect_list(F.struct(OBJECT, "x", "y")).alias("objects"))
    jobs = wanted.join(index.select("key", "path"), "key")
    names = ["path"]
    for k, (cycle, matrices) in enumerate(further, 1):
        jobs = jobs.join(cycle.select("key", F.col("path").alias(f"path{k}")), "key", "left")
        names.append(f"path{k}")
        if matrices is not None:
            jobs = jobs.join(matrices.select("key", F.col("matrix").alias(f"matrix{k}")), "key", "left")
        else:
            jobs = jobs.withColumn(f"matrix{k}", F.lit(None).cast("array<array<double>>"))
    folder = lambda p: p.rsplit("/", 1)[0]
    for name in names:  # contents come with a join on path, so that any store works
        folders = sorted({folder(r.p) for r in jobs.select(col(name).alias("p")).filter("p is not null").distinct().toLocalIterator()})
        if folders:
            files = spark.read.format("binaryFile").load(folders).select(F.col("path").alias(name), F.col("content").alias(f"content_{name}"))
            jobs = jobs.join(files, name, "left")
        else:
            jobs = jobs.withColumn(f"content_{name}", F.lit(None).cast("binary"))
    n_more = len(names) - 1

    def run(batches):
        for batch in batches:
            rows = {OBJECT: [], "dims": [], "data": []}
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                content = get("content_path")
                if content is None:
                    continue
                stack = decoder(content)
                stack = stack[:, :, None] if stack.ndim == 2 else stack
                for k in range(1, n_more + 1):
                    more = get(f"content_path{k}")
                    if more is not None:
                        other = decoder(more)
                        other = other[:, :, None] if other.ndim == 2 else other
                        matrix = get(f"matrix{k}")
                        stack = np.concatenate([stack, shift_registered(other, np.asarray(matrix)) if matrix is not None else other], 2)
                stack = stack[:, :, channels] if channels is not None else stack
                if stack.ndim == 4:
                    stack = stack[:, :, :, planes] if planes is not None else stack
                    stack = stack.max(3) if max_project else stack
                for o in get("objects"):
                    dims, data = to_row(crop(stack, o["x"], o["y"], window).astype(float))
                    rows[OBJECT].append(str(o[OBJECT]))
                    rows["dims"].append(dims)
                    rows["data"].append(data)
            yield pa.RecordBatch.from_arrays([pa.array(rows[OBJECT], pa.string()), pa.array(rows["dims"], pa.list_(pa.int32())), pa.array(rows["data"], pa.list_(pa.float64()))], names=[OBJECT, "dims", "data"])

    return jobs.mapInArrow(run, PIXELS)
