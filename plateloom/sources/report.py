"""A text report of named values, and example data."""

from __future__ import annotations

import platform
from pathlib import Path

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession

from plateloom.model import Dataset, dataset_from_matrices


def log_state(values: dict[str, object], file: str, max_rows: int = 20) -> str:
    """Writes each value under its name, tables up to ``max_rows`` rows in aligned columns, and versions; returns the text."""
    if not isinstance(values, dict) or any(not isinstance(k, str) or not k for k in values):
        raise ValueError("every value needs a name")
    lines = []
    for name, value in values.items():
        lines.append(f"== {name}")
        if isinstance(value, DataFrame):
            lines.append(value.limit(max_rows).toPandas().to_string(index=False))
        elif isinstance(value, pd.DataFrame):
            lines.append(value.head(max_rows).to_string(index=False))
        elif isinstance(value, (list, tuple)):
            lines += [f"  {x}" for x in value[:max_rows]] + (["  ..."] if len(value) > max_rows else [])
        elif isinstance(value, dict):
            width = max((len(str(k)) for k in value), default=0)
            lines += [f"  {str(k).ljust(width)} : {v}" for k, v in list(value.items())[:max_rows]]
        else:
            lines.append(f"  {value!r}" if isinstance(value, Dataset) else f"  {value}")
        lines.append("")
    lines += ["== versions", f"  python {platform.python_version()}", f"  pyspark {pyspark.__version__}", f"  numpy {np.__version__}", f"  pandas {pd.__version__}"]
    text = "\n".join(lines) + "\n"
    Path(file).write_text(text)
    return text


def example_dataset(spark: SparkSession, objects: int = 200, features: int = 12, images: int = 20, seed: int = 1) -> Dataset:
    """Made-up cells on two plates in three classes, with constant, missing, infinite, zero-heavy and negative features."""
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, 3, objects)
    x = rng.normal(size=(objects, features)) + kind[:, None] * (np.arange(features) < 3)
    names = [f"cell_Category{i % 3}_Feature{i}" for i in range(features)]
    frame = pd.DataFrame(x, columns=names)
    special = {"const": np.ones(objects), "gaps": np.where(rng.random(objects) < 0.05, None, x[:, 0]), "nan": np.where(rng.random(objects) < 0.05, np.nan, x[:, 1]), "inf": np.where(np.arange(objects) == 3, np.inf, x[:, 2]), "zeros": np.where(rng.random(objects) < 0.7, 0.0, x[:, 3]), "negative": -np.exp(x[:, 4]), "two": (x[:, 5] > 0).astype(float)}
    for k, v in special.items():
        frame[f"cell_Special_{k}"] = v
    ids = [f"FS1_I{i % images}_O{i}" for i in range(objects)]
    rows = [(i, *(None if v is None else float(v) for v in r)) for i, r in zip(ids, frame.itertuples(index=False))]
    data = spark.createDataFrame(rows, "object_id string, " + ", ".join(f"{c} double" for c in frame.columns))
    meta = spark.createDataFrame([(o, f"FS1_I{i % images}", ["a", "b", "c"][kind[i]], bool(i % 4 == 0), float(i % 30), float(i // 30)) for i, o in enumerate(ids)], "object_id string, image_id string, drug string, is_control boolean, x double, y double")
    wells = spark.createDataFrame([(f"FS1_I{k}", f"P{k % 2}", f"{'ABCD'[k % 4]}{k % 12 + 1:02d}", str(k % 3), float(k), 0.5 * k) for k in range(images)], "image_id string, plate string, well string, field string, Count_cell double, ExecutionTime_01 double")
    return dataset_from_matrices(data, meta, wells)
