"""Readers of segmented-image feature tables: filesets of tab-separated text, plain (A) or zipped with child objects (B)."""

from __future__ import annotations

import io
import re
import warnings
import zipfile
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateloom.functions.exprs import col
from plateloom.operators.resolve import feature_meta_from_names


def add_global_ids(df: DataFrame, fileset_id: int | str) -> DataFrame:
    """``<column>_Global`` for every id column: ``FS<fileset>_I<image>``, and with ``_O<object>`` for objects. NULL stays NULL."""
    images = [c for c in df.columns if "ImageNumber" in c and not c.endswith("_Global")]
    objects = [c for c in df.columns if re.search("ObjectNumber|Object_Number|Parent", c) and not c.endswith("_Global")]
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("bigint").cast("string"), col(c).cast("string"))
    made = {f"{c}_Global": F.concat(F.lit(f"FS{fileset_id}_I"), number(c)) for c in images}
    if images:
        made |= {f"{c}_Global": F.concat(F.lit(f"FS{fileset_id}_I"), number(images[0]), F.lit("_O"), number(c)) for c in objects}
    return df.withColumns(made)


def _files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths under a folder whose name matches a regular expression, sorted; listed by Spark, so on any store."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return sorted(r.path for r in found.filter(F.col("path").rlike(pattern)).collect())


def _lines(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(n).collect()]


def read_table(spark: SparkSession, path: str, header_rows: int = 1, sep: str = "\t") -> DataFrame | None:
    """A text table whose header takes one or two rows, which are joined by ``_``; numbers are doubles if they all are.

    None if it has no row. Header rows are told from others by their text, and types are inferred by Spark.
    """
    head = _lines(spark, path, header_rows + 1)
    if len(head) <= header_rows:
        return None
    names = ["_".join(p for p in parts if p) for parts in zip(*(x.split(sep) for x in head[:header_rows]))]
    text = spark.read.text(path).filter(~F.col("value").isin(head[:header_rows]) & (F.length("value") > 0))
    split = F.split("value", sep, -1)
    rows = text.select(*(F.nullif(F.get(split, i), F.lit("")).alias(n) for i, n in enumerate(names)))
    numeric = rows.agg(*(F.min((col(n).isNull() | col(n).isin("NA", "nan", "NaN") | col(n).try_cast("double").isNotNull()).cast("int")).alias(n) for n in names)).first()
    return rows.select(*((F.when(col(n) == "NA", None).otherwise(col(n)).try_cast("double") if numeric[n] else col(n)).alias(n) for n in names))


def read_cellprofiler_fileset_a(spark: SparkSession, prefix: str, fileset_id: int | str = 1, return_feature_meta: bool = False, add_global_id: bool = True, pat_img: str = "_Image.txt", pat_cells: str = "_cell.txt", pat_orl: str = "_Object relationships.txt", skip_orl: bool = False, min_cells: int = 2) -> dict | None:
    """Cells, images and object relationships of a plain fileset; None with fewer than ``min_cells`` cells."""
    cells = read_table(spark, prefix + pat_cells, 2)
    if cells is None or len(cells.limit(min_cells).collect()) < min_cells:
        return None
    out = {"cells": cells, "meta": read_table(spark, prefix + pat_img)}
    if not skip_orl:
        out["orl"] = read_table(spark, prefix + pat_orl)
    if add_global_id:
        out["cells"], out["meta"] = (add_global_ids(out[k], fileset_id) for k in ("cells", "meta"))
        if out.get("orl") is not None:
            out["orl"] = orl_ids(out["orl"], fileset_id)
    if return_feature_meta:
        out["features"] = feature_meta(out["cells"])
    return out


def orl_ids(orl: DataFrame, fileset_id: int | str) -> DataFrame:
    """Global ids of images and objects on both sides of the relationships."""
    whole = lambda c: F.coalesce(col(c).try_cast("bigint").cast("string"), col(c).cast("string"))
    made = {}
    for side in ("First", "Second"):
        image = F.concat(F.lit(f"FS{fileset_id}_I"), whole(f"{side} Image Number"))
        made |= {f"{side}_ImageNumber_Global": image, f"{side}_ObjectNumber_Global": F.concat(image, F.lit("_O"), whole(f"{side} Object Number"))}
    return orl.withColumns(made)


def feature_meta(cells: DataFrame) -> DataFrame:
    spark = cells.sparkSession
    types = spark.createDataFrame([(f.name, "numeric" if f.dataType.typeName() == "double" else "character") for f in cells.schema], "id string, type string")
    return feature_meta_from_names(types).join(types, "id")


def _zip_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(file, table)``: the text members of a zip archive, decoded by a task."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.endswith(".txt")]
                    yield pd.DataFrame({"file": [n.rsplit("/", 1)[-1] for n in names], "value": [z.read(n).decode("utf-8", "replace") for n in names]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, value string")


def _member(texts: DataFrame, file: str, names: list[str], numeric: dict[str, bool], sep: str = "\t") -> DataFrame:
    lines = texts.filter(F.col("file") == file).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).filter("at > 0 and length(line) > 0")
    split = F.split("line", sep, -1)
    cells = [F.nullif(F.get(split, i), F.lit("")) for i in range(len(names))]
    return lines.select(*((F.when(x == "NA", None).otherwise(x).try_cast("double") if numeric[n] else x).alias(n) for n, x in zip(names, cells)))


def _members(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame | None, list[str]]]:
    """The tables of an archive by file name, with their columns; None for one without rows."""
    texts = _zip_tables(spark, path).persist()
    sep = "\t"
    out: dict = {}
    for r in texts.select("file", F.split("value", "\r?\n", 2)[0].alias("head"), (F.size(F.filter(F.split("value", "\r?\n"), lambda x: F.length(x) > 0)) > 1).alias("has")).collect():
        names = r.head.split(sep)
        if not r.has:
            out[r.file] = (None, names)
            continue
        raw = _member(texts, r.file, names, dict.fromkeys(names, False))
        row = raw.agg(*(F.min((col(n).isNull() | col(n).isin("NA", "nan", "NaN") | col(n).try_cast("double").isNotNull()).cast("int")).alias(n) for n in names)).first()
        out[r.file] = (_member(texts, r.file, names, {n: bool(row[n]) for n in names}), names)
    return out


def read_cellprofiler_fileset_b(spark: SparkSession, path: str, fileset_id: int | str = 1, merging_strategy: str = "mean", parent_col: str = "Parent_cell", add_global_id: bool = True, pat_img: str = "_Image.txt", pat_cells: str = "_cell.txt", pat_exp: str = "_Experiment.txt", pat_orl: str = "_Object relationships.txt", pat_others: str = r".*_([^_]+)\.txt$", na_rm: bool = False, skip_orl: bool = False, skip_children: bool = False) -> dict | None:
    """Cells, images, relationships and child objects of a zipped fileset.

    ``mean``: cells get the mean of every feature of their children of each kind, and the number of these; children of
    object 0 have no parent. ``none``: child tables are returned as ``children``.
    """
    if merging_strategy not in ("mean", "none"):
        raise ValueError("the merging strategy is mean or none")
    tables = _members(spark, path)
    pick = lambda end: next((f for f in sorted(tables) if f.endswith(end)), None)
    cells_at = pick(pat_cells)
    if cells_at is None or tables[cells_at][0] is None:
        return None
    cells = tables[cells_at][0]
    cells = cells.withColumnsRenamed({c: f"cell_{c}" for c in cells.columns})
    out: dict = {"meta": tables[pick(pat_img)][0]}
    if not skip_orl and pick(pat_orl):
        out["orl"] = tables[pick(pat_orl)][0]
    children = {}
    if not skip_children:
        known = {pick(p) for p in (pat_img, pat_cells, pat_exp, pat_orl)}
        for f in sorted(set(tables) - known):
            if found := re.match(pat_others, f):
                children[found[1]] = tables[f]
    if merging_strategy == "mean":
        for name, (child, columns) in children.items():
            own = [c for c in columns if c not in ("ImageNumber", "ObjectNumber", "Number_Object_Number", parent_col)]
            if child is None:
                cells = cells.withColumns({f"{name}_{c}": F.lit(None).cast("double") for c in [*own, "QC_Object_Count"]})
                continue
            numeric = [c for c in own if child.schema[c].dataType.typeName() == "double"]
            kept = child.filter(col(parent_col) != 0)
            value = lambda c: F.avg(col(c)) if na_rm else F.when(F.count(col(c)) == F.count(F.lit(1)), F.avg(col(c)))
            rolled = kept.groupBy(col("ImageNumber").alias("cell_ImageNumber"), col(parent_col).alias("cell_ObjectNumber")).agg(*(value(c).alias(f"{name}_{c}") for c in numeric), F.count(F.lit(1)).alias(f"{name}_QC_Object_Count"))
            cells = cells.join(rolled, ["cell_ImageNumber", "cell_ObjectNumber"], "left")
    else:
        out["children"] = {n: c for n, (c, _) in children.items() if c is not None}
    out["cells"] = cells
    if add_global_id:
        out["cells"], out["meta"] = add_global_ids(cells, fileset_id), add_global_ids(out["meta"], fileset_id)
        if "orl" in out:
            out["orl"] = orl_ids(out["orl"], fileset_id)
        if "children" in out:
            out["children"] = {n: add_global_ids(c, fileset_id) for n, c in out["children"].items()}
    return out


def merge_filesets(parts: list[dict], skip_orl: bool = False) -> dict:
    """All filesets whose tables have as many columns as most have (the fewer, on a tie); others are left out with a warning."""
    keys = ["cells", "meta", *([] if skip_orl else ["orl"])]
    shape = lambda p, k: len(p[k].columns) if p.get(k) is not None else 0
    usual = {}
    for k in keys:
        votes = Counter(shape(p, k) for p in parts)
        usual[k] = min(votes, key=lambda n: (-votes[n], n))
    good = [p for p in parts if all(shape(p, k) == usual[k] for k in keys)]
    if len(good) < len(parts):
        warnings.warn(f"{len(parts) - len(good)} filesets have other columns and are left out", stacklevel=2)
    both = lambda k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[k] for p in good if p.get(k) is not None])
    out = {k: both(k) for k in [*keys, "cells_norm"] if any(p.get(k) is not None for p in good)}
    if any("children" in p for p in good):
        names = sorted({n for p in good for n in p.get("children", {})})
        out["children"] = {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p["children"][n] for p in good if n in p.get("children", {})]) for n in names}
    if any("features" in p for p in good):
        out["features"] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p["features"] for p in good if "features" in p]).dropDuplicates(["id"])
    return out


def read_cellprofiler_dir(spark: SparkSession, path: str, pattern: str = "_cell.txt", type: str = "A", n: int | list[int] | None = None, skip_orl: bool = True, col_object: str = "cell_ObjectNumber_Global", max_per_well: int | None = None, **how) -> dict:
    """All filesets under a folder as one; filesets are numbered in order of their paths, empty ones too."""
    files = _files(spark, path, re.escape(pattern) + "$" if type == "A" else pattern)
    if n is not None:
        files = files[:n] if isinstance(n, int) else [files[i] for i in n]
    parts = []
    for k, file in enumerate(files, 1):
        if type == "A":
            part = read_cellprofiler_fileset_a(spark, file[: -len(pattern)], k, pat_cells=pattern, skip_orl=skip_orl, **how)
        else:
            part = read_cellprofiler_fileset_b(spark, file, k, skip_orl=skip_orl, **how)
        if part is None:
            continue
        if max_per_well is not None and len(part["cells"].limit(max_per_well + 1).collect()) > max_per_well:
            warnings.warn(f"{file} has over {max_per_well} cells and is left out", stacklevel=2)
            continue
        parts.append(part)
    if not parts:
        raise ValueError(f"no fileset under {path} has cells")
    out = merge_filesets(parts, skip_orl)
    out["features"] = feature_meta(out["cells"])
    out["cells"] = out["cells"].filter(col(col_object).isNotNull())
    return out
