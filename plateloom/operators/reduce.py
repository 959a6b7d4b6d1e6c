"""Cross products, principal components and outliers in their space."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.functions import special
from plateloom.functions.exprs import agg_wide, col, divide, known, missing, number, var_known
from plateloom.model import OBJECT, Dataset, Reduction, columns_but


def cross_products(df: DataFrame, columns: list[str], group: str | None = None) -> dict[str, tuple[np.ndarray, int, np.ndarray]]:
    """By group (``0`` without one): the cross product of the centred columns, the rows, and the columns' sums.

    Rows with a missing value don't count. Every batch is centred on its own means before it is multiplied, and parts are
    merged by their means, so that columns with means far above their spread keep their digits. Every task sums its rows; a
    row of the product is summed by one task each. The driver gets matrices, whose size depends on columns and groups alone.
    """
    k = len(columns)
    schema = "g string, i int, n long, v array<double>, s array<double>"

    def merge(one: list, other: list) -> list:
        (v, n, s), (w, m, t) = one, other
        gap = t / m - s / n
        return [v + w + np.outer(gap, gap) * (n * m / (n + m)), n + m, s + t]

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
            whole = ~np.isnan(x).any(1)
            keys = batch.column("_g").to_numpy(zero_copy_only=False) if group else np.zeros(len(x), int)
            for key in pd.unique(keys[whole]):
                own = x[whole & (keys == key)]
                total = own.sum(0)
                centred = own - total / len(own)
                part = [centred.T @ centred, len(own), total]
                sums[key] = merge(sums[key], part) if key in sums else part
        for key, (v, n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(key)] * k), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array(list(v), pa.list_(pa.float64())), pa.array([s] * k, pa.list_(pa.float64()))], names=["g", "i", "n", "v", "s"])

    def add(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        rows = [[np.array(v), n, np.array(s)] for v, n, s in zip(*(table.column(c).to_pylist() for c in "vns"))]
        v, n, s = rows[0]
        for w, m, t in rows[1:]:
            gap = t / m - s / n
            v, n, s = v + w + gap[i] * gap * (n * m / (n + m)), n + m, s + t
        return pa.table({"g": table.column("g")[:1], "i": table.column("i")[:1], "n": [n], "v": pa.array([v], pa.list_(pa.float64())), "s": pa.array([s], pa.list_(pa.float64()))})

    rows = df.select(*([col(group).cast("string").alias("_g")] if group else []), *(number(c).alias(c) for c in columns))
    if group:
        rows = rows.filter(col("_g").isNotNull())
    out: dict = {}
    for r in rows.mapInArrow(partial, schema).groupBy("g", "i").applyInArrow(add, schema).collect():
        own = out.setdefault(r.g, [np.zeros((k, k)), r.n, np.array(r.s)])
        own[0][r.i] = r.v
    # parts may be merged in another order for each row
    return {g: ((v + v.T) / 2, n, s) for g, (v, n, s) in out.items()}


def gram(df: DataFrame, columns: list[str], group: str | None = None):
    """X'X over all rows without a missing value, and their number; by group, a dict of both."""
    found = {g: (v + np.outer(s, s) / n, n) for g, (v, n, s) in cross_products(df, columns, group).items()}
    return found if group else found.get("0", (np.zeros((len(columns),) * 2), 0))


def complete_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features without a missing value."""
    row = agg_wide(df, [], [F.max(missing(f).cast("int")).alias(f) for f in features]).first()
    return [f for f in features if row[f] == 0]


def project(df: DataFrame, features: list[str], vectors: np.ndarray, names: list[str], keep: list[str]) -> DataFrame:
    """Rows times a small matrix, in Arrow batches."""
    fields = [df.schema[c] for c in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], 1)
            y = x @ vectors
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(y[:, j]) for j in range(y.shape[1]))], names=schema.names)

    return df.select(*map(col, keep), *(number(f).alias(f"_x{i}") for i, f in enumerate(features))).mapInArrow(run, schema)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest component by amount is positive."""
    at = np.argmax(np.abs(vectors), 0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1, 1)


def principal_components(df: DataFrame, features: list[str], n: int | None = None, center: bool = False, scale: bool = False) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Loadings, variances, total variance and centres. Without ``center`` columns are taken as they are."""
    k = len(features)
    cross, rows, sums = cross_products(df, features).get("0", (np.zeros((k, k)), 0, np.zeros(k)))
    mean = sums / max(rows, 1)
    cov = (cross + (0 if center else rows * np.outer(mean, mean))) / max(rows - 1, 1)
    if scale:
        sd = np.sqrt(np.diag(cov))
        cov = cov / np.outer(sd, sd)
    lam, vectors = np.linalg.eigh(cov)
    order = np.argsort(-lam)[: n or len(lam)]
    return signed(vectors[:, order]), np.maximum(lam[order], 0), float(np.trace(cov)), mean if center else np.zeros(len(features))


def calculate_pca(dataset: Dataset, assay: str | None = None, slot: str = "scale_data", pc_n: int | None = None, reduction_name: str | None = None, recenter: bool = False, features: list[str] | None = None) -> Dataset:
    """The dataset with a reduction ``PCA.<assay>``, over features without missing values."""
    assay = assay or dataset.active_assay or next(iter(dataset.assays))
    data = dataset.assay(assay).slot(slot)
    own = complete_features(data, features or columns_but(data, OBJECT))
    vectors, var, total, centre = principal_components(data, own, pc_n, recenter)
    names = [f"PC{i + 1}" for i in range(vectors.shape[1])]
    centred = data.select(OBJECT, *((number(f) - float(c)).alias(f) for f, c in zip(own, centre)))
    scores = project(centred, own, vectors, names, [OBJECT])
    made = Reduction(scores, var.tolist(), total, {f: row.tolist() for f, row in zip(own, vectors)})
    return replace(dataset, reductions={**dataset.reductions, reduction_name or f"PCA.{assay}": made})


def outlier_components(cross: np.ndarray, n: int, used: np.ndarray, pc_thresh: float = 0.75, pc_max: int | None = None, pc_n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (all features by components) and variances that a group's outliers are looked for in.

    ``cross`` is the cross product of z-scores; unused features are zero. As many components are taken as explain more
    than ``pc_thresh``, of at most a quarter of the features, or ``pc_n``.
    """
    p = int(used.sum())
    if n < 3 or (pc_n is not None and n <= pc_n) or not p:
        return np.zeros((len(used), 0)), np.zeros(0)
    lam, vectors = np.linalg.eigh(cross[np.ix_(used, used)] / (n - 1))
    order = np.argsort(-lam)
    lam, vectors = np.maximum(lam[order], 0), signed(vectors[:, order])
    most = min(pc_n or pc_max or max(1, round(0.25 * p)), n - 1, p)
    enough = np.flatnonzero((np.cumsum(lam) / p)[:most] > pc_thresh)
    k = most if pc_n or not len(enough) else int(enough[0]) + 1
    k = min(k, int((lam > 1e-12 * lam[0]).sum()))
    out = np.zeros((len(used), k))
    out[used] = vectors[:, :k]
    return out, lam[:k]


def find_outliers_pca(df: DataFrame, features: list[str], qc_group: str | None = None, thresh: float | str = "auto", method: str = "mahalanobis", padj_method: str = "fdr", key: str = OBJECT, return_pcs: bool = False, **how) -> DataFrame:
    """``(object_id, outlier, dist, df, pval, padj, n_within, n_outlier)``, found within groups such as plates.

    Features are z-scored within a group; those with missing values or no variance there go. ``mahalanobis``: summed squares
    over variances of the leading components, with p-values from the chi-squared distribution, adjusted over all groups;
    outliers have less than 0.05 or, of the raw ones, ``thresh``. ``z`` and ``mod.z``: components within and beyond the
    threshold. Groups too small to tell have no outliers.

    Moments and cross products of all groups come from two distributed aggregates; the driver sees matrices whose size depends on
    features and groups, never rows, and a group may be of any size.
    """
    from plateloom.operators.stats import p_adjust

    if method not in ("mahalanobis", "z", "mod.z"):
        raise ValueError(f"no method {method}")
    limit = 3.5 if thresh == "auto" else float(thresh)
    kind = df.schema[key].dataType.simpleString()
    names = [f"_x{i}" for i in range(len(features))]
    group = F.coalesce(col(qc_group).cast("string"), F.lit("")) if qc_group else F.lit("all")
    rows = df.select(col(key).alias("_key"), group.alias("_g"), *(number(f).alias(x) for f, x in zip(features, names)))
    moments = agg_wide(rows, ["_g"], [a for x in names for a in (F.max(missing(x).cast("int")).alias(f"m|{x}"), F.avg(known(x)).alias(f"c|{x}"), F.sqrt(var_known(x)).alias(f"s|{x}"))]).collect()
    used, centre, scale = {}, {}, {}
    for r in moments:
        used[r["_g"]] = np.array([r[f"m|{x}"] == 0 and bool(r[f"s|{x}"]) and np.isfinite(r[f"s|{x}"]) for x in names])
        pick = lambda c, other: np.array([r[f"{c}|{x}"] if u else other for x, u in zip(names, used[r["_g"]])], float)  # noqa: B023, E731
        centre[r["_g"]], scale[r["_g"]] = pick("c", 0.0), pick("s", 1.0)
    sent = df.sparkSession.sparkContext.broadcast((used, centre, scale))

    def scaled(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
        used, centre, scale = sent.value
        groups, code = np.unique(batch.column("_g").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
        for i, g in enumerate(groups.tolist()):
            own = code == i
            x[own] = np.where(used[g], (x[own] - centre[g]) / scale[g], 0.0)
        return groups.tolist(), code, x

    def standard(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, x = scaled(batch)
                yield pa.RecordBatch.from_arrays([batch.column("_g"), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["_g", *names])

    z = rows.select("_g", *names).mapInArrow(standard, "_g string, " + ", ".join(f"{x} double" for x in names))
    spaces = {g: outlier_components(cross, n, used[g], **how) for g, (cross, n) in gram(z, names, group="_g").items()}
    spaces_sent = df.sparkSession.sparkContext.broadcast(spaces)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, code, x = scaled(batch)
            pcs = np.empty(len(x), object)
            for i, g in enumerate(groups):
                own = np.flatnonzero(code == i)
                vectors, var = spaces_sent.value[g]
                pcs[own] = list((x[own] @ vectors) / np.sqrt(var)) if len(var) else [np.zeros(0)] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_g"), pa.array(pcs, pa.list_(pa.float64()))], names=["_key", "qc", "pcs"])

    out = rows.mapInArrow(place, f"_key {kind}, qc string, pcs array<double>")
    if method == "mod.z":
        # scores in one dimension at a time: medians, then medians of distances
        at = out.select("qc", F.posexplode("pcs").alias("i", "v"))
        middle = at.groupBy("qc", "i").agg(F.median("v").alias("m"))
        mad = at.join(middle, ["qc", "i"]).groupBy("qc", "i", "m").agg((F.median(F.abs(F.col("v") - F.col("m"))) * 1.4826 / 0.6745).alias("d"))
        frames = {}
        for r in mad.collect():
            frames.setdefault(r.qc, {})[r.i] = (r.m, r.d)
        table = df.sparkSession.createDataFrame([(g, [own[i][0] for i in range(len(own))], [own[i][1] for i in range(len(own))]) for g, own in frames.items()], "qc string, m array<double>, d array<double>")
        out = out.join(table, "qc", "left")
        out = out.withColumn("pcs", F.coalesce(F.transform("pcs", lambda v, i: divide(v - F.get("m", i), F.get("d", i))), F.col("pcs"))).drop("m", "d")
    k = F.size("pcs").cast("double")
    some = k > 0
    beyond = F.size(F.filter("pcs", lambda v: F.abs(v) >= limit)).cast("double")
    squares = F.aggregate("pcs", F.lit(0.0), lambda acc, v: acc + v * v)
    out = out.withColumns({"df": F.when(some, k), "n_outlier": F.when(some, beyond).otherwise(0.0) if method != "mahalanobis" else F.lit(0.0)})
    out = out.withColumn("n_within", F.when(some, F.col("df") - F.col("n_outlier")))
    if method == "mahalanobis":
        out = out.withColumn("dist", F.when(some, squares))
        p = special.chi2_upper_udf("dist", "df")
        out = out.withColumn("pval", p).withColumn("pval", F.when(~F.isnan("pval"), F.col("pval")))
        out = p_adjust(out, "pval", padj_method)
        outlier = (F.col("padj") < 0.05) if thresh == "auto" else (F.col("pval") < limit)
    else:
        out = out.withColumns({"dist": F.col("n_within"), "pval": F.lit(None).cast("double"), "padj": F.lit(None).cast("double")})
        outlier = F.col("n_outlier") > 0
    listed = ["outlier", "dist", "df", "pval", "padj", "n_within", "n_outlier", *(["pcs"] if return_pcs else [])]
    return out.withColumn("outlier", F.coalesce(outlier, F.lit(False))).select(col("_key").alias(key), *listed)


def known_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*(known(f).alias(f) for f in features)).dropna()
