"""A two-dimensional layout of a neighbour graph (UMAP)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plateloom.functions.exprs import col
from plateloom.model import OBJECT, Dataset, Reduction
from plateloom.operators.neighbors import knn
from plateloom.operators.reduce import calculate_pca

#: The curve that fits a least distance of 0.01 and a spread of 1.
A, B = 1.8956, 0.8006


def memberships(dist: np.ndarray) -> np.ndarray:
    """How strongly each neighbour counts: exponential in its distance beyond the nearest, summing to log2(k)."""
    rho = np.where(dist > 0, dist, np.inf).min(1)
    rho = np.where(np.isfinite(rho), rho, 0)
    beyond = np.maximum(dist - rho[:, None], 0)
    low, high = np.zeros(len(dist)), np.full(len(dist), np.inf)
    sigma = np.ones(len(dist))
    for _ in range(64):
        total = np.exp(-beyond / sigma[:, None]).sum(1)
        over = total > np.log2(dist.shape[1] + 1)
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    return np.exp(-beyond / np.maximum(sigma, 1e-12)[:, None])


def layout(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: np.ndarray, epochs: int = 200, negatives: int = 5, seed: int = 1) -> np.ndarray:
    """Stochastic gradient descent: neighbours attract, random others repel; all edges of an epoch move at once."""
    rng = np.random.default_rng(seed)
    y = start.copy()
    chance = weight / weight.max()
    for epoch in range(epochs):
        alpha = 1.0 - epoch / epochs
        on = rng.random(len(src)) < chance
        i, j = src[on], dst[on]
        d = y[i] - y[j]
        r2 = (d * d).sum(1)
        pull = np.where(r2 > 0, -2 * A * B * np.maximum(r2, 1e-12) ** (B - 1) / (1 + A * r2**B), 0.0)
        g = np.clip(pull[:, None] * d, -4, 4)
        step = np.zeros_like(y)
        np.add.at(step, i, g)
        np.add.at(step, j, -g)
        k = np.repeat(i, negatives)
        o = rng.integers(0, len(y), len(k))
        d = y[k] - y[o]
        r2 = (d * d).sum(1)
        push = 2 * B / ((0.001 + r2) * (1 + A * r2**B))
        np.add.at(step, k, np.where(r2[:, None] > 0, np.clip(push[:, None] * d, -4, 4), 0.0))
        y += alpha * np.clip(step, -4, 4) * 0.5
    return y


def calculate_umap(dataset: Dataset, reduction: str | None = None, assay: str | None = None, slot: str = "scale_data", pc_n: int = 30, reduction_name: str | None = None, downsample: int | None = None, k: int = 15, epochs: int = 200, seed: int = 1) -> Dataset:
    """A reduction ``UMAP.<reduction>`` of the leading components; those of the assay if it has some, else they are computed.

    Neighbours are found by all tasks; the layout is one task's work, so that ``downsample`` objects, chosen by a hash,
    should be asked for where there are many. Others have no place.
    """
    name = assay or dataset.active_assay or next(iter(dataset.assays))
    if f"PCA.{name}" in dataset.reductions:
        reduction = f"PCA.{name}"
    if reduction is None:
        dataset, reduction = calculate_pca(dataset, name, slot, pc_n), f"PCA.{name}"
    scores = dataset.reductions[reduction].scores
    dims = dataset.reductions[reduction].dims[:pc_n]
    chosen = scores if downsample is None else scores.orderBy(F.xxhash64(OBJECT, F.lit(seed))).limit(downsample)
    chosen = chosen.persist()
    edges = knn(chosen, dims, k + 1).filter("src <> dst")
    starts = chosen.select(col(OBJECT).alias("src"), F.lit(None).cast("string").alias("dst"), col(dims[0]).alias("dist"), (col(dims[1]) if len(dims) > 1 else F.lit(0.0)).alias("other"))
    rows = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "dist", F.lit(0.0).alias("other")).unionByName(starts)

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        first = pdf[pdf["dst"].isna()].sort_values("src")
        ids = first["src"].to_numpy()
        start = first[["dist", "other"]].to_numpy(float)
        start = 10 * start / max(np.abs(start).max(), 1e-12) + 1e-4 * np.random.default_rng(seed).normal(size=start.shape)
        near = pdf[pdf["dst"].notna()].sort_values(["src", "dist", "dst"])
        at = {x: i for i, x in enumerate(ids)}
        src, dst = near["src"].map(at).to_numpy(), near["dst"].map(at).to_numpy()
        own = np.full((len(ids), max(1, int(near.groupby("src").size().max() if len(near) else 1))), np.inf)
        place = near.groupby("src").cumcount().to_numpy()
        own[src, place] = near["dist"].to_numpy()
        w = memberships(own)[src, place] if len(near) else np.zeros(0)
        both = {}
        for a, b, x in zip(src, dst, w):
            both[a, b] = x
        sym = {(a, b): x + both.get((b, a), 0) - x * both.get((b, a), 0) for (a, b), x in both.items()}
        if sym:
            s, d = (np.array([e[k] for e in sym]) for k in (0, 1))
            start = layout(s, d, np.array(list(sym.values())), start, epochs, seed=seed)
        return pa.table({OBJECT: ids, "UMAP1": start[:, 0], "UMAP2": start[:, 1]})

    placed = rows.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(lambda t: run(t.drop(["g"])), f"{OBJECT} string, UMAP1 double, UMAP2 double")
    out = scores.select(OBJECT).join(placed, OBJECT, "left")
    return replace(dataset, reductions={**dataset.reductions, reduction_name or f"UMAP.{reduction}": Reduction(out, [], None)})
