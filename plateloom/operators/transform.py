"""Scaling by column, group and reference rows; min-max; Box-Cox and modulus transforms."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions.exprs import col, known, number
from plateloom.functions.quantiles import exact_quantiles
from plateloom.model import OBJECT, Assay, Dataset, columns_but

LIMIT, GRID_STEP = 5.0, 0.1


def column_stats(df: DataFrame, features: list[str], keys: list[str], method: str = "mean", reference: Column | None = None, na_zero: bool = False, na_rm: bool = False) -> DataFrame:
    """``(keys, _c_<feature>, _s_<feature>)``: centre and spread of each feature over a group's reference rows.

    ``mean``: mean and standard deviation. ``median``: median and 1.4826 times the median absolute deviation, in a
    second pass. Without ``na_rm`` a missing value among a group's reference rows makes both missing. With ``na_zero``
    zeros count as missing here.
    """
    if method not in ("mean", "median"):
        raise ValueError(f"scale method {method} is neither mean nor median")
    rows = df if reference is None else df.filter(reference)

    def value(f: str) -> Column:
        return F.when(number(f) != 0, number(f)) if na_zero else number(f)

    if method == "mean":
        return X.agg_wide(rows, keys, [a for f in features for a in (X.mean(value(f), na_rm).alias(f"_c_{f}"), X.sd(value(f), na_rm).alias(f"_s_{f}"))])
    if not keys:
        centre = exact_quantiles(rows, {f: value(f) for f in features}, na_rm=na_rm)
        spread = exact_quantiles(rows, {f: F.abs(value(f) - F.lit(centre[f])) for f in features if centre[f] is not None}, na_rm=na_rm)
        made = [x for f in features for x in (centre[f], None if spread.get(f) is None else spread[f] * X.MAD_SCALE)]
        return df.sparkSession.createDataFrame([made], ", ".join(f"`_c_{f}` double, `_s_{f}` double" for f in features))
    centres = X.agg_wide(rows, keys, [X.median(value(f), na_rm).alias(f"_c_{f}") for f in features], 64)
    away = X.join_groups(rows, centres, keys)
    spread = X.agg_wide(away, keys, [X.median(F.abs(value(f) - col(f"_c_{f}")), na_rm).alias(f"_s_{f}") for f in features], 64)
    both = X.join_groups(centres, spread, keys)
    return both.withColumns({f"_s_{f}": col(f"_s_{f}") * X.MAD_SCALE for f in features})


def fast_colscale(df: DataFrame, features: list[str], center: bool = True, scale: bool = True, na_rm: bool = False, scale_method: str = "mean", reference: Column | None = None, na_zero: bool = False, grouping: str | list[str] | None = None, prefix: str = "", stats: DataFrame | None = None) -> DataFrame:
    """``df`` with its features centred and scaled, within groups if any, by what the reference rows have.

    Statistics are a small aggregate that is joined back; without groups it is one row. The median method multiplies by
    0.6745. A column without spread gives NaN. ``stats``, from ``column_stats``, freezes them. Scaled features replace
    the originals unless a ``prefix`` names them anew.
    """
    keys = [grouping] if isinstance(grouping, str) else list(grouping or [])
    found = stats if stats is not None else column_stats(df, features, keys, scale_method, reference, na_zero, na_rm)
    out = X.join_groups(df, found, keys)
    factor = F.lit(X.MOD_Z if scale_method == "median" else 1.0)

    def scaled(f: str) -> Column:
        x = number(f) - (col(f"_c_{f}") if center else F.lit(0.0))
        x = x if scale_method == "mean" else factor * x
        return X.divide(x, col(f"_s_{f}")) if scale else F.when(col(f"_c_{f}").isNotNull() | F.lit(not center), x)

    made = {f: scaled(f) for f in features}
    if prefix:
        return out.withColumns({f"{prefix}{f}": x for f, x in made.items()}).drop(*(f"_{k}_{f}" for f in features for k in "cs"))
    return out.select(*((made[c].alias(c) if c in made else col(c)) for c in df.columns))


def mod_zscore(df: DataFrame, features: list[str], prefix: str = "") -> DataFrame:
    """0.6745 (x - median) / (1.4826 MAD) of whole columns."""
    return fast_colscale(df, features, scale_method="median", prefix=prefix)


def grouped_scale(df: DataFrame, features: list[str], grouping: str | None = None, method: str = "mod.z", prefix: str = "") -> DataFrame:
    """z-scores (``z``) or modified z-scores (``mod.z``) within groups; missing values are left out."""
    if method not in ("z", "mod.z"):
        raise ValueError(f"method {method} is neither z nor mod.z")
    return fast_colscale(df, features, na_rm=True, scale_method="median" if method == "mod.z" else "mean", grouping=grouping, prefix=prefix)


def check_groups(df: DataFrame, columns: list[str]) -> None:
    """An error if a grouping or reference column has a missing value."""
    row = df.select(*(F.max(col(c).isNull().cast("int")).alias(c) for c in columns)).first()
    bad = [c for c in columns if row[c]]
    if bad:
        raise ValueError(f"missing values in {', '.join(bad)}")


def scale_assay(assay: Assay, meta: DataFrame | None = None, grouping: str | None = None, reference: str | None = None, check: bool = True, na_rm: bool = False, **how) -> Assay:
    """``scale_data`` from the assay's data. ``meta`` has the grouping and the boolean reference column by object."""
    features, data = assay.feature_names, assay.data
    extra = [c for c in (grouping, reference) if c]
    if extra:
        if reference and dict(meta.dtypes)[reference] != "boolean":
            raise TypeError("the reference must be boolean")
        if check:
            check_groups(meta, extra)
        data = data.join(meta.select(OBJECT, *map(col, extra)), OBJECT)
    scaled = fast_colscale(data, features, reference=col(reference) if reference else None, grouping=grouping, na_rm=na_rm, **how)
    return replace(assay, scale_data=scaled.select(OBJECT, *map(col, features)))


def scale_dataset(dataset: Dataset, assay: str | None = None, grouping: str | None = None, reference: str | None = None, **how) -> Dataset:
    """One assay, or all, scaled; grouping and reference are columns of objects or images."""
    from plateloom.operators.resolve import get_data_by_object

    extra = [c for c in (grouping, reference) if c]
    meta = get_data_by_object(dataset, extra) if extra else None
    for name in [assay] if assay else list(dataset.assays):
        dataset = dataset.with_assay(name, scale_assay(dataset.assay(name), meta, grouping, reference, **how))
    return dataset


def min_max(df: DataFrame, features: list[str], low: float = 0.0, high: float = 1.0, scale_by_var: bool = False, factors: dict[str, float] | None = None) -> DataFrame:
    """Features moved linearly to low..high, then times their variance or given factors. A missing value empties a column."""
    stats = X.agg_wide(df, [], [a for f in features for a in (X.whole_or(f, F.min(known(f)), False).alias(f"_lo_{f}"), F.max(known(f)).alias(f"_hi_{f}"), X.variance(f).alias(f"_v_{f}"))])
    out = X.join_groups(df, stats, [])

    def moved(f: str) -> Column:
        x = X.divide((high - low) * (number(f) - col(f"_lo_{f}")), col(f"_hi_{f}") - col(f"_lo_{f}")) + low
        return x * (col(f"_v_{f}") if scale_by_var else F.lit(float((factors or {}).get(f, 1.0))))

    return out.select(*((moved(c).alias(c) if c in features else col(c)) for c in df.columns))


def scale_assay_min_max(assay: Assay, low: float = 0.0, high: float = 1.0, scale_by_var: bool = False, factors: dict[str, float] | None = None) -> Assay:
    """``scale_data`` by ``min_max``; the feature table gets the factors."""
    features = assay.feature_names
    table = assay.feature_table()
    if scale_by_var:
        row = X.agg_wide(assay.data, [], [X.variance(f).alias(f) for f in features]).first()
        factors = {f: row[f] for f in features}
    listed = table.sparkSession.createDataFrame([(f, float((factors or {}).get(f) or 1.0)) for f in features], "id string, scaling_factors double")
    scaled = min_max(assay.data, features, low, high, False, factors)
    return replace(assay, scale_data=scaled, features=table.drop("scaling_factors").join(listed, "id", "left"))


# --- power transforms -------------------------------------------------------------------------------------------------


def _sampled(df: DataFrame, rows: int | None, key: str) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key, so always the same."""
    return df if rows is None else df.orderBy(F.xxhash64(col(key))).limit(rows)


def boxcox_lambdas(df: DataFrame, features: list[str], mode: str = "boxcox", limit: float = LIMIT, downsample: int | None = None, filter_iqr: bool = False, key: str = OBJECT) -> DataFrame:
    """``(feature, lambda, shift, gm)``: the exponent of most likelihood for each feature, of a grid from -limit to limit.

    Box-Cox first adds |min| + 1 to a column with a value that isn't positive. Two passes: one for shift and geometric
    mean, one for the spread of the transformed values at each exponent of the grid. The first of equal exponents wins.
    """
    if mode not in ("boxcox", "modulus"):
        raise ValueError(f"mode {mode} is neither boxcox nor modulus")
    least = X.agg_wide(df, [], [F.min(known(f)).alias(f) for f in features]).first()
    shifts = {f: abs(least[f]) + 1 if mode == "boxcox" and least[f] is not None and least[f] <= 0 else 0.0 for f in features}
    rows = _sampled(df, downsample, key).select(*((known(f) + shifts[f]).alias(f) for f in features))
    if filter_iqr:
        q = X.agg_wide(rows, [], [X.quantile(f, [0.25, 0.75]).alias(f) for f in features], 64).first()
        inside = lambda f: (number(f) > q[f][0] - 2 * (q[f][1] - q[f][0])) & (number(f) < q[f][1] + 2 * (q[f][1] - q[f][0]))
        rows = rows.select(*(F.when(inside(f), number(f)).alias(f) if q[f] else number(f).alias(f) for f in features))
    positive = (lambda f: number(f)) if mode == "boxcox" else (lambda f: F.abs(number(f)) + 1)
    means = X.agg_wide(rows, [], [F.exp(F.avg(F.ln(positive(f)))).alias(f) for f in features]).first()
    grid = [round(-limit + GRID_STEP * k, 10) for k in range(round(2 * limit / GRID_STEP) + 1)]
    own = [f for f in features if means[f]]
    spread = _spreads(rows.select(*((number(f) / means[f] if mode == "boxcox" else number(f)).alias(f) for f in own)), own, np.array(grid), mode, [means[f] for f in own])
    best = {}
    for f, (n, squares) in spread.items():
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(squares > 0, -n / 2 * np.log(squares), np.nan)
        best[f] = grid[int(np.nanargmax(ll))] if np.isfinite(ll).any() else None
    return df.sparkSession.createDataFrame([(f, best.get(f), shifts[f], means[f]) for f in features], "feature string, lambda double, shift double, gm double")


def _standard(x: np.ndarray, lam: np.ndarray, mode: str, gm: float) -> np.ndarray:
    """``boxcox_standard`` or ``modulus_standard`` of values (rows) at exponents (columns)."""
    with np.errstate(all="ignore"):
        if mode == "modulus":
            size = np.log1p(np.abs(x))[:, None]
            grown = np.where(np.abs(lam) < 1e-9, size, np.expm1(lam * size) / np.where(lam == 0, 1, lam))
            return np.sign(x)[:, None] * grown * gm ** (1 - lam)
        log = np.log(x)[:, None]
        near = log * (1 + lam * log / 2 * (1 + lam * log / 3 * (1 + lam * log / 4)))
        return np.where(np.abs(lam) > 0.02, (np.exp(lam * log) - 1) / np.where(lam == 0, 1, lam), near)


def _spreads(rows: DataFrame, features: list[str], grid: np.ndarray, mode: str, means: list[float]) -> dict[str, tuple[int, np.ndarray]]:
    """For each feature its known values and, by exponent, the summed squares about the mean of the transformed values.

    One pass: every task keeps a mean and a sum of squares for each feature and exponent, and sends these alone.
    """
    schema = "feature int, n long, mean array<double>, squares array<double>"

    def merge(one, other):
        (n, mean, squares), (m, mean2, squares2) = one, other
        gap = mean2 - mean
        return n + m, mean + gap * m / (n + m), squares + squares2 + gap * gap * n * m / (n + m)

    def partial(batches):
        found: dict = {}
        for batch in batches:
            for i, f in enumerate(features):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                for at in range(0, len(x), 1 << 14):
                    y = _standard(x[at : at + (1 << 14)], grid, mode, means[i])
                    mean = y.mean(0)
                    part = len(y), mean, ((y - mean) ** 2).sum(0)
                    found[i] = merge(found[i], part) if i in found else part
        if found:
            n, mean, squares = zip(*found.values())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(n, pa.int64()), pa.array(mean, kind), pa.array(squares, kind)], names=["feature", "n", "mean", "squares"])

    def add(table: pa.Table) -> pa.Table:
        parts = [(n, np.array(a), np.array(b)) for n, a, b in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "squares")))]
        n, mean, squares = reduce(merge, parts)
        kind = pa.list_(pa.float64())
        return pa.table({"feature": table.column("feature")[:1], "n": [n], "mean": pa.array([mean], kind), "squares": pa.array([squares], kind)})

    if not features:
        return {}
    return {features[r.feature]: (r.n, np.array(r.squares)) for r in rows.mapInArrow(partial, schema).groupBy("feature").applyInArrow(add, schema).collect()}


def snapped(lam: float | None, fudge: float) -> float | None:
    """0 or 1 for exponents near them."""
    if lam is None:
        return None
    return 0.0 if abs(lam) <= fudge else 1.0 if abs(lam - 1) <= fudge else lam


def power_transform(c: Column | str, lam: float | None, shift: float = 0.0, mode: str = "boxcox") -> Column:
    """A column under a (snapped) exponent: logarithm for 0, itself (shifted) for 1, else the power."""
    x = number(c) + shift
    if lam is None:
        return F.lit(None).cast("double")
    if mode == "modulus":
        return x if lam == 1 else X.modulus(x, lam)
    return F.ln(x) if lam == 0 else x if lam == 1 else F.try_divide(F.pow(x, F.lit(lam)) - 1, F.lit(lam))


def boxcox_transform(df: DataFrame, features: list[str], mode: str = "boxcox", limit: float = LIMIT, fudge: float = 0.2, **how) -> tuple[DataFrame, dict[str, float]]:
    """``df`` with its features transformed, and the exponents used, snapped to 0 or 1 within ``fudge``."""
    found = {r.feature: r for r in boxcox_lambdas(df, features, mode, limit, **how).collect()}
    lams = {f: snapped(found[f]["lambda"], fudge) for f in features}
    out = df.select(*((power_transform(c, lams[c], found[c].shift, mode).alias(c) if c in lams else col(c)) for c in df.columns))
    return out, lams


def apply_boxcox(dataset: Dataset, assay: str, assay_out: str | None = None, trim: bool = True, slot: str = "data", **how) -> Dataset:
    """A new assay of transformed features, without those that no longer vary, scaled; the exponents are in its feature table."""
    image = assay in dataset.image_assays
    data = dataset.image_assays[assay] if image else dataset.assay(assay).slot(slot)
    key = data.columns[0]
    features = columns_but(data, key)
    out, lams = boxcox_transform(data, features, key=key, **how)
    if trim:
        row = X.agg_wide(out, [], [X.var_known(f).alias(f) for f in features]).first()
        features = [f for f in features if row[f]]
        out = out.select(col(key), *map(col, features))
    if image:
        return replace(dataset, image_assays={**dataset.image_assays, assay_out or f"{assay}.trans": out})
    table = data.sparkSession.createDataFrame([(f, lams[f], True) for f in features], "id string, lambda double, analyze boolean")
    made = Assay(out, fast_colscale(out, features, na_rm=True), table)
    return dataset.with_assay(assay_out or f"{assay}-trans", made)
