"""Linear models with a shared design: formulas, least squares from one cross product, corrections."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateloom.functions import special
from plateloom.functions.exprs import all_of, col, missing, number
from plateloom.model import OBJECT, Assay, Dataset, columns_but
from plateloom.operators.reduce import cross_products
from plateloom.operators.resolve import get_data_by_object
from plateloom.operators.transform import fast_colscale


@dataclass(frozen=True)
class Design:
    """Columns of a model matrix as expressions of covariates."""

    names: list[str]
    columns: list[Column]
    covariates: list[str]
    terms: list[str]  # the formula's term that each column comes from


def _levels(df: DataFrame, name: str, most: int = 10_000) -> list[str]:
    found = df.select(col(name).cast("string").alias("v")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{name} has over {most} levels")
    return sorted(r.v for r in found if r.v is not None)


def _term(df: DataFrame, text: str) -> list[tuple[str, Column]]:
    text = text.strip()
    if power := re.fullmatch(r"I\(\s*([\w.]+)\s*\^\s*(\d+)\s*\)", text):
        return [(f"I({power[1]}^{power[2]})", F.pow(number(power[1]), F.lit(float(power[2]))))]
    if poly := re.fullmatch(r"poly\(\s*([\w.]+)\s*,\s*(\d+)\s*(?:,\s*raw\s*=\s*T(?:RUE)?\s*)?\)", text):
        return [(f"poly({poly[1]}){k}", F.pow(number(poly[1]), F.lit(float(k)))) for k in range(1, int(poly[2]) + 1)]
    if ":" in text:
        out = [("", F.lit(1.0))]
        for part in text.split(":"):
            out = [(f"{a}:{b}".strip(":"), x * y) for a, x in out for b, y in _term(df, part)]
        return out
    kind = df.schema[text].dataType
    if isinstance(kind, T.NumericType):
        return [(text, number(text))]
    if isinstance(kind, T.BooleanType):
        return [(f"{text}TRUE", col(text).cast("double"))]
    # treatment contrasts: the first level in code point order is the base
    return [(f"{text}{v}", (col(text).cast("string") == v).cast("double")) for v in _levels(df, text)[1:]]


def model_matrix(df: DataFrame, formula: str | None = None, covariates: list[str] | None = None) -> Design:
    """The design of a formula such as ``~ a + b:c + I(x^2) - 1``, or of covariates that add up."""
    text = (formula or "~ " + " + ".join(covariates or ["1"])).strip()
    if not text.startswith("~"):
        raise ValueError("a formula begins with ~")
    body = text[1:].replace(" ", "")
    if body == ".":
        body = "+".join(covariates or [])
    intercept = not re.search(r"(^|\+)0(\+|$)|-1", body)
    terms: list[str] = []
    for t in re.split(r"\+(?![^(]*\))", re.sub(r"-1", "", body)):
        if t in ("", "0", "1") or re.fullmatch(r"\(1\|[\w.]+\)", t):
            continue
        if "*" in t and not t.startswith("I("):
            parts = t.split("*")
            t_all = [":".join(some) for k in range(1, len(parts) + 1) for some in combinations(parts, k)]
        else:
            t_all = [t]
        terms += [x for x in t_all if x not in terms]
    made = [("(Intercept)", F.lit(1.0), "1")] if intercept else []
    for t in terms:
        made += [(name, column, t) for name, column in _term(df, t)]
    used = sorted({x for t in terms for x in re.findall(r"[A-Za-z_.][\w.]*", re.sub(r"\b(I|poly|raw|TRUE|T)\b", "", t)) if x in df.columns})
    return Design([n for n, _, _ in made], [x for _, x, _ in made], used, [t for _, _, t in made])


def check_unused_covar(design: Design, dont_use: list[str] | None) -> list[int]:
    """Positions of design columns whose effect stays in the residuals: those of a term, such as a factor, or of one name."""
    out = [i for i, (n, t) in enumerate(zip(design.names, design.terms)) if n in (dont_use or []) or t in (dont_use or [])]
    if dont_use and not out:
        raise ValueError(f"no column of the design belongs to {', '.join(dont_use)}")
    return out


@dataclass(frozen=True)
class Fit:
    """Coefficients (term by response) with standard errors and p-values, and a row of statistics for each response."""

    terms: list[str]
    responses: list[str]
    coef: np.ndarray
    se: np.ndarray
    pval: np.ndarray
    df: int
    n: int
    mse: np.ndarray
    cov_unscaled: np.ndarray
    stats: dict[str, np.ndarray]
    kept: list[int]


def _solvable(cross: np.ndarray, kept: list[int], names: list[str], eigen_tol: float) -> list[int]:
    """``kept`` without its last columns, as many as the scaled cross product has eigenvalues near zero."""
    while kept:
        size = np.sqrt(np.maximum(np.diag(cross)[kept], 0))
        scaled = cross[np.ix_(kept, kept)] / np.outer(*[np.where(size > 0, size, 1)] * 2)
        small = int((np.linalg.eigvalsh(scaled) < eigen_tol).sum())
        if not small:
            break
        warnings.warn(f"{small} eigenvalues of the design are near zero: its last columns go ({', '.join(names[i] for i in kept[-small:])})", stacklevel=3)
        kept = kept[: len(kept) - small]
    return kept


def solve(cross: np.ndarray, n: int, sums: np.ndarray, names: list[str], responses: list[str], dont_use: list[int] = (), keep_zerocol: bool = False, eigen_tol: float = 1e-8) -> Fit:
    """Least squares of many responses on one design, from the cross product of both, centred, and their sums.

    Design columns whose sum is zero go unless ``keep_zerocol``; if k eigenvalues of the scaled X'X are below the tolerance, so
    do the last k columns. Effects of ``dont_use`` columns are fitted but count neither as explained nor as residual.
    With an intercept everything is worked out about the means, so that large means cost no digits.
    """
    p = len(names)
    at = names.index("(Intercept)") if "(Intercept)" in names else None
    mean = sums / n
    used = cross if at is not None else cross + np.outer(sums, mean)
    slopes = [i for i in range(p) if i != at]
    if not keep_zerocol and at is not None:
        gone = [i for i in slopes if sums[i] == 0]
        if gone:
            warnings.warn(f"columns that sum to zero go: {', '.join(names[i] for i in gone)}", stacklevel=2)
        slopes = [i for i in slopes if i not in gone]
    slopes = _solvable(used, slopes, names, eigen_tol)
    kept = sorted([*slopes, *([at] if at is not None else [])])
    size = np.sqrt(np.diag(used)[slopes])
    xx, xy, yy = used[np.ix_(slopes, slopes)], used[slopes, p:], np.diag(used)[p:]
    inverse = np.linalg.inv(xx / np.outer(size, size)) / np.outer(size, size) if slopes else np.zeros((0, 0))
    b = inverse @ xy
    dof = n - len(kept)
    rss = np.maximum(yy - 2 * (b * xy).sum(0) + np.einsum("ij,ik,kj->j", b, xx, b), 0)
    mse = rss / dof if dof > 0 else np.full(len(yy), np.nan)
    coef, whole = np.zeros((p, len(responses))), np.zeros((p, p))
    coef[slopes], whole[np.ix_(slopes, slopes)] = b, inverse
    if at is not None:
        coef[at] = mean[p:] - mean[slopes] @ b
        whole[at, slopes] = whole[slopes, at] = -(mean[slopes] @ inverse)
        whole[at, at] = 1 / n + mean[slopes] @ inverse @ mean[slopes]
    coef, whole = coef[kept], whole[np.ix_(kept, kept)]
    se = np.sqrt(np.outer(np.diag(whole), mse))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
        if dont_use:
            # residuals of the used columns alone, centred
            own = np.where(np.isin(slopes, dont_use), 0, 1)[:, None] * b
            rss = np.maximum(yy - 2 * (own * xy).sum(0) + np.einsum("ij,ik,kj->j", own, xx, own), 0)
        rank = len(slopes)
        r2 = 1 - rss / yy
        adj = 1 - (1 - r2) * (n - 1) / dof
        f = (r2 / rank) / ((1 - r2) / dof) if rank else np.full(len(yy), np.nan)
        p_f = special.f_upper(f, np.full(len(yy), float(rank)), np.full(len(yy), float(dof))) if rank else np.full(len(yy), np.nan)
    stats = {"r2": r2, "adj_r2": adj, "f_stat": f, "p_value": p_f}
    return Fit([names[i] for i in kept], responses, coef, se, special.t_two_sided(t, np.full_like(t, float(dof))), dof, n, mse, whole, stats, kept)


def _tables(df: DataFrame, design: Design, responses: list[str]) -> tuple[DataFrame, list[str]]:
    """The design and responses as columns, over rows whose covariates are all known."""
    rows = df.filter(all_of([col(c).isNotNull() & (~missing(c) if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(True)) for c in design.covariates]))
    names = [f"_d{i}" for i in range(len(design.names))]
    return rows.withColumns(dict(zip(names, design.columns))), names


def lm_matrix(df: DataFrame, responses: list[str], design: Design, dont_use: list[str] | None = None, group: str | None = None, **how) -> Fit | dict[str, Fit]:
    """Least squares of every response on the design, all from one distributed cross product; by group, a fit for each.

    A response with missing values gets a missing fit.
    """
    rows, names = _tables(df, design, responses)
    hidden = check_unused_covar(design, dont_use)
    found = cross_products(rows, [*names, *responses], group)
    fits = {g: solve(c, n, sums, design.names, responses, hidden, **how) for g, (c, n, sums) in found.items()}
    if group:
        return fits
    if not fits:
        raise ValueError("no row has all covariates and responses")
    return fits["0"]


def complete_responses(df: DataFrame, responses: list[str]) -> list[str]:
    row = df.agg(*(F.max(missing(r).cast("int")).alias(r) for r in responses)).first()
    return [r for r in responses if row[r] == 0]


def fit_table(spark, fits: Fit | dict[str, Fit]) -> DataFrame:
    """``(group, feature, term, coef, se, t, df, pval)``."""
    rows = [
        (g, y, t, float(f.coef[i, j]), float(f.se[i, j]), float(f.coef[i, j] / f.se[i, j]) if f.se[i, j] else None, f.df, float(f.pval[i, j]))
        for g, f in (fits.items() if isinstance(fits, dict) else [(None, fits)])
        for i, t in enumerate(f.terms)
        for j, y in enumerate(f.responses)
    ]
    return spark.createDataFrame(rows, "group string, feature string, term string, coef double, se double, t double, df int, pval double")


def model_table(spark, fits: Fit | dict[str, Fit]) -> DataFrame:
    """``(group, feature, r2, adj_r2, f_stat, p_value, df)``."""
    rows = [(g, y, *(float(f.stats[s][j]) for s in ("r2", "adj_r2", "f_stat", "p_value")), f.df) for g, f in (fits.items() if isinstance(fits, dict) else [(None, fits)]) for j, y in enumerate(f.responses)]
    return spark.createDataFrame(rows, "group string, feature string, r2 double, adj_r2 double, f_stat double, p_value double, df int")


def residuals(df: DataFrame, design: Design, fit: Fit, dont_use: list[str] | None = None, keep: list[str] = (OBJECT,)) -> DataFrame:
    """Responses less the fitted effects, but for those of ``dont_use``; a projection with the coefficients in it."""
    rows, names = _tables(df, design, fit.responses)
    hidden = set(check_unused_covar(design, dont_use))
    out = []
    for j, y in enumerate(fit.responses):
        value = number(y)
        for i, k in enumerate(fit.kept):
            if k not in hidden:
                value = value - F.lit(float(fit.coef[i, j])) * col(names[k])
        out.append(value.alias(y))
    return rows.select(*map(col, keep), *out)


def _joined(dataset: Dataset, assay: str, slot: str, covariates: list[str], assay_covar: str | None, slot_covar: str, grouping: str | None, assay_image: str | None = None) -> DataFrame:
    extra = list(dict.fromkeys([*covariates, *([grouping] if grouping else [])]))
    data = dataset.assay(assay).slot(slot)
    lookup = get_data_by_object(dataset, extra, assay_covar or assay, assay_image, slot_covar)
    return data.drop(*extra).join(lookup, OBJECT)


def _names_in(formula: str) -> list[str]:
    return [x for x in dict.fromkeys(re.findall(r"[A-Za-z_.][\w.]*", re.sub(r"\b(I|poly|raw|TRUE|T)\b", "", formula)))]


def calculate_lm(dataset: Dataset, assay: str, covariates: list[str] | None = None, formula: str | None = None, slot: str = "data", grouping: str | None = None, assay_covar: str | None = None, slot_covar: str = "data", dont_use: list[str] | None = None, rescale_group: bool = True, **how) -> Fit | dict[str, Fit]:
    """Fits of all features on covariates, by group if any; responses are scaled within groups if so asked."""
    covariates = covariates or _names_in(formula)
    data = _joined(dataset, assay, slot, covariates, assay_covar, slot_covar, grouping)
    features = [f for f in dataset.assay(assay).feature_names if f not in covariates]
    if grouping and rescale_group:
        data = fast_colscale(data, features, na_rm=True, grouping=grouping)
    return lm_matrix(data, features, model_matrix(data, formula, covariates), dont_use, grouping, **how)


def correct_lm(dataset: Dataset, assay: str, covariates: list[str] | None = None, formula: str | None = None, slot: str = "data", assay_out: str | None = None, grouping: str | None = None, assay_covar: str | None = None, slot_covar: str = "data", dont_use: list[str] | None = None, rescale_group: bool = False, **how) -> Dataset:
    """A new assay of residuals, fitted within groups if any, and its z-scores."""
    covariates = covariates or _names_in(formula)
    data = _joined(dataset, assay, slot, covariates, assay_covar, slot_covar, grouping)
    features = [f for f in dataset.assay(assay).feature_names if f not in covariates]
    if grouping and rescale_group:
        data = fast_colscale(data, features, na_rm=True, grouping=grouping)
    design = model_matrix(data, formula, covariates)
    fits = lm_matrix(data, features, design, dont_use, grouping, **how)
    if grouping:
        parts = [residuals(data.filter(col(grouping).cast("string") == g), design, f, dont_use) for g, f in fits.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
    else:
        out = residuals(data, design, fits, dont_use)
    return dataset.with_assay(assay_out or f"{assay}.lm.corrected", Assay(out, fast_colscale(out, features, na_rm=True), dataset.assay(assay).features))


def correct_lm_per_featuregroup(dataset: Dataset, assay: str, covariates_group: dict[str, list[str]], slot: str = "data", assay_out: str | None = None, grouping: str | None = None, assay_covar: str | None = None, na_rm: bool = False, **how) -> Dataset:
    """``correct_lm`` with covariates of their own for each pattern of feature names. Other features are empty."""
    names = dataset.assay(assay).feature_names
    every = {c for cs in covariates_group.values() for c in cs}
    groups = {p: [f for f in names if re.search(p, f) and f not in every] for p in covariates_group}
    listed = [f for fs in groups.values() for f in fs]
    if len(listed) != len(set(listed)):
        raise ValueError("patterns overlap")
    out = dataset.assay(assay).slot(slot).select(OBJECT)
    for pattern, own in groups.items():
        if not own:
            continue
        covariates = covariates_group[pattern]
        if not na_rm:
            looked = get_data_by_object(dataset, covariates, assay_covar or assay, None, slot)
            if looked.filter(~all_of([~missing(c) if isinstance(looked.schema[c].dataType, T.NumericType) else col(c).isNotNull() for c in covariates])).head() is not None:
                raise ValueError("covariates have missing values")
        part = replace(dataset, assays={**dataset.assays, "_part": dataset.assay(assay).select(own)})
        fixed = correct_lm(part, "_part", covariates, None, slot, "_fixed", grouping, assay_covar or assay, slot, **how)
        out = out.join(fixed.assays["_fixed"].data, OBJECT, "left")
    out = out.select(OBJECT, *((col(f) if f in listed else F.lit(None).cast("double")).alias(f) for f in names if f not in every))
    features = columns_but(out, OBJECT)
    return dataset.with_assay(assay_out or f"{assay}.lm.corrected", Assay(out, fast_colscale(out, features, na_rm=True)))
