"""Linear mixed models with random intercepts, by restricted maximum likelihood."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateloom.functions import special
from plateloom.functions.exprs import col, number
from plateloom.operators.linmodel import _tables, model_matrix

_GRID = np.concatenate([[0.0], np.geomspace(1e-3, 30, 24)])


class RandomIntercepts:
    """y = X b + sum of a random intercept for each level of each grouping + noise."""

    def __init__(self, x: np.ndarray, y: np.ndarray, groups: list[np.ndarray]) -> None:
        self.x, self.y, self.n, self.p = x, y, *x.shape
        self.codes = [np.unique(g, return_inverse=True)[1] for g in groups]
        self.levels = [int(c.max()) + 1 for c in self.codes]
        z = np.zeros((self.n, sum(self.levels)))
        at = 0
        for c, k in zip(self.codes, self.levels):
            z[np.arange(self.n), at + c] = 1
            at += k
        self.zz, self.zx, self.zy = z.T @ z, z.T @ x, z.T @ y
        self.xx, self.xy, self.yy = x.T @ x, x.T @ y, float(y @ y)

    def profile(self, theta: np.ndarray, reml: bool = True) -> dict:
        """The deviance at relative standard deviations ``theta``, with effects and variances there."""
        lam = np.repeat(theta, self.levels)
        a = lam[:, None] * self.zz * lam + np.eye(len(lam))
        low = np.linalg.cholesky(a)
        cx, cy = (np.linalg.solve(low, lam[:, None] * self.zx), np.linalg.solve(low, lam * self.zy))
        s = self.xx - cx.T @ cx
        b = np.linalg.solve(s, self.xy - cx.T @ cy)
        rss = max(self.yy - cy @ cy - b @ (self.xy - cx.T @ cy), 1e-300)
        dof = self.n - self.p if reml else self.n
        logdet = 2 * np.log(np.diag(low)).sum() + (np.linalg.slogdet(s)[1] if reml else 0.0)
        return {"dev": dof * (1 + math.log(2 * math.pi * rss / dof)) + logdet, "b": b, "s2": rss / dof, "cov": np.linalg.inv(s)}

    def fit(self, reml: bool = True) -> tuple[np.ndarray, dict]:
        """Each relative standard deviation in turn: a grid, then golden sections around its best, until nothing changes."""
        theta = np.ones(len(self.levels))
        dev = lambda k, v: self.profile(np.r_[theta[:k], v, theta[k + 1 :]], reml)["dev"]
        last = math.inf
        for _ in range(40):
            for k in range(len(theta)):
                values = [dev(k, v) for v in _GRID]
                i = int(np.argmin(values))
                a, b = _GRID[max(i - 1, 0)], _GRID[min(i + 1, len(_GRID) - 1)]
                ratio = (math.sqrt(5) - 1) / 2
                c, d = b - ratio * (b - a), a + ratio * (b - a)
                fc, fd = dev(k, c), dev(k, d)
                for _ in range(70):
                    if fc < fd:
                        b, d, fd = d, c, fc
                        c = b - ratio * (b - a)
                        fc = dev(k, c)
                    else:
                        a, c, fc = c, d, fd
                        d = a + ratio * (b - a)
                        fd = dev(k, d)
                best = (a + b) / 2
                theta[k] = best if dev(k, best) <= dev(k, 0.0) - 1e-9 else 0.0
            found = self.profile(theta, reml)
            if last - found["dev"] < 1e-8 or len(theta) == 1:
                break
            last = found["dev"]
        return theta, found

    def satterthwaite(self, theta: np.ndarray, found: dict) -> np.ndarray:
        """Degrees of freedom of each effect from how its variance changes with the variance parameters."""
        base = np.r_[theta * math.sqrt(found["s2"]), math.sqrt(found["s2"])]
        live = [k for k in range(len(base)) if base[k] > 1e-6]

        def both(v: np.ndarray) -> tuple[float, np.ndarray]:
            s2 = v[-1] ** 2
            own = self.profile(v[:-1] / v[-1])
            dof = self.n - self.p
            # the deviance away from the profiled noise
            dev = own["dev"] - dof * (1 + math.log(2 * math.pi * own["s2"])) + dof * math.log(2 * math.pi * s2) + dof * own["s2"] / s2
            return dev, np.diag(own["cov"]) * s2

        step = {k: 1e-4 * max(base[k], 1e-2) for k in live}
        move = lambda *ks: both(base + sum(np.eye(len(base))[k] * s * step[k] for k, s in ks))
        hess = np.zeros((len(live), len(live)))
        grad = np.zeros((len(live), self.p))
        for i, a in enumerate(live):
            up, down = move((a, 1)), move((a, -1))
            grad[i] = (up[1] - down[1]) / (2 * step[a])
            for j, b in enumerate(live[: i + 1]):
                if a == b:
                    hess[i, i] = (up[0] - 2 * both(base)[0] + down[0]) / step[a] ** 2
                else:
                    mixed = move((a, 1), (b, 1))[0] - move((a, 1), (b, -1))[0] - move((a, -1), (b, 1))[0] + move((a, -1), (b, -1))[0]
                    hess[i, j] = hess[j, i] = mixed / (4 * step[a] * step[b])
        cov = 2 * np.linalg.pinv(hess)
        spread = np.einsum("ip,ij,jp->p", grad, cov, grad)
        var = np.diag(found["cov"]) * found["s2"]
        with np.errstate(divide="ignore"):
            return 2 * var**2 / spread


def fit_one(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray], x0: np.ndarray | None = None) -> dict:
    """Effects, standard errors, degrees of freedom, p-values, variances, R2 (fixed; all), and a ratio test against ``x0``."""
    model = RandomIntercepts(x, y, groups)
    theta, found = model.fit()
    se = np.sqrt(np.diag(found["cov"]) * found["s2"])
    dof = model.satterthwaite(theta, found)
    t = found["b"] / se
    fixed = float(np.var(x @ found["b"], ddof=1))
    random = float((theta**2).sum() * found["s2"])
    out = {"coef": found["b"], "se": se, "df": dof, "pval": special.t_two_sided(t, dof), "sigma2": found["s2"], "random": random, "r2_marginal": fixed / (fixed + random + found["s2"]), "r2_conditional": (fixed + random) / (fixed + random + found["s2"])}
    if x0 is not None:
        chisq = max(0.0, RandomIntercepts(x0, y, groups).fit(False)[1]["dev"] - model.fit(False)[1]["dev"])
        k = x.shape[1] - x0.shape[1]
        out |= {"chisq": chisq, "lrt_df": k, "lrt_p": float(special.chi2_upper(np.array(chisq), np.array(float(k))))}
    return out


def lmm_matrix(df: DataFrame, responses: list[str], formula: str, formula_null: str | None = None, key: str | None = None) -> DataFrame:
    """``(feature, term, coef, se, df, pval, r2_marginal, r2_conditional, sigma2, chisq, lrt_df, lrt_p)``.

    The formula has fixed effects and random intercepts ``(1|g)``. Each response is fitted by a task of its own, over the rows
    that it has a value in; responses without any are skipped.
    """
    if not formula.strip().startswith("~"):
        raise ValueError("a formula begins with ~")
    groups = re.findall(r"\(\s*1\s*\|\s*([\w.]+)\s*\)", formula)
    if not groups:
        raise ValueError("a mixed model needs a random intercept such as (1|g)")
    plain = re.sub(r"\+?\s*\(\s*1\s*\|[^)]*\)", "", formula)
    design = model_matrix(df, plain if plain.strip() != "~" else "~ 1")
    rows, names = _tables(df, design, responses)
    null = model_matrix(df, re.sub(r"\+?\s*\(\s*1\s*\|[^)]*\)", "", formula_null)) if formula_null else None
    null_at = [design.names.index(n) for n in null.names] if null else None
    terms = design.names  # the function below is sent to tasks; the design's expressions can't be
    n_groups = len(groups)
    wide = rows.select(*names, *(col(g).cast("string").alias(f"_g{i}") for i, g in enumerate(groups)), *(number(r).alias(r) for r in responses))
    wide = wide.dropna(subset=[f"_g{i}" for i in range(len(groups))])
    long = wide.unpivot([*names, *(f"_g{i}" for i in range(len(groups)))], [col(r) for r in responses], "feature", "y").filter("y is not null and not isnan(y)")
    schema = "feature string, term string, coef double, se double, df double, pval double, r2_marginal double, r2_conditional double, sigma2 double, chisq double, lrt_df double, lrt_p double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*names, "y"], kind="stable")
        x = pdf[names].to_numpy(float)
        if len(pdf) <= x.shape[1] + 1:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        fit = fit_one(x, pdf["y"].to_numpy(float), [pdf[f"_g{i}"].to_numpy() for i in range(n_groups)], x[:, null_at] if null_at is not None else None)
        k = len(terms)
        same = {c: [fit.get(c)] * k for c in ("r2_marginal", "r2_conditional", "sigma2", "chisq", "lrt_df", "lrt_p")}
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]] * k, "term": terms, **{c: fit[c] for c in ("coef", "se", "df", "pval")}, **same})

    return long.groupBy("feature").applyInPandas(run, schema)


def calculate_lmm(dataset, assay: str, formula: str, slot: str = "data", grouping: str | None = None, formula_null: str | None = None) -> DataFrame:
    """``lmm_matrix`` for all features of an assay; with ``grouping``, for each group apart, in a column ``group``."""
    from plateloom.operators.linmodel import _joined, _names_in

    covariates = [c for c in _names_in(re.sub(r"1\s*\|", "", formula)) if c]
    data = _joined(dataset, assay, slot, covariates, None, "data", grouping)
    features = [f for f in dataset.assay(assay).feature_names if f not in covariates]
    if not grouping:
        return lmm_matrix(data, features, formula, formula_null)
    out = None
    for r in data.select(col(grouping).cast("string").alias("g")).filter("g is not null").distinct().orderBy("g").collect():
        part = lmm_matrix(data.filter(col(grouping).cast("string") == r.g), features, formula, formula_null).withColumn("group", F.lit(r.g))
        out = part if out is None else out.unionByName(part)
    return out
