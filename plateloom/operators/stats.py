"""Markers, multiple testing, correlation tests and effective dimensionality."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.functions import special
from plateloom.functions.exprs import col, known, number
from plateloom.operators.reduce import cross_products


def marker_moments(df: DataFrame, ident: str, features: list[str]) -> DataFrame:
    """``(feature, class, n, m, v, n_missing, n_rows)`` from one wide pass with a combine before the shuffle."""
    made = [a for f in features for a in (F.count(known(f)).alias(f"n|{f}"), F.avg(known(f)).alias(f"m|{f}"), F.var_samp(known(f)).alias(f"v|{f}"))]
    wide = X.agg_wide(df, [ident], [F.count(F.lit(1)).alias("rows"), *made])
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), *(col(f"{k}|{f}").alias(k) for k in "nmv")) for f in features))
    return wide.select(col(ident).cast("string").alias("class"), col("rows"), F.explode(rows).alias("r")).select("class", "rows", "r.*")


def find_markers(df: DataFrame, ident: str, features: list[str], return_top: int | None = 10, ref_classes: list[str] | None = None, p_values: bool = True) -> DataFrame:
    """Welch's t-test of each class against the rest, or against ``ref_classes``, for each feature.

    Columns: ``class, feature, t_stat, df, pval, mean_diff, mean_se, mean_ref, mean_class``; the ``return_top`` features
    of highest t for each class with their ``rank``, padded with empty rows, or all if it is None. A test needs more than
    three known values on either side and some variance. The moments of the other classes are merged, not subtracted
    from a total, so that nothing cancels.
    """
    own = marker_moments(df.filter(col(ident).isNotNull()), ident, features)
    if own.select("class").distinct().count() < 2:
        raise ValueError("there is only one class")
    other = own.select(*(F.col(c).alias(f"r_{c}") for c in ("class", "feature", "n", "m", "v")))
    if ref_classes is not None:
        other = other.filter(F.col("r_class").isin([str(c) for c in ref_classes]))
        own = own.filter(~F.col("class").isin([str(c) for c in ref_classes]))
    pairs = own.join(other, (own["feature"] == F.col("r_feature")) & (own["class"] != F.col("r_class")))
    n, w = F.sum("r_n"), F.sum(F.col("r_n") * F.col("r_m"))
    rest = pairs.groupBy("class", "feature", "n", "m", "v").agg(n.alias("rn"), F.try_divide(w, n).alias("rm"), F.collect_list(F.struct("r_n", "r_m", "r_v")).alias("parts"))
    spread = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.coalesce((p["r_n"] - 1) * p["r_v"], F.lit(0.0)) + F.coalesce(p["r_n"] * F.pow(p["r_m"] - F.col("rm"), F.lit(2.0)), F.lit(0.0)))
    rest = rest.withColumn("rv", F.try_divide(spread, F.col("rn") - 1))
    a, b = F.try_divide(F.col("v"), F.col("n")), F.try_divide(F.col("rv"), F.col("rn"))
    good = (F.col("n") > 3) & (F.col("rn") > 3) & (F.col("v") >= 1e-16) & (F.col("rv") >= 1e-16)
    when = lambda x: F.when(good, x)
    t = F.try_divide(F.col("m") - F.col("rm"), F.sqrt(a + b))
    dof = F.try_divide(F.pow(a + b, F.lit(2.0)), F.try_divide(a * a, F.col("n") - 1) + F.try_divide(b * b, F.col("rn") - 1))
    out = rest.select("class", "feature", when(t).alias("t_stat"), when(dof).alias("df"), when(F.col("m") - F.col("rm")).alias("mean_diff"), when(F.sqrt(a + b)).alias("mean_se"), when(F.col("rm")).alias("mean_ref"), when(F.col("m")).alias("mean_class"))
    if return_top is not None:
        ranked = out.filter("t_stat is not null").withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("t_stat"), "feature")))
        slots = out.select("class").distinct().select("class", F.explode(F.sequence(F.lit(1), F.lit(return_top))).alias("rank"))
        out = slots.join(ranked.filter(F.col("rank") <= return_top), ["class", "rank"], "left")
    return out.withColumn("pval", special.t_two_sided_udf("t_stat", "df")) if p_values else out


def p_adjust(df: DataFrame, p: str, method: str = "fdr", out: str = "padj", groups: list[str] | None = None) -> DataFrame:
    """Adjusted p-values over all rows, or within groups: fdr (BH), BY, bonferroni, holm, hochberg or none. Missing stay missing.

    Groups may be null. Equal p-values are counted first. They are ranked without one global sort: they fall into cells by the
    logarithm of p, which are ranked apart; the counts and extremes of the cells, at most some hundred thousand rows a
    group, join them to one ranking.
    """
    method = {"fdr": "BH"}.get(method, method)
    if method not in ("BH", "BY", "bonferroni", "holm", "hochberg", "none"):
        raise ValueError(f"no method {method}")
    if method == "none":
        return df.withColumn(out, col(p))
    # a struct of group keys equals itself even where keys are null
    marked = df.withColumns({"__g": F.struct(*map(col, groups)) if groups else F.lit(0), "__p": col(p).cast("double")})
    tests = marked.filter(F.col("__p").isNotNull()).groupBy("__g", "__p").agg(F.count(F.lit(1)).alias("_c"))
    totals = tests.groupBy("__g").agg(F.sum("_c").cast("double").alias("_n"))
    tests = tests.join(totals, "__g") if groups else tests.crossJoin(F.broadcast(totals.drop("__g")))
    own = Window.partitionBy("__g", "_cell")
    if method == "bonferroni":
        found = tests.withColumn("_padj", F.least(F.lit(1.0), F.col("__p") * F.col("_n")))
    else:
        cell = F.when(F.col("__p") > 0, F.ceil(F.ln("__p") * 1024)).otherwise(F.lit(-(10**9))).cast("bigint")
        ranked = tests.withColumn("_cell", cell).withColumn("_in", F.sum("_c").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)))
        cells = ranked.groupBy("__g", "_cell").agg(F.sum("_c").alias("_all"))
        whole = Window.partitionBy("__g")
        before = F.coalesce(F.sum("_all").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(cells.select("__g", "_cell", before.alias("_before")), ["__g", "_cell"])
        # ranks of the last and the first of equal tests
        last = F.col("_before") + F.col("_in")
        first = last - F.col("_c") + 1
        n = F.col("_n")
        if method == "BY":
            # the harmonic sum, by its expansion where it is long
            long = F.ln(n) + 0.57721566490153286 + F.try_divide(F.lit(0.5), n) - F.try_divide(F.lit(1 / 12), n * n)
            short = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000.0)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i)
            n = n * F.when(n > 1000, long).otherwise(short)
        raw = {"BH": n / last, "BY": n / last, "hochberg": n - last + 1, "holm": n - first + 1}[method]
        ranked = ranked.withColumn("_v", F.col("__p") * raw)
        # from the largest p down the least so far counts; for holm, from the smallest up the largest
        step, extreme, pick = (F.desc, F.min, F.least) if method != "holm" else (F.asc, F.max, F.greatest)
        inner = extreme("_v").over(own.orderBy(step("__p")).rowsBetween(Window.unboundedPreceding, 0))
        ends = ranked.groupBy("__g", "_cell").agg(extreme("_v").alias("_e"))
        ends = ends.select("__g", "_cell", extreme("_e").over(whole.orderBy(step("_cell")).rowsBetween(Window.unboundedPreceding, -1)).alias("_outer"))
        found = ranked.withColumn("_inner", inner).join(ends, ["__g", "_cell"]).withColumn("_padj", F.least(F.lit(1.0), pick("_inner", "_outer")))
    names = [c for c in df.columns if c != out]
    found = found.select(F.col("__g").alias("_fg"), F.col("__p").alias("_fp"), "_padj")
    tested = marked.filter(F.col("__p").isNotNull())
    tested = tested.join(found, (F.col("__g") == F.col("_fg")) & (F.col("__p") == F.col("_fp"))).select(*map(col, names), F.col("_padj").alias(out))
    without = df.filter(col(p).isNull()).select(*map(col, names), F.lit(None).cast("double").alias(out))
    return tested.unionByName(without)


def cor_test(df: DataFrame, x: str, y: str, groups: list[str] | None = None, p_values: bool = True) -> DataFrame:
    """Pearson's R over rows with both values, its t statistic and p-value."""
    both = df.filter(~X.missing(x) & ~X.missing(y))
    out = both.groupBy(*map(col, groups or [])).agg(F.corr(number(x), number(y)).alias("r"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("t_stat", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    return out.withColumn("pval", special.t_two_sided_udf("t_stat", (F.col("n") - 2).cast("double"))) if p_values else out


def pairwise_correlations(df: DataFrame, features: list[str]) -> np.ndarray:
    """Correlations of features over rows with both values; of complete data from one Gram matrix."""
    incomplete = df.select(reduce(lambda a, b: a | b, map(X.missing, features)).alias("m")).agg(F.max("m")).first()[0]
    if not incomplete:
        centred = cross_products(df, features)["0"][0]
        sd = np.sqrt(np.diag(centred))
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred / np.outer(sd, sd)
    out = np.eye(len(features))
    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    for at in range(0, len(pairs), 200):
        made = [F.corr(F.when(~X.missing(features[j]), known(features[i])), F.when(~X.missing(features[i]), known(features[j]))).alias(f"{i}_{j}") for i, j in pairs[at : at + 200]]
        row = df.agg(*made).first()
        for i, j in pairs[at : at + 200]:
            out[i, j] = out[j, i] = np.nan if row[f"{i}_{j}"] is None else row[f"{i}_{j}"]
    return out


def effective_dimensionality(df: DataFrame, features: list[str], method: str = "LiJi", var_thresh: float = 0.95) -> float:
    """The number of independent dimensions, from the eigenvalues of the features' correlations."""
    lam = np.sort(np.linalg.eigvalsh(pairwise_correlations(df, features)))[::-1]
    m = len(lam)
    if method == "LiJi":
        # an eigenvalue of exactly one may come out a little less
        lam = np.where(np.abs(lam - np.round(lam)) < 1e-9, np.round(lam), np.maximum(lam, 0))
        return float(np.sum((lam > 1) + (lam - np.floor(lam))))
    if method == "pc_var":
        return float(np.argmax(np.cumsum(lam) / lam.sum() >= var_thresh - 1e-12) + 1)
    if method in ("Cheverud", "Chevrud"):
        return float(m + (m - 1) * (1 - lam.var(ddof=1) / m))
    if method == "Galwey":
        root = np.maximum(lam, 0)
        return float(root.sum() ** 2 / (root**2).sum())
    raise ValueError(f"no method {method}")

