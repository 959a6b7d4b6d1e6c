"""Operators against numpy, on made-up cells with every kind of odd column."""

import math
import warnings

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.model import OBJECT, FeatureLocation, FilterSpec, assay_from_matrix, feature_matrix
from plateloom.operators import aggregate, cluster, filters, image, legacy, linmodel, lmm, neighbors, plotdata, reduce, representatives, resolve, stats, transform, umap, validate
from plateloom.sources.report import example_dataset


@pytest.fixture(scope="module")
def data(spark):
    return example_dataset(spark)


def frame(df, key=OBJECT):
    return df.toPandas().sort_values(key).reset_index(drop=True)


def test_dataset_is_valid_and_subsets(data):
    assert validate.is_valid(data)
    part = data.where(F.col("drug") == "a")
    assert validate.is_valid(part) and 0 < part.nrow() < data.nrow()
    assert part.assay().data.count() == part.nrow()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        broken = data.where(F.col("drug") == "a")
        from dataclasses import replace

        assert not validate.is_valid(replace(broken, objects=data.objects))
    renamed = data.with_object_ids(data.objects.select(OBJECT, F.concat(F.lit("new_"), OBJECT).alias("new_id")))
    assert validate.is_valid(renamed)
    with pytest.raises(ValueError):
        data.with_object_ids(data.objects.select(OBJECT, F.lit("same").alias("new_id")))
    assert "drug" in dir(data) and data["drug"].columns == [OBJECT, "drug"] and "200" not in repr(data)


def test_lookup_order_and_errors(data):
    got = resolve.get_data_by_object(data, ["cell_Special_two", "plate", "drug"], "raw")
    assert got.columns == [OBJECT, "cell_Special_two", "plate", "drug"] and got.count() == 200
    with pytest.raises(ValueError):
        resolve.get_data_by_object(data, ["cell_Special_two"])
    with pytest.raises(KeyError):
        resolve.get_data_by_object(data, ["nothing"], "raw")
    assert resolve.is_available(data, ["plate", "drug", "cell_Special_two"]) and not resolve.is_available(data, ["nothing"])
    assert resolve.list_has_overlap([["a"], ["b", "a"]]) and not resolve.list_has_overlap([["a"]])
    with pytest.raises(ValueError):
        FeatureLocation("x", assay="raw")
    with pytest.raises(TypeError):
        feature_matrix(data.objects.select(OBJECT, "drug"))


def test_scaling_matches_numpy(data):
    names = [f"cell_Category{i % 3}_Feature{i}" for i in range(12)]
    x = frame(data.assay().data)
    got = frame(transform.scale_assay(data.assay().select(names)).scale_data)[names].to_numpy()
    own = x[names].to_numpy()
    assert np.allclose(got, (own - own.mean(0)) / own.std(0, ddof=1), atol=1e-12)
    robust = frame(transform.mod_zscore(data.assay().data, names))[names].to_numpy()
    middle = np.median(own, 0)
    assert np.allclose(robust, 0.6745 * (own - middle) / (1.4826 * np.median(np.abs(own - middle), 0)))
    meta = frame(data.objects)
    grouped = frame(transform.scale_assay(data.assay().select(names), data.objects, "drug", "is_control").scale_data)[names].to_numpy()
    for g in "abc":
        rows, ref = (meta.drug == g).to_numpy(), ((meta.drug == g) & meta.is_control).to_numpy()
        assert np.allclose(grouped[rows], (own[rows] - own[ref].mean(0)) / own[ref].std(0, ddof=1))
    constant = frame(transform.fast_colscale(data.assay().data, ["cell_Special_const"]))["cell_Special_const"]
    assert constant.isna().all()
    gaps = frame(transform.fast_colscale(data.assay().data, ["cell_Special_gaps"]))["cell_Special_gaps"]
    assert gaps.isna().all()
    with pytest.raises(TypeError):
        transform.scale_assay(data.assay(), data.objects, "drug", "x")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=3, max_size=30))
def test_scaled_columns_have_mean_0_and_sd_1(spark, values):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "object_id string, v double")
    z = np.array([r.v for r in transform.fast_colscale(df, ["v"]).collect()])
    if len(set(values)) == 1:
        assert np.isnan(z).all()
    elif np.std(values) > 1e-6 * max(map(abs, values)):
        assert abs(z.mean()) < 1e-6 and abs(z.std(ddof=1) - 1) < 1e-6
    m = np.array([r.v for r in transform.min_max(df, ["v"], -2, 3).collect()])
    assert np.isnan(m).all() or (m.min() >= -2 - 1e-9 and m.max() <= 3 + 1e-9)


def test_boxcox(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), float(math.exp(v)), float(v)) for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "object_id string, log_normal double, normal double")
    out, lams = transform.boxcox_transform(df, ["log_normal", "normal"])
    assert lams["log_normal"] == 0.0 and lams["normal"] == 1.0
    got = frame(out)
    order = sorted(range(300), key=str)
    assert np.allclose(got["log_normal"], [math.log(rows[i][1]) for i in order])
    shift = abs(min(r[2] for r in rows)) + 1
    assert np.allclose(got["normal"], [rows[i][2] + shift for i in order])
    for how in ({"mode": "modulus"}, {"filter_iqr": True}, {"downsample": 100}):
        transform.boxcox_lambdas(df, ["normal"], **how).collect()


def test_apply_boxcox_trims(data):
    out = transform.apply_boxcox(data, "raw")
    assert "cell_Special_const" not in out.assays["raw-trans"].feature_names
    assert "lambda" in out.assays["raw-trans"].features.columns


def test_filter_tables(data, spark):
    table = spark.createDataFrame([("na", "all", "filter_agg_na", 0.02, False, True), ("var", "all", "filter_agg_zero_var", 0.0, False, True), ("inf", "Special", "filter_agg_inf", 0.0, False, True)], "name string, column_pattern string, type string, value double, transpose boolean, active boolean")
    specs = filters.filters_from_table(table)
    found = filters.calculate_feature_filters(data.assay().data, specs)
    kept = filters.apply_feature_filters(data, found).assay().feature_names
    assert {"cell_Special_const", "cell_Special_gaps", "cell_Special_nan", "cell_Special_inf"}.isdisjoint(kept) and len(kept) == 15
    objects = filters.calculate_object_filters(data.assay().data, [FilterSpec("gap", "all", "filter_agg_na_multicol", 0.0, True), FilterSpec("z", "Feature", "filter_vec_mod_z_sum", 4.0), FilterSpec("p", "Feature", "filter_vec_mod_z_perc", 2.0, threshold2=0.9)])
    assert objects.count() == 200 and 0 < filters.apply_object_filters(data, objects).nrow() <= 200
    with pytest.raises(ValueError):
        filters.calculate_feature_filters(data.assay().data, [FilterSpec("x", "all", "no_such", 1)])
    assert filters.filter_near_zero_var(data.assay().data, "cell_Special_const").first().keep is False
    assert filters.filter_near_zero_var(data.assay().data, "cell_Special_negative").first().keep is True


def test_row_statistics_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 6))
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "object_id string, " + ", ".join(f"c{i} double" for i in range(6)))
    s = filters.row_statistics([f"c{i}" for i in range(6)])
    got = {r.object_id: r for r in df.select(OBJECT, *(v.alias(k) for k, v in s.items())).collect()}
    for i, r in enumerate(x):
        sd = r.std(ddof=1)
        assert np.isclose(got[str(i)]["var"], sd**2) and np.isclose(got[str(i)]["median"], np.median(r))
        assert np.isclose(got[str(i)]["skewness"], ((r - r.mean()) ** 3).sum() / (5 * sd**3)) and np.isclose(got[str(i)]["kurtosis"], ((r - r.mean()) ** 4).sum() / (5 * sd**4))


def test_aggregation(data, spark):
    by_plate = aggregate.aggregate_by_imagecol(data, "plate")
    assert validate.is_valid(by_plate) and by_plate.nrow() == 2
    meta = aggregate.aggregate_metadata(data.objects.select("drug", "is_control", "x", "image_id"), "drug", drop_multival_string=False)
    assert set(meta.columns) == {"drug", "x", "image_id"}
    with pytest.raises(ValueError):
        aggregate.aggregate_matrix(data.objects, ["x"], "drug", "mode")
    assert aggregate.aggregate_matrix(data.objects, ["x"], "drug", F.max).count() == 3
    assert aggregate.new_plate(spark).count() == 384 and aggregate.new_plate(spark, "96").filter("well = 'H12' and row = 8 and column = 12").count() == 1
    wells = resolve.get_data_by_object(data, ["plate", "well", "drug", "x"])
    assert aggregate.aggregate_to_plate(wells, "x", wide=True).count() == 32
    assert aggregate.aggregate_to_plate(wells, "drug", fmt="96").count() == 192
    assert aggregate.well_to_index(spark.createDataFrame([("B07",)], "well string")).first()[1:] == (2, 7)


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 120
    a, g = rng.normal(size=n), rng.choice(["u", "v", "w"], n)
    y = np.stack([1 + 2 * a + (g == "v") + rng.normal(size=n), rng.normal(size=n)], 1)
    df = spark.createDataFrame([(f"{i:03d}", float(a[i]), g[i], *map(float, y[i])) for i in range(n)], "object_id string, a double, g string, y1 double, y2 double")
    design = linmodel.model_matrix(df, "~ a + g + a:g + I(a^2)")
    assert design.names == ["(Intercept)", "a", "gv", "gw", "a:gv", "a:gw", "I(a^2)"]
    x = np.stack([np.ones(n), a, g == "v", g == "w", a * (g == "v"), a * (g == "w"), a * a], 1).astype(float)
    fit = linmodel.lm_matrix(df, ["y1", "y2"], design)
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose(fit.coef, beta) and fit.df == n - 7
    assert np.allclose(fit.se, np.sqrt(np.outer(np.diag(np.linalg.inv(x.T @ x)), rss / (n - 7))))
    total = ((y - y.mean(0)) ** 2).sum(0)
    assert np.allclose(fit.stats["r2"], 1 - rss / total)
    left = frame(linmodel.residuals(df, design, fit))[["y1", "y2"]].to_numpy()
    assert np.allclose(left, y - x @ beta)
    hidden = frame(linmodel.residuals(df, design, fit, ["I(a^2)"]))[["y1"]].to_numpy()
    assert np.allclose(hidden[:, 0], (y - x @ beta)[:, 0] + x[:, 6] * beta[6, 0])
    grouped = linmodel.lm_matrix(df, ["y1"], linmodel.model_matrix(df, "~ a"), group="g")
    rows = g == "u"
    assert np.allclose(grouped["u"].coef[:, 0], np.linalg.lstsq(x[rows, :2], y[rows, 0], rcond=None)[0])
    with pytest.warns(UserWarning, match="last columns go"):
        linmodel.lm_matrix(df.withColumn("b", F.col("a") * 2), ["y1"], linmodel.model_matrix(df.withColumn("b", F.col("a") * 2), "~ a + b"))
    with pytest.raises(ValueError):
        linmodel.model_matrix(df, "y ~ a")
    assert legacy.association(df, ["y1"], "~ a").filter("n_influential >= 0").count() == 2
    assert legacy.correct(df, ["y1"], ["a"], "g").count() == n
    assert legacy.association_two_steps(df, ["y1"], ["a"], "~ g").count() == 3
    assert legacy.transform_bc(df.withColumn("a", F.abs("a")), "a", 0.05).count() == n


def test_mixed_model_recovers_balanced_anova(spark):
    """For balanced groups the variance of intercepts and its effects are known in closed form."""
    rng = np.random.default_rng(4)
    k, m = 12, 10
    y = rng.normal(size=(k, m)) + rng.normal(size=(k, 1)) * 2 + 5
    df = spark.createDataFrame([(f"g{i}", float(v)) for i in range(k) for v in y[i]], "g string, y double")
    r = lmm.lmm_matrix(df, ["y"], "~ 1 + (1|g)").first()
    between, within = m * y.mean(1).var(ddof=1), y.var(axis=1, ddof=1).mean()
    assert np.isclose(r.coef, y.mean(), atol=1e-6) and np.isclose(r.sigma2, within, rtol=1e-4)
    assert np.isclose(r.se, math.sqrt(between / (k * m)), rtol=1e-4) and np.isclose(r.df, k - 1, rtol=0.02)
    x = rng.normal(size=(k, m))
    both = spark.createDataFrame([(f"g{i}", f"h{j % 3}", float(x[i, j]), float(y[i, j] + 3 * x[i, j])) for i in range(k) for j in range(m)], "g string, h string, x double, y double")
    rows = {r.term: r for r in lmm.lmm_matrix(both, ["y"], "~ x + (1|g) + (1|h)", "~ 1 + (1|g) + (1|h)").collect()}
    assert abs(rows["x"].coef - 3) < 0.5 and rows["x"].pval < 1e-6 and rows["x"].lrt_p < 1e-6


def test_markers_and_adjustments(data, spark):
    names = [f"cell_Category{i % 3}_Feature{i}" for i in range(12)]
    df = data.assay().data.join(data.objects.select(OBJECT, "drug"), OBJECT)
    rows = {(r["class"], r.feature): r for r in stats.find_markers(df, "drug", names, None).collect()}
    x = frame(df)
    a, b = x[x.drug == "a"][names[0]], x[x.drug != "a"][names[0]]
    t = (a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b))
    assert np.isclose(rows["a", names[0]].t_stat, t) and 0 <= rows["a", names[0]].pval <= 1
    assert stats.find_markers(df, "drug", names[:3], 5).count() == 15
    with pytest.raises(ValueError):
        stats.find_markers(df.filter("drug = 'a'"), "drug", names)
    p = [0.01, 0.02, 0.02, 0.3, 0.9, None]
    tests = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    known = np.array(p[:-1], float)
    expected = {"bonferroni": np.minimum(known * 5, 1), "BH": [0.1 / 3, 0.1 / 3, 0.1 / 3, 0.375, 0.9], "holm": [0.05, 0.08, 0.08, 0.6, 0.9], "hochberg": [0.05, 0.06, 0.06, 0.6, 0.9], "none": known}
    for method, values in expected.items():
        got = {r.i: r.padj for r in stats.p_adjust(tests, "p", method).collect()}
        assert got[5] is None and np.allclose([got[i] for i in range(5)], values), method
    assert all(r.padj <= 1 for r in stats.p_adjust(tests, "p", "BY").collect() if r.p is not None)
    r = stats.cor_test(df, names[0], names[1]).first()
    assert np.isclose(r.r, np.corrcoef(x[names[0]], x[names[1]])[0, 1]) and 0 <= r.pval <= 1


def test_adjusted_p_values_of_a_whole_table(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", F.abs(F.sin(F.col("event_id") * 12.9898)).alias("p"))
    known = events.toPandas().set_index("event_id")["p"].sort_values(kind="stable")
    p, n = known.to_numpy(), len(known)
    k = np.arange(1, n + 1)
    least = lambda x: np.minimum.accumulate(x[::-1])[::-1]
    expected = {
        "bonferroni": p * n,
        "holm": np.maximum.accumulate(p * (n - k + 1)),
        "hochberg": least(p * (n - k + 1)),
        "BH": least(p * n / k),
        "BY": least(p * (1 / k).sum() * n / k),
    }
    assert n == 10_000
    for method, values in expected.items():
        got = stats.p_adjust(events, "p", method).toPandas().set_index("event_id")["padj"]
        assert len(got) == n and np.allclose(got.loc[known.index], np.minimum(values, 1), rtol=1e-9, atol=0), method


def test_components_outliers_and_dimensions(data, spark):
    names = [f"cell_Category{i % 3}_Feature{i}" for i in range(12)]
    d = data.with_assay("raw", data.assay().select(names))
    d = reduce.calculate_pca(transform.scale_dataset(d, "raw"))
    r = d.reductions["PCA.raw"]
    z = frame(d.assay().scale_data)[names].to_numpy()
    s = np.linalg.svd(z, compute_uv=False)
    assert np.allclose(r.var, s**2 / 199) and np.isclose(r.var_total, 12)
    scores = frame(r.scores)[r.dims].to_numpy()
    assert np.allclose(scores @ scores.T, z @ z.T, atol=1e-8)
    found = reduce.find_outliers_pca(d.assay().data.join(d.objects.select(OBJECT, "drug"), OBJECT), names, "drug", return_pcs=True)
    assert found.count() == 200 and found.filter("outlier").count() < 40
    # one group against its singular values
    whole = frame(reduce.find_outliers_pca(d.assay().data, names))
    u, sv, _ = np.linalg.svd(z, full_matrices=False)
    assert set(whole["df"]) == {3.0} and np.allclose(whole["dist"], 199 * (u[:, :3] ** 2).sum(1))
    planted = d.assay().data.withColumn(names[0], F.when(F.col(OBJECT) == "FS1_I0_O0", 1e4).otherwise(F.col(names[0])))
    for method in ("mahalanobis", "z", "mod.z"):
        got = reduce.find_outliers_pca(planted, names, method=method, pc_n=6)
        assert [r.outlier for r in got.filter(F.col(OBJECT) == "FS1_I0_O0").collect()] == [True], method
    tiny = reduce.find_outliers_pca(planted.limit(2), names)
    assert tiny.filter("outlier").count() == 0
    independent = spark.createDataFrame([(float(a), float(b)) for a in (-1, 1) for b in (-1, 1)], "a double, b double")
    assert [round(stats.effective_dimensionality(independent, ["a", "b"], m), 6) for m in ("LiJi", "pc_var", "Cheverud", "Galwey")] == [0.0, 2.0, 3.0, 2.0]


def test_neighbours_clusters_layout(data, spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 5)), rng.normal(size=(60, 5)) + 8])
    df = spark.createDataFrame([(f"o{i:03d}", *map(float, r)) for i, r in enumerate(x)], "object_id string, " + ", ".join(f"PC{i} double" for i in range(5)))
    dims = [f"PC{i}" for i in range(5)]
    for metric in neighbors.METRICS:
        got = {(r.src, r["rank"]): r.dist for r in neighbors.knn(df, dims, 4, metric).collect()}
        d = neighbors._distances(x, x, metric)
        assert all(np.isclose(got[f"o{i:03d}", k + 1], np.sort(d[i])[k], atol=1e-6) for i in range(120) for k in range(4)), metric
    exact = {(r.src, r.dst) for r in neighbors.knn(df, dims, 6).collect()}
    near = {(r.src, r.dst) for r in neighbors.annoy_nn(df, dims, 6).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    from plateloom.model import Dataset, Reduction

    objects = df.select(OBJECT, F.lit("i").alias("image_id"))
    d = Dataset(objects, objects.select("image_id").distinct(), {"raw": assay_from_matrix(df)}, reductions={"PCA.raw": Reduction(df, [1.0] * 5)}, active_assay="raw")
    for method, r in (("louvain", 0.1), ("leiden", 0.01)):
        out = cluster.calculate_clustering(d, "PCA.raw", k=8, method=method, resolution=r, exact_nn=True)
        labels = frame(out.objects)[f"clusters_res_{r}"].tolist()
        assert len(set(labels[:60])) == 1 and len(set(labels[60:])) == 1 and labels[0] != labels[60]
    edges = [(a, b) for a, b in exact]
    assert cluster.modularity(edges, cluster.communities(edges)) > 0.3
    with pytest.raises(ValueError):
        cluster.communities(edges, "ward")
    laid = frame(umap.calculate_umap(d, downsample=100, epochs=40).reductions["UMAP.PCA.raw"].scores)
    assert laid["UMAP1"].notna().sum() == 100


def test_tolerance_join_and_match(data, spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 30, (80, 2)), rng.uniform(0, 30, (70, 2))
    da = spark.createDataFrame([(i, "p", *map(float, v)) for i, v in enumerate(a)], "a_id int, plate string, x double, y double")
    db = spark.createDataFrame([(i, "p", *map(float, v)) for i, v in enumerate(b)], "b_id int, plate string, x double, y double")
    got = {r.a_id: r.b_id for r in neighbors.nearest_within(da, db, 2.0, ["plate"]).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert got == {i: (int(d[i].argmin()) if d[i].min() <= 2 else None) for i in range(80)}
    for mode in ("add", "merge"):
        out, matched = neighbors.match_objects_xy_nn(data, data, 0.5, mode)
        assert matched.count() == 200 and matched.filter("dist > 0").count() == 0
        assert ("b_raw" in out.assays) == (mode == "add")


def test_representatives(data):
    rows = data.assay().data.select(OBJECT, F.col("cell_Special_negative").alias("v"))
    x = frame(rows)
    got = representatives.fetch_representative_object(rows, "v", "median", 2).collect()
    assert sorted(r.offset for r in got) == [-2, -1, 0, 1, 2]
    ordered = x.sort_values(["v", OBJECT]).reset_index(drop=True)
    centre = next(r for r in got if r.offset == 0)
    at = ordered[ordered[OBJECT] == centre[OBJECT]].index[0]
    assert {r[OBJECT] for r in got} == set(ordered[OBJECT][at - 2 : at + 3])
    assert representatives.fetch_representative_object_quantiles(rows, "v").count() >= 17
    both = data.assay().data.join(data.objects.select(OBJECT, "drug"), OBJECT)
    near = representatives.fetch_representative_object_nn(both, "drug", ["cell_Special_two", "cell_Special_negative"], 4)
    assert near.count() == 12


def test_images(spark):
    rng = np.random.default_rng(7)
    stacks = {f"o{i}": rng.uniform(size=(6, 5, 3, 2)) for i in range(3)}
    df = spark.createDataFrame([(k, *image.to_row(v)) for k, v in stacks.items()], image.PIXELS)
    arrays = lambda d: {r[OBJECT]: image.to_array(r.dims, r.data) for r in d.collect()}
    flat = arrays(image.img_max_project(df))
    assert all(np.array_equal(flat[k], v.max(3)) for k, v in stacks.items())
    factors = {r.channel: r.factor for r in image.img_max_per_channel(df, 0.9).collect()}
    assert all(np.isclose(factors[c], max(np.quantile(v[:, :, c], 0.9) for v in stacks.values())) for c in range(3))
    normal = arrays(image.img_norm(df, [1.0, 2.0, 4.0]))
    assert np.allclose(normal["o1"][:, :, 2], stacks["o1"][:, :, 2] / 4)
    grey = spark.createDataFrame([("g", c, *image.to_row(stacks["o0"][:, :, c, 0])) for c in range(2)], "group string, channel int, dims array<int>, data array<double>")
    made = arrays(image.img_composite(grey, [(1, 0, 0), (0, 1, 0)]))["g"]
    assert np.allclose(made[:, :, 0], stacks["o0"][:, :, 0, 0] / 2) and np.allclose(made[:, :, 2], 0)
    coloured = arrays(image.img_apply_color(grey.select(F.lit("q").alias(OBJECT), "dims", "data").limit(1), (0.5, 1, 0)))["q"]
    assert coloured.shape == (6, 5, 3)
    px = image.pixels(df).filter("object_id = 'o2' and y = 1 and x = 2 and channel = 1 and plane = 1").first().value
    assert px == stacks["o2"][1, 2, 1, 1]


def test_plot_tables(data):
    rows = data.objects.join(data.assay().data, OBJECT)
    hexes = plotdata.location_hex(rows, "x", "y", "cell_Special_negative", 8.0, min_count=2, thresh=5.0, divide_mean=True, scale=True)
    assert hexes.count() > 3
    assert plotdata.dimplot(data.assay().data, data.objects, ("cell_Special_two", "cell_Special_negative"), "drug", 50)[1].count() <= 3
    assert plotdata.heatmap_breaks(data.assay().data, ["cell_Special_two"], 4, symmetric=True) == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert plotdata.heatmap(data.assay().data, ["cell_Special_negative"], (-0.5, 0.5)).filter("cell_Special_negative < -0.5").count() == 0
    assert plotdata.histogram(rows, "x", 5, "drug").agg(F.sum("n")).first()[0] == 200
    assert plotdata.execution_time(data.images).count() == 1


def test_whole_analysis(data):
    """Filters, outliers, transform, correction, components, clusters and markers, one after the other."""
    specs = [FilterSpec("na", "all", "filter_agg_na", 0.0), FilterSpec("var", "all", "filter_agg_zero_var", 0.0), FilterSpec("inf", "all", "filter_agg_inf", 0)]
    d = filters.apply_feature_filters(data, filters.calculate_feature_filters(data.assay().data, specs))
    images = filters.calculate_object_filters(d.images.select("image_id", "Count_cell"), [FilterSpec("n", "Count_cell", "filter_vec_min", 2)], key="image_id")
    d = filters.apply_image_filters(d, images)
    found = reduce.find_outliers_pca(d.assay().data, d.assay().feature_names)
    d = d.where(found.filter("not outlier").select(OBJECT))
    d = transform.apply_boxcox(d, "raw")
    d = linmodel.correct_lm(d, "raw-trans", ["plate", "x"], assay_out="fixed")
    assert abs(frame(d.assays["fixed"].data).drop(columns=OBJECT).mean()).max() < 1e-6
    d = reduce.calculate_pca(d, "fixed", pc_n=6)
    d = cluster.calculate_clustering(d, "PCA.fixed", k=8, resolution=[0.5], exact_nn=True)
    both = d.assays["fixed"].scale_data.join(d.objects.select(OBJECT, "drug"), OBJECT)
    assert stats.find_markers(both, "drug", d.assays["fixed"].feature_names, 3).count() == 9
    assert validate.is_valid(d)
    assert X.NAN != X.NAN


def test_least_squares_of_large_means(spark):
    """Columns whose means are far above their spread keep their digits."""
    rng = np.random.default_rng(11)
    n = 2000
    x, noise = rng.normal(size=n), rng.normal(size=n)
    for mean in (0.0, 1e4, 1e6, 1e8):
        a, y = mean + x, mean + 0.5 * x + noise
        df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, y)], "a double, y double").repartition(3)
        fit = linmodel.lm_matrix(df, ["y"], linmodel.model_matrix(df, "~ a"))
        centred = np.stack([np.ones(n), a - a.mean()], 1)
        beta, rss, *_ = np.linalg.lstsq(centred, y - y.mean(), rcond=None)
        assert np.allclose(fit.stats["r2"], 1 - rss / ((y - y.mean()) ** 2).sum(), atol=1e-7)
        assert np.allclose(fit.coef[1], beta[1], rtol=1e-6) and np.allclose(fit.mse, rss / (n - 2), rtol=1e-6)
        var = reduce.principal_components(df, ["a", "y"], center=True)[1]
        assert np.allclose(var, np.linalg.eigvalsh(np.cov(a - a.mean(), y - y.mean()))[::-1], rtol=1e-6)
        assert np.allclose(stats.pairwise_correlations(df, ["a", "y"])[0, 1], np.corrcoef(a - a.mean(), y - y.mean())[0, 1], atol=1e-7)


def test_formulas_and_hidden_terms(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "p")], "e1 double, e10 double, b double, c double, g string")
    assert linmodel.model_matrix(df, "~ e1 * b * c").names == ["(Intercept)", "e1", "b", "c", "e1:b", "e1:c", "b:c", "e1:b:c"]
    design = linmodel.model_matrix(df, "~ e1 + e10")
    assert linmodel.check_unused_covar(design, ["e1"]) == [1]
    with pytest.raises(ValueError):
        linmodel.check_unused_covar(design, ["e"])


def test_adjusted_p_values_of_null_groups_and_ties(spark):
    rows = [(None, 0.01), (None, 0.02), ("a", 0.5), ("a", None), ("a", 0.5), (None, 1.0)] + [("t", 1.0)] * 50 + [("t", 0.0)] * 3
    df = spark.createDataFrame(rows, "g string, p double")
    for method in ("BH", "BY", "bonferroni", "holm", "hochberg"):
        got = stats.p_adjust(df, "p", method, groups=["g"]).collect()
        assert len(got) == len(rows)
        for g in (None, "a", "t"):
            p = sorted(v for k, v in rows if k == g and v is not None)
            n, q = len(p), sum(1 / (i + 1) for i in range(len(p)))
            if method in ("BH", "BY", "hochberg"):
                raw = [p[i] * ((n - i) if method == "hochberg" else n * (q if method == "BY" else 1) / (i + 1)) for i in range(n)]
                expected = [min(1, min(raw[i:])) for i in range(n)]
            else:
                expected = [min(1, max(p[j] * (n - j) for j in range(i + 1)) if method == "holm" else p[i] * n) for i in range(n)]
            assert np.allclose(sorted(r.padj for r in got if r.g == g and r.p is not None), sorted(expected))


def test_filters_by_metadata_group(spark):
    rows = [(f"{k}", "u" if k < 20 else "v", float(k % 20) + (1000 if k >= 20 else 0)) for k in range(40)] + [("x", "u", 900.0)]
    df = spark.createDataFrame(rows, "object_id string, plate string, f double")
    spec = FilterSpec("far", "^f$", "filter_vec_mod_z_sum", 3.5, True, metadata_group="plate")
    found = {r.object_id: r.far for r in filters.calculate_object_filters(df, [spec]).collect()}
    assert [k for k, ok in found.items() if not ok] == ["x"]


def test_exact_quantiles(spark, monkeypatch):
    from plateloom.functions import quantiles

    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(size=999), "b": np.r_[rng.normal(size=998), 1e300], "c": np.full(999, 7.0), "d": rng.integers(0, 3, 999).astype(float), "e": np.r_[[np.inf] * 600, rng.normal(size=399)]}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    for ranked in (1 << 17, 10):
        monkeypatch.setattr(quantiles, "RANKED", ranked)
        for p in (0.5, 0.25, 0.1234):
            got = quantiles.exact_quantiles(df, {c: F.col(c) for c in columns}, p)
            for c, x in columns.items():
                at = (len(x) - 1) * p
                low, high = np.sort(x)[[math.floor(at), math.ceil(at)]]
                expected = low if low == high else low + (at - math.floor(at)) * (high - low)
                assert got[c] == expected or np.isclose(got[c], expected, rtol=1e-12), (c, p)
    gaps = spark.createDataFrame([(None,), (1.0,), (float("nan"),)], "a double")
    assert quantiles.exact_quantiles(gaps, {"a": F.col("a")}) == {"a": 1.0} and quantiles.exact_quantiles(gaps, {"a": F.col("a")}, na_rm=False) == {"a": None}
