"""Further queries: images, plates, subsets, adjusted p-values, grouped corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateloom.functions import exprs as X
from plateloom.model import OBJECT, Assay
from plateloom.operators import aggregate, filters, image, legacy, linmodel, plotdata, representatives, stats, transform
from plateloom.plans.catalog import _order_dataset, _r, _vector_dataset, query
from plateloom.plans.tables import DIMS, FEATURES, VECTORS_SQL, line_items, orders, read, rounded, vectors


def _stacks(spark, sf_dir):
    """Embeddings as images of 4 x 4 pixels in two channels and two planes."""
    rows = read(spark, sf_dir, "embeddings").filter("size(embedding) = 64")
    return rows.select(F.col("vec_id").cast("string").alias(OBJECT), F.array(*map(F.lit, (4, 4, 2, 2))).alias("dims"), F.col("embedding").cast("array<double>").alias("data"))


_PIXELS_SQL = """px as (select vec_id::varchar as object_id, i - 1 as pos, embedding[i]::double as v from embeddings, range(1, 65) as r(i)),
c as (select object_id, pos % 16 as yx, (pos // 16) % 2 as channel, pos // 32 as plane, v from px)"""


@query(f"with {_PIXELS_SQL}, q as (select object_id, channel, quantile_cont(v, 0.9) as v from c group by 1, 2) select channel::int as channel, round(max(v), 6) + 0.0 as factor from q group by 1")
def img_max_per_channel(spark, sf_dir):
    return image.img_max_per_channel(_stacks(spark, sf_dir), 0.9).select("channel", rounded("factor").alias("factor"))


@query(f"with {_PIXELS_SQL}, m as (select object_id, channel, yx, max(v) as v from c group by 1, 2, 3) select object_id, round(sum(v), 6) + 0.0 as total, count(*) as n from m group by 1")
def img_max_project(spark, sf_dir):
    flat = image.pixels(image.img_max_project(_stacks(spark, sf_dir)))
    return flat.groupBy(OBJECT).agg(rounded(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"with {_PIXELS_SQL}, f as (select channel, max(v) as f from c group by 1) select object_id, round(sum(v / f), 6) + 0.0 as total from c join f using (channel) group by 1")
def img_norm(spark, sf_dir):
    return image.pixels(image.img_norm(_stacks(spark, sf_dir))).groupBy(OBJECT).agg(rounded(F.sum("value")).alias("total"))


@query("""with p as (select l_quantity::double as x, l_tax::double * 100 as y, ln(l_extendedprice) / ln(2) as z from lineitem), s as (select *, (z - avg(z) over ()) / stddev_samp(z) over () as w from p),
u as (select *, x / 5.0 as u, y / (5.0 * sqrt(3)) as v from s), r as (select *, round_even(u, 0) as r1, round_even(v, 0) as s1, floor(u) + 0.5 as r2, floor(v) + 0.5 as s2 from u),
h as (select w, case when (u - r1) ** 2 + 3 * (v - s1) ** 2 <= (u - r2) ** 2 + 3 * (v - s2) ** 2 then [r1, s1] else [r2, s2] end as c from r)
select round(c[1] * 5.0, 6) + 0.0 as hx, round(c[2] * 5.0 * sqrt(3), 6) + 0.0 as hy, count(*) as n, case when count(*) > 10 then round(avg(w), 5) + 0.0 end as value from h group by 1, 2""")
def location_hex(spark, sf_dir):
    rows = line_items(spark, sf_dir).select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_extendedprice").alias("z"))
    out = plotdata.location_hex(rows, "x", "y", "z", 5, log2=True, scale=True)
    return out.select(rounded("hx").alias("hx"), rounded("hy").alias("hy"), "n", rounded("value", 5).alias("value"))


@query("""with c as (select l_linenumber as v, count(*) as n from lineitem group by 1), t as (select max(n) as first, count(*) as d, sum(n) as total, arg_max(v, n) as mode from c),
s as (select max(n) as second from c, t where v <> mode) select not (first / second > 19 and 100.0 * d / total <= 10) and d > 1 as keep from t, s""")
def near_zero_var(spark, sf_dir):
    return filters.filter_near_zero_var(line_items(spark, sf_dir), "l_linenumber")


_PADJ = """p as (select event_id, abs(sin(event_id * 12.9898)) as p from events), n as (select count(*)::double as n, sum(1.0 / (1 + i)) as q from (select row_number() over () - 1 as i from p)),
r as (select *, row_number() over (order by p, event_id) as k from p)"""
for _method, _sql in {
    "bonferroni": "p * n",
    "holm": "max(p * (n - k + 1)) over (order by k rows between unbounded preceding and current row)",
    "hochberg": "min(p * (n - k + 1)) over (order by k desc rows between unbounded preceding and current row)",
    "by": "min(p * q * n / k) over (order by k desc rows between unbounded preceding and current row)",
}.items():

    def _adjusted(spark, sf_dir, method=_method):
        rows = read(spark, sf_dir, "events").select("event_id", F.abs(F.sin(F.col("event_id") * 12.9898)).alias("p"))
        return stats.p_adjust(rows, "p", method.upper() if method == "by" else method).select("event_id", rounded("padj", 5).alias("padj"))

    query(f"with {_PADJ} select event_id, round(least(1.0, {_sql}), 5) + 0.0 as padj from r, n", f"p_adjust_{_method}")(_adjusted)


@query("""select o_orderstatus as plate, well, ascii(well) - 64 as "row", substr(well, 2, 2)::int as "column", case when count(distinct o_orderpriority) = 1 then min(o_orderpriority) end as value
from (select *, chr((65 + o_orderkey % 8)::int) || lpad((1 + o_custkey % 12)::varchar, 2, '0') as well from orders) group by 1, 2""")
def plate_96_text(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("plate", F.col("o_orderstatus"))
    rows = rows.withColumn("well", F.concat(F.char(65 + F.col("o_orderkey") % 8), F.lpad((1 + F.col("o_custkey") % 12).cast("string"), 2, "0")))
    full = aggregate.aggregate_to_plate(rows, "o_orderpriority", fmt="96")
    return full.join(rows.select("plate", "well").distinct(), ["plate", "well"], "left_semi").select("plate", "well", "row", "column", "value")


@query("select p_partkey, ascii(w) - 64 as \"row\", substr(w, 2, 2)::int as \"column\" from (select p_partkey, chr((65 + p_partkey % 16)::int) || lpad((1 + p_partkey % 24)::varchar, 2, '0') as w from part)")
def well_to_index(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.char(65 + F.col("p_partkey") % 16), F.lpad((1 + F.col("p_partkey") % 24).cast("string"), 2, "0")).alias("well"))
    return aggregate.well_to_index(rows).select("p_partkey", "row", "column")


@query("select c_custkey::varchar as image_id from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
def dataset_subset_images(spark, sf_dir):
    """The images that are left when objects are chosen."""
    part = _order_dataset(spark, sf_dir).where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return part.images.select("image_id")


@query("""with s as (select c_mktsegment, avg(o_totalprice::double) m, stddev_samp(o_totalprice::double) s from orders join customer on o_custkey = c_custkey group by 1)
select o_orderkey::varchar as object_id, round((o_totalprice - m) / s, 6) + 0.0 as price from orders join customer on o_custkey = c_custkey join s using (c_mktsegment)""")
def scale_dataset_by_image_column(spark, sf_dir):
    return transform.scale_dataset(_order_dataset(spark, sf_dir), "raw", "c_mktsegment").assays["raw"].scale_data.select(OBJECT, rounded("price").alias("price"))


@query(f"""with {VECTORS_SQL}, m as (select label, {', '.join(f'avg({d}) as {d}' for d in DIMS)} from vectors group by 1)
select label as object_id, round((e0 - avg(e0) over ()) / stddev_samp(e0) over (), 5) + 0.0 as e0 from m""")
def aggregate_assay_rescaled(spark, sf_dir):
    d = _vector_dataset(spark, sf_dir)
    own = d.assay()
    out = aggregate.aggregate_assay(Assay(own.data, own.data), d.objects, "label")
    return out.scale_data.select(OBJECT, rounded("e0", 5).alias("e0"))


@query(f"""with {VECTORS_SQL}, m as (select label, regr_slope(e1, e0) b, regr_intercept(e1, e0) a from vectors group by 1)
select object_id::varchar as object_id, round(e1 - a - b * e0, 6) + 0.0 as e1 from vectors join m using (label)""")
def correct_lm_grouped(spark, sf_dir):
    out = linmodel.correct_lm(_vector_dataset(spark, sf_dir), "raw", ["e0"], grouping="label")
    return out.assays["raw.lm.corrected"].data.select(OBJECT, rounded("e1").alias("e1"))


@query(f"""with {VECTORS_SQL}, m as (select label, regr_slope(e1, e0) b from vectors group by 1) select object_id, round(e1 - b * e0, 6) + 0.0 as e1 from vectors join m using (label)""")
def correct_keeping_intercepts(spark, sf_dir):
    return legacy.correct(vectors(spark, sf_dir), ["e1"], ["e0"], "label").select(OBJECT, rounded("e1").alias("e1"))


@query(f"select l_returnflag, {', '.join(f'round(median({c}::double), 4) + 0.0 as {c}' for c in FEATURES)} from lineitem group by 1")
def median_by_group(spark, sf_dir):
    return legacy.median_by_group(line_items(spark, sf_dir), FEATURES, "l_returnflag").select("l_returnflag", *_r(FEATURES, 4))


@query("select l_orderkey, l_linenumber, round(greatest(10, least(40, l_quantity::double)), 6) + 0.0 as l_quantity from lineitem")
def heatmap_clipped(spark, sf_dir):
    return plotdata.heatmap(line_items(spark, sf_dir), ["l_quantity"], (10, 40)).select("l_orderkey", "l_linenumber", rounded("l_quantity").alias("l_quantity"))


_CORS = "list_sum([" + ", ".join(f"corr({a}, {b}) ** 2" for a in DIMS for b in DIMS) + "])"


@query(f"with {VECTORS_SQL} select round({len(DIMS) ** 2} / ({_CORS}), 6) + 0.0 as value from vectors")
def effective_dimensions_galwey(spark, sf_dir):
    """Squared sum over sum of squares of eigenvalues: the squared number of features over the summed squared correlations."""
    value = stats.effective_dimensionality(vectors(spark, sf_dir), DIMS, "Galwey")
    return spark.createDataFrame([(value,)], "value double").select(rounded("value").alias("value"))


@query(f"""with {VECTORS_SQL}, s as (select {', '.join(f'var_samp({d}) as {d}' for d in DIMS)} from vectors) select round({' + '.join(DIMS)}, 6) + 0.0 as total from s""")
def pca_total_variance(spark, sf_dir):
    from plateloom.operators.reduce import principal_components

    total = principal_components(vectors(spark, sf_dir), DIMS, center=True)[2]
    return spark.createDataFrame([(total,)], "total double").select(rounded("total").alias("total"))


@query(f"""with {VECTORS_SQL}, c as (select label, {', '.join(f'avg({d}) as {d}' for d in DIMS)} from vectors group by 1),
d as (select v.*, sqrt({' + '.join(f'(v.{d} - c.{d}) ** 2' for d in DIMS)}) as dist from vectors v join c using (label)),
s as (select * from d qualify row_number() over (partition by label order by dist, object_id) = 1),
n as (select v.label, v.object_id, sqrt({' + '.join(f'(v.{d} - s.{d}) ** 2' for d in DIMS)}) as dist from vectors v join s using (label)),
r as (select *, row_number() over (partition by label order by dist, object_id)::int as rank from n)
select label, object_id, round(dist, 6) + 0.0 as dist, rank from r where rank <= 3""")
def representative_nn_several(spark, sf_dir):
    return representatives.fetch_representative_object_nn(vectors(spark, sf_dir), "label", DIMS, 3).withColumn("dist", rounded("dist"))


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O') and l_suppkey in (select o_orderkey from orders where o_orderstatus = 'O') group by 1")
def prune_relationships(spark, sf_dir):
    """Relationships whose both ends are among the objects."""
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"))
    kept = legacy.prune_relationships(pairs, orders(spark, sf_dir).filter("o_orderstatus = 'O'"), ("a", "b"))
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, l_linenumber, (f1 is null)::int + (f2 is null)::int as gaps, round(list_avg(x), 6) + 0.0 as middle from
(select l_orderkey, l_linenumber, f1, f2, list_filter([f1, f2, l_tax::double], lambda v: v is not null) as x from (select *, case when l_quantity > 25 then l_quantity::double end as f1, case when l_discount > 0.02 then l_discount::double end as f2 from lineitem))
where len(x) = 2""")
def row_statistics(spark, sf_dir):
    """Statistics over the columns of each row, where two of three are known."""
    rows = line_items(spark, sf_dir).withColumns({"f1": F.when(F.col("l_quantity") > 25, F.col("l_quantity")), "f2": F.when(F.col("l_discount") > 0.02, F.col("l_discount"))})
    s = filters.row_statistics(["f1", "f2", "l_tax"])
    out = rows.select("l_orderkey", "l_linenumber", F.rint(s["missing"] * 3).cast("int").alias("gaps"), rounded(s["median"]).alias("middle"))
    return out.filter("gaps = 1")


@query("select l_orderkey, l_linenumber, isinf(x) as is_infinite, isnan(x) as is_nan from (select l_orderkey, l_linenumber, case when l_quantity > 25 then 'inf'::double when l_quantity > 10 then 'nan'::double else 1.0 end as x from lineitem)")
def divide_by_zero(spark, sf_dir):
    rows = line_items(spark, sf_dir)
    top = F.when(F.col("l_quantity") > 25, F.lit(1.0)).when(F.col("l_quantity") > 10, F.lit(0.0)).otherwise(F.lit(1.0))
    x = X.divide(top, F.when(F.col("l_quantity") > 10, F.lit(0.0)).otherwise(F.lit(1.0)))
    return rows.select("l_orderkey", "l_linenumber", X.infinite(x).alias("is_infinite"), F.isnan(x).alias("is_nan"))

