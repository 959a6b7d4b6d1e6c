"""The example tables as objects with features, images and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: All components of an embedding.
DIMS = [f"e{i}" for i in range(64)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def sums_in_order(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``(key, _sum_<name>, _n_<name>)``: sums and numbers of known values by key, added row by row in the order of the table's files.

    Partial sums of tasks, merged in any order, give other last digits, which decide at a threshold. ``rows`` is a table as read.
    """
    own = rows.select(key, *names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    order = Window.partitionBy(key).orderBy("_file", "_row")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {f"_{what}_{c}": f(F.col(c).cast("double")).over(upto) for c in names for what, f in (("sum", F.sum), ("n", F.count))}
    return own.withColumns({**made, "_more": F.lead(F.lit(1)).over(order)}).filter("_more is null").select(key, *made)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with four features; the plate is the return flag, controls are open lines, the image is the order."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_linestatus") == "O").alias("is_control"), *(F.col(f).cast("double").alias(f) for f in FEATURES))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with NULL, NaN, infinite and constant values among their features."""
    rows = line_items(spark, sf_dir)
    return rows.withColumns(
        {
            "f_null": F.when(F.col("l_quantity") > 3, F.col("l_quantity")),
            "f_nan": F.when(F.col("l_tax") > 0.01, F.col("l_tax")).otherwise(F.lit(float("nan"))),
            "f_inf": F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_discount")),
            "f_const": F.lit(4.0),
        }
    )


GAPPY = ["f_null", "f_nan", "f_inf", "f_const", "l_quantity"]
#: The same in SQL.
GAPPY_SQL = """gappy as (
  select l_orderkey, l_linenumber, l_returnflag, l_quantity::double as l_quantity,
         case when l_quantity > 3 then l_quantity::double end as f_null,
         case when l_tax > 0.01 then l_tax::double else 'nan'::double end as f_nan,
         case when l_linenumber = 1 then 'inf'::double else l_discount::double end as f_inf,
         4.0::double as f_const
  from lineitem)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_custkey").cast("string").alias("image_id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("long").alias("object_id"), F.col("label").cast("string").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(len(DIMS))))


VECTORS_SQL = "vectors as (select vec_id as object_id, label::varchar as label, " + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(len(DIMS))) + " from embeddings)"
