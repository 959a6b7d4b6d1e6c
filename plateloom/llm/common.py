"""Helpers that the text operators share: table access, staged tables and connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local one only where that is unset and so is the cluster."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (configured or "file:///tmp/plateloom-checkpoints").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when this driver ends."""
    path = f"{shared_dir(spark)}/plateloom/{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_staged() -> None:
    for spark, path in _STAGED:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before the interpreter  # noqa: BLE001
            return


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(u long, v long)`` as ``(node, component)``.

    ``component`` is the smallest node of its component; nodes without an edge don't appear. Alternates
    large-star and small-star steps until the edges no longer change. Every step is a minimum per node,
    which combines before its shuffle, and an equi-join of two staged tables, which Spark can split
    where one node has very many edges. Nothing but two numbers a round reaches the driver.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stage(edges.filter(F.col("u") != F.col("v")).select(high, low).distinct(), "edges")
    before = _digest(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v"), F.col("u")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large")
        root = stage(large.groupBy("u").agg(F.min("v").alias("m")), "root")
        small = large.join(root, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v"), F.col("v")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """The number of edges and an order-free hash of them."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return (row[0], row[1])
