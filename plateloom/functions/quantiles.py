"""Exact quantiles of whole columns by counting: no sort of all rows and no task that holds all different values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateloom.functions.exprs import agg_wide, known, missing

#: Ranges that a column is cut into in a pass, and the values that are ranked one by one at the end.
RANGES = 4096
RANKED = 1 << 17


def exact_quantiles(df: DataFrame, values: dict[str, Column], p: float = 0.5, na_rm: bool = True) -> dict[str, float | None]:
    """The quantile of each expression over all rows, with linear interpolation; None without known values.

    A pass counts the values in equal ranges between the least and the largest; the range that holds the wanted ranks is cut
    again until few enough values are left, which are counted one by one. Every pass is an aggregate that combines
    before its shuffle. Without ``na_rm`` a missing value makes the result None.
    """
    names = list(values)
    rows = df.select(*(values[f].cast("double").alias(f"_q{i}") for i, f in enumerate(names)))
    own = [f"_q{i}" for i in range(len(names))]
    finite = [F.when(F.abs(known(c)) < float("inf"), known(c)) for c in own]
    made = []
    for c, x in zip(own, finite):
        made += [F.count(known(c)).alias(f"{c}n"), F.sum(missing(c).cast("long")).alias(f"{c}g"), F.sum((known(c) == float("-inf")).cast("long")).alias(f"{c}l"), F.min(x).alias(f"{c}a"), F.max(x).alias(f"{c}b"), F.count(x).alias(f"{c}f")]
    first = agg_wide(rows, [], made, 120).first()
    out: dict[str, float | None] = dict.fromkeys(names)
    todo: dict[int, list] = {}  # column: least, largest, values below the least, values between, wanted ranks
    where: dict[int, float] = {}
    for i, (f, c) in enumerate(zip(names, own)):
        n, below = first[f"{c}n"], first[f"{c}l"] or 0
        if not n or (first[f"{c}g"] and not na_rm):
            continue
        where[i] = (n - 1) * p
        ranks = [math.floor(where[i]), math.ceil(where[i])]
        ends = [float("-inf") if r < below else float("inf") if r >= below + first[f"{c}f"] else None for r in ranks]
        if ends == [None, None]:
            todo[i] = [first[f"{c}a"], first[f"{c}b"], below, first[f"{c}f"], ranks]
        else:
            low, high = (0.0 if e is None else e for e in ends)
            out[f] = low if low == high else low + high  # between an infinite and a finite value, or two infinite ones
    found: dict[int, list] = {}

    def inside() -> DataFrame:
        """The values of unfinished columns within their bounds."""
        cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(own[i]).alias("v"), F.lit(todo[i][0]).alias("a"), F.lit(todo[i][1]).alias("b")) for i in todo))
        return rows.select(F.explode(cells).alias("c")).select("c.*").filter("v is not null and v between a and b")

    while todo:
        for i in [i for i, t in todo.items() if t[0] == t[1]]:
            found[i] = [todo[i][0]] * 2
            del todo[i]
        if not any(t[3] > RANKED for t in todo.values()):
            break
        spot = F.least(F.floor((F.col("v") / F.lit(2.0) - F.col("a") / 2) / ((F.col("b") / 2 - F.col("a") / 2) / RANGES)), F.lit(RANGES - 1))
        counted = inside().groupBy("i", spot.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for i, t in todo.items():
            before, kept = t[2], []
            for r in sorted((r for r in counted if r.i == i), key=lambda r: r.k):
                if before <= t[4][1] and before + r.n > t[4][0]:
                    kept.append((r.a, r.b, before, r.n))
                before += r.n
            todo[i] = [kept[0][0], kept[-1][1], kept[0][2], sum(k[3] for k in kept), t[4]]
            if len(kept) > 1:  # the ranks stand on either side of a border
                found[i] = [kept[0][1], kept[-1][0]]
        todo = {i: t for i, t in todo.items() if i not in found}
    if todo:
        counts = inside().groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        bound = lambda k: F.element_at(F.create_map(*(F.lit(x) for i, t in todo.items() for x in (i, t[4][k] - t[2]))), F.col("i"))
        hits = counts.withColumn("upto", upto).filter((F.col("upto") > bound(0)) & (F.col("upto") - F.col("n") <= bound(1))).orderBy("i", "v").collect()
        for i in todo:
            own_hits = [r.v for r in hits if r.i == i]
            found[i] = [own_hits[0], own_hits[-1]]
    for i, (a, b) in found.items():
        out[names[i]] = a + (where[i] - math.floor(where[i])) * (b - a) if a != b else a
    return out
