"""Inputs of density charts: violins by category and hexagonal bins.

Both reduce the rows to a bounded table in one shuffle with combining; the rest of the work is on that table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import c_
from .ranks import quantiles

#: Bins of a category's histogram, from which its density is made.
FINE = 2048


def _pairs(df: DataFrame, number: str, category: str) -> DataFrame:
    """category, v of the rows that have both; NaN counts as missing."""
    v = F.nanvl(c_(number).cast("double"), F.lit(None).cast("double"))
    return df.select(c_(category).cast("string").alias("category"), v.alias("v")).filter("category is not null and v is not null")


def violin(df: DataFrame, number: str, category: str, top: int = 10, points: int = 100, fine: int = FINE, cut: float = 0.0) -> DataFrame:
    """category, n, mean, median, point, x, density: a Gaussian kernel density at ``points`` places from least to greatest value, or ``cut`` bandwidths
    beyond them, for each of the ``top`` most frequent categories (ties by name).

    The bandwidth is Scott's, the standard deviation times n to the power -1/5. Kernels stand at the mean of each of ``fine`` bins and weigh its
    count, so all rows count and none is read again for a point. A category without spread has one point of density 1.
    """
    rows = _pairs(df, number, category)
    found = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    some = found.orderBy(F.desc("n"), "category").limit(top)  # ``top`` rows
    wide = F.col("hi") > F.col("lo")
    at = F.when(wide, F.least(F.lit(fine - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * fine))).otherwise(0)
    binned = rows.join(F.broadcast(some.select("category", "lo", "hi")), "category").groupBy("category", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("center"))
    place = F.when(wide, F.sequence(F.lit(0), F.lit(points - 1))).otherwise(F.array(F.lit(0)))
    width = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    begin, end = (F.col("lo") - cut * width, F.col("hi") + cut * width) if cut else (F.col("lo"), F.col("hi"))
    x = begin + (end - begin) * F.col("point") / (points - 1)
    kernels = binned.join(F.broadcast(some), "category").withColumn("point", F.explode(place)).withColumn("x", x)
    height = F.col("k") * F.exp(-F.pow((F.col("x") - F.col("center")) / width, 2) / 2) / (F.col("n") * width * math.sqrt(2 * math.pi))
    density = kernels.groupBy("category", "point", "x").agg(F.sum(F.when(wide, height).otherwise(1.0)).alias("density"))
    median = quantiles(rows.join(F.broadcast(some.select("category")), "category"), ["category"], "v", [0.5])
    middle = median.select("category", F.get("q", F.lit(0)).alias("median"))
    return density.join(F.broadcast(some.select("category", "n", "mean")), "category").join(F.broadcast(middle), "category").select("category", "n", "mean", "median", "point", "x", "density")


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """x, y (the centre), n of each hexagon that has points: ``gridsize`` columns between the least and the greatest x.

    Hexagons are the cells of two lattices of centres, the second shifted by half a step in both directions; a point belongs to the nearer of its
    two candidates (ties: the second). The ranges are a billionth wider on each side, so that all points lie within. Rows without either value, or with NaN, are left out; without spread a direction has one column.
    """
    number = lambda c: F.nanvl(c_(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(number(x).alias("a"), number(y).alias("b")).filter("a is not null and b is not null")
    ends = rows.agg(F.min("a").alias("xl"), F.max("a").alias("xh"), F.min("b").alias("yl"), F.max("b").alias("yh"))
    room = lambda lo, hi: (F.col(hi) - F.col(lo)) * 1e-9
    span = ends.select((F.col("xl") - room("xl", "xh")).alias("xl"), (F.col("xh") + room("xl", "xh")).alias("xh"), (F.col("yl") - room("yl", "yh")).alias("yl"), (F.col("yh") + room("yl", "yh")).alias("yh"))
    # 1 / sqrt(3) rows a column make the hexagons regular.
    steps = {"a": ("xl", "xh", gridsize), "b": ("yl", "yh", max(1, int(gridsize / math.sqrt(3))))}
    size = {c: F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) / k).otherwise(1.0) for c, (lo, hi, k) in steps.items()}
    put = {c: (F.col(c) - F.col(lo)) / size[c] for c, (lo, _, _) in steps.items()}
    placed = rows.join(F.broadcast(span)).select("*", put["a"].alias("i"), put["b"].alias("j"))  # a row
    i1, j1, i2, j2 = F.rint("i"), F.rint("j"), F.floor("i") + 0.5, F.floor("j") + 0.5
    far = lambda p, q: F.pow(F.col("i") - p, 2) + 3 * F.pow(F.col("j") - q, 2)
    first = far(i1, j1) < far(i2, j2)
    cells = placed.groupBy(F.when(first, i1).otherwise(i2).alias("p"), F.when(first, j1).otherwise(j2).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(span)).select((F.col("xl") + F.col("p") * size["a"]).alias("x"), (F.col("yl") + F.col("q") * size["b"]).alias("y"), "n")

