"""Rasters as rows (key, y, x, px): thresholds, profiles, openings, runs, clusters, components.

What is a sum or a neighbourhood along one axis is an aggregate or a window.
Connected components and greedy merging depend on order within one page and run
in a grouped function over that page's coarse grid.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LOW, HIGH, MIN_SPREAD = 0.02, 0.98, 20
MERGE_GAP = 14.0


def otsu(pixels: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the value that parts dark and light best, the smallest of equals."""
    hist = pixels.groupBy(key, "px").agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy(key).orderBy("px").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    sums = hist.select(key, "px", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("px")).over(upto).alias("m"), F.sum("n").over(every).alias("wt"), F.sum(F.col("n") * F.col("px")).over(every).alias("mt"))
    omega, mu, mu_t = F.col("w") / F.col("wt"), F.col("m") / F.col("wt"), F.col("mt") / F.col("wt")
    between = F.when(F.col("w") < F.col("wt"), (mu_t * omega - mu) * (mu_t * omega - mu) / (omega * (1 - omega))).otherwise(0.0)
    best = F.max_by("px", F.struct(F.round(between, 9).alias("s"), (-F.col("px")).alias("p")))
    return sums.groupBy(key).agg(best.alias("t"), F.max(between).alias("s")).select(key, F.when(F.col("s") > 0, F.col("t")).otherwise(0).cast("long").alias("threshold"))


def ink(pixels: DataFrame, key: str) -> DataFrame:
    """pixels with ink: darker than the threshold of their raster."""
    return pixels.join(otsu(pixels, key), key).withColumn("ink", F.col("px") < F.col("threshold"))


def profile_score(inked: DataFrame, key: str) -> DataFrame:
    """(key, score): variance of the change of ink from row to row; 0 under four rows."""
    rows = inked.groupBy(key, "y").agg(F.count_if("ink").alias("n"))
    step = rows.select(key, (F.col("n") - F.lag("n").over(Window.partitionBy(key).orderBy("y"))).alias("d"))
    return step.groupBy(key).agg(F.when(F.count("*") >= 4, F.var_pop("d")).otherwise(0.0).alias("score"))


def contrast(pixels: DataFrame, key: str) -> DataFrame:
    """pixels with px stretched between the 2nd and the 98th percentile, if these lie apart."""
    ends = pixels.groupBy(key).agg(F.percentile("px", [LOW, HIGH]).alias("p")).select(key, F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
    wide = F.col("hi") - F.col("lo") >= MIN_SPREAD
    stretched = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("px") - F.col("lo")) * (255.0 / (F.col("hi") - F.col("lo"))))), 6))
    return pixels.join(ends, key).withColumn("px", F.when(wide, stretched).otherwise(F.col("px")).cast("long")).drop("lo", "hi")


def opening(mask: DataFrame, keys: list[str], along: str, k: int, flag: str = "ink") -> DataFrame:
    """mask with opened: in a run of at least k along one axis (centred windows, nothing beyond the edges)."""
    frame = Window.partitionBy(*keys).orderBy(along).rowsBetween(-(k // 2), k - 1 - k // 2)
    eroded = mask.withColumn("__e", F.count_if(F.col(flag)).over(frame) == k)
    return eroded.withColumn("opened", F.count_if(F.col("__e")).over(frame) > 0).drop("__e")


def bands(points: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, start, end) of runs of values that lie at most gap apart."""
    order = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(order) > gap, F.lit(True)).cast("int")
    return points.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order)).groupBy(*keys, "__run").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("__run")


def longest_run(points: DataFrame, keys: list[str], at: str, gap: int = 4) -> DataFrame:
    """The longest band of each key, the first of equals."""
    length = F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"))
    return bands(points, keys, at, gap).groupBy(*keys).agg(F.max_by(F.struct("start", "end"), length).alias("r")).select(*keys, "r.start", "r.end")


def cluster_positions(points: DataFrame, keys: list[str], at: str, tolerance: float | Column) -> DataFrame:
    """Mean positions of chains of values whose neighbours lie within tolerance."""
    order = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(order) > tolerance, F.lit(True)).cast("int")
    return points.withColumn("__new", new).withColumn("__c", F.sum("__new").over(order)).groupBy(*keys, "__c").agg(F.avg(at).alias("position")).drop("__c")


def label(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells(keys, y, x, ...) with component, from 1 on in the order of their first cells; eight neighbours join."""
    schema = StructType([*cells.schema.fields, StructField("component", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[tuple[int, int], int] = {}
        places = list(zip(pdf["y"].tolist(), pdf["x"].tolist(), strict=True))
        there = set(places)
        n = 0
        for first in sorted(there):
            if first in number:
                continue
            n += 1
            number[first] = n
            wave = [first]
            while wave:
                near = {(y + dy, x + dx) for y, x in wave for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
                wave = [c for c in near if c in there and c not in number]
                number.update(dict.fromkeys(wave, n))
        return pdf.assign(component=[number[c] for c in places])

    return cells.groupBy(*keys).applyInPandas(run, schema)


def components(cells: DataFrame, key: str) -> DataFrame:
    """(key, component, cells, x0, y0, x1, y1) of the marked cells(key, y, x), joined over eight neighbours."""
    long = lambda f, c, n: f(c).cast("long").alias(n)
    found = label(cells.select(key, "y", "x").distinct(), [key]).groupBy(key, "component")
    return found.agg(F.count("*").alias("cells"), long(F.min, "x", "x0"), long(F.min, "y", "y0"), long(F.max, "x", "x1"), long(F.max, "y", "y1"))


def merge_close(regions: Column, gap: float = MERGE_GAP) -> Column:
    """Boxes (structs x0, top, x1, bottom, ink) in order; each joins the first box within gap, or stands alone."""
    def near(a: Column, b: Column) -> Column:
        return (a["x0"] < b["x1"] + gap) & (b["x0"] < a["x1"] + gap) & (a["top"] < b["bottom"] + gap) & (b["top"] < a["bottom"] + gap)

    def join(a: Column, b: Column) -> Column:
        return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["top"], b["top"]).alias("top"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["bottom"], b["bottom"]).alias("bottom"), F.greatest(a["ink"], b["ink"]).alias("ink"))

    def step(kept: Column, r: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: near(r, k)), True)
        return F.when(hit > 0, F.transform(kept, lambda k, i: F.when(i + 1 == hit, join(k, r)).otherwise(k))).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(regions, F.slice(regions, 1, 0), step)
