"""Ruled tables, figures and lean of page images.

pages(doc, page, width, height, scale, gray binary, words array<struct<text, x0,
top, x1, bottom>>). Single pixels are only looked at inside one page's raster, by
numpy: they become a few rows, which are strokes, dense cells and a lean. All that
follows is joins, windows and aggregates of those rows by (doc, page).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, overlap_ratio
from . import raster

#: Lengths in points and shares that make a ruling, a grid, a figure; angles in degrees.
MIN_RULE = {"h": (40.0, 20), "v": (18.0, 14)}
MIN_CELLS, MIN_CONFIDENCE, MIN_MAIN, MIN_INSIDE = 6, 0.25, 0.35, 6
MAX_RESCUES, MIN_ALNUM, CELL_FRAME = 60, 0.45, " |¦l_"
CELL_PT, DENSITY, MIN_W_PT, MIN_H_PT, MIN_AREA, MAX_AREA, FILL, ASPECT = 6.0, 0.035, 45.0, 40.0, 0.012, 0.92, 0.18, 25
IN_TABLE, CROP_PAD = 0.5, 4.0
SKEW, SKEW_STEP, MIN_SKEW = 4.0, 0.25, 0.2
PAGE = ["doc", "page"]


# ---- what pixels are needed for --------------------------------------------------
def dark_limit(gray: np.ndarray) -> int:
    """The grey that parts dark from light with the means farthest apart; 0 for one grey. Ink is darker than it."""
    grey, n = np.unique(gray, return_counts=True)
    below, mass = np.cumsum(n, dtype=float), np.cumsum(n * grey.astype(float))
    b, above, light = below[:-1], below[-1] - below[:-1], mass[-1] - mass[:-1]
    return int(grey[np.argmax(b * above * (mass[:-1] / b - light / above) ** 2)]) if len(b) else 0


def long_runs(ink: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of at least so many cells of ink along the rows."""
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    long = last - first + 1 >= least
    return row[long], first[long], last[long]


def lean(gray: np.ndarray) -> float:
    """Degrees by which lines lean: the shear whose profile of rows varies most; upright unless another is better."""
    ink = gray < dark_limit(gray)
    if min(gray.shape) < 50 or not 0.002 <= ink.mean() <= 0.6:
        return 0.0
    angles = np.arange(round(-SKEW / SKEW_STEP), round(SKEW / SKEW_STEP) + 1) * SKEW_STEP
    height, y, x = len(ink), *np.nonzero(ink)
    profile = np.zeros((len(angles), height), np.int64)
    for at in range(0, len(y), 50_000):
        s = slice(at, at + 50_000)
        row = np.rint(y[s] + np.tan(np.radians(angles))[:, None] * (x[s] - gray.shape[1] / 2)).astype(int).clip(0, height - 1)
        profile += np.bincount((row + height * np.arange(len(angles))[:, None]).ravel(), minlength=profile.size).reshape(profile.shape)
    score = np.diff(profile).var(1)
    upright = len(angles) // 2
    return float(angles[score.argmax()]) if score.max() > score[upright] else 0.0


def straightened(gray: np.ndarray, angle: float) -> np.ndarray:
    """The raster with its lines level again; too small a lean is left as it is."""
    if abs(angle) < MIN_SKEW:
        return gray
    x = np.arange(gray.shape[1])
    y = np.arange(len(gray))[:, None] - np.rint(np.tan(np.radians(angle)) * (x - gray.shape[1] / 2)).astype(int)
    return np.where((y >= 0) & (y < len(gray)), gray[y.clip(0, len(gray) - 1), x], 255).astype(np.uint8)


def stretched(gray: np.ndarray) -> np.ndarray:
    """The raster with its greys spread between the ends that raster.contrast takes."""
    low, high = np.quantile(gray, (raster.LOW, raster.HIGH))
    if high - low < raster.MIN_SPREAD:
        return gray
    return np.clip((gray - low) * (255 / (high - low)), 0, 255).astype(np.uint8)


def crop(gray: np.ndarray, scale: float, x0: float, top: float, x1: float, bottom: float) -> np.ndarray:
    """The part of the raster that a box in points and a small margin cover."""
    low = lambda v: max(0, int((v - CROP_PAD) * scale))
    return gray[low(top) : int((bottom + CROP_PAD) * scale), low(x0) : int((x1 + CROP_PAD) * scale)]


def _by_page(pages: DataFrame, look, schema: str) -> DataFrame:
    """look(raster, scale) of each page, a frame of rows, with doc and page beside them."""
    kinds = pages.schema
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                found = look(np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width), r.scale)
                found.insert(0, "page", r.page)
                found.insert(0, "doc", r.doc)
                yield found[["doc", "page", *names]]

    keys = ", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in PAGE)
    return pages.select(*PAGE, "width", "height", "scale", "gray").mapInPandas(run, f"{keys}, {schema}")


def prepared(pages: DataFrame) -> DataFrame:
    """(doc, page, angle, gray) ready for text recognition: level and with stretched greys."""

    def look(gray: np.ndarray, scale: float) -> pd.DataFrame:
        angle = lean(gray)
        return pd.DataFrame({"angle": [angle], "gray": [stretched(straightened(gray, angle)).tobytes()]})

    return _by_page(pages, look, "angle double, gray binary")


def strokes(pages: DataFrame) -> DataFrame:
    """(doc, page, axis, at, start, end): long runs of ink along the rows (h) and the columns (v), in pixels."""

    def look(gray: np.ndarray, scale: float) -> pd.DataFrame:
        ink = gray < dark_limit(gray)
        if min(gray.shape) < 40:
            ink = ink[:0]
        parts = []
        for axis, mask in (("h", ink), ("v", ink.T)):
            points, pixels = MIN_RULE[axis]
            at, start, end = long_runs(mask, max(pixels, int(points * scale * 0.5)))
            parts.append(pd.DataFrame({"axis": axis, "at": at, "start": start, "end": end}))
        return pd.concat(parts)

    return _by_page(pages, look, "axis string, at long, start long, end long")


def dense_cells(pages: DataFrame) -> DataFrame:
    """(doc, page, y, x, density) of the coarse cells that hold enough ink, but those at the rim of the page."""

    def look(gray: np.ndarray, scale: float) -> pd.DataFrame:
        side = cell_side(scale)
        ink = gray < dark_limit(gray)
        rows, cols = len(ink) // side, ink.shape[1] // side
        if min(rows, cols) < 4:
            rows = cols = 0
        share = ink[: rows * side, : cols * side].reshape(rows, side, cols, side).mean((1, 3)) if rows else np.zeros((0, 0))
        y, x = np.nonzero(share > DENSITY)
        inner = (y > 0) & (x > 0) & (y < rows - 1) & (x < cols - 1)
        return pd.DataFrame({"y": y[inner], "x": x[inner], "density": share[y[inner], x[inner]]})

    return _by_page(pages, look, "y long, x long, density double")


# ---- figures -----------------------------------------------------------------------
def cell_side(scale: float) -> int:
    return max(4, int(CELL_PT * scale))


def _side() -> Column:
    return F.greatest(F.lit(4), (F.lit(CELL_PT) * F.col("scale")).cast("int"))


def word_cells(pages: DataFrame) -> DataFrame:
    """(doc, page, y, x) of the coarse cells that a word or its margin of one cell covers."""
    word = pages.select(*PAGE, "width", "height", "scale", _side().alias("side"), F.explode("words").alias("w"))

    def covered(a: str, b: str, size: str) -> Column:
        first, last = (F.greatest(F.lit(0.0), F.col(f"w.{a}") * F.col("scale")), F.least(F.col(size), F.col(f"w.{b}") * F.col("scale")))
        cell = lambda v: F.floor(v.cast("int") / F.col("side")).cast("int")
        return F.sequence(cell(first) - 1, F.greatest(cell(last), cell(first) - 2) + 1)

    rows = word.select(*PAGE, covered("x0", "x1", "width").alias("xs"), F.explode(covered("top", "bottom", "height")).alias("y"))
    return rows.select(*PAGE, F.col("y").cast("long").alias("y"), F.explode(F.transform("xs", lambda x: x.cast("long"))).alias("x"))


def figures(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc, page, x0, top, x1, bottom, ink): inked regions without text, in points, close ones joined.

    tables(doc, page, x0, top, x1, bottom), where given: a region that lies mostly in one is no figure.
    """
    marked = dense_cells(pages).join(word_cells(pages), [*PAGE, "y", "x"], "left_anti")
    parts = raster.label(marked, PAGE).join(pages.select(*PAGE, "scale", "width", "height", _side().alias("side")), PAGE)
    point = F.col("side") / F.col("scale")
    whole = parts.groupBy(*PAGE, "component").agg(
        F.count("*").alias("n"), (F.min("x") * F.first(point)).alias("x0"), (F.min("y") * F.first(point)).alias("top"), ((F.max("x") + 1) * F.first(point)).alias("x1"), ((F.max("y") + 1) * F.first(point)).alias("bottom"),
        F.avg("density").alias("ink"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("cells"), (F.first(F.col("width") * F.col("height")) / F.first(F.col("scale") * F.col("scale"))).alias("area"),
    )
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    shaped = (w >= MIN_W_PT) & (h >= MIN_H_PT) & (F.greatest(w / F.greatest(h, F.lit(1.0)), h / F.greatest(w, F.lit(1.0))) <= ASPECT)
    filled = (F.col("n") >= 4) & (F.col("n") >= FILL * F.col("cells")) & (w * h / F.col("area")).between(MIN_AREA, MAX_AREA)
    region = F.struct("top", "x0", "x1", "bottom", "ink")
    boxes = whole.where(shaped & filled).groupBy(*PAGE).agg(F.sort_array(F.collect_list(region)).alias("r"))
    ordered = F.transform("r", lambda r: F.struct(r["x0"].alias("x0"), r["top"].alias("top"), r["x1"].alias("x1"), r["bottom"].alias("bottom"), r["ink"].alias("ink")))
    found = boxes.select(*PAGE, F.explode(raster.merge_close(ordered)).alias("f")).select(*PAGE, "f.*")
    return found if tables is None else outside(found, tables)


def outside(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """regions that don't lie by more than half in a table of their page."""
    named = tables.select(*(F.col(c).alias(f"t_{c}") for c in (*PAGE, "x0", "top", "x1", "bottom")))
    same = (F.col("doc") == F.col("t_doc")) & (F.col("page") == F.col("t_page"))
    return regions.join(named, same & (overlap_ratio(box(), box("t_")) > IN_TABLE), "left_anti")


# ---- ruled tables ---------------------------------------------------------------------
def rulings(pages: DataFrame) -> DataFrame:
    """(doc, page, axis, position, start, end) in points: strokes of neighbouring rows as one, its longest part."""
    keys = [*PAGE, "axis"]
    s = strokes(pages).join(pages.select(*PAGE, "scale"), PAGE)
    rows = Window.partitionBy(*keys).orderBy("at")
    new_band = F.coalesce(F.col("at") - F.lag("at").over(rows) > 2, F.lit(True)).cast("int")
    s = s.withColumn("new", new_band).withColumn("band", F.sum("new").over(rows.rangeBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys, "band").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    far = F.coalesce(F.col("start") - reach > F.greatest(F.lit(3), (F.col("scale") * 2).cast("int")), F.lit(True)).cast("int")
    s = s.withColumn("far", far).withColumn("part", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = s.groupBy(*keys, "band", "scale", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("at").alias("low"), F.max("at").alias("high"))
    longest = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("p")
    band = parts.groupBy(*keys, "band", "scale").agg(longest, ((F.min("low") + F.max("high")) / 2 / F.col("scale")).alias("position"))
    least = F.when(F.col("axis") == "h", MIN_RULE["h"][0]).otherwise(MIN_RULE["v"][0])
    found = band.select(*keys, "position", (F.col("p.start") / F.col("scale")).alias("start"), (F.col("p.end") / F.col("scale")).alias("end"))
    return found.where(F.col("end") - F.col("start") >= least)


def grid_edges(pages: DataFrame) -> DataFrame:
    """(doc, page, xs, ys): the edges that rulings draw, for pages where they may make a table."""
    size = pages.select(*PAGE, (F.col("height") / F.col("scale")).alias("h"), (F.col("width") / F.col("scale")).alias("w"))
    ruled = rulings(pages).join(size, PAGE)
    counts = ruled.groupBy(*PAGE, "h", "w").agg(F.count_if(F.col("axis") == "h").alias("nh"), F.count_if(F.col("axis") == "v").alias("nv"))
    at = raster.cluster_positions(ruled, [*PAGE, "axis"], "position", F.greatest(F.lit(2.0), F.col("h") * 0.004))
    side = lambda axis: F.sort_array(F.collect_list(F.when(F.col("axis") == axis, F.col("position"))))
    edges = at.groupBy(*PAGE).agg(side("v").alias("xs"), side("h").alias("ys")).join(counts, PAGE)
    reach = lambda c: F.array_max(c) - F.array_min(c)
    enough = (F.col("nh") >= 3) & (F.col("nv") >= 2) & (F.size("ys") >= 3) & (F.size("xs") >= 3)
    return edges.where(enough & (reach("xs") >= F.col("w") * 0.15) & (reach("ys") >= F.col("h") * 0.04)).select(*PAGE, "xs", "ys")


def ruled_tables(pages: DataFrame, reread: DataFrame | None = None) -> DataFrame:
    """(doc, page, rows, confidence, x0, top, x1, bottom): at most one table for each page, the whole grid.

    reread(doc, page, i, j, text), where given, are second readings of cells; if
    few cells are empty, those that read plausibly fill them.
    """
    edges = grid_edges(pages)
    words = pages.select(*PAGE, F.explode("words").alias("w")).join(edges, PAGE)
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    before = lambda edge, at: F.size(F.filter(edge, lambda e: e <= at))
    within = lambda edge, at: at.between(F.array_min(edge), F.array_max(edge))
    placed = words.select(*PAGE, "w.text", "w.x0", F.round(cy, 0).alias("line"), before("ys", cy).alias("i"), before("xs", cx).alias("j"), (within("ys", cy) & within("xs", cx)).cast("int").alias("inside"), F.size("ys").alias("ny"), F.size("xs").alias("nx"))
    inside = placed.groupBy(*PAGE).agg(F.sum("inside").alias("inside"))
    in_cell = placed.where((F.col("i") > 0) & (F.col("i") < F.col("ny")) & (F.col("j") > 0) & (F.col("j") < F.col("nx")))
    read = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "x0", "text"))), lambda w: w["text"]), " ")
    cells = in_cell.groupBy(*PAGE, "i", "j").agg(read.alias("text")).where("text <> ''")
    known = cells.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "text"))).alias("cells"), F.count("*").alias("full"))
    grid = edges.join(known, PAGE).join(inside, PAGE)
    n_cells = (F.size("xs") - 1) * (F.size("ys") - 1)
    grid = grid.where((F.col("inside") >= MIN_INSIDE) & (F.col("full") >= MIN_MAIN * n_cells))
    if reread is not None:
        grid = grid.join(second_readings(reread), PAGE, "left").withColumn("cells", F.when(n_cells - F.col("full") <= MAX_RESCUES, F.map_concat("cells", _missing("again", "cells"))).otherwise(F.col("cells")))
    numbers = lambda edge: F.sequence(F.lit(1), F.size(edge) - 1)
    rows = F.transform(numbers("ys"), lambda i: F.transform(numbers("xs"), lambda j: F.coalesce(F.element_at("cells", F.struct(i.alias("i"), j.alias("j"))), F.lit(""))))
    kept = grid.withColumn("rows", F.filter(rows, lambda r: F.exists(r, lambda c: c != "")))
    confidence = F.least(F.lit(1.0), F.size("cells") / F.greatest(F.lit(1), F.size("rows") * (F.size("xs") - 1)))
    good = (F.size("cells") >= MIN_CELLS) & (F.size("rows") >= 2) & (confidence >= MIN_CONFIDENCE)
    ends = [f(c).alias(n) for c, f, n in (("xs", F.array_min, "x0"), ("ys", F.array_min, "top"), ("xs", F.array_max, "x1"), ("ys", F.array_max, "bottom"))]
    return kept.where(good).select(*PAGE, "rows", confidence.alias("confidence"), *ends)


def plausible(text: Column) -> Column:
    """Whether a cell's second reading is text and no drawing: enough of its characters are letters or digits."""
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return alnum >= F.greatest(F.lit(1), F.floor(F.length(text) * MIN_ALNUM))


def second_readings(reread: DataFrame) -> DataFrame:
    """(doc, page, again): the plausible readings of reread(doc, page, i, j, text) by cell, without the cell's frame."""
    text = F.btrim(F.btrim(F.coalesce("text", F.lit("")), F.lit(CELL_FRAME)))
    good = reread.select(*PAGE, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), text.alias("text")).where(plausible(F.col("text")))
    first = good.groupBy(*PAGE, "i", "j").agg(F.min("text").alias("text"))
    return first.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "text"))).alias("again"))


def _missing(more: str, known: str) -> Column:
    """Entries of the map more whose key known hasn't got."""
    none = F.map_filter(known, lambda k, v: F.lit(False))
    return F.coalesce(F.map_filter(more, lambda k, v: ~F.map_contains_key(known, k)), none)
