"""Grids in long form: a row a cell (ix, iy), rows absent where nothing is known."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.operators import graph, kernels, spatial
from roadspark.operators.graph import stored


def binned(df: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Adds ix, iy: the cell by truncation towards zero."""
    return df.withColumn("ix", ((F.col("x") - x0) / cell).cast("int")).withColumn("iy", ((F.col("y") - y0) / cell).cast("int"))


def lower_envelope(samples: DataFrame, cell: float, drop: float, share: float = 0.1) -> DataFrame:
    """Height of each cell: the share quantile, but at most the least sample less drop."""
    least = F.min("z") - drop
    height = least if drop >= 0 else F.least(F.percentile("z", share), least)  # the quantile can't be below the minimum
    return binned(samples, cell).groupBy("ix", "iy").agg(height.alias("z"))


def cell_quantile(samples: DataFrame, cell: float, share: float) -> DataFrame:
    return binned(samples, cell).groupBy("ix", "iy").agg(F.percentile("z", share).alias("q"))


def corners(points: DataFrame, cell: float, nx: int, ny: int) -> DataFrame:
    """A row for each of a point's four grid nodes (ix, iy, weight), clamped to the grid, for bilinear sampling."""
    fx, fy = (F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), F.col(a) / cell)) for a, n in (("x", nx), ("y", ny)))
    d = points.withColumns({"_fx": fx, "_fy": fy}).withColumns({"_ix": F.least(F.floor("_fx"), F.lit(max(nx - 2, 0))), "_iy": F.least(F.floor("_fy"), F.lit(max(ny - 2, 0)))})
    tx, ty = F.col("_fx") - F.col("_ix"), F.col("_fy") - F.col("_iy")
    four = F.array(*(F.struct((F.col("_ix") + i).cast("int").alias("ix"), (F.col("_iy") + j).cast("int").alias("iy"), ((tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("weight")) for i in (0, 1) for j in (0, 1)))
    return d.select(*points.columns, F.explode(four).alias("_c")).select(*points.columns, "_c.*")


def bilinear(points: DataFrame, nodes: DataFrame, keys: list[str], cell: float, nx: int, ny: int) -> DataFrame:
    """keys and z: heights between the four nodes around; nodes that are absent give null."""
    c = corners(points, cell, nx, ny).filter("weight > 0").join(nodes.select("ix", "iy", F.col("z").alias("node_z")), ["ix", "iy"], "left")
    return c.groupBy(*keys).agg(F.when(F.count("node_z") == F.count("*"), F.sum(F.col("weight") * F.col("node_z"))).alias("z"))


def nearest_cell(points: DataFrame, nodes: DataFrame, cell: float, nx: int, ny: int, *, x0: float = 0.0, y0: float = 0.0, how: str = "round", outer: bool = False) -> DataFrame:
    """points with z of one node: by rounding half to even, by cutting off towards zero (truncate), or down (floor);
    kept within the grid.  outer: also points whose node is absent."""
    to = {"round": F.bround, "truncate": lambda c: c, "floor": F.floor}[how]
    at = lambda c, o, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), to((F.col(c) - o) / cell).cast("int")))
    return points.withColumns({"ix": at("x", x0, nx), "iy": at("y", y0, ny)}).join(nodes.select("ix", "iy", "z"), ["ix", "iy"], "left" if outer else "inner")


def sample_tiles(cells: DataFrame, key: str, sources: DataFrame, pixels: DataFrame, *, zoom: int, size: int, least: float = 0.5) -> DataFrame:
    """cells (key, lat, lon) with source and z from raster tiles (pixels: priority, source, tx, ty, px, py, z; size by
    size pixels a tile): from the first source, by priority, that covers more than least of the cells; cells that it
    doesn't cover are null, and no such source gives no rows.  Sources are a short list; a tile that is absent is no error."""
    n = float(1 << zoom)
    fx, fy = (F.col("lon") + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(F.col("lat")))) / math.pi) / 2 * n
    c = cells.withColumns({"_fx": fx, "_fy": fy}).withColumns({"tx": F.floor("_fx"), "ty": F.floor("_fy")})
    pixel = lambda f, t: F.least(F.lit(size - 1), F.greatest(F.lit(0), ((F.col(f) - F.col(t)) * size).cast("int")))
    c = c.withColumns({"px": pixel("_fx", "tx"), "py": pixel("_fy", "ty")}).drop("_fx", "_fy")
    total = cells.count()
    met = stored(c.join(pixels, ["tx", "ty", "px", "py"]).filter("z is not null and not isnan(z)").select(key, "priority", "source", "z"))
    share = met.groupBy("priority", "source").agg((F.count("*") / F.lit(max(total, 1))).alias("share"))
    best = best_source(share, least).select("priority", F.col("source").alias("best"))
    chosen = met.join(F.broadcast(best), "priority")  # one row
    return cells.join(chosen.select(key, "z"), key, "left").join(F.broadcast(best.select(F.col("best").alias("source"))))


def slope_degrees(cells: DataFrame, cell: float) -> DataFrame:
    """Adds slope from central differences, one-sided at edges; cells without a neighbour on an axis count as flat there."""

    def grad(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        b, a = (F.when(F.abs(f(along).over(w) - F.col(along)) == 1, f("z").over(w)) for f in (F.lag, F.lead))
        return F.coalesce((a - b) / (2 * cell), (a - F.col("z")) / cell, (F.col("z") - b) / cell, F.lit(0.0))

    gx, gy = grad("ix", "iy"), grad("iy", "ix")
    return cells.withColumn("slope", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))))


def neighbour_edges(cells: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) between cells side by side (4-neighbourhood); a cell's name is iy * width + ix."""
    name = (F.col("iy") * width + F.col("ix")).cast("long")
    a = cells.select("ix", "iy", name.alias("a"))
    steps = a.select("a", F.explode(F.array(F.struct((F.col("ix") + 1).alias("ix"), F.col("iy")), F.struct(F.col("ix"), (F.col("iy") + 1).alias("iy")))).alias("s")).select("a", "s.*")
    return steps.join(cells.select("ix", "iy", name.alias("b")), ["ix", "iy"]).select("a", "b")


def components(cells: DataFrame, width: int, block: int = 256, kind: str | None = None) -> DataFrame:
    """ix, iy (and kind) and component of each cell: 4-connected parts, of one kind each if a column is named, named by their
    least cell iy * width + ix.

    Blocks of block x block cells are labelled by themselves; only the parts that touch across block borders make the
    graph whose components are looked for by rounds, so its size follows the borders' length and not the area."""
    name = (F.col("iy").cast("long") * width + F.col("ix")).alias("cell")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((block, block), bool)
        i, j = pdf["iy"].to_numpy() % block, pdf["ix"].to_numpy() % block
        mask[i, j] = True
        part = kernels.label(mask)[i, j]
        pdf["own"] = pdf.groupby(part)["cell"].transform("min")
        return pdf[[*of, "ix", "iy", "cell", "own"]]

    of = [kind] if kind else []
    schema = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in of) + "ix int, iy int, cell long, own long"
    by = [*of, F.floor(F.col("ix") / block), F.floor(F.col("iy") / block)]
    own = stored(cells.select(*of, F.col("ix").cast("int"), F.col("iy").cast("int"), name).groupBy(*by).applyInPandas(label, schema))
    far = None
    for x, y in ((1, 0), (0, 1)):
        axis = "ix" if x else "iy"
        a = own.filter(F.pmod(F.col(axis), F.lit(block)) == block - 1).select(*of, (F.col("ix") + x).alias("ix"), (F.col("iy") + y).alias("iy"), F.col("own").alias("a"))
        b = own.filter(F.pmod(F.col(axis), F.lit(block)) == 0).select(*of, "ix", "iy", F.col("own").alias("b"))
        pairs = a.join(b, [*of, "ix", "iy"]).select("a", "b")
        far = pairs if far is None else far.unionByName(pairs)
    merged = graph.components(far.distinct()).select(F.col("node").alias("own"), "component")
    return own.join(merged, "own", "left").select(*of, "ix", "iy", F.coalesce("component", "own").alias("component"))


def support_distance(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Adds support: the distance in cells to the nearest known cell; null if none is known.

    Cells look within a radius that doubles for those that have found none, whatever it takes."""
    left = cells.select(F.struct("ix", "iy").alias("_c"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    right = known.select(F.struct("ix", "iy").alias("_k"), F.col("ix").cast("double").alias("r_x"), F.col("iy").cast("double").alias("r_y"))
    near = spatial.nearest(left, right, "_c", 2.0, "_k", "_k").select(F.col("_c.ix").alias("ix"), F.col("_c.iy").alias("iy"), F.col("dist").alias("support"))
    return cells.join(near, ["ix", "iy"], "left")


def gaussian(cells: DataFrame, sigma: float) -> DataFrame:
    """z of a whole grid smoothed by a Gaussian cut at four sigma, one axis after the other; beyond the edges the edge
    repeats."""
    r = int(4 * sigma + 0.5)
    weight = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    for along, across in (("ix", "iy"), ("iy", "ix")):
        w = Window.partitionBy(across).orderBy(along)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        z = F.lit(0.0)
        for o, g in zip(range(-r, r + 1), weight):
            there = F.col("z") if o == 0 else F.coalesce(F.lag("z", -o).over(w), F.first("z").over(whole)) if o < 0 else F.coalesce(F.lead("z", o).over(w), F.last("z").over(whole))
            z = z + there * (g / sum(weight))
        cells = cells.withColumn("_z", z).drop("z").withColumnRenamed("_z", "z")
    return cells


#: What a rule may ask of a cell, by name: columns and numbers in, a condition out.
RULES = {
    "everywhere": lambda: F.lit(True),
    "near_road": lambda metres, inner=0.0: (F.col("road_distance") <= metres) & (F.col("road_distance") > inner if inner > 0 else F.lit(True)),
    "in_plot": lambda: F.coalesce(F.col("in_plot"), F.lit(False)),
    "region": lambda x0, y0, x1, y1: F.col("x").between(x0, x1) & F.col("y").between(y0, y1),
    "steeper": lambda degrees: F.col("slope") >= degrees,
    "patches": lambda cut: F.col("noise") >= cut,
}


def rule(kind: str, **numbers) -> Column:
    """A rule of RULES; an unknown kind is an error."""
    if kind not in RULES:
        raise KeyError(f"no rule is called {kind!r}; there are {', '.join(RULES)}")
    return RULES[kind](**numbers)


def paint(rules: Sequence[tuple[str, Column]], palette: Sequence[str]) -> Column:
    """Painter's order: the last rule that holds names the class, the palette's first where none does.  An empty
    palette, or a rule for a class that isn't in it, is an error."""
    if not palette:
        raise ValueError("a palette needs a class")
    if unknown := {name for name, _ in rules} - set(palette):
        raise KeyError(f"not in the palette: {', '.join(sorted(unknown))}")
    base = palette[0]
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in reversed(rules)), F.lit(base))


def flatten_water(cells: DataFrame, water: DataFrame, *, bank: int, freeboard: float, depth: float, smallest: int = 1) -> DataFrame:
    """cells (ix, iy, z, dry) with ponds (water: ix, iy, component) made level: a pond's level is the least ground of
    the cells within bank of it that aren't water, less freeboard; all levels are known before any cell is lowered.
    Ponds of fewer than smallest cells, and cells that must stay dry (the carriageway), are no water.

    ix, iy, z and, for the cells that are then under the level of their pond, level."""
    allowed = water.join(cells.filter(~F.coalesce(F.col("dry"), F.lit(False))).select("ix", "iy"), ["ix", "iy"])
    large = allowed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= smallest).select("component")
    pond = allowed.join(large, "component")
    rim = F.explode(F.sequence(F.lit(-bank), F.lit(bank)))
    around = pond.select("component", "ix", "iy").withColumn("_i", rim).withColumn("_j", rim).filter(F.pow(F.col("_i"), 2) + F.pow(F.col("_j"), 2) <= bank * bank)
    around = around.select("component", (F.col("ix") + F.col("_i")).alias("ix"), (F.col("iy") + F.col("_j")).alias("iy")).distinct()
    land = cells.join(pond.select("ix", "iy"), ["ix", "iy"], "left_anti").select("ix", "iy", "z")
    level = around.join(land, ["ix", "iy"]).groupBy("component").agg((F.min("z") - freeboard).alias("level"))
    wet = pond.join(level, "component").select("ix", "iy", "level")
    out = cells.join(wet, ["ix", "iy"], "left").withColumn("_z", F.coalesce(F.least("z", F.col("level") - depth), F.col("z")))
    return out.select("ix", "iy", F.col("_z").alias("z"), F.when(F.col("_z") <= F.col("level"), F.col("level")).alias("level"))


def best_source(coverage: DataFrame, least: float = 0.5) -> DataFrame:
    """The first source, in order, that covers more than least of the cells: (source, priority, share)."""
    return coverage.filter(F.col("share") > least).orderBy("priority").limit(1)
