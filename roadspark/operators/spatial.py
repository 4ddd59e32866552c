"""Spatial joins by cell keys.

Spark has no range join: a condition on coordinates alone is planned as a nested loop.  Here both sides name the
grid cells that they may meet in, and an equi-join on the cell, with the exact condition behind it, does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.operators import graph
from roadspark.operators.graph import stored


def cells_of_box(df: DataFrame, cell: float) -> DataFrame:
    """df (x0, y0, x1, y1) with a row for each cell (cx, cy) that the box touches.

    No plan knows how many those are, or how large a shape made of two numbers is, so joins with them are sort-merge
    joins: a broadcast would take the map through the driver."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return df.hint("merge").withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def overlapping_boxes(df: DataFrame, cell: float, residual: Column) -> DataFrame:
    """Pairs (a_*, b_*), a_id < b_id, of overlapping boxes (id, x0, y0, x1, y1, …) that meet the residual.

    A pair is kept in one cell alone, the one of the overlap's lower corner, so no distinct is needed.
    """
    own = cells_of_box(df, cell)
    a, b = (own.select("cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for p in "ab")
    j = a.join(b, ["cx", "cy"]).filter("a_id < b_id and a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    low = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    return j.filter(low & residual).drop("cx", "cy")


def touching_boxes(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs (a_*, b_*) of left and right boxes (id, x0, y0, x1, y1, …) that meet, if only in a point; each pair in the
    cell of the overlap's lower corner alone."""
    a, b = (cells_of_box(df, cell).select("cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for df, p in ((left, "a"), (right, "b")))
    j = a.join(b, ["cx", "cy"]).filter("a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    low = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    return j.filter(low).drop("cx", "cy")


def ring_size(ring: Column) -> Column:
    """The area of a ring (array of structs x, y without a closing point), whichever way it runs."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, c: s + c)) / 2


def behind_frontage(ring: Column, tx: Column, ty: Column, depth: Column) -> Column:
    """A convex ring without a strip of a depth, but at most a third of its own, on the side that a unit vector points
    to; the ring itself for a depth of 0."""
    along = F.transform(ring, lambda p: p["x"] * tx + p["y"] * ty)
    cut = F.array_max(along) - F.least(depth, (F.array_max(along) - F.array_min(along)) / 3)
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def kept(p: Column, q: Column) -> Column:
        a, b = p["x"] * tx + p["y"] * ty, q["x"] * tx + q["y"] * ty
        t = (cut - a) / F.nullif(b - a, F.lit(0.0))
        cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        own = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        return F.when((a <= cut) & (b <= cut), F.array(own)).when(a <= cut, F.array(own, cross)).when(b <= cut, F.array(cross)).otherwise(F.slice(F.array(own), 1, 0))

    return F.when(depth <= 0, ring).otherwise(F.flatten(F.zip_with(ring, turned, kept)))


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left and right points (x, y; r_x, r_y) within radius, with dist."""
    near = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    l = left.hint("merge").withColumn("_i", near).withColumn("_j", near).withColumn("cx", F.floor(F.col("x") / radius) + F.col("_i")).withColumn("cy", F.floor(F.col("y") / radius) + F.col("_j")).drop("_i", "_j")
    r = right.withColumn("cx", F.floor(F.col("r_x") / radius)).withColumn("cy", F.floor(F.col("r_y") / radius))
    d = F.sqrt(F.pow(F.col("x") - F.col("r_x"), 2) + F.pow(F.col("y") - F.col("r_y"), 2))
    return l.join(r, ["cx", "cy"]).withColumn("dist", d).filter(F.col("dist") <= radius).drop("cx", "cy")


def nearest_within(left: DataFrame, right: DataFrame, key: str, radius: float, value: str, tie: str) -> DataFrame:
    """For each left point (key, x, y) that has one within radius, the value of the nearest right point."""
    return within(left, right, radius).groupBy(key).agg(F.min_by(value, F.struct("dist", tie)).alias(value), F.min("dist").alias("dist"))


def nearest(left: DataFrame, right: DataFrame, key: str, radius: float, value: str, tie: str) -> DataFrame:
    """The same for every left point, if there is any right one: the radius doubles for those that have found none
    yet.  Each round's finds are a written table, so no plan grows with the rounds."""
    left, right = stored(left), stored(right)
    found, rest = None, left
    while True:
        hit = stored(nearest_within(rest, right, key, radius, value, tie))
        found = hit if found is None else found.unionByName(hit)
        rest = stored(rest.join(hit.select(key), key, "left_anti"))
        if rest.isEmpty() or right.isEmpty():
            return found
        radius *= 2


def k_nearest(left: DataFrame, right: DataFrame, key: str, k: int, radius: float) -> DataFrame:
    """Pairs of each left point with its k nearest right points (all, if there are fewer), with dist; ties by r_key."""
    left, right = stored(left), stored(right)
    want = min(k, right.limit(k).count())
    found, rest = None, left
    while True:
        near = within(rest, right, radius)
        rank = F.row_number().over(Window.partitionBy(key).orderBy("dist", "r_key"))
        full = stored(near.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_r", rank).filter((F.col("_n") >= want) & (F.col("_r") <= want)).drop("_n", "_r"))
        found = full if found is None else found.unionByName(full)
        rest = stored(rest.join(full.select(key).distinct(), key, "left_anti"))
        if not want or rest.isEmpty():
            return found
        radius *= 2


def segment_distance(px: str, py: str, prefix: str = "") -> tuple[Column, Column]:
    """Distance of a point from the segment (x, y)-(x2, y2), and how far along (0 to 1) its foot is."""
    x, y, x2, y2 = (F.col(prefix + c) for c in ("x", "y", "x2", "y2"))
    dx, dy = x2 - x, y2 - y
    t = F.coalesce(F.try_divide((F.col(px) - x) * dx + (F.col(py) - y) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(F.col(px) - (x + t * dx), 2) + F.pow(F.col(py) - (y + t * dy), 2)), t


def nearest_segment(points: DataFrame, lines: DataFrame, key: str, radius: float) -> DataFrame:
    """key, dist and height of each point (key, px, py) on the nearest of all segments (x, y, z, x2, y2, z2): the
    height there, the least of equally near ones.  A segment is listed in the cells that come within radius of it; the
    radius doubles for points that have found none.  Points in one place are one point."""
    return graph.each_form(points.select(key, "px", "py"), key, lambda p: _nearest_segment(p, lines, key, radius))


def _nearest_segment(points: DataFrame, lines: DataFrame, key: str, radius: float) -> DataFrame:
    points, lines = stored(points), stored(lines)
    dist, t = segment_distance("px", "py")
    found, rest = None, points
    while True:
        box = lines.withColumns({"x0": F.least("x", "x2") - radius, "x1": F.greatest("x", "x2") + radius, "y0": F.least("y", "y2") - radius, "y1": F.greatest("y", "y2") + radius})
        own = rest.withColumns({"cx": F.floor(F.col("px") / radius), "cy": F.floor(F.col("py") / radius)})
        cells = cells_of_box(box, radius).drop("x0", "x1", "y0", "y1")
        # the pairs are met twice, for the least distance and for the heights there: numbers alone are added up as they
        # come, where a least pair of both would have all pairs sorted on disk
        near = own.join(cells, ["cx", "cy"]).select(key, F.round(dist, 9).alias("dist")).filter(F.col("dist") <= radius)
        least = stored(near.groupBy(key).agg(F.min("dist").alias("least")))
        there = own.join(least, key).join(cells, ["cx", "cy"]).filter(F.round(dist, 9) == F.col("least"))
        hit = stored(there.select(key, F.col("least").alias("dist"), (F.col("z") + t * (F.col("z2") - F.col("z"))).alias("h")).groupBy(key, "dist").agg(F.min("h").alias("height")))
        found = hit if found is None else found.unionByName(hit)
        rest = stored(rest.join(hit.select(key), key, "left_anti"))
        if rest.isEmpty() or lines.isEmpty():
            return found
        radius *= 2


def crossings(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array of structs x, y without a closing point): an odd number of edges above."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    above = F.zip_with(ring, turned, lambda a, b: ((a["x"] > px) != (b["x"] > px)) & (py < (b["y"] - a["y"]) * (px - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) + a["y"]))
    return F.size(F.filter(above, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def inside_polygons(points: DataFrame, polygons: DataFrame, key: str, shape: str, cell: float) -> DataFrame:
    """Pairs (key, shape) of points (px, py) in polygons (shape, ring): a point meets the polygons whose box shares its
    cell, and counts the edges of each ring above it, so nothing is shuffled but points and rings by cell."""
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = polygons.withColumns({"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)})
    p = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    near = p.join(cells_of_box(box.select(shape, "ring", "x0", "x1", "y0", "y1"), cell), ["cx", "cy"])
    return near.filter("px between x0 and x1 and py between y0 and y1").filter(crossings(F.col("px"), F.col("py"), F.col("ring"))).select(key, shape)
