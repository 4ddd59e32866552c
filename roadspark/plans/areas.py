"""Queries over areas of the whole map, level by level.

SQL has no polygons: dissolved() goes over upright boxes, whose parts SQL can find, and the tests hold the others to one
union of all shapes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.operators import areas, kernels, regions
from roadspark.operators.graph import spread
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6


def turned(spark: SparkSession, d: str) -> DataFrame:
    """Turned boxes as road pieces: id, kind (their level), and ring (array of x, y)."""
    f = V.footprint(spark, d)
    t = F.radians(F.col("id") % 45)
    cx, cy, hx, hy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, (F.col("x1") - F.col("x0")) / 5, (F.col("y1") - F.col("y0")) / 5
    corner = lambda u, v: F.array(cx + F.cos(t) * hx * u - F.sin(t) * hy * v, cy + F.sin(t) * hx * u + F.cos(t) * hy * v)
    return f.select("id", (F.col("id") % 4).alias("kind"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))


@query(
    "with recursive "
    + V.FOOTPRINT
    + """, touch as (
  select a.id as a, b.id as b from footprint a join footprint b on a.mean_z = b.mean_z and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1
    and (least(a.x1, b.x1) > greatest(a.x0, b.x0) or least(a.y1, b.y1) > greatest(a.y0, b.y0))),
reach as (select a, b from touch union select r.a, e.b from reach r join touch e on r.b = e.a),
part as (select a as id, min(b) as name from reach group by a),
half as (select distinct name, x, y from (select name, y0, y1, unnest(range(x0::bigint, x1::bigint)) as x from footprint join part using (id)), unnest(range((2 * y0)::bigint, (2 * y1)::bigint)) as t(y)),
size as (select name, count(*) * 0.5 as area from half group by name)
select any_value(mean_z) as level, round(any_value(area), 6)::double as area, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from footprint join part using (id) join size using (name) group by name"""
)
def dissolved(spark: SparkSession, d: str) -> DataFrame:
    """The parts of what upright boxes of a level cover together: area and bounds."""
    f = V.footprint(spark, d)
    ring = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    return areas.dissolved(f.select(F.col("mean_z").alias("level"), ring.alias("ring")), keys=["level"]).select("level", *r6("area", "x0", "y0", "x1", "y1"))


@query()
def buildable_area(spark: SparkSession, d: str) -> DataFrame:
    """The map without its roads and 3 m beside them: the parts of more than a square metre."""
    f = V.footprint(spark, d).agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    return areas.free_ground(turned(spark, d), beside=3.0, least=1.0, extent=tuple(f) if f[0] is not None else (0.0, 0.0, 1.0, 1.0)).select(*r6("area", "x0", "y0", "x1", "y1"))


@query()
def clip_crosswalks(spark: SparkSession, d: str) -> DataFrame:
    """Crossings on the carriageway: the pieces of each, of half a square metre or more."""
    p = turned(spark, d)
    found = areas.clipped(p.filter("kind = 0"), p.filter("kind > 0"), inside=True, least=0.5)
    return found.select("id", F.posexplode("parts").alias("piece", "area")).select("id", "piece", *r6("area"))


@query()
def clip_walkways(spark: SparkSession, d: str) -> DataFrame:
    """Footways off the carriageway: what of each is left, and what was taken off."""
    p = turned(spark, d)
    found = areas.clipped(p.filter("kind = 0"), p.filter("kind > 0"), inside=False)
    return found.select("id", F.col("left").alias("kept"), (F.col("whole") - F.col("left")).alias("removed")).select("id", *r6("kept", "removed"))


@query()
def infill_roads(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of up to a metre between road pieces of a level: the patches of 0.05 to 40 square metres that fill them."""
    return areas.infill(turned(spark, d), gap=0.5, least=0.05, most=40.0, keys=["kind"]).select("kind", *r6("area", "x0", "y0", "x1", "y1"))


@query()
def carriageway_holes(spark: SparkSession, d: str) -> DataFrame:
    """Holes that road pieces surround: seams, nowhere wider than a metre, and openings."""
    return areas.holes(turned(spark, d), narrow=1.0).select("seam", *r6("area", "x0", "y0", "x1", "y1"))


@query()
def cover_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Triangles over plots with a court: as many as cover them exactly, and their area."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, ring in zip(pdf["id"], pdf["ring"]):
                r = np.array([list(p) for p in ring], float)
                court = r.mean(0) + (r - r.mean(0)) * 0.4
                t = regions.triangles(regions.union([[r, court]]))
                rows.append((int(i), len(t), float(sum(kernels.area(x) for x in t))))
            yield pd.DataFrame(rows, columns=["id", "triangles", "area"])

    # a table of plots is a file or two, so they are dealt out first
    return spread(turned(spark, d).select("id", "ring"), "id").mapInPandas(run, "id long, triangles int, area double").select("id", "triangles", *r6("area"))


@query()
def stacked_rings(spark: SparkSession, d: str) -> DataFrame:
    """Turned road pieces over one another by half a square metre or more, 4 m apart at least, and the higher of both."""
    z = V.footprint(spark, d).select("id", F.col("mean_z").alias("z"))
    return areas.stacked(turned(spark, d).join(z, "id"), gap=4.0, least=0.5).select("a", "b", *r6("area"), "higher")
