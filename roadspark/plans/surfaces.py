"""Heights of a whole grid, the ground's mesh around the roads, buildings, and roads run on to the map's edge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators import atlas, contours, extend, fences, graph, grid, massing, regions, surface
from roadspark.operators import roofs as buildings
from roadspark.operators.graph import spread
from roadspark.plans import areas
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6

#: Cells across the map of V.footprint, and metres of a cell.
NX, CELL = 46, 10.0


def _rows(spark: SparkSession, d: str) -> int:
    """Cells down the map."""
    return int(V.table(spark, d, "part").agg(F.max("p_partkey")).first()[0] or 0) // 40 + 8


def survey(spark: SparkSession, d: str, ny: int) -> DataFrame:
    """Heights at grid nodes where a supplier lives (ix, iy, z, and a ceiling 5 cm below), about one node in twenty."""
    s = V.table(spark, d, "supplier")
    ix, iy = F.col("s_suppkey") * 37 % NX, F.col("s_suppkey") * 101 % ny
    return s.groupBy(ix.cast("int").alias("ix"), iy.cast("int").alias("iy")).agg(F.min(F.col("s_acctbal") / 1000).alias("z")).withColumn("ceiling", F.col("z") - 0.05)


@query()
def solve_membrane(spark: SparkSession, d: str) -> DataFrame:
    """Every node's height by a membrane through the surveyed ones, over the whole map."""
    ny = _rows(spark, d)
    return surface.solve_grid(survey(spark, d, ny), NX, ny, order=1).select("ix", "iy", F.round("z", 6).alias("z"))


@query()
def solve_plate(spark: SparkSession, d: str) -> DataFrame:
    """The same by a thin plate under its samples, smoothed, put under them again and settled anew."""
    ny = _rows(spark, d)
    return surface.settled_grid(survey(spark, d, ny), NX, ny, order=2, smooth=0.7).select("ix", "iy", F.round("z", 6).alias("z"))


def roads(spark: SparkSession, d: str) -> DataFrame:
    """Turned boxes as lanes that climb along their length: id, ring of x, y, z."""
    at = F.col("id") % 9 / 10
    return areas.turned(spark, d).select("id", F.transform("ring", lambda p, i: F.array(p[0], p[1], at + F.when((i == 1) | (i == 2), 0.4).otherwise(0.0))).alias("ring"))


def terraces(spark: SparkSession, d: str, ny: int) -> DataFrame:
    """Platforms of 6 by 4 metres about each supplier, level with its survey: id, ring, level."""
    s = V.table(spark, d, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 1000, 2).alias("level"), (F.col("s_suppkey") * 37 % NX * CELL + 2.0).alias("x"), (F.col("s_suppkey") * 101 % ny * CELL + 3.0).alias("y"))
    ring = F.array(*(F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in ((0.0, 0.0), (6.0, 0.0), (6.0, 4.0), (0.0, 4.0))))
    return s.select(F.col("s_suppkey").alias("id"), ring.alias("ring"), "level")


def _mesh(spark: SparkSession, d: str) -> DataFrame:
    ny = _rows(spark, d)
    nodes = surface.solve_grid(survey(spark, d, ny), NX, ny, order=1)
    return surface.ground_mesh(nodes, roads(spark, d), cell=CELL, steps=terraces(spark, d, ny))


@query()
def ground_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Faces of the ground around all roads, with terraces and their walls: size in plan, corners, lowest and highest."""
    z = F.transform("corners", lambda c: c["z"])
    return _mesh(spark, d).select("ix", "iy", "kind", F.size("corners").alias("n"), F.round(surface.plan_area(), 6).alias("area"), F.round(F.array_min(z), 6).alias("low"), F.round(F.array_max(z), 6).alias("high"))


@query()
def ground_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the same mesh, each once, with the cells it is in and how far these disagree about its height."""
    return surface.vertices(_mesh(spark, d)).select("kx", "ky", "level", F.round("z", 6).alias("z"), "cells", F.round("spread", 9).alias("spread"))


@query(
    V.with_(V.FOOTPRINT)
    + """, covered as (select distinct x::bigint as x, y::bigint as y from (select unnest(range(x0::bigint, x1::bigint)) as x, y0, y1 from footprint), unnest(range((2 * y0)::bigint, (2 * y1)::bigint)) as t(y)),
busy as (select x // 10 as ix, y // 20 as iy, count(*) * 0.5 as size from covered group by 1, 2),
cell as (select ix, iy from range(0, 45) a(ix), range(0, (select coalesce(max(p_partkey), 0) // 40 + 7 from part)) b(iy))
select ix::int as ix, iy::int as iy, round(100 - coalesce(size, 0), 6)::double as area from cell left join busy using (ix, iy) where coalesce(size, 0) < 100"""
)
def ground_left(spark: SparkSession, d: str) -> DataFrame:
    """How much ground the mesh has in each cell, between upright boxes as roads."""
    ny = _rows(spark, d)
    nodes = spark.range(NX * ny).select((F.col("id") % NX).cast("int").alias("ix"), F.expr(f"cast(id div {NX} as int)").alias("iy"), F.lit(0.0).alias("z"))
    box = F.array(*(F.array(F.col(x), F.col(y), F.col("mean_z")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    mesh = surface.ground_mesh(nodes, V.footprint(spark, d).select("id", box.alias("ring")), cell=CELL, gap=0.0)
    return mesh.withColumn("area", surface.plan_area()).groupBy("ix", "iy").agg(F.sum("area").alias("area")).select("ix", "iy", *r6("area"))


# ---------------------------------------------------------------- buildings


def houses(spark: SparkSession, d: str) -> DataFrame:
    """Upright and turned rectangles as buildings: id, rings, base, height and a form of roof."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    a, b, t = F.col("p_size") + 8.0, F.col("p_size") % 11 + 5.0, F.radians(F.col("id") % 180)
    corner = lambda u, v: F.array(F.cos(t) * u - F.sin(t) * v, F.sin(t) * u + F.cos(t) * v)
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(a, F.lit(0.0)), corner(a, b), corner(F.lit(0.0), b))
    form = F.element_at(F.array(*map(F.lit, buildings.FORMS)), (F.col("id") % 4 + 1).cast("int"))
    return p.select("id", F.array(ring).alias("rings"), F.lit(0.0).alias("base"), (F.col("p_size") % 9 * 3.5 + 3.5).alias("height"), form.alias("form"))


@query(
    """with h as (
  select p_partkey as id, greatest(p_size + 8.0::double, p_size % 11 + 5.0::double) as l, least(p_size + 8.0::double, p_size % 11 + 5.0::double) as w,
    p_size % 9 * 3.5::double + 3.5 as top, p_partkey % 4 as form, case p_partkey % 4 when 0 then 0.0 when 3 then 0.225 else 0.45 end::double as s from part)
select id, round(case when form = 0 then l * w else (l + 1) * (w + 1) * sqrt(1 + s * s) end, 4) as roof_area,
  round(case form when 1 then 0.45 * w * w / 2 when 3 then 0.225 * w * (l + w) else 0 end, 4)::double as gable_area,
  round(2 * (l + w) * (top + 1), 4) as wall_area,
  round(top - s * 0.5, 6) as low, round(top + case when form = 3 then s * (w + 0.5) else s * w / 2 end, 6) as high
from h"""
)
def roof_measures(spark: SparkSession, d: str) -> DataFrame:
    """Of each building the area of its roof, of the walls that close it and of those below, and the roof's ends."""
    xyz = lambda q: [q[c] for c in "xyz"]
    n = F.size("corners")

    def doubled(axis: int):
        """Twice the face's area in the plane across an axis: the sum of its sides' cross products."""
        i, j = [(1, 2), (2, 0), (0, 1)][axis]
        at = lambda k: F.element_at("corners", F.when(k + 2 > n, 1).otherwise(k + 2).cast("int"))
        return F.aggregate(F.transform("corners", lambda p, k: xyz(p)[i] * xyz(at(k))[j] - xyz(at(k))[i] * xyz(p)[j]), F.lit(0.0), lambda a, v: a + v)

    area = F.sqrt(sum((doubled(k) * doubled(k) for k in range(3)), F.lit(0.0))) / 2
    z = F.transform("corners", lambda p: p["z"])
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("area"))), F.lit(0.0)), 4).alias(f"{kind}_area")
    ends = [F.round(g(F.when(F.col("kind") == "roof", F.col(c))), 6).alias(c) for g, c in ((F.min, "low"), (F.max, "high"))]

    def measured(h: DataFrame) -> DataFrame:
        f = buildings.buildings(h, "id").select("id", "kind", area.alias("area"), F.array_min(z).alias("low"), F.array_max(z).alias("high"))
        return f.groupBy("id").agg(of("roof"), of("gable"), of("wall"), *ends)

    return graph.each_form(houses(spark, d), "id", measured)


@query()
def building_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of buildings on uneven plots, with a plinth: corners, and the sheet's width and height on each."""
    from roadspark.plans.shapes import plots

    h = houses(spark, d).drop("rings").join(plots(spark, d).select("id", F.array("ring").alias("rings")), "id")
    u, v = F.transform("corners", lambda p: p["u"]), F.transform("corners", lambda p: p["v"])
    sheet = [F.round(F.array_max(c) - F.array_min(c), 6).alias(n) for c, n in ((u, "sheet_width"), (v, "sheet_height"))]
    faces = lambda h: buildings.buildings(h, "id", plinth=0.35).select("id", "kind", "face", F.size("corners").alias("n"), *sheet)
    return graph.each_form(h, "id", faces)


# ---------------------------------------------------------------- roads run on


def _edge(spark: SparkSession, d: str, shapes: DataFrame, margin: float) -> DataFrame:
    """One row: the map's edge, a margin around all rings (ring: array of x, y)."""
    at = lambda axis: F.transform("ring", lambda p: p[axis])
    return shapes.agg(*((g(h(at(k))) + by).alias(n) for n, g, h, k, by in (("x0", F.min, F.array_min, 0, -margin), ("y0", F.min, F.array_min, 1, -margin), ("x1", F.max, F.array_max, 0, margin), ("y1", F.max, F.array_max, 1, margin))))


@query(
    V.with_(V.FOOTPRINT)
    + """, s as (select id, x1, y0, y1, (select max(x1) from footprint) + 30 - x1 as way from footprint),
hit as (
  select s.id, min(greatest(0, f.x0 - s.x1)) as obstacle from s join footprint f
  on f.id <> s.id and greatest(0, least(f.x1, s.x1 + way) - greatest(f.x0, s.x1)) * greatest(0, least(f.y1, s.y1) - greatest(f.y0, s.y0)) > 0.05 group by s.id)
select id, round(way, 6) as way, round(obstacle, 6) as obstacle,
  round(case when way < 2 then 0 when obstacle is null then way when least(way, obstacle - 1.5) < 2 then 0 else least(way, obstacle - 1.5) end, 6)::double as length
from s left join hit using (id)"""
)
def blocked_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Lanes that end to the east: how far it is to the map's edge, what is in the way, and how far they may go on."""
    f = V.footprint(spark, d)
    ring = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    rings = f.select("id", ring.alias("ring"))
    ends = f.crossJoin(F.broadcast(_edge(spark, d, rings, 30.0).select(F.col("x1").alias("edge"))))
    stubs = ends.select("id", F.col("x1").alias("lx"), F.col("y1").alias("ly"), F.col("x1").alias("rx"), F.col("y0").alias("ry"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), (F.col("edge") - F.col("x1")).alias("limit"))
    got = extend.blocked(stubs, rings, ["id"], "id")
    return got.select("id", F.col("limit").alias("way"), "obstacle", C.reach(F.col("limit"), F.col("obstacle"), clearance=1.5, least=2.0).alias("length")).select("id", *r6("way", "obstacle", "length"))


@query()
def extensions(spark: SparkSession, d: str) -> DataFrame:
    """Turned lanes, both ends: those that leave the survey within 60 m are run on to the map's edge, in order, each short of
    what is there and of what was granted before."""
    rings = areas.turned(spark, d).select("id", "ring")
    p = lambda k, axis: F.element_at(F.element_at("ring", k + 1), axis + 1)
    ends = []
    for side, left, right, far in (("end", 2, 1, 3), ("start", 0, 3, 1)):
        dx, dy = p(left, 0) - p(far, 0), p(left, 1) - p(far, 1)
        n = F.sqrt(dx * dx + dy * dy)
        ends.append(rings.select("id", F.lit(side).alias("side"), *(p(k, a).alias(f"{s}{c}") for s, k in (("l", left), ("r", right)) for a, c in enumerate("xy")), (dx / n).alias("dx"), (dy / n).alias("dy")))
    edge = _edge(spark, d, rings, 30.0)
    stubs = ends[0].unionByName(ends[1]).crossJoin(F.broadcast(edge))
    stubs = stubs.withColumn("limit", C.ray_to_box((F.col("lx") + F.col("rx")) / 2, (F.col("ly") + F.col("ry")) / 2, *(F.col(c) for c in ("dx", "dy", "x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1")
    out = extend.leaves(stubs, extend.outline(rings), margin=30.0, within=60.0).filter("leaves").drop("leaves")
    return extend.granted(out, rings, ["id", "side"], "id", clearance=1.5, least=2.0).select("id", "side", *r6("length"))


# ---------------------------------------------------------------- outlines


@query(
    "with recursive "
    + V.FOOTPRINT
    + """, cells as (select distinct mean_z::int as level, floor((x0 + x1) / 20)::bigint as ix, floor((y0 + y1) / 20)::bigint as iy from footprint),
side as (select * from (values (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 1, 1, 1, 0), (2, 1, 1, 0, 1, 0, 1), (3, 0, 1, 0, 0, -1, 0)) t(dir, dx, dy, ex, ey, nx, ny)),
edge as (
  select row_number() over (order by c.level, c.ix, c.iy, dir) as id, c.level, dir, c.ix + dx as x, c.iy + dy as y, c.ix + ex as x2, c.iy + ey as y2
  from cells c, side where not exists (select 1 from cells n where n.level = c.level and n.ix = c.ix + nx and n.iy = c.iy + ny)),
succ as (select a.id, arg_min(b.id, case (b.dir - a.dir + 4) % 4 when 1 then 0 when 0 then 1 else 2 end) as next from edge a join edge b on a.level = b.level and a.x2 = b.x and a.y2 = b.y group by a.id),
reach as (select id as a, next as b from succ union select r.a, s.next from reach r join succ s on r.b = s.id),
ring as (select a as id, min(b) as ring from reach group by a)
select any_value(level) as level, (sum(x * y2 - x2 * y) * 50)::double as area, (count(*) * 10)::double as length from edge join ring using (id) group by ring"""
)
def level_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The rings around each level's cells: area, negative around holes, and length."""
    f = V.footprint(spark, d)
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 20)
    cells = f.select(F.col("mean_z").cast("int").alias("level"), at("x0", "x1").alias("ix"), at("y0", "y1").alias("iy"))
    rings = contours.measures(contours.cell_outlines(cells, cell=CELL, keys=["level"]), ["level"])
    return rings.select("level", *r6("area", "length"))


def _ponds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Cells of ponds (body, ix, iy) that stand where the surveyed ground is below 1 m, the ground, and the cells down the map."""
    ny = _rows(spark, d)
    ground = surface.stored(surface.solve_grid(survey(spark, d, ny), NX, ny, order=1))
    return grid.components(ground.filter("z < 1"), NX).withColumnRenamed("component", "body"), ground, ny


@query()
def pond_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Shores of the ponds, each of cells that join, rounded off: body, area, length."""
    rings = contours.measures(contours.cell_outlines(_ponds(spark, d)[0], cell=CELL, keys=["body"], rounded=True), ["body"])
    return rings.select("body", *r6("area", "length"))


@query()
def pond_railings(spark: SparkSession, d: str) -> DataFrame:
    """Railings on the banks of all ponds, off the roads: rails of each pond, and their metres."""
    cells, ground, ny = _ponds(spark, d)
    x, y = F.col("ix") * CELL, F.col("iy") * CELL
    ring = F.array(F.array(x, y), F.array(x + CELL, y), F.array(x + CELL, y + CELL), F.array(x, y + CELL))
    rims = fences.banks(cells.select("body", ring.alias("ring"), F.lit(0.8).alias("level")), ground, NX, ny, cell=CELL, step=2.0, reach=10.0)
    rails = fences.railings(rims, areas.turned(spark, d))
    return rails.groupBy("body").agg(F.count_distinct("ring", "rail").alias("rails"), F.sum("length").alias("length")).select("body", "rails", *r6("length"))


# ---------------------------------------------------------------- masses


def _lots(spark: SparkSession, d: str) -> DataFrame:
    return houses(spark, d).select("id", F.col("rings")[0].alias("ring"), "base", "height")


@query(
    """with u as (
  select p_partkey as id, greatest(p_size + 8.0::double, p_size % 11 + 5.0::double) * least(p_size + 8.0::double, p_size % 11 + 5.0::double) as size, """
    + ", ".join(f"('0x' || substr(md5('3-' || p_partkey || '-{n}'), 1, 8))::bigint / 4294967296.0::double as {n}" for n in ("wall", "depth", "wing", "form", "pitch", "parapet"))
    + """ from part),
g as (select *, case when wall < 0.55 then size * (1 - 0.22::double * (0.7 + 0.6 * depth)) else size end as rest, ['flat', 'flat', 'gable', 'hip', 'mono'][floor(form * 5)::int + 1] as roof from u)
select id, roof as form, round(0.35::double + 0.3 * pitch, 6) as pitch, round(case when wing < 0.45 then rest * 0.62 else rest end, 4)::double as main_area,
  round(case when wing < 0.45 then rest * 0.38 else 0 end, 4)::double as wing_area, roof = 'flat' and parapet < 0.7 as parapet from g"""
)
def massing_measures(spark: SparkSession, d: str) -> DataFrame:
    """What is drawn for each plot, and how large the main part and the wing are, without courts."""
    parts = massing.masses(_lots(spark, d), "id", massing.Options(courtyard=0.0), seed=3)
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("area"))), F.lit(0.0)), 4).alias(f"{kind}_area")
    main = lambda c: F.max(F.when(F.col("part") == 0, F.col(c)))
    return parts.groupBy("id").agg(main("form").alias("form"), F.round(main("pitch"), 6).alias("pitch"), of("main"), of("wing"), F.bool_or(F.col("kind") == "parapet").alias("parapet"))


@query(
    """with u as (
  select p_partkey as id, greatest(p_size + 8.0::double, p_size % 11 + 5.0::double) * least(p_size + 8.0::double, p_size % 11 + 5.0::double) as size, """
    + ", ".join(f"('0x' || substr(md5('3-' || p_partkey || '-{n}'), 1, 8))::bigint / 4294967296.0::double as {n}" for n in ("wall", "depth", "wing"))
    + """ from part),
g as (select id, case when wall < 0.55 then size * (1 - 0.22::double * (0.7 + 0.6 * depth)) else size end * case when wing < 0.45 then 0.62 else 1 end as main from u)
select id, round(main, 4)::double as whole, round(main * 0.6, 3)::double as built from g"""
)
def inset_parts(spark: SparkSession, d: str) -> DataFrame:
    """The main part of each building drawn in until it covers 60 % of its ground."""
    parts = massing.masses(_lots(spark, d), "id", massing.Options(courtyard=0.0), seed=3).filter("part = 0")

    def run(batches):
        for pdf in batches:
            rings = [[np.array([list(p) for p in g], float) for g in r] for r in pdf["rings"]]
            built = [regions.area(regions.union(regions.inset_to_share(r, 0.6))) for r in rings]
            yield pd.DataFrame({"id": pdf["id"], "whole": pdf["area"], "built": built})

    return spread(parts.select("id", "area", "rings"), "id").mapInPandas(run, "id long, whole double, built double").select("id", F.round("whole", 4).alias("whole"), F.round("built", 3).alias("built"))


@query()
def massing_parts(spark: SparkSession, d: str) -> DataFrame:
    """All parts of the buildings on uneven plots, with courts: where they begin and end, and their faces."""
    from roadspark.plans.shapes import plots

    lots = _lots(spark, d).drop("ring").join(plots(spark, d).select("id", "ring"), "id")
    found = surface.stored(massing.masses(lots, "id", seed=3))
    faces = massing.face_counts(found, "id").filter("faces > 0")
    return found.join(faces, ["id", "part"], "left").select("id", "part", "kind", *r6("area", "bottom", "top"), F.size("rings").alias("rings"), "faces")


# ---------------------------------------------------------------- painted lanes


def _atlas(spark: SparkSession, d: str) -> atlas.Atlas:
    """Turned boxes as lanes, each with a stop line near its beginning and a lane line along its middle; a sheet for each tile
    of 200 m."""
    t = surface.stored(areas.turned(spark, d))  # its corners are named often
    p = lambda k, axis: F.element_at(F.element_at("ring", k + 1), axis + 1)
    ends = F.array(*(F.struct(F.lit(seq).alias("seq"), *(p(k, a).alias(f"{s}{c}") for s, k in (("l", left), ("r", right)) for a, c in enumerate("xy"))) for seq, left, right in ((0, 3, 0), (1, 2, 1))))
    lanes = t.select(F.col("id").alias("lane"), F.when(F.col("kind") == 0, "Junctions").otherwise("Roads").alias("kind"), atlas.by_tile(p(0, 0), p(0, 1), 200.0).alias("sheet"), F.explode(ends).alias("e"))
    lanes = lanes.select("lane", "e.*", F.lit(0.0).alias("lz"), F.lit(0.0).alias("rz"), "kind", "sheet")
    # a place in the box: so far along, so far across
    at = lambda u, v, axis: p(0, axis) + (p(1, axis) - p(0, axis)) * u + (p(3, axis) - p(0, axis)) * v
    quad = lambda u0, u1, v0, v1: F.array(*(F.array(at(u, v, 0), at(u, v, 1)) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))))
    paint = t.select((F.col("id") * 2).alias("id"), F.lit("StopLines").alias("grp"), quad(0.1, 0.16, 0.0, 1.0).alias("ring")).unionByName(
        t.select((F.col("id") * 2 + 1).alias("id"), F.lit("LaneMarkings").alias("grp"), quad(0.2, 0.9, 0.46, 0.54).alias("ring"))
    )
    return atlas.Atlas(lanes, paint, texel=0.25, step=16, page=256, samples=2)


@query()
def bake_strips(spark: SparkSession, d: str) -> DataFrame:
    """Where each lane's strip lies in the atlas, and how many of its texels are paint."""
    return _atlas(spark, d).strips().select("lane", "sheet", "page", "px", "py", "w", "h", F.round("coverage", 3).alias("coverage"))


@query()
def bake_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of all sheets: strips on each and texels of paint."""
    a = _atlas(spark, d)
    return a.pages(a.strips()).select("sheet", "page", "strips", F.round("coverage", 3).alias("coverage"))


@query()
def baked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Painted groups, and how many of their shapes lie on a strip."""
    return _atlas(spark, d).emptied()
