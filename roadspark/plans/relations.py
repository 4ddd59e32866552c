"""Queries over graphs, boxes, grids, ledgers and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators import graph, grid, mesh, reports, spatial
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6

# ---------------------------------------------------------------- graphs


@query(
    V.with_(V.ENDS)
    + """, t as (select lane_id, s as k from ends union select lane_id, e from ends)
select distinct a.lane_id as a, b.lane_id as b from t a join t b on a.k = b.k where a.lane_id <> b.lane_id"""
)
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(V.ends(spark, d))


@query(V.with_(V.ENDS) + "select a.lane_id, b.lane_id as next_id from ends a left join ends b on a.e = b.s and a.lane_id <> b.lane_id")
def successors(spark: SparkSession, d: str) -> DataFrame:
    return graph.successors(V.ends(spark, d))


@query(
    V.with_(V.ENDS)
    + """select lane_id, 'end' as side from ends where e not in (select s from ends) union all select lane_id, 'start' as side from ends where s not in (select e from ends)"""
)
def dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(V.ends(spark, d))


@query(
    V.with_(V.ENDS)
    + """, att as (select distinct s as point from ends where lane_id % 3 = 0)
select lane_id from ends where s not in (select point from att) and e not in (select point from att)"""
)
def pinned(spark: SparkSession, d: str) -> DataFrame:
    e = V.ends(spark, d)
    return graph.unpinned(e.select("lane_id", F.array("s", "e").alias("points")), e.filter("lane_id % 3 = 0").select(F.col("s").alias("point"))).select("lane_id")


_NODE = "node as (select id, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y, mean_z as z from footprint)"
_LINK = "link as (select id as a, id + 1 as b from node union select id + 1, id from node union select id as a, id + 40 as b from node union select id + 40, id from node)"


def _growth(rounds: int = 8) -> str:
    """The rounds of growth, each a whole search under a guard that is made of what the one before has left."""
    parts = ["r0 as (select id from node where z >= 8)"]
    for k in range(rounds):
        parts += [
            f"g{k} as (select * from node where id not in (select id from r{k}))",
            f"v{k} as (select a.id, any_value(a.z) as z, quantile_cont(b.z, 0.1) as level from g{k} a join g{k} b on sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 25 group by a.id)",
            f"ok{k} as (select id from v{k} where z - level >= 3 and (select count(*) from g{k}) >= 3)",
            f"r{k + 1} as (select id from r{k} union select b from r{k + 1} r join link on link.a = r.id join ok{k} o on o.id = link.b)",
        ]
    return ", ".join(parts)


@query("with recursive " + V.FOOTPRINT + ", " + _NODE + ", " + _LINK + ", " + _growth() + " select id from r8")
def grow_elevated(spark: SparkSession, d: str) -> DataFrame:
    """From the highest footprints over their neighbours, through those 3 m or more above the street beside them."""
    n = _centres(spark, d).withColumnRenamed("mean_z", "z")
    steps = F.array(*(F.struct(a.alias("a"), b.alias("b")) for k in (1, 40) for a, b in ((F.col("id"), F.col("id") + k), (F.col("id") + k, F.col("id")))))
    e = n.select(F.explode(steps).alias("x")).select("x.*").distinct()
    return graph.grow(n, e, n.filter("z >= 8"), graph.above_street(n, clearance=3.0, radius=25.0))


_WET = """cell as (select (p_partkey % 60)::int as ix, (p_partkey // 60)::int as iy, p_size from part), wet as (select ix, iy, iy * 60 + ix as id from cell where p_size % 5 < 3)"""


@query(
    "with recursive "
    + _WET
    + """, edge as (select a.id as a, b.id as b from wet a join wet b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
r as (select id as node, id as c from wet union select e.b, r.c from r join edge e on e.a = r.node where r.c < e.b)
select node::bigint as node, min(c)::bigint as component from r where node in (select a from edge) group by node"""
)
def components(spark: SparkSession, d: str) -> DataFrame:
    cells = V.table(spark, d, "part").filter("p_size % 5 < 3").select((F.col("p_partkey") % 60).cast("int").alias("ix"), F.expr("p_partkey div 60").cast("int").alias("iy"))
    parts = grid.components(cells, 60, 64).withColumn("node", F.col("iy").cast("long") * 60 + F.col("ix"))
    alone = parts.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return parts.join(alone, "component").select("node", "component")


# ---------------------------------------------------------------- spatial joins


@query(
    V.with_(V.FOOTPRINT)
    + """select a.id as a_id, b.id as b_id from footprint a join footprint b on a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
where abs(a.mean_z - b.mean_z) >= 4"""
)
def stacked_bbox(spark: SparkSession, d: str) -> DataFrame:
    return spatial.overlapping_boxes(V.footprint(spark, d), 30.0, F.abs(F.col("a_mean_z") - F.col("b_mean_z")) >= 4).select("a_id", "b_id")


@query(
    V.with_(V.FOOTPRINT)
    + """select distinct case when a.mean_z > b.mean_z then a.id else b.id end as id from footprint a join footprint b on a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
where abs(a.mean_z - b.mean_z) >= 4 and (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 4"""
)
def stacked_higher(spark: SparkSession, d: str) -> DataFrame:
    """The higher of each two boxes that lie over one another by 4 square metres at least."""
    p = _stacked(spark, d).filter("area >= 4")
    return p.select(F.when(F.col("a_mean_z") > F.col("b_mean_z"), F.col("a_id")).otherwise(F.col("b_id")).alias("id")).distinct()


def _stacked(spark: SparkSession, d: str) -> DataFrame:
    area = (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) * (F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    return spatial.overlapping_boxes(V.footprint(spark, d), 30.0, F.abs(F.col("a_mean_z") - F.col("b_mean_z")) >= 4).withColumn("area", area)


@query(
    V.with_(V.FOOTPRINT)
    + """, p as (select a.id as a_id, b.id as b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as area
from footprint a join footprint b on a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1 where abs(a.mean_z - b.mean_z) >= 4)
select a_id, b_id, round(area, 6) as area from p where area >= 4"""
)
def stacked_area(spark: SparkSession, d: str) -> DataFrame:
    """Boxes over one another by their common area."""
    return _stacked(spark, d).filter("area >= 4").select("a_id", "b_id", *r6("area"))


_CENTRE = """centre as (select id, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y, mean_z from footprint)"""


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return V.footprint(spark, d).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "mean_z")


@query(
    V.with_(V.FOOTPRINT, _CENTRE)
    + """, p as (select a.id, b.id as r_key, b.mean_z, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as dist from centre a join centre b on a.mean_z >= 7 and b.mean_z < 1),
q as (select *, row_number() over (partition by id order by dist, r_key) as r, min(dist) over (partition by id) as least from p)
select id, round(quantile_cont(mean_z, 0.1), 6) as level, count(*) as near from q where dist <= 25 or (least > 25 and r <= 5) group by id"""
)
def street_level(spark: SparkSession, d: str) -> DataFrame:
    """Low ground beside high boxes: the tenth percentile within 25 m, or of the five nearest where there is none."""
    c = _centres(spark, d)
    high = c.filter("mean_z >= 7").select("id", "x", "y")
    low = c.filter("mean_z < 1").select(F.col("id").alias("r_key"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), F.col("mean_z").alias("r_z"))
    near = spatial.within(high, low, 25.0)
    far = spatial.k_nearest(high.join(near.select("id").distinct(), "id", "left_anti"), low, "id", 5, 50.0)
    return near.unionByName(far).groupBy("id").agg(F.round(F.percentile("r_z", 0.1), 6).alias("level"), F.count("*").alias("near"))


@query(
    V.with_(V.FOOTPRINT, _CENTRE)
    + """, p as (select a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as dist, b.id as other, b.mean_z from centre a join centre b on a.mean_z >= 8 and b.mean_z < 1)
select id, arg_min(mean_z, (dist, other)) as mean_z, round(min(dist), 6) as dist from p group by id"""
)
def nearest_height(spark: SparkSession, d: str) -> DataFrame:
    c = _centres(spark, d)
    r = c.filter("mean_z < 1").select(F.col("id").alias("other"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), "mean_z")
    return spatial.nearest(c.filter("mean_z >= 8").select("id", "x", "y"), r, "id", 25.0, "mean_z", "other").select("id", "mean_z", *r6("dist"))


_KERB = """seg2 as (select line_id, x, y, z, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2 from vertex window w as (partition by line_id order by seq)),
pts as (select event_id, x + 1.5 as px, y + 2.0 as py from vertex),
t as (select p.event_id, s.*, px, py, greatest(0, least(1, coalesce(((px - s.x) * (x2 - s.x) + (py - s.y) * (y2 - s.y)) / nullif(pow(x2 - s.x, 2) + pow(y2 - s.y, 2), 0), 0))) as t from pts p join seg2 s on x2 is not null),
u as (select event_id, round(sqrt(pow(px - (x + t * (x2 - x)), 2) + pow(py - (y + t * (y2 - y)), 2)), 9) as dist, z + t * (z2 - z) as h from t)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line_id").orderBy("seq")
    return V.vertex(spark, d).select("x", "y", "z", *(F.lead(c).over(w).alias(f"{c}2") for c in "xyz")).filter("x2 is not null")


@query(V.with_(V.VERTEX, _KERB) + "select event_id, round(min(dist), 6) as dist, round(arg_min(h, (dist, h)), 6) as height from u group by event_id")
def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    """The kerb height beside every point: of the nearest of all segments, whatever line they are of."""
    p = V.vertex(spark, d).select("event_id", (F.col("x") + 1.5).alias("px"), (F.col("y") + 2.0).alias("py"))
    return spatial.nearest_segment(p, _segments(spark, d), "event_id", 5.0).select("event_id", *r6("dist", "height"))


_RING = """ring as (select id, unnest([x0, x1, x1, (x0 + x1) / 2, x0]) as x, unnest([y0, y0, y1, y1 + 5, y1]) as y, unnest([1, 2, 3, 4, 5]) as seq from footprint),
edge as (select id, x, y, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from ring window w as (partition by id order by seq)),
pt as (select id as pid, (x0 + x1) / 2 + 0.25 as px, (y0 + y1) / 2 + 0.25 as py from footprint),
inside as (select pid, id from pt join edge on (x > px) <> (x2 > px) and py < (y2 - y) * (px - x) / nullif(x2 - x, 0) + y group by pid, id having count(*) % 2 = 1)"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    mid = (F.col("x0") + F.col("x1")) / 2
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), (mid, F.col("y1") + 5), ("x0", "y1")]
    return V.footprint(spark, d).select("id", F.array(*(F.struct((F.col(x) if isinstance(x, str) else x).alias("x"), (F.col(y) if isinstance(y, str) else y).alias("y")) for x, y in corners)).alias("ring"))


def _ring_points(spark: SparkSession, d: str) -> DataFrame:
    return V.footprint(spark, d).select(F.col("id").alias("pid"), ((F.col("x0") + F.col("x1")) / 2 + 0.25).alias("px"), ((F.col("y0") + F.col("y1")) / 2 + 0.25).alias("py"))


@query(V.with_(V.FOOTPRINT, _RING) + "select pid, id from inside")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside_polygons(_ring_points(spark, d), _rings(spark, d), "pid", "id", 20.0)


@query(
    V.with_(V.FOOTPRINT, _RING)
    + """, far as (select pid, px + 20 + pid % 50 as px, py from pt), low as (select * from edge where id % 4 = 0),
hit as (select pid from far join low on (x > px) <> (x2 > px) and py < (y2 - y) * (px - x) / nullif(x2 - x, 0) + y group by pid, id having count(*) % 2 = 1),
t as (select *, greatest(0, least(1, coalesce(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / nullif(pow(x2 - x, 2) + pow(y2 - y, 2), 0), 0))) as t from far, low),
u as (select pid, min(sqrt(pow(px - (x + t * (x2 - x)), 2) + pow(py - (y + t * (y2 - y)), 2))) as dist from t group by pid)
select pid, case when pid in (select pid from hit) then 0 else round(dist, 6) end as dist from u"""
)
def road_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far every point is from the nearest polygon: 0 inside, else from its outline."""
    p = _ring_points(spark, d).withColumn("px", F.col("px") + 20 + F.col("pid") % 50)
    rings = _rings(spark, d).filter("id % 4 = 0")  # the polygons that count as road
    turned = F.concat(F.slice("ring", 2, 4), F.slice("ring", 1, 1))
    e = rings.select(F.explode(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b"))).alias("e"))
    e = e.select(*(F.col(f"e.{k}.{c}").alias(f"{c}{n}") for k, n in (("a", ""), ("b", "2")) for c in "xy"), F.lit(0.0).alias("z"), F.lit(0.0).alias("z2"))
    inside = spatial.inside_polygons(p, rings, "pid", "id", 20.0).select("pid").distinct().withColumn("in", F.lit(True))
    return spatial.nearest_segment(p, e, "pid", 10.0).join(inside, "pid", "left").select("pid", F.when(F.col("in"), 0.0).otherwise(F.round("dist", 6)).alias("dist"))


@query(
    V.with_(V.PLOT)
    + """, sheet as (select distinct floors * 2 as f from plot where floors % 2 = 1), wanted as (select distinct floors from plot)
select floors::int as floors, arg_min(f, (abs(floors - f), f))::int as sheet from wanted, sheet group by floors"""
)
def sheet_match(spark: SparkSession, d: str) -> DataFrame:
    p = V.plot(spark, d)
    sheets, wanted = p.filter("floors % 2 = 1").select((F.col("floors") * 2).alias("f")).distinct(), p.select("floors").distinct()
    # distinct floor counts on both sides: a few tens of rows each
    return wanted.crossJoin(sheets).groupBy("floors").agg(F.min_by("f", F.struct(F.abs(F.col("floors") - F.col("f")), "f")).alias("sheet"))


@query("""select p_type as grp, coalesce(r_name, 'unknown') as label, count(*) as n from part left join region on p_size % 7 = r_regionkey group by 1, 2""")
def manifest_join(spark: SparkSession, d: str) -> DataFrame:
    p, r = V.table(spark, d, "part").select("p_type", "p_size"), V.table(spark, d, "region").select("r_regionkey", "r_name")
    return p.join(r, F.col("p_size") % 7 == F.col("r_regionkey"), "left").groupBy(F.col("p_type").alias("grp"), F.coalesce("r_name", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


_NODES = """nodes as (select (p_partkey % 40)::int as ix, (p_partkey // 40)::int as iy, p_size::double as z from part),
ny as (select (max(p_partkey) // 40 + 1)::int as ny from part),
pt as (select event_id, (event_id % 390)::double as x, ((event_id * 7) % (10 * (select ny from ny)))::double as y from events)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    return p.select((F.col("p_partkey") % 40).cast("int").alias("ix"), F.expr("p_partkey div 40").cast("int").alias("iy"), F.col("p_size").cast("double").alias("z"))


def _rows(spark: SparkSession, d: str) -> int:
    """Rows of the grid, which has 40 columns."""
    return int(_nodes(spark, d).agg(F.max("iy")).first()[0] or 0) + 1


def _grid_points(spark: SparkSession, d: str, ny: int) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", (F.col("event_id") % 390).cast("double").alias("x"), (F.col("event_id") * 7 % (10 * ny)).cast("double").alias("y"))


@query(
    V.with_(_NODES)
    + """, f as (select event_id, greatest(0, least(39, x / 10)) as fx, greatest(0, least((select ny from ny) - 1, y / 10)) as fy from pt),
g as (select *, least(floor(fx), 38)::int as ix, least(floor(fy), greatest((select ny from ny) - 2, 0))::int as iy from f),
h as (select event_id, ix + i as ix, iy + j as iy, (case when i = 1 then fx - ix else 1 - (fx - ix) end) * (case when j = 1 then fy - iy else 1 - (fy - iy) end) as w from g, (values (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j))
select event_id, round(case when count(z) = count(*) then sum(w * z) end, 6) as z from h left join nodes using (ix, iy) where w > 0 group by event_id"""
)
def bilinear(spark: SparkSession, d: str) -> DataFrame:
    ny = _rows(spark, d)
    return grid.bilinear(_grid_points(spark, d, ny), _nodes(spark, d), ["event_id"], 10.0, 40, ny).select("event_id", *r6("z"))


@query(V.with_(_NODES) + """select event_id, z from pt join nodes on least(39, greatest(0, round_even(x / 10, 0)::int)) = ix and least((select ny from ny) - 1, greatest(0, round_even(y / 10, 0)::int)) = iy""")
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    ny = _rows(spark, d)
    return grid.nearest_cell(_grid_points(spark, d, ny), _nodes(spark, d), 10.0, 40, ny).select("event_id", "z")


@query(
    V.with_(_NODES)
    + ", "
    + ", ".join(f"{n} as (select event_id, z from pt left join nodes on least(39, greatest(0, {x}::int)) = ix and least((select ny from ny) - 1, greatest(0, {y}::int)) = iy)" for n, x, y in (("cut", "trunc((x - 200) / 10)", "trunc(y / 10)"), ("low", "floor((x - 200) / 10)", "floor(y / 10)")))
    + " select event_id, cut.z as cut_z, low.z as low_z from cut join low using (event_id)"
)
def cell_roundings(spark: SparkSession, d: str) -> DataFrame:
    """The two other ways to a cell: cut off towards zero, and rounded down; both kept within the grid."""
    ny = _rows(spark, d)
    p, n = _grid_points(spark, d, ny), _nodes(spark, d)
    cut, low = (grid.nearest_cell(p, n, 10.0, 40, ny, x0=200.0, how=h, outer=True).select("event_id", F.col("z").alias(f"{a}_z")) for h, a in (("truncate", "cut"), ("floor", "low")))
    return cut.join(low, "event_id")


# ---------------------------------------------------------------- grids


@query(V.with_(V.SAMPLE) + "select trunc(x / 10)::int as ix, trunc(y / 10)::int as iy, round(min(z) - 0.05, 6) as z from sample_pt group by 1, 2")
def lower_envelope(spark: SparkSession, d: str) -> DataFrame:
    return grid.lower_envelope(V.sample_pt(spark, d), 10.0, 0.05).select("ix", "iy", *r6("z"))


@query(V.with_(V.SAMPLE) + "select trunc(x / 10)::int as ix, trunc(y / 10)::int as iy, round(quantile_cont(z, 0.1), 6) as q from sample_pt group by 1, 2")
def cell_p10(spark: SparkSession, d: str) -> DataFrame:
    return grid.cell_quantile(V.sample_pt(spark, d), 10.0, 0.1).select("ix", "iy", *r6("q"))


@query(
    V.with_(_NODES)
    + """, a as (select *, case when lag(ix) over wx = ix - 1 then lag(z) over wx end as bx, case when lead(ix) over wx = ix + 1 then lead(z) over wx end as ax, case when lag(iy) over wy = iy - 1 then lag(z) over wy end as by_, case when lead(iy) over wy = iy + 1 then lead(z) over wy end as ay from nodes
window wx as (partition by iy order by ix), wy as (partition by ix order by iy)),
g as (select ix, iy, coalesce((ax - bx) / 20, (ax - z) / 10, (z - bx) / 10, 0) as gx, coalesce((ay - by_) / 20, (ay - z) / 10, (z - by_) / 10, 0) as gy from a)
select ix, iy, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) as slope from g"""
)
def slope(spark: SparkSession, d: str) -> DataFrame:
    return grid.slope_degrees(_nodes(spark, d), 10.0).select("ix", "iy", *r6("slope"))


@query(
    """with c as (select (p_partkey % 40)::int as ix, (p_partkey // 40)::int as iy, p_size from part), k as (select ix, iy from c where p_size % 25 = 0)
select c.ix, c.iy, round(min(sqrt(pow(c.ix - k.ix, 2) + pow(c.iy - k.iy, 2))), 6) as support from c, k group by 1, 2"""
)
def support_distance(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "part").select((F.col("p_partkey") % 40).cast("int").alias("ix"), F.expr("p_partkey div 40").cast("int").alias("iy"), "p_size")
    return grid.support_distance(c.select("ix", "iy"), c.filter("p_size % 25 = 0").select("ix", "iy")).select("ix", "iy", *r6("support"))


@query(
    """with c as (select (p_partkey % 40)::int as ix, (p_partkey // 40)::int as iy, p_size from part), k as (select ix, iy from c where p_size % 5 = 0)
select round(avg(case when k.ix is not null then 1.0::double else 0 end), 6) as share from c left join k using (ix, iy)"""
)
def supported_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of cells that have a sample of their own."""
    c = V.table(spark, d, "part").select((F.col("p_partkey") % 40).cast("int").alias("ix"), F.expr("p_partkey div 40").cast("int").alias("iy"), "p_size")
    known = c.filter("p_size % 5 = 0").select("ix", "iy").withColumn("known", F.lit(1.0))
    return c.join(known, ["ix", "iy"], "left").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))), 6).alias("share"))


_R = 4
_GAUSS = ", ".join(
    f"{t} as (select ix, iy, "
    + " + ".join(f"{__import__('math').exp(-0.5 * o * o):.17g}::double * " + ("z" if not o else f"coalesce({'lag' if o < 0 else 'lead'}(z, {abs(o)}) over w, {'first' if o < 0 else 'last'}_value(z) over e)") for o in range(-_R, _R + 1))
    + f" as s from {f} window w as (partition by {a} order by {b}), e as (partition by {a} order by {b} rows between unbounded preceding and unbounded following)), {t}n as (select ix, iy, s / {sum(__import__('math').exp(-0.5 * o * o) for o in range(-_R, _R + 1)):.17g}::double as z from {t})"
    for t, f, a, b in (("gx", "nodes", "iy", "ix"), ("gy", "gxn", "ix", "iy"))
)


@query(V.with_(_NODES) + ", " + _GAUSS + " select ix, iy, round(z, 6) as z from gyn")
def gaussian(spark: SparkSession, d: str) -> DataFrame:
    return grid.gaussian(_nodes(spark, d), 1.0).select("ix", "iy", *r6("z"))


_CLASS = """rule as (select p_partkey, case when p_size % 9 >= 7 then 'rock' when p_retailprice >= (select quantile_cont(p_retailprice, 0.7) from part) then 'meadow' when p_size <= 12 and p_size > 3 then 'verge' else 'grass' end as class from part)"""


def _painted(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    cut = p.agg(F.percentile("p_retailprice", 0.7).alias("cut"))  # one row
    cells = p.withColumns({"road_distance": F.col("p_size").cast("double"), "slope": (F.col("p_size") % 9).cast("double"), "noise": F.col("p_retailprice") >= 0})
    rules = [("verge", grid.rule("near_road", metres=12, inner=3)), ("meadow", F.col("p_retailprice") >= F.col("cut")), ("rock", grid.rule("steeper", degrees=7))]
    return cells.crossJoin(F.broadcast(cut)).select("p_partkey", grid.paint(rules, ["grass", "verge", "meadow", "rock"]).alias("class"))


@query(V.with_(_CLASS) + "select p_partkey, class from rule")
def painter_classify(spark: SparkSession, d: str) -> DataFrame:
    return _painted(spark, d)


@query(V.with_(_CLASS) + "select class, round(count(*) / sum(count(*)) over (), 4)::double as share from rule group by class")
def class_fractions(spark: SparkSession, d: str) -> DataFrame:
    return reports.fractions(_painted(spark, d), "class").select("class", F.round("share", 4).alias("share"))


_POND = """c as (select (p_partkey % 40)::int as ix, (p_partkey // 40)::int as iy, p_partkey as id, p_size::double as z, p_size, p_size % 16 = 0 as dry from part),
w0 as (select ix, iy, iy::bigint * 40 + ix as id from c where p_size % 8 < 3),
e as (select a.id as a, b.id as b from w0 a join w0 b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
r as (select id as node, id as k from w0 union select e.b, r.k from r join e on e.a = r.node where r.k < e.b),
p as (select node, min(k) as component from r group by node),
w1 as (select w0.ix, w0.iy, component from w0 join p on p.node = w0.id join c on c.ix = w0.ix and c.iy = w0.iy where not dry),
w as (select * from w1 where component in (select component from w1 group by 1 having count(*) >= 2)),
land as (select * from c where (ix, iy) not in (select ix, iy from w)),
l as (select w.component, min(land.z) - 0.3 as level from w join land on pow(w.ix - land.ix, 2) + pow(w.iy - land.iy, 2) <= 4 group by 1),
o as (select c.ix, c.iy, coalesce(least(c.z, l.level - 0.5), c.z) as z, l.level from c left join w on c.ix = w.ix and c.iy = w.iy left join l using (component))"""


@query("with recursive " + _POND + " select ix, iy, round(z, 6) as z, round(case when z <= level then level end, 6) as level from o")
def flatten_water(spark: SparkSession, d: str) -> DataFrame:
    """Ponds of connected cells, of two cells at least, made level under their banks; the carriageway stays dry."""
    c = V.table(spark, d, "part").select((F.col("p_partkey") % 40).cast("int").alias("ix"), F.expr("p_partkey div 40").cast("int").alias("iy"), F.col("p_size").cast("double").alias("z"), (F.col("p_size") % 16 == 0).alias("dry"), "p_size")
    w = grid.components(c.filter("p_size % 8 < 3").select("ix", "iy"), 40, 64)
    return grid.flatten_water(c.select("ix", "iy", "z", "dry"), w, bank=2, freeboard=0.3, depth=0.5, smallest=2).select("ix", "iy", *r6("z", "level"))


_STEP = """c as (select (p_partkey % 40)::int as ix, (p_partkey // 40)::int as iy, p_size // 20 as step from part),
t as (select ix, iy, iy::bigint * 40 + ix as id, step from c),
e as (select a.id as a, b.id as b from t a join t b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 and a.step = b.step),
r as (select id as node, id as k from t union select e.b, r.k from r join e on e.a = r.node where r.k < e.b),
p as (select node, min(k) as terrace from r group by node)"""


@query("with recursive " + _STEP + " select terrace, any_value(step)::int as step, count(*) as cells from p join t on t.id = p.node group by terrace having count(*) >= 3")
def terraces(spark: SparkSession, d: str) -> DataFrame:
    """Level ground: connected cells of one height class, three at least."""
    c = V.table(spark, d, "part").select((F.col("p_partkey") % 40).cast("int").alias("ix"), F.expr("p_partkey div 40").cast("int").alias("iy"), F.expr("p_size div 20").cast("int").alias("step"))
    parts = grid.components(c, 40, 64, "step")
    return parts.groupBy(F.col("component").alias("terrace")).agg(F.first("step").alias("step"), F.count("*").alias("cells")).filter("cells >= 3")


_TILES = """cell as (select p_partkey as id, 35.0::double + (p_partkey % 40)::double / 500 as lat, 139.0::double + (p_partkey // 40)::double / 2000 as lon from part),
spot as (select id, (lon + 180) / 360 * 16384 as fx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384 as fy from cell),
key as (select id, floor(fx)::bigint as tx, floor(fy)::bigint as ty, least(3, greatest(0, trunc((fx - floor(fx)) * 4)::int)) as px, least(3, greatest(0, trunc((fy - floor(fy)) * 4)::int)) as py from spot),
src as (select r_regionkey as priority, r_name as source from region),
pix as (select priority, source, tx, ty, px, py, (tx * 31 + ty * 17 + px * 5 + py)::double % 97 as z from src, (select distinct tx, ty from key), range(4) a(px), range(4) b(py) where (tx + ty) % 5 < priority + 2),
got as (select key.id, src.priority, src.source, pix.z from key cross join src left join pix on pix.priority = src.priority and pix.tx = key.tx and pix.ty = key.ty and pix.px = key.px and pix.py = key.py),
best as (select priority from got group by priority having avg(case when z is not null then 1.0::double else 0 end) > 0.5 order by priority limit 1)"""


@query(V.with_(_TILES) + "select id, source, z from got where priority in (select priority from best)")
def sample_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Heights of cells from raster tiles: the first source that covers more than half of the cells gives them all."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40 / 500 + 35.0).alias("lat"), (F.expr("p_partkey div 40") / 2000 + 139.0).alias("lon"))
    tx, ty = C.slippy_tile(F.col("lat"), F.col("lon"), 14)
    keys = p.select(tx.alias("tx"), ty.alias("ty")).distinct()
    src = V.table(spark, d, "region").select(F.col("r_regionkey").alias("priority"), F.col("r_name").alias("source"))
    side = F.explode(F.sequence(F.lit(0), F.lit(3)))
    pix = keys.crossJoin(src).filter("(tx + ty) % 5 < priority + 2").withColumn("px", side).withColumn("py", side)
    pix = pix.withColumn("z", ((F.col("tx") * 31 + F.col("ty") * 17 + F.col("px") * 5 + F.col("py")) % 97).cast("double"))
    return grid.sample_tiles(p, "id", src, pix, zoom=14, size=4).select("id", "source", "z")


@query("""with c as (select r_name as source, r_regionkey as priority, (select count(*) filter (p_size % 5 <= r_regionkey) / count(*)::double from part) as share from region) select source, priority, round(share, 6) as share from c where share > 0.5 order by priority limit 1""")
def tile_source(spark: SparkSession, d: str) -> DataFrame:
    r, p = V.table(spark, d, "region"), V.table(spark, d, "part").select("p_size")
    j = p.groupBy((F.col("p_size") % 5).alias("m")).count().crossJoin(F.broadcast(r))  # five rows by five
    c = j.groupBy(F.col("r_name").alias("source"), F.col("r_regionkey").alias("priority")).agg((F.sum(F.when(F.col("m") <= F.col("r_regionkey"), F.col("count")).otherwise(0)) / F.sum("count")).alias("share"))
    return grid.best_source(c).select("source", "priority", *r6("share"))


# ---------------------------------------------------------------- aggregates, reports, ranks


@query(V.with_(V.VERTEX) + "select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, round(avg(x), 6) as cx, round(avg(y), 6) as cy from vertex")
def extent(spark: SparkSession, d: str) -> DataFrame:
    return reports.extent(V.vertex(spark, d)).select("x0", "x1", "y0", "y1", *r6("cx", "cy"))


@query("select coalesce(event_type, '?') as kind, count(*) as n, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) as spread from events group by 1")
def inspect_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts_by(V.table(spark, d, "events"), "event_type", "value").select("kind", "n", *r6("spread"))


@query(
    V.with_(V.SAMPLE)
    + """, o as (select median(x - z) as offset_ from sample_pt), r as (select abs(x - z - offset_) as res from sample_pt, o)
select round((select offset_ from o), 6) as datum, round(median(res), 6) as res_median, round(quantile_cont(res, 0.9), 6) as res_p90 from r"""
)
def datum_align(spark: SparkSession, d: str) -> DataFrame:
    return reports.datum_align(V.sample_pt(spark, d), F.col("x"), F.col("z")).select(*r6("datum", "res_median", "res_p90"))


@query(
    V.with_(V.VERTEX, V.GROUND)
    + """, m as (select line_id, median(v.z - g.ground) as m from vertex v join ground g on floor(v.x / 10) = g.ix and floor(v.y / 10) = g.iy group by 1)
select count(*) as lanes, round(min(m), 6) as least, round(median(m), 6) as middle, round(max(m), 6) as most from m"""
)
def elevation_report(spark: SparkSession, d: str) -> DataFrame:
    v = V.vertex(spark, d).withColumn("ix", F.floor(F.col("x") / 10)).withColumn("iy", F.floor(F.col("y") / 10)).join(V.ground(spark, d), ["ix", "iy"])
    m = v.groupBy("line_id").agg(F.median(F.col("z") - F.col("ground")).alias("m"))
    return m.agg(F.count("*").alias("lanes"), F.min("m").alias("least"), F.median("m").alias("middle"), F.max("m").alias("most")).select("lanes", *r6("least", "middle", "most"))


@query(V.with_(V.PLOT) + "select count(*) as n, min(height) as least, median(height) as middle, max(height) as most, array_to_string(list_sort(list(distinct floors)), ',') as floor_counts from plot")
def building_report(spark: SparkSession, d: str) -> DataFrame:
    return V.plot(spark, d).agg(F.count("*").alias("n"), F.min("height").alias("least"), F.median("height").alias("middle"), F.max("height").alias("most"), F.array_join(F.sort_array(F.collect_set("floors")), ",").alias("floor_counts"))


@query(
    V.with_(V.ATTEMPT)
    + """, b as (select building, count(*) as tries, max(iou) as best from attempt group by building)
select count(*) as attempted, count(*) filter (best >= 0.85) as used, sum(tries)::bigint as generations, count(*) filter (tries > 1) as retried, round(min(best) filter (best >= 0.85), 6) as iou_min, round(avg(best) filter (best >= 0.85), 6) as iou_mean from b"""
)
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    b = V.attempt(spark, d).groupBy("building").agg(F.count("*").alias("tries"), F.max("iou").alias("best"))
    return reports.ledger_summary(b, F.col("best") >= 0.85).select("attempted", "used", "generations", "retried", *r6("iou_min", "iou_mean"))


@query(
    V.with_(V.ATTEMPT)
    + """, s as (select building, min(try_no) filter (iou >= 0.9) as stop, max(try_no) as last from attempt group by building)
select a.building, round(max(iou), 6) as best, count(*) as tries from attempt a join s on a.building = s.building and a.try_no <= coalesce(stop, last) group by 1"""
)
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return reports.best_of_n(V.attempt(spark, d), ["building"], "try_no", "iou", 0.9).select("building", *r6("best"), "tries")


@query(V.with_(V.PLOT) + "select id, area from plot order by area desc, id limit 100")
def topk_area(spark: SparkSession, d: str) -> DataFrame:
    """The hundred largest plots: a top-k report."""
    return V.plot(spark, d).orderBy(F.desc("area"), "id").limit(100).select("id", "area")


@query("select p_partkey as mesh, p_size::bigint as vertices, (sum(p_size) over (order by p_partkey) - p_size)::bigint as first from part")
def offsets(spark: SparkSession, d: str) -> DataFrame:
    return reports.running_offsets(V.table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), F.col("p_size").cast("long").alias("vertices")), "mesh", "vertices")


@query("select l_orderkey as id, 'Roads' as grp from lineitem where l_returnflag = 'A' union all select o_orderkey, 'Junctions' from orders where o_orderstatus = 'F'")
def union_bag(spark: SparkSession, d: str) -> DataFrame:
    a = V.table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), F.lit("Roads").alias("grp"))
    return a.unionByName(V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("Junctions").alias("grp")))


@query("select o_orderkey as id from orders except select l_orderkey from lineitem where l_returnflag = 'R'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which nothing came back."""
    back = V.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct().join(back, "id", "left_anti")


@query("select c_custkey as id from customer intersect select o_custkey from orders")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(V.table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query(
    """with u as (select user_id as k, 1 as prio, max(value) as v from events group by 1 union all select c_custkey, 2, c_acctbal from customer where c_custkey % 2 = 0)
select k, arg_max(v, prio) as v from u group by k"""
)
def merge_later_wins(spark: SparkSession, d: str) -> DataFrame:
    a = V.table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("v")).withColumn("prio", F.lit(1))
    b = V.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(2).alias("prio"))
    return a.unionByName(b).groupBy("k").agg(F.max_by("v", "prio").alias("v"))


_MESH = """mesh as (select l_orderkey % 97 as mesh, l_extendedprice / 20000 as x, l_quantity / 10 as y, l_discount * 100 + l_tax * 10 as z from lineitem),
sp as (select mesh, min(z) as low, max(z) - min(z) as span from mesh group by mesh),
col as (select mesh, floor(x / greatest(span * 0.02, 1e-9)) as cx, floor(y / greatest(span * 0.02, 1e-9)) as cy, min(z) as z, any_value(low) as low, any_value(span) as span from mesh join sp using (mesh) group by 1, 2, 3),
seat as (select mesh, case when any_value(span) <= 0 or count(*) filter (z < low + span * 0.5) < 4 then any_value(low) else least(quantile_cont(z, 0.3) filter (z < low + span * 0.5), any_value(low) + any_value(span) * 0.15) end as seat from col group by mesh)"""


def _mesh(spark: SparkSession, d: str) -> DataFrame:
    """Clouds of vertices: mesh, x, y, z."""
    li = V.table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 97).alias("mesh"), (F.col("l_extendedprice") / 20000).alias("x"), (F.col("l_quantity") / 10).alias("y"), (F.col("l_discount") * 100 + F.col("l_tax") * 10).alias("z"))


@query(V.with_(_MESH) + "select mesh, round(seat, 6) as seat from seat")
def seat_z(spark: SparkSession, d: str) -> DataFrame:
    return reports.seat_z(_mesh(spark, d), ["mesh"]).select("mesh", *r6("seat"))


@query(
    V.with_(_MESH)
    + """, m as (select mesh, avg(x) as mx, avg(y) as my from mesh group by mesh),
t as (select mesh, seat, (x - mx) * cos(mesh / 10.0::double - 0.3::double) - (y - my) * sin(mesh / 10.0::double - 0.3::double) as a, (x - mx) * sin(mesh / 10.0::double - 0.3::double) + (y - my) * cos(mesh / 10.0::double - 0.3::double) as b, z from mesh join m using (mesh) join seat using (mesh)),
u as (select mesh, a * 1.2 * cos(0.3::double) - b * 0.9 * sin(0.3::double) + mesh as x, a * 1.2 * sin(0.3::double) + b * 0.9 * cos(0.3::double) - mesh as y, (z - seat) * sqrt(1.2::double * 0.9) + 5 as z from t)
select mesh, round(min(x), 5) as x0, round(max(x), 5) as x1, round(min(y), 5) as y0, round(max(y), 5) as y1, round(min(z), 5) as z0, round(max(z), 5) as z1 from u group by mesh"""
)
def place_mesh(spark: SparkSession, d: str) -> DataFrame:
    """The extent of meshes that were turned, stretched along a heading, and seated on the ground."""
    m = _mesh(spark, d)
    seats = reports.seat_z(m, ["mesh"])
    id_ = F.col("mesh").cast("double")
    fit = seats.withColumns({"yaw": id_ / 10, "sx": F.lit(1.2), "sy": F.lit(0.9), "along": F.lit(0.3), "cx": id_, "cy": -id_, "base": F.lit(5.0)})
    p = mesh.placed(m, fit, ["mesh"])
    return p.groupBy("mesh").agg(*(F.round(f(c), 5).alias(f"{c}{n}") for c in "xyz" for n, f in ((0, F.min), (1, F.max))))


@query(
    V.with_(V.VERTEX, V.GROUND)
    + """select count(*) filter (ground > z) as above, round(max(ground - z), 6) as worst, count(*) as vertices from vertex v join ground g on floor(v.x / 10) = g.ix and floor(v.y / 10) = g.iy"""
)
def ground_clearance_qa(spark: SparkSession, d: str) -> DataFrame:
    v = V.vertex(spark, d).withColumn("ix", F.floor(F.col("x") / 10)).withColumn("iy", F.floor(F.col("y") / 10)).join(V.ground(spark, d), ["ix", "iy"])
    return v.agg(F.count_if(F.col("ground") > F.col("z")).alias("above"), F.round(F.max(F.col("ground") - F.col("z")), 6).alias("worst"), F.count("*").alias("vertices"))


# ---------------------------------------------------------------- ribbons in plan


@query(
    V.with_(V.VERTEX, V.STRIP)
    + """, ring as (
  select line_id, seq as k, lx as x, ly as y, lz as z from strip union all select line_id, 2 * n - seq + 1, rx, ry, rz from strip join (select line_id, max(seq) as n from strip group by 1) using (line_id)),
nxt as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from ring window w as (partition by line_id order by k)),
s as (select line_id, count(*) as corners, avg(z) as mean_z, avg(x) as x, avg(y) as y, abs(sum(x * y2 - x2 * y)) / 2 as area from nxt group by line_id)
select line_id, corners, round(mean_z, 6) as mean_z, round(x, 6) as x, round(y, 6) as y, round(area, 4) as area from s where corners >= 4"""
)
def footprint_of(spark: SparkSession, d: str) -> DataFrame:
    """Each lane's ring in plan (left bound there, right bound back): corners, mean height, middle of the corners, area."""
    return reports.footprints(V.strip(spark, d), ["line_id"]).select("line_id", F.size("ring").cast("long").alias("corners"), *r6("mean_z", "x", "y"), F.round("area", 4).alias("area"))
