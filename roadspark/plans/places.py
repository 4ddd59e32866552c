"""Queries that put things in their places: paint by lane, heights of patches and plots, edges, frontages; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators import sequence as S
from roadspark.operators import spatial
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6

# ---------------------------------------------------------------- candidates by boxes


@query(
    V.with_(V.FOOTPRINT)
    + """, lane as (select id, x0 - 0.6 as x0, y0 - 0.6 as y0, x1 + 0.6 as x1, y1 + 0.6 as y1 from footprint where id % 3 > 0),
paint as (select id, case when id % 2 = 0 then 'StopLines' else 'LaneMarkings' end as grp, x0 + 2 as x0, y0 + 1 as y0, x0 + 3 as x1, y0 + 4 as y1 from footprint where id % 3 = 0)
select l.id as lane_id, p.id as paint_id, p.grp from lane l join paint p on p.x0 <= l.x1 and p.x1 >= l.x0 and p.y0 <= l.y1 and p.y1 >= l.y0 and not (l.id % 4 = 0 and p.grp = 'LaneMarkings')"""
)
def paint_near(spark: SparkSession, d: str) -> DataFrame:
    """Paint whose box meets a lane's, 0.6 m wider all round, with the group it is from; lanes of junctions (every
    fourth) take no lane lines."""
    f = V.footprint(spark, d)
    lane = f.filter("id % 3 > 0").select("id", *((F.col(c) + s).alias(c) for c, s in (("x0", -0.6), ("y0", -0.6), ("x1", 0.6), ("y1", 0.6))))
    grp = F.when(F.col("id") % 2 == 0, "StopLines").otherwise("LaneMarkings")
    paint = f.filter("id % 3 = 0").select("id", grp.alias("grp"), (F.col("x0") + 2).alias("x0"), (F.col("y0") + 1).alias("y0"), (F.col("x0") + 3).alias("x1"), (F.col("y0") + 4).alias("y1"))
    met = spatial.touching_boxes(lane, paint, 20.0)
    return met.filter(~((F.col("a_id") % 4 == 0) & (F.col("b_grp") == "LaneMarkings"))).select(F.col("a_id").alias("lane_id"), F.col("b_id").alias("paint_id"), F.col("b_grp").alias("grp"))


@query(
    V.with_(V.FOOTPRINT)
    + """, patch as (select id, x1 + 1 as x0, y0 as y0, x1 + 3 as x1, y0 + 2 as y1 from footprint where id % 5 = 0),
near as (select p.id, f.mean_z from patch p join footprint f on f.id % 5 > 0 and f.id % 7 < 3 and f.x0 <= p.x1 + 1 and f.x1 >= p.x0 - 1 and f.y0 <= p.y1 + 1 and f.y1 >= p.y0 - 1)
select p.id, count(n.id) as lanes, round(coalesce(avg(n.mean_z), (select avg(mean_z) from footprint where id % 5 > 0 and id % 7 < 3)), 6) as z from patch p left join near n using (id) group by p.id"""
)
def patch_heights(spark: SparkSession, d: str) -> DataFrame:
    """A patch's height from the lanes that come within a metre of it; from all lanes where none does."""
    f = V.footprint(spark, d)
    lanes = f.filter("id % 5 > 0 and id % 7 < 3").select("id", "x0", "y0", "x1", "y1", "mean_z")
    patch = f.filter("id % 5 = 0").select("id", F.col("x1").alias("x0"), (F.col("y0") - 1).alias("y0"), (F.col("x1") + 4).alias("x1"), (F.col("y0") + 3).alias("y1"))
    near = spatial.touching_boxes(patch, lanes, 20.0).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("lanes"), F.avg("b_mean_z").alias("z"))
    every = lanes.agg(F.avg("mean_z").alias("mean"))  # one row
    return patch.join(near, "id", "left").crossJoin(F.broadcast(every)).select("id", F.coalesce("lanes", F.lit(0)).alias("lanes"), F.round(F.coalesce("z", "mean"), 6).alias("z"))


@query(
    V.with_(V.FOOTPRINT)
    + """, part as (select l_orderkey as id, l_linenumber as k, l_quantity / 2 as w, l_extendedprice / 4000 as h from lineitem),
box as (select p.id, p.k, f.x0, f.y0, f.x1, f.y1, f.x0 + p.w as px, f.y0 + p.h as py from part p join footprint f on f.id = p.id)
select id, bool_and(px <= x1 + 0.25 and py <= y1 + 0.25) as fits from box group by id"""
)
def within_plot(spark: SparkSession, d: str) -> DataFrame:
    """Whether all parts of a building lie in its plot, with a quarter of a metre to spare."""
    part = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") / 2).alias("w"), (F.col("l_extendedprice") / 4000).alias("h"))
    inside = (F.col("x0") + F.col("w") <= F.col("x1") + 0.25) & (F.col("y0") + F.col("h") <= F.col("y1") + 0.25)
    return part.join(V.footprint(spark, d), "id").groupBy("id").agg(F.bool_and(inside).alias("fits"))


@query("select l_orderkey as id, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) as part, max(l_extendedprice) as area from lineitem group by 1")
def largest_part(spark: SparkSession, d: str) -> DataFrame:
    """The largest part of each shape, the first of equal ones."""
    li = V.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("part"), F.max("l_extendedprice").alias("area"))


# ---------------------------------------------------------------- heights and edges


@query(
    V.with_(V.VERTEX, V.GROUND, V.FOOTPRINT)
    + """, c as (select id, unnest([x0, x1, x1, x0]) as x, unnest([y0, y0, y1, y1]) as y from footprint)
select id, round(min(ground) + 0.3, 6) as base, count(ground) as corners from c left join ground g on floor(c.x / 10) = g.ix and floor(c.y / 10) = g.iy group by id"""
)
def base_height(spark: SparkSession, d: str) -> DataFrame:
    """Where a building stands: on the lowest of its corners' ground, and a terrace's height of 30 cm."""
    p = F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))))
    c = V.footprint(spark, d).select("id", p.alias("p")).select("id", F.floor(F.col("p.x") / 10).alias("ix"), F.floor(F.col("p.y") / 10).alias("iy"))
    return c.join(V.ground(spark, d), ["ix", "iy"], "left").groupBy("id").agg(F.round(F.min("ground") + 0.3, 6).alias("base"), F.count("ground").alias("corners"))


@query(
    V.with_(V.VERTEX, V.STATION)
    + """, f as (select *, z - 2.4 >= 0.5 as flag, row_number() over (partition by line_id order by seq) as p from station),
g as (select *, p - row_number() over (partition by line_id order by seq) as k from f where flag)
select line_id, min(seq) as start, max(seq) as stop, round(max(station) - min(station), 6) as length from g group by line_id, k having max(seq) > min(seq) and max(station) - min(station) >= 3"""
)
def terrace_edges(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of an outline below which the ground falls by half a metre or more, 3 m long at least: they get a fence."""
    v = S.stations(V.vertex(spark, d), ["line_id"]).withColumn("flag", F.col("z") - 2.4 >= 0.5)
    return S.measured_runs(v, ["line_id"], "flag", 3.0).select("line_id", "start", "stop", *r6("length"))


@query(
    V.with_(V.FOOTPRINT)
    + """, e as (select id, unnest([x0, x1, x1, x0]) as x, unnest([y0, y0, y1, y1]) as y, unnest([x1, x1, x0, x0]) as x2, unnest([y0, y1, y1, y0]) as y2 from footprint where id % 6 = 0),
p as (select id as pid, x0 + 3 as px, y0 + 1 as py from footprint),
t as (select pid, px, py, e.*, greatest(0, least(1, coalesce(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / nullif(pow(x2 - x, 2) + pow(y2 - y, 2), 0), 0))) as t from p, e)
select pid, min(sqrt(pow(px - (x + t * (x2 - x)), 2) + pow(py - (y + t * (y2 - y)), 2))) < 2.0 as outer from t group by pid"""
    .replace(" as outer ", ' as "outer" ')
)
def outer_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a point lies on the edge of a structure: within 2 m of its outline."""
    f = V.footprint(spark, d)
    corners = ["x0", "x1", "x1", "x0"], ["y0", "y0", "y1", "y1"]
    sides = [F.struct(F.col(corners[0][k]).alias("x"), F.col(corners[1][k]).alias("y"), F.col(corners[0][(k + 1) % 4]).alias("x2"), F.col(corners[1][(k + 1) % 4]).alias("y2")) for k in range(4)]
    e = f.filter("id % 6 = 0").select(F.explode(F.array(*sides)).alias("e")).select("e.*", F.lit(0.0).alias("z"), F.lit(0.0).alias("z2"))
    p = f.select(F.col("id").alias("pid"), (F.col("x0") + 3).alias("px"), (F.col("y0") + 1).alias("py"))
    return spatial.nearest_segment(p, e, "pid", 8.0).select("pid", (F.col("dist") < 2.0).alias("outer"))


_REACH = """r as (select p_partkey, p_size::double as edge, case when p_partkey % 3 = 0 then p_size * 0.6 + p_partkey % 5 end as obstacle from part),
s as (select p_partkey, case when obstacle is null then edge else least(edge, obstacle - 1) end as length, edge from r)"""


@query(V.with_(_REACH) + "select p_partkey, round(case when edge < 2 or length < 2 then 0 else length end, 6)::double as length from s")
def stub_reach(spark: SparkSession, d: str) -> DataFrame:
    """How far a loose end is continued: to the map's edge, or to a metre before what is in the way; under 2 m not at all."""
    edge = F.col("p_size").cast("double")
    obstacle = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 0.6 + F.col("p_partkey") % 5)
    return V.table(spark, d, "part").select("p_partkey", F.round(C.reach(edge, obstacle, clearance=1.0, least=2.0), 6).alias("length"))


_LOT = """lot as (select id, x0, y0, x1, y1, 3.5::double * (0.7 + (id % 7) / 10.0::double) as depth from footprint),
cut as (select *, least(depth, (y1 - y0) / 3) as d, case when id % 2 = 0 then -1 else 1 end as side from lot)"""


@query(V.with_(V.FOOTPRINT, _LOT) + "select id, round((x1 - x0) * (y1 - y0), 6) as whole, round((x1 - x0) * (y1 - y0 - d), 6) as built from cut")
def lot_frontage(spark: SparkSession, d: str) -> DataFrame:
    """Lots, and what is left of them behind a strip on the street's side (above or below): at most a third of their
    depth, taken off as a half-plane."""
    f = V.footprint(spark, d)
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    depth = (F.col("id") % 7 / 10 + 0.7) * 3.5
    lots = f.select("id", ring.alias("ring"), depth.alias("depth"), F.lit(0.0).alias("tx"), F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0).alias("ty"))
    rest = lots.withColumn("back", spatial.behind_frontage(F.col("ring"), F.col("tx"), F.col("ty"), F.col("depth")))
    return rest.select("id", F.round(spatial.ring_size(F.col("ring")), 6).alias("whole"), F.round(spatial.ring_size(F.col("back")), 6).alias("built"))
