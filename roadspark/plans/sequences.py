"""Queries over lane polylines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.operators import mesh as M
from roadspark.operators import sequence as S
from roadspark.plans import views as V
from roadspark.plans.registry import query

BY = ["line_id"]


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(V.with_(V.VERTEX, V.STATION) + "select line_id, seq, round(station, 6) as station from station")
def station(spark: SparkSession, d: str) -> DataFrame:
    return S.stations(V.vertex(spark, d), BY).select("line_id", "seq", *r6("station"))


@query(V.with_(V.VERTEX, V.STATION) + "select line_id, round(sum(coalesce(gap, 0)), 6) as length from seg group by line_id")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return S.lengths(V.vertex(spark, d), BY).select("line_id", *r6("length"))


_SEG3 = """s0 as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)) as gap3 from vertex window w as (partition by line_id order by seq)),
s1 as (select *, sum(coalesce(gap3, 0)) over (partition by line_id order by seq rows unbounded preceding) as st from s0),
s2 as (select *, lead(st) over w as st2, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2, max(st) over (partition by line_id) as total, count(*) over (partition by line_id) as cnt from s1 window w as (partition by line_id order by seq))"""


@query(
    V.with_(V.VERTEX, _SEG3)
    + """, n as (select *, greatest(cnt, ceil(total / 40.0) + 1)::int as n from s2 where st2 > st),
p as (select *, total / (n - 1) as step from n),
q as (select *, ceil(round(st / step, 9))::int as a, case when st2 = total then n - 1 else ceil(round(st2 / step, 9))::int - 1 end as b from p),
k as (select *, unnest(range(a, b + 1)) as k from q where b >= a)
select line_id, k::int as k, round(x + (k * step - st) / (st2 - st) * (x2 - x), 6) as x, round(y + (k * step - st) / (st2 - st) * (y2 - y), 6) as y, round(z + (k * step - st) / (st2 - st) * (z2 - z), 6) as z from k"""
)
def resample3d(spark: SparkSession, d: str) -> DataFrame:
    return S.resample_count(V.vertex(spark, d), BY, 40.0).select("line_id", "k", *r6("x", "y", "z"))


_SEG2 = """s2 as (select *, lead(station) over w as st2, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2, max(station) over (partition by line_id) as total, count(*) over (partition by line_id) as cnt from station window w as (partition by line_id order by seq))"""


@query(
    V.with_(V.VERTEX, V.STATION, _SEG2)
    + """, q as (select *, case when station = 0 then 0 else floor(station / 7.5)::int + 1 end as a, floor(st2 / 7.5)::int as b from s2 where st2 > station),
k as (select *, unnest(range(a, b + 1)) as k from q where b >= a)
select line_id, k::int as k, round(x + (k * 7.5 - station) / (st2 - station) * (x2 - x), 6) as x, round(y + (k * 7.5 - station) / (st2 - station) * (y2 - y), 6) as y, round(z + (k * 7.5 - station) / (st2 - station) * (z2 - z), 6) as z from k"""
)
def resample_step(spark: SparkSession, d: str) -> DataFrame:
    return S.resample_step(V.vertex(spark, d), BY, 7.5).select("line_id", "k", *r6("x", "y", "z"))


@query(
    V.with_(V.VERTEX)
    + """select line_id, seq, round(case when count(*) over (partition by line_id) < 5 then z else avg(z) over (partition by line_id order by seq rows between 2 preceding and 2 following) end, 6) as z from vertex"""
)
def smooth(spark: SparkSession, d: str) -> DataFrame:
    return S.smooth(V.vertex(spark, d), BY, 5, axes="z").select("line_id", "seq", *r6("z"))


@query(
    V.with_(V.VERTEX)
    + """, l as (select *, coalesce(lead(x, 3) over w, last_value(x) over e) as x_to, coalesce(lead(y, 3) over w, last_value(y) over e) as y_to, last_value(seq) over e as last from vertex
window w as (partition by line_id order by seq), e as (partition by line_id order by seq rows between unbounded preceding and unbounded following))
select line_id, seq, round(x_to - x, 6) as dx, round(y_to - y, 6) as dy from l where seq <> last and (x <> x_to or y <> y_to)"""
)
def lookahead(spark: SparkSession, d: str) -> DataFrame:
    return S.look_ahead(V.vertex(spark, d), BY, 3).select("line_id", "seq", F.round(F.col("x_to") - F.col("x"), 6).alias("dx"), F.round(F.col("y_to") - F.col("y"), 6).alias("dy"))


_RUNS = """on_ as (select *, seq - row_number() over (partition by line_id order by seq) as g from flagged where flag),
runs as (select line_id, min(seq) as start, max(seq) as stop from on_ group by line_id, g having max(seq) > min(seq))"""


@query(V.with_(V.VERTEX, "flagged as (select *, z >= 2 as flag from vertex)", _RUNS) + "select line_id, start, stop from runs")
def runs_of(spark: SparkSession, d: str) -> DataFrame:
    return S.runs(V.vertex(spark, d).withColumn("flag", F.col("z") >= 2), BY, "flag").select("line_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(
    V.with_(
        V.VERTEX,
        V.STATION,
        """f as (select *, z >= 2 as flag, row_number() over (partition by line_id order by seq) as p, count(*) over (partition by line_id) as n from station)""",
        """g as (select *, p - row_number() over (partition by line_id, flag order by seq) as g from f)""",
        """h as (select *, min(p) over r as a, max(p) over r as b, max(station) over r - min(station) over r as len from g window r as (partition by line_id, flag, g))""",
    )
    + "select line_id, seq, flag or (b > a and a > 1 and b < n and len < 12) as closed from h"
)
def close_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = S.stations(V.vertex(spark, d), BY).withColumn("flag", F.col("z") >= 2)
    return S.close_gaps(s, BY, "flag", 12.0).select("line_id", "seq", "closed")


@query(
    V.with_(
        V.VERTEX,
        V.STATION,
        V.GROUND,
        """c as (select s.*, s.z - g.ground >= 1.0 as flag from station s join ground g on floor(s.x / 10) = g.ix and floor(s.y / 10) = g.iy)""",
        """o as (select *, row_number() over (partition by line_id order by seq) as p from c)""",
        """r as (select *, p - row_number() over (partition by line_id order by seq) as g from o where flag)""",
    )
    + """select line_id, min(seq) as start, max(seq) as stop, round(max(station) - min(station), 6) as length from r group by line_id, g having max(seq) > min(seq) and max(station) - min(station) >= 10"""
)
def bridge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches that run a metre or more above the lower envelope, ten metres long at least."""
    v = S.stations(V.vertex(spark, d), BY)
    g = V.ground(spark, d)
    c = v.withColumn("ix", F.floor(F.col("x") / 10)).withColumn("iy", F.floor(F.col("y") / 10)).join(g, ["ix", "iy"])
    c = c.withColumn("flag", F.col("z") - F.col("ground") >= 1.0)
    w = Window.partitionBy("line_id").orderBy("seq")
    c = c.withColumn("p", F.row_number().over(w)).filter("flag").withColumn("g", F.col("p") - F.row_number().over(w))
    out = c.groupBy("line_id", "g").agg(F.min("seq").cast("long").alias("start"), F.max("seq").cast("long").alias("stop"), (F.max("station") - F.min("station")).alias("length"))
    return out.filter("stop > start and length >= 10").select("line_id", "start", "stop", *r6("length"))


@query(
    V.with_(V.VERTEX, V.STATION, _SEG2)
    + """, v as (select *, max(station) over (partition by line_id) as total, min(seq) over (partition by line_id) as s0, max(seq) over (partition by line_id) as s1 from station),
own as (select line_id, case when total <= 3 then 0 else floor(station / 8.0)::int end as dash, case when total > 3 then 1 when seq = s0 then 0 when seq = s1 then 2 else 1 end as part, station as place, x, y
  from v where total <= 3 or (station > floor(station / 8.0) * 8.0 and station < least(floor(station / 8.0) * 8.0 + 3, total))),
q as (select * from s2 where st2 > station and total > 3),
a as (select line_id, unnest(range(greatest(0, ceil(round((station - o) / 8.0, 9)))::int, floor(round((st2 - o) / 8.0, 9))::int + 1)) as dash, o, part, station, st2, total, x, y, x2, y2
  from q, (values (0, 0.0::double), (2, 3.0::double)) t(part, o)),
b as (select line_id, dash::int as dash, part, dash * 8.0::double + o as place, x + (dash * 8.0 + o - station) / (st2 - station) * (x2 - x) as x, y + (dash * 8.0 + o - station) / (st2 - station) * (y2 - y) as y
  from a where (dash * 8.0 + o < st2 or (dash * 8.0 + o = total and part = 2)) and dash * 8.0 + o >= station and (part = 2 or total - dash * 8.0 > 1e-6)),
c as (select line_id, floor(total / 8.0)::int as dash, 2 as part, total as place, x2 as x, y2 as y from q where st2 = total and total - floor(total / 8.0) * 8.0 > 1e-6 and total - floor(total / 8.0) * 8.0 < 3.0)
select line_id, dash, part, round(place, 6) as place, round(x, 6) as x, round(y, 6) as y from (select * from own union all select * from b union all select * from c)"""
)
def dashes(spark: SparkSession, d: str) -> DataFrame:
    return S.dashes(V.vertex(spark, d), BY, 3.0, 5.0).select("line_id", "dash", "part", *r6("place", "x", "y"))


def _heading_sql(name: str, line: str, window: float) -> str:
    """Headings of a view of lines (line_id, seq, x, y, z), as a view."""
    return f"""{name}_g as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as gap from {line} window w as (partition by line_id order by seq)),
{name}_s as (select *, sum(gap) over (partition by line_id order by seq rows unbounded preceding) as station from {name}_g),
{name}_b as (select *, max(station) over (partition by line_id) - station as back from {name}_s),
{name}_h as (select line_id, arg_max(x, seq) as ex, arg_max(y, seq) as ey, arg_max(z, seq) as ez, coalesce(max(seq) filter (back >= {window}), min(seq)) as fs from {name}_b group by line_id),
{name}_k as (select h.*, h.ex - b.x as dx0, h.ey - b.y as dy0, h.ez - b.z as dz0, sqrt(pow(h.ex - b.x, 2) + pow(h.ey - b.y, 2)) as run from {name}_h h join {name}_b b on h.line_id = b.line_id and b.seq = h.fs),
{name} as (select line_id, ex, ey, ez, case when run >= 1e-6 then dx0 / run end as dx, case when run >= 1e-6 then dy0 / run end as dy, case when run >= 1e-6 then dz0 / run end as grade from {name}_k)"""


_HEADING = _heading_sql("heading", "vertex", 20)


@query(V.with_(V.VERTEX, _HEADING) + "select line_id, round(dx, 6) as dx, round(dy, 6) as dy, round(grade, 6) as grade from heading")
def heading(spark: SparkSession, d: str) -> DataFrame:
    return S.heading(V.vertex(spark, d), BY, 20.0).select("line_id", *r6("dx", "dy", "grade"))


@query(
    V.with_(
        V.VERTEX,
        V.STRIP,
        "lb as (select line_id, seq, lx as x, ly as y, lz as z from strip)",
        "rb as (select line_id, seq, rx as x, ry as y, rz as z from strip)",
        _heading_sql("lh", "lb", 15),
        _heading_sql("rh", "rb", 15),
        "two as (select line_id, 0 as side, dx, dy, grade from lh where dx is not null union all select line_id, 1, dx, dy, grade from rh where dx is not null)",
        "m as (select line_id, avg(dx) as mx, avg(dy) as my, avg(grade) as g, arg_min(dx, side) as ox, arg_min(dy, side) as oy from two group by line_id)",
    )
    + """select line_id, round(case when sqrt(mx * mx + my * my) < 1e-6 then ox else mx / sqrt(mx * mx + my * my) end, 6) as dx, round(case when sqrt(mx * mx + my * my) < 1e-6 then oy else my / sqrt(mx * mx + my * my) end, 6) as dy, round(greatest(-0.06, least(0.06, g)), 6) as grade from m"""
)
def stub_heading(spark: SparkSession, d: str) -> DataFrame:
    """Where each lane's end points, from both of its bounds over 15 m, at a grade of 6 % at most."""
    s = V.strip(spark, d)
    sides = None
    for side, p in ((0, "l"), (1, "r")):
        h = S.heading(s.select("line_id", "seq", *(F.col(f"{p}{c}").alias(c) for c in "xyz")), BY, 15.0).withColumn("side", F.lit(side))
        sides = h if sides is None else sides.unionByName(h)
    return S.stub(sides, BY, "side", 0.06).select("line_id", *r6("dx", "dy", "grade"))


@query(
    V.with_(V.VERTEX, _HEADING)
    + """, p as (select *, 25.0::double as len, unnest(range(1, 6)) as k from heading)
select line_id, k::int as k, round(ex + dx * (k * len / 5), 6) as x, round(ey + dy * (k * len / 5), 6) as y, round(ez + grade * (k * len / 5), 6) as z from p"""
)
def extend_points(spark: SparkSession, d: str) -> DataFrame:
    v = V.vertex(spark, d)
    tips = v.groupBy("line_id").agg(F.max_by(F.struct("x", "y", "z"), "seq").alias("t")).select("line_id", "t.*")
    stubs = S.heading(v, BY, 20.0).join(tips, "line_id").withColumn("length", F.lit(25.0))
    return S.continuation(stubs, 5.0).select("line_id", "k", *r6("x", "y", "z"))


@query(
    V.with_(
        V.VERTEX,
        V.STRIP,
        "mid as (select *, (lx + rx) / 2 as mx, (ly + ry) / 2 as my from strip)",
        "g as (select *, coalesce(sqrt(pow(mx - lag(mx) over w, 2) + pow(my - lag(my) over w, 2)), 0) as gap from mid window w as (partition by line_id order by seq))",
        "st as (select *, sum(gap) over (partition by line_id order by seq rows unbounded preceding) as station from g)",
        "sg as (select *, lead(station) over w as st2, "
        + ", ".join(f"lead({s}{c}) over w as {s}{c}2" for s in "lr" for c in "xyz")
        + ", max(station) over (partition by line_id) as length from st window w as (partition by line_id order by seq))",
        "n as (select *, greatest(1, floor((length + 2.5) / 5.0))::int as n from sg where st2 > station and length >= 5)",
        "m as (select *, (length - (n * 5.0 - 2.5)) / 2 as margin from n)",
        "k as (select *, unnest(range(0, n)) as bar from m)",
        "e as (select *, margin + bar * 5.0 + edge * 2.5 as place from k, (values (0), (1)) t(edge))",
        "f as (select *, least(1, (place - station) / (st2 - station)) as t from e where place >= station and (place < st2 or (st2 = length and place >= st2)))",
    )
    + "select line_id, bar::int as bar, corner, round(px, 6) as x, round(py, 6) as y, round(pz, 6) as z from ("
    + " union all ".join(f"select line_id, bar, case when edge = 0 then {a} else {b} end as corner, {s}x + ({s}x2 - {s}x) * t as px, {s}y + ({s}y2 - {s}y) * t as py, {s}z + ({s}z2 - {s}z) * t as pz from f" for s, a, b in (("l", 0, 3), ("r", 1, 2)))
    + ")"
)
def zebra(spark: SparkSession, d: str) -> DataFrame:
    """Rings of the bars across every lane, as if it were a crossing."""
    return S.zebra_bars(V.strip(spark, d), BY, 2.5, 2.5).select("line_id", "bar", "corner", *r6("x", "y", "z"))


_PIERS = V.with_(
    V.VERTEX,
    V.STATION,
    V.GROUND,
    "sg as (select line_id, seq, x, y, z, station, lead(station) over w as st2, lead(x) over w as x2, lead(y) over w as y2 from station window w as (partition by line_id order by seq))",
    "p as (select *, row_number() over w as i, sum(st2 - station) over (partition by line_id order by seq rows unbounded preceding) + 12.5 as t from sg where st2 - station >= 1e-9 window w as (partition by line_id order by seq))",
    "q as (select *, i + least(0, min(floor(t / 25) - i) over (partition by line_id order by seq rows unbounded preceding)) as e from p)",
    "r as (select *, lag(e, 1, 0) over (partition by line_id order by seq) as before from q)",
    "pier as (select line_id, seq, x, y, z - 0.8 as top, ground - 0.5 as bottom, atan2(y2 - y, x2 - x) as heading from r join ground g on floor(x / 10) = g.ix and floor(y / 10) = g.iy where e > before and z - 0.8 - ground >= 1.0)",
)


def _piers(spark: SparkSession, d: str) -> DataFrame:
    due = S.thinned(V.vertex(spark, d), BY, 25.0).withColumns({"ix": F.floor(F.col("x") / 10), "iy": F.floor(F.col("y") / 10)}).join(V.ground(spark, d), ["ix", "iy"])
    top, heading = F.col("z") - 0.8, F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    return due.filter(top - F.col("ground") >= 1.0).select("line_id", "seq", "x", "y", top.alias("top"), (F.col("ground") - 0.5).alias("bottom"), heading.alias("heading"))


@query(_PIERS + "select line_id, seq, round(bottom, 6) as bottom, round(top, 6) as top, round(heading, 6) as heading from pier")
def pier_marks(spark: SparkSession, d: str) -> DataFrame:
    """Piers along lanes every 25 m, at the segments' starts, where the deck clears the ground by a metre."""
    return _piers(spark, d).select("line_id", "seq", *r6("bottom", "top", "heading"))


@query(
    _PIERS
    + """, c as (select *, 2.0 * u as along, 1.2 * v as across from pier, (values (0, -0.5, -0.5), (1, 0.5, -0.5), (2, 0.5, 0.5), (3, -0.5, 0.5)) t(k, u, v))
select line_id, seq, (k + 4 * up)::int as vertex, round(x + along * cos(heading) - across * sin(heading), 6) as x, round(y + along * sin(heading) + across * cos(heading), 6) as y, round(case when up = 1 then top else bottom end, 6) as z from c, (values (0), (1)) s(up)"""
)
def pier_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The corners of a box for each pier, 1.2 m wide and 2 m deep."""
    p = _piers(spark, d)
    c = M.box_corners(F.col("x"), F.col("y"), F.lit(1.2), F.lit(2.0), F.col("bottom"), F.col("top"), F.col("heading"))
    return p.select("line_id", "seq", F.explode(c).alias("c")).select("line_id", "seq", "c.*").select("line_id", "seq", "vertex", *r6("x", "y", "z"))


@query(V.with_(V.VERTEX) + "select line_id, seq, event_id from (select *, row_number() over (partition by line_id order by seq) - 1 as place from vertex) where place between 2 and 2 + line_id % 5")
def slice_line(spark: SparkSession, d: str) -> DataFrame:
    """Vertices from the third on, as many as the line's number says."""
    return S.sliced(V.vertex(spark, d), BY, F.lit(2), F.col("line_id") % 5 + 2).select("line_id", "seq", "event_id")


@query(
    V.with_(V.VERTEX)
    + """, a as (select *, lead(x) over w - x as fx, lead(y) over w - y as fy, x - lag(x) over w as bx, y - lag(y) over w as by_ from vertex window w as (partition by line_id order by seq)),
b as (select *, coalesce(fx / nullif(sqrt(fx * fx + fy * fy), 0), 0) + coalesce(bx / nullif(sqrt(bx * bx + by_ * by_), 0), 0) as tx, coalesce(fy / nullif(sqrt(fx * fx + fy * fy), 0), 0) + coalesce(by_ / nullif(sqrt(bx * bx + by_ * by_), 0), 0) as ty from a)
select line_id, seq, round(x - coalesce(ty / nullif(sqrt(tx * tx + ty * ty), 0), 0) * 1.5, 6) as left_x, round(y + coalesce(tx / nullif(sqrt(tx * tx + ty * ty), 0), 0) * 1.5, 6) as left_y from b"""
)
def ribbon_offset(spark: SparkSession, d: str) -> DataFrame:
    return S.offset_ribbon(V.vertex(spark, d), BY, 3.0).select("line_id", "seq", *r6("left_x", "left_y"))


@query(
    V.with_(V.VERTEX)
    + """, p as (select line_id % 10 as route, line_id, seq, x, y from vertex),
q as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as gap, coalesce(line_id <> lag(line_id) over w, false) as fresh from p window w as (partition by route order by line_id, seq))
select route, line_id, seq, row_number() over (partition by route order by line_id, seq)::int as at from q where not (fresh and gap < 500)"""
)
def route_join(spark: SparkSession, d: str) -> DataFrame:
    v = V.vertex(spark, d).withColumn("route", F.col("line_id") % 10)
    return S.join_route(v, ["route"], "line_id", 500.0).select("route", "line_id", "seq", "at")


@query(
    V.with_(V.VERTEX, V.STATION, _SEG2)
    + """, n as (select *, greatest(1, round_even(total / 30.0, 0)::int) as n from s2 where st2 > station),
p as (select *, total / n as step from n),
q as (select *, ceil(round(station / step, 9))::int as a, case when st2 = total then n else ceil(round(st2 / step, 9))::int - 1 end as b from p),
k as (select *, unnest(range(a, b + 1)) as k from q where b >= a)
select line_id, k::int as k, round(x + (k * step - station) / (st2 - station) * (x2 - x), 6) as x, round(y + (k * step - station) / (st2 - station) * (y2 - y), 6) as y from k"""
)
def fence_posts(spark: SparkSession, d: str) -> DataFrame:
    return S.posts(V.vertex(spark, d), BY, 30.0).select("line_id", "k", *r6("x", "y"))


@query(
    V.with_(V.VERTEX)
    + """select line_id, seq, round(case when lag(z) over w is null then lead(z) over w - z when lead(z) over w is null then z - lag(z) over w else (lead(z) over w - lag(z) over w) / 2 end, 6) as grad_z from vertex window w as (partition by line_id order by seq)"""
)
def gradient(spark: SparkSession, d: str) -> DataFrame:
    return S.gradients(V.vertex(spark, d), BY, "z").select("line_id", "seq", *r6("grad_z"))


@query(
    V.with_(V.VERTEX)
    + """, c as (select line_id, x * coalesce(lead(y) over w, first_value(y) over e) - coalesce(lead(x) over w, first_value(x) over e) * y as c from vertex
window w as (partition by line_id order by seq), e as (partition by line_id order by seq rows between unbounded preceding and unbounded following))
select line_id, round(sum(c) / 2, 4) as area from c group by line_id"""
)
def shoelace(spark: SparkSession, d: str) -> DataFrame:
    return S.ring_area(V.vertex(spark, d), BY).select("line_id", F.round("area", 4).alias("area"))


@query(
    V.with_(V.VERTEX, V.STATION, "len as (select line_id, sum(coalesce(gap, 0)) as length from seg group by line_id)")
    + """select count(*) as fences, round(sum(length), 4) as metres, sum(greatest(round_even(length / 30.0, 0)::bigint, 1) + 1)::bigint as posts from len where length >= 3"""
)
def fence_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.bround(F.col("length") / 30).cast("long"), F.lit(1).cast("long")) + 1
    return S.lengths(V.vertex(spark, d), BY).filter("length >= 3").agg(F.count("*").alias("fences"), F.round(F.sum("length"), 4).alias("metres"), F.sum(n).alias("posts"))


@query(
    V.with_(V.VERTEX, V.STATION, "len as (select line_id, sum(coalesce(gap, 0)) as length from seg group by line_id)")
    + """select count(*) as lanes, round(sum(length), 4) as metres, round(sum(length) / 11, 4) as seconds, (select min(z) from vertex) as z_min, (select max(z) from vertex) as z_max from len"""
)
def route_report(spark: SparkSession, d: str) -> DataFrame:
    v = V.vertex(spark, d)
    s = v.withColumn("gap", S.gap(BY, "seq")).agg(F.count_distinct("line_id").alias("lanes"), F.sum(F.coalesce("gap", F.lit(0.0))).alias("m"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return s.select("lanes", F.round("m", 4).alias("metres"), F.round(F.col("m") / 11, 4).alias("seconds"), "z_min", "z_max")
