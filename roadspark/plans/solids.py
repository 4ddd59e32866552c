"""Queries that make meshes, kerbs, walls and lane frames from strips and rings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators import mesh as M
from roadspark.operators import sequence as S
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import BY, r6

_NUMBERED = "nr as (select *, row_number() over (partition by line_id order by seq) - 1 as i, count(*) over (partition by line_id) as n from {0})"


def _cross(a: str, b: str, c: str) -> list[str]:
    """The normal of a triangle of points, each named by a pattern with {} for the axis."""
    u, v = ([f"({q.format(x)} - {a.format(x)})" for x in "xyz"] for q in (b, c))
    return [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]


_N, _M = _cross("l{}", "r{}", "r{}2"), _cross("l{}", "r{}2", "l{}2")
_QUADS = V.with_(
    V.VERTEX,
    V.STRIP,
    _NUMBERED.format("strip"),
    "q as (select *, " + ", ".join(f"lead({s}{c}) over w as {s}{c}2" for s in "lr" for c in "xyz") + " from nr window w as (partition by line_id order by seq))",
    "c as (select *, " + ", ".join(f"{e} as {n}{k}" for n, es in (("n", _N), ("m", _M)) for k, e in enumerate(es)) + " from q where i < n - 1)",
    "face as (select line_id, i::int as cell, n0 * m0 + n1 * m1 + n2 * m2 >= 0 and abs(n0) + abs(n1) + abs(n2) + abs(m0) + abs(m1) + abs(m2) > 1e-9 as sane, n2 + m2 >= 0 as up from c)",
)


@query(_QUADS + "select line_id, cell, case when sane then case when up then concat_ws(',', 2 * cell, 2 * cell + 1, 2 * cell + 3, 2 * cell + 2) else concat_ws(',', 2 * cell, 2 * cell + 2, 2 * cell + 3, 2 * cell + 1) end end as face from face where sane")
def ribbon_faces(spark: SparkSession, d: str) -> DataFrame:
    """The quads of every lane's surface."""
    f = M.strip_faces(V.strip(spark, d), BY).filter("sane")
    return f.select("line_id", "cell", F.array_join(F.transform("face", lambda x: x.cast("string")), ",").alias("face"))


@query(_QUADS + "select line_id, count(*) filter (sane) as faces, count(*) filter (not sane) as skipped from face group by line_id")
def ribbon_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Quads made and left out, of each lane."""
    f = M.strip_faces(V.strip(spark, d), BY)
    return f.groupBy("line_id").agg(F.count_if("sane").alias("faces"), F.count_if(~F.col("sane")).alias("skipped"))


@query(V.with_(V.VERTEX, V.STRIP, _NUMBERED.format("strip")) + "select line_id, (2 * i)::int as vertex, round(lx, 6) as x, round(ly, 6) as y, round(lz, 6) as z from nr where n >= 2 union all select line_id, (2 * i + 1)::int, round(rx, 6), round(ry, 6), round(rz, 6) from nr where n >= 2")
def ribbon_vertices(spark: SparkSession, d: str) -> DataFrame:
    return M.strip_vertices(V.strip(spark, d), BY).select("line_id", F.col("vertex").cast("int").alias("vertex"), *r6("x", "y", "z"))


def _tops(spark: SparkSession, d: str) -> DataFrame:
    """Five-cornered rings that end where they begin, some without area: id, seq, x, y, z."""
    f = V.footprint(spark, d)
    flat = F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("x1") - F.col("x0"))
    p = lambda u, v: F.struct((F.col("x0") + flat * u).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * v * F.when(F.col("id") % 10 == 0, 0.0).when(F.col("id") % 3 == 0, -1.0).otherwise(1.0)).alias("y"), F.col("mean_z").alias("z"))
    return f.select("id", F.posexplode(F.array(p(0.0, 0.0), p(1.0, 0.0), p(1.0, 1.0), p(0.5, 1.5), p(0.0, 1.0), p(0.0, 0.0))).alias("seq", "p")).select("id", "seq", "p.*")


_TOPS = """top as (select id, seq, x0 + case when id % 10 = 0 then 0 else x1 - x0 end * u as x, y0 + (y1 - y0) * v * case when id % 10 = 0 then 0.0::double when id % 3 = 0 then -1.0 else 1.0 end as y, mean_z as z
from footprint, (values (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.5, 1.5), (4, 0.0, 1.0), (5, 0.0, 0.0)) t(seq, u, v)),
ring as (select id, seq, x, y, z from top window w as (partition by id order by seq) qualify not (count(*) over (partition by id) > 2 and seq = max(seq) over (partition by id) and greatest(abs(x - first_value(x) over w), abs(y - first_value(y) over w), abs(z - first_value(z) over w)) < 1e-6))"""


@query(
    V.with_(V.FOOTPRINT, _TOPS)
    + """, t as (select id, seq, x, y, first_value(x) over w as x0, first_value(y) over w as y0, lead(x) over w as x2, lead(y) over w as y2 from ring window w as (partition by id order by seq)),
n as (select *, (x - x0) * (y2 - y0) - (y - y0) * (x2 - x0) as nz from t where seq between 1 and 3),
s as (select *, sum(nz) over (partition by id) >= 0 as up, sum(abs(nz)) over (partition by id) as size from n)
select id, seq::int as part, case when up then concat_ws(',', 0, seq, seq + 1) else concat_ws(',', 0, seq + 1, seq) end as face from s where size >= 1e-9"""
)
def fan_faces(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of closed rings, none of those without area."""
    f = M.fan_faces(_tops(spark, d), ["id"])
    return f.select("id", "part", F.array_join(F.transform("face", lambda x: x.cast("string")), ",").alias("face"))


@query(V.with_(V.FOOTPRINT, _TOPS) + "select id, seq::int as seq, round(x, 6) as x, round(y, 6) as y from top where seq < 5")
def close_ring(spark: SparkSession, d: str) -> DataFrame:
    """Rings without the vertex that closes them."""
    return S.closed_ring(_tops(spark, d), ["id"]).select("id", "seq", *r6("x", "y"))


@query(V.with_(V.VERTEX) + "select line_id, seq, round(z, 6) as lz, round(z + 0.15, 6) as rz from vertex where line_id in (select line_id from vertex group by 1 having count(*) >= 2)")
def curb_strip(spark: SparkSession, d: str) -> DataFrame:
    """Kerbs: lines stood up by 15 cm."""
    return M.curb(V.vertex(spark, d), BY, 0.15).select("line_id", "seq", *r6("lz", "rz"))


def _deck(spark: SparkSession, d: str) -> DataFrame:
    flags = {"lo": F.when(F.col("seq") % 11 == 0, None).otherwise(F.col("seq") % 5 > 0), "ro": F.col("seq") % 4 > 0, "cap_start": F.col("line_id") % 2 == 0, "cap_end": F.col("line_id") % 3 == 0}
    return V.strip(spark, d).withColumns(flags)


_DECK = V.with_(
    V.VERTEX,
    V.STRIP,
    _NUMBERED.format("strip"),
    "o as (select *, coalesce(case when seq % 11 = 0 then null else seq % 5 > 0 end, true) as lo, seq % 4 > 0 as ro from nr)",
    "p as (select *, lo and coalesce(lead(lo) over w, true) as l2, ro and coalesce(lead(ro) over w, true) as r2, 4 * i as a, 4 * i + 4 as b, 4 * n - 4 as t from o where n >= 2 window w as (partition by line_id order by seq))",
)


@query(
    _DECK
    + """select line_id, i::int as cell, 'bottom' as side, concat_ws(',', a + 1, a, b, b + 1) as face from p where i < n - 1
union all select line_id, i::int, 'left', concat_ws(',', a + 2, a, b, b + 2) from p where i < n - 1 and l2 union all select line_id, i::int, 'right', concat_ws(',', a + 1, a + 3, b + 3, b + 1) from p where i < n - 1 and r2
union all select line_id, 0, 'start', '0,1,3,2' from p where i = 0 and line_id % 2 = 0 union all select line_id, 0, 'end', concat_ws(',', t + 2, t + 3, t + 1, t) from p where i = 0 and line_id % 3 = 0"""
)
def deck_faces(spark: SparkSession, d: str) -> DataFrame:
    """Undersides, outer sides and caps of decks."""
    f = M.deck_shell(_deck(spark, d), BY, 0.8)[1]
    return f.select("line_id", "cell", "side", F.array_join(F.transform("face", lambda x: x.cast("string")), ",").alias("face"))


@query(
    _DECK
    + """select line_id, (4 * i + k)::int as vertex, round(case when k % 2 = 0 then lx else rx end, 6) as x, round(case when k % 2 = 0 then ly else ry end, 6) as y, round(case when k % 2 = 0 then lz else rz end - case when k < 2 then 0.8::double else 0 end, 6) as z from p, range(4) t(k)"""
)
def deck_vertices(spark: SparkSession, d: str) -> DataFrame:
    v = M.deck_shell(_deck(spark, d), BY, 0.8)[0]
    return v.select("line_id", F.col("vertex").cast("int").alias("vertex"), *r6("x", "y", "z"))


_WALL = V.with_(
    V.VERTEX,
    _NUMBERED.format("vertex"),
    "t as (select *, coalesce(lead(x) over w, x) - coalesce(lag(x) over w, x) as dx, coalesce(lead(y) over w, y) - coalesce(lag(y) over w, y) as dy from nr window w as (partition by line_id order by seq))",
    "o as (select *, case when sqrt(dx * dx + dy * dy) < 1e-9 then 0 else -dy / sqrt(dx * dx + dy * dy) * 0.3 end as ox, case when sqrt(dx * dx + dy * dy) < 1e-9 then 0 else dx / sqrt(dx * dx + dy * dy) * 0.3 end as oy, 4 * i as a, 4 * i + 4 as b, 4 * n - 4 as l from t where n >= 2)",
)


@query(_WALL + "select line_id, (4 * i + k)::int as vertex, round(x + ox * (k % 2), 6) as x, round(y + oy * (k % 2), 6) as y, round(z + case when k >= 2 then 0.9::double else 0 end, 6) as z from o, range(4) t(k)")
def wall_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Parapets along every line."""
    v = M.wall(V.vertex(spark, d), BY, 0.9, 0.3)[0]
    return v.select("line_id", F.col("vertex").cast("int").alias("vertex"), *r6("x", "y", "z"))


@query(
    _WALL
    + """select line_id, i::int as cell, 'top' as side, concat_ws(',', a + 2, a + 3, b + 3, b + 2) as face from o where i < n - 1
union all select line_id, i::int, 'outer', concat_ws(',', a, b, b + 2, a + 2) from o where i < n - 1 union all select line_id, i::int, 'inner', concat_ws(',', a + 1, a + 3, b + 3, b + 1) from o where i < n - 1
union all select line_id, 0, 'start', '0,2,3,1' from o where i = 0 union all select line_id, 0, 'end', concat_ws(',', l + 1, l + 3, l + 2, l) from o where i = 0"""
)
def wall_faces(spark: SparkSession, d: str) -> DataFrame:
    f = M.wall(V.vertex(spark, d), BY, 0.9, 0.3)[1]
    return f.select("line_id", "cell", "side", F.array_join(F.transform("face", lambda x: x.cast("string")), ",").alias("face"))


@query(
    V.with_(V.VERTEX, V.STATION)
    + """, f as (select *, seq % 4 > 0 as flag, row_number() over (partition by line_id order by seq) as p, count(*) over (partition by line_id) as n from station),
g as (select *, p - row_number() over (partition by line_id, flag order by seq) as g from f),
h as (select *, min(p) over r as a, max(p) over r as b, max(station) over r - min(station) over r as len from g window r as (partition by line_id, flag, g)),
c as (select *, flag or (b > a and a > 1 and b < n and len < 6) as closed from h),
i as (select *, p - row_number() over (partition by line_id order by seq) as k from c where closed)
select line_id, min(seq) as start, max(seq) as stop, round(max(station) - min(station), 6) as length from i group by line_id, k having max(seq) > min(seq) and max(station) - min(station) >= 8"""
)
def parapet_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a bound that get a parapet: on the outer edge, over gaps of under 6 m, 8 m long at least."""
    s = S.stations(V.vertex(spark, d), BY).withColumn("flag", F.col("seq") % 4 > 0)
    closed = S.close_gaps(s, BY, "flag", 6.0)
    runs = S.runs(closed, BY, "closed")
    at = s.select("line_id", F.col("seq").alias("start"), F.col("station").alias("s0")), s.select("line_id", F.col("seq").alias("stop"), F.col("station").alias("s1"))
    out = runs.join(at[0], ["line_id", "start"]).join(at[1], ["line_id", "stop"]).withColumn("length", F.col("s1") - F.col("s0"))
    return out.filter("length >= 8").select("line_id", "start", "stop", *r6("length"))


@query(V.with_(V.VERTEX, V.STRIP) + ", n as (select *, sqrt(pow(lx - rx, 2) + pow(ly - ry, 2)) as span from strip) select line_id, seq, round(case when span < 1e-9 then 0 else (lx - rx) / span end, 6) as nx, round(case when span < 1e-9 then 0 else (ly - ry) / span end, 6) as ny from n")
def outward_normals(spark: SparkSession, d: str) -> DataFrame:
    nx, ny = C.outward(*(F.col(c) for c in ("lx", "ly", "rx", "ry")))
    return V.strip(spark, d).select("line_id", "seq", F.round(nx, 6).alias("nx"), F.round(ny, 6).alias("ny"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Buildings with a court: id, ring, seq, x, y, base, height; some outlines run the other way round."""
    f = V.footprint(spark, d)
    x, y = ["x0", "x1", "x1", "x0"], ["y0", "y0", "y1", "y1"]
    outer = [F.struct(F.lit(0).alias("ring"), F.when(F.col("id") % 2 == 0, k).otherwise(3 - k).alias("seq"), F.col(a).alias("x"), F.col(b).alias("y")) for k, (a, b) in enumerate(zip(x, y))]
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inner = [F.struct(F.lit(1).alias("ring"), F.lit(k).alias("seq"), ((F.col(a) + mx) / 2).alias("x"), ((F.col(b) + my) / 2).alias("y")) for k, (a, b) in enumerate(zip(x, y))]
    b = f.select("id", "mean_z", F.explode(F.array(*outer, *inner)).alias("p")).select("id", "p.*", F.col("mean_z").alias("base"), ((F.col("mean_z") + 1) * 3.5).alias("height"))
    return b


_BLOCKS = """corner as (select * from (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) t(k, u, v)),
block as (select id, 0 as ring, case when id % 2 = 0 then k else 3 - k end as seq, case when u = 1 then x1 else x0 end as x, case when v = 1 then y1 else y0 end as y, mean_z as base, (mean_z + 1) * 3.5::double as height from footprint, corner
union all select id, 1, k, (case when u = 1 then x1 else x0 end + (x0 + x1) / 2) / 2, (case when v = 1 then y1 else y0 end + (y0 + y1) / 2) / 2, mean_z, (mean_z + 1) * 3.5::double from footprint, corner),
shoe as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from block window w as (partition by id, ring order by seq)),
turn as (select *, sum(x * y2 - x2 * y) over (partition by id, ring) as area from shoe),
put as (select id, ring, x, y, base, height, case when (ring = 0 and area < 0) or (ring > 0 and area >= 0) then 3 - seq else seq end as edge from turn),
nx as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from put window w as (partition by id, ring order by edge)),
sp as (select *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) as span from nx),
rn as (select *, sum(span) over (partition by id, ring) as len, sum(span) over (partition by id, ring order by edge rows unbounded preceding) - span as run from sp),
sc as (select *, case when len > 1e-9 then greatest(1, round_even(len / 12, 0)) / len else 0 end as k from rn),
wall as (select id, ring, edge, c.corner, case when c.far = 1 then x2 else x end as x, case when c.far = 1 then y2 else y end as y, case when c.up = 1 then base + height else base - 1 end as z, (run + c.far * span) * k as u, case when c.up = 1 then 1 else -1.0 / height end as v
  from sc, (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(corner, far, up))"""


@query(V.with_(V.FOOTPRINT, _BLOCKS) + "select id, ring, edge::int as edge, corner, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(u, 6) as u, round(v, 6)::double as v from wall")
def extrude_walls(spark: SparkSession, d: str) -> DataFrame:
    """Walls of buildings with a court, facing outwards, with their place on the sheet."""
    w = M.extruded(_blocks(spark, d), ["id"])
    return w.select("id", "ring", F.col("edge").cast("int").alias("edge"), "corner", *r6("x", "y", "z", "u", "v"))


_FRAME = V.with_(
    V.VERTEX,
    V.STRIP,
    "mid as (select *, (lx + rx) / 2 as mx, (ly + ry) / 2 as my, sqrt(pow(lx - rx, 2) + pow(ly - ry, 2)) as w0 from strip)",
    "g as (select *, coalesce(sqrt(pow(mx - lag(mx) over w, 2) + pow(my - lag(my) over w, 2)), 0) as gap from mid window w as (partition by line_id order by seq))",
    "st as (select *, sum(gap) over (partition by line_id order by seq rows unbounded preceding) as station from g)",
    "frame as (select *, max(station) over (partition by line_id) as length, median(w0) over (partition by line_id) as width from st)",
)


@query(_FRAME + "select line_id, seq, round(station, 6) as station, round(length, 6) as length, round(width, 6) as width from frame")
def lane_frame(spark: SparkSession, d: str) -> DataFrame:
    return M.lane_frame(V.strip(spark, d), BY).select("line_id", "seq", *r6("station", "length", "width"))


_W = ["x", "y"]


def _weights(a: str, b: str, c: str) -> str:
    e0, e1, o = ([f"({q}{x} - {a}{x})" for x in _W] for q in (b, c, "p"))
    dot = lambda p, q: f"({p[0]} * {q[0]} + {p[1]} * {q[1]})"
    return f"{dot(e0, e0)} as d00, {dot(e0, e1)} as d01, {dot(e1, e1)} as d11, {dot(o, e0)} as d20, {dot(o, e1)} as d21"


@query(
    _FRAME
    + """, cell as (select line_id, row_number() over w as i, lx as ax, ly as ay, rx as bx, ry as by_, lead(rx) over w as cx, lead(ry) over w as cy, lead(lx) over w as dx, lead(ly) over w as dy, station / length as u, lead(station) over w / length as u2 from frame where length > 0 window w as (partition by line_id order by seq)),
tri as (select line_id, 2 * i as nr, ax, ay, bx as fx, by_ as fy, cx, cy, u as ua, 0.0::double as va, u as ub, 1.0::double as vb, u2 as uc, 1.0::double as vc from cell where cx is not null
  union all select line_id, 2 * i + 1, ax, ay, cx, cy, dx, dy, u, 0.0, u2, 1.0, u2, 0.0 from cell where cx is not null),
pt as (select line_id, event_id, x + 0.7 as px, y + (event_id % 9) * 0.5 - 2 as py from vertex),
m as (select *, """
    + _weights("a", "f", "c")
    + """ from pt join tri using (line_id)),
n as (select *, case when abs(d00 * d11 - d01 * d01) < 1e-12 then 1e-12 else d00 * d11 - d01 * d01 end as det from m),
b as (select *, (d11 * d20 - d01 * d21) / det as beta, (d00 * d21 - d01 * d20) / det as gamma from n),
a as (select *, 1 - beta - gamma as alpha from b),
f as (select *, row_number() over (partition by line_id, event_id order by least(alpha, beta, gamma) desc, nr) as k from a)
select line_id, event_id, round(alpha * ua + beta * ub + gamma * uc, 5) as u, round(alpha * va + beta * vb + gamma * vc, 5) as v from f where k = 1"""
)
def lane_project(spark: SparkSession, d: str) -> DataFrame:
    """Places along and across their lane of the paint's corners: every vertex has one."""
    p = V.vertex(spark, d).select("line_id", "event_id", (F.col("x") + 0.7).alias("px"), (F.col("y") + F.col("event_id") % 9 * 0.5 - 2).alias("py"))
    return M.lane_project(p, M.lane_frame(V.strip(spark, d), BY), BY, "event_id").select("line_id", "event_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(_FRAME + "select line_id, seq, side::int as side, round((64 + side * 96) / 512.0::double, 6) as u, round(1 - (32 + case when length > 0 then station / length else 0 end * 400) / 512, 6) as v from frame, range(2) t(side)")
def strip_uvs(spark: SparkSession, d: str) -> DataFrame:
    """Places on the atlas page of a strip that was put at (64, 32), 96 wide and 400 high."""
    f = M.lane_frame(V.strip(spark, d), BY).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    u, v = C.strip_uv(F.col("station"), F.col("length"), F.col("side"), F.lit(64), F.lit(32), F.lit(96), F.lit(400), 512)
    return f.select("line_id", "seq", "side", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query(V.with_(V.VERTEX) + "select event_id, round((x - 10) / 4, 6) as u, round((y + 5) / 4, 6) as v, round(-z, 6) as sy, round(y, 6) as sz from vertex")
def planar_uv(spark: SparkSession, d: str) -> DataFrame:
    """Places on a ground tile of 4 m, and a y-up model's axes as the scene has them."""
    u, v = C.planar_uv(F.col("x"), F.col("y"), 10.0, -5.0, 4.0)
    _, sy, sz = C.to_scene_axes(F.col("x"), F.col("y"), F.col("z"))
    return V.vertex(spark, d).select("event_id", *(F.round(c, 6).alias(n) for c, n in ((u, "u"), (v, "v"), (sy, "sy"), (sz, "sz"))))


_LOOSE = """tip as (select line_id, arg_max(event_id, seq) as last_id, arg_min(event_id, seq) as first_id from vertex group by line_id),
more as (select first_id as id, k, -k * 1.0::double as x from tip, (values (1), (2)) t(k) where line_id % 2 = 0 union all select last_id, k, 1000 + k from tip, (values (1), (2)) t(k) where line_id % 3 = 0),
whole as (select line_id, 0 as part, -k as place, more.x from tip join more on more.id = first_id union all select line_id, 1, seq, x from vertex union all select line_id, 2, k, more.x from tip join more on more.id = last_id)"""


@query(V.with_(V.VERTEX, _LOOSE) + "select line_id, row_number() over (partition by line_id order by part, place)::int as k, round(x, 6)::double as x from whole")
def extended_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with what continues them beyond either end, known by the end points' ids."""
    v = V.vertex(spark, d).select("line_id", "seq", F.col("event_id").alias("point_id"), "x", "y", "z")
    tips = v.groupBy("line_id").agg(F.min_by("point_id", "seq").alias("first"), F.max_by("point_id", "seq").alias("last"))
    two = F.explode(F.array(F.lit(1), F.lit(2)))
    head = tips.filter("line_id % 2 = 0").select(F.col("first").alias("point_id"), two.alias("k")).withColumn("x", -F.col("k") * 1.0)
    tail = tips.filter("line_id % 3 = 0").select(F.col("last").alias("point_id"), two.alias("k")).withColumn("x", F.col("k") + 1000.0)
    more = head.unionByName(tail).withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    return S.extended(v, more, BY, "point_id").select("line_id", F.col("at").alias("k"), *r6("x"))


_EDGE = """h as (select line_id, ex, ey, dx, dy from heading where dx is not null),
box as (select min(x) - 30 as x0, max(x) + 30 as x1, min(y) - 30 as y0, max(y) + 30 as y1 from vertex),
r as (select line_id, case when dx > 1e-9 then (x1 - ex) / dx when dx < -1e-9 then (x0 - ex) / dx end as tx, case when dy > 1e-9 then (y1 - ey) / dy when dy < -1e-9 then (y0 - ey) / dy end as ty from h, box)"""


def _heading_view() -> str:
    from roadspark.plans.sequences import _HEADING

    return _HEADING


@query(V.with_(V.VERTEX, _heading_view(), _EDGE) + "select line_id, round(greatest(0, coalesce(least(tx, ty), 0)), 5)::double as length from r")
def to_edge(spark: SparkSession, d: str) -> DataFrame:
    """How far each lane's end is from the map's edge, along its heading; the edge is 30 m beyond everything."""
    v = V.vertex(spark, d)
    box = v.agg((F.min("x") - 30).alias("x0"), (F.max("x") + 30).alias("x1"), (F.min("y") - 30).alias("y0"), (F.max("y") + 30).alias("y1"))  # one row
    tips = v.groupBy("line_id").agg(F.max_by("x", "seq").alias("x"), F.max_by("y", "seq").alias("y"))
    h = S.heading(v, BY, 20.0).filter("dx is not null").join(tips, "line_id").crossJoin(F.broadcast(box))
    return h.select("line_id", F.round(C.ray_to_box(*(F.col(c) for c in ("x", "y", "dx", "dy", "x0", "y0", "x1", "y1"))), 5).alias("length"))
