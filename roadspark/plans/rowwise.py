"""Queries of row functions: projections, noise, sizes, fronts, routing, wording; with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators import reports
from roadspark.operators.graph import stored
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6
from roadspark.sources import readers

_LL = "select event_id, 35.0::double + (event_id % 1000)::double / 10000 as lat, 139.0::double + (event_id % 777)::double / 10000 as lon from events"


def _latlon(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", (F.col("event_id") % 1000 / 10000 + 35.0).alias("lat"), (F.col("event_id") % 777 / 10000 + 139.0).alias("lon"))


@query(f"select event_id, round((radians(lon) - radians(139.0::double)) * cos(radians(35.0::double)) * 6371000.0::double, 4) as x, round((radians(lat) - radians(35.0::double)) * 6371000.0::double, 4) as y from ({_LL})")
def to_local(spark: SparkSession, d: str) -> DataFrame:
    x, y = C.to_local(F.col("lat"), F.col("lon"), 35.0, 139.0)
    return _latlon(spark, d).select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(V.with_(V.VERTEX) + "select event_id, round(degrees(y / 6371000.0::double + radians(35.0::double)), 9) as lat, round(degrees(x / (6371000.0::double * cos(radians(35.0::double))) + radians(139.0::double)), 9) as lon from vertex")
def to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = C.to_wgs84(F.col("x"), F.col("y"), 35.0, 139.0)
    return V.vertex(spark, d).select("event_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query(f"select event_id, floor((lon + 180) / 360 * 16384)::bigint as tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384)::bigint as ty from ({_LL})")
def slippy_tile(spark: SparkSession, d: str) -> DataFrame:
    tx, ty = C.slippy_tile(F.col("lat"), F.col("lon"), 14)
    return _latlon(spark, d).select("event_id", tx.alias("tx"), ty.alias("ty"))


@query("""with p as (select p_partkey, p_partkey % 256 as r, p_size * 5 % 256 as g, (p_partkey * 7) % 256 as b from part), v as (select p_partkey, r * 65536 + g * 256 + b as v from p)
select p_partkey, round(case when v = 8388608 then null when v > 8388608 then (v - 16777216) * 0.01::double else v * 0.01::double end, 4) as metres from v""")
def dem_decode(spark: SparkSession, d: str) -> DataFrame:
    m = C.decode_elevation(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256)
    return V.table(spark, d, "part").select("p_partkey", F.round(m, 4).alias("metres"))


def _lattice_sql(ix: str, iy: str, seed: int) -> str:
    h0 = f"((({ix})::bigint * {C.LATTICE_X} + ({iy})::bigint * {C.LATTICE_Y} + {seed * C.LATTICE_SEED}) & {C.LATTICE_32})"
    h1 = f"((xor({h0}, {h0} >> 13) * {C.LATTICE_MIX}) & {C.LATTICE_32})"
    return f"((xor({h1}, {h1} >> 16) & {C.LATTICE_24}) / {C.LATTICE_24}.0::double)"


@query(f"select event_id, round({_lattice_sql('event_id % 100 - 50', 'user_id', 3)}, 9) as v from events")
def lattice(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", F.round(C.lattice(F.col("event_id") % 100 - 50, F.col("user_id"), 3), 9).alias("v"))


def _noise_sql(name: str, before: str, cell: float, seed: int, out: str) -> str:
    """Views that add a column of noise, at px, py, to a view."""
    ease = lambda t: f"{t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10)"
    a, b, c, e = (_lattice_sql(f"ix + {i}", f"iy + {j}", seed) for j in (0, 1) for i in (0, 1))
    return f"""{name}a as (select *, floor(px / {cell!r}::double) as ix, floor(py / {cell!r}::double) as iy from {before}),
{name}b as (select *, px / {cell!r}::double - ix as tx, py / {cell!r}::double - iy as ty from {name}a),
{name}c as (select *, {ease("tx")} as u, {ease("ty")} as w from {name}b),
{name} as (select * exclude (ix, iy, tx, ty, u, w), (({a} * (1 - u) + {b} * u) * (1 - w) + ({c} * (1 - u) + {e} * u) * w) * 2 - 1 as {out} from {name}c)"""


def _fbm_sql(base: str, metres: float, octaves: int, roughness: float, warp: float, seed: int) -> str:
    """Views up to fbm, which has v, of a view with px and py."""
    parts = [_noise_sql("wx", base, metres * 2, seed + 101, "n"), f"wx2 as (select * replace (px + n * {metres * warp!r}::double as px) from wx)"]
    parts += [_noise_sql("wy", "wx2", metres * 2, seed + 202, "n2"), f"wy2 as (select * replace (py + n2 * {metres * warp!r}::double as py) from wy)"]
    at = "wy2"
    for o in range(octaves):
        parts.append(_noise_sql(f"o{o}", at, metres / 2**o, seed + 7 * o, f"v{o}"))
        at = f"o{o}"
    total = " + ".join(f"v{o} * {roughness**o!r}::double" for o in range(octaves))
    return ",\n".join(parts) + f",\nfbm as (select *, {total} as v from {at})"


@query(V.with_(V.VERTEX, "base as (select event_id, x as px, y as py from vertex)", _noise_sql("one", "base", 35.0, 9, "v")) + "select event_id, round(v, 6) as v from one")
def value_noise(spark: SparkSession, d: str) -> DataFrame:
    return C.with_noise(V.vertex(spark, d), "x", "y", 35.0, 9, "v").select("event_id", *r6("v"))


@query(V.with_(V.VERTEX, "base as (select event_id, x as px, y as py from vertex)", _fbm_sql("base", 140.0, 4, 0.45, 0.35, 3)) + "select event_id, round(v, 6) as v from fbm")
def fbm(spark: SparkSession, d: str) -> DataFrame:
    return C.with_fbm(V.vertex(spark, d), "x", "y", "v", seed=3).select("event_id", *r6("v"))


@query("with base as (select a * 210.0::double / 12 as px, b * 210.0::double / 12 as py from range(13) t(a), range(13) s(b)),\n" + _fbm_sql("base", 140.0, 4, 0.45, 0.35, 3) + ", span as (select max(v) - min(v) as s from fbm) select p_partkey, round(p_size / 10.0::double / s, 6) as scale from part, span")
def relief_scale(spark: SparkSession, d: str) -> DataFrame:
    """What brings the invented relief of a patch to each plot's metres from trough to peak."""
    one = readers.relief_scale(spark, amplitude=1.0, extent=210.0, steps=13, seed=3)
    return V.table(spark, d, "part").crossJoin(F.broadcast(one)).select("p_partkey", F.round(F.col("p_size") / 10 * F.col("scale"), 6).alias("scale"))


@query("""with a as (select p_partkey, p_size / 10.0::double as ratio from part)
select p_partkey, round_even(case when ratio > 1.5 then 0.55::double + (0.30::double - 0.55) * least((ratio - 1.5) / 1.5, 1.0) else 0.55 end, 4) as strength, 0.25::double as weak from a""")
def licence(spark: SparkSession, d: str) -> DataFrame:
    """How much of a strength is left for long plots; one below the floor stays as it is."""
    ratio = F.col("p_size") / 10
    return V.table(spark, d, "part").select("p_partkey", C.taper(ratio, 0.55).alias("strength"), C.taper(ratio, 0.25).alias("weak"))


_FRAME = """f as (select p_partkey, p_size::double as radius, (1 + p_size % 9) * 3.5::double as height from part),
g as (select *, height / 2 as half, cos(radians(35.0::double)) as c, sin(radians(35.0::double)) as s from f),
dist as (select *, 1.25 * greatest(half * s + radius * sqrt(c * c + pow(50.0::double / 18, 2)),
  radius * c + half * s + abs(half * c - radius * s) / 0.36, radius * c - half * s + abs(-half * c - radius * s) / 0.36,
  -radius * c + half * s + abs(half * c + radius * s) / 0.36, -radius * c - half * s + abs(-half * c + radius * s) / 0.36) as dist from g)"""


def _framed(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("radius"), ((F.col("p_size") % 9 + 1) * 3.5).alias("height"))
    return p.withColumn("dist", C.framing_distance(F.col("radius"), F.col("height")))


@query(V.with_(_FRAME) + "select p_partkey, round(dist, 6) as dist from dist")
def framing(spark: SparkSession, d: str) -> DataFrame:
    return _framed(spark, d).select("p_partkey", *r6("dist"))


@query(V.with_(_FRAME) + "select p_partkey, round(p_partkey + dist * c * cos(radians(p_partkey % 180 + 35.0::double)), 5) as x, round(dist * c * sin(radians(p_partkey % 180 + 35.0::double)), 5) as y, round(3 + half + dist * s, 5) as z from dist")
def camera_pose(spark: SparkSession, d: str) -> DataFrame:
    """Where the camera stands for each building."""
    p = _framed(spark, d)
    at = C.camera_pose(F.col("p_partkey").cast("double"), F.lit(0.0), F.lit(3.0), F.col("height"), F.col("dist"), F.col("p_partkey") % 180)
    return p.select("p_partkey", *(F.round(c, 5).alias(n) for c, n in zip(at, "xyz")))


_FRONT = "front as (select p_partkey, (1 + p_size % 9)::int as floors, (1 + p_partkey % 4)::int as bays, 1.0::double + (p_size % 5) / 5.0::double as ratio from part)"


def _fronts(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 9 + 1).cast("int").alias("floors"), (F.col("p_partkey") % 4 + 1).cast("int").alias("bays"), (F.col("p_size") % 5 / 5 + 1.0).alias("ratio"))


def _each_front(spark: SparkSession, d: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of all fronts, row by row of them: it goes by floors, bays and ratio alone, of which there are 9 * 4 * 5 at most, so it
    runs over these, and a broadcast of what it finds for each gives every front its rows."""
    fronts, of = _fronts(spark, d), ["floors", "bays", "ratio"]
    form = stored(fronts.select(*of).distinct().withColumn("p_partkey", F.monotonically_increasing_id()))
    found = f(form)
    rows = found.groupBy("p_partkey").agg(F.collect_list(F.struct(*found.columns[1:])).alias("rows"))
    known = form.join(rows, "p_partkey").select(*(F.col(c).alias(f"_{c}") for c in of), "rows")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of))
    return fronts.join(F.broadcast(known), same).select("p_partkey", F.explode("rows").alias("r")).select("p_partkey", "r.*")


@query(V.with_(_FRONT) + "select p_partkey, k::int as k, round(case when k = 0 then 0 when k = floors then 1 else (ratio + k - 1) / (ratio + floors - 1) end, 6)::double as line from (select *, unnest(range(0, floors + 1)) as k from front)")
def floor_lines(spark: SparkSession, d: str) -> DataFrame:
    """Storey lines of fronts whose ground floors are up to 1.8 storeys high, from 0 to exactly 1."""
    return _fronts(spark, d).select("p_partkey", F.posexplode(C.floor_lines(F.col("floors"), F.col("ratio"))).alias("k", "line")).select("p_partkey", "k", *r6("line"))


@query(V.with_(_FRONT) + "select p_partkey, k::int as k, round(k / bays::double, 6) as line from (select *, unnest(range(0, bays + 1)) as k from front)")
def bay_lines(spark: SparkSession, d: str) -> DataFrame:
    return _fronts(spark, d).select("p_partkey", F.posexplode(C.bay_lines(F.col("bays"))).alias("k", "line")).select("p_partkey", "k", *r6("line"))


_WINDOWS = _FRONT + """, fl as (select *, unnest(range(0, floors)) as floor from front),
ln as (select *, case when floor = 0 then 0 else (ratio + floor - 1) / (ratio + floors - 1) end as v0, case when floor + 1 = floors then 1 else (ratio + floor) / (ratio + floors - 1) end as v1,
  case when floor = 0 then 0.80::double else 0.52 end as ww, case when floor = 0 then 0.68::double else 0.55 end as wh, case when floor = 0 then 0.08::double else 0.25 end as wb from fl),
op as (select *, least(v0 + (v1 - v0) * (wb + wh), 1 - 0.035::double) as top, v0 + (v1 - v0) * wb as bottom, unnest(range(0, bays)) as bay from ln),
win as (select p_partkey, floor::int as floor, bay::int as bay, (bay + 0.5) / bays - ww / (2 * bays) as u0, (bay + 0.5) / bays + ww / (2 * bays) as u1, bottom as v0, top as v1 from op where top > bottom)"""


def _windows(fronts: DataFrame) -> DataFrame:
    return fronts.select("p_partkey", F.explode(C.windows(F.col("floors"), F.col("bays"), F.col("ratio"))).alias("w")).select("p_partkey", "w.*")


@query(V.with_(_WINDOWS) + "select p_partkey, floor, bay, round(u0, 6) as u0, round(u1, 6) as u1, round(v0, 6) as v0, round(v1, 6) as v1 from win")
def facade_windows(spark: SparkSession, d: str) -> DataFrame:
    """The openings of every front."""
    return _each_front(spark, d, lambda f: _windows(f).select("p_partkey", "floor", "bay", *r6("u0", "u1", "v0", "v1")))


@query(V.with_(_WINDOWS) + """select p_partkey, floor, bay, greatest(0, least(512, round_even((1 - v1) * 512, 0)::int)) as r0, greatest(0, least(512, round_even((1 - v0) * 512, 0)::int)) as r1,
greatest(0, least(256, round_even(u0 * 256, 0)::int)) as c0, greatest(0, least(256, round_even(u1 * 256, 0)::int)) as c1 from win""")
def window_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of every opening on a sheet of 256 by 512."""
    rows, cols = C.pixel_range(F.col("v0"), F.col("v1"), F.lit(512), flipped=True), C.pixel_range(F.col("u0"), F.col("u1"), F.lit(256))
    return _each_front(spark, d, lambda f: _windows(f).select("p_partkey", "floor", "bay", *(c.alias(n) for c, n in zip((*rows, *cols), ("r0", "r1", "c0", "c1")))))


_DRAWN = """rng as (select *, greatest(0, least(128, round_even((1 - v1) * 128, 0)::int)) as r0, greatest(0, least(128, round_even((1 - v0) * 128, 0)::int)) as r1,
  greatest(0, least(64, round_even(u0 * 64, 0)::int)) as c0, greatest(0, least(64, round_even(u1 * 64, 0)::int)) as c1 from win),
hit as (select p_partkey, r0, r1, c0, c1, unnest(range(r0, r1)) as r from rng where r1 > r0 and c1 > c0),
wide as (select *, c1 - c0 as w, r = r0 or r = r1 - 1 as level from hit),
open as (select p_partkey, r, sum(case when level or w < 3 then 0 else w - 2 end) as glass, sum(case when level or w < 3 then w else 2 end) as frame,
  sum(case when level or w < 3 then w * (c0 + c1 - 1) // 2 else c0 + c1 - 1 end) as place from wide group by 1, 2),
line as (select p_partkey, (ratio + k - 1) / (ratio + floors - 1) as v, k from (select *, unnest(range(1, floors)) as k from front)),
span as (select distinct p_partkey, unnest(range(greatest(0, least(128, round_even((1 - v) * 128, 0)::int)), greatest(0, least(128, round_even((1 - (v - 0.012)) * 128, 0)::int)))) as r from line),
band as (
  select distinct p_partkey, greatest(0, least(127, round_even((1 - v) * 128, 0)::int)) as r from (
    select p_partkey, case when floors = 1 then 1.0 else ratio / (ratio + floors - 1) end as v from front union all select p_partkey, 1 - 0.035::double from front)),
pic as (select p_partkey, unnest(range(0, 128)) as r from front)"""


@query(
    V.with_(_WINDOWS, _DRAWN)
    + """select pic.p_partkey, pic.r::int as row, coalesce(glass, 0)::int as glass, coalesce(frame, 0)::int as frame, coalesce(place, 0)::int as place,
case when pic.r < 4 then 64 - coalesce(glass, 0) - coalesce(frame, 0) else 0 end::int as parapet,
case when pic.r >= 4 and span.r is not null then 64 - coalesce(glass, 0) - coalesce(frame, 0) else 0 end::int as spandrel, band.r is not null as band
from pic left join open using (p_partkey, r) left join span using (p_partkey, r) left join band using (p_partkey, r)"""
)
def drawn_fronts(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every front's picture (64 by 128): how many pixels of each kind, the frames' columns summed, and whether
    the control drawing has a line there."""
    return _each_front(spark, d, _drawn)


def _drawn(f: DataFrame) -> DataFrame:
    w = C.windows(F.col("floors"), F.col("bays"), F.col("ratio"))
    lines = C.floor_lines(F.col("floors"), F.col("ratio"))

    def opening(x: Column) -> Column:
        r, c = C.pixel_range(x["v0"], x["v1"], F.lit(128), flipped=True), C.pixel_range(x["u0"], x["u1"], F.lit(64))
        return F.struct(*(v.alias(n) for v, n in zip((*r, *c), ("r0", "r1", "c0", "c1"))))

    def spandrel(v: Column) -> Column:
        r = C.pixel_range(v - 0.012, v, F.lit(128), flipped=True)
        return F.struct(r[0].alias("r0"), r[1].alias("r1"))

    inner = F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))
    p = f.select("p_partkey", F.transform(w, opening).alias("openings"), F.transform(inner, spandrel).alias("spandrels"), C.band_row(F.element_at(lines, 2), 128).alias("fascia"))
    top = C.pixel_range(F.lit(1 - 0.035), F.lit(1.0), F.lit(128), flipped=True)[1]
    # rows between two of these are alike, and are drawn once
    cuts = F.concat(F.array(F.lit(0), top, F.lit(128)), F.flatten(F.transform("openings", lambda w: F.array(w["r0"], w["r0"] + 1, w["r1"] - 1, w["r1"]))), F.flatten(F.transform("spandrels", lambda w: F.array(w["r0"], w["r1"]))))
    p = p.withColumn("cuts", F.array_sort(F.array_distinct(F.filter(cuts, lambda r: (r >= 0) & (r <= 128)))))
    p = p.select("*", F.explode(F.arrays_zip(F.slice("cuts", 1, F.size("cuts") - 1).alias("row"), F.slice("cuts", 2, F.size("cuts") - 1).alias("until"))).alias("part")).select("*", F.col("part.row").alias("row"), F.col("part.until").alias("until"))
    plain = F.when(F.col("row") < top, C.ON_PARAPET).when(F.size(C.in_row(F.col("row"), F.col("spandrels"))) > 0, C.ON_SPANDREL).otherwise(C.ON_WALL)
    p = p.select("p_partkey", "row", "until", "fascia", C.in_row(F.col("row"), F.col("openings")).alias("openings"), plain.alias("plain"))
    p = p.withColumn("pixels", C.front_row(F.col("row"), F.col("openings"), F.col("plain"), 64))
    count = lambda kind: F.size(F.filter("pixels", lambda x: x == kind))
    place = F.aggregate(F.transform("pixels", lambda x, c: F.when(x == C.ON_FRAME, c).otherwise(0)), F.lit(0), lambda a, x: a + x)
    p = p.select("p_partkey", "fascia", F.sequence("row", F.col("until") - 1).alias("rows"), count(C.ON_GLASS).alias("glass"), count(C.ON_FRAME).alias("frame"), place.alias("place"), count(C.ON_PARAPET).alias("parapet"), count(C.ON_SPANDREL).alias("spandrel"))
    p = p.withColumn("row", F.explode("rows"))
    band = (F.col("row") == F.col("fascia")) | (F.col("row") == C.band_row(F.lit(1 - 0.035), 128))
    return p.select("p_partkey", "row", "glass", "frame", "place", "parapet", "spandrel", band.alias("band"))


@query(V.with_(_FRONT) + "select p_partkey, greatest(8, round_even(bays * 100.0::double / 8, 0)::bigint * 8) as w, greatest(8, round_even((ratio + floors - 1) * 100 / 8, 0)::bigint * 8) as h, greatest(1, round_even(p_partkey % 40 / 3.0::double, 0)::int) as bays from front")
def pixel_size(spark: SparkSession, d: str) -> DataFrame:
    """Sheet sizes in multiples of eight, and the bays that walls of up to 39 m have."""
    w, h = C.pixel_size(F.col("floors"), F.col("bays"), F.col("ratio"), 100, 100)
    return _fronts(spark, d).select("p_partkey", w.alias("w"), h.alias("h"), C.bays_for(F.col("p_partkey") % 40).alias("bays"))


@query("""with l as (select p_partkey, p_retailprice / 300 - 3 as width, p_size * 4.0::double as length from part)
select p_partkey, case when width > 0 and length > 0 then greatest(32, least(ceil(width / 0.05 / 32)::bigint * 32, 512)) else 0 end as w, case when width > 0 and length > 0 then greatest(2, least(round_even(length / 0.05, 0)::bigint, 512)) else 0 end as h from l""")
def lane_pixels(spark: SparkSession, d: str) -> DataFrame:
    w, h = C.lane_pixels(F.col("p_retailprice") / 300 - 3, F.col("p_size") * 4.0, page=512)
    return V.table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("select p_partkey, format('facade_f{:02d}_{:03d}.png', (1 + p_size % 9)::int, (p_partkey % 1000)::int) as sheet, (1 + p_size % 9)::int as floors from part")
def sheet_name(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select("p_partkey", C.sheet_name("facade", (F.col("p_size") % 9 + 1).cast("int"), (F.col("p_partkey") % 1000).cast("int")).alias("sheet"))
    return p.withColumn("floors", C.sheet_floors(F.col("sheet")))


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(1 + p_size % 4, 4 + p_size % 4), [10]))), ',') as floors from part")
def floor_spec(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("p_size") % 4 + 1
    return V.table(spark, d, "part").select("p_partkey", F.array_join(C.floor_spec(F.concat(a, F.lit("-"), a + 2, F.lit(",10,10"))), ",").alias("floors"))


_KIND = """k as (select event_id, event_type, (props->>'k')::int as k from events)"""


@query(
    V.with_(_KIND)
    + """, g as (select event_id, k, case when event_type in ('click', 'view') and k % 11 = 0 then 'Junctions' when event_type in ('click', 'view') then 'Roads' when event_type = 'purchase' then 'Crosswalks' end as grp from k)
select event_id, grp, coalesce(k::varchar, '?') as k from g where grp is not null"""
)
def route_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Lanes by their tags: a turn makes a road lane a junction's, and leaves a crossing a crossing."""
    e = V.table(spark, d, "events").withColumn("tags", F.from_json("props", "map<string,string>"))
    k = C.attribute(F.col("tags"), "k")
    sub = F.when(F.col("event_type") == "click", "road").when(F.col("event_type") == "view", "bus_lane").when(F.col("event_type") == "purchase", "crosswalk").otherwise("walkway")
    own = F.create_map(F.lit("subtype"), sub)
    tags = F.when(k.cast("int") % 11 == 0, F.map_concat(own, F.create_map(F.lit("turn_direction"), F.lit("left")))).otherwise(own)
    return e.select("event_id", C.surface_group(tags).alias("grp"), F.coalesce(k, F.lit("?")).alias("k")).filter("grp is not null")


@query(
    V.with_(_KIND)
    + """, t as (select *, case k % 6 when 0 then 'stop_line' when 1 then 'pedestrian_marking' when 2 then 'road_border' when 3 then 'line_thin' when 4 then 'line_thick' else 'virtual' end as type from k)
select event_id, case type when 'stop_line' then 'StopLines' when 'pedestrian_marking' then 'CrosswalkStripes' when 'road_border' then 'Curbs' else 'LaneMarkings' end as grp,
case type when 'stop_line' then 0.4::double when 'line_thick' then 0.3 when 'line_thin' then 0.15 end as width, type in ('line_thin', 'line_thick') and event_type = 'click' as dashed from t where type <> 'virtual'"""
)
def route_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines by their type: stop lines, stripes, kerbs and markings with their widths; virtual lines are never drawn."""
    e = V.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("stop_line", "pedestrian_marking", "road_border", "line_thin", "line_thick", "virtual"))), F.col("k") % 6 + 1)
    tags = F.create_map(F.lit("type"), kind, F.lit("subtype"), F.when(F.col("event_type") == "click", "dashed").otherwise("solid"))
    group, width, dashed = C.line_group(F.col("tags"))
    return e.withColumn("tags", tags).select("event_id", group.alias("grp"), width.alias("width"), dashed.alias("dashed")).filter("grp is not null")


@query(
    """select event_id, value::double as z from events where event_type = 'signup' and not exists (select 1 from events where event_type = 'stripes') and exists (select 1 from events where event_type = 'signup')"""
)
def fallback_exists(spark: SparkSession, d: str) -> DataFrame:
    """Generated marks where the map has crossings and no marks of its own."""
    e = V.table(spark, d, "events")
    own = e.filter("event_type = 'stripes'").limit(1)
    return e.filter("event_type = 'signup'").join(own.select(F.lit(True).alias("there")), how="left_anti").select("event_id", F.col("value").alias("z"))


#: How far each group lies above the carriageway, and by how much lanes of one id modulo 8 differ.
Z_BIAS = {"Roads": 0.0, "Junctions": 0.002, "Crosswalks": 0.010, "LaneMarkings": 0.020, "StopLines": 0.022, "CrosswalkStripes": 0.026, "Walkways": 0.030, "Curbs": 0.0}
JITTER = {"Roads": 0.0002, "Junctions": 0.0002}

_LAYERS = "layer as (select * from (values " + ", ".join(f"('{g}', {z}::double, {JITTER.get(g, 0.0)}::double)" for g, z in Z_BIAS.items()) + ") t(grp, bias, jitter))"


@query(V.with_(V.VERTEX, _LAYERS) + "select event_id, round(z + bias + (line_id % 8) * jitter, 6) as z from vertex join layer on grp = case event_type when 'click' then 'Roads' when 'view' then 'Junctions' when 'purchase' then 'Crosswalks' else 'StopLines' end")
def z_bias(spark: SparkSession, d: str) -> DataFrame:
    """Layers over one another, and lanes of a layer a hair apart."""
    layers = spark.createDataFrame([(g, z, JITTER.get(g, 0.0)) for g, z in Z_BIAS.items()], "grp string, bias double, jitter double")  # eight rows
    grp = F.when(F.col("event_type") == "click", "Roads").when(F.col("event_type") == "view", "Junctions").when(F.col("event_type") == "purchase", "Crosswalks").otherwise("StopLines")
    v = V.vertex(spark, d).withColumn("grp", grp).join(F.broadcast(layers), "grp")
    return v.select("event_id", F.round(F.col("z") + F.col("bias") + F.pmod("line_id", F.lit(8)) * F.col("jitter"), 6).alias("z"))


@query(V.with_(V.VERTEX, V.STRIP, V.FOOTPRINT) + "select line_id, seq, round(lz - (select least((select min(lz) from strip), (select min(mean_z) - 1 from footprint)) as m), 6) as lz, round(rz - (select least((select min(lz) from strip), (select min(mean_z) - 1 from footprint)) as m), 6) as rz from strip")
def z_datum(spark: SparkSession, d: str) -> DataFrame:
    """Heights above the lowest point of the strips' left bounds and of all polygons."""
    s = V.strip(spark, d)
    low = s.agg(F.min("lz").alias("a")).crossJoin(V.footprint(spark, d).agg((F.min("mean_z") - 1).alias("b"))).select(F.least("a", "b").alias("datum"))
    return s.crossJoin(F.broadcast(low)).select("line_id", "seq", *(F.round(F.col(c) - F.col("datum"), 6).alias(c) for c in ("lz", "rz")))  # one row


@query(V.with_(V.VERTEX, V.STRIP) + """, n as (select line_id, least(count(*), greatest(count(*) - line_id % 3, 0)) as n from strip group by line_id)
select line_id, row_number() over (partition by line_id order by seq)::int - 1 as k, round((lx + rx) / 2, 6) as x, round((ly + ry) / 2, 6) as y, round((lz + rz) / 2, 6) as z from strip join n using (line_id) qualify row_number() over (partition by line_id order by seq) <= n""")
def centreline(spark: SparkSession, d: str) -> DataFrame:
    """The middle of two bounds as arrays, as far as the shorter of them goes."""
    point = lambda p: F.struct("seq", *(F.col(f"{p}{c}").alias(c) for c in "xyz"))
    a = V.strip(spark, d).groupBy("line_id").agg(F.sort_array(F.collect_list(point("l"))).alias("l"), F.sort_array(F.collect_list(point("r"))).alias("r"))
    a = a.withColumn("r", F.slice("r", 1, F.greatest(F.size("r") - (F.col("line_id") % 3).cast("int"), F.lit(0))))
    mid = F.zip_with(F.slice("l", 1, F.least(F.size("l"), F.size("r"))), F.slice("r", 1, F.least(F.size("l"), F.size("r"))), lambda p, q: F.struct(*(((p[c] + q[c]) / 2).alias(c) for c in "xyz")))
    return a.select("line_id", F.posexplode(mid).alias("k", "m")).select("line_id", "k", "m.*").select("line_id", "k", *r6("x", "y", "z"))


@query(
    V.with_(V.VERTEX)
    + """, q as (select line_id, seq, x as ax, y + 1.5 as ay, z as az, x as bx, y - 1.5 as by_, z as bz, lead(x) over w as cx, lead(y) over w - 1.5 + (seq % 3) * 2 as cy, lead(z) over w as cz, lead(x) over w as dx, lead(y) over w + 1.5 - (seq % 3) * 2 as dy, lead(z) over w as dz from vertex window w as (partition by line_id order by seq)),
n as (select *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as n0, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as n1, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as n2,
 (cy - ay) * (dz - az) - (cz - az) * (dy - ay) as m0, (cz - az) * (dx - ax) - (cx - ax) * (dz - az) as m1, (cx - ax) * (dy - ay) - (cy - ay) * (dx - ax) as m2 from q where cx is not null)
select line_id, seq, n0 * m0 + n1 * m1 + n2 * m2 >= 0 and abs(n0) + abs(n1) + abs(n2) + abs(m0) + abs(m1) + abs(m2) > 1e-9 as sane from n"""
)
def quad_sane(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line_id").orderBy("seq")
    v = V.vertex(spark, d).withColumns({f"{c}n": F.lead(c).over(w) for c in "xyz"}).filter("xn is not null")
    turn = (F.col("seq") % 3) * 2
    pts = [[F.col("x"), F.col("y") + 1.5, F.col("z")], [F.col("x"), F.col("y") - 1.5, F.col("z")], [F.col("xn"), F.col("yn") - 1.5 + turn, F.col("zn")], [F.col("xn"), F.col("yn") + 1.5 - turn, F.col("zn")]]
    return v.select("line_id", "seq", C.quad_is_sane(*pts).alias("sane"))


@query("select p_partkey, (17 + p_size + p_partkey % 5 * 10007)::bigint as seed, md5(p_name) as tag from part")
def seeds(spark: SparkSession, d: str) -> DataFrame:
    s = C.attempt_seed(F.lit(17).cast("long"), F.col("p_size"), F.col("p_partkey") % 5)
    return V.table(spark, d, "part").select("p_partkey", s.alias("seed"), F.md5(F.col("p_name").cast("binary")).alias("tag"))


@query(V.with_(V.PLOT) + """, p as (select id, least(1, area / 2500) as pull, (id % 97)::double / 97 as draw from plot), h as (select *, 6 + 39 * pow(draw, 1 - 0.35 * pull) * (0.35 + 0.65 * pull) as raw from p)
select id, greatest(1, round_even(raw / 3.5, 0)::int) as floors, greatest(1, round_even(raw / 3.5, 0)::int) * 3.5::double as height from h""")
def pick_height(spark: SparkSession, d: str) -> DataFrame:
    height, floors = C.pick_height((F.col("id") % 97) / 97, F.col("area"))
    return V.plot(spark, d).select("id", floors.alias("floors"), height.alias("height"))


@query(V.with_(V.PLOT) + """, q as (select *, case when id % 7 <> 0 then 1 end as ring from plot), w as (select id, area from q where ring is not null and area >= 400)
select id, area, (select count(*) from w) as total from w order by area desc, id limit 50""")
def worth_rebuilding(spark: SparkSession, d: str) -> DataFrame:
    """The fifty largest plots that have a footprint and 400 square metres, and how many there are in all: a top-k report."""
    p = V.plot(spark, d).withColumn("footprint", F.when(F.col("id") % 7 != 0, F.array(F.lit(1.0))))
    return reports.candidates(p, "footprint", "area", least=400.0, limit=50).select("id", "area", "total")


_SPARE = "base as (select p_partkey, p_size as s, case when p_partkey % 3 = 0 then p_size + 100 end as o from part)"


@query(V.with_(_SPARE) + "select p_partkey, coalesce(o, s) as v from base")
def merge_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Settings of which some are overridden."""
    p = V.table(spark, d, "part")
    return p.select("p_partkey", C.overridden(F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 100)).alias("v"))


@query("""with p as (select p_partkey, p_type, 1 + p_size % 9 as floors, (1 + p_size % 9) * 3.5::double as height, p_size::double as long_side, 1 + p_size % 7 + 0.5::double as short_side from part),
q as (select *, long_side / greatest(short_side, 1e-6) as ratio from p)
select p_partkey, 'photograph of ' || p_type || ', ' || case when floors = 1 then 'single-storey' else floors || ' storeys' end || ' and ' || round_even(height, 0)::bigint || ' metres tall, footprint about ' || round_even(long_side, 0)::bigint || ' by ' || round_even(short_side, 0)::bigint || ' metres, '
|| case when ratio < 1.25 then 'almost square in plan' else 'about ' || format('{:.1f}', round_even(ratio, 1)) || ' times as wide as it is deep' end || ', seen from the street' as words from q""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    """The wording for each building."""
    n = F.col("p_size") % 9 + 1
    words = C.describe(F.col("p_type"), n.cast("int"), n * 3.5, F.col("p_size").cast("double"), F.col("p_size") % 7 + 1.5, "seen from the street")
    return V.table(spark, d, "part").select("p_partkey", words.alias("words"))


@query("""with style as (select r_regionkey, r_name, row_number() over (order by md5('5:' || r_name)) - 1 as k, count(*) over () as n from region)
select p_partkey, r_name || ', flat light' as prompt from part join style on p_partkey % n = k""")
def styled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Styles in a shuffled order, dealt out in turn."""
    p = V.table(spark, d, "part").select("p_partkey", (F.col("p_partkey")).alias("turn"))
    styles = V.table(spark, d, "region").select(F.col("r_name").alias("style"))
    return reports.dealt(p, "turn", styles, "style", seed=5).select("p_partkey", F.concat("style", F.lit(", flat light")).alias("prompt"))


@query("""with w as (select p_partkey, p_brand as family, p_type as role, p_name as tag from part)
select family, count(*) as n, min(p_partkey) as first from w where role = (select min(role) from w) and contains(lower(tag), 'a') group by family""")
def find_weights(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue by family, role and a part of the tag."""
    w = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("family"), F.col("p_type").alias("role"), F.col("p_name").alias("tag"))
    role = w.agg(F.min("role").alias("role"))  # one row
    hits = w.join(F.broadcast(role), "role").filter(F.lower("tag").contains("a"))
    return hits.groupBy("family").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""select r_regionkey, '{"source":"' || r_name || '","zoom":' || (14 - r_regionkey) || ',"covered":' || format('{:.2f}', 0.25 + r_regionkey / 10.0) || ',"tiles":' || (r_regionkey * 3) || '}' as line from region""")
def coverage_json(spark: SparkSession, d: str) -> DataFrame:
    """Small records as JSON, with numbers of a fixed length."""
    k = F.col("r_regionkey")
    r = F.struct(F.col("r_name").alias("source"), (14 - k).alias("zoom"), (k / 10 + 0.25).cast("decimal(6,2)").alias("covered"), (k * 3).alias("tiles"))
    return V.table(spark, d, "region").select("r_regionkey", F.to_json(r).alias("line"))
