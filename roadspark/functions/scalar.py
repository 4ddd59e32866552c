"""Row functions as Column expressions: projections of the globe, noise, decoding, sizes, names, numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two earth radii in use, metres.
LOCAL_RADIUS = 6_371_000.0
TILE_RADIUS = 6_378_137.0


def to_local(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Local metres (x, y) of WGS84 degrees, equirectangular around (lat0, lon0)."""
    x = (F.radians(lon) - math.radians(lon0)) * math.cos(math.radians(lat0)) * LOCAL_RADIUS
    return x, (F.radians(lat) - math.radians(lat0)) * LOCAL_RADIUS


def to_wgs84(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """(lat, lon) of local metres."""
    return F.degrees(y / LOCAL_RADIUS + math.radians(lat0)), F.degrees(x / (LOCAL_RADIUS * math.cos(math.radians(lat0))) + math.radians(lon0))


def slippy_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web-map tile."""
    n = float(1 << zoom)
    return F.floor((lon + 180) / 360 * n), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)


def decode_elevation(r: Column, g: Column, b: Column) -> Column:
    """Metres of a 24-bit elevation pixel in centimetres, two's complement; (128, 0, 0) is no data."""
    v = r * 65536 + g * 256 + b
    return F.when(v == 1 << 23, None).when(v > 1 << 23, (v - (1 << 24)) * 0.01).otherwise(v * 0.01)


# Multipliers and masks of the lattice hash, which must agree for equal terrain.
LATTICE_X = 374761393
LATTICE_Y = 668265263
LATTICE_SEED = 1442695041
LATTICE_MIX = 1274126177
LATTICE_32 = 0xFFFFFFFF
LATTICE_24 = 0xFFFFFF


def lattice(ix: Column, iy: Column, seed: int) -> Column:
    """A number in [0, 1] for each lattice point, from integer hashing: a function of position alone, so that tiles meet."""
    big = lambda v: F.lit(v).cast("long")
    h = (ix.cast("long") * big(LATTICE_X) + iy.cast("long") * big(LATTICE_Y) + big(seed * LATTICE_SEED)).bitwiseAND(big(LATTICE_32))
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * big(LATTICE_MIX)).bitwiseAND(big(LATTICE_32))
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(big(LATTICE_24)) / float(LATTICE_24)


def with_noise(df: DataFrame, x: str, y: str, cell: float, seed: int, out: str) -> DataFrame:
    """df with out: lattice values blended by the quintic smoothstep, a feature a cell, in [-1, 1].  In steps, as each
    is used several times by the next."""
    ease = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    d = df.withColumns({"_fx": F.col(x) / cell, "_fy": F.col(y) / cell}).withColumns({"_ix": F.floor("_fx"), "_iy": F.floor("_fy")})
    d = d.withColumns({"_tx": F.col("_fx") - F.col("_ix"), "_ty": F.col("_fy") - F.col("_iy")}).withColumns({"_u": ease(F.col("_tx")), "_v": ease(F.col("_ty"))})
    ix, iy, u, v = (F.col(c) for c in ("_ix", "_iy", "_u", "_v"))
    rows = [lattice(ix, iy + j, seed) * (1 - u) + lattice(ix + 1, iy + j, seed) * u for j in (0, 1)]
    return d.withColumn(out, (rows[0] * (1 - v) + rows[1] * v) * 2.0 - 1.0).drop("_fx", "_fy", "_ix", "_iy", "_tx", "_ty", "_u", "_v")


def with_fbm(df: DataFrame, x: str, y: str, out: str, *, metres: float = 140.0, octaves: int = 4, roughness: float = 0.45, warp: float = 0.35, seed: int = 0) -> DataFrame:
    """df with out: octaves of value noise, each of half the size and roughness times the height of the one before;
    with warp the positions are first bent by noise of twice the size, y by the x already bent."""
    d = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double"), out: F.lit(0.0)})
    if warp:
        for axis, step in (("_x", 101), ("_y", 202)):
            d = with_noise(d, "_x", "_y", metres * 2, seed + step, "_n").withColumn(axis, F.col(axis) + F.col("_n") * (metres * warp))
    for o in range(max(octaves, 1)):
        d = with_noise(d, "_x", "_y", max(metres, 1e-6) / 2**o, seed + 7 * o, "_n").withColumn(out, F.col(out) + F.col("_n") * roughness**o)
    return d.drop("_x", "_y", "_n")


def pick_height(draw: Column, area: Column, *, low: float = 6.0, high: float = 45.0, floor_height: float = 3.5, bias: float = 0.35) -> tuple[Column, Column]:
    """Height (whole floors) and floors of a building from a uniform draw; large plots lean taller."""
    pull = F.least(F.lit(1.0), area / 2500.0)
    h = low + (high - low) * F.pow(draw, 1 - pull * bias) * (pull * 0.65 + 0.35)
    floors = F.greatest(F.lit(1), F.bround(h / floor_height).cast("int"))
    return floors * floor_height, floors


def taper(aspect: Column, strength: float, *, plain: float = 1.5, elongated: float = 3.0, floor: float = 0.30) -> Column:
    """strength up to the aspect plain, then in a line down to floor at elongated, to four places; a strength of floor
    or less, or an unknown aspect, leaves it as it is."""
    if strength <= floor:
        return F.lit(float(strength))
    share = F.least((aspect - plain) / max(elongated - plain, 1e-6), F.lit(1.0))
    return F.when(aspect > plain, F.bround(strength + (floor - strength) * share, 4)).otherwise(F.lit(float(strength)))


def framing_distance(radius: Column, height: Column, *, lens: float = 50.0, sensor: float = 36.0, resolution: tuple[int, int] = (1024, 1024), elevation_deg: float = 35.0, margin: float = 1.25) -> Column:
    """Camera distance from the middle of a standing cylinder at which all of it is in view; null without an extent."""
    tilt, wide = math.radians(elevation_deg), sensor / (2 * lens)
    tall = wide * min(resolution) / max(resolution)
    # a point at (out from the axis towards the camera, up from the middle) is so far before the middle, and so high
    before = lambda out, up: out * math.cos(tilt) + up * math.sin(tilt)
    above = lambda out, up: up * math.cos(tilt) - out * math.sin(tilt)
    rims = [(out, up) for out in (radius, -radius) for up in (height / 2, -height / 2)]
    in_height = [before(*p) + F.abs(above(*p)) / tall for p in rims]
    # across the picture the whole upper circle counts
    in_width = height / 2 * math.sin(tilt) + radius * math.sqrt(math.cos(tilt) ** 2 + 1 / wide**2)
    return F.when((radius > 0) & (height > 0), F.greatest(in_width, *in_height) * margin)


def camera_pose(cx: Column, cy: Column, base: Column, height: Column, distance: Column, axis_deg: Column, *, off_axis_deg: float = 35.0, elevation_deg: float = 35.0) -> tuple[Column, Column, Column]:
    """Where the camera stands: off a building's long axis, above its middle."""
    theta, phi = F.radians(axis_deg + off_axis_deg), math.radians(elevation_deg)
    return cx + distance * math.cos(phi) * F.cos(theta), cy + distance * math.cos(phi) * F.sin(theta), base + height / 2 + distance * math.sin(phi)


def round_to_8(v: Column) -> Column:
    """The nearest multiple of 8."""
    return F.bround(v / 8).cast("long") * 8


def sheet_name(prefix: str, floors: Column, index: Column) -> Column:
    return F.format_string(f"{prefix}_f%02d_%03d.png", floors, index)


def sheet_floors(name: Column) -> Column:
    """The floors that a sheet's file name declares; null if none."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.nullif(F.regexp_extract(base, r"_f(\d+)(?=[_.])", 1), F.lit("")).cast("int")


def floor_spec(spec: Column) -> Column:
    """'3-6,10' as sorted distinct numbers."""
    part = lambda p: F.split(F.trim(p), "-")
    one = lambda p: F.sequence(F.element_at(part(p), 1).cast("int"), F.element_at(part(p), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), one))))


def stable_seed(text: Column) -> Column:
    return F.crc32(text.cast("binary")) % 100000


def attempt_seed(seed: Column, index: Column, attempt: Column) -> Column:
    return seed + index + attempt * 10007


def attribute(tags: Column, key: str, default: str | None = None) -> Column:
    """A tag of a string map, or a default."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(default))


#: Lane subtypes that carry vehicles.
ROAD_SUBTYPES = ("road", "highway", "bus_lane")


def surface_group(tags: Column, *, road_subtypes: tuple[str, ...] = ROAD_SUBTYPES, crosswalks: bool = True, walkways: bool = False) -> Column:
    """The group of a lane by its tags: roads, junctions where they tell a turn, crossings and footways if wanted;
    null for what isn't drawn."""
    sub = F.coalesce(attribute(tags, "subtype"), F.lit(""))
    return (
        F.when(sub.isin(*road_subtypes) & F.map_contains_key(tags, "turn_direction"), "Junctions").when(sub.isin(*road_subtypes), "Roads")
        .when((sub == "crosswalk") & F.lit(crosswalks), "Crosswalks").when((sub == "walkway") & F.lit(walkways), "Walkways")
    )


def line_group(tags: Column, *, stop_lines: bool = True, stripes: bool = True, curbs: bool = True, markings: bool = True) -> tuple[Column, Column, Column]:
    """Group, width and whether it is dashed, of a line by its type; null for what is never drawn (virtual lines)."""
    kind = F.coalesce(attribute(tags, "type"), F.lit(""))
    group = F.when(F.lit(stop_lines) & (kind == "stop_line"), "StopLines").when(F.lit(stripes) & (kind == "pedestrian_marking"), "CrosswalkStripes")
    group = group.when(F.lit(curbs) & (kind == "road_border"), "Curbs").when(F.lit(markings) & kind.isin("line_thin", "line_thick"), "LaneMarkings")
    # Painted widths in metres.
    width = F.when(kind == "stop_line", 0.4).when(kind == "line_thick", 0.3).when(kind == "line_thin", 0.15)
    return group, F.when(group.isin("StopLines", "LaneMarkings"), width), (group == "LaneMarkings") & (F.coalesce(attribute(tags, "subtype"), F.lit("")) == "dashed")


def overridden(base: Column, override: Column) -> Column:
    """An override, where there is one."""
    return F.coalesce(override, base)


def lane_pixels(width: Column, length: Column, *, texel: float = 0.05, step: int = 32, page: int = 4096) -> tuple[Column, Column]:
    """Texels across and along a lane's strip: across in whole steps, both within the page; 0, 0 without an extent."""
    some = (width > 0) & (length > 0)
    w = F.greatest(F.lit(step), F.least(F.ceil(width / texel / step) * step, F.lit(page)))
    h = F.greatest(F.lit(2), F.least(F.bround(length / texel).cast("long"), F.lit(page)))
    return F.when(some, w).otherwise(0).cast("long"), F.when(some, h).otherwise(0).cast("long")


def strip_uv(station: Column, length: Column, side: Column, x: Column, y: Column, w: Column, h: Column, page: int) -> tuple[Column, Column]:
    """Place on the atlas page, v upwards, of a vertex at a station on the left (side 0) or right (1) of a lane."""
    along = F.when(length > 0, station / length).otherwise(0.0)
    return (x + side * w) / float(page), 1 - (y + along * h) / float(page)


def describe(style: Column, floors: Column, height: Column, long_side: Column, short_side: Column, framing: str) -> Column:
    """The wording for one building: storeys, metres and proportions."""
    n = F.greatest(F.coalesce(floors, F.lit(1)), F.lit(0))
    n = F.when(n == 0, 1).otherwise(n)
    ratio = long_side / F.greatest(short_side, F.lit(1e-6))
    whole = lambda c: F.bround(c).cast("long").cast("string")
    shape = F.when(ratio < 1.25, "almost square in plan").otherwise(F.concat(F.lit("about "), F.format_string("%.1f", F.bround(ratio, 1)), F.lit(" times as wide as it is deep")))
    storeys = F.when(n == 1, "single-storey").otherwise(F.concat(n.cast("string"), F.lit(" storeys")))
    return F.concat(F.lit("photograph of "), style, F.lit(", "), storeys, F.lit(" and "), whole(F.coalesce(height, F.lit(0.0))), F.lit(" metres tall, footprint about "), whole(long_side), F.lit(" by "), whole(short_side), F.lit(" metres, "), shape, F.lit(", " + framing))


def faces_up(*normal_z: Column) -> Column:
    """Whether triangles with these z parts of normals face up; upright ones count as up."""
    return sum(normal_z, F.lit(0.0)) >= 0


def outward(lx: Column, ly: Column, rx: Column, ry: Column) -> tuple[Column, Column]:
    """Unit vector of a cross-section from right to left (the right bound's outward vector is its negative); 0 if it has no width."""
    dx, dy = lx - rx, ly - ry
    span = F.sqrt(dx * dx + dy * dy)
    return F.when(span < 1e-9, 0.0).otherwise(dx / span), F.when(span < 1e-9, 0.0).otherwise(dy / span)


def ray_to_box(x: Column, y: Column, dx: Column, dy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """How far along a direction a point leaves a box; 0 if it is outside already, or has no direction."""
    limit = lambda p, v, low, high: F.when(v > 1e-9, (high - p) / v).when(v < -1e-9, (low - p) / v)
    return F.greatest(F.lit(0.0), F.coalesce(F.least(limit(x, dx, x0, x1), limit(y, dy, y0, y1)), F.lit(0.0)))


def reach(edge: Column, obstacle: Column, *, clearance: float, least: float) -> Column:
    """How far to go: to the edge, or to clearance before an obstacle (null: none, and none is owed to it); 0 for less
    than the least."""
    length = F.when(obstacle.isNull(), edge).otherwise(F.least(edge, obstacle - clearance))
    return F.when((edge < least) | (length < least), 0.0).otherwise(length)


def to_scene_axes(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A y-up model turned z-up, without mirroring."""
    return x, -z, y


def rotated(x: Column, y: Column, radians: Column) -> tuple[Column, Column]:
    return x * F.cos(radians) - y * F.sin(radians), x * F.sin(radians) + y * F.cos(radians)


def planar_uv(x: Column, y: Column, x0: float, y0: float, tile: float) -> tuple[Column, Column]:
    return (x - x0) / tile, (y - y0) / tile


def tile_distance(blown: Column, sd: Column, seam: Column) -> Column:
    """How far a tile's score is from usable; 0 if it is."""
    over = lambda c: F.greatest(F.lit(0.0), c)
    return over(blown - 0.01) * 100 + over(sd - 70.0) / 10 + over(4.0 - sd) / 10 + over(F.abs(seam - 1) - 0.4)


def tile_usable(blown: Column, sd: Column, seam: Column) -> Column:
    return (blown <= 0.01) & sd.between(4.0, 70.0) & seam.between(0.6, 1.4)


def bays_for(width: Column, bay: float = 3.0) -> Column:
    return F.greatest(F.lit(1), F.bround(width / bay).cast("int"))


def pixel_size(floors: Column, bays: Column, ground_ratio: Column, per_floor: int = 128, per_bay: int = 128) -> tuple[Column, Column]:
    """A sheet's width and height, multiples of 8, at so many texels a bay and a floor."""
    at_least_8 = lambda v: F.greatest(F.lit(8).cast("long"), round_to_8(v))
    return at_least_8(bays * float(per_bay)), at_least_8((ground_ratio + floors - 1) * float(per_floor))


def floor_lines(floors: Column, ground_ratio: Column) -> Column:
    """Heights of the floor lines of a front, 0 to exactly 1, whose ground floor is ground_ratio storeys high."""
    total = ground_ratio + floors - 1
    return F.transform(F.sequence(F.lit(0), floors), lambda k: F.when(k == 0, 0.0).when(k == floors, 1.0).otherwise((ground_ratio + k - 1) / total))


def bay_lines(bays: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), bays), lambda k: k / bays)


# Shares of a bay and a floor that openings take, on upper floors and the ground floor.
WINDOW = {"width": 0.52, "height": 0.55, "base": 0.25}
SHOPFRONT = {"width": 0.80, "height": 0.68, "base": 0.08}
PARAPET = 0.035


def windows(floors: Column, bays: Column, ground_ratio: Column, parapet: float = PARAPET) -> Column:
    """Openings (floor, bay, u0, u1, v0, v1) of a front; those that the parapet leaves no height are none."""
    lines = floor_lines(floors, ground_ratio)

    def of(floor: Column) -> Column:
        part = lambda k: F.when(floor == 0, SHOPFRONT[k]).otherwise(WINDOW[k])
        v0, v1 = F.get(lines, floor), F.get(lines, floor + 1)
        top, bottom = F.least(v0 + (v1 - v0) * (part("base") + part("height")), F.lit(1 - parapet)), v0 + (v1 - v0) * part("base")
        one = lambda b: F.struct(floor.alias("floor"), b.alias("bay"), ((b + 0.5) / bays - part("width") / (bays * 2)).alias("u0"), ((b + 0.5) / bays + part("width") / (bays * 2)).alias("u1"), bottom.alias("v0"), top.alias("v1"))
        return F.filter(F.transform(F.sequence(F.lit(0), bays - 1), one), lambda w: w["v1"] > w["v0"])

    return F.flatten(F.transform(F.sequence(F.lit(0), floors - 1), of))


def pixel_range(low: Column, high: Column, size: Column, *, flipped: bool = False) -> tuple[Column, Column]:
    """First and last + 1 pixel of a span of 0 to 1; flipped: 0 is the last row."""
    a, b = (1 - high, 1 - low) if flipped else (low, high)
    clamp = lambda c: F.greatest(F.lit(0), F.least(size, F.bround(c * size).cast("int")))
    return clamp(a), clamp(b)


def signed_normal(a: list[Column], b: list[Column], c: list[Column]) -> tuple[Column, Column, Column]:
    """Normal of a triangle of points (x, y, z)."""
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def quad_is_sane(a: list[Column], b: list[Column], c: list[Column], d: list[Column], tiny: float = 1e-9) -> Column:
    """Whether a quad's two triangles face the same side; false if both have next to no area."""
    n, m = signed_normal(a, b, c), signed_normal(a, c, d)
    dot = sum((p * q for p, q in zip(n, m)), F.lit(0.0))
    return (dot >= 0) & (sum((F.abs(p) for p in (*n, *m)), F.lit(0.0)) > tiny)


#: What a pixel of a drawn front shows.
ON_WALL, ON_SPANDREL, ON_PARAPET, ON_GLASS, ON_FRAME = range(5)


def in_row(row: Column, ranges: Column) -> Column:
    """Those of an array of structs with r0 and r1 whose rows hold a row."""
    return F.filter(ranges, lambda w: (row >= w["r0"]) & (row < w["r1"]))


def front_row(row: Column, openings: Column, plain: Column, width: int, line: int = 1) -> Column:
    """A row of a drawn front, a number a pixel, put together from runs: openings (those in_row(): structs r0, r1, c0, c1, from
    left to right, none over another) are glass within a frame `line` pixels wide; what lies between them is plain."""

    def run(w: Column, i: Column) -> Column:
        n = w["c1"] - w["c0"]
        level = (row < w["r0"] + line) | (row >= w["r1"] - line) | (n <= 2 * line)
        upright = F.concat(F.array_repeat(F.lit(ON_FRAME), line), F.array_repeat(F.lit(ON_GLASS), n - 2 * line), F.array_repeat(F.lit(ON_FRAME), line))
        before = F.when(i > 0, F.get(openings, i - 1)["c1"]).otherwise(0)
        return F.concat(F.array_repeat(plain, w["c0"] - before), F.when(level, F.array_repeat(F.lit(ON_FRAME), n)).otherwise(upright))

    last = F.coalesce(F.try_element_at(openings, F.lit(-1))["c1"], F.lit(0))
    return F.concat(F.flatten(F.transform(openings, run)), F.array_repeat(plain, F.lit(width) - last))


def band_row(v: Column, height: int, line: int = 1) -> Column:
    """The first row of a line at a height v (0 at the pavement), kept within the picture."""
    return F.greatest(F.lit(0), F.least(F.lit(height - line), F.bround((1 - v) * height).cast("int") - line // 2))
