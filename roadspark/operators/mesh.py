"""Meshes from strips and rings, as rows: vertices with numbers, and faces as arrays of those numbers.

A strip is a row a cross-section: by, seq, and its left and right points lx, ly, lz, rx, ry, rz.  A ring is a row a
vertex: by, seq, x, y, z.  Vertices and faces are numbered from 0 within each shape, by the order of seq.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators.graph import stored

By = list[str]
SIDES = [f"{s}{c}" for s in "lr" for c in "xyz"]


def _numbered(df: DataFrame, by: By, order: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumns({"_i": (F.row_number().over(w.orderBy(order)) - 1).cast("int"), "_n": F.count("*").over(w).cast("int")})


def _point(prefix: str, behind: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}{behind}") for c in "xyz"]


def _ints(*numbers: Column) -> Column:
    return F.array(*(n.cast("int") for n in numbers))


def curb(df: DataFrame, by: By, height: float, order: str = "seq") -> DataFrame:
    """A line (x, y, z) stood up as a strip of a height; lines of one point are left out."""
    d = _numbered(df, by, order).filter("_n >= 2")
    return d.select(*by, order, F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("z").alias("lz"), F.col("x").alias("rx"), F.col("y").alias("ry"), (F.col("z") + height).alias("rz"))


def strip_vertices(df: DataFrame, by: By, order: str = "seq") -> DataFrame:
    """by, vertex, x, y, z: left and right of each cross-section in turn."""
    both = F.posexplode(F.array(*(F.struct(*(F.col(f"{s}{c}").alias(c) for c in "xyz")) for s in "lr"))).alias("_s", "_p")
    d = _numbered(df, by, order).filter("_n >= 2").select(*by, "_i", both)
    return d.select(*by, (F.col("_i") * 2 + F.col("_s")).alias("vertex"), "_p.*")


def strip_faces(df: DataFrame, by: By, order: str = "seq") -> DataFrame:
    """by, cell, face and sane of each two neighbouring cross-sections: the quad's vertex numbers, wound to face up;
    null where it is folded or empty, which callers count."""
    w = Window.partitionBy(*by).orderBy(order)
    d = _numbered(df, by, order).withColumns({f"{c}2": F.lead(c).over(w) for c in SIDES}).filter(F.col("_i") < F.col("_n") - 1)
    a, b, c, e = _point("l"), _point("r"), _point("r", "2"), _point("l", "2")
    up = C.faces_up(C.signed_normal(a, b, c)[2], C.signed_normal(a, c, e)[2])
    i = F.col("_i") * 2
    face = F.when(up, _ints(i, i + 1, i + 3, i + 2)).otherwise(_ints(i, i + 2, i + 3, i + 1))
    d = d.withColumn("sane", C.quad_is_sane(a, b, c, e))
    return d.select(*by, F.col("_i").alias("cell"), F.when(F.col("sane"), face).alias("face"), "sane")


def fan_faces(df: DataFrame, by: By, order: str = "seq") -> DataFrame:
    """by, part and face: a convex ring as a fan of triangles around its first vertex, all wound up or all down as the
    ring faces.  A last vertex that repeats the first is left out; rings of under three vertices, and without area,
    have no faces."""
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = _numbered(df, by, order).withColumns({f"{c}0": F.first(c).over(end) for c in "xyz"})
    same = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}0")) for c in "xyz")) < 1e-6
    d = d.filter(~((F.col("_n") > 2) & (F.col("_i") == F.col("_n") - 1) & same)).withColumn("_n", F.count("*").over(whole))
    d = d.withColumns({f"{c}2": F.lead(c).over(w) for c in "xyz"}).filter((F.col("_n") >= 3) & F.col("_i").between(1, F.col("_n") - 2))
    n = C.signed_normal(_point("", "0"), _point(""), _point("", "2"))
    d = d.withColumns({"_up": F.sum(n[2]).over(whole) >= 0, "_size": F.sum(F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2])).over(whole)}).filter("_size >= 1e-9")
    i = F.col("_i")
    return d.select(*by, i.alias("part"), F.when(F.col("_up"), _ints(F.lit(0), i, i + 1)).otherwise(_ints(F.lit(0), i + 1, i)).alias("face"))


def deck_shell(df: DataFrame, by: By, thickness: float, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a strip made a slab: its underside, the sides where two neighbouring cross-sections are
    both outer (boolean columns lo, ro; null counts as outer), and the caps at its ends (boolean columns cap_start,
    cap_end, alike in all of its rows)."""
    d = _numbered(df, by, order).filter((F.col("_n") >= 2) & F.lit(thickness > 0))
    four = F.array(*(F.struct(F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"), (F.col(f"{s}z") - low).alias("z")) for low in (thickness, 0.0) for s in "lr"))
    v = d.select(*by, "_i", F.posexplode(four).alias("_k", "_p")).select(*by, (F.col("_i") * 4 + F.col("_k")).alias("vertex"), "_p.*")
    w = Window.partitionBy(*by).orderBy(order)
    outer = lambda c: F.coalesce(F.col(c), F.lit(True)) & F.coalesce(F.lead(c).over(w), F.lit(True))
    d = d.withColumns({"_lo": outer("lo"), "_ro": outer("ro")})
    a, b = F.col("_i") * 4, F.col("_i") * 4 + 4
    inner, top = F.col("_i") < F.col("_n") - 1, (F.col("_n") - 1) * 4
    faces = [
        ("bottom", inner, _ints(a + 1, a, b, b + 1)), ("left", inner & F.col("_lo"), _ints(a + 2, a, b, b + 2)), ("right", inner & F.col("_ro"), _ints(a + 1, a + 3, b + 3, b + 1)),
        ("start", (F.col("_i") == 0) & F.col("cap_start"), _ints(F.lit(0), F.lit(1), F.lit(3), F.lit(2))), ("end", (F.col("_i") == 0) & F.col("cap_end"), _ints(top + 2, top + 3, top + 1, top)),
    ]
    return v, _faces(d, by, faces)


def _faces(d: DataFrame, by: By, faces: list) -> DataFrame:
    every = F.filter(F.array(*(F.struct(F.lit(name).alias("side"), F.when(cond, face).alias("face")) for name, cond, face in faces)), lambda f: f["face"].isNotNull())
    return d.select(*by, F.col("_i").alias("cell"), F.explode(every).alias("f")).select(*by, "cell", "f.*")


def wall(df: DataFrame, by: By, height: float, width: float, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a solid wall along a line: top, both sides and ends; square to the line through each
    vertex's neighbours, to its left for a positive width."""
    w = Window.partitionBy(*by).orderBy(order)
    d = _numbered(df, by, order)
    dx, dy = (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xy")
    d = d.withColumns({"_dx": dx, "_dy": dy}).filter((F.col("_n") >= 2) & F.lit(height > 0))
    span = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    ox, oy = F.when(span < 1e-9, 0.0).otherwise(-F.col("_dy") / span * width), F.when(span < 1e-9, 0.0).otherwise(F.col("_dx") / span * width)
    four = F.array(*(F.struct((F.col("x") + ox * far).alias("x"), (F.col("y") + oy * far).alias("y"), (F.col("z") + up).alias("z")) for up in (0.0, float(height)) for far in (0, 1)))
    v = d.select(*by, "_i", F.posexplode(four).alias("_k", "_p")).select(*by, (F.col("_i") * 4 + F.col("_k")).alias("vertex"), "_p.*")
    a, b = F.col("_i") * 4, F.col("_i") * 4 + 4
    inner, last = F.col("_i") < F.col("_n") - 1, (F.col("_n") - 1) * 4
    faces = [
        ("top", inner, _ints(a + 2, a + 3, b + 3, b + 2)), ("outer", inner, _ints(a, b, b + 2, a + 2)), ("inner", inner, _ints(a + 1, a + 3, b + 3, b + 1)),
        ("start", F.col("_i") == 0, _ints(F.lit(0), F.lit(2), F.lit(3), F.lit(1))), ("end", F.col("_i") == 0, _ints(last + 1, last + 3, last + 2, last)),
    ]
    return v, _faces(d, by, faces)


def box_corners(x: Column, y: Column, width: Column, depth: Column, bottom: Column, top: Column, heading: Column) -> Column:
    """The eight corners (vertex, x, y, z) of a box, the lower four first, counter-clockwise; depth lies along the heading."""
    out = []
    for k, (u, v) in enumerate(((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))):
        rx, ry = C.rotated(depth * u, width * v, heading)
        out += [(k, x + rx, y + ry, bottom), (k + 4, x + rx, y + ry, top)]
    return F.array(*(F.struct(F.lit(k).alias("vertex"), px.alias("x"), py.alias("y"), pz.alias("z")) for k, px, py, pz in sorted(out, key=lambda c: c[0])))


#: The faces of such a box.
BOX_FACES = [[3, 2, 1, 0], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]]


def extruded(df: DataFrame, by: By, *, skirt: float = 1.0, facade: float = 12.0, order: str = "seq") -> DataFrame:
    """Wall corners (by, ring, edge, corner 0 to 3, x, y, z, u, v) of footprints: rings (ring 0 is the outline, the
    others are courtyards; x, y, base and height) turned so that walls face outwards.  u runs around a ring in whole
    sheets of about facade metres, v from 0 at the base to 1 at the top; walls go skirt metres below the base."""
    ring = [*by, "ring"]
    whole = Window.partitionBy(*ring)
    w = whole.orderBy(order)
    d = _numbered(df, ring, order)
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(end)) for c in "xy")
    d = d.withColumns({"_nx": nx, "_ny": ny})
    d = d.withColumn("_area", F.sum(F.col("x") * F.col("_ny") - F.col("_nx") * F.col("y")).over(whole)).filter("_n >= 3")
    turn = F.when(F.col("ring") == 0, F.col("_area") < 0).otherwise(F.col("_area") >= 0)
    d = d.withColumn("_at", F.when(turn, F.col("_n") - 1 - F.col("_i")).otherwise(F.col("_i")))
    v = whole.orderBy("_at")
    around = v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"_nx": F.coalesce(F.lead("x").over(v), F.first("x").over(around)), "_ny": F.coalesce(F.lead("y").over(v), F.first("y").over(around))})
    d = d.withColumn("_span", F.sqrt(F.pow(F.col("_nx") - F.col("x"), 2) + F.pow(F.col("_ny") - F.col("y"), 2)))
    d = d.withColumns({"_length": F.sum("_span").over(whole), "_run": F.sum("_span").over(v.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_span")})
    scale = F.when(F.col("_length") > 1e-9, F.greatest(F.lit(1.0), F.bround(F.col("_length") / facade)) / F.col("_length")).otherwise(0.0)
    u0, u1, below = F.col("_run") * scale, (F.col("_run") + F.col("_span")) * scale, -skirt / F.col("height")
    low, high = F.col("base") - skirt, F.col("base") + F.col("height")
    corners = [("x", "y", low, u0, below), ("_nx", "_ny", low, u1, below), ("_nx", "_ny", high, u1, F.lit(1.0)), ("x", "y", high, u0, F.lit(1.0))]
    four = F.array(*(F.struct(F.lit(k).alias("corner"), F.col(x).alias("x"), F.col(y).alias("y"), z.alias("z"), u.alias("u"), v.alias("v")) for k, (x, y, z, u, v) in enumerate(corners)))
    return d.select(*ring, F.col("_at").alias("edge"), F.explode(four).alias("_c")).select(*ring, "edge", "_c.*")


def placed(df: DataFrame, seats: DataFrame, by: By) -> DataFrame:
    """Vertices (x, y, z) under a fit (by; yaw, sx, sy, along, cx, cy, base, all a row a mesh; angles in radians):
    turned about their mean, stretched along and across a heading, moved, and seated with seats' height on the base;
    heights take the geometric mean of both scales."""
    whole = Window.partitionBy(*by)
    d = df.join(seats, by).withColumns({"_x": F.col("x") - F.avg("x").over(whole), "_y": F.col("y") - F.avg("y").over(whole)})
    a, b = C.rotated(F.col("_x"), F.col("_y"), F.col("yaw") - F.col("along"))
    d = d.withColumns({"_a": a * F.col("sx"), "_b": b * F.col("sy")})
    x, y = C.rotated(F.col("_a"), F.col("_b"), F.col("along"))
    z = (F.col("z") - F.col("seat")) * F.sqrt(F.col("sx") * F.col("sy")) + F.col("base")
    return d.withColumns({"x": x + F.col("cx"), "y": y + F.col("cy"), "z": z}).select(*df.columns)


def lane_frame(df: DataFrame, by: By, order: str = "seq") -> DataFrame:
    """A strip with the station of each cross-section along its middle line, the line's length, and the median width."""
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    mx, my = (F.col("lx") + F.col("rx")) / 2, (F.col("ly") + F.col("ry")) / 2
    d = df.withColumns({"_mx": mx, "_my": my, "_w": F.sqrt(F.pow(F.col("lx") - F.col("rx"), 2) + F.pow(F.col("ly") - F.col("ry"), 2))})
    d = d.withColumn("_gap", F.coalesce(F.sqrt(F.pow(F.col("_mx") - F.lag("_mx").over(w), 2) + F.pow(F.col("_my") - F.lag("_my").over(w), 2)), F.lit(0.0)))
    d = d.withColumn("station", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumns({"length": F.max("station").over(whole), "width": F.percentile("_w", 0.5).over(whole)}).drop("_mx", "_my", "_w", "_gap")


#: Lanes of so few quads meet all of their points.
FEW = 8
#: A quad's first corner, the ways from it to the other three, and its stations; its triangles' products.
_CORNER = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy", "u0", "u1")
_PRODUCTS = tuple(f"{n}{k}" for k in (0, 1) for n in ("d00", "d01", "d11", "det"))
_QUAD = ("_i", *_CORNER, *_PRODUCTS)


def _lane_quads(frames: DataFrame, by: By, order: str) -> DataFrame:
    """Quads of lanes (by, _QUAD) with their middle (mx, my) and _g, so that a point further than _g / 2 from a quad's middle
    is outside of both its triangles by two thirds or more; _g is null for a quad that all of the lane's points have to
    meet: of a lane of few quads, or with a flat triangle.

    A point's least weight falls from a third at a triangle's centroid to nothing at its side and on as steeply or more, so
    it is (1 - d / r) / 3 at most, d from the centroid, where no corner is further than r from that."""
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    q = frames.withColumns({f"{c}2": F.lead(c).over(w) for c in ("lx", "ly", "rx", "ry", "station")}).withColumn("_i", F.row_number().over(w)).filter("station2 is not null and length > 0")
    way = {f"{p}{c}": F.col(f"{of[0]}{c}{of[1:]}") - F.col(f"l{c}") for p, of in (("b", "r"), ("c", "r2"), ("d", "l2")) for c in "xy"}
    q = q.select(*by, "_i", F.col("lx").alias("ax"), F.col("ly").alias("ay"), *(c.alias(n) for n, c in way.items()), (F.col("station") / F.col("length")).alias("u0"), (F.col("station2") / F.col("length")).alias("u1"))
    dot = lambda p, r: F.col(f"{p}x") * F.col(f"{r}x") + F.col(f"{p}y") * F.col(f"{r}y")
    sides = ("b", "c"), ("c", "d")
    q = q.withColumns({f"{n}{k}": dot(*x) for k, (p, r) in enumerate(sides) for n, x in (("d00", (p, p)), ("d01", (p, r)), ("d11", (r, r)))})
    q = q.withColumns({f"_det{k}": F.col(f"d00{k}") * F.col(f"d11{k}") - F.col(f"d01{k}") * F.col(f"d01{k}") for k in (0, 1)})
    q = q.withColumns({f"det{k}": F.when(F.abs(f"_det{k}") < 1e-12, 1e-12).otherwise(F.col(f"_det{k}")) for k in (0, 1)})
    # from the first corner: the middle, each centroid, and how far this is from the middle and from the corners
    m, reach = [(F.col(f"b{c}") + F.col(f"c{c}") + F.col(f"d{c}")) / 4 for c in "xy"], []
    for p, r in sides:
        o = [(F.col(f"{p}{c}") + F.col(f"{r}{c}")) / 3 for c in "xy"]
        away = lambda x, y: F.sqrt((x - o[0]) * (x - o[0]) + (y - o[1]) * (y - o[1]))  # noqa: E731, B023
        reach.append(away(*m) + 3 * F.greatest(away(F.lit(0.0), F.lit(0.0)), *(away(F.col(f"{n}x"), F.col(f"{n}y")) for n in (p, r))))
    sound = [F.col(f"_det{k}") > 1e-6 * F.col(f"d00{k}") * F.col(f"d11{k}") + 1e-9 for k in (0, 1)]
    q = q.withColumns({"mx": F.col("ax") + m[0], "my": F.col("ay") + m[1], "_reach": F.greatest(*reach), "_ok": F.coalesce(sound[0] & sound[1], F.lit(False))})
    q = q.withColumn("_ok", F.col("_ok") & (F.col("_reach") < 1e9) & (F.count("*").over(whole) > FEW))
    far = F.max(F.when(F.col("_ok"), F.col("_reach"))).over(whole)
    return q.select(*by, *_QUAD, "mx", "my", F.when(F.col("_ok"), 2 * far).alias("_g"))


def _weighed(met: DataFrame) -> DataFrame:
    """Points (px, py) that have met a quad, with their weights in its triangles, and how far inside of each they are."""
    met = met.withColumns({"_ox": F.col("px") - F.col("ax"), "_oy": F.col("py") - F.col("ay")})
    met = met.withColumns({f"_to_{p}": F.col("_ox") * F.col(f"{p}x") + F.col("_oy") * F.col(f"{p}y") for p in "bcd"})
    for k, (p, r) in enumerate((("b", "c"), ("c", "d"))):
        d00, d01, d11, det, d20, d21 = (F.col(n) for n in (f"d00{k}", f"d01{k}", f"d11{k}", f"det{k}", f"_to_{p}", f"_to_{r}"))
        met = met.withColumns({f"_b{k}": (d11 * d20 - d01 * d21) / det, f"_c{k}": (d00 * d21 - d01 * d20) / det})
    met = met.withColumns({f"_a{k}": 1 - F.col(f"_b{k}") - F.col(f"_c{k}") for k in (0, 1)})
    return met.withColumns({f"_in{k}": F.least(f"_a{k}", f"_b{k}", f"_c{k}") for k in (0, 1)})


def lane_project(points: DataFrame, frames: DataFrame, by: By, key: str, order: str = "seq") -> DataFrame:
    """key, u, v of points (by, key, px, py) in their lane: along it (0 to 1) and across it (0 left, 1 right), by the
    triangle of the lane that a point is most inside of (or least outside).

    A point meets the quads in the four cells around it.  If it is outside of all of them by two thirds or more, a quad further
    off may suit it better, and it meets the whole lane.

    First how far inside is found, then where: numbers alone are added up as they come, where a struct would have every
    point's meeting with every triangle sorted on disk."""
    quads = stored(_lane_quads(frames, by, order))
    cells = quads.filter("_g is not null").select(*by, *_QUAD, F.floor(F.col("mx") / F.col("_g")).alias("_x"), F.floor(F.col("my") / F.col("_g")).alias("_y"))
    everywhere, lanes = quads.filter("_g is null").select(*by, *_QUAD), quads.filter("_g is not null").select(*by, "_g").distinct()
    points = points.select(*by, key, "px", "py")
    whole, near = list(by), [*by, "_x", "_y"]

    def around(p: DataFrame) -> DataFrame:
        p = p.filter("_g is not null")
        for c in "xy":
            low = F.floor(F.col(f"p{c}") / F.col("_g") - 0.5)
            p = p.withColumn(f"_{c}", F.explode(F.array(low, low + 1)))
        return p

    def most(*met: DataFrame) -> DataFrame:
        inside = reduce(DataFrame.unionByName, (_weighed(m).select(*by, key, "_g", F.greatest("_in0", "_in1").alias("_in")) for m in met))
        return inside.groupBy(*by, key).agg(F.max("_in").alias("_best"), F.max("_g").alias("_g"))

    def where(*met: DataFrame) -> DataFrame:
        at = []
        for m in met:
            m = _weighed(m).withColumns({f"_is{k}": F.col(f"_in{k}").eqNullSafe(F.col("_best")) for k in (0, 1)}).filter("_is0 or _is1")
            u0, u1 = F.col("u0"), F.col("u1")
            of = lambda a, b, c, k: F.col(f"_a{k}") * a + F.col(f"_b{k}") * b + F.col(f"_c{k}") * c
            u, v = (F.when(F.col("_is0"), x).otherwise(y) for x, y in ((of(u0, u0, u1, 0), of(u0, u1, u1, 1)), (of(0.0, 1.0, 1.0, 0), of(0.0, 1.0, 0.0, 1))))
            at.append(m.select(*by, key, F.when(F.col("_is0"), F.col("_i") * 2).otherwise(F.col("_i") * 2 + 1).alias("nr"), F.struct(u.alias("u"), v.alias("v")).alias("m")))
        return reduce(DataFrame.unionByName, at).groupBy(*by, key).agg(F.min_by("m", "nr").alias("m")).select(*by, key, "m.u", "m.v")

    same = reduce(lambda x, y: x & y, (F.col(f"_p.{n}").eqNullSafe(F.col(f"_q.{n}")) for n in (*by, key)))
    knowing = lambda p, b: p.alias("_p").join(b.alias("_q"), same).select("_p.*", "_best")
    if lanes.isEmpty():  # as an atlas has them: lanes of a quad or two
        alone = points.withColumn("_g", F.lit(None).cast("double"))
        return where(knowing(alone, most(alone.join(everywhere, whole))).join(everywhere, whole))
    points = stored(points.join(lanes, by, "left"))
    best = stored(most(points.join(everywhere, whole), around(points).join(cells, near)))
    sure = best.filter("_g is null or _best > -0.666")
    rest = stored(points.alias("_p").join(sure.alias("_q"), same, "left_anti"))
    known = knowing(points, sure)
    first = where(known.join(everywhere, whole), around(known).join(cells, near))
    lane = quads.select(*by, *_QUAD)
    return first.unionByName(where(knowing(rest, most(rest.join(lane, whole))).join(lane, whole)))
