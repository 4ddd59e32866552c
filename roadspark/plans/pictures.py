"""Queries over pictures, which are arrays of numbers: seams, scores, descriptors, bays, alignment; with their SQL.

A vector of 64 numbers is read as a grey picture of 8 x 8, and as one of three channels, each of which is the grey
picture begun 21 numbers further on than the one before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import scalar as C
from roadspark.operators import reports
from roadspark.operators.graph import stored
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6

_GREY = """px as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding[1:64])::double * 100 + 128 as v from embeddings),
grey as (select vec_id, i // 8 as r, i % 8 as c, v from px)"""
_RGB = """px3 as (select vec_id, embedding, unnest(range(0, 192)) as i from embeddings),
rgb as (select vec_id, i // 24 as r, (i % 24) // 3 as c, i % 3 as ch, embedding[(i // 3 + 21 * (i % 3)) % 64 + 1]::double * 100 + 128 as v from px3)"""


def _image(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100 + 128).alias("image"))


def _rgb(spark: SparkSession, d: str) -> DataFrame:
    """192 numbers: rows of pixels of three channels; a written table, as an expression would be worked out anew for every
    pixel that is named."""
    at = F.sequence(F.lit(0), F.lit(191))
    pixel = lambda i: F.get("image", ((F.floor(i / 3) + i % 3 * 21) % 64).cast("int"))
    return stored(stored(_image(spark, d)).select("vec_id", F.transform(at, pixel).alias("image")))


def _seam_sql(view: str, h: int, w: int, by: str = "") -> str:
    """A view seam (vec_id, seam) of a view of pixels (vec_id, r, c, v; and by)."""
    on = f" and a.{by} = b.{by}" if by else ""
    step = lambda cond, where: f"(select a.vec_id, avg(abs(a.v - b.v)) as s from {view} a join {view} b on a.vec_id = b.vec_id{on} and {cond} where {where} group by 1)"
    return f"""seam as (select w0.vec_id, (w0.s + w1.s) / (n0.s + n1.s + 1e-9) as seam
from {step("a.c = b.c", f"a.r = 0 and b.r = {h - 1}")} w0 join {step("a.r = b.r", f"a.c = 0 and b.c = {w - 1}")} w1 using (vec_id)
join {step("a.c = b.c and b.r = a.r + 1", "true")} n0 using (vec_id) join {step("a.r = b.r and b.c = a.c + 1", "true")} n1 using (vec_id))"""


@query(V.with_(_GREY, _seam_sql("grey", 8, 8)) + "select vec_id, round(seam, 6) as seam from seam")
def seam_error(spark: SparkSession, d: str) -> DataFrame:
    return _image(spark, d).select("vec_id", F.round(reports.seam_error(F.col("image"), 8, 8), 6).alias("seam"))


@query(
    V.with_(_GREY)
    + """, w as (select a.vec_id, avg(abs(a.v - b.v)) as s from grey a join grey b on a.vec_id = b.vec_id and a.r = b.r where a.c = 0 and b.c = 7 group by 1),
n as (select a.vec_id, avg(abs(a.v - b.v)) as s from grey a join grey b on a.vec_id = b.vec_id and a.r = b.r and b.c = a.c + 1 group by 1)
select vec_id, round(w.s / (n.s + 1e-9), 6) as seam from w join n using (vec_id)"""
)
def seam_error_axis(spark: SparkSession, d: str) -> DataFrame:
    return _image(spark, d).select("vec_id", F.round(reports.seam_error_axis(F.col("image"), 8, 8), 6).alias("seam"))


_SCORE = (
    _seam_sql("rgb", 8, 8, "ch")
    + """, scale as (select vec_id, case when max(v) <= 1.001 then 255.0::double else 1.0::double end as k, stddev_pop(v) as sd from rgb group by 1),
white as (select vec_id, avg(case when low * k > 235 then 1.0::double else 0 end) as blown from (select vec_id, r, c, min(v) as low from rgb group by 1, 2, 3) join scale using (vec_id) group by 1),
score as (select vec_id, blown, sd * k as sd, seam from white join scale using (vec_id) join seam using (vec_id))"""
)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    blown, sd, seam = reports.tile_score(F.col("image"), 8, 8)
    return _rgb(spark, d).select("vec_id", blown.alias("blown"), sd.alias("sd"), seam.alias("seam"))


@query(V.with_(_RGB, _SCORE) + "select vec_id, round(blown, 6) as blown, round(sd, 6) as sd, round(seam, 6) as seam from score")
def tile_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", *r6("blown", "sd", "seam"))


@query(
    V.with_(_RGB, _SCORE)
    + """select vec_id, blown <= 0.01 and sd between 4 and 70 and seam between 0.6 and 1.4 as usable,
round(greatest(0, blown - 0.01) * 100 + greatest(0, sd - 70) / 10 + greatest(0, 4 - sd) / 10 + greatest(0, abs(seam - 1) - 0.4), 6) as far from score"""
)
def tile_usable(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    of = [F.col(c) for c in ("blown", "sd", "seam")]
    return s.select("vec_id", C.tile_usable(*of).alias("usable"), F.round(C.tile_distance(*of), 6).alias("far"))


_DRAWS = """draw as (select vec_id // 4 as tile, (vec_id % 4)::int as try_no, blown <= 0.01 and sd between 4 and 70 and seam between 0.6 and 1.4 as usable,
round(greatest(0, blown - 0.01) * 100 + greatest(0, sd - 70) / 10 + greatest(0, 4 - sd) / 10 + greatest(0, abs(seam - 1) - 0.4), 6) as far from score),
first as (select tile, min(try_no) as stop from draw where usable group by tile),
made as (select draw.* from draw left join first using (tile) where stop is null or try_no <= stop)"""


@query(V.with_(_RGB, _SCORE, _DRAWS) + "select tile, arg_min(try_no, (far, try_no)) as try_no, min(far) as far, count(*)::int as draws from made group by tile")
def best_tile(spark: SparkSession, d: str) -> DataFrame:
    """Of the draws of each tile, up to the first that is usable, the one nearest to being so."""
    of = [F.col(c) for c in ("blown", "sd", "seam")]
    s = _scored(spark, d).select(F.expr("vec_id div 4").alias("tile"), (F.col("vec_id") % 4).cast("int").alias("try_no"), C.tile_usable(*of).alias("usable"), F.round(C.tile_distance(*of), 6).alias("far"))
    return reports.least_of_n(s, ["tile"], "try_no", "far", "usable").select("tile", "try_no", "far", "draws")


@query(V.with_(_RGB, _SCORE) + "select (vec_id % 10)::int as family, count(*) as sheets, count(*) filter (seam < 1.0) as kept, round(avg(seam), 6) as mean, round(min(seam), 6) as least, round(max(seam), 6) as most from score group by 1")
def family_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each family of sheets, and how many a threshold keeps."""
    s = _scored(spark, d).withColumn("family", (F.col("vec_id") % 10).cast("int"))
    return reports.score_summary(s, ["family"], "seam", F.col("seam") < 1.0).select("family", "sheets", "kept", *r6("mean", "least", "most"))


_DESCRIPTOR = """one as (select vec_id, r, c, max(v) as high, min(v) as low, avg(v) as g from rgb group by 1, 2, 3),
sat as (select vec_id, avg((high - low) / (high + 1e-9)) as s from one group by 1),
busy as (select a.vec_id, avg(abs(a.g - b.g)) as b from one a join one b on a.vec_id = b.vec_id and a.c = b.c and b.r = a.r + 1 group by 1),
mean as (select vec_id, avg(v) as m, avg(v) filter (ch = 0) as r, avg(v) filter (ch = 1) as g, avg(v) filter (ch = 2) as b from rgb group by 1),
descriptor as (select vec_id, m / 255 as d0, (r - mean.b) / 255 as d1, (g - (r + mean.b) / 2) / 255 as d2, s as d3, busy.b / 255 as d4 from mean join sat using (vec_id) join busy using (vec_id))"""


@query(V.with_(_RGB, _DESCRIPTOR) + "select vec_id, " + ", ".join(f"round(d{k}, 6) as d{k}" for k in range(5)) + " from descriptor")
def descriptor(spark: SparkSession, d: str) -> DataFrame:
    x = _rgb(spark, d).select("vec_id", reports.descriptor(F.col("image"), 8, 8).alias("x"))
    return x.select("vec_id", *(F.round(F.get("x", F.lit(k)), 6).alias(f"d{k}") for k in range(5)))


@query(V.with_(_RGB, _DESCRIPTOR) + "select vec_id, round(d3, 6) as saturation from descriptor")
def saturation(spark: SparkSession, d: str) -> DataFrame:
    return _rgb(spark, d).select("vec_id", F.round(reports.saturation(F.col("image"), 8, 8), 6).alias("saturation"))


@query(
    V.with_(_RGB, _DESCRIPTOR)
    + "select count(*) as pairs, round(avg(sqrt("
    + " + ".join(f"pow(a.d{k} - b.d{k}, 2)" for k in range(5))
    + ")), 6) as diversity from descriptor a join descriptor b on a.vec_id < b.vec_id"
)
def diversity(spark: SparkSession, d: str) -> DataFrame:
    """The mean distance between any two of all descriptors."""
    x = _rgb(spark, d).select("vec_id", reports.descriptor(F.col("image"), 8, 8).alias("x"))
    return reports.diversity(x, "vec_id", "x").select("pairs", *r6("diversity"))


#: Columns of a control picture, which repeats after some of them, and the picture itself in eight equal rows.
_BAYS = """ctl as (select vec_id, r, c, ((c % (2 + vec_id % 7)) * 10 + r)::double as v from embeddings, range(8) a(r), range(24) b(c)),
m as (select vec_id, avg(v) as m from ctl group by 1), k0 as (select vec_id, avg(abs(v - m)) as contrast from ctl join m using (vec_id) group by 1),
fit as (select a.vec_id, k, avg(abs(a.v - b.v)) as err from ctl a, (select unnest([2, 3, 4, 6, 8, 12]) as k) ks, ctl b where a.vec_id = b.vec_id and a.r = b.r and b.c = (a.c + 24 - 24 // k) % 24 group by 1, 2),
bays as (select k0.vec_id, case when contrast < 1e-9 then 1 else coalesce(max(k) filter (err < 0.02 * contrast), 1) end::int as bays from k0 join fit using (vec_id) group by k0.vec_id, contrast)"""


def _control() -> Column:
    """24 columns by 8 rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: ((i % 24) % (F.col("vec_id") % 7 + 2) * 10 + F.floor(i / 24)).cast("double"))


@query(V.with_(_BAYS) + "select vec_id, bays from bays")
def bays_in(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "embeddings").select("vec_id", _control().alias("image"))
    return c.select("vec_id", reports.bays_in(F.col("image"), 8, 24).alias("bays"))


@query(
    V.with_(_GREY)
    + """, bay as (select vec_id, (1 + vec_id % 4)::int as bays from embeddings),
st as (select a.vec_id, a.c, avg(abs(b.v - a.v)) as s from grey a join grey b on a.vec_id = b.vec_id and a.r = b.r and b.c = a.c + 1 group by 1, 2),
w as (select a.vec_id, avg(abs(a.v - b.v)) as s from grey a join grey b on a.vec_id = b.vec_id and a.r = b.r where a.c = 0 and b.c = 7 group by 1),
peer as (select vec_id, least(round_even(k * 8.0::double / bays, 0)::int, 7) - 1 as c from (select vec_id, bays, unnest(range(1, bays)) as k from bay where bays > 1) union all select vec_id, c from st join bay using (vec_id) where bays = 1),
md as (select vec_id, median(s) as m from peer join st using (vec_id, c) group by 1)
select vec_id, round(w.s / (m + 1e-9), 6) as seam from w join md using (vec_id)"""
)
def wrap_seam(spark: SparkSession, d: str) -> DataFrame:
    """The wrap's step against those at the borders of one to four bays."""
    bays = (F.col("vec_id") % 4 + 1).cast("int")
    return _image(spark, d).select("vec_id", F.round(reports.wrap_seam(F.col("image"), 8, 8, bays), 6).alias("seam"))


def _blur_sql(view: str, out: str, sigma: float) -> str:
    r = round(3 * max(1.0, sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / max(1.0, sigma)) ** 2)
    table = ", ".join(f"({o}, {k:.17g}::double)" for o, k in zip(range(-r, r + 1), kernel / kernel.sum()))
    return f"{out} as (select a.vec_id, a.i, sum(b.p * g) as p from {view} a join {view} b using (vec_id) join (values {table}) t(o, g) on b.i = a.i + o group by 1, 2)"


_PLACE = np.linspace(0, 11 - 1, 7)

_ALIGN = (
    """sheet as (select a.vec_id, a.r as i, avg(abs(b.v - a.v)) as p from grey a join grey b on a.vec_id = b.vec_id and a.c = b.c and b.r = a.r + 1 group by 1, 2),
pic as (select vec_id, r, c, ((r * (3 + vec_id % 5) + c * r) % 11)::double as v from embeddings, range(12) a(r), range(8) b(c)),
want0 as (select a.vec_id, a.r as i, avg(abs(b.v - a.v)) as p from pic a join pic b on a.vec_id = b.vec_id and a.c = b.c and b.r = a.r + 1 group by 1, 2),
spot as (select * from (values """
    + ", ".join(f"({k}, {min(int(p), 9)}, {p - min(int(p), 9):.17g}::double)" for k, p in enumerate(_PLACE))
    + """) t(i, low, share)),
want as (select a.vec_id, spot.i, a.p * (1 - share) + b.p * share as p from spot join want0 a on a.i = low join want0 b on b.i = low + 1 and a.vec_id = b.vec_id), """
    + _blur_sql("sheet", "s2", 0.7)
    + ", "
    + _blur_sql("want", "w2", 0.7)
)


@query(V.with_(_GREY, _ALIGN) + "select vec_id, round(case when stddev_pop(s2.p) * stddev_pop(w2.p) > 1e-9 then corr(s2.p, w2.p) else 0 end, 6) as r from s2 join w2 using (vec_id, i) group by 1")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    """How well a picture's edges lie where those of a control of another height are."""
    control = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: ((F.floor(i / 8) * (F.col("vec_id") % 5 + 3) + i % 8 * F.floor(i / 8)) % 11).cast("double"))
    x = _image(spark, d).withColumn("control", control)
    return reports.alignment(x, "vec_id", "image", (8, 8), "control", (12, 8), tolerance=0.1).select("vec_id", *r6("r"))
