"""Queries whose inner step is a kernel: one bounded group at a time, in grouped functions.

Most have no SQL; the tests hold them to their rules.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.operators import areas, graph, kernels
from roadspark.plans import views as V
from roadspark.plans.registry import query
from roadspark.plans.sequences import r6

_RINGS = 64


def plots(spark: SparkSession, d: str) -> DataFrame:
    """Four-sided plots (id, ring), turned and uneven, from part."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    a, b, t = F.col("p_size") + 8.0, (F.col("p_size") % 11) + 5.0, F.radians(F.col("id") % 180)
    corner = lambda u, v: F.array(F.cos(t) * u - F.sin(t) * v, F.sin(t) * u + F.cos(t) * v)
    return p.select("id", F.array(corner(F.lit(0.0), F.lit(0.0)), corner(a, F.lit(0.0)), corner(a, b), corner(F.lit(0.0), b * 0.9)).alias("ring"))


def _each(df: DataFrame, schema: str, f) -> DataFrame:
    """f(row) -> list of tuples, over batches of rows, each by itself."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for r in pdf.itertuples(index=False) for x in f(r)], columns=names)

    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # a small file; kernels take much longer than a shuffle of its rows
        df = df.repartition(cores)
    return df.mapInPandas(run, schema)


def _ring(r) -> np.ndarray:
    return np.array([list(p) for p in r.ring], float)


@query()
def plan_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Long and short side and heading of each plot's smallest rectangle."""
    out = _each(plots(spark, d), "id long, long_side double, short_side double, heading double", lambda r: [(r.id, *kernels.rotated_rectangle(_ring(r)))])
    return out.select("id", *r6("long_side", "short_side", "heading"))


_PLOTS = """side as (select p_partkey as id, p_size + 8.0::double as a, p_size % 11 + 5.0::double as b, radians(p_partkey % 180) as t from part),
corner as (select id, k, cos(t) * u - sin(t) * v as x, sin(t) * u + cos(t) * v as y from (select id, t, unnest([0, 1, 2, 3]) as k, unnest([0, a, a, 0]) as u, unnest([0, 0, b, b * 0.9]) as v from side))"""


@query(
    V.with_(_PLOTS)
    + """, m as (select id, (min(x) + max(x)) / 2 as mx, (min(y) + max(y)) / 2 as my from corner group by id)
select id, round(any_value(mx), 6) as x, round(any_value(my), 6) as y, round(max(sqrt(pow(x - mx, 2) + pow(y - my, 2))), 6) as radius from corner join m using (id) group by id"""
)
def enclosing_circle(spark: SparkSession, d: str) -> DataFrame:
    """The middle of each plot's box, and its furthest corner."""
    p = plots(spark, d)
    xs, ys = F.transform("ring", lambda q: q[0]), F.transform("ring", lambda q: q[1])
    p = p.withColumns({"x": (F.array_min(xs) + F.array_max(xs)) / 2, "y": (F.array_min(ys) + F.array_max(ys)) / 2})
    far = F.array_max(F.transform("ring", lambda q: F.sqrt(F.pow(q[0] - F.col("x"), 2) + F.pow(q[1] - F.col("y"), 2))))
    return p.select("id", *r6("x", "y"), F.round(far, 6).alias("radius"))


@query()
def plot_inset(spark: SparkSession, d: str) -> DataFrame:
    """Plots drawn in until they cover 60 % of their ground."""
    inset = lambda r: [(r.id, abs(kernels.area(_ring(r))), abs(kernels.area(kernels.inset_to_share(_ring(r), 0.6))))]
    return graph.each_form(plots(spark, d), "id", lambda p: _each(p, "id long, whole double, built double", inset).select("id", *r6("whole", "built")))


@query()
def split_lots(spark: SparkSession, d: str) -> DataFrame:
    """Lots of blocks, halved down to 120 square metres; each block has a stream of its own."""
    out = _each(plots(spark, d), "id long, lot int, area double", lambda r: [(r.id, i, abs(kernels.area(x))) for i, x in enumerate(kernels.split_lots(_ring(r), 120.0, 20.0, int(r.id)))])
    return out.select("id", "lot", *r6("area"))


def _faces(p: DataFrame) -> DataFrame:
    return _each(p, "id long, face int, a int, b int, c int", lambda r: [(r.id, i, *t) for i, t in enumerate(kernels.ear_clip(_ring(r)))])


@query()
def triangulate(spark: SparkSession, d: str) -> DataFrame:
    return _faces(plots(spark, d))


@query()
def fit_footprint(spark: SparkSession, d: str) -> DataFrame:
    """The turn and scale that lay a turned copy of a plot over the plot."""

    def fit(r):
        ring = _ring(r)
        c, s = np.cos(0.7), np.sin(0.7)
        return [(r.id, *kernels.best_fit(ring @ np.array([[c, s], [-s, c]]) * 2, ring))]

    return graph.each_form(plots(spark, d), "id", lambda p: _each(p, "id long, iou double, turn double, scale double", fit).select("id", *r6("iou", "turn", "scale")))


@query()
def bound_projection(spark: SparkSession, d: str) -> DataFrame:
    """Points of right bounds, of fewer vertices, paired with the left bounds' vertices, never going back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        left = pdf[["x", "y", "z"]].to_numpy(float)
        right = left[:: max(1, len(left) // 8)] + np.array([0.0, -3.0, 0.1])
        pair = kernels.monotone_projection(left, right) if len(right) > 1 else np.full((len(left), 3), np.nan)
        return pd.DataFrame({"line_id": pdf["line_id"], "seq": pdf["seq"], **{c: np.round(pair[:, k], 6) for k, c in enumerate("xyz")}})

    return V.vertex(spark, d).select("line_id", F.col("seq").cast("long").alias("seq"), "x", "y", "z").groupBy("line_id").applyInPandas(run, "line_id long, seq long, x double, y double, z double")


@query()
def pack_strips(spark: SparkSession, d: str) -> DataFrame:
    """Strips on atlas pages, a set of pages for each lane group: packing goes on from strip to strip, within a group."""

    def run(pdf):
        pdf = pdf.sort_values("p_partkey")
        sizes = list(zip(pdf["w"], pdf["h"]))
        out = pd.DataFrame(kernels.shelf_pack(sizes, 512), columns=["page", "px", "py"])  # no strip here is empty
        return pd.concat([pdf.reset_index(drop=True), out], axis=1)

    p = V.table(spark, d, "part").select((F.col("p_partkey") % _RINGS).alias("grp"), "p_partkey", ((F.col("p_size") % 4 + 1) * 16).cast("int").alias("w"), (F.col("p_size") * 8).cast("int").alias("h"))
    return p.groupBy("grp").applyInPandas(run, "grp long, p_partkey long, w int, h int, page int, px int, py int")


_WALKS = """lane as (select lane_id, s, e, o_totalprice / 1000 as length from ends join orders on o_orderkey = lane_id),
start as (select row_number() over (order by md5('5-' || lane_id), lane_id) - 1 as attempt, lane_id from lane order by attempt limit 400),
walk as (
  select attempt::int as attempt, [start.lane_id] as path, e, length, 0 as step from start join lane using (lane_id)
  union all
  select attempt, list_append(path, next), e2, length + more, step + 1 from (
    select w.*, l.lane_id as next, l.e as e2, l.length as more, row_number() over (partition by attempt order by md5('5-' || attempt || '-' || step || '-' || l.lane_id), l.lane_id) as r
    from walk w join lane l on l.s = w.e where not list_contains(path, l.lane_id)) where r = 1),
walked as (select attempt, arg_max(path, step) as path, max(length) as length from walk group by attempt)"""


def _walks(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("lane_id"), (F.col("o_totalprice") / 1000).alias("length"))
    return graph.step_walks(V.ends(spark, d).join(o, "lane_id"), 400, 5)


@query("with recursive " + V.ENDS + ", " + _WALKS + " select attempt, array_to_string(path, ',') as path, len(path)::int as lanes, round(length, 6) as length from walked")
def route_walks(spark: SparkSession, d: str) -> DataFrame:
    """400 random walks over the lanes of all orders, none of which drives a lane twice."""
    return _walks(spark, d).select("attempt", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.size("path").alias("lanes"), *r6("length"))


@query("with recursive " + V.ENDS + ", " + _WALKS + " select attempt, len(path)::int as lanes, round(length, 6) as length from walked order by walked.length desc, attempt limit 1")
def longest_route(spark: SparkSession, d: str) -> DataFrame:
    """The longest of these walks, the first of equal ones."""
    return graph.longest_walk(_walks(spark, d)).select("attempt", F.size("path").alias("lanes"), *r6("length"))


@query()
def cut_backdrop(spark: SparkSession, d: str) -> DataFrame:
    """Share of each picture (a disc before a plain backdrop) that is cut out as its subject."""

    def one(r):
        y, x = np.mgrid[:24, :24]
        disc = (x - 12) ** 2 + (y - 12) ** 2 <= (3 + r.p_size % 7) ** 2
        image = np.where(disc[..., None], 40, 220) + np.zeros(3)
        return [(r.p_partkey, float((kernels.cut_out(image.astype(np.uint8), 30.0) > 0).mean()))]

    return _each(V.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey long, share double", one).select("p_partkey", *r6("share"))


@query()
def paint_strips(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of pixels by each plot's outline, filled with supersampling."""

    def one(r):
        ring = _ring(r)
        return [(r.id, float(kernels.raster((ring - ring.min(0)) / max(np.ptp(ring, axis=0).max(), 1e-9) * 16, 16, 16).sum()))]

    return _each(plots(spark, d), "id long, pixels double", one).select("id", *r6("pixels"))


@query()
def texture_noise(spark: SparkSession, d: str) -> DataFrame:
    """Seamless noise tiles: their mean, and the wrap's step over the mean inner step."""

    def one(r):
        t = kernels.periodic_noise(32, 32, int(r.r_regionkey))
        wrap = np.abs(t[:, 0] - t[:, -1]).mean() / np.abs(np.diff(t, axis=1)).mean()
        return [(int(r.r_regionkey), float(t.mean()), float(wrap))]

    return _each(V.table(spark, d, "region").select("r_regionkey"), "r_regionkey int, mean double, wrap double", one).select("r_regionkey", *r6("mean", "wrap"))


@query(
    V.with_(_PLOTS)
    + """, n as (select id, k, x, y, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from corner window w as (partition by id order by k))
select id, round(abs(sum(x * y2 - x2 * y)) / 2, 4) as area, round(min(x), 6) as x0, round(min(y), 6) as y0, round(max(x), 6) as x1, round(max(y), 6) as y1 from n group by id"""
)
def faces_to_polygons(spark: SparkSession, d: str) -> DataFrame:
    """The triangles of each plot joined to polygons again: their areas and bounds."""

    def joined(p: DataFrame) -> DataFrame:
        corner = lambda c: F.element_at("ring", F.col(c) + 1)
        faces = _faces(p).join(p, "id").select("id", F.array(corner("a"), corner("b"), corner("c")).alias("ring"))
        return areas.dissolved(faces, keys=["id"]).select("id", F.round("area", 4).alias("area"), *r6("x0", "y0", "x1", "y1"))

    return graph.each_form(plots(spark, d), "id", joined)
