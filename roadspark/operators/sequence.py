"""Operators over ordered sequences: polylines, rings and routes in long form, a row a vertex.

A sequence is named by the columns `by` and ordered by `order`; every operator is a window or an explode over the
sequence's own partition, so that one shuffle by `by` serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = list[str]


def _w(by: By, order: str):
    return Window.partitionBy(*by).orderBy(order)


def gap(by: By, order: str, axes: str = "xy") -> Column:
    """Distance from the vertex before; null for the first."""
    w = _w(by, order)
    return F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0)))


def stations(df: DataFrame, by: By, order: str = "seq", axes: str = "xy") -> DataFrame:
    """Adds station, the length walked up to each vertex."""
    return df.withColumn("gap", gap(by, order, axes)).withColumn("station", F.sum(F.coalesce("gap", F.lit(0.0))).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))).drop("gap")


def lengths(df: DataFrame, by: By, order: str = "seq", axes: str = "xy") -> DataFrame:
    """The length of each sequence."""
    return df.withColumn("gap", gap(by, order, axes)).groupBy(*by).agg(F.sum(F.coalesce("gap", F.lit(0.0))).alias("length"))


def segments(df: DataFrame, by: By, order: str = "seq", axes: str = "xy") -> DataFrame:
    """stations() with each vertex's next: station2, and x2, y2, z2; without the last vertex."""
    w = _w(by, order)
    out = stations(df, by, order, axes)
    return out.withColumns({f"{c}2": F.lead(c).over(w) for c in ("station", "x", "y", "z")}).filter("station2 is not null")


def _between(t: Column) -> list[Column]:
    share = F.when(F.col("station2") > F.col("station"), (t - F.col("station")) / (F.col("station2") - F.col("station"))).otherwise(F.lit(0.0))
    return [(F.col(c) + share * (F.col(f"{c}2") - F.col(c))).alias(c) for c in ("x", "y", "z")]


def resample_count(df: DataFrame, by: By, max_segment: float, order: str = "seq", axes: str = "xyz") -> DataFrame:
    """Evenly spaced points, max(points, ceil(length / max_segment) + 1) of them; every segment makes its own.

    Point k of n stands at k * length / (n - 1); a segment holds those in [station, station2), and the last segment
    of some length also the end, so no join is needed.
    """
    whole = Window.partitionBy(*by)
    s = segments(df, by, order, axes).filter("station2 > station")
    s = s.withColumn("length", F.max("station2").over(whole)).withColumn("vertices", F.count("*").over(whole) + 1)
    s = s.withColumn("n", F.greatest("vertices", F.ceil(F.col("length") / max_segment) + 1).cast("int"))
    s = s.withColumn("step", F.col("length") / (F.col("n") - 1))
    first = F.ceil(F.round(F.col("station") / F.col("step"), 9)).cast("int")
    last = F.when(F.col("station2") == F.col("length"), F.col("n") - 1).otherwise(F.ceil(F.round(F.col("station2") / F.col("step"), 9)).cast("int") - 1)
    s = s.withColumn("first", first).withColumn("last", last).filter("last >= first").withColumn("k", F.explode(F.sequence("first", "last")))
    return s.select(*by, "k", *_between(F.col("k") * F.col("step")))


def resample_step(df: DataFrame, by: By, step: float, order: str = "seq") -> DataFrame:
    """Points every step of plan length from the start on; the end is not forced."""
    s = segments(df, by, order).filter("station2 > station")
    first = F.when(F.col("station") == 0, 0).otherwise(F.floor(F.col("station") / step) + 1).cast("int")
    s = s.withColumn("first", first).withColumn("last", F.floor(F.col("station2") / step).cast("int")).filter("last >= first")
    return s.withColumn("k", F.explode(F.sequence("first", "last"))).select(*by, "k", *_between(F.col("k") * F.lit(float(step))))


def smooth(df: DataFrame, by: By, window: int, order: str = "seq", axes: str = "xyz") -> DataFrame:
    """Centred moving averages, cut off at the ends; sequences of under window vertices, or a window under two, stay."""
    if window < 2:
        return df
    half = window // 2
    w, whole = _w(by, order).rowsBetween(-half, half), Window.partitionBy(*by)
    n = F.count("*").over(whole)
    return df.select("*", *(F.when(n < window, F.col(a)).otherwise(F.avg(a).over(w)).alias(f"s{a}") for a in axes)).drop(*axes).withColumnsRenamed({f"s{a}": a for a in axes})


def look_ahead(df: DataFrame, by: By, k: int, order: str = "seq") -> DataFrame:
    """Each vertex with the one k ahead (the last, where there are fewer); without the last vertex and targets at the same place."""
    w = _w(by, order)
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {f"{c}_to": F.coalesce(F.lead(c, k).over(w), F.last(c).over(end)) for c in "xyz"}
    return df.withColumns(cols).withColumn("last", F.last(order).over(end)).filter(f"{order} <> last and (x <> x_to or y <> y_to)").drop("last")


def runs(df: DataFrame, by: By, flag: str, order: str = "seq") -> DataFrame:
    """Maximal runs of two or more true flags: start and stop."""
    w = _w(by, order)
    # positions without gaps, whatever the order column holds
    on = df.withColumn("_p", F.row_number().over(w)).filter(F.coalesce(F.col(flag), F.lit(False)))
    islands = on.withColumn("_g", F.col("_p") - F.row_number().over(w)).groupBy(*by, "_g")
    return islands.agg(F.min(order).alias("start"), F.max(order).alias("stop")).filter("stop > start").drop("_g")


def measured_runs(df: DataFrame, by: By, flag: str, least: float, order: str = "seq") -> DataFrame:
    """runs() of df (with station) with their length, of the least length or more."""
    w = _w(by, order)
    on = df.withColumn("_p", F.row_number().over(w)).filter(F.coalesce(F.col(flag), F.lit(False)))
    islands = on.withColumn("_g", F.col("_p") - F.row_number().over(w)).groupBy(*by, "_g")
    found = islands.agg(F.min(order).alias("start"), F.max(order).alias("stop"), (F.max("station") - F.min("station")).alias("length"))
    return found.filter((F.col("stop") > F.col("start")) & (F.col("length") >= least)).drop("_g")


def close_gaps(df: DataFrame, by: By, flag: str, least: float, order: str = "seq") -> DataFrame:
    """df (with station) and closed: the flag, with false runs of two or more that are shorter than least and touch neither end made true."""
    w, whole = _w(by, order), Window.partitionBy(*by)
    on = F.coalesce(F.col(flag), F.lit(False))
    d = df.withColumn("_p", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_on", on)
    d = d.withColumn("_g", F.col("_p") - F.row_number().over(Window.partitionBy(*by, "_on").orderBy(order)))
    run = Window.partitionBy(*by, "_on", "_g")
    d = d.withColumns({"_a": F.min("_p").over(run), "_b": F.max("_p").over(run), "_len": F.max("station").over(run) - F.min("station").over(run)})
    fill = ~F.col("_on") & (F.col("_b") > F.col("_a")) & (F.col("_a") > 1) & (F.col("_b") < F.col("_n")) & (F.col("_len") < least)
    return d.withColumn("closed", F.col("_on") | fill).drop("_p", "_n", "_on", "_g", "_a", "_b", "_len")


def dashes(df: DataFrame, by: By, dash: float, space: float, order: str = "seq") -> DataFrame:
    """The vertices (dash, part, place, x, y, z) of each dash along a line: its start (part 0), the line's own vertices
    within it (1), and its end (2), by the plan length, place.  A line of at most a dash is one dash, whole; the last dash
    is cut at the line's end, and is none if a micrometre or less of it is left."""
    period, dash = float(dash + space), float(dash)
    whole = Window.partitionBy(*by)
    v = stations(df, by, order).withColumn("length", F.max("station").over(whole))
    k = F.floor(F.col("station") / period)
    short = F.col("length") <= dash
    edge = F.when(F.col(order) == F.min(order).over(whole), 0).when(F.col(order) == F.max(order).over(whole), 2).otherwise(1)
    inside = (F.col("station") > k * period) & (F.col("station") < F.least(k * period + dash, F.col("length")))
    own = v.withColumn("part", F.when(short, edge).when(inside, 1)).filter("part is not null")
    own = own.select(*by, F.when(short, 0).otherwise(k).cast("int").alias("dash"), F.col("part").cast("int").alias("part"), F.col("station").alias("place"), "x", "y", "z")
    s = segments(df, by, order).filter("station2 > station").withColumn("length", F.max("station2").over(whole)).filter(~short)
    ends = []
    for part, offset in ((0, 0.0), (2, dash)):
        at = F.col("k") * period + offset
        first = F.greatest(F.lit(0), F.ceil(F.round((F.col("station") - offset) / period, 9))).cast("int")
        last = F.floor(F.round((F.col("station2") - offset) / period, 9)).cast("int")
        e = s.withColumn("first", first).withColumn("last", last).filter("last >= first").withColumn("k", F.explode(F.sequence("first", "last")))
        # a place on a vertex belongs to the segment that begins there; a dash needs a length
        e = e.filter(((at < F.col("station2")) | ((at == F.col("length")) & F.lit(part == 2))) & (at >= F.col("station")) & ((F.col("length") - at > 1e-6) | F.lit(part == 2)))
        ends.append(e.select(*by, F.col("k").alias("dash"), F.lit(part).alias("part"), at.alias("place"), *_between(at)))
    rest = F.col("length") - F.floor(F.col("length") / period) * period
    tail = s.filter("station2 = length").filter((rest > 1e-6) & (rest < dash))
    ends.append(tail.select(*by, F.floor(F.col("length") / period).cast("int").alias("dash"), F.lit(2).alias("part"), F.col("length").alias("place"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("z2").alias("z")))
    return own.unionByName(ends[0]).unionByName(ends[1]).unionByName(ends[2])


def heading(df: DataFrame, by: By, window: float, order: str = "seq") -> DataFrame:
    """Direction (dx, dy) and grade at each sequence's end: from the last vertex that is window metres or more of
    walked length before it (the first, if none is), straight, in rise by plan distance.  Without a plan distance none."""
    whole = Window.partitionBy(*by)
    s = stations(df, by, order).withColumn("back", F.max("station").over(whole) - F.col("station"))
    last = F.max_by(F.struct("x", "y", "z"), order)
    there = F.col("back") >= max(window, 1e-6)
    far = F.coalesce(F.max_by(F.when(there, F.struct("x", "y", "z")), F.when(there, F.col(order))), F.min_by(F.struct("x", "y", "z"), order))
    g = s.groupBy(*by).agg(last.alias("e"), far.alias("f"))
    run = F.sqrt(F.pow(F.col("e.x") - F.col("f.x"), 2) + F.pow(F.col("e.y") - F.col("f.y"), 2))
    g = g.withColumn("run", F.when(run >= 1e-6, run))
    return g.select(*by, *(((F.col(f"e.{c}") - F.col(f"f.{c}")) / F.col("run")).alias(n) for c, n in (("x", "dx"), ("y", "dy"), ("z", "grade"))))


def stub(headings: DataFrame, by: By, side: str, most: float) -> DataFrame:
    """One direction and grade for a lane's end, from the headings of its two bounds (side, the left one first in
    order): the mean direction, made a unit again; the first bound's where they cancel out; the mean grade, at most
    most either way.  Lanes without any heading are left out."""
    g = headings.filter("dx is not null").groupBy(*by).agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.avg("grade").alias("mg"), F.min_by(F.struct("dx", "dy"), side).alias("one"))
    n = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    pick = lambda m, o: F.when(n < 1e-6, F.col(f"one.{o}")).otherwise(F.col(m) / n).alias(o)
    return g.select(*by, pick("mx", "dx"), pick("my", "dy"), F.greatest(F.lit(-most), F.least(F.lit(most), F.col("mg"))).alias("grade"))


def continuation(stubs: DataFrame, step: float) -> DataFrame:
    """ceil(length / step) evenly spaced points beyond a stub's end (x, y, z, dx, dy, grade, length), in k from 1."""
    n = F.ceil(F.col("length") / step).cast("int")
    d = F.col("k") * F.col("length") / n
    keys = [c for c in stubs.columns if c not in ("x", "y", "z", "dx", "dy", "grade", "length")]
    return stubs.filter("length > 0").withColumn("k", F.explode(F.sequence(F.lit(1), n))).select(*keys, "k", (F.col("x") + F.col("dx") * d).alias("x"), (F.col("y") + F.col("dy") * d).alias("y"), (F.col("z") + F.col("grade") * d).alias("z"))


def zebra_bars(df: DataFrame, by: By, bar: float, space: float, order: str = "seq") -> DataFrame:
    """Corners (bar, corner 0 to 3, x, y, z) of the bars across a crossing, whose bounds are the columns lx, ly, lz and
    rx, ry, rz of its cross-sections: as many as fit, centred along its middle line, each from the left bound to the
    right and back.  A crossing shorter than two bars has none."""
    step = bar + space
    whole, w = Window.partitionBy(*by), _w(by, order)
    sides = [f"{s}{c}" for s in "lr" for c in "xyz"]
    mid = df.withColumns({c: (F.col(f"l{c}") + F.col(f"r{c}")) / 2 for c in "xyz"})
    s = stations(mid, by, order).withColumns({f"{c}2": F.lead(c).over(w) for c in ("station", *sides)}).withColumn("length", F.max("station").over(whole))
    s = s.filter("station2 > station").filter(F.col("length") >= 2 * bar)
    s = s.withColumn("n", F.greatest(F.lit(1), F.floor((F.col("length") + space) / step)).cast("int")).withColumn("margin", (F.col("length") - (F.col("n") * step - space)) / 2)
    out = []
    for edge, offset, corners in ((0, 0.0, ((0, "l"), (1, "r"))), (1, float(bar), ((3, "l"), (2, "r")))):
        at = F.col("margin") + F.col("k") * step + offset
        first = F.greatest(F.lit(0), F.ceil(F.round((F.col("station") - F.col("margin") - offset) / step, 9))).cast("int")
        end = F.ceil(F.round((F.col("station2") - F.col("margin") - offset) / step, 9)).cast("int") - 1
        last = F.least(F.col("n") - 1, F.when(F.col("station2") == F.col("length"), F.col("n") - 1).otherwise(end))
        e = s.withColumn("first", first).withColumn("last", last).filter("last >= first").withColumn("k", F.explode(F.sequence("first", "last")))
        t = F.least(F.lit(1.0), (at - F.col("station")) / (F.col("station2") - F.col("station")))
        point = lambda side, t=t: [(F.col(f"{side}{c}") + (F.col(f"{side}{c}2") - F.col(f"{side}{c}")) * t).alias(c) for c in "xyz"]
        four = F.explode(F.array(*(F.struct(F.lit(n).alias("corner"), *point(side)) for n, side in corners))).alias("p")
        out.append(e.select(*by, F.col("k").alias("bar"), four).select(*by, "bar", "p.*"))
    return out[0].unionByName(out[1])


def thinned(df: DataFrame, by: By, spacing: float, order: str = "seq") -> DataFrame:
    """Segments (their first vertex and the next one's x2, y2, z2) at which a mark is due: walked lengths add up from
    half a spacing on, a mark takes a spacing off, and a segment makes one mark at most.

    With T(i) the length up to segment i's end plus half a spacing, A(i) = floor(T(i) / spacing) marks would be due,
    and E(i) = min(A(i), E(i - 1) + 1) are made, which is i + min(0, least A(j) - j so far): a running minimum."""
    w = _w(by, order)
    s = segments(df, by, order).filter(F.col("station2") - F.col("station") >= 1e-9)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_i", F.row_number().over(w)).withColumn("_t", F.sum(F.col("station2") - F.col("station")).over(run) + spacing / 2)
    made = F.col("_i") + F.least(F.lit(0), F.min(F.floor(F.col("_t") / spacing) - F.col("_i")).over(run))
    s = s.withColumn("_e", made).withColumn("_before", F.coalesce(F.lag("_e").over(w), F.lit(0)))
    return s.filter("_e > _before").drop("_before").drop("_i", "_t", "_e", "station", "station2")


def sliced(df: DataFrame, by: By, start: Column, stop: Column, order: str = "seq") -> DataFrame:
    """The vertices from number start to number stop of each sequence, counted from 0, both included."""
    at = F.row_number().over(_w(by, order)) - 1
    return df.withColumn("_at", at).filter((F.col("_at") >= start) & (F.col("_at") <= stop)).drop("_at")


def extended(df: DataFrame, more: DataFrame, by: By, point: str, order: str = "seq") -> DataFrame:
    """Lines with the continuations (point, k from 1 on, x, y, z) of their first and last points: those of the first
    before the line, the furthest first; those of the last behind it; at numbers all from 1."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({"_head": F.first(point).over(w), "_tail": F.last(point).over(w), "_n": F.row_number().over(_w(by, order))})
    own = d.select(*by, F.lit(1).alias("_part"), F.col("_n").alias("_at"), "x", "y", "z")
    tips = d.filter("_n = 1").select(*by, "_head", "_tail")
    for part, end, sign in ((0, "_head", -1), (2, "_tail", 1)):
        ahead = more.withColumnRenamed(point, end)
        own = own.unionByName(tips.join(ahead, end).select(*by, F.lit(part).alias("_part"), (F.col("k") * sign).alias("_at"), "x", "y", "z"))
    return own.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("_part", "_at"))).drop("_part", "_at")


def closed_ring(df: DataFrame, by: By, order: str = "seq", near: float = 1e-3) -> DataFrame:
    """Rings without a last vertex that repeats the first in plan; rings of fewer than three vertices are left out."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    gap = F.sqrt(F.pow(F.first("x").over(w) - F.last("x").over(w), 2) + F.pow(F.first("y").over(w) - F.last("y").over(w), 2))
    d = df.withColumns({"_n": F.count("*").over(whole), "_gap": gap, "_last": F.last(order).over(w)})
    d = d.filter(~((F.col("_n") > 2) & (F.col("_gap") < near) & (F.col(order) == F.col("_last")))).drop("_gap", "_last")
    return d.withColumn("_n", F.count("*").over(whole)).filter("_n >= 3").drop("_n")


def offset_ribbon(df: DataFrame, by: By, width: float, order: str = "seq") -> DataFrame:
    """Left and right bounds of a line: half the width aside of the mean of the directions before and behind each vertex."""
    w = _w(by, order)

    def unit(a: str, b: str) -> tuple[Column, Column]:
        dx, dy = (F.lead(c).over(w) - F.col(c) if a == "lead" else F.col(c) - F.lag(c).over(w) for c in ("x", "y"))
        n = F.sqrt(dx * dx + dy * dy)
        return F.coalesce(F.try_divide(dx, n), F.lit(0.0)), F.coalesce(F.try_divide(dy, n), F.lit(0.0))

    (ax, ay), (bx, by_) = unit("lag", ""), unit("lead", "")
    d = df.withColumns({"_tx": ax + bx, "_ty": ay + by_}).withColumn("_n", F.sqrt(F.col("_tx") * F.col("_tx") + F.col("_ty") * F.col("_ty")))
    half = width / 2
    nx, ny = F.coalesce(F.try_divide(-F.col("_ty"), F.col("_n")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("_tx"), F.col("_n")), F.lit(0.0))
    return d.withColumns({"left_x": F.col("x") + nx * half, "left_y": F.col("y") + ny * half, "right_x": F.col("x") - nx * half, "right_y": F.col("y") - ny * half}).drop("_tx", "_ty", "_n")


def join_route(df: DataFrame, by: By, piece: str, near: float, order: str = "seq") -> DataFrame:
    """The vertices of a route's pieces in one order, without a piece's first vertex that is within near of the one before it."""
    w = Window.partitionBy(*by).orderBy(piece, order)
    d = df.withColumn("_gap", F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))).withColumn("_new", F.coalesce(F.col(piece) != F.lag(piece).over(w), F.lit(False)))
    return d.filter(~(F.col("_new") & (F.col("_gap") < near))).withColumn("at", F.row_number().over(w)).drop("_gap", "_new")


def posts(df: DataFrame, by: By, spacing: float, order: str = "seq") -> DataFrame:
    """Posts at even distances on a whole line: max(round(length / spacing), 1) + 1 of them."""
    whole = Window.partitionBy(*by)
    s = segments(df, by, order).filter("station2 > station").withColumn("length", F.max("station2").over(whole))
    s = s.withColumn("n", F.greatest(F.lit(1), F.bround(F.col("length") / spacing).cast("int"))).withColumn("step", F.col("length") / F.col("n"))
    first = F.ceil(F.round(F.col("station") / F.col("step"), 9)).cast("int")
    last = F.when(F.col("station2") == F.col("length"), F.col("n")).otherwise(F.ceil(F.round(F.col("station2") / F.col("step"), 9)).cast("int") - 1)
    return s.withColumn("first", first).withColumn("last", last).filter("last >= first").withColumn("k", F.explode(F.sequence("first", "last"))).select(*by, "k", *_between(F.col("k") * F.col("step")))


def gradients(df: DataFrame, by: By, column: str, order: str = "seq") -> DataFrame:
    """Adds grad_<column>: central differences, one-sided at the ends."""
    w = _w(by, order)
    before, behind = F.lag(column).over(w), F.lead(column).over(w)
    g = F.when(before.isNull(), behind - F.col(column)).when(behind.isNull(), F.col(column) - before).otherwise((behind - before) / 2)
    return df.withColumn(f"grad_{column}", g)


def ring_area(df: DataFrame, by: By, order: str = "seq") -> DataFrame:
    """Signed area of each ring (shoelace)."""
    w = _w(by, order)
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(end)) for c in ("x", "y"))
    return df.withColumn("_c", F.col("x") * ny - nx * F.col("y")).groupBy(*by).agg((F.sum("_c") / 2).alias("area"))
