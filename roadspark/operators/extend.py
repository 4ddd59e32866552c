"""Roads that the map's edge cut off, run on to the edge: what is in the way, whether the way leaves the survey, and who goes
first.

A stub is a loose end (lx, ly, rx, ry: its left and right bound, dx, dy: its heading, limit: metres to the edge).  Its sweep
is the quad that it would cover.  Sweeps and the rings in their way meet in the grid cells along the sweep; only pairs that
share a cell are cut with each other.  Stubs are granted in the order of their keys, each beside the sweeps granted before;
as only stubs whose sweeps can meet have to wait for each other, a round decides all that wait for nobody.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.operators import kernels, regions, spatial
from roadspark.operators.graph import spread, stored

#: Square metres of overlap that count as none: contact along a side stops nothing.
CONTACT = 0.05
_STUB = ("lx", "ly", "rx", "ry", "dx", "dy")


def _sweep(lx: float, ly: float, rx: float, ry: float, dx: float, dy: float, length: float) -> np.ndarray:
    d = np.array([dx, dy]) * length
    left, right = np.array([lx, ly]), np.array([rx, ry])
    return np.array([left, left + d, right + d, right])


def nearest_overlap(stub: tuple, length: float, ring: np.ndarray, contact: float = CONTACT) -> float:
    """How far along its heading a stub's sweep first covers part of a ring; infinite if it covers contact or less."""
    quad = _sweep(*stub, length)
    if (quad.max(0) < ring.min(0)).any() or (ring.max(0) < quad.min(0)).any():
        return np.inf
    a, b = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    bend = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    origin, axis = (quad[0] + quad[3]) / 2, np.array(stub[4:])
    if (bend >= 0).all() or (bend <= 0).all():  # convex: one cut after another
        corners = kernels.clip_convex(ring, quad if kernels.area(quad) > 0 else quad[::-1])
        return max(0.0, float(((corners - origin) @ axis).min())) if len(corners) > 2 and abs(kernels.area(corners)) > contact else np.inf
    common = regions.intersection([[quad]], [[ring]])
    if regions.area(common) <= contact:
        return np.inf
    t = np.array([x for row in common for x in row])
    corners = np.concatenate([t[:, [x, y]] for x, y in ((2, 0), (4, 0), (3, 1), (5, 1))])
    return max(0.0, float(((corners - origin) @ axis).min()))


def _clipped(rings: np.ndarray, quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kernels.clip_convex() of n rings (n, k, 2) by a quad each, all at once: which of them have points left, and those,
    the last one repeated."""
    ways = np.roll(quads, -1, axis=1)
    turned = (quads[..., 0] * ways[..., 1] - ways[..., 0] * quads[..., 1]).sum(1) <= 0
    quads = np.where(turned[:, None, None], quads[:, ::-1], quads)
    alive, out = np.arange(len(rings)), rings
    for k in range(4):
        a, b = quads[alive, k][:, None], quads[alive, (k + 1) % 4][:, None]
        side = (b[..., 0] - a[..., 0]) * (out[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (out[..., 0] - a[..., 0])
        before, q = np.roll(side, 1, axis=1), np.roll(out, 1, axis=1)
        keep = side >= 0
        cross = keep != (before >= 0)
        u = np.divide(before, before - side, out=np.zeros_like(side), where=cross)
        both = np.stack((q + u[..., None] * (out - q), out), axis=2).reshape(len(out), -1, 2)
        has = np.stack((cross, keep), axis=2).reshape(len(out), -1)
        n = has.sum(1)
        some = n > 0
        alive, both, has, n = alive[some], both[some], has[some], n[some]
        if not len(alive):
            return alive, both[:, :0]
        order = np.argsort(~has, axis=1, kind="stable")
        at = np.take_along_axis(order, np.minimum(np.arange(n.max()), n[:, None] - 1), axis=1)
        out = np.take_along_axis(both, at[..., None], axis=1)
    return alive, out


def nearest_overlaps(stubs: np.ndarray, lengths: np.ndarray, rings: np.ndarray, starts: np.ndarray, contact: float = CONTACT) -> np.ndarray:
    """nearest_overlap() of many stubs (n, 6) with a ring each, whose corners are rings[starts[i]:starts[i + 1]]: convex rings
    of as many corners are cut all at once."""
    found, size = np.full(len(stubs), np.inf), np.diff(starts)
    ahead = stubs[:, 4:] * lengths[:, None]
    left, right = stubs[:, :2], stubs[:, 2:4]
    quads = np.stack((left, left + ahead, right + ahead, right), axis=1)
    for k in np.unique(size):
        of = np.flatnonzero(size == k)
        ring = rings[starts[of][:, None] + np.arange(k)]
        apart = (quads[of].max(1) < ring.min(1)).any(1) | (ring.max(1) < quads[of].min(1)).any(1)
        of, ring = of[~apart], ring[~apart]
        a, b = ring - np.roll(ring, 1, axis=1), np.roll(ring, -1, axis=1) - ring
        bend = a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
        convex = (bend >= 0).all(1) | (bend <= 0).all(1)
        for i, r in zip(of[~convex], ring[~convex]):
            found[i] = nearest_overlap(tuple(stubs[i]), float(lengths[i]), r, contact)
        of, ring = of[convex], ring[convex]
        alive, left_over = _clipped(ring, quads[of]) if len(of) else (of, ring)
        if not len(alive):
            continue
        of, nxt = of[alive], np.roll(left_over, -1, axis=1)
        area = np.abs((left_over[..., 0] * nxt[..., 1] - nxt[..., 0] * left_over[..., 1]).sum(1) / 2)
        origin, axis = (quads[of, 0] + quads[of, 3]) / 2, stubs[of, 4:]
        along = ((left_over - origin[:, None]) * axis[:, None]).sum(2).min(1)
        found[of] = np.where(area > contact, np.maximum(0.0, along), np.inf)
    return found


def _swept(stubs: DataFrame, length: str, cell: float) -> DataFrame:
    """stubs with the boxes (x0, y0, x1, y1) of their sweeps, a piece of one cell's length at a time."""
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(length) / cell).cast("int") - 1, F.lit(0))))
    s = stubs.filter(F.col(length) > 0).withColumn("_k", k)
    a, b = F.col("_k") * cell, F.least((F.col("_k") + 1) * cell, F.col(length))
    ends = lambda p, d: [F.col(f"{s_}{p}") + F.col(d) * t for s_ in "lr" for t in (a, b)]
    return s.withColumns({"x0": F.least(*ends("x", "dx")), "x1": F.greatest(*ends("x", "dx")), "y0": F.least(*ends("y", "dy")), "y1": F.greatest(*ends("y", "dy"))}).drop("_k")


def swept_cells(stubs: DataFrame, length: str, cell: float) -> DataFrame:
    """stubs with cx, cy of the cells along their sweeps."""
    return spatial.cells_of_box(_swept(stubs, length, cell), cell).select(*stubs.columns, "cx", "cy").distinct()


def _first_overlaps(pairs: DataFrame, key: list[str], length: str) -> DataFrame:
    """key and obstacle: the least of nearest_overlap() over pairs (key, a stub, its length, ring); none without one."""
    flat = F.flatten(F.transform("ring", lambda p: F.slice(p, 1, 2)))
    pairs = pairs.select(F.struct(*key).alias("_key"), *_STUB, F.col(length).cast("double").alias("_length"), flat.alias("ring"))

    def run(batches):
        for batch in batches:
            column = lambda n: batch.column(n).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            ring = batch.column("ring")
            corners = ring.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
            starts = np.concatenate(([0], np.cumsum(ring.value_lengths().to_numpy(zero_copy_only=False)))) // 2
            found = nearest_overlaps(np.column_stack([column(c) for c in _STUB]), column("_length"), corners, starts.astype(int))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found)], ["_key", "obstacle"])

    cut = pairs.mapInArrow(run, f"_key {pairs.schema['_key'].dataType.simpleString()}, obstacle double")
    return cut.filter(F.col("obstacle") < float("inf")).groupBy("_key").agg(F.min("obstacle").alias("obstacle")).select("_key.*", "obstacle")


def blocked(stubs: DataFrame, rings: DataFrame, key: list[str], own: str, *, length: str = "limit", cell: float = 25.0) -> DataFrame:
    """stubs with obstacle: how far each gets before it covers part of a ring (own, ring: array of x, y) other than its own;
    null where the way is clear.  Rings of fewer than three corners are in nobody's way."""
    at = lambda axis: F.transform("ring", lambda p: p[axis])
    box = {"x0": F.array_min(at(0)), "y0": F.array_min(at(1)), "x1": F.array_max(at(0)), "y1": F.array_max(at(1))}
    r = rings.filter(F.size("ring") >= 3).withColumns(box).select(F.col(own).alias("_other"), "ring", *box)
    columns = list(dict.fromkeys([*key, own, *_STUB, length]))
    left, found, reach = stored(stubs.select(*columns)), None, cell
    while True:  # a stretch of each sweep, and four times as much of those that met nothing in it
        part = _swept(left.withColumn("_part", F.least(length, F.lit(reach))), "_part", cell)
        pairs = spatial.touching_boxes(part, r, cell).filter(F.col("b__other") != F.col(f"a_{own}"))
        pairs = pairs.select(*(F.col(f"a_{c}").alias(c) for c in columns), F.col("b_ring").alias("ring"))
        met = stored(left.join(_first_overlaps(pairs, key, length), key, "left"))
        over = (F.col("obstacle") <= reach) | (F.col(length) <= reach)
        done = met.filter(over & F.col("obstacle").isNotNull()).select(*key, "obstacle")
        found = done if found is None else found.unionByName(done)
        left = met.filter(~F.coalesce(over, F.lit(False))).select(*columns)
        if left.isEmpty():
            return stubs.join(found, key, "left")
        left, found, reach = stored(left), stored(found), 4 * reach


def outline(rings: DataFrame) -> np.ndarray:
    """The convex hull of all rings' corners.  Each task sends its own hull, whose corners are few."""

    def run(batches):
        held = np.zeros((0, 2))
        for pdf in batches:
            points = [held, *(np.array([list(p) for p in r], float)[:, :2] for r in pdf["ring"] if len(r))]
            held = kernels.hull(np.concatenate(points))
        if len(held):
            yield pd.DataFrame(held, columns=["x", "y"])

    got = rings.select("ring").filter("ring is not null").mapInPandas(run, "x double, y double").collect()
    return kernels.hull(np.array([(r.x, r.y) for r in got], float).reshape(-1, 2)) if got else np.zeros((0, 2))


def leaves(stubs: DataFrame, hull: np.ndarray, *, margin: float, within: float) -> DataFrame:
    """stubs with leaves: whether one gets out of the survey (its hull and margin metres around) in so many metres.  The
    survey is convex, so a way stays inside if both its ends do; without a survey everything leaves it."""

    def outside(p: np.ndarray) -> np.ndarray:
        if len(hull) < 3:
            return np.ones(len(p), bool)
        return ~kernels.contains(hull, p) & (kernels.outline_distance(hull, p) > margin)

    @F.pandas_udf("boolean")
    def gone(x: pd.Series, y: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        a = np.column_stack((x, y)).astype(float)
        return pd.Series(outside(a) | outside(a + within * np.column_stack((dx, dy)).astype(float)))

    return stubs.withColumn("leaves", gone((F.col("lx") + F.col("rx")) / 2, (F.col("ly") + F.col("ry")) / 2, "dx", "dy"))


def granted(stubs: DataFrame, rings: DataFrame, key: list[str], own: str, *, clearance: float, least: float, cell: float = 25.0) -> DataFrame:
    """key and length of each stub in the order of key: to its limit, or to clearance before a ring of another owner or the
    sweep of a stub granted before it; 0 for less than least.  Keys are unique."""
    from roadspark.functions import scalar

    length = lambda obstacle: scalar.reach(F.col("limit"), obstacle, clearance=clearance, least=least)
    first = blocked(stubs.select(*dict.fromkeys([*key, own, *_STUB, "limit"])), rings, key, own, cell=cell)
    first = stored(first.withColumn("most", length(F.col("obstacle"))))
    order = F.struct(*key)
    # an earlier stub's longest sweep against a later one's whole way
    a = first.filter("most > 0").select(order.alias("a"), *(F.col(c).alias(f"a_{c}") for c in (*_STUB, "most")))
    a = swept_cells(a.select("a", *(F.col(f"a_{c}").alias(c) for c in _STUB), F.col("a_most").alias("most")), "most", cell)
    a = a.select("a", "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in (*_STUB, "most")))
    b = swept_cells(first.filter("most > 0").select(order.alias("b"), *_STUB, "limit"), "limit", cell)
    pairs = a.join(b, ["cx", "cy"]).filter(F.col("a") < F.col("b")).drop("cx", "cy").distinct()

    def meet(batches):
        for pdf in batches:
            a, b = (pdf[list(c)].to_numpy(float) for c in ((*(f"a_{c}" for c in _STUB), "a_most"), (*_STUB, "limit")))
            ahead = a[:, 4:6] * a[:, 6:]
            sweeps = np.stack((a[:, :2], a[:, :2] + ahead, a[:, 2:4] + ahead, a[:, 2:4]), axis=1)
            yield pdf[nearest_overlaps(b[:, :6], b[:, 6], sweeps.reshape(-1, 2), 4 * np.arange(len(a) + 1)) < np.inf]

    pairs = stored(spread(pairs, "a", "b").mapInPandas(meet, pairs.schema))
    state = stored(first.select(order.alias("k"), "most", "obstacle", "limit", F.when(F.col("most") <= 0, 0.0).alias("length")))
    while True:
        waiting = state.filter("length is null").select(F.col("k"))
        if waiting.isEmpty():
            break
        held = pairs.join(waiting.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        ready = waiting.join(held, "k", "left_anti")
        before = state.filter("length > 0").select(F.col("k").alias("a"), F.col("length").alias("a_length"))
        now = pairs.join(ready.withColumnRenamed("k", "b"), "b", "left_semi").join(before, "a")
        d = lambda s, t: F.array(F.col(f"a_{s}x") + F.col("a_dx") * t, F.col(f"a_{s}y") + F.col("a_dy") * t)
        ring = F.array(d("l", F.lit(0.0)), d("l", F.col("a_length")), d("r", F.col("a_length")), d("r", F.lit(0.0)))
        met = _first_overlaps(now.select(F.col("b").alias("k"), *_STUB, "limit", ring.alias("ring")), ["k"], "limit").withColumnRenamed("obstacle", "met")
        new = ready.withColumn("ready", F.lit(True)).join(met, "k", "left")
        state = state.join(new, "k", "left").withColumn("length", F.when(F.col("length").isNull() & F.col("ready"), length(F.least("obstacle", "met"))).otherwise(F.col("length"))).select("k", "most", "obstacle", "limit", "length")
        state = stored(state)
    return state.select("k.*", "length")


def claims(grants: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """point_id and length: how far each end point (key, point_id) moves; of several claims to a point the shortest."""
    return points.join(grants.filter("length > 0"), key).groupBy("point_id").agg(F.min("length").alias("length"))
