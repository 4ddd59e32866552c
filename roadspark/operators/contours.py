"""Outlines of areas that lie over many blocks, without gathering an area or a ring anywhere.

Each block finds the pieces of outline that run through it, as chains of points; a chain ends where it leaves the block, or
is closed within it.  Chains follow one another where their ends meet, so each has one successor, and doubling of successors
names every ring after its least chain and counts the chains' places in it: as many rounds, each a written table, as the
logarithm of a ring's chains.  Lengths and areas of rings are sums over their chains; chains are thinned out one by one,
with their ends fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.operators import regions
from roadspark.operators.areas import Region, Square, listed, square_of
from roadspark.operators.graph import spread, stored

#: Metres within which two ends are one.
WELD = 1e-3
_CHAIN = "closed boolean, ax long, ay long, bx long, by long, turn double, points array<struct<x:double,y:double>>"


def _key(v: float) -> int:
    return int(round(round(float(v), 7) / WELD))


def chains_within(rings: list[np.ndarray], square: Square) -> list[np.ndarray]:
    """The stretches of rings within a square, its lower sides included and its upper ones not; closed ones end where they
    begin."""
    (x0, y0), (x1, y1) = square[0], square[2]
    out = []
    for r in rings:
        pieces: list[tuple[np.ndarray, np.ndarray, bool]] = []
        for a, b in zip(r, np.roll(r, -1, axis=0)):
            cut = [0.0, 1.0]
            for axis, low, high in ((0, x0, x1), (1, y0, y1)):
                d = b[axis] - a[axis]
                cut += [t for v in (low, high) if abs(d) > 1e-12 and 1e-12 < (t := (v - a[axis]) / d) < 1 - 1e-12]
            cut = sorted(set(cut))
            at = [a + t * (b - a) for t in cut]
            at[0], at[-1] = a, b
            for p, q in zip(at, at[1:]):
                m = (p + q) / 2
                pieces.append((p, q, bool(x0 - 1e-9 <= m[0] < x1 - 1e-9 and y0 - 1e-9 <= m[1] < y1 - 1e-9)))
        if all(inside for *_, inside in pieces):
            out.append(np.array([p for p, *_ in pieces] + [pieces[0][0]]))
            continue
        start = next(i for i, piece in enumerate(pieces) if not piece[2])
        run: list[np.ndarray] = []
        for p, q, inside in pieces[start:] + pieces[:start]:
            if inside:
                run += [q] if run else [p, q]
            elif run:
                out.append(np.array(run))
                run = []
        if run:
            out.append(np.array(run))
    return out


def thinned(p: np.ndarray, by: float) -> np.ndarray:
    """A chain with as few of its points as stay within a distance of it; both ends stay, and of a closed chain the point
    furthest from its end."""
    if by <= 0 or len(p) < 3:
        return p
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = p[i], p[j] - p[i]
        size = float(np.hypot(*d))
        between = p[i + 1 : j] - a
        away = np.hypot(*between.T) if size < 1e-9 else np.hypot(*(between - np.clip(between @ d / size**2, 0, 1)[:, None] * d).T)
        k = int(away.argmax())
        if away[k] > by or size < 1e-9:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep]


def chains(shapes: DataFrame, f: Callable[..., Region], *, keys: Sequence[str] = (), block: float, reach: float, thin: float = 0.0) -> DataFrame:
    """The chains of the outlines of f's region (of a block with reach around it, from the shapes there; with keys f is given
    their values too), counter-clockwise around areas and clockwise around their holes; node is a chain's own number."""
    rows = listed(shapes, block, reach, keys)
    names = [*keys, *(c.split()[0] for c in _CHAIN.split(", "))]
    schema = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys) + _CHAIN

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        square = square_of(key[-2], key[-1], block)
        wide = square + reach * np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])
        shapes_ = sorted((np.array([list(p) for p in r], float) for r in pdf["ring"]), key=lambda r: r.tolist())
        out = []
        for c in chains_within(regions.outlines(f(wide, shapes_, *key[:-2])), square):
            closed = bool((c[0] == c[-1]).all())
            c = thinned(c, thin)
            if len(c) < (4 if closed else 2):
                continue
            first = c[1] - c[0]
            out.append((*key[:-2], closed, _key(c[0, 0]), _key(c[0, 1]), _key(c[-1, 0]), _key(c[-1, 1]), float(np.arctan2(first[1], first[0])), [{"x": float(x), "y": float(y)} for x, y in c]))
        return pd.DataFrame(out, columns=names)

    found = spread(rows, *keys, "bx", "by").groupBy(*keys, "bx", "by").applyInPandas(run, schema)
    return stored(found.withColumn("node", F.monotonically_increasing_id()))


def ordered(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """chains with ring, the least node of their ring, and place, from 0 at that one on.  Where rings touch in a point, a
    chain is followed by the one that turns furthest to the left, which keeps them apart."""
    loose = found.filter("not closed")
    last = F.element_at("points", -1)
    before = F.element_at("points", -2)
    ends = loose.select(*keys, "node", F.col("bx").alias("kx"), F.col("by").alias("ky"), F.atan2(last["y"] - before["y"], last["x"] - before["x"]).alias("arrives"))
    begins = loose.select(*keys, F.col("node").alias("next"), F.col("ax").alias("kx"), F.col("ay").alias("ky"), "turn")
    left = F.pmod(F.col("turn") - F.col("arrives") + np.pi, F.lit(2 * np.pi))
    step = stored(ends.join(begins, [*keys, "kx", "ky"]).groupBy("node").agg(F.max_by("next", left).alias("next")))
    far = stored(step.withColumn("least", F.least("node", "next")))
    while True:
        ahead = far.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        new = far.join(ahead, "next", "left").select("node", F.coalesce("next2", "next").alias("next"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("least2") < F.col("least")).alias("moved"))
        new = stored(new)
        far = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    ring = far.select("node", F.col("least").alias("ring"))
    # the way from each chain to the last of its ring
    way = step.join(ring, "node").select("node", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"))
    way = stored(way.withColumn("left", F.when(F.col("next").isNotNull(), 1).otherwise(0)))
    while not way.filter("next is not null").isEmpty():
        ahead = way.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        way = stored(way.join(ahead, "next", "left").select("node", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    placed = ring.join(way.select("node", "left"), "node")
    size = placed.groupBy("ring").agg((F.max("left")).alias("most"))
    placed = placed.join(size, "ring").select("node", "ring", (F.col("most") - F.col("left")).cast("int").alias("place"))
    return found.join(placed, "node", "left").withColumns({"ring": F.coalesce("ring", "node"), "place": F.coalesce("place", F.lit(0))})


def measures(chains_: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each ring's area (negative around holes), length and corners, of ordered() chains."""
    pair = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))
    cross = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    length = F.aggregate(pair, F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], 2) + F.pow(p["b"]["y"] - p["a"]["y"], 2)))
    return chains_.groupBy(*keys, "ring").agg((F.sum(cross) / 2).alias("area"), F.sum(length).alias("length"), F.sum(F.size("points") - 1).alias("corners"), F.count("*").alias("chains"))


def _squares(cells: DataFrame, cell: float, keys: Sequence[str]) -> DataFrame:
    x, y = F.col("ix") * float(cell), F.col("iy") * float(cell)
    return cells.select(*keys, F.array(F.array(x, y), F.array(x + cell, y), F.array(x + cell, y + cell), F.array(x, y + cell)).alias("ring"))


def cell_outlines(cells: DataFrame, *, cell: float, keys: Sequence[str] = (), rounded: bool = False, block: float | None = None) -> DataFrame:
    """Ordered chains around cells (ix, iy; keys: each value is an area of its own).

    rounded: the stairs' corners are rounded off, by closing and opening by three quarters of a cell, and what lies within
    half a cell of the outline is thinned out; an area of which that leaves half or less keeps its stairs.
    """
    block = block or 32 * cell
    plain = lambda wide, rings, *_: regions.intersection([[r] for r in rings], [[wide]])
    shapes = stored(_squares(cells.filter("ix is not null and iy is not null"), cell, keys))
    if not rounded:
        return ordered(chains(shapes, plain, keys=keys, block=block, reach=cell), keys)
    by = 0.75 * cell

    def smooth(wide, rings, *_):
        area = regions.as_polygons(regions.intersection([[r] for r in rings], [[wide]]))
        area = regions.as_polygons(regions.shrunk(regions.as_polygons(regions.grown(area, by)), 2 * by))
        return regions.grown(area, by)

    soft = ordered(chains(shapes, smooth, keys=keys, block=block, reach=6 * cell, thin=0.5 * cell), keys)
    size = cells.distinct().groupBy(*keys).agg((F.count("*") * cell * cell).alias("whole"))
    left = measures(soft, keys).groupBy(*keys).agg(F.sum("area").alias("left"))
    if not keys:
        lost = size.crossJoin(left.agg(F.coalesce(F.sum("left"), F.lit(0.0)).alias("left"))).filter("left <= 0.5 * whole")  # one row each
        return cell_outlines(cells, cell=cell, block=block) if not lost.isEmpty() else soft
    lost = stored(size.join(left, [*keys], "left").filter("coalesce(left, 0) <= 0.5 * whole").select(*keys))
    stairs = ordered(chains(shapes.join(lost, [*keys], "left_semi"), plain, keys=keys, block=block, reach=cell), keys)
    return soft.join(lost, [*keys], "left_anti").unionByName(stairs.join(lost, [*keys], "left_semi"))
