"""Railings on the bank of water, where the ground is out of the water and no road runs.

A pond is dug, so its bank is looked for: its outline is pushed outwards step by step, and the first at which nine tenths of
the ground along it are above the water is the bank.  All steps of all ponds are outlined at once, as contours by block;
the ground is sampled along each, and each pond takes its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.operators import contours, grid, kernels, regions, spatial
from roadspark.operators.graph import spread, stored

#: Places along an outline where the ground is asked for.
PLACES = 48


def _sampled(rims: DataFrame) -> DataFrame:
    """body, k, j, x, y: PLACES even places along the outer rings of each body and step."""
    w = Window.partitionBy("body", "k").orderBy("ring", "place")
    at = rims.withColumns({"start": F.sum("length").over(w) - F.col("length"), "total": F.sum("length").over(Window.partitionBy("body", "k"))})
    kind = rims.schema["body"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for body, k, start, size, total, points in zip(pdf["body"], pdf["k"], pdf["start"], pdf["length"], pdf["total"], pdf["points"]):
                p = np.array([(q["x"], q["y"]) for q in points], float)
                far = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
                j = np.arange(PLACES)
                d = j * total / PLACES - start
                j = j[(d >= 0) & (d < size)]
                d = j * total / PLACES - start
                out += [(body, k, int(i), float(np.interp(v, far, p[:, 0])), float(np.interp(v, far, p[:, 1]))) for i, v in zip(j, d)]
            if out:
                yield pd.DataFrame(out, columns=["body", "k", "j", "x", "y"])

    return at.select("body", "k", "start", "length", "total", "points").mapInPandas(run, f"body {kind}, k int, j int, x double, y double")


def banks(ponds: DataFrame, nodes: DataFrame, nx: int, ny: int, *, cell: float, setback: float = 0.25, step: float = 0.5, reach: float = 10.0, clearance: float = 0.1, clear: float = 0.9, block: float = 50.0) -> DataFrame:
    """Ordered chains of the bank of each pond (body, ring: array of x, y, a piece of it; level, the water's), outer rings alone:
    of its outlines setback and 0, step, 2 step, ... reach further out the first of which `clear` of the ground is clearance
    or more above the level, else the last.  Ground beyond the nodes, or of missing ones, is under water."""
    steps = int(round(reach / step))
    k = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    shapes = stored(ponds.filter(F.size("ring") >= 3).select("body", "ring").withColumn("k", k))

    def wider(wide, rings, body, k):
        own = regions.as_polygons(regions.intersection([[r] for r in rings], [[wide]]))
        return regions.grown(own, setback + int(k) * step)

    far = setback + reach + 1.0
    found = contours.ordered(contours.chains(shapes, wider, keys=["body", "k"], block=block, reach=far), ["body", "k"])
    outer = contours.measures(found, ["body", "k"]).filter("area > 0").select("body", "k", "ring")
    pair = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.sqrt(F.pow(F.element_at("points", i + 1)["x"] - F.element_at("points", i)["x"], 2) + F.pow(F.element_at("points", i + 1)["y"] - F.element_at("points", i)["y"], 2)))
    rims = stored(found.join(outer, ["body", "k", "ring"]).withColumn("length", F.aggregate(pair, F.lit(0.0), lambda a, v: a + v)))
    ground = grid.bilinear(_sampled(rims), nodes, ["body", "k", "j"], cell, nx, ny)
    level = ponds.groupBy("body").agg(F.max("level").alias("level"))
    dry = ground.join(level, "body").groupBy("body", "k").agg(F.avg(F.coalesce(F.col("z") >= F.col("level") + clearance, F.lit(False)).cast("double")).alias("share"))
    pick = dry.groupBy("body").agg(F.coalesce(F.min(F.when(F.col("share") >= clear, F.col("k"))), F.max("k")).alias("k"))
    return rims.join(pick, ["body", "k"])


def outside(p: np.ndarray, rings: list[np.ndarray]) -> list[np.ndarray]:
    """The stretches of a line that no ring covers."""
    out, run = [], []
    for a, b in zip(p, p[1:]):
        d, cut = b - a, [0.0, 1.0]
        for r in rings:
            e = np.roll(r, -1, axis=0) - r
            cross = d[0] * e[:, 1] - d[1] * e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((r[:, 0] - a[0]) * e[:, 1] - (r[:, 1] - a[1]) * e[:, 0]) / cross
                u = ((r[:, 0] - a[0]) * d[1] - (r[:, 1] - a[1]) * d[0]) / cross
            cut += t[(np.abs(cross) > 1e-14) & (t > 1e-9) & (t < 1 - 1e-9) & (u >= -1e-12) & (u <= 1 + 1e-12)].tolist()
        cut = sorted(set(cut))
        for s, e in zip(cut, cut[1:]):
            if any(kernels.contains(r, (a + d * (s + e) / 2)[None])[0] for r in rings):
                if run:
                    out.append(np.array(run))
                run = []
            else:
                run += [a + d * e] if run else [a + d * s, a + d * e]
    if run:
        out.append(np.array(run))
    return out


def railings(rims: DataFrame, roads: DataFrame, *, least: float = 3.0, cell: float = 25.0) -> DataFrame:
    """Pieces of railing (body, rail, ring, place, piece, points, length) along rims where no road (ring: array of x, y) runs:
    rails, pieces that go on into one another, of least metres or more."""
    at = lambda c: F.transform("points", lambda p: p[c])
    by = lambda a: F.transform("ring", lambda p: p[a])
    chain = rims.withColumns({"x0": F.array_min(at("x")), "x1": F.array_max(at("x")), "y0": F.array_min(at("y")), "y1": F.array_max(at("y"))})
    road = roads.filter(F.size("ring") >= 3).withColumns({"x0": F.array_min(by(0)), "x1": F.array_max(by(0)), "y0": F.array_min(by(1)), "y1": F.array_max(by(1))})
    near = spatial.cells_of_box(chain, cell).select("node", "cx", "cy").join(spatial.cells_of_box(road, cell).select(F.col("ring").alias("road"), "cx", "cy"), ["cx", "cy"]).select("node", "road").distinct()
    rows = rims.select("node", "body", "ring", "place", "points").join(near.groupBy("node").agg(F.collect_list("road").alias("roads")), "node", "left")
    rows = rows.withColumn("roads", F.coalesce("roads", F.array().cast("array<array<array<double>>>")))
    kind = rims.schema["body"].dataType.simpleString()

    def cut(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                p = np.array([(q["x"], q["y"]) for q in r["points"]], float)
                for n, q in enumerate(outside(p, [np.array([list(c) for c in g], float) for g in r["roads"]])):
                    whole = (bool(np.allclose(q[0], p[0], atol=1e-9)), bool(np.allclose(q[-1], p[-1], atol=1e-9)))
                    out.append((r["body"], r["ring"], r["place"], n, *whole, float(np.hypot(*np.diff(q, axis=0).T).sum()), [{"x": float(x), "y": float(y)} for x, y in q]))
            if out:
                yield pd.DataFrame(out, columns=["body", "ring", "place", "piece", "begins", "ends", "length", "points"])

    pieces = spread(rows, "node").mapInPandas(cut, f"body {kind}, ring long, place int, piece int, begins boolean, ends boolean, length double, points array<struct<x:double,y:double>>")
    w = Window.partitionBy("body", "ring").orderBy("place", "piece")
    goes_on = F.col("begins") & F.coalesce(F.lag("ends").over(w), F.lit(False)) & (F.coalesce(F.col("place") - F.lag("place").over(w), F.lit(9)) == 1)
    pieces = pieces.withColumn("rail", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    whole = Window.partitionBy("body", "ring")
    # where the ring closes its last rail goes on into its first
    wraps = F.max(F.when((F.col("place") == 0) & (F.col("piece") == 0), F.col("begins"))).over(whole) & F.max_by("ends", F.struct("place", "piece")).over(whole)
    last = F.max("rail").over(whole)
    pieces = pieces.withColumn("rail", F.when(F.coalesce(wraps, F.lit(False)) & (F.col("rail") == last), 1).otherwise(F.col("rail")))
    size = F.sum("length").over(Window.partitionBy("body", "ring", "rail"))
    return pieces.withColumn("run", size).filter(F.col("run") >= least).select("body", "ring", "rail", "place", "piece", "points", "length")
