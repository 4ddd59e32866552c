"""How joins are planned, whatever the estimates say."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from roadspark.operators import mesh, spatial


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_boxes_are_not_broadcast(spark):
    """A map looks small where its shapes are made of a column or two, and its cells aren't counted."""
    box = spark.range(40).select("id", *((F.col("id") % 7 * 3.0 + k).alias(n) for n, k in (("x0", 0), ("y0", 1), ("x1", 5), ("y1", 9))))
    pairs = spatial.overlapping_boxes(box, 4.0, F.lit(True))
    assert "BroadcastExchange" not in _plan(pairs) and pairs.count() == len({(a, b) for a in range(40) for b in range(a + 1, 40) if abs(a % 7 - b % 7) * 3 < 5})
    left, right = box.select("id", F.col("x0").alias("x"), F.col("y0").alias("y")), box.select(F.col("x1").alias("r_x"), F.col("y1").alias("r_y"))
    assert "BroadcastExchange" not in _plan(spatial.within(left, right, 10.0))


def test_places_on_a_lane_are_not_sorted_by_triangle(spark):
    """A point's meetings with its lane's triangles are added up in a hash table: a lane of 4 m by 30 m, three quads."""
    strip = spark.range(4).select(F.lit(1).alias("line_id"), F.col("id").alias("seq"), *((F.col("id") * 10.0 if c == "x" else F.lit(y if c == "y" else 0.0)).alias(f"{s}{c}") for s, y in (("l", 4.0), ("r", 0.0)) for c in "xyz"))
    points = spark.createDataFrame([(1, 7, 15.0, 1.0), (1, 8, 29.0, 4.0), (1, None, 10.0, 2.0), (1, 9, None, 2.0)], "line_id int, event_id long, px double, py double")
    got = mesh.lane_project(points, mesh.lane_frame(strip, ["line_id"]), ["line_id"], "event_id")
    plan = _plan(got)
    assert "max_by(" not in plan and re.search(r"HashAggregate\(keys=\[[^]]*\], functions=\[(partial_)?max\(_in", plan)
    rows = {r["event_id"]: tuple(None if v is None else round(v, 6) for v in (r["u"], r["v"])) for r in got.collect()}
    assert rows == {7: (0.5, 0.75), 8: (round(29 / 30, 6), 0.0), None: (round(1 / 3, 6), 0.5), 9: (None, None)}


def test_points_meet_the_quads_around_them(spark, monkeypatch):
    """A lane of 60 quads with a flat one and a turn: points on it meet few of them, and all places are those that the whole
    lane gives, also far off it."""
    met, weighed = [], mesh._weighed

    def spy(df):
        met.append(df.count())
        return weighed(df)

    at = lambda k: (k * 5.0, 0.0) if k < 30 else (150.0, (k - 30) * 5.0)
    rows = [(1, k, x, y + 3.0, 0.0, x + 3.0, y, 0.0) for k, (x, y) in ((k, at(min(k, 59))) for k in range(61))]
    frame = mesh.lane_frame(spark.createDataFrame(rows, "line_id int, seq long, " + ", ".join(f"{c} double" for c in mesh.SIDES)), ["line_id"])
    on = [(1, i, at(k)[0] + i % 5 * 0.7, at(k)[1] + 1.0) for i, k in enumerate(range(1, 58))]
    points = spark.createDataFrame([*on, (1, 900, -400.0, 70.0), (1, 901, None, 1.0)], "line_id int, event_id long, px double, py double")
    places = lambda: sorted((r.event_id, *(None if v is None else round(v, 6) for v in (r.u, r.v))) for r in mesh.lane_project(points, frame, ["line_id"], "event_id").collect())
    monkeypatch.setattr(mesh, "_weighed", spy)
    got = places()
    assert sum(met[:2]) < 20 * len(on) and len(got) == len(on) + 2
    monkeypatch.setattr(mesh, "_weighed", weighed)
    monkeypatch.setattr(mesh, "FEW", 1000)
    assert got == places()


def test_points_in_one_place_are_one(spark, monkeypatch):
    seen, step = [], spatial._nearest_segment

    def spy(points, lines, key, radius):
        seen.append(points.count())
        return step(points, lines, key, radius)

    monkeypatch.setattr(spatial, "_nearest_segment", spy)
    points = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3 * 100.0).alias("px"), F.lit(2.0).alias("py"))
    lines = spark.createDataFrame([(0.0, 0.0, 5.0, 10.0, 0.0, 5.0), (0.0, 4.0, 3.0, 10.0, 4.0, 3.0)], "x double, y double, z double, x2 double, y2 double, z2 double")
    got = sorted((r["k"], round(r["dist"], 3), r["height"]) for r in spatial.nearest_segment(points, lines, "k", 5.0).collect())
    far = {0: 2.0, 1: round((90**2 + 2**2) ** 0.5, 3), 2: round((190**2 + 2**2) ** 0.5, 3)}
    assert seen == [3] and got == [(k, far[k % 3], 3.0) for k in range(30)]
