"""How much work kernels and rounds do: what needn't be worked out isn't, and the results are the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from roadspark.operators import areas, graph, kernels, massing, regions, roofs, triangulate


def box(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def test_only_narrow_ground_is_drawn_in(monkeypatch):
    """a gap of 0.8 m is, the open ground is not; both are told apart as when all of it was."""
    square = areas.square_of(0, 0, 50.0)
    rings = [box(5, 5, 20, 20), box(20.8, 5, 40, 20), box(5, 20, 40, 22), box(5, 3, 40, 5), box(60, 60, 70, 70)]
    seen, step = [], regions.shrunk
    monkeypatch.setattr(regions, "shrunk", lambda polygons, by, join="round": seen.append(sum(len(r) for p in polygons for r in p)) or step(polygons, by, join))
    found = regions.parts(regions.difference([[square]], [[r] for r in rings]))
    wide = areas.are_wide(found, rings, 1.0)
    assert sorted((round(regions.area(p), 6), w) for p, w in zip(found, wide)) == [(12.0, False), (2500 - 35 * 19, True)]
    assert len(seen) == 1 and seen[0] < 20
    assert areas.are_wide(regions.parts(regions.difference([[square]], [])), [], 1.0) == [True]


def test_long_components_take_few_rounds(spark, monkeypatch):
    """A way of 3,000 nodes whose names lie anyhow; labels met their neighbours' alone before."""
    n = 3000
    name = np.random.default_rng(5).permutation(n) + 10
    edges = [(int(a), int(b)) for a, b in zip(name, name[1:])] + [(3, 4), (5, 5)]
    seen, step = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(1) or step(df))
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(int(x), 10) for x in name} | {(3, 3), (4, 3), (5, 5)}
    assert len(seen) < 30


def _convex(rng):
    turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(4, 9)))
    return np.stack((rng.uniform(3, 30) * np.cos(turn), rng.uniform(3, 30) * np.sin(turn)), axis=1) + rng.uniform(-50, 50, 2)


def test_convex_rings_are_cut_and_drawn_in_as_any(monkeypatch):
    """what the few lines for convex rings give is what sweeps give, corner by corner."""
    rng = np.random.default_rng(4)
    same = lambda a, b: len(a) == len(b) and all(x[0].shape == y[0].shape and np.allclose(x[0], y[0], atol=1e-6) for x, y in zip(a, b))
    for _ in range(40):
        r, by, d = _convex(rng), rng.uniform(0.01, 3), rng.normal(size=2)
        c, d, far = regions.convex([r[::-1]]), d / np.hypot(*d), 1e3
        assert same([[c]], regions.as_polygons(regions.union([[r]])))
        left, at, across = regions.drawn_in(c, by), float((r @ d).mean()), np.array([-d[1], d[0]])
        assert same([[left]] if len(left) else [], regions.as_polygons(regions.shrunk([[r]], by, "mitre")))
        for side, (u0, u1) in zip(regions.cut_convex(c, d, at), ((-far, at), (at, far))):
            half = np.array([d * u + across * v for u, v in ((u0, -far), (u1, -far), (u1, far), (u0, far))])
            assert same(side, regions.as_polygons(regions.intersection([[r]], [[half]])))
        share = rng.uniform(0.05, 0.95)
        got = regions.inset_to_share([r], share)
        assert abs(regions.area(regions.union(got)) - share * regions.area(regions.union([[r]]))) < 1e-6
        with monkeypatch.context() as m:
            m.setattr(regions, "convex", lambda polygon: None)
            assert np.allclose(got[0][0], regions.inset_to_share([r], share)[0][0], atol=1e-5)
    star = np.array([[np.cos(t), np.sin(t)] for t in np.arange(5) * 4 * np.pi / 5])
    assert regions.convex([star]) is None and regions.convex([box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)]) is None
    assert regions.convex([np.array([[0, 0], [2, 0], [4, 0], [4, 4], [0, 4]], float)]) is None and regions.convex([np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)]) is None


def test_plain_plots_need_no_sweep(monkeypatch):
    """neither a four-sided plot's plan nor its inset sweeps slabs."""
    draw = {"wall": True, "depth": 0.25, "street": True, "wing": True, "court": True, "court_u": 0.5, "court_v": 0.4, "court_stretch": 1.2, "form": "gable", "pitch": 0.4, "parapet": False}
    monkeypatch.setattr(regions, "combine", None)
    parts, has = massing.plan(np.array([[0, 0], [50, 4], [52, 30], [0, 26]], float), 0.0, 9.0, draw)
    assert has == ["forecourt", "wing", "court", "gable", "wall"] and [p[0] for p in parts] == ["main", "wing", "wall"] and [len(p[1]) for p in parts] == [2, 1, 2]
    assert regions.inset_to_share([box(0, 0, 4, 4)], 0.25)[0][0].tolist() == [[1, 1], [3, 1], [3, 3], [1, 3]]


def test_few_corners_are_triangulated_as_many(monkeypatch):
    """plain floats find the triangles that arrays find, and corners of one circle keep the first diagonal."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        r = _convex(rng)
        hole = r.mean(0) + (r - r.mean(0)) * 0.5
        for polygon in ([r[:3]], [r[:4]], [r], [r, hole]):
            p, few = triangulate.constrained(polygon)
            with monkeypatch.context() as m:
                m.setattr(triangulate, "FEW", 0)
                m.setattr(triangulate, "_few", lambda ring: None)
                q, many = triangulate.constrained(polygon)
            corners = lambda p, found: sorted(sorted(map(tuple, p[list(t)].tolist())) for t in found)
            assert corners(p, few) == corners(q, many)
    turn = np.radians(37)
    square = box(0, 0, 8, 5) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    assert len(triangulate.constrained([square])[1]) == 2


def test_flat_roofs_are_not_grown(monkeypatch):
    """a flat roof has no eaves; a gable over a plain plot has its eaves and pieces without a sweep."""
    monkeypatch.setattr(regions, "combine", None)
    flat, gable = (roofs.roof([box(0, 0, 8, 5)], form, pitch=0.5, eave=0.5) for form in ("flat", "gable"))
    size = lambda found: sum(abs(kernels.area(t)) for t, _ in found)
    assert abs(size(flat) - 40) < 1e-9 and abs(size(gable) - 54) < 1e-9


def test_faces_are_counted_where_they_are_built(spark):
    plots = spark.createDataFrame([(1, [[0.0, 0.0], [20.0, 0.0], [20.0, 12.0], [0.0, 12.0]], 0.0, 7.0), (2, [[0.0, 0.0], [30.0, 2.0], [28.0, 14.0], [0.0, 12.0]], 0.0, 9.0)], "id long, ring array<array<double>>, base double, height double")
    found = massing.masses(plots, "id", seed=3)
    want = massing.mass_faces(found, "id").groupBy("id", "part").count()
    assert sorted(map(tuple, massing.face_counts(found, "id").collect())) == sorted(map(tuple, want.collect()))


def test_blocks_of_free_ground_are_dealt_out_from_a_table(spark, monkeypatch):
    """F16: straight from a join Spark leaves out the dealing, and all blocks were worked out in two tasks."""
    seen, step = [], areas.by_block
    monkeypatch.setattr(areas, "by_block", lambda rows, f, **more: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or step(rows, f, **more))
    rings = spark.createDataFrame([(box(10, 10, 20, 20).tolist(),)], "ring array<array<double>>")
    got = areas.free_ground(rings, beside=1.0, least=1.0, extent=(0.0, 0.0, 120.0, 60.0)).collect()
    assert len(got) == 1 and 7200 - 144 < got[0].area < 7200 - 140 and len(seen) == 1 and "Join" not in seen[0]


def test_rings_of_growth_are_not_broadcast(spark, monkeypatch):
    """every ring's joins took what was reached through the driver."""
    nodes, edges = spark.range(6), spark.range(5).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    seen, step = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or step(df))
    got = graph.grow(nodes, edges, nodes.filter("id = 0"), F.col("id") != 4)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3] and seen and not any("Broadcast" in p for p in seen)
