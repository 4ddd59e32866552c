"""Extensions against a plain loop in the order of the keys."""

from __future__ import annotations

import numpy as np
import pytest

from roadspark.operators import extend, kernels
from test_regions import box

STUB = (40.0, 1.5, 40.0, -1.5, 1.0, 0.0)


def test_what_stops_a_stub():
    assert extend.nearest_overlap(STUB, 100.0, box(60, -20, 70, 20)) == pytest.approx(20)
    assert extend.nearest_overlap(STUB, 100.0, box(0, 1.5, 140, 6)) == np.inf  # along the side
    assert extend.nearest_overlap(STUB, 15.0, box(60, -20, 70, 20)) == np.inf
    assert extend.nearest_overlap(STUB, 100.0, box(30, -20, 60, 20)) == 0
    ell = np.array([[50, -9], [90, -9], [90, 9], [80, 9], [80, -5], [50, -5]], float)  # a bay is open to the road
    assert extend.nearest_overlap(STUB, 100.0, ell) == pytest.approx(40)


def table(spark, stubs):
    return spark.createDataFrame([(i, s, *map(float, v), float(limit)) for i, s, v, limit in stubs], "lane long, side string, lx double, ly double, rx double, ry double, dx double, dy double, limit double")


def rings_of(spark, rings):
    return spark.createDataFrame([(i, r.tolist()) for i, r in rings], "lane long, ring array<array<double>>")


def made(seed, n):
    rng = np.random.default_rng(seed)
    stubs, rings = [], []
    for i in range(n):
        x, y, t, w, h = *rng.uniform(0, 160, 2), rng.uniform(0, 2 * np.pi), rng.uniform(6, 16), rng.uniform(2, 4)
        r = box(x - w / 2, y - h / 2, x + w / 2, y + h / 2, t)
        d = np.array([np.cos(t), np.sin(t)])
        rings.append((i, r))
        stubs.append((i, "end", (*r[2], *r[1], *d), float(rng.choice([1.0, 30.0, 90.0]))))
        stubs.append((i, "start", (*r[0], *r[3], *-d), float(rng.uniform(10, 70))))
    return stubs, rings


@pytest.mark.parametrize("cell", [8.0, 60.0])
def test_grants_follow_the_order(spark, cell):
    stubs, rings = made(4, 45)
    want, sweeps = {}, []
    for i, side, v, limit in sorted(stubs, key=lambda s: s[:2]):
        stop = min([extend.nearest_overlap(v, limit, r) for j, r in rings if j != i] + [extend.nearest_overlap(v, limit, q) for q in sweeps])
        length = min(limit, stop - 1.5)
        want[i, side] = length if limit >= 2 and length >= 2 else 0.0
        if want[i, side] > 0:
            sweeps.append(extend._sweep(*v, want[i, side]))
    got = {(r.lane, r.side): r.length for r in extend.granted(table(spark, stubs), rings_of(spark, rings), ["lane", "side"], "lane", clearance=1.5, least=2.0, cell=cell).collect()}
    assert got == pytest.approx(want) and len({round(v, 3) for v in want.values()}) > 20
    alone = {(r.lane, r.side): r.obstacle for r in extend.blocked(table(spark, stubs), rings_of(spark, rings), ["lane", "side"], "lane", cell=cell).collect()}
    for i, side, v, limit in stubs:
        stop = min(extend.nearest_overlap(v, limit, r) for j, r in rings if j != i)
        assert alone[i, side] == pytest.approx(stop) if stop < np.inf else alone[i, side] is None
    # sweeps granted earlier did stop some
    assert any(want[k] > 0 and want[k] + 1.5 < min(alone[k] or np.inf, 1e9) - 1e-6 and want[k] < dict(((i, s), x) for i, s, _, x in stubs)[k] - 1e-6 for k in want)


def test_leaving_the_survey(spark):
    rings = rings_of(spark, [(0, box(-30, -30, 500, 20)), (1, box(-30, 20, 500, 500)), (2, box(100, 100, 110, 110))])
    hull = extend.outline(rings.repartition(3))
    assert abs(kernels.area(hull)) == pytest.approx(530 * 530)
    stubs = [(0, "a", (480.0, 1.5, 480.0, -1.5, 1.0, 0.0), 9), (0, "b", (100.0, 1.5, 100.0, -1.5, 1.0, 0.0), 9), (0, "c", (900.0, 0.0, 900.0, 1.0, -1.0, 0.0), 9)]
    got = {r.side: r.leaves for r in extend.leaves(table(spark, stubs), hull, margin=5.0, within=60.0).collect()}
    assert got == {"a": True, "b": False, "c": True}
    assert all(r.leaves for r in extend.leaves(table(spark, stubs), np.zeros((0, 2)), margin=5.0, within=60.0).collect())


def test_the_shortest_claim_moves_a_point(spark):
    grants = spark.createDataFrame([(1, "end", 9.0), (2, "end", 4.0), (3, "end", 0.0)], "lane long, side string, length double")
    points = spark.createDataFrame([(1, "end", 7), (1, "end", 8), (2, "end", 8), (3, "end", 7)], "lane long, side string, point_id long")
    assert {(r.point_id, r.length) for r in extend.claims(grants, points, ["lane", "side"]).collect()} == {(7, 9.0), (8, 4.0)}


def test_nothing_to_grant(spark):
    stubs, rings = made(1, 3)
    assert extend.granted(table(spark, stubs).limit(0), rings_of(spark, rings), ["lane", "side"], "lane", clearance=1.0, least=2.0).count() == 0
    free = extend.granted(table(spark, [(9, "end", STUB, 60.0)]), rings_of(spark, rings).limit(0), ["lane", "side"], "lane", clearance=1.0, least=2.0).collect()
    assert [r.length for r in free] == [60.0]


def test_stubs_are_cut_all_at_once(spark, monkeypatch):
    """overlaps of many stubs and rings, convex or not, are those found one by one; of rings only those that the next
    metres of a sweep touch are cut."""
    rng = np.random.default_rng(8)
    ell = np.array([[0, 0], [30, 0], [30, 18], [22, 18], [22, 4], [0, 4]], float)
    rings = [box(*(c := rng.uniform(0, 80, 2)), *(c + rng.uniform(1, 30, 2)), rng.uniform(0, 6)) for _ in range(900)] + [ell + rng.uniform(0, 60, 2) for _ in range(30)]
    rings += [r[::-1] for r in rings[:20]] + [np.array([[0, 0], [60, 10], [20, 70]], float)]
    x, y, t = rng.uniform(0, 80, len(rings)), rng.uniform(0, 80, len(rings)), rng.uniform(0, 7, len(rings))
    c, s = np.cos(t), np.sin(t)
    stubs, lengths = np.column_stack((x - s * 2, y + c * 2, x + s * 2, y - c * 2, c, s)), rng.choice([0.0, 5.0, 90.0], len(rings))
    got = extend.nearest_overlaps(stubs, lengths, np.concatenate(rings), np.cumsum([0, *map(len, rings)]))
    want = [extend.nearest_overlap(tuple(v), n, r) for v, n, r in zip(stubs, lengths, rings)]
    assert got == pytest.approx(want) and 20 < np.isfinite(got).sum() < len(got)
    seen, step = [], extend._first_overlaps
    monkeypatch.setattr(extend, "_first_overlaps", lambda pairs, *a: seen.append(pairs.count()) or step(pairs, *a))
    row = [(i, box(i * 10.0, 0, i * 10.0 + 4, 3)) for i in range(30)]
    found = extend.blocked(table(spark, [(i, "end", (i * 10.0 + 4, 3, i * 10.0 + 4, 0, 1, 0), 300.0) for i, _ in row]), rings_of(spark, row), ["lane"], "lane", cell=25.0)
    assert {r.lane: r.obstacle for r in found.collect()} == {i: 6.0 if i < 29 else None for i in range(30)} and seen[0] < 30 * 4
