"""Areas against known shapes and against plain sampling."""

from __future__ import annotations

import numpy as np
import pytest

from roadspark.operators import kernels, regions


def box(x0, y0, x1, y1, turn=0.0):
    r = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    m, c, s = r.mean(0), np.cos(turn), np.sin(turn)
    return (r - m) @ np.array([[c, s], [-s, c]]) + m


def test_two_squares():
    a, b = [box(0, 0, 4, 4)], [box(3, 1, 7, 3)]
    assert regions.area(regions.union([a, b])) == pytest.approx(22)
    assert regions.area(regions.intersection([a], [b])) == pytest.approx(2)
    assert regions.area(regions.difference([a], [b])) == pytest.approx(14)
    (ring,) = regions.outlines(regions.union([a, b]))
    assert kernels.area(ring) == pytest.approx(22) and len(ring) == 8
    assert regions.area(regions.union([])) == 0 and regions.outlines(regions.union([])) == []


def test_parts_and_holes():
    frame = [[box(0, 0, 10, 2)], [box(0, 8, 10, 10)], [box(0, 0, 2, 10)], [box(8, 0, 10, 10)], [box(20, 0, 21, 1)]]
    u = regions.union(frame)
    assert len(regions.parts(u)) == 2 and regions.area(u) == pytest.approx(65)
    (hole,) = regions.holes(u)
    assert kernels.area(hole) == pytest.approx(36)
    first = max(regions.as_polygons(u), key=lambda p: abs(kernels.area(p[0])))
    assert [round(kernels.area(r)) for r in first] == [100, -36]
    court = [box(0, 0, 10, 10), box(4, 4, 6, 6)]
    t = regions.triangles(regions.union([court]))
    assert sum(kernels.area(x) for x in t) == pytest.approx(96) and min(kernels.area(x) for x in t) > 0


def test_against_sampling():
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 20, (40_000, 2))
    for _ in range(6):
        polygons = [[box(x, y, x + w, y + h, t)] for x, y, w, h, t in rng.uniform([0, 0, 2, 2, 0], [14, 14, 8, 6, 3], (7, 5))]
        a, b = polygons[:4], polygons[4:]
        ina, inb = (np.any([kernels.contains(p[0], at) for p in x], axis=0) for x in (a, b))
        for got, want in ((regions.union(polygons), ina | inb), (regions.intersection(a, b), ina & inb), (regions.difference(a, b), ina & ~inb)):
            rings = regions.outlines(got)
            assert sum(kernels.area(r) for r in rings) == pytest.approx(regions.area(got), abs=1e-6)
            odd = np.sum([kernels.contains(r, at) for r in rings], axis=0) % 2 == 1 if rings else np.zeros(len(at), bool)
            assert (odd != want).mean() < 1e-3


def test_growth_and_shrinkage():
    square = [box(0, 0, 10, 6)]
    assert regions.area(regions.grown([square], 1, "mitre")) == pytest.approx(96)
    assert regions.area(regions.grown([square], 1, "round")) == pytest.approx(92 + np.pi, abs=0.01)
    assert regions.area(regions.shrunk([square], 1, "mitre")) == pytest.approx(32)
    assert regions.area(regions.shrunk([square], 3.1)) == pytest.approx(0, abs=1e-9)
    ell = [np.array([[0, 0], [8, 0], [8, 3], [3, 3], [3, 9], [0, 9]], float)]
    assert regions.area(regions.grown([ell], 0.5, "mitre")) == pytest.approx(42 + 34 * 0.5 + 4 * 0.25)
    assert regions.area(regions.shrunk([ell], 0.5, "mitre")) == pytest.approx(42 - 34 * 0.5 + 4 * 0.25)
    assert kernels.area(regions.grown_convex(square[0], 1, 16)) == pytest.approx(92 + np.pi, abs=0.01)
    court = [box(0, 0, 10, 10), box(3, 3, 7, 7)]
    assert regions.area(regions.grown([court], 0.5, "mitre")) == pytest.approx(121 - 9)


def test_gaps_are_filled_and_yards_are_not():
    lanes = [[box(0, 0, 20, 3)], [box(0, 3.4, 20, 6.4)], [box(0, 12, 20, 15)]]
    (patch,) = regions.infill(lanes, 0.5, 0.05, 40.0)
    assert regions.area(patch) == pytest.approx(8.0)
    ring = [[box(0, 0, 9, 2)], [box(0, 5, 9, 7)], [box(0, 0, 2, 7)], [box(7, 0, 9, 7)]]
    assert [round(regions.area(p), 6) for p in regions.infill(ring, 0.5, 0.05, 40.0)] == [15.0]
    assert regions.infill(ring, 0.5, 0.05, 10.0) == []
    assert regions.is_narrow(box(0, 0, 9, 0.8), 1.0) and not regions.is_narrow(box(0, 0, 9, 1.2), 1.0)


def test_insets_of_any_form():
    ell = np.array([[0, 0], [20, 0], [20, 8], [9, 8], [9, 15], [0, 15]], float)
    court = [box(0, 0, 20, 20), box(8, 8, 12, 12)]
    waist = np.array([[0, 0], [10, 0], [10, 4.8], [12, 4.8], [12, 0], [22, 0], [22, 10], [12, 10], [12, 5.2], [10, 5.2], [10, 10], [0, 10]], float)
    for polygon in ([ell], court, [waist]):
        whole = regions.area(regions.union([polygon]))
        for share in (0.8, 0.4):
            left = regions.inset_to_share(polygon, share)
            assert regions.area(regions.union(left)) == pytest.approx(share * whole, rel=1e-6)
            assert regions.area(regions.difference(left, [polygon])) < 1e-9
    assert len(regions.inset_to_share([waist], 0.6)) == 2
    assert regions.inset_to_share([ell], 0.0) == [] and len(regions.inset_to_share([ell], 1.0)) == 1


def test_a_slab_whose_middle_is_the_height_of_a_vertex():
    """Heights a nanometre apart make one cut, and the slab above it may have a corner exactly half way up."""
    sliver = [np.array([[0.0, 2.5e-9], [0.5, 0.0], [0.5, 1.25e-9], [0.5, 2.5e-9]])]
    square = [box(0, 5e-10, 4, 4)]
    assert regions.area(regions.union([sliver, square])) == pytest.approx(16)
    assert regions.area(regions.difference([square], [sliver])) == pytest.approx(16)
    (part,) = regions.as_polygons(regions.union([sliver, square]))
    assert kernels.area(part[0]) == pytest.approx(16)
