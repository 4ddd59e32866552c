"""Outlines of cells over blocks against the rings of one region."""

from __future__ import annotations

import numpy as np
import pytest

from roadspark.operators import contours, kernels, regions
from test_regions import box


def table(spark, cells):
    return spark.createDataFrame([(b, int(i), int(j)) for b, i, j in cells], "body int, ix int, iy int")


def rings_of(rows):
    """Each ring's points, from its chains in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.body, r.ring, r.place)):
        out.setdefault((r.body, r.ring), []).append([(p.x, p.y) for p in r.points])
    for parts in out.values():
        for a, b in zip(parts, parts[1:] + parts[:1]):
            assert np.allclose(a[-1], b[0], atol=1e-6)
    return {k: np.array([q for part in parts for q in part[:-1]]) for k, parts in out.items()}


def blob(seed, n=26):
    rng = np.random.default_rng(seed)
    v = kernels.blurred(rng.normal(size=(n, n)), 1.6)
    return [(1, i, j) for j, i in zip(*np.nonzero(v > 0.05))]


@pytest.mark.parametrize("block", [4.0, 10.0, 200.0])
def test_rings_of_cells(spark, block):
    cells = blob(3) + [(2, i, j) for i in range(3, 9) for j in range(3, 9) if not (i in (5, 6) and j in (5, 6))] + [(3, 0, 0), (3, 1, 1)]
    got = contours.cell_outlines(table(spark, cells), cell=2.0, keys=["body"], block=block).collect()
    rings = rings_of(got)
    for body in (1, 2, 3):
        want = regions.outlines(regions.union([[box(2 * i, 2 * j, 2 * i + 2, 2 * j + 2)] for b, i, j in cells if b == body]))
        mine = [r for (b, _), r in rings.items() if b == body]
        assert sorted(round(kernels.area(r), 6) for r in mine) == sorted(round(kernels.area(r), 6) for r in want)
    assert sorted(round(kernels.area(r), 6) for (b, _), r in rings.items() if b == 3) == [4.0, 4.0]  # a point in common joins nothing
    at = {(r.body, r.ring): r for r in contours.measures(contours.cell_outlines(table(spark, cells), cell=2.0, keys=["body"], block=block), ["body"]).collect()}
    assert sorted(round(r.area, 6) for r in at.values()) == sorted(round(kernels.area(r), 6) for r in rings.values())
    assert sum(r.length for r in at.values() if r.body == 2) == pytest.approx(4 * 12 + 4 * 4)


@pytest.mark.parametrize("block", [8.0, 24.0])
def test_a_rounded_pond(spark, block):
    cells = [(1, i, j) for i in range(30) for j in range(30) if (i - 14.5) ** 2 + (j - 14.5) ** 2 < 130] + [(7, 40, 40), (7, 42, 42)]
    got = contours.cell_outlines(table(spark, cells), cell=2.0, keys=["body"], rounded=True, block=block).collect()
    rings = rings_of(got)
    (pond,) = [r for (b, _), r in rings.items() if b == 1]
    whole = 4.0 * sum(b == 1 for b, *_ in cells)
    around = np.hypot(*(np.roll(pond, -1, axis=0) - pond).T).sum()
    assert abs(kernels.area(pond) - whole) < around * 1.0  # half a cell along the shore
    assert len(pond) < 0.6 * 2 * np.pi * 11.4 * 2
    # puddles that rounding would take away keep their cells
    assert sorted(kernels.area(r) for (b, _), r in rings.items() if b == 7) == pytest.approx([4.0, 4.0])


def test_thinning_keeps_its_distance():
    rng = np.random.default_rng(0)
    p = np.cumsum(rng.normal(size=(300, 2)), axis=0)
    q = contours.thinned(p, 1.5)
    assert len(q) < 150 and (q[0] == p[0]).all() and (q[-1] == p[-1]).all()
    a, d = q[:-1], np.diff(q, axis=0)
    t = np.clip(((p[:, None] - a) * d).sum(2) / (d * d).sum(1), 0, 1)
    assert np.hypot(*(a + t[..., None] * d - p[:, None]).transpose(2, 0, 1)).min(1).max() <= 1.5 + 1e-9


def test_no_cells(spark):
    assert contours.cell_outlines(table(spark, []), cell=2.0, keys=["body"]).count() == 0
    assert contours.cell_outlines(table(spark, []), cell=2.0, keys=["body"], rounded=True).count() == 0
