"""Railings: on the bank and not in the bowl, never on a road, none too short."""

from __future__ import annotations

import numpy as np
import pytest

from roadspark.operators import fences, kernels
from test_regions import box

NX = NY = 41


def nodes(spark, height):
    """A grid of 2 m cells over 80 m by 80 m."""
    return spark.createDataFrame([(i, j, float(height(2.0 * i, 2.0 * j))) for i in range(NX) for j in range(NY)], "ix int, iy int, z double")


def ponds(spark, *rings, level=-1.0):
    return spark.createDataFrame([(n, r.tolist(), level) for n, r in enumerate(rings)], "body int, ring array<array<double>>, level double")


def roads(spark, *rings):
    return spark.createDataFrame([(r.tolist(),) for r in rings], "ring array<array<double>>")


def length(rows):
    return sum(r.length for r in rows)


@pytest.mark.parametrize("block", [15.0, 100.0])
def test_a_pond_is_fenced_all_round(spark, block):
    rims = fences.banks(ponds(spark, box(30, 30, 50, 50)), nodes(spark, lambda x, y: 0.0), NX, NY, cell=2.0, block=block)
    rows = fences.railings(rims, roads(spark)).collect()
    assert length(rows) == pytest.approx(80 + 2 * np.pi * 0.25, abs=0.05) and len({(r.ring, r.rail) for r in rows}) == 1


@pytest.mark.parametrize("block", [15.0, 100.0])
def test_the_railing_is_on_the_bank(spark, block):
    dug = lambda x, y: -2.0 if 26 <= x <= 54 and 26 <= y <= 54 else 0.0
    rims = fences.banks(ponds(spark, box(30, 30, 50, 50)), nodes(spark, dug), NX, NY, cell=2.0, block=block).collect()
    (k,) = {r.k for r in rims}
    assert 8 <= k <= 12  # between the edge of the bowl and the next node out
    p = np.array([(q.x, q.y) for r in rims for q in r.points])
    assert p[:, 0].min() < 26 and p[:, 0].max() > 54


def test_no_railing_on_a_road(spark):
    rims = fences.banks(ponds(spark, box(30, 30, 50, 50)), nodes(spark, lambda x, y: 0.0), NX, NY, cell=2.0, block=18.0)
    road = box(0, 38, 80, 42)
    rows = fences.railings(rims, roads(spark, road, box(29, 49, 33, 53))).collect()
    assert length(rows) == pytest.approx(80 + 2 * np.pi * 0.25 - 8 - 4 - np.pi * 0.125, abs=0.05)
    for r in rows:
        p = np.array([(q.x, q.y) for q in r.points])
        assert not kernels.contains(road, (p[1:] + p[:-1]) / 2).any()
    assert len({(r.ring, r.rail) for r in rows}) == 3


def test_short_and_drowned(spark):
    flat = nodes(spark, lambda x, y: 0.0)
    tiny = fences.banks(ponds(spark, box(40, 40, 40.1, 40.1)), flat, NX, NY, cell=2.0)
    assert fences.railings(tiny, roads(spark)).count() == 0
    drowned = fences.banks(ponds(spark, box(30, 30, 50, 50), level=5.0), flat, NX, NY, cell=2.0).collect()
    assert {r.k for r in drowned} == {20}
    assert fences.banks(ponds(spark, box(30, 30, 50, 50)).limit(0), flat, NX, NY, cell=2.0).count() == 0
