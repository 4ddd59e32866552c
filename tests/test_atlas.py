"""Paint on an atlas: coverage by area, nothing lost between strips and pages, junctions without lane lines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark.operators import atlas
from test_regions import box

LANE = "lane long, seq int, lx double, ly double, lz double, rx double, ry double, rz double, kind string, sheet string"


def lanes(spark, n=12):
    rows = []
    for i in range(n):
        y = 10.0 * i
        rows += [(i, k, 10.0 * k, y + 2, 0.0, 10.0 * k, y - 2, 0.0, "Junctions" if i % 3 == 0 else "Roads", f"s{i % 2}") for k in range(4)]
    return spark.createDataFrame(rows + [(99, 0, 5.0, 5.0, 0.0, 5.0, 5.0, 0.0, "Roads", "s0")], LANE)


def paint(spark, n=12):
    rows = []
    for i in range(n):
        y = 10.0 * i
        rows += [(10 * i, "StopLines", box(9, y - 2, 10, y + 2).tolist()), (10 * i + 1, "LaneMarkings", box(2, y - 0.5, 28, y + 0.5).tolist())]
    rows += [(500, "StopLines", box(900, 900, 901, 901).tolist()), (501, "Crosswalks", [[0.0, 0.0], [1.0, 1.0]]), (502, "Crosswalks", box(20, -1, 24, 5).tolist())]
    return spark.createDataFrame(rows, "id long, grp string, ring array<array<double>>")


@pytest.fixture(scope="module")
def baked(spark):
    a = atlas.Atlas(lanes(spark), paint(spark), texel=0.25, step=16, page=128, samples=4)
    return a, a.strips().cache()


def test_coverage_is_the_paints_area(baked):
    _, strips = baked
    rows = {r.lane: r for r in strips.collect()}
    assert set(rows) == set(range(12))
    for i, r in rows.items():
        assert (r.w, r.h) == (16, 120)
        area = 4.0 if i % 3 == 0 else 4.0 + 26.0 - 1.0  # a stop line, and a lane line that crosses it
        if i == 0:
            area += 4 * 3
        assert r.coverage * 0.25 * 0.25 == pytest.approx(area, abs=0.15)
        image = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)
        assert (image[37:39] == 255).all() and (image[60, :5] == 0).all()


def test_pages_have_all_strips(baked):
    a, strips = baked
    pages = a.pages(strips).collect()
    assert sum(p.coverage for p in pages) == pytest.approx(sum(r.coverage for r in strips.collect())) and sum(p.strips for p in pages) == 12
    assert {p.sheet for p in pages} == {"s0", "s1"}
    places = a.places().collect()
    for p in places:
        assert p.px + p.w <= 128 and p.py + p.h <= 128
    for p in places:
        for q in places:
            if p.lane < q.lane and (p.sheet, p.page) == (q.sheet, q.page):
                assert p.px + p.w <= q.px or q.px + q.w <= p.px or p.py + p.h <= q.py or q.py + q.h <= p.py


def test_groups_and_places(baked):
    a, _ = baked
    assert {(r.grp, r.shapes, r.baked) for r in a.emptied().collect()} == {("StopLines", 13, 12), ("LaneMarkings", 12, 8), ("Crosswalks", 1, 1)}
    uv = a.uvs().collect()
    assert len(uv) == 12 * 4 * 2 and all(0 <= r.u <= 1 and 0 <= r.v <= 1 for r in uv)
    at = {r.lane: r for r in a.places().collect()}
    for r in uv:
        p = at[r.lane]
        assert r.u == pytest.approx((p.px + r.side * p.w) / 128) and r.v == pytest.approx(1 - (p.py + r.seq / 3 * p.h) / 128)


def test_nothing_to_bake(spark):
    a = atlas.Atlas(lanes(spark).limit(0), paint(spark), texel=0.25, page=128)
    assert a.strips().count() == 0 and {(r.grp, r.baked) for r in a.emptied().collect()} == {("StopLines", 0), ("LaneMarkings", 0), ("Crosswalks", 0)}
    b = atlas.Atlas(lanes(spark), paint(spark).limit(0), texel=0.25, page=128)
    assert b.strips().agg(F.sum("coverage")).first()[0] == 0 and b.emptied().count() == 0
