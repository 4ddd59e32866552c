"""What grew faster than the input, or lay in one task, doesn't."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark import registry
from roadspark.operators import areas, graph, kernels, reports
from roadspark.plans import rowwise


def parts(spark, d, n: int) -> str:
    rows = spark.range(n).select((F.col("id") + 1).alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(str(d / "part.parquet"))
    return str(d)


def test_plots_of_one_file_are_dealt_out(spark, tmp_path):
    """the table's only file was one task."""
    got = registry.QUERIES["cover_triangles"](spark, parts(spark, tmp_path, 40))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == 40


@pytest.mark.parametrize("name", ["drawn_fronts", "facade_windows", "window_pixels"])
def test_alike_fronts_are_worked_out_once(spark, tmp_path, monkeypatch, name):
    """400 fronts, of 180 forms at most; all rows are those that each front has for itself."""
    d, seen, step = parts(spark, tmp_path, 400), [], rowwise._each_front

    def spy(spark, d, f):
        def count(fronts):
            seen.append(fronts.count())
            return f(fronts)

        return step(spark, d, count)

    monkeypatch.setattr(rowwise, "_each_front", spy)
    got = registry.QUERIES[name](spark, d).toPandas()
    monkeypatch.setattr(rowwise, "_each_front", lambda spark, d, f: f(rowwise._fronts(spark, d)))
    want = registry.QUERIES[name](spark, d).toPandas()
    a, b = (x.sort_values(list(x.columns[:3])).reset_index(drop=True) for x in (got, want))
    assert len(seen) == 1 and seen[0] <= 180 and a.equals(b)


def test_mean_distance_copies_rows_a_few_times(spark, monkeypatch):
    """rows were copied once for each 512 of them, and sorted as a whole."""
    v = np.random.default_rng(4).random((6000, 5))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, x array<double>")
    seen = []
    monkeypatch.setattr(reports, "spread", lambda df, *k: seen.append(df.count()) or graph.spread(df, *k), raising=False)
    got = reports.diversity(df, "id", "x").first()
    total = sum(np.sqrt(((v[i + 1 :] - v[i]) ** 2).sum(1)).sum() for i in range(len(v)))
    assert got.pairs == 6000 * 5999 // 2 and abs(got.diversity - total / got.pairs) < 1e-9
    assert len(seen) == 1 and seen[0] <= 6000 * 8
    assert reports.diversity(df.limit(1), "id", "x").first().pairs == 0 and reports.diversity(df.limit(0), "id", "x").first().pairs == 0


def test_a_piece_meets_what_its_box_touches(spark, monkeypatch):
    """a piece met all that shared a cell with it, and had its own ring beside each."""
    box = lambda x, y: [[float(a), float(b)] for a, b in ((x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2))]
    pieces = spark.createDataFrame([(1, box(0, 0))], "id long, ring array<array<double>>")
    others = spark.createDataFrame([(box(1, 1),), (box(1, 1),), (box(6, 6),), (box(9, 9),), (box(12, 3),)], "ring array<array<double>>")
    seen = []
    monkeypatch.setattr(areas, "spread", lambda df, *k: seen.append(df.count()) or graph.spread(df, *k))
    got = areas.clipped(pieces, others, inside=False).first()
    assert tuple(got) == (1, 4.0, 3.0, [3.0]) and seen == [3]


def test_small_rings_are_cut_in_plain_floats(monkeypatch):
    """hulls, rectangles and cuts of four corners took an array operation a corner."""
    ring = np.array([[0.0, 0.0], [40.0, 10.0], [35.0, 30.0], [-5.0, 20.0]])
    for name in ("unique", "roll", "hypot"):
        monkeypatch.setattr(np, name, lambda *a, **k: pytest.fail("an array operation"))
    lots = kernels.split_lots(ring, 120.0, 0.0, 7)
    assert len(lots) > 4 and all(abs(kernels.area(r)) <= 120 for r in lots)
    assert abs(sum(abs(kernels.area(r)) for r in lots) - abs(kernels.area(ring))) < 1e-9
