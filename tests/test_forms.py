"""Rows that are alike but for their key are worked out once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadspark import registry
from roadspark.operators import graph


def test_each_form_is_worked_out_once(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None), (3, 7.0, "x"), (None, 7.0, "x"), (3, 7.0, "x"), (4, -0.0, "x"), (5, 0.0, "x")], "id long, v double, w string")
    seen = []

    def f(rows):
        seen.append(rows.count())
        return rows.select("id", F.explode(F.array(F.col("v"), F.col("v") * 2)).alias("u"))

    got = graph.each_form(df, "id", f)
    assert seen == [3]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, df.select("id", F.explode(F.array(F.col("v"), F.col("v") * 2))).collect()), key=key)


@pytest.mark.parametrize("name", ["faces_to_polygons", "fit_footprint", "roof_measures", "plot_inset", "building_faces"])
def test_alike_plots_are_worked_out_once(spark, tmp_path, monkeypatch, name):
    """48 plots of three forms: the kernels see three, and all plots get their form's results."""
    parts = spark.range(48).select((F.col("id") * 180).alias("p_partkey"), (F.col("id") % 3 * 7 + 4).cast("int").alias("p_size"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    seen, step = [], graph.each_form

    def spy(df, key, f):
        def count(rows):
            seen.append(rows.count())
            return f(rows)

        return step(df, key, count)

    monkeypatch.setattr(graph, "each_form", spy)
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    monkeypatch.setattr(graph, "each_form", lambda df, key, f: f(df))
    want = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    by = [c for c in want.columns if want[c].dtype != float]
    a, b = (x.sort_values(list(x.columns)).sort_values(by, kind="stable").reset_index(drop=True) for x in (got, want))
    assert seen == [3] and a.equals(b)


def test_stored_rows_are_as_large_on_disk_as_they_are(spark):
    """Cells of a grid aren't taken for a small table, to be broadcast, because they compress well."""
    cells = spark.range(0, 1_000_000, numPartitions=4).select((F.col("id") % 40).alias("ix"), F.expr("id div 40").alias("iy"), F.lit(0.0).alias("z"))
    a, b = graph.stored(cells), graph.stored(cells.withColumnRenamed("z", "w"))
    assert a._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 20_000_000
    joined = a.join(b, ["ix", "iy"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1_000_000
