"""Approximate nearest neighbours by cross-polytope hashing.

A table's cell is the concatenation of polytopes: each turns unit vectors by three rounds of random signs and a fast
Hadamard transform, and takes the nearest signed axis among its first coordinates.  There are as many polytopes, and
coordinates in the last, as give about a cell a vector, whatever their number n.  A query probes, in each of TABLES
tables, the cells with the least sum of its squared gaps to the nearest axes: PROBED / sqrt(n) of them, so it meets
some TABLES * PROBED * sqrt(n) vectors (fewer of n, the more there are).

Runs of cells that hold about GROUP vectors are one group, a row of the shuffle's key: a vector goes once to its group
in each table, and a query once to each group it probes, with the numbers of its cells there.  Groups of more than
BUCKET vectors are dealt out by the vectors' ids, and their queries go to each part, so no task gathers a hot cell.
What a query meets is ranked exactly, by the cosine of the original vectors in double precision, and only its best
leave the group.  Queries that meet fewer than k + 1 vectors in all are searched again in every cell of one table,
which is exact.

Equal vectors are one, with their k + 1 smallest ids, and queries with equal vectors are one search, so copies cost
neither comparisons nor pairs.  They are known by two 64-bit hashes of the vector.

Defined cases: rows whose id or vector is null, and vectors that are zero, hold null or non-finite components or
are not of the most common dimension (of the longest, if several are), take no part; repeated rows (same id and
vector) are one; rows with the query's id are not its neighbours; an id with several vectors is a query by each, and
its rows are ranked together; ties go to the smaller id; an empty table gives no rows; very large and small components
are scaled by a power of two first; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from roadspark.llm._spark import stored

TABLES = 8
#: Cells probed in a table are this over the square root of the number of vectors, of all cells.
PROBED = 2.9
#: Vectors of a group of cells on average, and of one task's part of it at most.
GROUP, BUCKET = 4096, 16_384
#: Rows of the join of results with queries are dealt over as many parts, as one vector may have very many ids.
PARTS = 16
SEED = 20_240_229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, made orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int, polytope: int = 0) -> np.ndarray:
    """Vectors under a polytope's pseudo-rotation, padded to a power of two."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng([SEED, table, polytope])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def polytopes(n: int, d: int) -> list[int]:
    """Coordinates of each polytope, so that the cells are n or a little more; at most d polytopes."""
    d2, out, cells = 1 << max(0, (d - 1).bit_length()), [], 1
    while cells < n and len(out) < d:
        width = 1
        while width < d2 and cells * 2 * width < n:
            width *= 2
        out.append(width)
        cells *= 2 * width
    return out or [1]


def gaps(x: np.ndarray, table: int, polytope: int, width: int) -> np.ndarray:
    """Squared gap of each signed axis (positive ones first) to the nearest one."""
    y = turned(x, table, polytope)[:, :width]
    y = np.concatenate((y, -y), axis=1)
    return (y.max(1, keepdims=True) - y) ** 2


def cells(x: np.ndarray, table: int, widths: list[int]) -> np.ndarray:
    """Each unit vector's cell."""
    out = np.zeros(len(x), np.int64)
    for i, w in enumerate(widths):
        out = out * (2 * w) + gaps(x, table, i, w).argmin(1)
    return out


def probed(x: np.ndarray, table: int, widths: list[int], n: int) -> np.ndarray:
    """The n cells with the least sums of gaps, for each unit vector, in the order of their numbers."""
    total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for i, w in enumerate(widths):
        g = gaps(x, table, i, w)
        # sums of gaps only grow, so the best of the prefixes are enough
        total = (total[:, :, None] + g[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * w) + np.arange(2 * w)).reshape(len(x), -1)
        if total.shape[1] > n:
            near = np.argpartition(total, n - 1, axis=1)[:, :n]
            total, code = np.take_along_axis(total, near, 1), np.take_along_axis(code, near, 1)
    return np.sort(code, axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors in double precision, each scaled by a power of two to components of at most 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _index(d: int, tables: int, widths: list[int], run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _unit(_matrix(part.column("vector"), d))
                for t in range(tables):
                    c = cells(x, t, widths)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(c // run), pa.array(c % run), part.column("id"), part.column("vector")], names=["table", "grp", "cell", "id", "vector"])

    return go


def _ask(d: int, tables: int, widths: list[int], run: int, n: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 20) // (n * 2 * max(widths)))):
                part = batch.slice(at, max(1, (1 << 20) // (n * 2 * max(widths))))
                x = _unit(_matrix(part.column("vector"), d))
                for t in range(tables):
                    c = probed(x, t, widths, n)
                    query = np.repeat(np.arange(len(x)), c.shape[1])
                    c = c.ravel()
                    first = np.flatnonzero(np.concatenate(([True], (c[1:] // run != c[:-1] // run) | (query[1:] != query[:-1]))))
                    rows = part.take(pa.array(query[first]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)), pa.int32()), pa.array(c % run))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), t), pa.int32()), pa.array(c[first] // run), lists, rows.column("k1"), rows.column("k2"), rows.column("vector")], names=["table", "grp", "cells", "k1", "k2", "vector"])

    return go


def best(queries: np.ndarray, asked: list[np.ndarray], cell: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, cosine) of the k nearest of the vectors in each query's cells, exactly, ties to the smaller id."""
    order = np.argsort(cell, kind="stable")
    cell, ids, vectors = cell[order], ids[order], vectors[order]
    length = np.sqrt((vectors * vectors).sum(1))
    own = np.sqrt((queries * queries).sum(1))
    size = np.array([len(a) for a in asked])
    flat = np.concatenate(asked) if len(asked) else np.zeros(0, np.int64)
    low, high = np.searchsorted(cell, flat), np.searchsorted(cell, flat, side="right")
    met = np.add.reduceat(np.append(high - low, 0), np.concatenate(([0], np.cumsum(size)[:-1]))) * (size > 0) if len(asked) else size
    found: list = []
    at, end = 0, np.concatenate(([0], np.cumsum(size)))
    while at < len(queries):
        to = at + max(1, int(np.searchsorted(np.cumsum(met[at:]), 100_000, side="right")))
        a, b = low[end[at] : end[to]], high[end[at] : end[to]]
        q = np.repeat(np.repeat(np.arange(at, to), size[at:to]), b - a)
        row = np.arange(len(q)) + np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)
        near = np.einsum("ij,ij->i", vectors[row], queries[q]) / (length[row] * own[q])
        rank = np.lexsort((ids[row], -near, q))
        q, row, near = q[rank], row[rank], near[rank]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((q[place < k], ids[row[place < k]], near[place < k]))
        at = to
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))


_FOUND = "k1 long, k2 long, id long, score double"


def _search(d: int, k: int):
    def run(key, left, right):
        q, v = left.combine_chunks(), right.combine_chunks()
        if not (left.num_rows and right.num_rows):
            return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(_FOUND.split(", "), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})
        cell = v.column("cell").to_numpy()
        asked = [np.unique(cell) if c is None else np.asarray(c) for c in q.column("cells").to_numpy()]
        place, ids, score = best(_matrix(q.column("vector"), d), asked, cell, v.column("id").to_numpy(), _matrix(v.column("vector"), d), k)
        rows = q.take(pa.array(place.astype(np.int64)))
        return pa.table({"k1": rows.column("k1"), "k2": rows.column("k2"), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, tables: int = TABLES, share: float = PROBED, bucket: int = BUCKET, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id every divides."""
    kind = vectors.schema[vector_column].dataType
    item = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{item}>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumns({"d": F.size("vector"), "k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(SEED), "vector")})
    d = (rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).select("d").first() or [1])[0]
    rows = rows.filter(F.col("d") == d).drop("d")
    # the limit of ranks is taken within each input partition first, so copies do not gather
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    few = rows.dropDuplicates(["k1", "k2", "id"]).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    classes = stored(few.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")), "vectors")
    n = max(1, classes.count())
    widths = polytopes(n, d)
    all_cells = int(np.prod([2 * w for w in widths], dtype=object))
    run = max(1, all_cells * GROUP // n)
    probes = int(min(all_cells, max(4, -(-share * all_cells // n**0.5))))
    queries = rows.filter(F.col("id") % every == 0).select("id", "k1", "k2")
    asking = classes.join(queries.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vector")

    shape = f"vector array<{item}>"
    index = classes.select("id", "vector").mapInArrow(_index(d, tables, widths, run), f"table int, grp long, cell long, id long, {shape}")
    asked = asking.mapInArrow(_ask(d, tables, widths, run, probes), f"table int, grp long, cells array<long>, k1 long, k2 long, {shape}")
    top = stored(_top(index, asked, d, k + 1, bucket), "nearest")
    full = top.filter(F.size("top") > k).select("k1", "k2")
    again = asking.join(full, ["k1", "k2"], "left_anti")
    if not again.isEmpty():
        groups = stored(index.filter("table = 0").select("table", "grp").distinct(), "groups")
        everywhere = again.crossJoin(groups).withColumn("cells", F.lit(None).cast("array<long>"))
        second = _top(index.filter("table = 0"), everywhere, d, k + 1, bucket)
        top = top.join(full, ["k1", "k2"], "left_semi").unionByName(second)

    # each found vector's ids, and the k + 1 nearest of them all
    ids = classes.select(F.col("id").alias("head"), "ids")
    found = top.select("k1", "k2", F.explode("top").alias("x")).select("k1", "k2", F.col("x.far").alias("far"), F.col("x.id").alias("head")).join(ids, "head").select("k1", "k2", F.explode("ids").alias("id"), "far")
    found = found.groupBy("k1", "k2").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("top"))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out = queries.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(found, ["k1", "k2", "part"])
    # an id with several vectors is ranked over all of them
    out = out.groupBy("id").agg(F.flatten(F.collect_list("top")).alias("top"))
    near = F.slice(F.array_sort(F.array_distinct(F.filter("top", lambda x: x["id"] != F.col("id")))), 1, k)
    return out.select(F.col("id").alias("query_id"), F.posexplode(near).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _top(index: DataFrame, asked: DataFrame, d: int, k: int, bucket: int) -> DataFrame:
    """k1, k2 and top, the k nearest vectors (far, id) that each query meets, in order."""
    # groups that need several parts: few unless vectors crowd; read back from a table, so that its size decides the join
    large = stored(index.groupBy("table", "grp").agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts")).filter("parts > 1"), "groups")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(large, ["table", "grp"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    asked = asked.join(large, ["table", "grp"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    by = ["table", "grp", "part"]
    found = asked.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(_search(d, k), _FOUND)
    return found.groupBy("k1", "k2").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), "id"))), 1, k).alias("top"))
