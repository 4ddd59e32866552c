"""Reports: aggregates over rows, images as arrays, ledgers of attempts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.operators.graph import spread, stored


def extent(df: DataFrame) -> DataFrame:
    """Bounds and mean of points (x, y), one row; nulls for no points."""
    return df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def counts_by(df: DataFrame, kind: str, value: str) -> DataFrame:
    """Rows of each kind ('?' for none), and the spread between the value's tenth and ninetieth percentile."""
    return df.groupBy(F.coalesce(kind, F.lit("?")).alias("kind")).agg(F.count("*").alias("n"), (F.percentile(value, 0.9) - F.percentile(value, 0.1)).alias("spread"))


def fractions(df: DataFrame, kind: str) -> DataFrame:
    """The share of each class that occurs."""
    n = df.groupBy(kind).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select(kind, (F.col("n") / F.col("total")).alias("share"))


def exact_quantiles(df: DataFrame, column: str, shares: list[float], *, bins: int = 4096, small: int = 100_000) -> list[float | None]:
    """Quantiles of a column, interpolated between ranks, exactly.

    The values are never sorted or gathered: histograms of bins equal steps narrow the range that holds a rank, each a
    sum that is added up before the shuffle, until small rows or one value are left there; nulls and NaN don't count."""
    df = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n, low, high = df.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    found: dict[int, float] = {}

    def at(rank: int) -> float:
        """The value with so many before it."""
        if rank in found:
            return found[rank]
        lo, hi, before, inside = low, high, 0, n
        while inside > small and lo < hi and lo + (hi - lo) / bins > lo:
            step = (hi - lo) / bins
            part = df.filter(F.col("v").between(lo, hi))
            rows = sorted((r["b"], r["n"], r["lo"], r["hi"]) for r in part.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / step)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
            for _, k, first, last in rows:
                if before + k > rank:
                    lo, hi, inside = first, last, k
                    break
                before += k
        counts = df.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("n"))
        for v, k in sorted((r["v"], r["n"]) for r in counts.collect()):  # small values at most, unless doubles are exhausted
            for r in range(before, before + min(k, 3)):
                found.setdefault(r, v)
            if before <= rank < before + k:
                found[rank] = v
            before += k
        return found[rank]

    out = []
    for share in shares:
        place = share * (n - 1)
        rank = int(place)
        a = at(rank)
        out.append(a if place == rank else a + (at(rank + 1) - a) * (place - rank))
    return out


def datum_align(df: DataFrame, model: Column, sample: Column) -> DataFrame:
    """Median offset of a model from samples, and the median and ninetieth percentile of what is left; without a
    sample that the model reaches, an error."""
    spark = df.sparkSession
    d = stored(df.select((model - sample).alias("d")).filter("d is not null and not isnan(d)"))
    (datum,) = exact_quantiles(d, "d", [0.5])
    if datum is None:
        raise ValueError("the model reaches none of the samples")
    rest = d.select(F.abs(F.col("d") - datum).alias("res"))
    return spark.createDataFrame([(datum, *exact_quantiles(rest, "res", [0.5, 0.9]))], "datum double, res_median double, res_p90 double")


def best_of_n(df: DataFrame, by: list[str], order: str, score: str, enough: float) -> DataFrame:
    """The best score of each group's attempts up to the first that is enough, and how many those were."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col(score)).over(w) >= enough, F.lit(False))
    return df.withColumn("_done", done).filter("not _done").groupBy(*by).agg(F.max(score).alias("best"), F.count("*").alias("tries"))


def least_of_n(df: DataFrame, by: list[str], order: str, score: str, enough: str) -> DataFrame:
    """The attempt with the least score (the first of equal ones) of each group's, up to the first for which enough is
    true, with draws, how many those were."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    made = df.withColumn("_done", F.coalesce(F.max(F.col(enough)).over(w), F.lit(False))).filter("not _done")
    return made.groupBy(*by).agg(F.min_by(order, F.struct(score, order)).alias(order), F.min(score).alias(score), F.count("*").cast("int").alias("draws"))


def score_summary(df: DataFrame, by: list[str], score: str, keep: Column) -> DataFrame:
    """sheets, kept, and the mean, least and greatest score of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("sheets"), F.count_if(keep).alias("kept"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))


def ledger_summary(df: DataFrame, used: Column) -> DataFrame:
    """attempted, used, generations, retried, iou_min and iou_mean of a ledger (tries, best)."""
    return df.withColumn("_used", used).agg(
        F.count("*").alias("attempted"), F.count_if("_used").alias("used"), F.sum("tries").alias("generations"), F.count_if(F.col("tries") > 1).alias("retried"),
        F.min(F.when(F.col("_used"), F.col("best"))).alias("iou_min"), F.avg(F.when(F.col("_used"), F.col("best"))).alias("iou_mean"),
    )


def candidates(df: DataFrame, needed: str, size: str, *, least: float = 0.0, limit: int = 0) -> DataFrame:
    """Rows that have what is needed and at least the least size, the largest first, limit of them (0: all), with
    total, how many there are in all."""
    fit = df.filter(F.col(needed).isNotNull() & (F.size(needed) > 0) & (F.col(size) >= least))
    total = fit.agg(F.count("*").alias("total"))  # one row
    rest = [c for c in df.columns if c not in (needed, size)]
    top = fit.orderBy(F.desc(size), *rest)
    return (top.limit(limit) if limit else top).crossJoin(F.broadcast(total))


def dealt(df: DataFrame, turn: str, choices: DataFrame, choice: str, *, seed: int = 0) -> DataFrame:
    """df with a choice each, in turn, from a short list in an order that the seed shuffles."""
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(choice)).cast("binary")))
    ranked = choices.select(choice, (F.row_number().over(order) - 1).alias("_k"))  # a list of names, one partition
    n = ranked.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn("_k", F.pmod(F.col(turn), F.col("_n")).cast("int")).join(F.broadcast(ranked), "_k").drop("_k", "_n")


def running_offsets(df: DataFrame, key: str, size: str, parts: int = 1024) -> DataFrame:
    """Where each member begins once all are put behind one another: exclusive sums within ranges of keys, plus the
    ranges' own offsets, so that no task holds all rows."""
    lo = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo") + 1) / parts))
    d = df.crossJoin(F.broadcast(lo)).withColumn("_r", F.floor((F.col(key) - F.col("lo")) / width)).drop("lo", "hi")
    sums = d.groupBy("_r").agg(F.sum(size).alias("_s"))  # parts rows at most
    before = sums.select("_r", (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_b"))
    own = F.sum(size).over(Window.partitionBy("_r").orderBy(key)) - F.col(size)
    return d.withColumn("_own", own).join(F.broadcast(before), "_r").select(*df.columns, (F.col("_own") + F.col("_b")).alias("first"))


def diversity(df: DataFrame, key: str, vector: str, *, block: int = 4096) -> DataFrame:
    """Number of pairs of descriptors and their mean distance: every pair once, block by block.  Each block of rows
    meets each other one in a task of its own, and only sums leave it.  A row is copied once a block, so blocks are as
    large as leaves work for every core."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        a, b = (np.array(pdf.loc[pdf["side"] == s, vector].tolist(), float) for s in (0, 1))
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if not len(a) or not len(b):
            return pd.DataFrame({"n": [], "total": []})
        n, total = 0, 0.0
        for k in range(0, len(a), 128):
            part = a[k : k + 128]
            dist = np.zeros((len(part), len(b)))
            for x, y in zip(part.T, b.T):
                step = x[:, None] - y
                step *= step
                dist += step
            np.sqrt(dist, out=dist)
            if same:
                dist = dist[np.triu_indices(len(part), k + 1, len(b))]
            n, total = n + dist.size, total + float(dist.sum())
        return pd.DataFrame({"n": [n], "total": [total]})

    df = stored(df.select(key, vector))
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(math.isqrt(8 * cores) + 1, -(-n // 128)))
    d = df.select(F.col(key), F.col(vector), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    other = d.select(key, vector, "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("far"))
    first = other.filter("own <= far").select(key, vector, F.col("own").alias("i"), F.col("far").alias("j"), F.lit(0).alias("side"))
    second = other.filter("own >= far").select(key, vector, F.col("far").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    sums = spread(first.unionByName(second), "i", "j").groupBy("i", "j").applyInPandas(run, "n long, total double")
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(0.0)).alias("diversity"))


def footprints(strips: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """by, ring (array of x, y: along the left bound and back along the right one), mean_z, x and y (the mean of its corners)
    and area of ribbons (by, order, lx, ly, lz, rx, ry, rz); those of one cross-section have none.  A ribbon's cross-sections
    are one array."""
    rows = strips.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "lx", "ly", "lz", "rx", "ry", "rz"))).alias("s")).filter(F.size("s") > 1)
    side = lambda a: F.transform("s", lambda p: F.struct(p[f"{a}x"].alias("x"), p[f"{a}y"].alias("y"), p[f"{a}z"].alias("z")))
    rows = rows.select(*by, F.concat(side("l"), F.reverse(side("r"))).alias("corners"))
    mean = lambda c: _mean(F.transform("corners", lambda p: p[c]))
    nxt = F.concat(F.slice("corners", 2, F.size("corners") - 1), F.slice("corners", 1, 1))
    twice = F.aggregate(F.zip_with("corners", nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)
    return rows.select(*by, F.transform("corners", lambda p: F.array(p["x"], p["y"])).alias("ring"), mean("z").alias("mean_z"), mean("x").alias("x"), mean("y").alias("y"), (F.abs(twice) / 2).alias("area"))


# ---------------------------------------------------------------- pictures: arrays of numbers, rows after one another


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _steps(image: Column, n: int, a, b) -> Column:
    """The mean difference of the values at a(i) and b(i), for i below n."""
    return _mean(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.abs(F.get(image, a(i)) - F.get(image, b(i)))))


def seam_error(image: Column, h: int, w: int, channels: int = 1) -> Column:
    """The steps across a picture's wrap, both ways, over the mean steps inside; about 1 is seamless."""
    row, c = w * channels, channels
    wrap = _steps(image, row, lambda i: i, lambda i: i + (h - 1) * row)
    wrap = wrap + _steps(image, h * c, lambda i: F.floor(i / c).cast("int") * row + i % c, lambda i: F.floor(i / c).cast("int") * row + (w - 1) * c + i % c)
    flat = (w - 1) * c
    inner = _steps(image, (h - 1) * row, lambda i: i, lambda i: i + row)
    inner = inner + _steps(image, h * flat, lambda i: F.floor(i / flat).cast("int") * row + i % flat, lambda i: F.floor(i / flat).cast("int") * row + i % flat + c)
    return wrap / (inner + 1e-9)


def seam_error_axis(image: Column, h: int, w: int) -> Column:
    """The same of the left and right edge alone."""
    flat = w - 1
    wrap = _steps(image, h, lambda i: i * w, lambda i: i * w + w - 1)
    return wrap / (_steps(image, h * flat, lambda i: F.floor(i / flat).cast("int") * w + i % flat, lambda i: F.floor(i / flat).cast("int") * w + i % flat + 1) + 1e-9)


def _pixels(image: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(image, i * 3 + 1, 3))


def tile_score(image: Column, h: int, w: int, blown: float = 235.0) -> tuple[Column, Column, Column]:
    """Of a picture of three channels: the share of near-white pixels, the standard deviation (both on a scale of 255)
    and the seam error."""
    scale = F.when(F.array_max(image) <= 1.001, 255.0).otherwise(1.0)
    sd = F.sqrt(_mean(F.zip_with(image, F.array_repeat(_mean(image), h * w * 3), lambda x, m: (x - m) * (x - m)))) * scale
    white = _mean(F.zip_with(_pixels(image, h * w), F.array_repeat(scale, h * w), lambda p, k: F.when(F.array_min(p) * k > blown, 1.0).otherwise(0.0)))
    return white, sd, seam_error(image, h, w, 3)


def saturation(image: Column, h: int, w: int) -> Column:
    """How far from grey a picture of three channels is, on average."""
    return _mean(F.transform(_pixels(image, h * w), lambda p: (F.array_max(p) - F.array_min(p)) / (F.array_max(p) + 1e-9)))


def descriptor(image: Column, h: int, w: int) -> Column:
    """Five numbers of a picture of three channels: lightness, two colour axes, saturation, and how busy it is from
    row to row."""
    def channel(c: int) -> Column:
        return _mean(F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.get(image, i * 3 + c)))

    r, g, b = (channel(c) for c in range(3))
    grey = F.transform(_pixels(image, h * w), _mean)
    busy = _let(grey, lambda g: _steps(g, (h - 1) * w, lambda i: i, lambda i: i + w))
    return F.array(_mean(image) / 255, (r - b) / 255, (g - (r + b) / 2) / 255, saturation(image, h, w), busy / 255)


def bays_in(image: Column, h: int, w: int) -> Column:
    """The largest number of bays, 2 to 16, by whose width a grey picture rolls onto itself: by less than a fiftieth of
    its contrast on average; 1 if there is none, or no contrast."""
    # what a lambda captures is computed for each element, so the mean is an array beside the picture
    contrast = _mean(F.zip_with(image, F.array_repeat(_mean(image), h * w), lambda x, m: F.abs(x - m)))
    fits = [F.lit(1)]
    for k in range(2, 17):
        if w % k == 0:
            s = w // k
            fits.append(F.when(_steps(image, h * w, lambda i: i, lambda i, s=s: F.floor(i / w).cast("int") * w + (i % w + (w - s)) % w) < contrast * 0.02, F.lit(k)))
    return F.when(contrast < 1e-9, 1).otherwise(F.greatest(*fits))


def wrap_seam(image: Column, h: int, w: int, bays: Column) -> Column:
    """The step across a grey picture's wrap over the median of its peers, the steps at the other bays' borders (of all
    steps, if there is one bay)."""
    step = F.transform(F.sequence(F.lit(0), F.lit(w - 2)), lambda c: _mean(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.abs(F.get(image, r * w + c + 1) - F.get(image, r * w + c)))))
    wrap = _steps(image, h, lambda r: r * w, lambda r: r * w + w - 1)
    peers = F.when(bays > 1, F.transform(F.sequence(F.lit(1), F.greatest(bays - 1, F.lit(1))), lambda k: F.get(step, F.least(F.bround(k * w / bays).cast("int"), F.lit(w - 1)) - 1))).otherwise(step)
    ranked = F.array_sort(peers)
    n = F.size(ranked)
    middle = (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2
    return wrap / (middle + 1e-9)


def edge_profile(image: np.ndarray, axis: int) -> np.ndarray:
    """Mean steps of grey pictures (n, h, w) from row to row (axis 0) or column to column (1)."""
    return np.abs(np.diff(image, axis=axis + 1)).mean(axis=2 - axis)


def blurred(profile: np.ndarray, sigma: float) -> np.ndarray:
    """Profiles (n, size) smoothed by a Gaussian of sigma (1 at least) cut at three; beyond the ends is nothing."""
    r = round(3 * max(1.0, sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / max(1.0, sigma)) ** 2)
    padded = np.pad(profile, ((0, 0), (r, r)))
    return sum(g * padded[:, k : k + profile.shape[1]] for k, g in enumerate(kernel / kernel.sum()))


def alignment(df: DataFrame, key: str, sheet: str, sheet_size: tuple[int, int], control: str, control_size: tuple[int, int], *, axis: int = 0, tolerance: float = 0.01) -> DataFrame:
    """key and r: how well a grey sheet's edges lie where its control's are: the correlation of their profiles, the
    control's brought to the sheet's length, both smoothed by tolerance of it; 0 for profiles of under four steps, and
    where one is flat.  Whole batches at a time, so nothing is shuffled."""
    n, m = sheet_size[axis] - 1, control_size[axis] - 1

    def run(batches):
        for pdf in batches:
            r = np.zeros(len(pdf))
            if len(pdf) and min(n, m) >= 4:
                have, want = (edge_profile(np.array(pdf[c].tolist(), float).reshape(-1, *size), axis) for c, size in ((sheet, sheet_size), (control, control_size)))
                if m != n:
                    place = np.linspace(0, m - 1, n)
                    low = np.minimum(place.astype(int), m - 2)
                    want = want[:, low] * (1 - (place - low)) + want[:, low + 1] * (place - low)
                a, b = (p - p.mean(1, keepdims=True) for p in (blurred(have, tolerance * n), blurred(want, tolerance * n)))
                size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
                r = np.where(size > 1e-12, (a * b).sum(1) / np.maximum(size, 1e-300), 0.0)
            yield pd.DataFrame({key: pdf[key], "r": r})

    return df.select(key, sheet, control).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, r double")


def seat_z(df: DataFrame, by: list[str], *, coverage: float = 0.30, grid: float = 0.02, limit: float = 0.15) -> DataFrame:
    """by and seat: the height of each mesh (vertices x, y, z) that belongs on the ground.  Of the plan columns, a grid-th
    of the height wide, that begin in the lower half, the height by which coverage of them have begun, but at most
    limit of the height above the lowest vertex; the lowest vertex itself for flat meshes and under four columns."""
    whole = Window.partitionBy(*by)
    d = df.withColumns({"low": F.min("z").over(whole), "span": F.max("z").over(whole) - F.min("z").over(whole)})
    cell = F.greatest(F.col("span") * grid, F.lit(1e-9))
    columns = d.groupBy(*by, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.min("z").alias("z"), F.first("low").alias("low"), F.first("span").alias("span"))
    lower = F.when(F.col("z") < F.col("low") + F.col("span") * 0.5, F.col("z"))
    g = columns.groupBy(*by).agg(F.first("low").alias("low"), F.first("span").alias("span"), F.count(lower).alias("n"), F.percentile(lower, coverage).alias("q"))
    return g.select(*by, F.when((F.col("span") <= 0) | (F.col("n") < 4), F.col("low")).otherwise(F.least("q", F.col("low") + F.col("span") * limit)).alias("seat"))
