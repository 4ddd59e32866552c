"""Lane graphs: edges from shared ends, loose ends, guarded growth, components, walks."""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Only for a master that is this machine alone, as in tests, when the session names no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder of spark.checkpoint.dir and read again: its lineage is cut, a lost
    executor loses nothing of it, and its size is known rather than a product of estimates.

    Files are plain, neither compressed nor by dictionary: joins go by their size, and a million rows of cells would be
    half a megabyte otherwise and broadcast through the driver."""
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(named or LOCAL_CHECKPOINTS).rstrip('/')}/{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many parts as the session has shuffle partitions, and its cores at least: rows that are
    few but take long each aren't gathered into one task for being few."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def each_form(df: DataFrame, key: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of df, row by row of it, where what f finds depends on the columns but key alone: rows that are alike but for
    their key are worked out once, and all of them get what was found.  f gets a unique long as the key."""
    of = [c for c in df.columns if c != key]
    form = stored(df.select(*of).distinct().withColumn("_form", F.monotonically_increasing_id()))
    same = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in of]
    member = df.alias("_a").join(form.alias("_b"), reduce(lambda x, y: x & y, same)).select(F.col(f"_a.{key}").alias("_key"), "_b._form")
    found = f(form.withColumnRenamed("_form", key))
    return member.join(found.withColumnRenamed(key, "_form"), "_form").withColumnRenamed("_key", key).select(*found.columns)


def adjacency(ends: DataFrame) -> DataFrame:
    """Ordered pairs (a, b), a <> b, of lanes (lane_id, s, e) that share an end of either kind."""
    touch = ends.select(F.col("lane_id").alias("a"), F.explode(F.array_distinct(F.array("s", "e"))).alias("key"))
    other = touch.withColumnRenamed("a", "b")
    return touch.join(other, "key").filter("a <> b").select("a", "b").distinct()


def successors(ends: DataFrame) -> DataFrame:
    """Edges (lane_id, next_id): next begins where lane ends; a lane without a successor has one row, of null."""
    nxt = ends.select(F.col("lane_id").alias("next_id"), F.col("s").alias("e"))
    lanes = ends.select("lane_id", "e")
    j = lanes.join(nxt, (lanes["e"] == nxt["e"]) & (lanes["lane_id"] != nxt["next_id"]), "left")
    return j.select("lane_id", "next_id")


def dangling(ends: DataFrame) -> DataFrame:
    """Loose ends (lane_id, side): an end where no lane begins, a start where none ends."""
    keys = lambda a, b: ends.select(F.col(a).alias(b)).distinct()
    tails = ends.join(keys("s", "e"), "e", "left_anti").select("lane_id", F.lit("end").alias("side"))
    heads = ends.join(keys("e", "s"), "s", "left_anti").select("lane_id", F.lit("start").alias("side"))
    return tails.unionByName(heads)


def unpinned(stubs: DataFrame, attached: DataFrame) -> DataFrame:
    """Stubs (…, points: array) none of whose points an attached end touches (attached: point)."""
    keys = [c for c in stubs.columns if c != "points"]
    hit = stubs.withColumn("point", F.explode("points")).join(attached.select("point").distinct(), "point", "left_semi").select(*keys).distinct()
    return stubs.join(hit, keys, "left_anti")


def grow(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, allowed: Column | Callable[[DataFrame], DataFrame], max_rounds: int = 8) -> DataFrame:
    """Seeds (id) and what is reached from them over edges (a, b) through nodes for which allowed holds.

    A round is a whole search: rings of neighbours until one is empty; each is stored, so a lost executor costs that
    ring alone.  allowed may be a function of the nodes not yet reached, which gives the allowed ones (id); it is
    called anew for each of at most max_rounds rounds, until a round adds nothing or fewer than three nodes are left.
    A plain column stays as it is, so one round reaches everything.  Joins are by sort-merge: broadcasts would take what is
    reached through the driver once a ring.
    """
    reached = stored(seeds.select("id").distinct()).hint("merge")
    for _ in range(max_rounds if callable(allowed) else 1):
        if callable(allowed):
            left = nodes.join(reached, "id", "left_anti")
            if left.limit(3).count() < 3:
                break
            ok = allowed(left).select("id")
        else:
            ok = nodes.filter(allowed).select("id")
        steps = stored(edges.select("a", F.col("b").alias("id")).join(ok.hint("merge"), "id", "left_semi").select("a", "id").distinct()).hint("merge")
        frontier, added = reached, False
        while True:
            frontier = stored(frontier.withColumnRenamed("id", "a").join(steps, "a").select("id").distinct().join(reached, "id", "left_anti"))
            if frontier.isEmpty():
                break
            # written anew, so that no plan grows with the number of rings
            reached, added = stored(reached.unionByName(frontier)).hint("merge"), True
        if not added:
            break
    return reached


def above_street(nodes: DataFrame, *, clearance: float, radius: float, share: float = 0.1) -> Callable[[DataFrame], DataFrame]:
    """A guard for grow(): of the nodes (id, x, y, z) still on the ground, those clearance or more above the street
    beside them, the share quantile of the heights of all ground nodes within radius (itself among them)."""
    from roadspark.operators import spatial

    def guard(left: DataFrame) -> DataFrame:
        ground = stored(left.select("id", "x", "y", "z"))
        street = ground.select(F.col("x").alias("r_x"), F.col("y").alias("r_y"), F.col("z").alias("r_z"))
        level = spatial.within(ground, street, radius).groupBy("id", "z").agg(F.percentile("r_z", share).alias("level"))
        return level.filter(F.col("z") - F.col("level") >= clearance)

    return guard


def components(edges: DataFrame) -> DataFrame:
    """(node, component): a component's name is its least node.  Every node points to a lesser one or itself, and each round
    it, and the node it points to, take the least that their neighbours' targets point to, so trees join by their roots and
    rounds are few, however long a component is.  Tables of labels are joined by sort-merge: a broadcast a round would
    take them all through the driver as often as there are rounds."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both).hint("merge")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        jump = labels.hint("merge").join(far, "component")
        near = both.join(jump.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("m"))
        step = stored(jump.join(near.hint("merge"), "node").select("node", "component", F.least("far", "m").alias("m"))).hint("merge")
        root = step.groupBy(F.col("component").alias("node")).agg(F.min("m").alias("r"))
        least = F.least("component", "m", "r")
        labels = stored(step.join(root, "node", "left").select("node", least.alias("component"), (least < F.col("component")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("moved")


def walks(spark: SparkSession, edges: dict[int, list[int]], weights: dict[int, float], attempts: int = 400, seed: int = 0) -> DataFrame:
    """Random self-avoiding walks (attempt, path, length) over a road graph that fits a worker, one a row.

    edges and weights are configuration of a size the caller has checked; they travel with the function.
    """
    starts = sorted(weights)

    def run(batches):
        for pdf in batches:
            rows = []
            for attempt in pdf["id"]:
                rng = random.Random(seed * 1_000_003 + int(attempt))
                at = rng.choice(starts)
                path, seen = [at], {at}
                while nexts := [n for n in edges.get(at, ()) if n not in seen]:
                    at = rng.choice(nexts)
                    path.append(at)
                    seen.add(at)
                rows.append((int(attempt), path, float(sum(weights[p] for p in path))))
            yield pd.DataFrame(rows, columns=["attempt", "path", "length"])

    if not starts:
        return spark.createDataFrame([], "attempt long, path array<long>, length double")
    return spark.range(attempts).mapInPandas(run, "attempt long, path array<long>, length double")


def step_walks(lanes: DataFrame, attempts: int, seed: int = 0) -> DataFrame:
    """Random self-avoiding walks (attempt, path, length) over lanes (lane_id, s, e, length): a lane is followed by any that
    begins where it ends and isn't on the path yet, until there is none.

    All walks take a step at once, by a join with the lanes' starts; which of several is drawn goes by a hash of seed,
    attempt, step and lane, so a walk is the same however the table lies.  They begin at the attempts lanes of least hash,
    fewer if there are fewer lanes.  Only walks that still move are written anew in a round.
    """
    drawn = lambda *parts: F.md5(F.concat_ws("-", F.lit(seed), *(c.cast("string") for c in parts)))
    lanes = stored(lanes.filter("lane_id is not null").select("lane_id", "s", "e", "length"))
    first = lanes.orderBy(drawn(F.col("lane_id")), "lane_id").limit(attempts)
    turn = F.row_number().over(Window.orderBy(drawn(F.col("lane_id")), "lane_id")) - 1  # over so many rows as attempts
    moving = stored(first.select(turn.cast("int").alias("attempt"), F.array("lane_id").alias("path"), "e", "length"))
    begins = lanes.select(F.col("lane_id").alias("next"), F.col("s").alias("e"), F.col("e").alias("to"), F.col("length").alias("more"))
    done = None
    while True:
        ahead = moving.join(begins, "e").filter(~F.array_contains("path", F.col("next")))
        pick = F.min(F.struct(drawn(F.col("attempt"), F.size("path") - 1, F.col("next")).alias("h"), "next", "to", "more"))
        step = ahead.groupBy("attempt").agg(pick.alias("p"), F.first("path").alias("path"), F.first("length").alias("length"))
        step = stored(step.select("attempt", F.concat("path", F.array("p.next")).alias("path"), F.col("p.to").alias("e"), (F.col("length") + F.col("p.more")).alias("length")))
        ended = moving.join(step.select("attempt"), "attempt", "left_anti")
        done = stored(ended if done is None else done.unionByName(ended))
        if step.isEmpty():
            return done.select("attempt", "path", "length")
        moving = step


def longest_walk(found: DataFrame) -> DataFrame:
    """The longest walk, the first of equal ones."""
    return found.orderBy(F.desc("length"), "attempt").limit(1)
