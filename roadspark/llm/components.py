"""Connected components of an edge table, by rounds of minima with shortcuts, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm._spark import spread_join, stored

#: Edges to a task of a round.
ROWS = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component's name is its least node.

    Large-star and small-star alternate: each node links its larger neighbours, then all its smaller ones, to the
    least of its neighbourhood, until each points to one that points nowhere; the number of rounds grows as the logarithm
    of the longest path and has no bound of its own.  No neighbourhood is collected: the least neighbour is an aggregate,
    which is summed up before the shuffle, and it comes back to its edges by spread_join(), so a node with very many
    neighbours gathers nowhere.  A round's tables are written by a task for each ROWS edges, and one a core at least, as
    most rounds are short.  Null ends and loops are no edges; repeated edges count once; no edges give no rows.
    """
    e = stored(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-e.count() // ROWS))
    round_of = lambda df, name: stored(df.coalesce(tasks), name)
    while not _settled(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, round_of(low, "low"), "a", "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = round_of(large.filter("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, round_of(low, "low"), "a", "n").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = round_of(small.filter("a <> b").distinct(), "edges")
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select("b", F.lit(0), F.lit(1)).toDF("node", "out", "into"))
    node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not node.filter("out > 1 or out + into > 1").agg(F.count("*")).first()[0]
