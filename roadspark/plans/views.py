"""Stand-ins for road data, derived from the relational tables: as DataFrames, and as SQL for the same rows.

Every ordering key ends in a unique column, so that windows over the views are determined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertex(spark: SparkSession, d: str) -> DataFrame:
    """Lane polylines: line_id, seq, event_id, event_type, x, y, z."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.select(F.col("user_id").alias("line_id"), seq.cast("long").alias("seq"), "event_id", "event_type", "value")
    x = F.col("seq") * F.lit(5.0) + (F.col("event_id") % 7) / F.lit(10.0)
    y = (F.col("line_id") % 50) * F.lit(4.0) + (F.col("event_id") % 5) / F.lit(10.0)
    return e.select("line_id", "seq", "event_id", "event_type", x.alias("x"), y.alias("y"), (F.col("value") / 50).alias("z"))


VERTEX = """vertex as (
  select line_id, seq, event_id, event_type, seq * 5.0::double + (event_id % 7)::double / 10 as x,
    (line_id % 50)::double * 4 + (event_id % 5)::double / 10 as y, value / 50 as z
  from (select user_id as line_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_id, event_type, value from events))"""


def strip(spark: SparkSession, d: str) -> DataFrame:
    """Lanes as cross-sections: line_id, seq, lx, ly, lz, rx, ry, rz; the right bound bends and tilts a little."""
    wave = F.col("seq") % 3
    cols = {"lx": F.col("x"), "ly": F.col("y") + 1.5, "lz": F.col("z"), "rx": F.col("x") + wave * 0.2, "ry": F.col("y") - 1.5 + wave * 0.3, "rz": F.col("z") - wave * 0.1}
    return vertex(spark, d).select("line_id", "seq", *(c.alias(n) for n, c in cols.items()))


STRIP = """strip as (select line_id, seq, x as lx, y + 1.5 as ly, z as lz, x + (seq % 3) * 0.2::double as rx, y - 1.5 + (seq % 3) * 0.3::double as ry, z - (seq % 3) * 0.1::double as rz from vertex)"""


def ends(spark: SparkSession, d: str) -> DataFrame:
    """Lane end keys: lane_id, s, e."""
    n = table(spark, d, "customer").agg((F.count("*") * 4).alias("n"))  # one row
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").crossJoin(F.broadcast(n))
    return o.select(F.col("o_orderkey").alias("lane_id"), F.col("o_custkey").alias("s"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % F.col("n")).alias("e"))


ENDS = """ends as (select o_orderkey as lane_id, o_custkey as s, (o_custkey * 7 + o_orderkey % 3) % (4 * (select count(*) from customer)) as e from orders)"""


def sample_pt(spark: SparkSession, d: str) -> DataFrame:
    """Terrain samples: x, y, z."""
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_extendedprice") / 100).alias("x"), (F.col("l_quantity") * 10).alias("y"), (F.col("l_discount") * 100 + F.col("l_tax") * 10).alias("z"))


SAMPLE = """sample_pt as (select l_extendedprice / 100 as x, l_quantity * 10 as y, l_discount * 100 + l_tax * 10 as z from lineitem)"""


def footprint(spark: SparkSession, d: str) -> DataFrame:
    """Plan-view boxes: id, x0, y0, x1, y1, mean_z."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    x0, y0 = (F.col("p_partkey") % 40) * F.lit(10.0), F.floor(F.col("p_partkey") / 40) * F.lit(10.0)
    return p.select(F.col("p_partkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size")).alias("x1"), (y0 + F.col("p_size") / 2).alias("y1"), (F.col("p_size") % 9).cast("double").alias("mean_z"))


FOOTPRINT = """footprint as (
  select id, x0, y0, x0 + p_size as x1, y0 + p_size / 2.0::double as y1, mean_z from (
    select p_partkey as id, p_size, (p_partkey % 40)::double * 10 as x0, floor(p_partkey / 40)::double * 10 as y0, (p_size % 9)::double as mean_z from part))"""


def plot(spark: SparkSession, d: str) -> DataFrame:
    """Building plots: id, area, floors, height."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    floors = (F.col("p_size") % 9 + 1).cast("int")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * F.lit(40.0)).alias("area"), floors.alias("floors"), (floors * F.lit(3.5)).alias("height"))


PLOT = """plot as (select p_partkey as id, p_size * 40.0::double as area, 1 + p_size % 9 as floors, (1 + p_size % 9) * 3.5::double as height from part)"""


def attempt(spark: SparkSession, d: str) -> DataFrame:
    """Scored attempts: building, try_no, iou."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("building"), F.row_number().over(w).alias("try_no"), (1 - F.col("l_discount") * 4).alias("iou"))


ATTEMPT = """attempt as (select l_orderkey as building, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) as try_no, 1 - l_discount * 4 as iou from lineitem)"""


def tile(spark: SparkSession, d: str) -> DataFrame:
    """One-dimensional images: vec_id, pos, v."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))


TILE = """tile as (select vec_id, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as v from embeddings)"""


def ground(spark: SparkSession, d: str) -> DataFrame:
    """Lower envelope of the vertices in 10 m cells: ix, iy, ground."""
    v = vertex(spark, d)
    return v.groupBy((F.floor(F.col("x") / 10)).alias("ix"), (F.floor(F.col("y") / 10)).alias("iy")).agg((F.min("z") - 0.05).alias("ground"))


GROUND = """ground as (select floor(x / 10)::bigint as ix, floor(y / 10)::bigint as iy, min(z) - 0.05 as ground from vertex group by 1, 2)"""

STATION = """seg as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as gap from vertex window w as (partition by line_id order by seq)),
station as (select *, sum(coalesce(gap, 0)) over (partition by line_id order by seq rows unbounded preceding) as station from seg)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
