"""What the operators need of a session: shared storage, scale, defined inputs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for a master that is this machine alone, as in tests, when the session names no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: A key with more than one in HOT rows of a join is hot, so there are HOT of them at most.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one of spark.checkpoint.dir, to be removed when it has ended;
    without that setting a cluster has none, which is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or LOCAL_CHECKPOINTS).rstrip('/')}/{sc.applicationId}"


def stored(df: DataFrame, name: str, *, group_bytes: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: no lineage, no executor holds its only copy.
    group_bytes: of a row group, which a writer holds in memory; Parquet's own if it isn't given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which follow the size of the input on a tuned cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that others, of whatever name, can't clash with an operator's own."""
    return df.select(*(F.col(n) for n in names))


def id_text(doc_id: str = "doc_id") -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id's text modulo n."""
    return F.crc32(id_text(doc_id).cast("binary")) % n


def spread_join(rows: DataFrame, one: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with one, which has a row a key and, in n, the number of rows with it; n is left out.

    Hot keys, those with more than a HOT-th of all rows, are HOT at most: their rows stay where they are and meet a
    broadcast of HOT rows; only the others are dealt out by key.  rows and one are read twice: give stored tables.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total / HOT
    few = F.broadcast(one.filter(hot).drop(n))
    calm = rows.join(F.broadcast(one.filter(hot).select(key)), key, "left_anti").join(one.filter(~hot).drop(n), key)
    return rows.join(few, key).unionByName(calm)
