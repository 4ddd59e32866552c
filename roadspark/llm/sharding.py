"""Sharding by fixed virtual slots.

Records are hashed, by id and text, into SLOTS virtual slots; bytes are summed up for each slot, and a slot map
assigns slots to shards, the largest slot first, each to the shard with the fewest bytes.  The map has a version and
is stored as a table; rebalancing edits it: a new shard takes slots from the fullest ones, and no other slot moves.

A slot whose bytes exceed 1 / HEAVY of a shard's share (one record repeated very often) is split into sub-slots by
the records' row numbers.  Statistics and maps have SLOTS rows plus the sub-slots (HEAVY times the shards at most),
whatever the number of records; positions are counted within slots, never within a whole shard.

Defined cases: a null text has no bytes, so its size is 1, and the checksum 0; a null doc_id is hashed as the text
''; repeated rows are placed each; an empty table gives an empty map and no rows; other columns of the input are not
read.  The law is `bytes`: shards' sizes differ by no more than about one slot.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm._spark import id_text, shared_dir, stored

SLOTS = 4096
HEAVY = 64
SCHEMA = "version int, slot int, sub int, shard int, bytes long, rows long"


@dataclass
class SlotMap:
    """Version, number of shards, and (slot, sub-slot) -> (shard, bytes, rows)."""

    shards: int
    version: int = 1
    slots: dict[tuple[int, int], tuple[int, int, int]] = field(default_factory=dict)

    @classmethod
    def balanced(cls, stats: dict[tuple[int, int], tuple[int, int]], shards: int) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes (then the lower number)."""
        heap = [(0, s) for s in range(shards)]
        out = cls(shards)
        for key, (size, rows) in sorted(stats.items(), key=lambda x: (-x[1][0], x[0])):
            load, s = heapq.heappop(heap)
            out.slots[key] = (s, size, rows)
            heapq.heappush(heap, (load + size, s))
        return out

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for shard, size, _ in self.slots.values():
            out[shard] += size
        return out

    def grown(self) -> SlotMap:
        """The next version, with one more shard: it takes slots from the fullest shards until it has its share."""
        out = SlotMap(self.shards + 1, self.version + 1, dict(self.slots))
        loads = out.loads()
        share = sum(loads) / out.shards
        held: dict[int, list] = {s: [] for s in range(self.shards)}
        for key, (shard, size, _) in sorted(self.slots.items(), key=lambda x: (x[1][1], x[0])):
            held[shard].append((size, key))
        while loads[-1] < share:
            source = max(range(self.shards), key=lambda s: (loads[s] if held[s] else -1, -s))
            if not held[source]:
                break
            size, key = held[source].pop()
            if loads[-1] + size > share + size / 2:
                continue
            _, _, rows = out.slots[key]
            out.slots[key] = (self.shards, size, rows)
            loads[source] -= size
            loads[-1] += size
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, k[0], k[1], *v) for k, v in sorted(self.slots.items())], SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the maps stored at path."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def latest(spark: SparkSession, path: str) -> int:
        """The latest stored version; 0 if none is."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return 0
        return spark.read.schema(SCHEMA).parquet(path).agg(F.max("version")).first()[0] or 0

    @classmethod
    def read(cls, spark: SparkSession, path: str, shards: int, version: int | None = None) -> SlotMap:
        """A stored version, the latest if none is named."""
        maps = spark.read.schema(SCHEMA).parquet(path)
        version = maps.agg(F.max("version")).first()[0] if version is None else version
        rows = maps.filter(F.col("version") == version).collect()  # SLOTS rows and the sub-slots
        return cls(shards, version, {(r["slot"], r["sub"]): (r["shard"], r["bytes"], r["rows"]) for r in rows})


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, slot and row number of each row, stored."""
    text = F.coalesce("text", F.lit(""))
    return stored(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(id_text(), "text"), F.lit(slots)).cast("int").alias("slot"), F.monotonically_increasing_id().alias("row")), "records")


def assign(rows: DataFrame, shards: int, heavy: int = HEAVY) -> tuple[DataFrame, SlotMap]:
    """records() with their sub-slots, and the map of the slots to shards."""
    spark = rows.sparkSession
    stats = {r["slot"]: (r["bytes"], r["rows"]) for r in rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    most = sum(b for b, _ in stats.values()) / shards / heavy
    split = {s: min(n, -(-b // max(1, int(most)))) for s, (b, n) in stats.items() if b > max(most, 4 * sum(x for x, _ in stats.values()) / max(1, len(stats))) and n > 1}
    if not split:
        return rows.withColumn("sub", F.lit(0)), SlotMap.balanced({(s, 0): x for s, x in stats.items()}, shards)
    pieces = F.broadcast(spark.createDataFrame(sorted(split.items()), "slot int, pieces long"))
    rows = rows.join(pieces, "slot", "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    found = rows.groupBy("slot", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return rows, SlotMap.balanced({(r["slot"], r["sub"]): (r["bytes"], r["rows"]) for r in found}, shards)


def shard(docs: DataFrame, shards: int = 16, *, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, place (from 0 without gaps within the shard) and virtual_slot of each row.

    The slot map is written to the folder maps as its next version (to a new one among the session's shared folders,
    if none is named), and rows are placed by that version as it is read back."""
    spark = docs.sparkSession
    maps = maps or f"{shared_dir(spark).rstrip('/')}/slot-maps-{uuid.uuid4().hex}"
    rows, made = assign(records(docs, slots), shards)
    made.version = SlotMap.latest(spark, maps) + 1
    made.write(spark, maps)
    found = SlotMap.read(spark, maps, shards, made.version)
    first, start = [0] * shards, []
    for key, (s, _, n) in sorted(found.slots.items()):
        start.append((*key, s, first[s]))
        first[s] += n
    places = F.broadcast(spark.createDataFrame(start, "slot int, sub int, shard int, first long"))
    within = F.row_number().over(Window.partitionBy("slot", "sub").orderBy("doc_id", "text_crc32", "row"))
    return rows.withColumn("within", within).join(places, ["slot", "sub"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within") - 1).alias("place"), F.col("slot").alias("virtual_slot"))
