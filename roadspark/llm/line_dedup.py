"""Lines that stand in several documents, kept in the first alone.

Two Bloom filters over the lines' keys tell which lines may be repeated: a key that the first already holds goes into
the second.  The filters are cut into segments by the keys' hashes.  Each task sends the distinct 64-bit hashes of a
block's keys to the segments' owners, packed, with those that several of the block's documents hold marked; an owner
takes one block after another into its two bit fields, and only the second filter leaves it, for a broadcast of
FILTER_BYTES at most.

The texts are then read a second time against that broadcast.  A line that the second filter doesn't hold is in one
document and never moves.  The keys of the others, as 128-bit digests, are shuffled with their documents' ids; the
digests with more than one id are the true repeats, and their least id the one that keeps them.  Only texts with
suspected lines meet what they have to drop.

With n keys the filters have BITS_A_KEY * n bits up to the bound; beyond that more unrepeated lines are suspected, all
of them in the end, which costs their digests' shuffle and changes no result.

Defined cases: a null or empty text is one empty line; rows with the same id are one document, and a null id is a
document that comes after all others; repeated rows are treated alike; a line that a document repeats within itself is
not repeated for that, and where it is dropped all its places are; keys are told apart by 128-bit digests; a text of more
than BLOCK_BYTES is a block of its own; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes
from roadspark.llm._spark import partitions, spread_join, stored
from roadspark.llm.lm import blocks

#: Code points of the shortest key that counts.
MIN_POINTS = 10
BITS_A_KEY = 12
PROBES = 3
#: Of the filter that is broadcast.
FILTER_BYTES = 128 << 20
#: Texts that a worker holds decoded at once, and bytes of a stored table's row group.
ROWS, GROUP_BYTES = 1024, 16 << 20
U64 = np.uint64

_NEWLINE = np.uint8(10)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of texts, and each text's first line's number (n + 1 of them)."""
    at = np.flatnonzero(raw == _NEWLINE)
    counts = np.searchsorted(at, offsets)
    bounds = counts + np.arange(len(offsets))
    start, end = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    text = np.searchsorted(offsets[1:-1], at, side="right")
    start[bounds[:-1]] = offsets[:-1]
    start[np.arange(len(at)) + text + 1] = at + 1
    end[bounds[1:] - 1] = offsets[1:]
    end[np.arange(len(at)) + text] = at
    return start, end, bounds


def keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines' keys, stripped, and whether they are long enough to count."""
    solid = np.flatnonzero(_bytes.TOKEN[raw])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = b > a
    s, e = start.copy(), start.copy()
    s[full], e[full] = solid[a[full]], solid[b[full] - 1] + 1
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    return s, e, points[e] - points[s] >= MIN_POINTS


def key_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a column: the first text's number, and of the keys that count their texts' numbers in the piece,
    their hashes, starts, ends and the lowered bytes."""
    raw, offsets = _bytes.strings(column)
    for i, j in _bytes.pieces(offsets):
        buf, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, bounds = lines(buf, off)
        s, e, long = keys(buf, start, end)
        text = np.repeat(np.arange(j - i), np.diff(bounds))[long]
        low = _bytes.LOWER[buf]
        yield i, text, _bytes.hash_words(low, s[long], e[long]), s[long], e[long], low


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """A key's bits in its segment."""
    x = _bytes.mix(h * U64(0x9FB21C651E98DF25) + U64(1))
    step = x & U64(0xFFFFFFFF) | U64(1)
    return [((x >> U64(32)) + step * U64(i) & U64(0xFFFFFFFF)) * U64(bits) >> U64(32) for i in range(PROBES)]


def holds(field: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(at[0]), bool)
    for a in at:
        out &= field[a]
    return out


def _send(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            pairs = []
            for column in table.column("text").chunks:
                for _, text, h, *_ in key_hashes(column):
                    order = np.lexsort((text, h))
                    h, text = h[order], text[order]
                    pairs.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))[: len(h)]])  # a document counts once
            key, count = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, U64), return_counts=True)
            edge = np.searchsorted(segment_of(key, n), np.arange(n + 1))
            full = np.flatnonzero(np.diff(edge))
            rows = [[int(s), key[a:b].tobytes(), np.packbits(count[a:b] > 1).tobytes(), int(b - a)] for s, a, b in zip(full, edge[full], edge[full + 1])]
            for k in range(0, len(rows), 512):
                cols = list(zip(*rows[k : k + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], names=["segment", "keys", "twice", "n"])

    return run


def _build(bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            for packed, marks in zip(batch.column("keys"), batch.column("twice")):
                h = np.frombuffer(packed.as_buffer(), "<u8")
                at = places(h, bits)
                again = holds(once, at) | np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8), count=len(h)).astype(bool)
                for a in at:
                    twice[a[again]] = True
                for a in at:
                    once[a] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def repeated_filter(docs: DataFrame, n: int, *, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The second filter, as n segments of equally many packed bits."""
    sent = stored(docs.select("text").mapInArrow(_send(n), "segment long, keys binary, twice binary, n long"), "keys")
    total = sent.agg(F.sum("n")).first()[0] or 0
    size = max(8, min(-(-total * BITS_A_KEY // n // 8), filter_bytes // n))  # bytes of a segment
    out = np.zeros((n, size), np.uint8)
    for r in sent.groupBy("segment").applyInArrow(_build(8 * size), "segment long, bits binary").collect():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def suspected(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    n, size = field.shape
    segment, out = segment_of(h, n), np.ones(len(h), bool)
    for at in places(h, 8 * size):
        out &= (field[segment, (at >> U64(3)).astype(np.int64)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).astype(bool)
    return out


def digest(key: np.ndarray) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspect(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            found = [[] for _ in range(batch.num_rows)]
            for i, text, h, s, e, low in key_hashes(batch.column("text")):
                for k in np.flatnonzero(suspected(field, h)).tolist():
                    found[i + text[k]].append(digest(low[s[k] : e[k]]))
            raw, offsets = _bytes.strings(batch.column("text"))
            count = np.concatenate(([0], np.cumsum(raw == _NEWLINE)))[offsets]
            own = pa.array([digest(raw[a:b]) if f else None for a, b, f in zip(offsets[:-1], offsets[1:], found)], pa.binary())
            digests = pa.array([sorted(set(f)) for f in found], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(np.diff(count) + 1, pa.int64()), digests, own], names=["doc_id", "text", "n_lines", "digests", "own"])

    return run


def without(text: str, drop: set[bytes]) -> tuple[int, str]:
    """How many lines of a text have keys whose digests are in drop, and the text without them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = lines(raw, np.array([0, len(raw)]))
    s, e, long = keys(raw, start, end)
    low = _bytes.LOWER[raw]
    kept = np.ones(len(start), bool)
    for k in np.flatnonzero(long).tolist():
        kept[k] = digest(low[s[k] : e[k]]) not in drop
    return int((~kept).sum()), b"\n".join(raw[a:b].tobytes() for a, b in zip(start[kept], end[kept])).decode()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        dropped, kept = [], []
        for text, drop in zip(batch.column("text"), batch.column("drop")):
            n, rest = without(text.as_py(), set(drop.as_py())) if drop.is_valid else (0, text.as_py())
            dropped.append(n)
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, *, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the text without lines that an earlier document holds."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    field = repeated_filter(docs, max(16, 4 * partitions(spark)), filter_bytes=filter_bytes)
    probed = docs.mapInArrow(_suspect(spark.sparkContext.broadcast(field)), f"doc_id {kind}, text string, n_lines long, digests array<binary>, own binary")
    probed = stored(probed.withColumn("clean", F.size("digests") == 0), "probed", group_bytes=GROUP_BYTES)
    held = probed.filter("not clean").select("doc_id", "own", F.explode("digests").alias("digest"))
    first = held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"), F.count("*").alias("n"))
    first = stored(first.filter("first < last or unnamed and first is not null").select("digest", "first", "n"), "repeats")
    later = spread_join(held, first, "digest", "n").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    # by id and text, so that rows that share an id gather nothing but their own lines
    drop = later.groupBy(F.col("doc_id").alias("of"), F.col("own").alias("its")).agg(F.collect_set("digest").alias("drop"))
    rest = probed.filter("not clean").drop("digests")
    rest = rest.join(drop, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("its")), "left").select("doc_id", "text", "n_lines", "drop")
    done = rest.mapInArrow(_cut, f"doc_id {kind}, n_lines long, n_dropped long, kept string")
    return done.unionByName(probed.filter("clean").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept")))
