"""How document filters interact: what each removes, in every order of them.

A scan of the texts' Arrow buffers gives each document a mask of the filters that it fails.  Byte classes and their
prefix sums count words, capitals, symbols and code points of many texts at once; a text's words are told apart by
sorted hashes, and words with equal hashes are compared byte by byte, so that the number of distinct words is exact.
A text is identical to one of a smaller id if it isn't the least id's of its digest, which is found by one partial
aggregate and a join by digest and id together, so that a group of copies is dealt out by its ids.  The documents then
shrink to counts by part and mask, 32 a part at most, and every order's rows are sums over masks: a fixed matrix of
600 rows by 32 masks, applied to each part's counts.

Defined cases: a null text is empty, and an empty text has no words; a null source is the part ''; a null id is neither
smaller than another nor larger; repeated rows count each, and rows with the same id are no copies of each other; of
several labels of an id any label 1 counts, and null labels don't; texts of more than LONG_BYTES are scanned in chunks
cut at white space, with their distinct words in a set; texts are told apart by 128-bit digests; an empty table gives no
rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes
from roadspark.llm._spark import stored

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
#: Texts from here on are scanned in chunks.
LONG_BYTES = 1 << 20

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_POINT = np.ones(256, bool)  # all bytes but a code point's later ones
_POINT[0x80:0xC0] = False


def totals(kind: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of a kind each text has."""
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(kind[buf], out=sums[1:])
    return np.diff(sums[offsets])


def distinct_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of distinct words of each text; fewer than 2^16 texts."""
    n = np.diff(bounds)
    if not len(start):
        return n
    text = np.repeat(np.arange(len(n)), n)
    key = text.astype(np.uint64) << np.uint64(48) | _bytes.hash_words(buf, start, end) >> np.uint64(16)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[same], order[same + 1]
    size = end - start
    alike = size[a] == size[b]
    short = np.minimum(size[a], size[b])
    first = np.cumsum(short) - short
    step = np.arange(int(short.sum()))
    unlike = buf[np.repeat(start[a] - first, short) + step] != buf[np.repeat(start[b] - first, short) + step]
    if unlike.any():
        alike &= np.bincount(np.repeat(np.arange(len(a)), short)[unlike], minlength=len(a)) == 0
    out = n - np.bincount(text[a], minlength=len(n))
    for t in np.unique(text[a[~alike]]).tolist():  # unlike words with equal hashes: by the words themselves
        out[t] = len({buf[start[i] : end[i]].tobytes() for i in range(bounds[t], bounds[t + 1])})
    return out


def chunks(raw: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A text in chunks of size bytes or a little more, cut at white space."""
    at = 0
    while at < len(raw):
        to = at + size
        while to < len(raw):
            gap = np.flatnonzero(~_bytes.TOKEN[raw[to : to + size]])
            if len(gap):
                to += int(gap[0])
                break
            to += size
        yield raw[at:to]
        at = to


def measures(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    start, end, bounds = _bytes.words(raw, offsets, _bytes.TOKEN)
    return np.diff(bounds), distinct_words(raw, start, end, bounds), *(totals(k, raw, offsets) for k in (_CAPITAL, _POINT, _SYMBOL))


def long_measures(raw: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The same of one long text, a chunk at a time."""
    total, seen = np.zeros(5, np.int64), set()
    for part in chunks(raw, size):
        start, end, _ = _bytes.words(part, np.array([0, len(part)]), _bytes.TOKEN)
        total += [len(start), 0, *(int(k[part].sum()) for k in (_CAPITAL, _POINT, _SYMBOL))]
        seen.update(part.tobytes().split())  # by the same six bytes as TOKEN
    total[1] = len(seen)
    return tuple(total[i : i + 1] for i in range(5))


def failures(words: np.ndarray, distinct: np.ndarray, capitals: np.ndarray, points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Bits of the first four filters that a text fails."""
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITALS_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _scan(long_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes.strings(batch.column("text"))
            found = [np.zeros(0, np.int32)]
            for i, j in _bytes.pieces(offsets, min(1 << 18, long_bytes)):
                own, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if j - i == 1 and len(own) > long_bytes:
                    found.append(failures(*long_measures(own, long_bytes)))
                    continue
                for a in range(0, j - i, 1 << 15):  # no more texts at once than a key has room for
                    part = off[a : a + (1 << 15) + 1]
                    found.append(failures(*measures(own[part[0] : part[-1]], part - part[0])))
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(np.concatenate(found))], names=["doc_id", "part", "digest", "mask"])

    return run


def failed(docs: DataFrame, *, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, part and mask (bit i: FILTERS[i] is failed) of each document."""
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(own.mapInArrow(_scan(long_bytes), f"doc_id {kind}, part string, digest binary, mask int"), "masks")
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones by part and mask."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long")).alias("good"), F.max((F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")).alias("bad"))
    return masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "bad")))


def orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each order and step: the order's name, the step's filter as a bit and the bits of those before it."""
    names, own, before = [], [], []
    for p in itertools.permutations(range(len(FILTERS))):
        done = 0
        for f in p:
            names.append("".join(FILTERS[i] for i in p))
            own.append(1 << f)
            before.append(done)
            done |= 1 << f
    return names, np.array(own), np.array(before)


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, own, before = orders()
    mask = np.arange(1 << len(FILTERS))
    fails, earlier = (mask & own[:, None]) > 0, (mask & before[:, None]) > 0
    step = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names) // len(FILTERS))
    columns = [f.split()[0] for f in _REPORT.split(", ")]
    for batch in batches:
        for part, cell in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            count = np.zeros((3, len(mask)), np.int64)
            for c in cell:
                count[:, c["mask"]] = c["n"], c["good"], c["bad"]
            n, good, bad = count
            removed = (fails & ~earlier) @ n
            by_filter = np.bincount(own, weights=removed, minlength=len(mask)).astype(np.int64)
            values = [~(fails | earlier) @ n, removed, (fails & earlier) @ n, n[own], (fails & ~earlier) @ good, (fails & ~earlier) @ bad, by_filter[own]]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array(names), pa.array(step), *(pa.array(v, pa.int64()) for v in values)], names=columns)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; a sum of removed documents up to 2^53 is exact."""
    packed = cells(failed(docs), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))
    return packed.mapInArrow(_report, _REPORT)
