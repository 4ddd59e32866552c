"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts become one: the distinct texts are written once, bucketed by their MD5, and all that follows works on
   them, so a copy costs a row of (id, digest) and neither counts in a frequency nor makes a pair.
2. Shingles are SHINGLE consecutive words (lower-cased; a shorter text, but not an empty one, is one shingle).
   Their document frequencies over all distinct texts go into a sketch of CELLS counters, summed up by segments;
   the mean cell is taken off an estimate, which is then right to some 2 sqrt(shingles / CELLS): rare shingles are
   all alike to it, and common ones are told from them.  A shingle weighs tf * (1 + ln((1 + n) / (1 + df))).
   Near copies count as ALIKE texts at most: a text whose least shingle, by one of SEEDS orders, is also that of more
   than ALIKE texts counts as a part.  Else what a large group of copies has in common would weigh little, what each
   copy has of its own much, and the group would fall apart the more the larger it is.
3. Each text has BANDS * ROWS samples: sample k of a weighted set is the shingle and the step of its weight that
   minimise c / (y e^r), with r, c, b drawn from the shingle and k, t = floor(ln w / r + b), y = e^(r (t - b)).
   Two texts agree in a sample with the probability of their weighted Jaccard similarity.
4. Texts of equal samples in a band, and of a total weight that allows the similarity, meet: each is linked to the
   least of its bucket, which is an aggregate and needs no group in memory, and the components of these links are
   the candidate groups.
5. A candidate group's texts are compared by weighted Jaccard similarity: all that share a band, but for those that
   are linked already; a text meets all others at once, by lists of the texts that have a shingle.
   A group of more than GROUP texts is dealt out by hash over tasks; each finds its classes, and the classes'
   leaders meet in the next round.  Buckets in which several classes are left after that are compared whole, two
   parts of GROUP texts at a time, so that no link between texts that share a band is lost.
6. The verified links' components are the classes.

A band of ROWS samples agrees with probability s^ROWS, so BANDS of them miss a pair of similarity 0.8 with
(1 - 0.8^4)^BANDS = 0.002; README has the recall that was measured against brute force.

Defined cases: a null text is empty; rows of equal texts are one class, empty ones too; a null doc_id is kept, and
a class is named by its least doc_id that isn't null (null if none); repeated rows are in one class, of which one
row alone is kept; a text of any length is one set of its distinct shingles, some 50 bytes a word while it is
sampled; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes
from roadspark.llm._spark import id_text, partitions, shared_dir, spread_join, stored
from roadspark.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
CELLS = 1 << 21
GROUP = 4000
#: Texts that one is compared with pair by pair.
FEW = 8
ALIKE, SEEDS, PARTS = 16, 4, 1 << 20
U64 = np.uint64


def _variates() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) by the quantiles of 65,536 even probabilities, and its logarithm."""
    x = np.linspace(0, 30, 400_001)
    cdf = 1 - (1 + x) * np.exp(-x)
    g = np.interp((np.arange(65536) + 0.5) / 65536, cdf, x)
    return g.astype(np.float32), np.log(g).astype(np.float32)


GAMMA, LOG_GAMMA = _variates()
_SALT = _bytes.mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def shingles(column: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a column: the first text's number, distinct shingles by text, their times, the texts' bounds."""
    raw, offsets = _bytes.strings(column)
    for i, j in _bytes.pieces(offsets):
        off = offsets[i : j + 1] - offsets[i]
        buf = _bytes.LOWER[raw[offsets[i] : offsets[j]]]
        start, end, bounds = _bytes.words(buf, off, _bytes.WORD)
        g, bounds = _bytes.grams(_bytes.hash_words(buf, start, end), bounds, n)
        text = np.repeat(np.arange(j - i, dtype=U64), np.diff(bounds))
        own = _bytes.mix(text + U64(0x2545F4914F6CDD1D))
        _, first, times = np.unique(g ^ own, return_index=True, return_counts=True)
        order = np.argsort(first)  # by text again
        first, times = first[order], times[order]
        yield i, g[first], times, np.searchsorted(first, bounds)


def cell_of(g: np.ndarray) -> np.ndarray:
    return (_bytes.mix(g + U64(0x632BE59BD9B4E019)) >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _sketch(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts, rows = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), 0
        for batch in batches:
            share = batch.column("share").to_numpy()  # in parts; PARTS for a text that counts as one
            rows += int(share.sum())
            for i, g, _, bounds in shingles(batch.column("text")):
                cell, own = cell_of(g), np.repeat(share[i : i + len(bounds) - 1], np.diff(bounds))
                counts += np.bincount(cell[own == PARTS], minlength=CELLS)
                np.add.at(parts, cell[own < PARTS], own[own < PARTS])
        size = CELLS // segments
        of = lambda x: pa.array([_bytes.pack(x[s * size : (s + 1) * size]) for s in range(segments)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(segments), pa.int32()), of(counts), of(parts), pa.array([rows] * segments, pa.int64())], names=["segment", "counts", "parts", "n"])

    return run


def _add(key, pdf):
    whole, parts = (np.sum([_bytes.unpack(b).astype(np.int64) for b in pdf[c]], axis=0) for c in ("counts", "parts"))
    total = whole + parts / PARTS
    return pd.DataFrame([{"segment": key[0], "counts": total.astype(np.float32).tobytes(), "n": int(pdf["n"].sum())}])


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least shingle of each text that has one, by SEEDS orders."""
    for batch in batches:
        for i, g, _, bounds in shingles(batch.column("text")):
            have = np.flatnonzero(np.diff(bounds) > 0)
            if len(have):
                low = np.stack([np.minimum.reduceat(_bytes.mix(g * U64(2) ^ _SALT[k]), bounds[:-1][have]) for k in range(SEEDS)], axis=1)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(_bytes.mix(low + np.arange(SEEDS, dtype=U64)).view(np.int64).ravel()), SEEDS)
                yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(i + have)), keys.cast(pa.list_(pa.int64()))], names=["digest", "keys"])


def shares(body: DataFrame) -> DataFrame:
    """digest and share (in PARTS) of the texts that count as less than one."""
    keys = stored(body.mapInArrow(_least, "digest binary, keys array<bigint>").select("digest", F.explode("keys").alias("key")), "least")
    large = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > ALIKE).withColumn("rows", F.col("n")), "alike")
    share = F.greatest(F.lit(1), F.floor(F.lit(PARTS * ALIKE) / F.max("n"))).cast("long")
    return spread_join(keys, large, "key", "rows").groupBy("digest").agg(share.alias("share"))


def frequency_weights(body: DataFrame) -> np.ndarray:
    """A weight for each cell: 1 + ln((1 + n) / (1 + df)).  Its size is fixed, so it may be broadcast."""
    segments = 64
    body = body.join(stored(shares(body), "shares"), "digest", "left").select("text", F.coalesce("share", F.lit(PARTS).cast("long")).alias("share"))
    rows = body.mapInArrow(_sketch(segments), "segment int, counts binary, parts binary, n long").groupBy("segment").applyInPandas(_add, "segment int, counts binary, n long").collect()
    counts = np.zeros(CELLS, np.float32)
    size = CELLS // segments
    for r in rows:
        counts[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["counts"], np.float32)
    n = max([1, *(r["n"] / PARTS for r in rows)])
    df = np.clip(counts - counts.mean(), 1, n)
    return (1 + np.log((1 + n) / (1 + df))).astype(np.float32)


def samples(g: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples (rows) of each text (columns); texts must have shingles."""
    log_w, out = np.log(weight).astype(np.float32), np.zeros((len(_SALT), len(bounds) - 1), np.uint32)
    for k, salt in enumerate(_SALT):
        x = (g ^ (g >> U64(29))) * salt
        x ^= x >> U64(32)
        r = GAMMA[x & U64(0xFFFF)]
        b = ((x >> U64(32)) & U64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + b)
        a = LOG_GAMMA[(x >> U64(16)) & U64(0xFFFF)] - r * (t - b) - r
        bits = a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # in the order of the numbers
        tag = (x >> U64(24)).astype(np.uint32) * np.uint32(0x9E3779B1) ^ t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA77)
        out[k] = np.minimum.reduceat((bits.astype(U64) << U64(32)) | tag, bounds[:-1]).astype(np.uint32)
    return out


def _signatures(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bands, total = np.zeros((n, BANDS), np.int64), np.zeros(n)
            for i, g, times, bounds in shingles(batch.column("text")):
                have = np.flatnonzero(np.diff(bounds) > 0)
                if not len(have):
                    continue
                w = times * weights.value[cell_of(g)]
                at = bounds[:-1][have]
                sig = samples(g, w, np.append(at, len(g))).astype(U64)
                for b in range(BANDS):
                    x = np.full(len(have), b + 1, U64)
                    for row in sig[b * ROWS : (b + 1) * ROWS]:
                        x = _bytes.mix(x * U64(0x9E3779B97F4A7C15) + row)
                    bands[i + have, b] = x.view(np.int64)
                total[i + have] = np.add.reduceat(w.astype(np.float64), at)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array(total)], names=["digest", "bands", "total"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets, each as sorted hashes and weights."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[int], np.ndarray]:
    """A function of a text's place that gives what it has in common with each of the sets, by weight: for every shingle the
    texts that have it are listed once, so a text meets all others in a few passes over the lists of its own shingles."""
    size = np.array([len(s[0]) for s in sets])
    bounds = np.concatenate(([0], np.cumsum(size)))
    _, name = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    weight = np.concatenate([s[1] for s in sets])
    order = np.argsort(name, kind="stable")
    start = np.searchsorted(name[order], np.arange(name.max(initial=-1) + 2))
    text, listed = np.repeat(np.arange(len(sets)), size)[order], weight[order]

    def of(x: int) -> np.ndarray:
        own = slice(bounds[x], bounds[x + 1])
        first, times = start[name[own]], start[name[own] + 1] - start[name[own]]
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.bincount(text[at], np.minimum(listed[at], np.repeat(weight[own], times)), minlength=len(sets))

    return of


def links(sets: list[tuple[np.ndarray, np.ndarray]], bands: list[np.ndarray], least: float) -> list[int]:
    """The class of each text (its leader's place), where texts that share a band and are similar are of one class.

    A text that is compared meets all that share a band with it at once.  In each bucket only texts of its largest class need
    not be compared, as the others of another class have met them.  Memory grows with the texts, not with their pairs."""
    n = len(sets)
    label, done, total = np.arange(n), np.zeros(n, bool), np.array([float(s[1].sum()) for s in sets])
    bands = np.array(bands)
    common = None

    def compare(x: int) -> bool:
        """Links x to what it is similar to; whether there was any of another class."""
        nonlocal common
        done[x] = True
        alike = np.minimum(total, total[x]) >= least * np.maximum(total, total[x])
        y = np.flatnonzero((bands == bands[x]).any(1) & alike & ~done & (label != label[x]))
        if len(y) <= FEW:
            near = y[[1 - similarity(sets[x], sets[i]) <= 1 - least + 1e-9 for i in y]] if len(y) else y
        else:
            common = common or overlaps(sets)
            low = common(x)[y]
            near = y[1 - low / (total[x] + total[y] - low) <= 1 - least + 1e-9]
        if len(near):
            joined = np.unique(label[np.append(near, x)])
            label[np.isin(label, joined)] = joined[0]
        return len(near) > 0

    buckets: dict[tuple[int, int], list[int]] = {}
    for i, bs in enumerate(bands):
        for k, b in enumerate(bs.tolist()):
            buckets.setdefault((k, b), []).append(i)
    for bucket in buckets.values():
        members = np.array(bucket)
        while True:
            members = members[~done[members]]
            if (label[members] == label[members[:1]]).all():
                break
            _, of, times = np.unique(label[members], return_inverse=True, return_counts=True)
            # the smallest classes first, until one more link makes other classes
            for x in members[np.argsort(times[of], kind="stable")][: len(members) - times.max()]:
                if compare(int(x)):
                    break
    return label.tolist()


def _classes(weights, least: float):
    def run(key, table):
        table = table.combine_chunks().sort_by("digest")
        sets: list = []
        for _, g, times, bounds in shingles(table.column("text")):
            w = times * weights.value[cell_of(g)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                order = np.argsort(g[a:b])
                sets.append((g[a:b][order], w[a:b][order].astype(np.float64)))
        leader = links(sets, [np.array(b) for b in table.column("bands").to_pylist()], least)
        names = table.column("digest").to_pylist()
        return pa.table({"a": pa.array(names, pa.binary()), "b": pa.array([names[i] for i in leader], pa.binary())})

    return run


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest and text of the distinct texts, written once in buckets of digests: joins on the digest leave them in place."""
    spark = docs.sparkSession
    name = f"near_dup_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    texts = docs.select("digest", "text").dropDuplicates(["digest"])
    texts.write.bucketBy(partitions(spark), "digest").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def near_duplicates(docs: DataFrame, *, least: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """doc_id, class_id, class_rows (rows of the class), kept (true for one row of each class) and text_md5 of every
    row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = stored(docs.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")), "rows")
    body = distinct_texts(docs)
    weights = spark.sparkContext.broadcast(frequency_weights(body))
    signed = stored(body.mapInArrow(_signatures(weights), "digest binary, bands array<bigint>, total double"), "signatures")

    # similar texts' total weights are within one step of each other, so they share one of two neighbouring classes
    step = F.floor(F.log(F.col("total")) / F.log(F.lit(1 / least)))
    near = signed.filter("total > 0").select("digest", F.posexplode("bands").alias("band", "value"), step.alias("step"))
    near = stored(near.select("digest", F.explode(F.array(*(F.xxhash64("band", "value", F.col("step") + i) for i in (0, 1)))).alias("bucket")), "buckets")
    low = near.groupBy("bucket").agg(F.min("digest").alias("b"), F.count("*").alias("n")).filter("n > 1")
    pairs = spread_join(near, stored(low, "low"), "bucket", "n").select(F.col("digest").alias("a"), "b").filter("a <> b").distinct()
    candidates = connected_components(pairs)

    def compared(dealt: DataFrame, by: list[str]) -> DataFrame:
        """Links (a, b) of each text to its class's leader within its group by; dealt names the groups' digests."""
        dealt = stored(dealt.join(signed.select("digest", "bands"), "digest"), "dealt")
        found = body.join(dealt, "digest").select("digest", *by, "text", "bands")
        return stored(found.groupBy(*by).applyInArrow(_classes(weights, least), "a binary, b binary"), "links")

    members, found, whole = stored(candidates.withColumnRenamed("node", "digest"), "candidates"), None, True
    while True:
        sized = members.join(members.groupBy("component").agg(F.count("*").alias("n")), "component")
        # a large group's texts are dealt out, by hash, over tasks of about group texts
        part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / group))
        dealt = sized.select("digest", "component", part.alias("part"), (F.col("n") > group).alias("large"))
        step_links = compared(dealt, ["component", "part"])
        found = step_links if found is None else found.unionByName(step_links)
        large = dealt.filter("large").select("digest", "component")
        before = large.count()
        if not before:
            break
        # the classes' leaders meet in the next round, as long as there are much fewer of them
        whole = False
        members = stored(step_links.select(F.col("b").alias("digest")).distinct().join(large, "digest"), "candidates")
        if members.count() > 0.9 * before:
            break
    if whole:
        classes = found.select(F.col("a").alias("digest"), F.col("b").alias("component"))
    else:
        # what leaders don't show: buckets that still hold several classes, two parts of a bucket at a time
        classes = stored(connected_components(found).withColumnRenamed("node", "digest"), "classes")
        lone = candidates.withColumnRenamed("node", "digest").join(classes.select("digest"), "digest", "left_anti").select("digest", F.col("digest").alias("component"))
        inside = stored(near.join(classes.unionByName(lone), "digest"), "inside")
        mixed = inside.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / group).cast("int").alias("parts")).filter("low <> high")
        own = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
        pairs = inside.join(mixed, "bucket").select("digest", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        pairs = pairs.select("digest", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        found = found.unionByName(compared(pairs, ["bucket", "i", "j"]))
        classes = connected_components(found).withColumnRenamed("node", "digest")
    texts = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    named = stored(texts.join(classes, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "named")
    heads = named.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("class_rows"), F.count("*").alias("n"))
    of = stored(spread_join(named.select("digest", "component", "copies"), stored(heads, "heads"), "component", "n"), "classes")
    out = spread_join(rows, of, "digest", "copies")
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), "class_rows", (F.col("row") == F.col("head.row")).alias("kept"), F.col("digest").alias("text_md5"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, that with the least doc_id."""
    docs = docs.withColumns({"_digest": F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))), "_id": id_text(), "_none": F.col("doc_id").isNull()})
    keep = near_duplicates(docs, **options).filter("kept").select(F.col("text_md5").alias("_digest"), id_text().alias("_id"), F.col("doc_id").isNull().alias("_none"))
    # repeated rows are dropped within the join's own partitions, without another exchange of texts
    by = ["_digest", "_id", "_none"]
    return docs.join(keep, by, "left_semi").dropDuplicates(by).drop(*by)
