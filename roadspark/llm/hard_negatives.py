"""Hard negatives for contrastive training, by distributed radix selection.

A window is an anchor, a range of scores, a rule for labels and a number k: the k best rows of the range are wanted,
higher scores first and then smaller ids.  Vectors are packed into blocks, anchors and their windows into others, and
each pair of blocks is one matrix product of whole numbers; no score leaves it.  What leaves is a histogram a window:
how many scores fall into each value of the current digit, counted from the top of the range, which ends in the block
as soon as it holds as many as are still wanted, as the kth score of all can't lie below it.  The sums over all
blocks locate the value that holds the kth score; the next round refines it by the next digit, until the score is
known.  Then only qualifying rows are gathered: those above the kth score, and of those that equal it each task's
smallest ids.

The first selection takes an anchor's positives (its own label, any score), the second the negatives of each pair
(other labels, scores within two shares of the positive's).

Scores are exact: by 64-bit floats while no sum can reach 2^53, by 64-bit integers up to 2^62, else by Python's own,
and those beyond 2^62 of either sign are given as that.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no
part; rows equal in id, label and vector are one; rows with the anchor's id are no candidates for it, and an id with
several vectors or labels is an anchor by each; vectors are compared with those of the same length only, and an empty
vector scores 0; a positive's score below 0 leaves an empty range of negatives, and one of 0 the score 0 alone; ties go to
the smaller id, then to the smaller label; a range that holds fewer than k rows gives all of them; an anchor without
positives or negatives gives no rows; an empty table gives none; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm._spark import stored

#: Vectors of a block, and anchors of a block.
VECTORS, ANCHORS = 8192, 256
#: Bits of a digit.
DIGIT = 10
POSITIVES, NEGATIVES = 5, 10
#: Shares of the positive's score, in tenths.
LOW, HIGH = 3, 9
#: Rows whose id is divisible by this are anchors.
EVERY = 100
#: No score is given beyond this.
LIMIT = 2**62


def components(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole numbers: of a long, or Python's own if one is too large."""
    with np.errstate(over="ignore"):
        v = np.floor(flat.astype(np.float64) * 256)
    if not len(v) or np.abs(v).max() < 2.0**62:
        return v.astype(np.int64)
    return np.array([256 * int(x) if abs(x) >= 2.0**53 else math.floor(256 * x) for x in flat.tolist()], object)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to VECTORS vectors of the same length d: ids, labels, components q (of a kind: i4, i8, or f8 for
    the vectors themselves where components are beyond a long) and a bound of their square lengths."""
    held: dict[int, list] = {}

    def block(d: int) -> pa.RecordBatch:
        ids, labels, flat = (np.concatenate(x) for x in zip(*held.pop(d)))
        q = components(flat)
        with np.errstate(over="ignore"):
            norm = float(((np.abs(flat) * 256 + 1) ** 2).reshape(len(ids), d).sum(axis=1).max())
        kind = "f8" if q.dtype == object else "i4" if not len(q) or np.abs(q).max() < 2**31 else "i8"
        packed = (flat if kind == "f8" else q).astype(f"<{kind}").tobytes()
        cols = [pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()), pa.array([kind]), pa.array([packed], pa.binary()), pa.array([norm])]
        return pa.RecordBatch.from_arrays(cols, names=["d", "ids", "labels", "kind", "q", "norm"])

    for batch in batches:
        vectors = batch.column("v")
        at = vectors.offsets.to_numpy()
        size = np.diff(at)
        flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), at - at[0]
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            for i in range(0, len(own), VECTORS):
                part = own[i : i + VECTORS]
                held.setdefault(d, []).append((ids[part], labels[part], flat[(at[part][:, None] + np.arange(d)).ravel()]))
                if sum(len(x[0]) for x in held[d]) >= VECTORS:
                    yield block(d)
    for d in list(held):
        yield block(d)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of blocks of vectors, in blocks of ANCHORS or a little more."""
    held: dict[tuple, list] = {}

    def block(d: int, kind: str) -> pa.RecordBatch:
        ids, labels, q = (np.concatenate(x) for x in zip(*held.pop((d, kind))))
        cols = [pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()), pa.array([kind]), pa.array([q.tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["a_d", "a_ids", "a_labels", "a_kind", "a_q", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i4")
            own, key = np.flatnonzero(ids % EVERY == 0), (row["d"], row["kind"])
            if len(own):
                held.setdefault(key, []).append((ids[own], labels[own], np.frombuffer(row["q"], f"<{row['kind']}").reshape(len(ids), row["d"])[own]))
                if sum(len(x[0]) for x in held[key]) >= ANCHORS:
                    yield block(*key)
    for key in list(held):
        yield block(*key)


def unpacked(row: dict, at: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components of a block."""
    ids, labels = np.frombuffer(row[f"{at}ids"], "<i8"), np.frombuffer(row[f"{at}labels"], "<i4")
    raw = np.frombuffer(row[f"{at}q"], f"<{row[f'{at}kind']}")
    return ids, labels, (components(raw) if row[f"{at}kind"] == "f8" else raw.astype(np.int64)).reshape(len(ids), row[f"{at}d"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows of a with all of b, within a long."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object:
        most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
        if most < 2**53:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        if most < 2**62:
            return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def prepared(rows: DataFrame) -> DataFrame:
    """id, label and v (components as doubles) of the rows that take part, each once."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("id", label.alias("label"), F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v")).distinct()


def candidates(row: dict, same: bool) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a pair of blocks: its windows, and the scores that any of them takes, with their ids and labels;
    worst first, and of equal scores the largest id first."""
    if row["d"] != row["a_d"] or not row["windows"]:
        return
    of: dict[int, list[dict]] = {}
    for w in row["windows"]:
        of.setdefault(w["at"], []).append(w)
    ids, labels, q = unpacked(row)
    a_ids, a_labels, a_q = unpacked(row, "a_")
    order = np.lexsort((labels, ids))[::-1]
    ids, labels, q = ids[order], labels[order], q[order]
    used = sorted(of)
    score = products(a_q[used], q)
    for i, s in zip(used, score):
        low, high = min(w["lo"] for w in of[i]), max(w["hi"] for w in of[i])
        may = np.flatnonzero(((labels == a_labels[i]) == same) & (ids != a_ids[i]) & (s >= low) & (s <= high))
        may = may[np.argsort(s[may], kind="stable")]
        yield of[i], s[may], ids[may], labels[may]


def top_digits(s: np.ndarray, w: dict, bits: int) -> dict[int, int]:
    """How many of a block's scores have each digit, of as many as are still wanted; the digit that begins at bit `bits`
    of the distance below w's top."""
    end = int(np.searchsorted(s, w["top"], side="right"))
    low = max(w["lo"], w["top"] - (1 << bits + DIGIT) + 1)
    out: dict[int, int] = {}
    for x in s[max(0, end - w["need"]) : end].tolist():
        if x >= low:
            digit = w["top"] - x >> bits
            out[digit] = out.get(digit, 0) + 1
    return out


def _histograms(same: bool, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, out = batch.slice(i, 1).to_pylist()[0], []
                row["windows"] = [w for w in row["windows"] if not w["done"]]
                for windows, s, *_ in candidates(row, same):
                    out += [(row["block"], w["at"], w["turn"], d, n) for w in windows for d, n in top_digits(s, w, bits).items()]
                if out:
                    cols = zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["block", "at", "turn", "digit", "n"])

    return run


def _gathered(same: bool):
    """Of each pair of blocks the rows above a window's kth score, and the smallest ids of those that equal it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, out = batch.slice(i, 1).to_pylist()[0], []
                for windows, s, ids, labels in candidates(row, same):
                    for w in windows:
                        a, b, end = (int(np.searchsorted(s, w[x], side=y)) for x, y in (("top", "left"), ("top", "right"), ("hi", "right")))
                        take = slice(max(a, b - w["need"]), end)
                        out += [(row["block"], w["at"], w["turn"], *x) for x in zip(s[take].tolist(), ids[take].tolist(), labels[take].tolist())]
                if out:
                    cols = zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["block", "at", "turn", "score", "id", "label"])

    return run


def select(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, *, same: bool, bits: int) -> DataFrame:
    """The k best rows of each window (block, at, turn, lo, hi): rank, score, id and label; hi - lo < 2^bits."""
    key = ["block", "at", "turn"]
    state = windows.select(*key, "lo", "hi", F.col("hi").alias("top"), F.lit(k).alias("need"), F.lit(False).alias("done"))

    def pairs(state: DataFrame) -> DataFrame:
        packed = state.groupBy("block").agg(F.collect_list(F.struct("at", "turn", "lo", "hi", "top", "need", "done")).alias("windows"))
        # blocks against blocks: a stored table of whose size the planner knows
        return blocks.crossJoin(stored(anchors.join(packed, "block"), "windows"))

    for at in range(-(-bits // DIGIT) - 1, -1, -1):
        state = stored(state, "state")
        counts = pairs(state).mapInArrow(_histograms(same, at * DIGIT), "block long, at int, turn int, digit long, n long").groupBy(*key, "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("digit"))
        found = counts.withColumn("upto", upto).join(state.select(*key, "need"), key).filter("upto >= need")
        found = found.groupBy(*key).agg(F.min(F.struct("digit", (F.col("upto") - F.col("n")).alias("above"))).alias("hit"))
        # a window with fewer rows than are wanted takes all, down to its end
        short = F.col("hit").isNull()
        state = state.join(found, key, "left").select(
            *key, "lo", "hi",
            F.when(F.col("done"), F.col("top")).when(short, F.col("lo")).otherwise(F.col("top") - F.shiftleft(F.col("hit.digit"), at * DIGIT)).alias("top"),
            F.when(F.col("done") | short, F.col("need")).otherwise(F.col("need") - F.col("hit.above")).cast("int").alias("need"),
            (F.col("done") | short).alias("done"),
        )
    got = pairs(stored(state, "state")).mapInArrow(_gathered(same), "block long, at int, turn int, score long, id long, label int")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id", "label"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("a_ids").to_pylist()):
            ids = np.frombuffer(packed, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["block", "at", "anchor_id"])


def mine(rows: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score from rows (vec_id, embedding, label)."""
    ready = stored(prepared(rows), "vectors")
    # as many parts as blocks, so that blocks are full however the table was dealt out
    ready = ready.repartition(max(1, -(-ready.count() // VECTORS)))
    blocks = stored(ready.mapInArrow(_packed, "d int, ids binary, labels binary, kind string, q binary, norm double"), "blocks")
    anchors = blocks.mapInArrow(_anchors, "a_d int, a_ids binary, a_labels binary, a_kind string, a_q binary, n int")
    anchors = stored(anchors.withColumn("block", F.monotonically_increasing_id()), "anchors")
    norm = blocks.agg(F.max("norm")).first()[0] or 0.0
    most = LIMIT if norm >= 2.0**62 else min(LIMIT, int(norm * (1 + 1e-12)) + 1)  # no score is larger, of either sign
    blocks = blocks.drop("norm")
    each = anchors.select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), F.lit(0).alias("turn"), F.lit(-most).cast("long").alias("lo"), F.lit(most).cast("long").alias("hi"))
    own = stored(select(blocks, anchors, each, positives, same=True, bits=(2 * most).bit_length()), "positives")
    share = lambda tenths, up: F.expr(f"{tenths} * (score div 10) + ({tenths} * (score % 10) + {9 * up}) div 10")  # noqa: E731  of a score of 0 or more
    pairs = own.filter("score >= 0").select("block", "at", F.col("rank").alias("turn"), share(LOW, 1).alias("lo"), share(HIGH, 0).alias("hi"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = stored(pairs, "pairs")
    found = select(blocks, anchors, pairs.filter("lo <= hi"), negatives, same=False, bits=most.bit_length())
    names = anchors.select("block", "a_ids").mapInArrow(_ids, "block long, at int, anchor_id long")
    found = found.select("block", "at", "turn", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["block", "at", "turn"]).join(names, ["block", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
