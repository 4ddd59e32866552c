"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between, and its words'
stems (their first STEMS bytes, so that inflected forms share weights), hashed to 2^BITS weights.  The learner goes through a bounded sample of labelled rows: of all rows that may be learned from, the
TRAINING_ROWS with the least hash of doc_id; its rates are each coordinate's own, and the L1 term leaves most
weights zero.  The weights (a fixed size, mostly zeros) are broadcast, and every text is scored whole.

Defined cases: a null text is empty, and an empty text has the bias alone; a null doc_id counts as the text '' in
the fold rule and has no label; of several labels of a doc_id the largest holds; null labels are none, and labels
without a document don't count against TRAINING_ROWS; without any label every score is that of PRIOR, below the
threshold, so an untrained model rejects nothing; an empty table of documents gives no rows; repeated rows are scored
alike; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes
from roadspark.llm._spark import remainder

BITS = 20
TRAINING_ROWS = 8_192
ROUNDS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2.0, 0.1
STEMS = (4, 5, 6)
#: What is toxic among so many rows, added to the labels' own counts: the bias starts from the rate of both.
PRIOR = (0.1, 1.0)
#: Predicted toxic from this score on.
THRESHOLD = 0.3
U64 = np.uint64


def features(column: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of a column: the first text's number, distinct features by text, the texts' bounds; of the
    features with a mark in keep, if given."""
    raw, offsets = _bytes.strings(column)
    shift = U64(64 - BITS)
    for i, j in _bytes.pieces(offsets):
        off = offsets[i : j + 1] - offsets[i]
        buf = _bytes.LOWER[raw[offsets[i] : offsets[j]]]
        start, end, bounds = _bytes.words(buf, off, _bytes.WORD)
        sums = _bytes.prefix(buf)
        h = _bytes.hash_spans(sums, start, end, buf)
        text = np.repeat(np.arange(j - i), np.diff(bounds))
        found = [(text, (h >> shift).astype(np.int64))]
        for n in STEMS:
            long = end - start > n
            stem = _bytes.mix(_bytes.hash_spans(sums, start[long], start[long] + n) + U64(n)) >> shift
            found.append((text[long], stem.astype(np.int64)))
        for gap in (1, 2):
            pair = _bytes.mix(h[:-gap] * U64(0xD6E8FEB86659FD93) + h[gap:] + U64(gap)) >> shift
            one = text[:-gap] == text[gap:]
            found.append((text[:-gap][one], pair[one].astype(np.int64)))
        if keep is not None:
            found = [(t[m], f[m]) for t, f in found for m in (keep[f],)]
        both = np.unique(np.concatenate([t << BITS | f for t, f in found]))
        yield i, both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(j - i + 1))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [f[a:b].astype("<u4").tobytes() for _, f, bounds in features(batch.column("text")) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("turn"), pa.array(out, pa.binary())], names=["toxic", "turn", "features"])


def rate(labels: np.ndarray) -> float:
    """The log odds of a label 1 before any text is read."""
    toxic, n = PRIOR[0] + float(np.sum(labels)), PRIOR[1] + len(labels)
    return math.log(toxic / (n - toxic))


def learn(rows: list[np.ndarray], labels: np.ndarray, *, rounds: int = ROUNDS, start: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, the rows in their order, over and over; start: the bias before the first."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(rounds):
        for f, y in zip(rows, labels):
            zf, root = z[f], np.sqrt(n[f])
            w = np.where(np.abs(zf) > L1, (np.sign(zf) * L1 - zf) / ((BETA + root) / ALPHA + L2), 0.0)
            bias = start - zb / ((BETA + np.sqrt(nb)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            after = np.sqrt(n[f] + g * g)
            z[f] = zf + g - (after - root) / ALPHA * w
            n[f] += g * g
            after = np.sqrt(nb + g * g)
            zb += g - (after - np.sqrt(nb)) / ALPHA * (bias - start)
            nb += g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w.astype(np.float32), float(start - zb / ((BETA + np.sqrt(nb)) / ALPHA))


def _learn(pdf):
    pdf = pdf.sort_values(["turn", "features"])
    labels = pdf["toxic"].to_numpy(float)
    w, bias = learn([np.frombuffer(b, "<u4") for b in pdf["features"]], labels, start=rate(labels))
    at = np.flatnonzero(w)
    return pd.DataFrame([{"at": at.astype("<u4").tobytes(), "weight": w[at].tobytes(), "bias": bias}])


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from labels (doc_id, toxic) of docs; at most rows of them are learned from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy("turn").limit(rows)  # so the broadcast is of rows at most
    text = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", "turn")
    ready = text.mapInArrow(_featured, "toxic int, turn long, features binary").orderBy("turn").limit(rows)
    got = ready.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_learn, "at binary, weight binary, bias double").collect()
    w = np.zeros(1 << BITS, np.float32)
    for r in got:
        w[np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["weight"], np.float32)
    return w, got[0]["bias"] if got else rate(np.zeros(0))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs, score and predicted."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    spark = docs.sparkSession
    at = np.flatnonzero(model[0])
    sent = spark.sparkContext.broadcast((at, model[0][at], model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        w = np.zeros(1 << BITS)
        w[at] = values
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for i, f, bounds in features(batch.column(text), w != 0):
                total[i : i + len(bounds) - 1] += np.diff(np.concatenate(([0.0], np.cumsum(w[f])))[bounds])
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*(f"c{i}" for i in range(len(columns))), "score", "predicted"])

    text = columns.index("text") if "text" in columns else len(columns)  # a text goes to the workers once
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate([*columns, "text"][: max(len(columns), text + 1)])))
    schema = StructType([*(StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    out = own.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "score", "predicted")


def score_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted, learned from labels outside the fold held_out."""
    model = train(docs, labels.select("doc_id", "toxic").filter(remainder(folds) != held_out), rows=rows)
    return scored(docs, model).select("doc_id", (remainder(folds) == held_out).alias("held_out"), "score", "predicted")
