"""Language-model scoring with a log-frequency Bloom filter.

Training: every worker hashes the tokens of its texts and sends, for each segment of the hash space, the distinct
unigrams and bigrams of a block with their counts; the owner of a segment sums them, exactly, over the whole
corpus, quantises each count to a level on a logarithmic scale, and inserts the n-gram with each level up to its
own into the segment's Bloom filter.  A filter has as many bits as its own insertions ask for, so every n-gram is
kept whatever the corpus; the segments are rows of a stored table, and only their statistics' sums come to the driver.

Scoring: a count is read back by probing for level 1, 2, ... until a probe misses, and
    P(w | v) = L * c(v, w) / c(v) + (1 - L) * P(w)
with L = BIGRAM_WEIGHT where c(v) > 0 and 0 elsewhere; P(w) = c(w) / (N + 1) for unigrams in the filter, and 1 / (N + 1)
for all others.  (A caller may name a bound, filter_bytes; the segments then keep the n-grams with at least the least
count for which they fit, and the unigrams left out share their mass evenly with the unknown.)

Each block sends its distinct unigrams and bigrams to the segments' owners, who hold one segment's filter at a time
and send the levels back in the same order; the block's texts go to where the answers meet, once.  The base score needs the exact count of every token, so the block also
sends its (token, text, times) triples; the owner adds up the counts, and sends each text's sum of
tf * log10(c + 1) back to its block.

Defined cases: a null text is empty, and an empty text has the end token alone; a null doc_id counts as the text
'' in the training rule; repeated rows count each; with no training text at all every count is 0; an empty table
gives no rows; a text of more than BLOCK_BYTES is a block of its own, some 60 bytes a token at once.  Tokens are
told apart by 64-bit hashes (BLAKE2b from 128 bytes on).  Other columns of the input are not read.  The input must give the same rows when
read again, as a table does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes
from roadspark.llm._spark import only, partitions, remainder, stored

PROBES = 3
#: Insertions a bit: about a third of the bits are set at most.
FILL = 0.4
#: Ratio of a level's least count to the one below it.
STEP = 1.5
BIGRAM_WEIGHT = 0.6
#: Bytes of text that a worker sums up before it sends.
BLOCK_BYTES = 12 << 20
END = np.uint64(0xFFFFFFFFFFFFFFFE)
START = np.uint64(0x5851F42D4C957F2D)
U64 = np.uint64

#: The least count of each level: 1, 2, 3, 4, 6, 9, ... by STEP, never the same twice.
_LEVELS = [1]
while _LEVELS[-1] < 1 << 50:
    _LEVELS.append(max(_LEVELS[-1] + 1, int(_LEVELS[-1] * STEP)))
LEAST = np.array(_LEVELS)
#: What a level stands for: the geometric mean of its ends.
VALUE = np.concatenate(([0.0], np.sqrt(LEAST * np.append(LEAST[1:] - 1, LEAST[-1] * STEP))))


def levels(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, count, side="right")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end behind it, and the texts' bounds."""
    raw, offsets = _bytes.strings(column)
    found, sizes = [], []
    for i, j in _bytes.pieces(offsets):
        off = offsets[i : j + 1] - offsets[i]
        buf = _bytes.LOWER[raw[offsets[i] : offsets[j]]]
        start, end, bounds = _bytes.words(buf, off, _bytes.TOKEN)
        h = _bytes.hash_words(buf, start, end)
        found.append(np.insert(h, bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(found) if found else np.zeros(0, U64)), bounds


def bigrams(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bigram that ends at each token; a text's first follows START."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1]] = START
    return _bytes.mix(before * U64(0xD6E8FEB86659FD93) + h)


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash's segment of n, in the hashes' own order."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows in blocks of about BLOCK_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        offsets = _bytes.strings(batch.column("text"))[1]
        for i, j in _bytes.pieces(offsets, BLOCK_BYTES):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES // 2:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def count_blocks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            h, bounds = tokens(table.column("text"))
            parts = [distinct(h), distinct(bigrams(h, bounds))]
            edges = [np.searchsorted(segment_of(k, n), np.arange(n + 1)) for k, _ in parts]
            rows = []
            for s in range(n):
                (a, b), (c, d) = (e[s : s + 2] for e in edges)
                if a < b or c < d:
                    # the high bits of a bigram are its segment's, so that the low 32 tell it apart there
                    rows.append((s, parts[0][0][a:b].tobytes(), _bytes.pack(parts[0][1][a:b]), (parts[1][0][c:d] & U64(0xFFFFFFFF)).astype("<u4").tobytes(), _bytes.pack(parts[1][1][c:d])))
            for k in range(0, len(rows), 512):
                cols = list(zip(*rows[k : k + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["segment", "uni", "uni_n", "bi", "bi_n"])

    return run


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def probes(key: np.ndarray, level: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits in its segment for an n-gram at a level."""
    x = _bytes.mix(key * U64(0x9FB21C651E98DF25) + level.astype(U64))
    step = x & U64(0xFFFFFFFF) | U64(1)
    return [((x >> U64(32)) + step * U64(i) & U64(0xFFFFFFFF)) * U64(bits) >> U64(32) for i in range(PROBES)]


def build_segment(limit: int | None):
    """One segment's bits and statistics from all blocks' counts; limit: the most bits it may have, if any."""

    def run(key, pdf):
        uni, uni_n = summed([np.frombuffer(b, "<u8") for b in pdf["uni"]], [_bytes.unpack(b) for b in pdf["uni_n"]])
        bi, bi_n = summed([np.frombuffer(b, "<u4") for b in pdf["bi"]], [_bytes.unpack(b) for b in pdf["bi_n"]])
        low = np.concatenate(((uni & U64(0xFFFFFFFF)), bi.astype(U64) | U64(1 << 32)))
        count = np.concatenate((uni_n, bi_n))
        level = levels(count)
        by = np.bincount(level, weights=level, minlength=2)[::-1].cumsum()[::-1]  # insertions if only this level and above stay
        bits, least = max(64, -(-int(by[1] * PROBES / FILL) // 8) * 8), 1
        if limit is not None and bits > limit:
            bits, fit = limit, FILL * limit / PROBES
            least = max(1, int(np.argmax(by <= fit)) if (by <= fit).any() else len(by))
        keep = level >= least
        low, level = low[keep], level[keep]
        field = np.zeros(bits, bool)
        top = int(level.max()) if len(level) else 0
        for q in range(1, top + 1):
            k = low[level >= q]
            for at in probes(k, np.full(len(k), q), bits):
                field[at] = True
        out = keep[: len(uni)]
        return pd.DataFrame([{"segment": key[0], "bits": np.packbits(field).tobytes(), "tokens": int(uni_n.sum()), "types": len(uni), "rest_tokens": int(uni_n[~out].sum()), "rest_types": int((~out).sum()), "ngrams": len(low), "least": int(LEAST[least - 1])}])

    return run


def read_back(field: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The level of each of a segment's n-grams in its packed bits: 0 if it isn't in the filter."""
    out = np.zeros(len(low), np.uint8)
    left, q = np.arange(len(low)), 1
    while len(left) and q < len(VALUE):
        hit = np.ones(len(left), bool)
        for at in probes(low[left], np.full(1, q), 8 * len(field)):
            hit &= (field[at >> U64(3)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).astype(bool)
        left = left[hit]
        out[left] = q
        q += 1
    return out


def logs(h: np.ndarray, bounds: np.ndarray, uni: np.ndarray, bi: np.ndarray, tokens_n: int, rare: float) -> np.ndarray:
    """log10 P of each token after the one before it; uni and bi: the levels of the distinct unigrams and bigrams."""
    u, back = np.unique(h, return_inverse=True)
    c = VALUE[uni]
    p = np.where(c > 0, c / (tokens_n + 1), rare)[back]
    start = c[np.searchsorted(u, END)]  # texts, read back as their ends
    c = c[back]
    two = VALUE[bi][np.unique(bigrams(h, bounds), return_inverse=True)[1]]
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[bounds[:-1]] = start
    seen = before > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        joint = np.where(seen, np.minimum(1.0, two / before), 0.0)
    return np.log10(np.where(seen, BIGRAM_WEIGHT * joint + (1 - BIGRAM_WEIGHT) * p, p))


def train(docs: DataFrame, n: int, *, filter_bytes: int | None = None) -> DataFrame:
    """The model of all texts of docs: a stored table of n segments at most, of filter_bytes in all if that is given."""
    limit = None if filter_bytes is None else max(64, filter_bytes * 8 // n // 8 * 8)
    sent = only(docs, "text").mapInArrow(count_blocks(n), "segment long, uni binary, uni_n binary, bi binary, bi_n binary")
    return stored(sent.groupBy("segment").applyInPandas(build_segment(limit), "segment long, bits binary, tokens long, types long, rest_tokens long, rest_types long, ngrams long, least long"), "lm")


def _ask_blocks(n: int):
    """Rows for the segments' owners: a block's tokens with the texts that hold them, and its bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "block", "keys", "bi", "train", "texts", "of", "times"]
        for number, table in enumerate(blocks(batches)):
            block = (table.column("part")[0].as_py() << 24) + number
            h, bounds = tokens(table.column("text"))
            size = np.diff(bounds)
            held = np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool)
            keys, which = np.unique(h, return_inverse=True)
            two = np.unique(bigrams(h, bounds))
            text = np.repeat(np.arange(len(size)), size)
            pair, times = np.unique(which.astype(np.int64) * len(size) + text, return_counts=True)
            of, text = pair // len(size), pair % len(size)
            train = np.bincount(of, weights=times * ~held[text], minlength=len(keys)).astype(np.int64)
            texts = np.bincount(of, minlength=len(keys))
            edge, edge2 = (np.searchsorted(segment_of(k, n), np.arange(n + 1)) for k in (keys, two))
            pairs = np.concatenate(([0], np.cumsum(texts)))
            rows = []
            for s in range(n):
                (a, b), (c, d) = edge[s : s + 2], edge2[s : s + 2]
                if a < b or c < d:
                    rows.append((s, block, keys[a:b].tobytes(), (two[c:d] & U64(0xFFFFFFFF)).astype("<u4").tobytes(), _bytes.pack(train[a:b]), _bytes.pack(texts[a:b]), _bytes.pack(text[pairs[a] : pairs[b]]), _bytes.pack(times[pairs[a] : pairs[b]])))
            for k in range(0, len(rows), 256):
                cols = list(zip(*rows[k : k + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=names)

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's own rows, which wait where the answers come back; numbered as in _ask_blocks()."""
    for number, table in enumerate(blocks(batches)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([(table.column("part")[0].as_py() << 24) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "head"])


_ANSWER = "block long, segment long, texts binary, sums binary, known binary, uni binary, bi binary"


def _look_up(key, pdf, segment):
    """A segment's owner: levels by its filter, counts over all blocks, and each text's sums for its block."""
    out, names = [], [c.split()[0] for c in _ANSWER.split(", ")]
    if len(pdf):
        keys = [np.frombuffer(b, "<u8") for b in pdf["keys"]]
        all_keys, count = summed(keys, [_bytes.unpack(b) for b in pdf["train"]])
        logs = np.log10(count + 1.0)
        field = np.frombuffer(segment["bits"].iloc[0], np.uint8) if len(segment) else np.zeros(8, np.uint8)
        uni = read_back(field, all_keys & U64(0xFFFFFFFF))
        for k, block, two, texts, of, times in zip(keys, pdf["block"], pdf["bi"], pdf["texts"], pdf["of"], pdf["times"]):
            place = np.searchsorted(all_keys, k)
            at = np.repeat(place, _bytes.unpack(texts))
            of, times = _bytes.unpack(of).astype(np.int64), _bytes.unpack(times).astype(np.float64)
            sums, known = np.bincount(of, weights=logs[at] * times), np.bincount(of, weights=times * (count[at] > 0))
            there = np.unique(of)
            bi = read_back(field, np.frombuffer(two, "<u4").astype(U64) | U64(1 << 32))
            out.append({"block": block, "segment": key[0], "texts": _bytes.pack(there), "sums": sums[there].tobytes(), "known": _bytes.pack(known[there].astype(np.int64)), "uni": uni[place].tobytes(), "bi": bi.tobytes()})
    return pd.DataFrame(out, columns=names)


def _gather(tokens_n: int, types: int, rare: float):
    def run(key, pdf):
        table = pa.ipc.open_stream(pdf["head"].dropna().iloc[0]).read_all()
        h, bounds = tokens(table.column("text"))
        n = np.diff(bounds)
        base, known = np.zeros(len(n)), np.zeros(len(n), np.int64)
        part = pdf[pdf["head"].isna()].sort_values("segment")  # the keys' order, and the same order of sums each time
        for texts, sums, k in zip(part["texts"], part["sums"], part["known"]):
            at = _bytes.unpack(texts).astype(np.int64)
            base[at] += np.frombuffer(sums)
            known[at] += _bytes.unpack(k).astype(np.int64)
        uni, bi = (np.frombuffer(b"".join(part[c]), np.uint8) for c in ("uni", "bi"))
        if len(uni) != len(np.unique(h)):
            raise ValueError("the input gave other rows when it was read again")
        score = np.add.reduceat(logs(h, bounds, uni, bi, tokens_n, rare), bounds[:-1])
        head = table.select(["doc_id", "held_out"]).to_pandas()
        return pd.DataFrame({"doc_id": head["doc_id"], "held_out": head["held_out"], "n_tokens": n.astype(np.int64), "n_known": known, "train_tokens": np.full(len(head), tokens_n), "base_score": base - n * np.log10(float(tokens_n + types + 1)), "score": score})

    return run


def score_documents(docs: DataFrame, *, folds: int = 7, held_out: int = 2, filter_bytes: int | None = None) -> DataFrame:
    """Scores all texts by a model of those whose crc32(doc_id as text) modulo folds is not held_out."""
    docs = docs.select("doc_id", "text", (remainder(folds) == held_out).alias("held_out"))
    n = max(64, 4 * partitions(docs.sparkSession))
    model = train(docs.filter(~F.col("held_out")), n, filter_bytes=filter_bytes)
    of = model.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "rest_tokens", "rest_types"))).first()
    rare = (of["rest_tokens"] + 1) / (of["tokens"] + 1) / (of["rest_types"] + 1)
    # both readings number their blocks by the partition that they read
    docs = docs.withColumn("part", F.spark_partition_id())
    sent = docs.mapInArrow(_ask_blocks(n), "segment long, block long, keys binary, bi binary, train binary, texts binary, of binary, times binary")
    back = sent.groupBy("segment").cogroup(model.select("segment", "bits").groupBy("segment")).applyInPandas(_look_up, _ANSWER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = docs.mapInArrow(_heads, "block long, head binary")
    back = back.unionByName(heads, allowMissingColumns=True)
    return back.groupBy("block").applyInPandas(_gather(of["tokens"], of["types"], rare), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
