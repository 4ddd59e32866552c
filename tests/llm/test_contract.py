"""The contract's sixteen shards, and the pipeline's stages on odd tables: empty, null, repeated, clashing, long, unlabelled."""

from __future__ import annotations

import collections
import random
import zlib

import pytest

import corpus_pipeline
from roadspark.llm.queries import op4_sharding

D = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, clash string"


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sixteen_shards_by_bytes(spark, d):
    rows = op4_sharding(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} == set(range(16)) and {r.grown_shard for r in rows} == {None}
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in rows)


def folder(spark, tmp_path, labels):
    """A folder with the given labels and the benchmark of a real one."""
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(5, 80)) for _ in range(20)] + [None, "", prose(20_000)]
    out = [(i, t, "en", "s", 0, 1.0, "x") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None), (77, texts[4], "de", "t", 9, None, "y")]


@pytest.mark.parametrize("labels", [[], [(10**9, 1, 1)], [(1, None, 0), (2, 1, 0)]])
def test_stages_on_odd_rows(spark, tmp_path, labels):
    """Without a label that tells of toxicity nothing is dropped for it; copies go, and all else stays."""
    d = folder(spark, tmp_path, labels)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name != "bpe":
            assert docs.columns == COLUMNS, name
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept.append(docs.count())
    assert kept[0] == len(rows())
    distinct = {r[1] or "" for r in rows()}
    assert kept[1] == kept[2] == kept[3] == kept[4] == len(distinct)


def test_stages_on_an_empty_table(spark, tmp_path):
    d = folder(spark, tmp_path, [(1, 1, 1)])
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else None
