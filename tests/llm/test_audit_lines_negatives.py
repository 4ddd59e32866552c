"""Filter audit, line dedup and hard negatives against plain loops, with nulls, ties, copies, long texts and clashing names."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from roadspark.llm import _bytes, filter_audit, hard_negatives, line_dedup
from roadspark.llm.queries import op11_filter_audit, op12_line_dedup, op13_hard_negatives

SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéX") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = [prose(4) for _ in range(6)]
    out = []
    for i in range(60):
        lines = [prose(rng.randint(0, 12)) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 4)):
            c = rng.choice(common)
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([c, c.upper().replace("É", "é"), f"\t{c} \r", c + "."]))
        out.append((i, "\n".join(lines), rng.choice(["s0", "s0", "s1", None, ""])))
    out += [(60, None, "s0"), (61, "", None), (62, "\n\n", "s0"), (63, "a" * 30 + "\n" + "a" * 30, "s1"), (64, " " * 50, "s1"), (65, "123456789\n1234567890\nééééééééé\néééééééééé", "s0"), (66, "1234567890\n123456789\nÉéééééééé\néééééééééé ", "s0")]
    out += [(70 + i, out[3][1], f"s{i % 2}") for i in range(6)] + [(2, out[9][1], "s1"), out[5], out[5], (None, out[3][1], "s1"), (None, "alone in the text", None), (None, None, "s1")]
    out += [(90, prose(9000) + "\n" + common[0], "s2"), (91, "Word " * 300 + "# money", "s2"), (92, "word " * 300, "s2"), (93, " ".join(vocabulary[:250]).lower(), "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, part string, mask int").repartition(3)


def key(line):
    return line.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_filter_audit(spark, docs, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 95, 3)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (6, None, None), (999, 1, 1)]
    good = collections.defaultdict(int)
    bad = collections.defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            good[i], bad[i] = max(good[i], int(q == 1)), max(bad[i], int(t == 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    cells = collections.defaultdict(lambda: [0, 0, 0])
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split(f"[{SPACE}]+", t) if x]
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t) is not None, i is not None and i > least[t])
        c = cells[s or "", fails]
        c[0] += 1
        c[1] += good[i] if i is not None else 0
        c[2] += bad[i] if i is not None else 0
    assert len({f for _, f in cells}) > 6
    want = {}
    for part in {p for p, _ in cells}:
        removed_by = collections.Counter()
        for order in itertools.permutations(range(5)):
            for step, f in enumerate(order):
                here = [(c, any(m[g] for g in order[:step]), m) for (p, m), c in cells.items() if p == part]
                name = "".join("ABCDE"[g] for g in order)
                gone = [c for c, early, m in here if m[f] and not early]
                removed_by[f] += sum(c[0] for c in gone)
                want[part, name, step + 1] = [sum(c[0] for c, early, m in here if not m[f] and not early), sum(c[0] for c in gone), sum(c[0] for c, early, m in here if m[f] and early), sum(c[0] for c, _, m in here if sum(m) == 1 and m[f]), sum(c[1] for c in gone), sum(c[2] for c in gone), f]
        for k, v in want.items():
            if k[0] == part:
                v[6] = removed_by[v[6]]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want and len(got) == len(want)
    masks = {(r.doc_id, r.part): r.mask for r in filter_audit.failed(docs).collect()}
    assert masks == {(r.doc_id, r.part): r.mask for r in filter_audit.failed(docs, long_bytes=50).collect()}  # by chunks
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_with_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(_bytes, "hash_words", lambda buf, start, end: np.zeros(len(start), np.uint64))
    texts = ["a b a", "a b", "", "x", "ab cd ab cd", "q qq qqq q"]
    raw, offsets = _bytes.strings(pa.array(texts))
    start, end, bounds = _bytes.words(raw, offsets, _bytes.TOKEN)
    assert filter_audit.distinct_words(raw, start, end, bounds).tolist() == [len(set(t.split())) for t in texts]


def test_line_dedup(docs, rows, spark):
    of = collections.defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                of[key(line)].add(math.inf if i is None else i)
    want = collections.Counter()
    for i, t, _ in rows:
        own = math.inf if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(of[key(x)]) < 2 or min(of[key(x)]) == own]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert sum(n for (_, _, d, _), n in want.items() if d) > 20
    for size in (line_dedup.FILTER_BYTES, 16):  # 16: a filter so full that all lines are suspected
        got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs, filter_bytes=size).collect())
        assert got == want, size
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_the_second_filter_holds_repeats_and_little_else(spark):
    """Keys of two documents are all suspected, those of one hardly ever."""
    rng = random.Random(1)
    lines = [f"line {rng.random()} of its own" for _ in range(6000)]
    twice = lines[:500]
    texts = ["\n".join(lines[i::40]) for i in range(40)] + ["\n".join(twice[i::10]) for i in range(10)]
    field = line_dedup.repeated_filter(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 16)
    (_, _, h, *_), = line_dedup.key_hashes(pa.array(["\n".join(lines)]))
    found = line_dedup.suspected(field, h)
    assert found[:500].all() and found[500:].mean() < 0.02


def score(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


def brute(rows):
    seen = {}
    for i, e, y in rows:
        if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            y = int(math.fmod(y + 1, 10)) if i % 7 == 0 else y
            seen[i, y, tuple(x + 0.0 for x in e)] = True
    out = collections.Counter()
    for i, y, a in seen:
        if i % 100:
            continue
        others = sorted(((-score(a, b), j, z) for j, z, b in seen if j != i and len(a) == len(b)))
        for p, j, _ in [x for x in others if x[2] == y][:5]:
            for rank, (n, m, _) in enumerate([x for x in others if x[2] != y and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]):
                out[i, j, rank + 1, m, -p, -n] += 1
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(i, e, y, "x", 2.0) for i, e, y in rows], "vec_id long, embedding array<double>, label int, id string, score double").repartition(3)
    return collections.Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df).collect())


@pytest.mark.parametrize("blocks", [(8192, 256, 10), (37, 2, 3)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, value in zip(("VECTORS", "ANCHORS", "DIGIT"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 6))
    v[50:90] = v[0] * 0.5  # ties over blocks
    v[200:330] = v[100]
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(500)]
    rows += [(600, None, 1), (None, [1.0] * 6, 1), (601, [1.0] * 6, None), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (603, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1), (604, [math.inf] * 6, 1)]
    rows += [(700, [], 1), (701, [], 1), (702, [], 2), (703, [1.0, 2.0], 1), (800, [0.0] * 6, 1), (-100, [0.1] * 6, 9), (-7, [0.1] * 6, -3), rows[100], rows[101], (100, [0.3] * 6, 2), (101, [0.2] * 6, 0)]
    want = brute(rows)
    assert len(want) > 200 and mined(spark, rows) == want


def test_hard_negatives_of_large_components(spark):
    rows = [(i, [float((i * 37 % 11) * 10.0**6), 3.0 * 10**6], i % 2) for i in range(101)]
    assert mined(spark, rows) == brute(rows)
    wide = [(100, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e-290, 5 * 10.0**13], 2), (3, [-1e300, 0.0], 2)]
    assert hard_negatives.products(hard_negatives.components(np.array([1e300, 0.5])).reshape(1, 2), np.array([[1, 2]])).tolist() == [[hard_negatives.LIMIT]]
    assert mined(spark, wide) == {(100, 1, 1, 2, hard_negatives.LIMIT, 256 * 256 * 5 * 10**13): 1}


def test_hard_negatives_of_nothing(spark):
    assert not mined(spark, []) and not mined(spark, [(1, [1.0], 1)]) and not mined(spark, [(100, [1.0], 1)]) and not mined(spark, [(100, [1.0], 1), (101, [1.0], 1)])


def test_queries_have_their_columns(spark):
    d = "/root/testdata/sf0.001"
    assert op11_filter_audit(spark, d).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert op12_line_dedup(spark, d).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert op13_hard_negatives(spark, d).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
