"""Removal of repeated byte strings by sampled suffix sorting (deep-shallow).

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too.  Sorting every suffix of a corpus
would ship each one's LENGTH bytes; instead every window of LENGTH bytes names its anchor, the leftmost least hash
of its K-grams, so equal windows have equal anchors at equal offsets, and a run of windows with one anchor is one
segment of text.

1. Each block of texts sends, to owners by hash, its distinct segments' hashes and its distinct anchors (with the
   least and the greatest hash of the anchor's segments).  Owners reply which segments occur twice or more, all of
   whose windows are repeated, and which anchors have segments that differ.  A block names a thing once, so the
   group of a very common string has a row a block, not one an occurrence.
2. Of anchors with differing segments each block sends one text a segment to the anchor's owner, which sorts the
   suffixes that begin at the anchor, and the mirrored prefixes that end there: multikey quicksort to SHALLOW bytes,
   then a blind trie for each group that is still together.  The common lengths of neighbours tell which windows
   of which segments are equal.  Of an anchor with more than HOT segments windows' hashes are counted instead, by
   their own owners, so that no task gathers them.
3. Each block marks its bytes.

Texts meet their blocks in one exchange by a hash of id and text, which all steps share.

What the sort decides, plainly: no suffix order of the whole corpus is made.  Segments that are equal as a whole
(copies, and the inner parts of long repeats) are found by counts of their hashes; two unlike segments of an anchor are
compared directly; and anchors with more than HOT unlike segments go by counts of their windows' hashes.  The deep-
shallow sort orders the segments of the anchors in between, those of 3 to HOT unlike ones, which are the edges of
repeats.  The result is the same by every way, but for collisions of 64-bit hashes.

A block holds its texts with some 80 bytes a byte of the piece (256 kB, or one longer text) that it works on.

Defined cases: an empty table gives no rows; a null text is empty; texts of under LENGTH bytes stay whole; repeated rows and copies of a text
repeat all their strings, so rows of LENGTH bytes or more lose all bytes; a null doc_id is kept; other columns are
passed through only if named.  Segments and windows are told apart by 64-bit hashes beside their anchors'.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm import _bytes
from roadspark.llm._spark import partitions
from roadspark.llm.lm import segment_of

LENGTH = 200
K = 24
SHALLOW = 16
HOT = 1_000
U64 = np.uint64

# ---------------------------------------------------------------- deep-shallow sorting


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("depth", "next", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.next, self.leaf = depth, {}, leaf


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """The group's strings in order.  Only branching bytes are stored; a string goes down blindly, is compared once
    with the leaf that it meets, and then finds its place by the common length.  Equal strings stay together."""
    root, same = None, {}
    for i in group:
        s = strings[i]
        if root is None:
            root = _Node(len(s), i)
            continue
        at = root
        while at.next:
            at = at.next.get(s[at.depth] if at.depth < len(s) else -1) or next(iter(at.next.values()))
        n = common(s, strings[at.leaf])
        if n == len(s) == len(strings[at.leaf]):
            same.setdefault(at.leaf, []).append(i)
            continue
        above, at = None, root
        while at.next and at.depth < n:
            above, at = at, at.next[s[at.depth] if at.depth < len(s) else -1]
        if at.next and at.depth == n:
            at.next[s[n] if n < len(s) else -1] = _Node(len(s), i)
            continue
        fork, other = _Node(n, -1), strings[_leaf(at)]
        fork.next = {other[n] if n < len(other) else -1: at, s[n] if n < len(s) else -1: _Node(len(s), i)}
        if above is None:
            root = fork
        else:
            above.next[s[above.depth] if above.depth < len(s) else -1] = fork
    out, stack = [], [root] if root else []
    while stack:
        at = stack.pop()
        if at.next:
            stack.extend(at.next[c] for c in sorted(at.next, reverse=True))
        else:
            out += [at.leaf, *same.get(at.leaf, ())]
    return out


def _leaf(node: _Node) -> int:
    while node.next:
        node = next(iter(node.next.values()))
    return node.leaf


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The strings' order, and the common length of each with the one before it (0 for the first)."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            order += group
        elif depth >= shallow:
            order += blind_trie(strings, group)
        elif depth < 0:  # strings that ended, all equal
            order += group
        else:
            middle = strings[group[len(group) // 2]]
            pivot = middle[depth] if depth < len(middle) else -1
            low, same, high = [], [], []
            for i in group:
                s = strings[i]
                c = s[depth] if depth < len(s) else -1
                (low if c < pivot else high if c > pivot else same).append(i)
            stack += [(high, depth), (same, depth + 1 if pivot >= 0 else -1), (low, depth)]
    return order, [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def repeated_windows(members: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For segments (text, anchor's place, number of windows) of one anchor, all different: which windows also
    stand in another segment."""
    left, right = [t[:a][::-1] for t, a, _ in members], [t[a:] for t, a, _ in members]
    m = len(members)
    if m == 2:
        l, r = common(*left), common(*right)
        return [(a - np.arange(n) <= l) & (length - a + np.arange(n) <= r) for _, a, n in members]
    order, lcp = deep_shallow(right)
    order_l, lcp_l = deep_shallow(left)
    order, order_l, lcp, lcp_l = (np.array(x) for x in (order, order_l, lcp, lcp_l))
    place, count = np.array([a for _, a, _ in members]), np.array([n for _, _, n in members])
    out = [np.zeros(n, bool) for n in count]
    top = int(place.max())
    step = max(1, (1 << 21) // m)
    for o in range(0, top + 1, step):
        offset = np.arange(o, min(top + 1, o + step))  # bytes of the window before the anchor
        cls, cls_l = np.empty((m, len(offset)), np.int64), np.empty((m, len(offset)), np.int64)
        cls[order] = np.cumsum(lcp[:, None] < length - offset, axis=0)
        cls_l[order_l] = np.cumsum(lcp_l[:, None] < offset, axis=0)
        start = place[:, None] - offset
        inside = (start >= 0) & (start < count[:, None])
        key = np.where(inside, cls * (m + 1) + cls_l, -1 - np.arange(m)[:, None])
        by = np.argsort(key, axis=0, kind="stable")
        key = np.take_along_axis(key, by, axis=0)
        same = np.zeros(key.shape, bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        hit = np.empty_like(same)
        np.put_along_axis(hit, by, same, axis=0)
        for i, j in zip(*np.nonzero(hit & inside)):
            out[i][start[i, j]] = True
    return out


# ---------------------------------------------------------------- anchors of a block


class Segments:
    """The segments of a piece of texts: first window, number of windows, anchor, hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int):
        n, w = len(buf), length - K + 1
        self.buf = buf
        e = np.zeros(0, np.int64)
        self.first = self.count = self.at = e
        self.anchor = self.hash = np.zeros(0, U64)
        good = np.flatnonzero(np.diff(offsets) >= length)
        if not len(good):
            return
        grams = np.arange(n - K + 1)
        sums = _bytes.prefix(buf)  # eight times the text, so not kept
        h = _bytes.hash_spans(sums, grams, grams + K)
        bits = U64(n.bit_length())
        packed = h >> bits << bits | grams.astype(U64)
        size = -(-len(packed) // w) * w
        rows = np.full(size, U64(2**64 - 1))
        rows[: len(packed)] = packed
        rows = rows.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - length + 1], ahead[w - 1 : w - 1 + n - length + 1])
        at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
        edge = np.zeros(n - length + 2, np.int8)
        edge[offsets[:-1][good]] += 1
        np.add.at(edge, offsets[1:][good] - length + 1, -1)
        valid = np.cumsum(edge[:-1]) > 0
        fresh = valid.copy()
        fresh[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        fresh[offsets[:-1][good]] = True
        self.first = np.flatnonzero(fresh)
        text_end = offsets[1:][np.searchsorted(offsets, self.first, side="right") - 1]
        stop = np.minimum(np.append(self.first[1:], n), text_end - length + 1)
        self.count = stop - self.first
        self.at = at[self.first]
        self.anchor = _bytes.mix(h[self.at] ^ U64(0x5851F42D4C957F2D))  # least hashes are all small; owners need even ones
        self.hash = _bytes.mix(_bytes.hash_spans(sums, self.first, stop + length - 1) + (self.at - self.first).astype(U64) * U64(0xD6E8FEB86659FD93))


def block_segments(column: pa.Array, length: int):
    raw, offsets = _bytes.strings(column)
    for i, j in _bytes.pieces(offsets):
        yield i, j, Segments(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)


class Names:
    """A block's distinct segments and anchors, sorted as their owners are."""

    def __init__(self, parts: list[Segments]):
        none = np.zeros(0, U64)
        anchor, seg = (np.concatenate([none, *(getattr(p, k) for p in parts)]) for k in ("anchor", "hash"))
        self.segs, first, n = np.unique(seg, return_index=True, return_counts=True)
        self.many = n > 1
        self.of = anchor[first]
        order = np.lexsort((self.segs, self.of))
        a, s = self.of[order], self.segs[order]
        self.anchors, start, self.each = np.unique(a, return_index=True, return_counts=True)
        self.low, self.high = s[start], s[start + self.each - 1] if len(s) else s


def _cut(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(segment_of(keys, n), np.arange(n + 1))


def _ask(n: int, length: int):
    """Step 1, a block's questions."""

    def run(key, table):
        x = Names([p for _, _, p in block_segments(table.column("text"), length)])
        rows = []
        for s, (a, b), (c, d) in zip(range(n), *(list(zip(e[:-1], e[1:])) for e in (_cut(x.segs, n), _cut(x.anchors, n)))):
            if a < b or c < d:
                rows.append((s, x.segs[a:b].tobytes(), np.packbits(x.many[a:b]).tobytes(), x.anchors[c:d].tobytes(), x.low[c:d].tobytes(), x.high[c:d].tobytes(), _bytes.pack(x.each[c:d])))
        cols = list(zip(*rows)) or [()] * 7
        return pa.table({"owner": pa.array(cols[0], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), **{k: pa.array(c, pa.binary()) for k, c in zip(("segs", "many", "anchors", "low", "high", "each"), cols[1:])}})

    return run


def _u64(column) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [np.frombuffer(b, "<u8") for b in column]
    return parts, np.concatenate(parts) if parts else np.zeros(0, U64)


def counted(column, flags) -> list[np.ndarray]:
    """For each block's distinct keys: whether a key occurs twice or more in all."""
    parts, keys = _u64(column)
    times = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(p)) for p, f in zip(parts, flags)]).astype(np.int64) + 1
    u, back = np.unique(keys, return_inverse=True)
    twice = np.bincount(back, weights=times, minlength=len(u)) > 1
    return np.split(twice[back], np.cumsum([len(p) for p in parts])[:-1])


def _answer(hot: int):
    def run(key, pdf):
        twice = counted(pdf["segs"], pdf["many"])
        parts, anchors = _u64(pdf["anchors"])
        u, back = np.unique(anchors, return_inverse=True)
        low, high = np.full(len(u), U64(2**64 - 1)), np.zeros(len(u), U64)
        np.minimum.at(low, back, _u64(pdf["low"])[1])
        np.maximum.at(high, back, _u64(pdf["high"])[1])
        each = np.bincount(back, weights=np.concatenate([_bytes.unpack(b) for b in pdf["each"]]), minlength=len(u))
        state = np.where(low == high, 0, np.where(each > hot, 2, 1)).astype(np.uint8)[back]
        cut = np.split(state, np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"block": pdf["block"], "kind": 0, "owner": key[0], "a": [np.packbits(t).tobytes() for t in twice], "na": [len(t) for t in twice], "b": [c.tobytes() for c in cut]})

    return run


REPLY = "block long, kind int, owner int, a binary, na int, b binary"


class Replies:
    """What a block has been told, put together in its own order."""

    def __init__(self, replies: pd.DataFrame, names: Names):
        first = replies[replies["kind"] == 0].sort_values("owner")
        self.twice = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for a, n in zip(first["a"], first["na"]))])
        state = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(b, np.uint8) for b in first["b"])])
        of = state[np.searchsorted(names.anchors, names.of)] if len(names.of) else np.zeros(0, np.uint8)
        # texts to compare, in the order of (anchor, segment); windows to count are those of segments that occur once
        self.compare = np.flatnonzero(of == 1)
        self.compare = self.compare[np.lexsort((names.segs[self.compare], names.of[self.compare]))]
        self.hot = np.flatnonzero(of == 2)


def _found(parts: list[Segments], names: Names, wanted: np.ndarray):
    """Where each wanted segment (a place in names.segs) stands first: (part, row)."""
    seg = np.concatenate([p.hash for p in parts])
    part = np.repeat(np.arange(len(parts)), [len(p.hash) for p in parts])
    row = np.concatenate([np.arange(len(p.hash)) for p in parts])
    order = np.argsort(seg, kind="stable")
    at = order[np.searchsorted(seg[order], names.segs[wanted])]
    return part[at], row[at]


def _hot_windows(parts: list[Segments], names: Names, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows of hot anchors' segments, each segment once, in order; and each segment's number of them."""
    if not len(hot):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out: list = [None] * len(hot)
    part, row = _found(parts, names, hot)
    for p in np.unique(part):
        sums = _bytes.prefix(parts[p].buf)
        for i in np.flatnonzero(part == p):
            s = np.arange(parts[p].first[row[i]], parts[p].first[row[i]] + parts[p].count[row[i]])
            out[i] = _bytes.hash_spans(sums, s, s + length)
    return np.concatenate(out), np.array([len(x) for x in out])


def _send(n: int, length: int):
    """Step 2, a block's texts and windows."""
    kinds = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("segs", pa.binary()), ("many", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])

    def run(key, table, replies):
        parts = [p for _, _, p in block_segments(table.column("text"), length)] if table.num_rows else []
        rows = []
        if parts:
            names = Names(parts)
            told = Replies(replies.to_pandas(), names)
            if len(told.compare):
                a = names.of[told.compare]
                p, r = _found(parts, names, told.compare)
                for s, (i, j) in enumerate(zip(*(lambda e: (e[:-1], e[1:]))(_cut(a, n)))):
                    if i < j:
                        texts = [parts[x].buf[parts[x].first[y] : parts[x].first[y] + parts[x].count[y] + length - 1].tobytes() for x, y in zip(p[i:j], r[i:j])]
                        sizes = np.array([[parts[x].count[y], parts[x].at[y] - parts[x].first[y]] for x, y in zip(p[i:j], r[i:j])], "<u4")
                        rows.append((s, key[0].as_py(), 1, a[i:j].tobytes(), names.segs[told.compare[i:j]].tobytes(), None, sizes.tobytes(), b"".join(texts)))
            windows, count = _hot_windows(parts, names, told.hot, length)
            if len(windows):
                u, back, times = np.unique(windows, return_inverse=True, return_counts=True)
                many = np.bincount(back, weights=np.repeat(names.many[told.hot], count), minlength=len(u)) + times > 1
                for s, (i, j) in enumerate(zip(*(lambda e: (e[:-1], e[1:]))(_cut(u, n)))):
                    if i < j:
                        rows.append((s, key[0].as_py(), 2, u[i:j].tobytes(), None, np.packbits(many[i:j]).tobytes(), None, None))
        cols = list(zip(*rows)) or [()] * 8
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    return run


def _compare(length: int):
    def run(key, pdf):
        out = []
        counts = pdf[pdf["kind"] == 2]
        if len(counts):
            for b, t in zip(counts["block"], counted(counts["keys"], counts["many"])):
                out.append((b, 2, key[0], np.packbits(t).tobytes(), len(t), None))
        rows = pdf[pdf["kind"] == 1]
        if len(rows):
            anchors, segs = _u64(rows["keys"])[1], _u64(rows["segs"])[1]
            sizes = np.concatenate([np.frombuffer(b, "<u4").reshape(-1, 2) for b in rows["sizes"]]).astype(np.int64)
            text = b"".join(rows["text"])
            end = np.cumsum(sizes[:, 0] + length - 1)
            start = end - sizes[:, 0] - length + 1
            order = np.lexsort((segs, anchors))
            bits: list = [None] * len(order)
            lone = np.flatnonzero(np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])))
            for a, b in zip(lone, np.append(lone[1:], len(order))):
                group = order[a:b]
                fresh = np.concatenate(([True], segs[group][1:] != segs[group][:-1]))
                heads = group[fresh]
                if len(heads) == 1:
                    found = [np.zeros(sizes[heads[0], 0], bool)]
                else:
                    found = repeated_windows([(text[start[i] : end[i]], int(sizes[i, 1]), int(sizes[i, 0])) for i in heads], length)
                for i, f in zip(group, np.cumsum(fresh) - 1):
                    bits[i] = found[f]
            at = 0
            for b, k in zip(rows["block"], rows["keys"]):
                own = np.concatenate(bits[at : at + len(k) // 8])
                out.append((b, 1, key[0], np.packbits(own).tobytes(), len(own), None))
                at += len(k) // 8
        return pd.DataFrame(out, columns=["block", "kind", "owner", "a", "na", "b"])

    return run


def _mark(length: int, columns: list[str], form: str, schema: pa.Schema):
    """Step 3: the bytes that stay."""

    def bits(replies: pd.DataFrame, kind: int) -> np.ndarray:
        rows = replies[replies["kind"] == kind].sort_values("owner")
        return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for a, n in zip(rows["a"], rows["na"]))])

    def run(key, table, replies):
        if not table.num_rows:
            return schema.empty_table()
        table = table.combine_chunks()
        pieces = list(block_segments(table.column("text"), length))
        parts = [p for _, _, p in pieces]
        names, replies = Names(parts), replies.to_pandas()
        told = Replies(replies, names)
        # windows of each distinct segment: all, some, none
        some: dict[int, np.ndarray] = {}
        if len(told.compare):
            p, r = _found(parts, names, told.compare)
            count = np.array([parts[x].count[y] for x, y in zip(p, r)])
            some.update(zip(told.compare.tolist(), np.split(bits(replies, 1), np.cumsum(count)[:-1])))
        windows, count = _hot_windows(parts, names, told.hot, length)
        if len(windows):
            u, back = np.unique(windows, return_inverse=True)
            some.update(zip(told.hot.tolist(), np.split(bits(replies, 2)[back], np.cumsum(count)[:-1])))
        raw, offsets = _bytes.strings(table.column("text"))
        n_bytes, removed, spans, kept = [], [], [], []
        for i, j, p in pieces:
            start = np.zeros(len(p.buf), bool)
            if len(p.hash):
                at = np.searchsorted(names.segs, p.hash)
                whole = told.twice[at]
                delta = np.zeros(len(p.buf) + 1, np.int32)
                np.add.at(delta, p.first[whole], 1)
                np.add.at(delta, p.first[whole] + p.count[whole], -1)
                start = np.cumsum(delta[:-1]) > 0
                for k in np.flatnonzero(~whole):
                    if (b := some.get(int(at[k]))) is not None:
                        start[p.first[k] : p.first[k] + p.count[k]] |= b
            total = np.concatenate((np.zeros(length, np.int32), np.cumsum(start, dtype=np.int32)))
            gone = total[length:] > total[:-length]
            off = offsets[i : j + 1] - offsets[i]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            cut = off[1:-1][off[1:-1] < len(gone)]
            edge[cut] = gone[cut]
            lost, runs = (np.concatenate(([0], np.cumsum(x))) for x in (gone, edge))
            n_bytes += np.diff(off).tolist()
            removed += np.diff(lost[off]).tolist()
            spans += np.diff(runs[off]).tolist()
            stay, text = ~gone, p.buf
            for a, b, d in zip(off[:-1].tolist(), off[1:].tolist(), removed[-(j - i) :]):
                k = (text[a:b][stay[a:b]] if d else text[a:b]).tobytes()
                kept.append(hashlib.sha256(k).hexdigest() if form == "kept_sha256" else k.decode("utf-8", "ignore") if form == "text" else k)
        return pa.Table.from_arrays([*(table.column(c) for c in columns), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary() if form == "kept" else pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, columns: tuple[str, ...] = ("doc_id",), form: str = "kept", hot: int = HOT) -> DataFrame:
    """columns of docs with n_bytes, n_removed, n_spans and, by form, the bytes that stay (kept), their SHA-256
    (kept_sha256) or their text without the parts of characters that have lost others (text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    # small blocks for the memory of a task, and fewer owners: each block sends each owner a row at most
    blocks, n = 2 * partitions(docs.sparkSession), partitions(docs.sparkSession)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    texts = docs.select(block.alias("block"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    by = texts.groupBy("block")
    asked = by.applyInArrow(_ask(n, length), "owner int, block long, segs binary, many binary, anchors binary, low binary, high binary, each binary")
    first = asked.groupBy("owner").applyInPandas(_answer(hot), REPLY)
    sent = by.cogroup(first.groupBy("block")).applyInArrow(_send(n, length), "owner int, block long, kind int, keys binary, segs binary, many binary, sizes binary, text binary")
    second = sent.groupBy("owner").applyInPandas(_compare(length), REPLY)
    result = StructType([*(StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField(form, BinaryType() if form == "kept" else StringType())])
    own = [f"c{i}" for i in range(len(columns))]
    marked = by.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(_mark(length, own, form, to_arrow_schema(result)), result)
    return marked.select(*(F.col(o).alias(c) for o, c in zip(own, columns)), "n_bytes", "n_removed", "n_spans", form)
