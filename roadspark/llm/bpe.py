"""Byte-level BPE encoding and decoding (contiguous rank arrays).

A text is cut at the special tokens and then by the vocabulary's pattern.  Each piece is merged on two
contiguous arrays, its parts and the ranks of adjacent parts: the least rank is looked for by a scan, the
boundary there is deleted, and the two neighbouring ranks are refreshed.  The new pieces of a batch stand as rows
of one pair of arrays, so that each step is one array operation for all of them.  Pieces beyond SHORT bytes, for
which repeated scans would cost the square of the length, take the same merges in the same order from a heap.

Pieces of texts that need no pattern are told apart by 64-bit hashes (BLAKE2b from 128 characters on), in one batch
and in a worker's memory of pieces; two pieces with one hash would share their ids.

Defined cases: null and empty texts have no tokens; a text of any length is encoded whole, some 60 bytes a character
at once; repeated rows and repeated ids are encoded row by row; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from roadspark.llm import _bytes
from roadspark.llm._spark import only

SHORT = 64
#: Pieces kept with their ids in a worker; beyond that the memory is emptied.
REMEMBERED = 400_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = (1 << 31) - 1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the others from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Where a piece may begin with an apostrophe and letters; texts without it need no pattern.
APOSTROPHE = regex.compile("'(?:s|t|re|ve|m|ll|d)").search
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class that the pattern sees in each character."""
    every = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        out[[ord(c) for run in regex.findall(name, every) for c in run]] = kind
    return out


@lru_cache(maxsize=1)
def character_codes() -> np.ndarray:
    return _bytes.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cuts(chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin: runs of one class; of white space before something else the last character stands
    apart, and belongs to what follows if it is a space."""
    kind = character_classes()[chars]
    edge = np.zeros(len(chars) + 1, bool)
    text_starts = text_starts[text_starts < len(chars)]
    edge[text_starts] = True
    fresh = edge[:-1].copy()
    edge[1:-1] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~fresh[1:])
    edge[last] = True
    edge[last[chars[last] == 0x20] + 1] = False
    return np.flatnonzero(edge[:-1])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range behind the other."""
    start, size = start[size > 0], size[size > 0]
    step = np.ones(int(size.sum()), np.int64)
    if len(step):
        step[0] = start[0]
        step[np.cumsum(size)[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(step)


class ByteBPE(dict):
    """An encoder over a vocabulary file; itself the memory of pieces met, each (or its 64-bit hash) with its ids
    as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.table[i] = raw[t]
        for t, i in self.special.items():
            self.table[i] = t.encode()
        self.single = np.zeros(256, np.int32)
        for t, i in vocab.items():
            if len(raw[t]) == 1:
                self.single[raw[t][0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges] or [0], np.int32)
        self.pairs = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self._index(np.array(list(self.pairs) or [(0, 0)], np.int64), np.array(list(self.pairs.values()) or [_NONE], np.int32))
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        length = np.array([len(b) for b in self.table], np.int64)
        self.start, self.length = np.concatenate(([0], np.cumsum(length)[:-1])), length
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)

    def _index(self, pairs: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs' ranks, a quarter full at most."""
        self.bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        left = pairs[:, 0] << 32 | pairs[:, 1]
        at = self._slot(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]  # of several for a slot the last stays
            mine = self.keys[at] == left
            self.ranks[at[mine]] = ranks[mine]
            left, at, ranks = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1), ranks[~mine]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of adjacent parts; _NONE where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        out = self.ranks[at]
        go = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        out[self.keys[at] != key] = _NONE
        while len(go):
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[go]]
            hit = found == key[go]
            out[go[hit]] = self.ranks[at[go[hit]]]
            go = go[~hit & (found >= 0)]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Merges pieces and remembers their ids."""
        self.update(zip(pieces, self.learned(pieces)))

    def learned(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces."""
        out = [b""] * len(pieces)
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw])
        low = 0
        for high in (8, 16, 32, SHORT):
            at = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                for i, ids in zip(part.tolist(), self.merge([raw[i] for i in part.tolist()], high)):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = np.array(self.merge_long(self.single[np.frombuffer(raw[i], np.uint8)].tolist()), "<u4").tobytes()
        return out

    def merge(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of width bytes at most, one word a row."""
        n, cols = len(words), np.arange(width)
        size = np.array([len(w) for w in words])
        ids = np.zeros((n, width + 1), np.int32)
        inside = cols < size[:, None]
        ids[:, :width][inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width), _NONE, np.int32)
        both = cols + 1 < size[:, None]
        ranks[both] = self.rank(ids[:, :width][both], ids[:, 1:][both])
        done = np.zeros((n, width), "<u4")
        row, count = np.arange(n), size.copy()
        while len(row):
            here = np.arange(len(row))
            m = ranks.argmin(1)
            least = ranks[here, m]
            over = least == _NONE
            if over.any():
                done[row[over]] = ids[over, :width]
                keep = ~over
                row, ids, ranks, m, least, here = row[keep], ids[keep], ranks[keep], m[keep], least[keep], np.arange(int(keep.sum()))
                if not len(row):
                    break
            ids[here, m] = self.made[least]
            gone = cols >= m[:, None]  # the boundary behind part m: what stands after it moves up
            ids[:, 1:width] = np.where(gone[:, : width - 1], ids[:, 2 : width + 1], ids[:, 1:width])
            ranks[:, : width - 1] = np.where(gone[:, : width - 1], ranks[:, 1:], ranks[:, : width - 1])
            ranks[:, width - 1] = _NONE
            count[row] -= 1
            k = np.flatnonzero(m > 0)
            ranks[k, m[k] - 1] = self.rank(ids[k, m[k] - 1], ids[k, m[k]])
            right = m + 1 < count[row]
            k = np.flatnonzero(right)
            ranks[k, m[k]] = self.rank(ids[k, m[k]], ids[k, m[k] + 1])
            k = np.flatnonzero(~right)
            ranks[k, m[k]] = _NONE
        flat, w = done.tobytes(), 4 * width
        return [flat[i * w : i * w + 4 * c] for i, c in enumerate(count.tolist())]

    def merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := pairs.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return [x for x, ok in zip(ids, alive) if ok]

    def cut_up(self, text: str) -> list[str]:
        """A text's pieces by the pattern, special tokens as pieces of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        return [x for p in self.cut.split(text) for x in ([p] if p in self.special else self.find(p))]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts.  Texts with apostrophes before letters or with special tokens are cut by the
        pattern itself, the others by their characters' classes, all at once."""
        plain = [i for i, t in enumerate(texts) if not self.odd(t)]
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for i, ids in zip(plain, self.encode_plain([texts[i] for i in plain])):
            out[i] = ids
        for i in {*range(len(texts))} - {*plain}:
            pieces = self.cut_up(texts[i])
            self.room(len(pieces))
            self.learn([p for p in {*pieces}.difference(self) if p not in self.special])
            for s in self.special.keys() & {*pieces}:
                self[s] = self.special[s].to_bytes(4, "little")
            out[i] = np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u4")
        return out

    def odd(self, text: str) -> bool:
        return "'" in text and APOSTROPHE(text) is not None or any(s in text for s in self.special)

    def room(self, n: int) -> None:
        if len(self) + n > REMEMBERED:
            self.clear()

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, "<u4")] * len(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        starts = cuts(chars, np.concatenate(([0], ends[:-1])))
        stops = np.append(starts[1:], len(chars))
        codes = character_codes()
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(codes[chars] * _bytes.powers(len(chars))[0][: len(chars)], out=sums[1:])
        keys, first, which = np.unique(_bytes.hash_spans(sums, starts, stops, chars), return_index=True, return_inverse=True)
        self.room(len(keys))
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in self]
        if new:
            at = first[new]
            pieces = [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())]
            found = self.learned(pieces)
            for i, ids in zip(new, found):
                self[listed[i]] = ids
        got = [self[k] for k in listed]
        size = np.array([len(g) // 4 for g in got])
        pool, begin = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
        total = np.concatenate(([0], np.cumsum(size[which])))
        ids = pool[spread(begin[which], size[which])]
        bound = total[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.bytes[spread(self.start[ids], self.length[ids])].tobytes().decode("utf-8", "replace")


_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One encoder for each vocabulary file in a process."""
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, *, digests: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row; with digests the ids' and the text's SHA-256 and n_tokens instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i, j in _bytes.pieces(_bytes.strings(batch.column("text"))[1], 1 << 20):
                part = batch.slice(i, j - i)
                rows = []
                for ids in bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                    back = bpe.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) if digests else (len(ids), ids.astype(np.int32), back))
                n, a, b = zip(*rows)
                kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip((n, a, b), kinds))], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))
