"""Byte-level BPE encoding of whole corpora.

Two tiers. A minimal perfect hash over the vocabulary resolves, for a whole Arrow batch at once, every distinct
pre-token that is a vocabulary entry; the rest is merged with a heap over a doubly linked list of bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at once in a Python worker.
CHUNK_BYTES = 1 << 20
#: Misses remembered by a worker; when full the memory is emptied, never the work.
MEMO_ENTRIES = 200_000
#: Odd multipliers of the two polynomial hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Endings after an apostrophe that form a piece of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 0, 3
_BORDER = regex.compile(rb"(?<=[!-~])[ \n\t\r]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary bytes to id, from a rank file (base64, blank, id in each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for found in regex.finditer(pattern, every):
            a, b = ord(found[0][0]), ord(found[0][-1])
            classes[a : b + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_A, _B = _Powers(BASE_A), _Powers(BASE_B)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each byte span, from prefix sums of the whole buffer."""
    out = []
    lengths = (ends - starts).astype(np.uint64)
    for powers in (_A, _B):
        up, down = powers.of(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
        out.append(_mix((prefix[ends] - prefix[starts]) * down[starts] + lengths))
    return out[0], out[1]


def spans_equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of `a` are those of the span of `b` of the same length."""
    which = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    ends = np.cumsum(lengths)
    step = np.arange(len(which)) - np.repeat(ends - lengths, lengths)
    equal = np.ones(len(lengths), bool)
    equal[which[a[a_at[which] + step] != b[b_at[which] + step]]] = False
    return equal


class PerfectHash:
    """Minimal perfect hash (hash and displace) of a fixed set of byte strings, looked up in vectors.

    Every slot holds one key's second hash, length and bytes; only a string with the same bytes is a hit.
    """

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        blob = np.frombuffer(b"".join(keys), np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        starts = ends - np.array([len(k) for k in keys])
        one, two = span_hashes(blob, starts, ends)
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        bucket = one % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(n, bool)
        self.print = np.zeros(n, np.uint64)
        self.length = np.full(n, -1, np.int32)
        self.value = np.zeros(n, np.int32)
        self.blob, self.place = blob, np.zeros(n, np.int64)
        value, length = np.array(values, np.int32), (ends - starts).astype(np.int32)
        for b in np.argsort(-(cuts[1:] - cuts[:-1]), kind="stable"):
            members = order[cuts[b] : cuts[b + 1]]
            if not len(members):
                break
            found, tried = None, 0
            while found is None:
                shifts = np.arange(tried, tried + 64, dtype=np.uint64)
                slots = (_mix(one[members][None, :] + shifts[:, None] * np.uint64(BASE_B)) % np.uint64(n)).astype(np.int64)
                free = ~taken[slots].any(axis=1)
                for row in np.flatnonzero(free):
                    if len(np.unique(slots[row])) == len(members):
                        found = row
                        break
                tried += 64
            self.shift[b] = shifts[found]
            at = slots[found]
            taken[at] = True
            self.print[at], self.length[at], self.value[at], self.place[at] = two[members], length[members], value[members], starts[members]

    def lookup(self, one: np.ndarray, two: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Value of each span of `data`, given its hashes; -1 for strings outside the set."""
        shift = self.shift[(one % np.uint64(self.buckets)).astype(np.int64)]
        slot = (_mix(one + shift * np.uint64(BASE_B)) % np.uint64(self.n)).astype(np.int64)
        near = np.flatnonzero((self.print[slot] == two) & (self.length[slot] == lengths))
        near = near[spans_equal(data, starts[near], self.blob, self.place[slot[near]], lengths[near])]
        found = np.full(len(slot), -1, np.int32)
        found[near] = self.value[slot[near]]
        return found


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: a heap of mergeable neighbours over a doubly linked list of its bytes."""
    n = len(piece)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            rank = ranks.get(piece[i : end[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def piece_starts(codes: np.ndarray, doc_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Boolean mask of the code points that begin a pre-token.

    Letters, numbers and other signs form runs, each with one blank before it; of a run of white space
    before a text the last sign stands alone; an apostrophe with certain endings is a piece of its own.
    """
    n = len(codes)
    kind = classes[codes]
    first = np.zeros(n, bool)
    first[doc_starts[doc_starts < n]] = True
    last = np.zeros(n, bool)
    last[-1:] = True
    last[:-1] = first[1:]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (codes[:-1] == 32) & ~first[1:]
    start = change & ~(blank_before & ~space)
    before_text = np.zeros(n, bool)
    before_text[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= before_text
    start |= first
    quote = np.flatnonzero((codes == 39) & change & ~blank_before)
    if len(quote):
        quote = quote[~last[quote]]
        for ending in CONTRACTIONS:
            at = quote[quote + len(ending) < n]
            for k, letter in enumerate(ending, 1):
                at = at[(codes[at + k] == ord(letter)) & ~first[at + k]]
            stop = at + len(ending) + 1
            start[at + 1] = False
            start[stop[stop < n]] = True
    return start


class Encoder:
    """Encoder of one vocabulary; the perfect hash is built once on the driver and travels with it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        self.classes = character_classes()
        self.memo: dict[bytes, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        return cls(load_ranks(path))

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "hash": self.hash, "classes": self.classes, "memo": {}}

    def _miss(self, piece: bytes) -> list[int]:
        found = self.memo.get(piece)
        if found is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            found = self.memo[piece] = merge_bytes(piece, self.ranks)
        return found

    def encode_chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some UTF-8 texts in a row, and the number of ids of each text."""
        data = b"".join(texts)
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        byte_at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=text_at[1:])
        full = text_at[:-1][text_at[1:] > text_at[:-1]]
        starts = byte_at[np.flatnonzero(piece_starts(codes, np.searchsorted(byte_at, full), self.classes))]
        ends = np.append(starts[1:], len(data))
        raw = np.frombuffer(data, np.uint8)
        one, two = span_hashes(raw, starts, ends)
        _, example, piece = np.unique(one ^ (two << np.uint64(1)), return_index=True, return_inverse=True)
        example, piece = self._apart(data, raw, starts, ends, example, piece)
        lengths = (ends - starts)[example].astype(np.int32)
        ids = self.hash.lookup(one[example], two[example], raw, starts[example], lengths)
        counts = np.ones(len(example), np.int64)
        missing = np.flatnonzero(ids < 0)
        merged = [self._miss(data[starts[e] : ends[e]]) for e in example[missing]]
        counts[missing] = [len(m) for m in merged]
        offset = np.zeros(len(example) + 1, np.int64)
        np.cumsum(counts, out=offset[1:])
        flat = np.zeros(offset[-1], np.int32)
        hit = np.flatnonzero(ids >= 0)
        flat[offset[hit]] = ids[hit]
        for k, m in zip(missing, merged, strict=True):
            flat[offset[k] : offset[k + 1]] = m
        each = counts[piece]
        out_at = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(each, out=out_at[1:])
        out = flat[np.arange(out_at[-1]) - np.repeat(out_at[:-1] - offset[piece], each)]
        return out, np.diff(out_at[np.searchsorted(starts, text_at)])

    @staticmethod
    def _apart(data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, example: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of pre-tokens with equal hashes, with those of other bytes than their example's in groups of their own."""
        head, lengths = example[piece], ends - starts
        same = lengths[head] == lengths
        some = np.flatnonzero(same & (head != np.arange(len(head))))
        same[some] = spans_equal(raw, starts[some], raw, starts[head[some]], lengths[some])
        others: dict[bytes, int] = {}
        more: list[int] = []
        for k in np.flatnonzero(~same).tolist():
            text = data[starts[k] : ends[k]]
            if text not in others:
                others[text] = len(example) + len(more)
                more.append(k)
            piece[k] = others[text]
        return np.append(example, more).astype(np.int64), piece

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_chunk([text.encode()])[0].tolist()


def _split_long(text: bytes) -> Iterator[bytes]:
    """A long text cut where white space follows other signs: always a border between pre-tokens."""
    at = 0
    while len(text) - at > 2 * CHUNK_BYTES:
        found = _BORDER.search(text, at + CHUNK_BYTES)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_column(texts: pa.Array, encoder: Encoder) -> pa.Array:
    """Ids of each text of an Arrow string array; null and empty texts give an empty list."""
    parts: list[bytes] = []
    owner: list[int] = []
    for k, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        for part in _split_long(text) if text else ():
            parts.append(part)
            owner.append(k)
    ids: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    at, size = 0, 0
    for k in range(len(parts) + 1):
        if k == len(parts) or (size and size + len(parts[k]) > CHUNK_BYTES):
            if k > at:
                some, each = encoder.encode_chunk(parts[at:k])
                ids.append(some)
                np.add.at(counts, owner[at:k], each)
            at, size = k, 0
        if k < len(parts):
            size += len(parts[k])
    offsets = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def token_ids(documents: DataFrame, encoder: Encoder, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """One row per input row: `key` and the ids of `text`, without special tokens, of the text exactly as stored.

    Null and empty texts give an empty list; repeated rows and keys are kept; special-token strings in a text are
    ordinary text; other columns are not carried. A map over the scan: no shuffle, memory bounded by CHUNK_BYTES.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(encoder)
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            size = max(1, int(batch.num_rows * 4 * CHUNK_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), mine)], [key, ids])

    return documents.select(key, text).mapInArrow(encode, schema)
