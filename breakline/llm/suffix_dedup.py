"""Suffix-array dedup: bytes of passages that a document with a smaller doc_id holds too are removed.

Which windows are equal is decided by bucket-pointer refinement, in each batch and among the stretches that batches
share: suffixes are put into buckets by their first eight bytes; buckets are refined by sorting on the bucket identifiers
of later offsets, the new identifiers are written back, and the next refinement, twice as deep, reads those. The suffix
array is sparse: suffixes at anchors, and backwards from anchors, are sorted, since every window has its anchor inside.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import CHUNK, KEY_BITS, M1, Batch, distinct, grams_at, mixed, remove_repeats

LENGTH = 50
GRAM = 24
Q = 8


class Bytes(Batch):
    def __init__(self, ids: list[int], texts: list[bytes]):
        self.data = b"".join(texts) + bytes(64)
        starts = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        n = int(starts[-1])
        self.grams = grams_at(self.data, n + 40)
        order = np.empty(n, np.uint32)
        for a in range(0, n, CHUNK):
            order[a : a + CHUNK] = mixed(self.grams[a : min(n, a + CHUNK)] * M1) >> np.uint64(32)
        order |= np.uint32(1)
        super().__init__(ids, starts, order)

    def key(self, at: np.ndarray) -> np.ndarray:
        g = self.grams
        return mixed(mixed(mixed(g[at] + M1) + g[at + 8]) + g[at + 16]) & KEY_BITS

    def content(self, a: int, b: int) -> bytes:
        return self.data[a:b]

    symbols = len
    merged = False

    def kept(self, t: int, gone: np.ndarray) -> bytes:
        a, b = int(self.starts[t]), int(self.starts[t + 1])
        return np.frombuffer(self.data, np.uint8)[a:b][~gone].tobytes() if gone.any() else self.data[a:b]


class BucketPointers:
    """Bucket identifiers of positions in a text: equal for positions that agree over the depth they are refined to,
    ordered as their suffixes. Suffixes are sorted from the positions that are asked for."""

    def __init__(self, data: np.ndarray, reach: int):
        self.data = np.r_[data, np.zeros(reach + Q, np.uint8)]
        self.pointer = np.zeros(len(data) + reach, np.int64)

    def refine(self, at: np.ndarray, length: int) -> np.ndarray:
        """Sort the distinct positions ``at`` by their ``length`` first bytes; their pointers are written back.

        Up to Q bytes make the initial buckets. Deeper ones come from buckets of half the depth, refined before at
        these positions and at the later offset, by sorting on both identifiers.
        """
        if length <= Q:
            grams = np.ndarray((len(self.data) - Q + 1,), ">u8", self.data, strides=(1,))[at].astype(np.uint64)
            key = grams >> np.uint64(8 * (Q - length))
        else:
            depth = Q
            while 2 * depth < length:
                depth *= 2
            self.refine(distinct(np.r_[at, at + length - depth]), depth)
            key = self.pointer[at] << 32 | self.pointer[at + length - depth]
        order = np.argsort(key)
        key = key[order]
        self.pointer[at[order]] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(at)), 0))
        return at[order]


def shared_depths(data: np.ndarray, at: np.ndarray, depths: range) -> dict[int, np.ndarray]:
    """For each depth and position: the first suffix that agrees with this one over that many bytes, as a slot of the
    suffix array."""
    length = depths[-1]
    found = BucketPointers(data, length)
    order = found.refine(at, length)
    rows = found.data[order[:, None] + np.arange(length)]
    differs = rows[1:] != rows[:-1]
    same = np.r_[0, np.where(differs.any(1), differs.argmax(1), length)]  # longest common prefix with the suffix before
    back = np.argsort(order)  # ``at`` ascends
    slots = np.arange(len(at))
    return {d: np.maximum.accumulate(np.where(same < d, slots, 0))[back] for d in depths}


def window_classes(contents: list[bytes], anchors: np.ndarray, copies: np.ndarray | None = None, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of the contents, one after another: a number that equal windows share, -1 where it stands alone.
    A content is sorted once, however many copies there are; where there are several, no window stands alone.

    Each content has its anchor in all of its windows. So the suffixes at anchors are sorted, and those of the reversed
    text: windows are equal if as many bytes stand before their anchors and both intervals, of that many bytes before
    and of the rest from the anchor on, are the same.
    """
    if not contents:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    at = np.cumsum(sizes) - sizes + anchors
    after = shared_depths(data, at, range(gram, length + 1))
    before = {d: slots[::-1] for d, slots in shared_depths(data[::-1], (len(data) - at)[::-1], range(length - gram + 1)).items()}
    many = sizes - length + 1
    first = np.cumsum(many) - many
    classes, used = np.full(int(many.sum()), -1, np.int64), 0
    for r in range(length - gram + 1):  # bytes of the window before the anchor
        own = np.flatnonzero((anchors >= r) & (anchors - r < many))
        pair = before[r][own] << 32 | after[length - r][own]
        _, name = np.unique(pair, return_inverse=True)
        count = np.bincount(name, None if copies is None else copies[own])
        classes[first[own] + anchors[own] - r] = np.where(count[name] > 1, used + name, -1)
        used += len(count)
    return classes


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, starts, ends (removed runs of bytes), kept (the rest).

    Texts are UTF-8 bytes, null is empty. A byte goes when a 50-byte string over it also starts in a row with a smaller
    doc_id (null: larger than all); strings are judged on the input. Rows that repeat a doc_id do not remove each other.
    """
    return remove_repeats(docs, LENGTH, GRAM, Bytes, window_classes, same_text=False).withColumnRenamed("n_symbols", "n_bytes")


def removed(starts: str = "starts", ends: str = "ends"):
    return F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed().alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_OVER = "OVER (PARTITION BY doc_id ORDER BY i)"
SQL = {
    # windows of 2, 4, ... 32 bytes by doubling; two of 32 that overlap make one of 50
    "op1_suffix_dedup": f"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        h AS (SELECT doc_id, regexp_extract_all(hex(b), '..') AS hs FROM d),
        x1 AS (SELECT doc_id, unnest(hs) AS byte, generate_subscripts(hs, 1) AS i FROM h),
        x2 AS (SELECT doc_id, i, byte, byte || lead(byte) {_OVER} AS x FROM x1),
        x4 AS (SELECT doc_id, i, byte, x || lead(x, 2) {_OVER} AS x FROM x2),
        x8 AS (SELECT doc_id, i, byte, x || lead(x, 4) {_OVER} AS x FROM x4),
        x16 AS (SELECT doc_id, i, byte, x || lead(x, 8) {_OVER} AS x FROM x8),
        x32 AS (SELECT doc_id, i, byte, x || lead(x, 16) {_OVER} AS x FROM x16),
        x50 AS (SELECT doc_id, i, byte, x || lead(x, {LENGTH - 32}) {_OVER} AS x FROM x32),
        g AS (SELECT doc_id, i, byte, (x IS NOT NULL AND min(doc_id) OVER (PARTITION BY x) < doc_id)::INTEGER AS again FROM x50),
        c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM g),
        s AS (SELECT doc_id, i, byte, gone, gone = 1 AND coalesce(lag(gone) {_OVER}, 0) = 0 AS new FROM c),
        k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (new) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY doc_id)
        SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
