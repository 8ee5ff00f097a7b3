"""Repeated passages of at least ``length`` symbols in all texts: routing, indexing and folding of candidates.

Every window of ``length`` symbols owns an anchor, the leftmost gram with the smallest hash inside it, so equal windows
own equal anchors wherever they stand. Anchors only say which windows must meet; which of them are equal is decided by
the index that the operator names (suffix buckets, FM-index). Rows are dealt to batches of a few megabytes by a hash of
doc_id and text, and five steps follow, each a Spark shuffle:

1. each batch names its distinct anchors (about one in fourteen positions);
2. by anchor, those of two or more batches are found;
3. each batch sends its stretches (runs of windows with one anchor) whose anchors are shared. Those whose anchor it holds
   twice are indexed, and of those that the index names alike it sends one; the others have no equal in the batch;
4. by anchor, the stretches of all batches are indexed together, each content once with the number of its copies; a
   batch is told which of its windows an earlier document of another batch holds;
5. each batch indexes what it may hold twice and removes what it was told and what it repeats itself.

A passage that a third of all documents share is one anchor, and one stretch, per batch: hot groups are folded before
each shuffle. An anchor of many batches is split by the symbols beside it, so a common phrase with ever new
surroundings is spread over many tasks. Nothing is capped and no window is skipped; hashes route, contents decide.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch.
BATCH_BYTES = 4_000_000
#: Batches that share an anchor before it is split by its surroundings.
HOT_BATCHES = 64
KEY_BITS = np.uint64(2**48 - 1)
LAST_ID = 2**63 - 1  # stands for a null doc_id
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


#: Positions worked on at once: what passes over them again and again should stay in a core's cache.
CHUNK = 1 << 16


def slide(x: np.ndarray, w: int, op, out: np.ndarray | None = None) -> np.ndarray:
    """op over every w neighbours, by doubling."""
    n = len(x) - w + 1
    out = np.empty(n, x.dtype) if out is None else out
    for a in range(0, n, CHUNK):
        m, s, k = x[a : a + CHUNK + w - 1], 1, min(CHUNK, n - a)
        while 2 * s <= w:
            m, s = op(m[:-s], m[s:]), 2 * s
        out[a : a + k] = op(m[:k], m[w - s : w - s + k])
    return out


def grams_at(buffer: bytes, n: int) -> np.ndarray:
    """The eight bytes from each position as an integer; ``buffer`` holds at least seven bytes more than n."""
    return np.ndarray((n,), "<u8", buffer, strides=(1,))


@dataclass
class Batch:
    """Texts in order of doc_id, laid end to end as symbols."""

    ids: list[int]
    starts: np.ndarray  # first symbol of each text, and the end
    order: np.ndarray  # uint32 > 0 per position: the smallest in a window is its anchor
    merged = False  # whether the index takes runs of windows of any length; else stretches with their anchors

    def key(self, at: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def content(self, a: int, b: int) -> bytes:
        raise NotImplementedError


class Anchors:
    """Each anchor of a batch with the run of windows that own it."""

    def __init__(self, batch: Batch, length: int, gram: int):
        self.batch, self.length, self.w = batch, length, length - gram + 1
        v, n, w = batch.order, len(batch.order), length - gram + 1
        self.at = self.first = self.last = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)
        if n < length:
            return
        ends = batch.starts[1:]
        smallest = np.zeros(n + w - 1, v.dtype)  # of the windows that stay in their text, shifted by w - 1; else 0
        slide(v[: n - gram + 1], w, np.minimum, smallest[w - 1 : w - 1 + n - length + 1])
        for a, b in zip(batch.starts[:-1].tolist(), ends.tolist(), strict=True):
            smallest[w - 1 + max(a, b - length + 1) : w - 1 + b] = 0
        at = np.flatnonzero(slide(smallest, w, np.maximum) == v)
        if not len(at):
            return
        # an anchor's windows follow those of the anchor before it, until it is left behind or a smaller one comes in
        value, text = v[at], np.searchsorted(batch.starts, at, "right")
        other = np.flatnonzero(np.r_[(value[1:] != value[:-1]) | (text[1:] != text[:-1]), True])  # last of each run of equals
        after = np.minimum(other[np.searchsorted(other, np.arange(len(at)))] + 1, len(at) - 1)
        smaller = (value[after] < value) & (text[after] == text)
        last = np.minimum(np.minimum(at, np.where(smaller, at[after] - w, at)), batch.starts[text] - length)
        begin = np.r_[True, text[1:] != text[:-1]]
        first = np.where(begin, batch.starts[text - 1], np.r_[0, last[:-1]] + 1)
        own = np.flatnonzero(first <= last)
        self.at, self.first, self.last = at[own], first[own], last[own]
        self.keys = batch.key(self.at)

    def repeated(self, across_texts: bool) -> np.ndarray:
        """Keys that the batch holds twice: in two texts, or anywhere."""
        if not len(self.at):
            return self.keys
        order = np.argsort(self.keys, kind="stable")
        keys = self.keys[order]
        same = keys[1:] == keys[:-1]
        if across_texts:
            text = np.searchsorted(self.batch.starts, self.at[order], "right")
            same &= text[1:] != text[:-1]
        return distinct(keys[1:][same])

    def owner(self, windows: np.ndarray) -> np.ndarray:
        """Which anchor each window owns."""
        return np.searchsorted(self.first, windows, "right") - 1

    def stretches(self, keys: np.ndarray) -> np.ndarray:
        """The anchors whose key is among the sorted ``keys``: each with its run of windows is a stretch."""
        return np.flatnonzero(_among(keys, self.keys))


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _blob(rows: pa.Table) -> bytes:
    """Rows as one compressed value: columns of a few bytes a row instead of wide rows in the shuffle."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(blobs: list[bytes], schema: dict) -> pa.Table:
    return pa.concat_tables([pa.table({k: pa.array([], t) for k, t in schema.items()}), *(pa.ipc.open_stream(b).read_all() for b in blobs)]).combine_chunks()


def _dealt(rows: pa.Table, by: str) -> tuple[list[int], list[bytes]]:
    """A blob for each value of ``by``, without that column."""
    rows = rows.take(pa.array(np.argsort(rows.column(by).to_numpy(), kind="stable")))
    keys, rows = rows.column(by).to_numpy(), rows.drop_columns([by])
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[new[1:], len(keys)] if len(keys) else new
    return [int(keys[a]) for a in new], [_blob(rows.slice(a, b - a)) for a, b in zip(new.tolist(), ends.tolist(), strict=True)]


def _first(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - first, counts)


def earliest(classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each window of a class (>= 0) the smallest rank in its class; its own rank where it stands alone."""
    out = ranks.copy()
    shared = np.flatnonzero(classes >= 0)
    order = shared[np.argsort(classes[shared], kind="stable")]
    if len(order):
        new = np.flatnonzero(np.r_[True, classes[order][1:] != classes[order][:-1]])
        out[order] = np.repeat(np.minimum.reduceat(ranks[order], new), np.diff(np.r_[new, len(order)]))
    return out


@dataclass(frozen=True)
class Job:
    """What an operator asks for. ``read``: texts to a batch of symbols. ``classes``: contents (and the places
    of their anchors; how many copies there are of each, else one) to a number for each of their windows, equal for equal
    windows, -1 for one without an equal. ``same_text``: an earlier place in the same text counts."""

    length: int
    gram: int
    read: object
    classes: object
    same_text: bool
    n: int  # batches, and groups of anchors

    def open(self, table: pa.Table) -> Batch:
        ids, texts = table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").to_pylist()]
        rows = sorted(zip((LAST_ID if i is None else i for i in ids), texts, strict=True))
        return self.read([r[0] for r in rows], [r[1] for r in rows])

    def anchors(self, batch: Batch) -> Anchors:
        return Anchors(batch, self.length, self.gram)

    def name_anchors(self, table: pa.Table) -> pa.Table:
        keys = distinct(self.anchors(self.open(table)).keys)
        group = (keys % np.uint64(self.n)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        keys, group = keys[order], group[order]
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[new[1:], len(keys)] if len(keys) else new
        me = _first(table, "batch")
        return pa.table({"bucket": pa.array(group[new], pa.int32()), "batch": pa.array([me] * len(new), pa.int32()), "keys": pa.array([_pack(keys[a:b]) for a, b in zip(new, ends, strict=True)], pa.binary())})

    def share_anchors(self, table: pa.Table) -> pa.Table:
        """To each batch, the anchors that other batches have too, those of many batches apart."""
        lists = [_unpack(k) for k in table.column("keys").to_pylist()]
        keys = np.sort(np.concatenate(lists))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        batches = np.diff(np.r_[first, len(keys)])
        shared, batches = keys[first[batches > 1]], batches[batches > 1]
        to, few, many = [], [], []
        for b, own in zip(table.column("batch").to_pylist(), lists, strict=True):
            if len(shared):
                at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                kept, hot = shared[at] == own, batches[at] > HOT_BATCHES
                if kept.any():
                    to.append(b)
                    few.append(_pack(own[kept & ~hot]))
                    many.append(_pack(own[kept & hot]))
        return pa.table({"batch": pa.array(to, pa.int32()), "keys": pa.array(few, pa.binary()), "hot": pa.array(many, pa.binary())})

    def indexed(self, batch: Batch, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, class, rank) of the windows of stretches (and between neighbouring ones, if the operator's index
        takes runs of any length), by position. Ranks order owners."""
        if not len(first):
            return (np.zeros(0, np.int64),) * 3
        text = np.searchsorted(batch.starts, first, "right") - 1
        if batch.merged:
            new = np.flatnonzero(np.r_[True, (first[1:] > last[:-1] + self.length) | (text[1:] != text[:-1])])
            first, last, text = first[new], last[np.r_[new[1:] - 1, len(last) - 1]], text[new]
        at = spans(first, last - first + 1)
        contents = [batch.content(x, y + self.length) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        classes = self.classes(contents) if batch.merged else self.classes(contents, anchor - first)
        _, rank = np.unique(np.array(batch.ids, np.int64), return_inverse=True)
        owner = np.repeat(text, last - first + 1)
        return at, classes, self.ranks(rank[owner], at - batch.starts[owner])

    def ranks(self, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        return doc.astype(np.int64) << 32 | start if self.same_text else doc.astype(np.int64)

    def split(self, batch: Batch, a: Anchors, own: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first, last, key, anchor) of the stretches ``own``. Those around hot anchors are cut in two: windows with
        enough symbols after the gram go by gram and those, the others by gram and as many symbols before it."""
        first, last, key, anchor = a.first[own], a.last[own], a.keys[own].copy(), a.at[own]
        cut = np.flatnonzero(_among(hot, key))
        if not len(cut):
            return first, last, key, anchor
        beside = (a.w - 1) // 2
        named = lambda x, y, side: int.from_bytes(hashlib.blake2b(side + batch.content(x, y), digest_size=6).digest(), "little")
        more: list[tuple[int, int, int, int]] = []
        last = last.copy()
        for k, f, l, g in zip(cut.tolist(), first[cut].tolist(), last[cut].tolist(), anchor[cut].tolist(), strict=True):
            middle = g - beside  # the first window with at most ``beside`` symbols before its gram
            after = named(g, g + self.gram + beside, b">") if l >= middle else 0
            if f >= middle:
                key[k] = after
                continue
            key[k] = named(g - beside, g + self.gram, b"<")
            if l >= middle:
                last[k] = middle - 1
                more.append((middle, l, after, g))
        columns = [np.array(c) for c in zip(*more, strict=True)] or [np.zeros(0, np.int64)] * 4
        first, last, key, anchor = (np.r_[x, y.astype(x.dtype)] for x, y in zip((first, last, key, anchor), columns, strict=True))
        order = np.argsort(first)
        return first[order], last[order], key[order], anchor[order]

    def cut_stretches(self, texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not texts.num_rows or not shared.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), "stretches": pa.array([], pa.binary())})
        batch = self.open(texts)
        a = self.anchors(batch)
        few, hot = (distinct(np.concatenate([_unpack(k) for k in shared.column(c).to_pylist()])) for c in ("keys", "hot"))
        first, last, key, anchor = self.split(batch, a, a.stretches(distinct(np.r_[few, hot])), hot)
        twice = _among(a.repeated(False), a.keys[np.searchsorted(a.at, anchor)])  # others have no equal in this batch
        lead, own = np.flatnonzero(~twice), np.flatnonzero(twice)
        if len(own):
            at, classes, rank = self.indexed(batch, first[own], last[own], anchor[own])
            # stretches are shorter than two windows: equal first and last windows mean equal stretches
            f, l, more = np.searchsorted(at, first[own]), np.searchsorted(at, last[own]), (last - first)[own]
            alone = np.where((classes[f] < 0) | (classes[l] < 0), np.arange(len(f)) + 1, 0)
            order = np.lexsort((rank[f], alone, classes[l], classes[f], more))
            parts = [x[order] for x in (more, classes[f], classes[l], alone)]
            lead = np.r_[lead, own[order[np.flatnonzero(np.r_[True, np.any([p[1:] != p[:-1] for p in parts], 0)])]]]
        text = np.searchsorted(batch.starts, first[lead], "right") - 1
        begin = first[lead] - batch.starts[text] if self.same_text else np.zeros(len(lead), np.int64)
        contents = [batch.content(x, y + self.length) for x, y in zip(first[lead].tolist(), last[lead].tolist(), strict=True)]
        columns = ((key[lead] % np.uint64(self.n)).astype(np.int32), first[lead], np.array(batch.ids, np.int64)[text], begin, (anchor - first)[lead], contents)
        buckets, blobs = _dealt(pa.table({k: pa.array(c, t) for (k, t), c in zip({"bucket": pa.int32(), **STRETCH}.items(), columns, strict=True)}), "bucket")
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "batch": pa.array([_first(texts, "batch")] * len(blobs), pa.int32()), "stretches": pa.array(blobs, pa.binary())})

    def compare(self, blobs: pa.Table) -> pa.Table:
        """To each batch, the windows of its stretches that have an earlier owner in another batch and none as early here."""
        found = [pa.ipc.open_stream(b).read_all() for b in blobs.column("stretches").to_pylist()]
        table, batches = pa.concat_tables(found).combine_chunks(), np.repeat(blobs.column("batch").to_numpy(), [f.num_rows for f in found])
        folded = table.column("content").cast(pa.large_binary()).combine_chunks().dictionary_encode()
        contents, own = folded.dictionary.to_pylist(), folded.indices.to_numpy()
        _, one, copies = np.unique(own, return_index=True, return_counts=True)
        classes = self.classes(contents, copies=copies) if self.read.merged else self.classes(contents, table.column("anchor").to_numpy()[one].astype(np.int64), copies=copies)
        counts = self.windows(contents)
        classes, counts = classes[spans((np.cumsum(counts) - counts)[own], counts[own])], counts[own]
        _, doc = np.unique(table.column("doc").to_numpy(), return_inverse=True)
        first = np.r_[0, np.cumsum(counts)]
        stretch = np.repeat(np.arange(len(own)), counts)
        rank = self.ranks(doc[stretch], table.column("start").to_numpy()[stretch] + np.arange(len(stretch)) - first[stretch])
        _, batch = np.unique(batches, return_inverse=True)
        shared = np.flatnonzero(classes >= 0)
        group = classes[shared] * (int(batch.max()) + 1) + batch[stretch[shared]]  # a class within a batch
        order = np.argsort(group)
        shared, group = shared[order], group[order]
        gone = np.zeros(len(classes), bool)
        if len(shared):
            by_class, by_group = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) for x in (classes[shared], group))
            least = np.repeat(np.minimum.reduceat(rank[shared], by_class), np.diff(np.r_[by_class, len(shared)]))
            own = np.repeat(np.minimum.reduceat(rank[shared], by_group), np.diff(np.r_[by_group, len(shared)]))
            gone[shared] = own > least
        tell = np.flatnonzero(np.add.reduceat(gone, first[:-1]) > 0)
        masks = [np.packbits(gone[x:y]).tobytes() for x, y in zip(first[tell].tolist(), first[tell + 1].tolist(), strict=True)]
        told = pa.table({"batch": pa.array(batches[tell]), "at": table.column("at").take(pa.array(tell)), "n": pa.array(counts[tell], pa.int32()), "mask": pa.array(masks, pa.binary())})
        to, out = _dealt(told, "batch")
        return pa.table({"batch": pa.array(to, pa.int32()), "told": pa.array(out, pa.binary())})

    def windows(self, contents: list[bytes]) -> np.ndarray:
        return np.array([self.read.symbols(c) for c in contents], np.int64) - self.length + 1

    def remove(self, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: pa.array([], t) for k, t in KEPT.items()})
        told = _rows(told.column("told").to_pylist(), TOLD)
        batch = self.open(texts)
        a = self.anchors(batch)
        head, count = told.column("at").to_numpy().astype(np.int64), told.column("n").to_numpy().astype(np.int64)
        keys = a.repeated(not self.same_text)
        if len(head) and not self.same_text:  # one of the windows alike was told, the others may be in the same text
            named = a.keys[a.owner(np.sort(head))]
            keys = distinct(np.r_[keys, named[_among(a.repeated(False), named)]])
        own = a.stretches(keys)
        at, classes, rank = self.indexed(batch, a.first[own], a.last[own], a.at[own])
        gone, hit = rank > earliest(classes, rank), np.zeros(0, np.int64)
        if len(head):
            bits = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[:k] for m, k in zip(told.column("mask").to_pylist(), count.tolist(), strict=True)])
            hit = spans(head, count)[bits.astype(bool)]
            gone |= (classes >= 0) & _among(distinct(classes[_among(distinct(hit), at)]), classes)
        removed = np.zeros(int(batch.starts[-1]), bool)
        hit = distinct(np.r_[at[gone], hit])
        if len(hit):  # runs of removed windows
            new = np.flatnonzero(np.r_[True, hit[1:] > hit[:-1] + self.length])
            for x, y in zip(hit[new].tolist(), hit[np.r_[new[1:] - 1, len(hit) - 1]].tolist(), strict=True):
                removed[x : y + self.length] = True
        rows = []
        for t, (b, e) in enumerate(zip(batch.starts[:-1].tolist(), batch.starts[1:].tolist(), strict=True)):
            own = removed[b:e]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False])) if own.any() else np.zeros(0, np.int64)
            rows.append((None if batch.ids[t] == LAST_ID else batch.ids[t], e - b, edge[::2].tolist(), edge[1::2].tolist(), batch.kept(t, own)))
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(KEPT.items(), zip(*rows, strict=True), strict=True)})


def _among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


STRETCH = {"at": pa.int32(), "doc": pa.int64(), "start": pa.int32(), "anchor": pa.int32(), "content": pa.binary()}
TOLD = {"at": pa.int32(), "n": pa.int32(), "mask": pa.binary()}
KEPT = {"doc_id": pa.int64(), "n_symbols": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary()}


def remove_repeats(docs: DataFrame, length: int, gram: int, read, classes, same_text: bool) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_symbols, starts, ends (removed runs, half open), kept (bytes).

    Null and repeated doc_ids are dealt like others: a row goes by doc_id and text. Rows that repeat a doc_id have one
    rank (with ``same_text``: a window that starts at a smaller symbol comes first, in whichever row).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    job = Job(length, gram, read, classes, same_text, max(1, -(-size // BATCH_BYTES)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(job.n)).cast("int").alias("batch"))
    named = texts.groupBy("batch").applyInArrow(lambda t: job.name_anchors(t), "bucket int, batch int, keys binary")
    shared = named.groupBy("bucket").applyInArrow(lambda t: job.share_anchors(t), "batch int, keys binary, hot binary")
    cut = texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(lambda t, u: job.cut_stretches(t, u), "bucket int, batch int, stretches binary")
    told = cut.groupBy("bucket").applyInArrow(lambda t: job.compare(t), "batch int, told binary")
    return texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda t, u: job.remove(t, u), "doc_id long, n_symbols long, starts array<long>, ends array<long>, kept binary")
