r"""Language-model scores of texts from a log-frequency Bloom filter.

Words are counted exactly (sharded tables, answered batch by batch); pairs of words are held by a Bloom filter of their
quantised counts: a pair that occurs c times is entered once for each of its 1 + floor(log_BASE c) levels, and its count
is read back by probing level after level until one is missing. The filter is cut into shards of bounded size, so its
size follows the corpus and its error does not. A filter up to ``BROADCAST_BYTES`` is broadcast to the workers; a larger
one stays where it is, and the batches' distinct pairs are sent to its shards. Both ways give equal scores.

The score interpolates a pair's share of its first word's occurrences with the words' own probabilities; how much goes
to the latter is learned per class of first words of like frequency, as the share of their pairs that occur only once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .ngram_join import FOLDED
from .repeats import M1, M2, mixed
from .substring_dedup import word_bounds, word_hashes

#: Bytes of text in a batch, and batches for each bucket of words.
BATCH_BYTES = 4_000_000
BUCKET_BATCHES = 16
#: Training tokens for each shard of the filter: bounds its entries.
SHARD_TOKENS = 2_000_000
BITS, PROBES, BASE = 12, 7, 1.5
#: Filters up to this size are broadcast whole.
BROADCAST_BYTES = 128_000_000
#: The end of a text, a token of its own and the word before a text's first; no hash of a word's bytes by intent.
END = np.uint64(0xA0761D6478BD642F)
CLASSES = 64
MODULUS, HELD_OUT = 5, 1

COUNTED = {"batch": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "keys": pa.binary(), "totals": pa.binary(), "ids": pa.binary(), "words": pa.int64(), "tokens": pa.int64()}
COUNTED_SQL = "batch long, doc_ids array<long>, held_out array<boolean>, lengths array<int>, keys binary, totals binary, ids binary, words long, tokens long"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' lower-cased words, each text's followed by its end, and the texts' numbers of tokens."""
    data = b" " + b" ".join(t.translate(FOLDED) for t in texts) + b" "
    begins, ends, starts = word_bounds(data, [len(t) for t in texts])
    hashes = word_hashes(np.frombuffer(data, np.uint8), begins, ends)
    return np.insert(hashes, starts[1:], END), np.diff(starts) + 1


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers with bytes of like weight side by side, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _sorted(x: np.ndarray) -> bytes:
    """Rising numbers, as the steps between them."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _from_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_from_planes(data, kind), dtype=kind)


def _grouped(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by group, and where each group begins and ends in it."""
    order = np.argsort(group, kind="stable")
    own = group[order]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order, new, np.r_[new[1:], len(own)] if len(own) else new


def _texts(rows: pa.Table) -> list[bytes]:
    return [t or b"" for t in rows.column("text").to_pylist()]


WORDS = "bucket int, batch long, keys binary, counts binary"


def _words(rows: pa.Table, buckets: int) -> pa.Table:
    """Distinct words of a batch by bucket, with their counts in its training texts (0: in none)."""
    hashes, lengths = tokens(_texts(rows))
    trained = ~rows.column("held_out").to_numpy(zero_copy_only=False)
    keys, which = np.unique(hashes, return_inverse=True)
    counts = np.bincount(which, np.repeat(trained, lengths), len(keys)).astype(np.int64)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order, new, ends = _grouped(bucket)
    keys, counts, me = keys[order], counts[order], rows.column("batch")[0].as_py()
    cuts = list(zip(new.tolist(), ends.tolist(), strict=True))
    return pa.table({"bucket": pa.array(bucket[order][new], pa.int32()), "batch": pa.array([me] * len(cuts), pa.int64()), "keys": pa.array([_sorted(keys[a:b]) for a, b in cuts], pa.binary()), "counts": pa.array([_planes(counts[a:b]) for a, b in cuts], pa.binary())})


REPLIES = "batch long, bucket int, totals binary, words long, tokens long"


def _totals(rows: pa.Table) -> pa.Table:
    """Each word's total for every batch that asked, and one row without a batch: the bucket's words and tokens."""
    keys = [_from_sorted(k, "<u8") for k in rows.column("keys").to_pylist()]
    counts = np.concatenate([_from_planes(c, "<i8") for c in rows.column("counts").to_pylist()])
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(which, kind="stable")
    total = np.add.reduceat(counts[order], np.searchsorted(which[order], np.arange(len(every))))
    bucket = rows.column("bucket")[0].as_py()
    back, at = [], 0
    for k in keys:
        back.append(_planes(total[which[at : at + len(k)]]))
        at += len(k)
    n = len(back)
    return pa.table({"batch": pa.array([*rows.column("batch").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "totals": pa.array([*back, None], pa.binary()), "words": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "tokens": pa.array([None] * n + [int(total.sum())], pa.int64())})


def _counted(rows: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """One row for a batch: its documents, distinct words with their totals in the corpus, and the texts as places among
    these words. One row without a batch: the corpus's words and tokens."""
    if not rows.num_rows:
        row = {k: None for k in COUNTED} | {"words": sum(replies.column("words").to_pylist()), "tokens": sum(replies.column("tokens").to_pylist())}
        return pa.table({k: pa.array([row[k]], t) for k, t in COUNTED.items()})
    hashes, lengths = tokens(_texts(rows))
    keys, ids = np.unique(hashes, return_inverse=True)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order, new, ends = _grouped(bucket)
    told = dict(zip(replies.column("bucket").to_pylist(), replies.column("totals").to_pylist(), strict=True))
    totals = np.empty(len(keys), np.int64)
    for a, b in zip(new.tolist(), ends.tolist(), strict=True):
        totals[order[a:b]] = _from_planes(told[int(bucket[order[a]])], "<i8")
    common = np.argsort(-np.bincount(ids), kind="stable")  # frequent words first: small numbers, which compress
    rank = np.empty(len(common), "<u4")
    rank[common] = np.arange(len(common))
    keys, totals, ids = keys[common], totals[common], rank[ids]
    row = {"batch": rows.column("batch")[0].as_py(), "doc_ids": rows.column("doc_id").to_pylist(), "held_out": rows.column("held_out").to_pylist(), "lengths": lengths.tolist(), "keys": keys.tobytes(), "totals": _planes(totals), "ids": _planes(ids), "words": None, "tokens": None}
    return pa.table({k: pa.array([row[k]], t) for k, t in COUNTED.items()})


class Counted:
    """A batch's words and texts, and its distinct pairs of neighbouring words."""

    def __init__(self, row: dict, shards: int):
        self.row = row
        self.keys, self.totals = np.frombuffer(row["keys"], np.uint64), _from_planes(row["totals"], "<i8")
        self.ids, self.lengths = _from_planes(row["ids"], "<u4"), np.array(row["lengths"], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        self.held_out = np.array(row["held_out"], bool)
        self.before = np.roll(self.ids, 1)
        self.before[self.starts] = np.flatnonzero(self.keys == END)[0]
        g = mixed(self.keys[self.before] * M1 + self.keys[self.ids])
        # 32 bits within a shard of a few million entries: strangers meet far less often than the filter itself errs
        pair = (g >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | g & np.uint64(0xFFFFFFFF)
        pairs, self.first, self.which = np.unique(pair, return_index=True, return_inverse=True)
        self.shard, self.names = (pairs >> np.uint64(32)).astype(np.int32), pairs.astype(np.uint32)

    def by_shard(self, chosen: np.ndarray | None = None):
        """(shard, places of its pairs) for each shard; pairs are sorted by shard already."""
        own = np.arange(len(self.names)) if chosen is None else np.flatnonzero(chosen)
        _, new, ends = _grouped(self.shard[own])
        for a, b in zip(new.tolist(), ends.tolist(), strict=True):
            yield int(self.shard[own[a]]), own[a:b]


def classes(totals: np.ndarray) -> np.ndarray:
    """Class of a word by its count's power of two; 0: not seen."""
    return np.frexp(totals.astype(float))[1]


def _rows(batches, shards: int):
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("batch")[k].is_valid:
                yield Counted({c: batch.column(c)[k].as_py() for c in batch.schema.names}, shards)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


PAIRS = "shard int, names binary, counts binary, classes binary"


def _pairs(batches, shards: int):
    """Distinct pairs of each batch's training texts by shard, with counts and the classes of their first words."""
    for own in _rows(batches, shards):
        counts = np.bincount(own.which, np.repeat(~own.held_out, own.lengths), len(own.names)).astype("<u4")
        kind = classes(own.totals)[own.before[own.first]].astype(np.uint8)
        yield _table([(s, _sorted(own.names[at]), _planes(counts[at]), kind[at].tobytes()) for s, at in own.by_shard(counts > 0)], PAIRS)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _count_of_level() -> np.ndarray:
    """What a count of each level is taken for: the middle of the whole numbers in it (a gap between levels: the least)."""
    edges = [int(np.ceil(BASE**j - 1e-9)) for j in range(100)]
    return np.array([0.0, *[(a + max(a, b - 1)) / 2 for a, b in zip(edges, edges[1:], strict=False)]])


COUNT_OF_LEVEL = _count_of_level()


def _places(names: np.ndarray, level: int, size: int):
    """The bits of each name at a level, one array for each probe."""
    h = mixed(names.astype(np.uint64) * M1 + np.uint64(level * int(M2) % 2**64))
    step = (mixed(h + M2) | np.uint64(1)) & np.uint64(0xFFFFFFFF)
    h &= np.uint64(0xFFFFFFFF)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


def filter_of(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a log-frequency Bloom filter, packed."""
    levels = levels_of(counts)
    size = max(64, -(-int(levels.sum()) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(names[levels >= level], level, size):
            bits[place] = True
    return np.packbits(bits, bitorder="little")


def probed(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Level of each name: the number of levels in a row that the filter knows."""
    out, live, level = np.zeros(len(names), np.uint8), np.arange(len(names)), 1
    while len(live) and level < len(COUNT_OF_LEVEL) - 1:
        known = np.arange(len(live))
        for place in _places(names[live], level, 8 * len(bits)):
            known = known[bits[place[known] >> 3] >> (place[known] & 7).astype(np.uint8) & 1 > 0]
            if not len(known):
                break
        live = live[known]
        out[live] = level
        level += 1
    return out


SHARDS = "shard int, bits binary, singles array<long>, every array<long>"


def _shard(rows: pa.Table) -> pa.Table:
    """A shard of the filter from all batches' counts, and per class of first words the pairs that occur once and all."""
    names = np.concatenate([_from_sorted(x, "<u4") for x in rows.column("names").to_pylist()])
    counts = np.concatenate([_from_planes(x, "<u4") for x in rows.column("counts").to_pylist()])
    kinds = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("classes").to_pylist()])
    order, new, _ = _grouped(names)
    own, kind, total = names[order[new]], kinds[order[new]], np.add.reduceat(counts[order], new, dtype=np.int64)
    singles = np.bincount(kind, total == 1, CLASSES).astype(np.int64)
    every = np.bincount(kind, total, CLASSES).astype(np.int64)
    return pa.Table.from_batches([_table([(rows.column("shard")[0].as_py(), filter_of(own, total).tobytes(), singles.tolist(), every.tolist())], SHARDS)])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(own: Counted, levels: np.ndarray, words: int, train: int, free: np.ndarray) -> pa.RecordBatch:
    base = (own.totals + 0.5) / (train + 0.5 * (words + 1))
    p0, history = base[own.ids], own.totals[own.before]
    seen = np.minimum(COUNT_OF_LEVEL[levels[own.which]], np.minimum(history, own.totals[own.ids]))  # no pair outnumbers its words
    share = free[classes(own.totals)[own.before]]
    p = np.where(history > 0, (1 - share) * seen / np.maximum(history, 1) + share * p0, p0)
    add = lambda x: np.add.reduceat(x, own.starts)  # noqa: E731  every text has its end, so none is empty
    n, row = len(own.lengths), own.row
    kinds = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(own.lengths), pa.array(add((own.totals[own.ids] > 0).astype(np.int64))), pa.array(np.full(n, train)), pa.array(add(np.log10(p0))), pa.array(add(np.log10(p)))]
    return pa.RecordBatch.from_arrays(kinds, [f.split()[0] for f in SCORES.split(", ")])


def _scored(batches, shards, bits, words, train, free):
    for own in _rows(batches, shards):
        levels = np.zeros(len(own.names), np.uint8)
        for s, at in own.by_shard():
            if s in bits.value:
                levels[at] = probed(np.frombuffer(bits.value[s], np.uint8), own.names[at])
        yield _scores(own, levels, words, train, free)


def _asked(batches, shards):
    for own in _rows(batches, shards):
        yield _table([(s, own.row["batch"], _sorted(own.names[at])) for s, at in own.by_shard()], "shard int, batch long, names binary")


ANSWERS = "batch long, shard int, levels binary"


def _answered(asked: pa.Table, held: pa.Table) -> pa.Table:
    found = np.frombuffer(held.column("bits")[0].as_py(), np.uint8) if held.num_rows else None
    rows = []
    for s, batch, names in zip(*[asked.column(c).to_pylist() for c in ("shard", "batch", "names")], strict=True):
        own = _from_sorted(names, "<u4")
        rows.append((batch, s, (np.zeros(len(own), np.uint8) if found is None else probed(found, own)).tobytes()))
    return pa.Table.from_batches([_table(rows, ANSWERS)])


def _scored_by_answers(rows: pa.Table, answers: pa.Table, shards, words, train, free) -> pa.Table:
    out = []
    for own in _rows(rows.to_batches(), shards):
        told = dict(zip(answers.column("shard").to_pylist(), answers.column("levels").to_pylist(), strict=True))
        levels = np.zeros(len(own.names), np.uint8)
        for s, at in own.by_shard():
            levels[at] = np.frombuffer(told[s], np.uint8)
        out.append(_scores(own, levels, words, train, free))
    return pa.Table.from_batches(out or [_table([], SCORES)])


def lm_scores(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows whose crc32 of the doc_id's digits, mod ``modulus``, is not ``held_out`` (a null doc_id counts
    as the empty text, whose rest is 0). A null or empty text is its end alone. Repeated rows are rows of their own and
    count each. Without training rows every word has probability 1. An empty table gives no rows; other columns are not
    read. Scores are base-10 logarithms; a text's own words are in the counts if it is a training row.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // BATCH_BYTES))
    buckets = max(1, many // BUCKET_BATCHES)
    doc_id = F.col("doc_id").cast("long")
    rest = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
    texts = docs.select(doc_id.alias("doc_id"), (rest == held_out).alias("held_out"), F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64(doc_id, "text"), F.lit(many)).alias("batch"))
    replies = texts.groupBy("batch").applyInArrow(lambda t: _words(t, buckets), WORDS).groupBy("bucket").applyInArrow(lambda t: _totals(t), REPLIES)
    counted = cut(texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(lambda t, r: _counted(t, r, buckets), COUNTED_SQL), "counted", "zstd")
    stats = counted.filter("batch IS NULL").select("words", "tokens").first()
    words, train = (stats.words, stats.tokens) if stats else (0, 0)
    counted = counted.filter("batch IS NOT NULL").drop("words", "tokens")
    shards = max(1, -(-train // SHARD_TOKENS))
    held = cut(counted.mapInArrow(lambda b: _pairs(b, shards), PAIRS).groupBy("shard").applyInArrow(lambda t: _shard(t), SHARDS), "filter")
    sums = held.select(F.posexplode(F.arrays_zip("singles", "every")).alias("k", "x")).groupBy("k").agg(F.sum("x.singles").alias("singles"), F.sum("x.every").alias("every")).collect()  # a row for each class
    free = np.full(CLASSES, 0.5)
    for r in sums:
        free[r.k] = (r.singles + 1) / (r.every + 2)
    if (held.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= BROADCAST_BYTES:
        bits = spark.sparkContext.broadcast({r.shard: bytes(r.bits) for r in held.select("shard", "bits").toLocalIterator()})
        return counted.mapInArrow(lambda b: _scored(b, shards, bits, words, train, free), SCORES)
    asked = counted.mapInArrow(lambda b: _asked(b, shards), "shard int, batch long, names binary")
    answers = asked.groupBy("shard").cogroup(held.select("shard", "bits").groupBy("shard")).applyInArrow(lambda a, h: _answered(a, h), ANSWERS)
    return counted.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda t, a: _scored_by_answers(t, a, shards, words, train, free), SCORES)


def op13_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
