"""Benchmark decontamination: n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

Texts are folded to lower-case words. Every 4-word seed of a benchmark item is looked up in all texts in one pass; a
passage around the places found is a candidate, however many documents hold the seed. A seed that many items share is not
expanded to all of them: an alignment of the least score takes so many of the item's words that one of its rarest must be
in the text, so only items with such a word go on. An exact bound drops candidates early: the item's words that the
passage has, counted with repetition, limit the alignment's score. The rest are aligned word by word, which keeps copies
with changed, added or missing words; equal passages of a batch are aligned once.

Seeds are broadcast in blocks of bounded size, one pass over the texts for each, whatever the benchmark's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, table
from .licenses import WORDS
from .substring_dedup import word_bounds, word_grams, word_hashes

SEED_WORDS = 4
#: Seeds (8-byte hash, item, place) that one pass broadcasts at most.
BLOCK_SEEDS = 500_000
#: Items that share a seed before it is followed by way of their rarest words.
HOT_SEED = 8
#: Characters of text that a task searches at once.
PORTION = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.55


def folded_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORDS).split()


def _grams(texts: list[str]):
    """All texts as one run of words: data, begins, ends, each text's first word, word hashes, seed hashes."""
    folded = [t.lower().encode("utf-8", "surrogatepass").translate(WORDS) for t in texts]
    data = b" " + b" ".join(folded) + b" "
    begins, ends, starts = word_bounds(data, [len(t) for t in folded])
    hashes = word_hashes(np.frombuffer(data, np.uint8), begins, ends)
    return data, begins, ends, starts, hashes, word_grams(hashes, SEED_WORDS)


def _item_seeds(rows: list[tuple[int, str]], least: float):
    """Sorted seed hashes with item, each item's word hashes with counts (an item of fewer words than a seed has no seed),
    and for items with a seed that many share, sorted hashes of their rarest words with item."""
    _, _, _, starts, hashes, grams = _grams([t for _, t in rows])
    seeds, items, words = [], [], {}
    for (item, _), a, b in zip(rows, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        k = max(0, b - a - SEED_WORDS + 1)
        seeds.append(grams[a : a + k])
        items += [item] * k
        words[item] = np.unique(hashes[a:b], return_counts=True)
    seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    order = np.lexsort((np.array(items, np.int64), seeds))
    seeds, items = seeds[order], np.array(items, np.int64)[order]
    shared = np.searchsorted(seeds, seeds, "right") - np.searchsorted(seeds, seeds, "left") > HOT_SEED
    every, items_of = np.unique(np.concatenate([w for w, _ in words.values()]) if words else np.zeros(0, np.uint64), return_counts=True)
    rare, owners = [np.zeros(0, np.uint64)], []
    for item in np.unique(items[shared]).tolist():
        own, counts = words[item]
        by_rarity = np.argsort(items_of[np.searchsorted(every, own)], kind="stable")
        n = int(counts.sum())
        # at least ``least`` of the item's words match, so all but that many and one more, the rarest first, hold a match
        enough = n - int(np.ceil(least * n - 1e-9)) + 1
        rare.append(own[by_rarity][: int(np.searchsorted(np.cumsum(counts[by_rarity]), enough)) + 1])
        owners += [item] * len(rare[-1])
    rare = np.concatenate(rare)
    order = np.argsort(rare, kind="stable")
    return seeds, items, words, rare[order], np.array(owners, np.int64)[order]


def _near(present: np.ndarray, rare: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Items one of whose rarest words is among ``present``."""
    a, b = np.searchsorted(rare, present, "left"), np.searchsorted(rare, present, "right")
    found = np.flatnonzero(b > a)
    return np.unique(np.concatenate([owners[a[k] : b[k]] for k in found.tolist()])) if len(found) else np.zeros(0, np.int64)


def most(words: tuple[np.ndarray, np.ndarray], passage: np.ndarray) -> float:
    """The best score that an item of these words can reach in a passage of these word hashes: all that both have match."""
    own, counts = words
    at = np.minimum(np.searchsorted(own, passage), len(own) - 1)
    return int(np.minimum(counts, np.bincount(at[own[at] == passage], minlength=len(own))).sum()) / int(counts.sum())


FOUND = "doc_id long, item long, first_word long, passage binary"


def _portions(batches):
    """Rows of the batches, a few megabytes of text at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= PORTION:
                yield ids, texts
                ids, texts, size = [], [], 0
        yield ids, texts


def _search(batches, block, least):
    seeds, items, words, rare, owners = block.value
    lengths = {item: int(counts.sum()) for item, (_, counts) in words.items()}
    for ids, texts in _portions(batches):
        data, begins, ends, starts, hashes, grams = _grams(texts)
        at = np.searchsorted(seeds, grams)
        hit = np.flatnonzero(seeds[np.minimum(at, len(seeds) - 1)] == grams) if len(grams) else np.zeros(0, int)
        text = np.searchsorted(starts, hit, "right") - 1
        hit, text = hit[hit + SEED_WORDS <= starts[text + 1]], text[hit + SEED_WORDS <= starts[text + 1]]
        by_pair: dict[tuple[int, int], list[int]] = {}
        own_text, near, among = -1, None, {}
        for h, t, a, b in zip(hit.tolist(), text.tolist(), at[hit].tolist(), np.searchsorted(seeds, grams[hit], "right").tolist(), strict=True):
            held = items[a:b]
            if b - a > HOT_SEED:
                if t != own_text:
                    own_text, near, among = t, _near(np.unique(hashes[starts[t] : starts[t + 1]]), rare, owners), {}
                if a not in among:
                    among[a] = near[held[np.minimum(np.searchsorted(held, near), len(held) - 1)] == near]
                held = among[a]
            for item in held.tolist():
                by_pair.setdefault((t, item), []).append(h)
        rows = []
        for (t, item), found in by_pair.items():
            room, group = lengths[item], []
            for h in [*found, 1 << 60]:  # places further apart than an item are passages of their own
                if group and h - group[-1] > room:
                    a = max(int(starts[t]), group[0] - room)
                    b = min(int(starts[t + 1]), group[-1] + room + SEED_WORDS)
                    if most(words[item], hashes[a:b]) >= least:
                        passage = b" ".join(data[x:y] for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True))
                        rows.append((ids[t], item, a - int(starts[t]), passage))
                    group = []
                group.append(h)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in FOUND.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def align(item: list[bytes], passage: list[bytes]) -> tuple[float, int, int]:
    """Smith-Waterman over words: score as a share of the item's best, and the aligned words of the passage."""
    if not item or not passage:
        return 0.0, 0, 0
    names: dict[bytes, int] = {}
    x = np.array([names.setdefault(w, len(names)) for w in item])
    y = np.array([names.setdefault(w, len(names)) for w in passage])
    m, columns = len(y), np.arange(len(y) + 1)
    row, begin = np.zeros(m + 1), columns.copy()
    best, top, came = 0.0, 0, 0
    for a in x:
        diagonal = row[:-1] + np.where(y == a, MATCH, MISMATCH)
        up = row[1:] + GAP
        new, start = np.zeros(m + 1), columns.copy()
        new[1:] = np.maximum(0, np.maximum(diagonal, up))
        start[1:] = np.where(new[1:] == 0, columns[1:], np.where(diagonal >= up, begin[:-1], begin[1:]))
        slope = new - GAP * columns
        reach = np.maximum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == reach, columns, 0))
        new, start = np.maximum(new, reach + GAP * columns), np.where(reach + GAP * columns > new, start[source], start)
        row, begin = new, start
        if row.max() > best:
            best, top = float(row.max()), int(row.argmax())
            came = int(begin[top])
    return best / (MATCH * len(item)), came, top


def _aligned(batches):
    for batch in batches:
        pairs = list(zip(batch.column("item_text").to_pylist(), batch.column("passage").to_pylist(), strict=True))
        aligned = {(i, p): align(folded_words(i or ""), (p or b"").split()) for i, p in set(pairs)}
        scores = [aligned[pair] for pair in pairs]
        first = batch.column("first_word").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item"), pa.array([s for s, _, _ in scores], pa.float64()), pa.array([f + a for f, (_, a, _) in zip(first, scores, strict=True)], pa.int64()), pa.array([f + b for f, (_, _, b) in zip(first, scores, strict=True)], pa.int64())], ["doc_id", "item", "score", "first_word", "end_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): passages of ``docs`` that hold a benchmark item.

    One row for each document and item, its best passage; ``score`` (``least`` to 1) is the alignment's share of a
    verbatim copy's. Items or texts that are null, empty or shorter than a seed meet nothing. Every distinct text of
    ``benchmark`` is searched; of rows that repeat a doc_id or an item_id the best passage counts. Rows with a null
    doc_id are searched and keep the null; so do texts that stand under no item_id but null (one that also has an
    item_id is reported under that).
    """
    spark = docs.sparkSession
    pairs = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = cut(pairs.groupBy("text").agg((F.count("item_id") > 0).alias("named")).withColumn("item", F.monotonically_increasing_id()), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = items.select((F.length("text") + 1).alias("size"))
    blocks = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // (2 * BLOCK_SEEDS)))  # a word and a space: two characters at least
    found = None
    for block in range(blocks):
        rows = [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()]
        own = spark.sparkContext.broadcast(_item_seeds(rows, least))
        if not len(own.value[0]):
            continue
        part = cut(texts.mapInArrow(lambda b, own=own: _search(b, own, least), FOUND), "found")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    scored = found.join(items.select("item", F.col("text").alias("item_text")), "item").select("doc_id", "item", "item_text", "first_word", "passage").mapInArrow(_aligned, "doc_id long, item long, score double, first_word long, end_word long")
    names = pairs.join(items, "text").filter("item_id IS NOT NULL OR NOT named").select("item", "item_id")
    best = scored.filter(F.col("score") >= least).join(names, "item").groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("x"))
    return best.select("doc_id", "item_id", "x.score", "x.first_word", "x.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns. Each row is judged by its own text, whatever its doc_id."""
    rows, row = numbered(docs)
    hit = contaminated(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(hit, row, "left_anti").select(docs.columns)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
