r"""Jaccard join on word n-grams: rare-first prefix filtering, verified once per pair, and the components of its links.

Two sets link only if at least ``NEED`` percent of either one's n-grams are shared. So three filters narrow the rows:

1. a third of each document's n-grams (those with the smallest hashes) is compared across the corpus; a document with
   more unshared ones than a partner could miss has no partner;
2. equal sets are folded into one class, and exact document frequencies are counted among the classes that are left;
3. each class's n-grams are ordered rare first, and only the prefix that a partner must meet is indexed.

Pairs come from the index under length, positional and suffix filters and are verified on the whole sets. Within an
index entry every class is first paired with one pivot only; once links have joined classes into components, rounds
of a few pivots each follow and at last the remaining pairs of different components. A group of near copies thus costs
a few pairs for each member. Pivots are drawn among the classes with the fewest rarer n-grams, which lie in the middle
of their group, and the remaining pairs are listed where their prefixes first meet. Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, table
from .components import components
from .repeats import BATCH_BYTES, KEY_BITS, _pack, _unpack
from .substring_dedup import word_bounds, word_grams, word_hashes

N = 4
NEED = 85
SAMPLED = np.uint64(2**64 // 3)
#: Pivots that an index entry's classes are paired with in each round before the rest is paired off.
PIVOTS = (1, 4, 4, 4)
#: Classes of an index entry whose remaining pairs one task lists; a larger entry is dealt to several.
SPREAD = 2_000
#: Hash ranges of the suffix filter: a set's signature has a bit for each, odd or even.
RANGE_BITS = 9
SET_BATCH_BYTES = 4_000_000
#: Rarer n-grams of its prefix that an index entry knows: a pair that shares one of them is listed there.
BEFORE = 8


#: A-Z to a-z, and the six bytes between words to a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct n-word shingles; of all its words if there are fewer."""
    data = b" " + b" ".join(t.translate(FOLDED) for t in texts) + b" "
    begins, ends, starts = word_bounds(data, [len(t) for t in texts])
    h = word_hashes(np.frombuffer(data, np.uint8), begins, ends)
    grams = word_grams(h, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            words = b" ".join(data[x:y] for x, y in zip(begins[a:b], ends[a:b], strict=True))
            out.append(np.frombuffer(hashlib.blake2b(words, digest_size=8).digest(), "<u8"))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def misses(n: int, need: int = NEED) -> int:
    """How many of a set's n members a partner may lack."""
    return n - -(-need * n // 100)


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _by_bucket(me: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Distinct 48-bit keys of a batch with their counts, a row for each bucket."""
    group = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    keys, counts, group = keys[order], counts[order], group[order]
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[new[1:], len(keys)] if len(keys) else new
    spans = list(zip(new.tolist(), ends.tolist(), strict=True))
    return pa.table({"bucket": pa.array(group[new], pa.int32()), "batch": pa.array([me] * len(new), pa.int32()), "keys": pa.array([_pack(keys[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())})


PACKED = "bucket int, batch int, keys binary, counts binary"
BACK = "batch int, keys binary, counts binary"


def _shared(rows: pa.Table) -> pa.Table:
    """Keys of a bucket that two documents have, back to each batch that holds them, with their total counts."""
    keys = [_unpack(k) for k in rows.column("keys").to_pylist()]
    counts = [np.frombuffer(c, "<u4") for c in rows.column("counts").to_pylist()]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts).astype(float)).astype(np.int64)
    common, total = distinct[total > 1], total[total > 1]
    batches, out, sums = [], [], []
    for b, own in zip(rows.column("batch").to_pylist(), keys, strict=True):
        kept = own[member(common, own)]
        if len(kept):
            batches.append(b)
            out.append(_pack(kept))
            sums.append(np.minimum(total[np.searchsorted(common, kept)], 2**32 - 1).astype("<u4").tobytes())
    return pa.table({"batch": pa.array(batches, pa.int32()), "keys": pa.array(out, pa.binary()), "counts": pa.array(sums, pa.binary())})


def _told(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([_unpack(k) for k in rows.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in rows.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _read(rows: pa.Table, n: int) -> tuple[list, list[np.ndarray]]:
    return rows.column("doc_id").to_pylist(), shingle_sets([t or b"" for t in rows.column("text").to_pylist()], n)


def _sampled(rows: pa.Table, n: int, buckets: int) -> pa.Table:
    _, sets = _read(rows, n)
    keys, counts = np.unique(np.concatenate([s[: np.searchsorted(s, SAMPLED)] for s in sets]) & KEY_BITS, return_counts=True)
    return _by_bucket(rows.column("batch")[0].as_py(), keys, counts, buckets)


def _survivors(rows: pa.Table, back: pa.Table, n: int, need: int) -> pa.Table:
    """A row for each document; ``fp`` of those that may have partners, the set with the first of each ``fp``."""
    if not rows.num_rows:
        return pa.table({"rid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "fp": pa.array([], pa.binary()), "set": pa.array([], pa.binary())})
    ids, sets = _read(rows, n)
    common, _ = _told(back)
    fps, kept, seen = [], [], set()
    for s in sets:
        few = s[: np.searchsorted(s, SAMPLED)]
        alone = len(few) - int(member(common, few & KEY_BITS).sum())
        if not len(s) or alone > misses(len(s), need):
            fps.append(None)
            kept.append(None)
            continue
        fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        fps.append(fp)
        kept.append(None if fp in seen else s.astype("<u8").tobytes())
        seen.add(fp)
    return pa.table({"rid": rows.column("rid"), "doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array(fps, pa.binary()), "set": pa.array(kept, pa.binary())})


def _counted(rows: pa.Table, buckets: int) -> pa.Table:
    sets = [np.frombuffer(s, "<u8") for s in rows.column("set").to_pylist()]
    keys, counts = np.unique(np.concatenate(sets) & KEY_BITS, return_counts=True)
    return _by_bucket(rows.column("batch")[0].as_py(), keys, counts, buckets)


INDEX = {"cid": pa.int64(), "n": pa.int64(), "tokens": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "signature": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}
INDEX_SQL = "cid long, n long, tokens array<long>, places array<int>, signature array<long>, keys array<long>"


def signature(s: np.ndarray) -> np.ndarray:
    """Whether each hash range holds an odd number of members: every bit in which two sets differ is a member that they
    do not share, whatever their order."""
    odd = np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS) & 1
    return np.packbits(odd).view(np.int64)


def _indexed(rows: pa.Table, back: pa.Table, need: int) -> pa.Table:
    """Rare-first prefixes of the classes whose shared n-grams suffice for a partner."""
    out = []
    common, totals = _told(back)
    for cid, data in zip(rows.column("cid").to_pylist(), rows.column("set").to_pylist(), strict=True) if rows.num_rows else ():
        s = np.frombuffer(data, "<u8")
        short = s & KEY_BITS
        has = member(common, short)
        allowed = misses(len(s), need)
        if len(s) - int(has.sum()) > allowed:
            continue
        df = np.ones(len(s), np.int64)
        df[has] = totals[np.searchsorted(common, short[has])]
        order = np.lexsort((s, df))[: allowed + 1]
        place = np.flatnonzero(df[order] > 1)  # what no other class has can't meet anything
        if len(place):
            out.append((cid, len(s), s[order[place]].view(np.int64), place, signature(s), s.view(np.int64)))
    columns = list(zip(*out, strict=True)) or [()] * len(INDEX)
    return pa.table({k: pa.array(list(c), t) for (k, t), c in zip(INDEX.items(), columns, strict=True)})


def _may_link(a: str, b: str, need: int) -> Column:
    """Length, positional and suffix filters on two index entries; none drops a pair that links."""
    na, nb, pa_, pb = (F.col(f"{x}.{y}") for x, y in ((a, "n"), (b, "n"), (a, "place"), (b, "place")))
    least = F.lit(100 + need)
    enough = lambda overlap: overlap * least >= (na + nb) * need  # noqa: E731  100 o >= need (na + nb - o)
    length = (F.least(na, nb) * 100) >= (F.greatest(na, nb) * need)
    position = enough(F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1))
    apart = sum((F.bit_count(F.col(f"{a}.signature")[i].bitwiseXOR(F.col(f"{b}.signature")[i])) for i in range((1 << RANGE_BITS) // 64)), F.lit(0))
    return length & position & enough((na + nb - apart) / 2)


def _verified(pairs: DataFrame, index: DataFrame, need: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    sets = index.select("cid", "keys")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("keys").alias("ka")), "a").join(sets.select(F.col("cid").alias("b"), F.col("keys").alias("kb")), "b")
    overlap = F.size(F.array_intersect("ka", "kb"))
    return both.filter(overlap * (100 + need) >= (F.size("ka") + F.size("kb")) * need).select("a", "b")


def class_links(index: DataFrame, need: int) -> DataFrame:
    """(node, root) over the ids of linked classes."""
    each = index.select("cid", "n", "signature", "tokens", F.posexplode(F.arrays_zip("tokens", "places")).alias("at", "e"))
    before = F.slice("tokens", F.greatest(F.col("at") - (BEFORE - 1), F.lit(1)), F.least("at", F.lit(BEFORE)))
    entries = cut(each.select("cid", "n", "signature", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"), before.alias("before")), "entries")
    tried = None
    roots = index.select(F.col("cid").alias("node"), F.col("cid").alias("root"))
    for turn in range(len(PIVOTS) + 1):
        known = entries.drop("before") if turn < len(PIVOTS) else entries
        rows = known.join(roots.withColumnRenamed("node", "cid"), "cid") if turn else known.withColumn("root", F.col("cid"))
        if turn:  # entries of one component only are done
            rows = cut(rows, "rows")
            open_ = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
            rows = rows.join(open_, "token", "left_semi")
        own = rows.select("token", "root", F.struct("n", "cid", "place", "signature", "root").alias("x"), *[c for c in rows.columns if c == "before"])
        if turn < len(PIVOTS):
            # few rarer n-grams before this one, in a new draw for each pivot, alike for all entries
            keys = [F.struct((F.col("x.place") + 1) * (F.pmod(F.xxhash64("x.cid", F.lit(turn), F.lit(k)), F.lit(1024)) + 1024), F.col("x.cid")) for k in range(PIVOTS[turn])]
            pivots = own.groupBy("token").agg(F.array(*[F.min_by("x", k) for k in keys]).alias("ys")).select("token", F.explode("ys").alias("y"))
            met = own.join(pivots, "token").filter("x.root <> y.root").filter(_may_link("x", "y", need))
        else:
            many = own.groupBy("token").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
            own = cut(own.join(many, "token"), "own")
            left = own.withColumn("part", F.pmod(F.xxhash64("x.cid"), F.col("parts")).cast("int"))
            right = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            met = left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.root") < F.col("r.root")) & _may_link("l.x", "r.x", need) & ~F.arrays_overlap("l.before", "r.before")).select(F.col("l.x").alias("x"), F.col("r.x").alias("y"))
        pairs = met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = cut(_verified(pairs, index, need), "links")
        if found.isEmpty():
            continue
        # links join components, so only the components' roots are connected anew
        ends = found.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        roots = cut(roots.join(joined, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")
    return roots


def jaccard_classes(docs: DataFrame, n: int = N, need: int = NEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets are of distinct n-word shingles after lower-casing A-Z; a text of fewer words is one shingle, a text without
    words (or null) has none, links with nothing and is its own component. Rows with equal sets link. component_id is
    the smallest doc_id reachable by links of at least ``need`` percent, null doc_ids aside; a row without links
    keeps its own. Rows that repeat a doc_id are told apart. An empty table gives no rows.
    """
    return linked_rows(docs.select("doc_id", "text", F.lit(0).cast("long").alias("rid")), n, need).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, n: int = N, need: int = NEED) -> DataFrame:
    """``jaccard_classes`` of ``docs`` (doc_id, text, rid: a number of the caller's, passed on) with rid and ``root``, the
    number of the row's component (null: no row is like it)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // BATCH_BYTES))
    texts = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(many)).cast("int").alias("batch"))
    shared = texts.groupBy("batch").applyInArrow(lambda t: _sampled(t, n, many), PACKED).groupBy("bucket").applyInArrow(lambda t: _shared(t), BACK)
    base = cut(texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(lambda t, u: _survivors(t, u, n, need), "rid long, doc_id long, n long, fp binary, set binary"), "base")
    folded = base.filter("set IS NOT NULL").groupBy("fp").agg(F.first("set").alias("set"))
    volume = base.agg(F.sum(F.octet_length("set"))).first()[0] or 0
    some = max(1, -(-volume // SET_BATCH_BYTES))
    sets = cut(folded.select("fp", "set", F.monotonically_increasing_id().alias("cid"), F.pmod(F.xxhash64("fp"), F.lit(some)).cast("int").alias("batch")), "sets")
    counts = sets.select("batch", "set").groupBy("batch").applyInArrow(lambda t: _counted(t, some), PACKED).groupBy("bucket").applyInArrow(lambda t: _shared(t), BACK)
    index = cut(sets.select("batch", "cid", "set").groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(lambda t, u: _indexed(t, u, need), INDEX_SQL), "index")
    roots = class_links(index, need)
    least = base.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = least.join(sets.select("fp", "cid"), "fp").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("fp", "least", F.coalesce("root", "cid").alias("root"))
    classes = cut(classes, "classes")
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return base.join(named, F.col("fp") == F.col("_fp"), "left").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def keep_one_of_each(docs: DataFrame, n: int = N, need: int = NEED) -> DataFrame:
    """The rows of ``docs`` that lead their component (smallest doc_id, null last; one of the rows that share it), and
    those without a like, all columns."""
    rows, row = numbered(docs)
    linked = cut(linked_rows(rows.select("doc_id", "text", F.col(row).alias("rid")), n, need).filter("root IS NOT NULL").select("rid", "doc_id", "root"), "linked")
    lead = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("lead")).select("lead.rid")
    dropped = linked.join(lead, "rid", "left_anti").select(F.col("rid").alias(row))
    return rows.join(dropped, row, "left_anti").select(docs.columns)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


SQL = {
    "op6_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) >= {N}),
        x AS (SELECT doc_id, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS x FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT DISTINCT doc_id, x FROM x WHERE x IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {N - 1}),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * o >= {NEED} * (za.n + zb.n - o)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
        FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a) m USING (doc_id)""",
}
