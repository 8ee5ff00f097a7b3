r"""Substring dedup on words: words of windows that stand earlier in the corpus are removed.

Which windows are equal is decided by compressed FM-indexes, one for each batch and one for each shard of stretches that
batches share: the runs of the words' Burrows-Wheeler transform with a wavelet tree over them. Texts are streamed through
the index by backward search, from a table of the first eight words' intervals on, which gives their matching statistics:
from each word on, how many words stand elsewhere too. A content of several copies is indexed and streamed once. Places
of 20 or more are reported with their interval; all windows that end in one interval are its places, and those with an
earlier one go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import KEY_BITS, M1, Batch, mixed, remove_repeats, spans
from .suffix_dedup import removed

LENGTH = 20
GRAM = 8
#: The six bytes that part words, each made a space.
SPACES = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


#: Bytes of text hashed at once: tables and sums stay small, whatever the batch (a longer word is hashed whole).
CHUNK = 1 << 18
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(x))]) for x in (int(M1), pow(int(M1), -1, 2**64))]
    return _powers


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes between each begin and end, from prefix sums over chunks of whole words."""
    out, first = np.zeros(len(begins), np.uint64), 0
    while first < len(begins):
        start = int(begins[first])
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        b, e = begins[first:last] - start, ends[first:last] - start
        power, back = powers(int(e[-1]))
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((raw[start : start + int(e[-1])].astype(np.uint64) + np.uint64(1)) * power[: int(e[-1])], out=total[1:])
        out[first:last] = mixed((total[e] - total[b]) * back[b])
        first = last
    return out


def word_bounds(data: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of words in texts of these lengths that spaces part and surround, and each text's first word."""
    space = np.frombuffer(data, np.uint8) == 32
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins, ends = turns[::2], turns[1::2]
    return begins, ends, np.searchsorted(begins, np.r_[0, np.cumsum(np.array(lengths, np.int64) + 1)] + 1)


def word_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (past the end: of fewer)."""
    grams = hashes
    for k in range(1, n):
        grams = mixed(grams * M1 + np.r_[hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)])
    return grams


class Words(Batch):
    r"""Words ``[^\x20\x09-\x0D]+``, laid end to end with one space after each."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        raw = np.frombuffer(b" ".join([*texts, b""]).translate(SPACES), np.uint8)
        word = raw != 32
        last = np.flatnonzero(word[:-1] & ~word[1:])  # of each word; a space follows every text
        starts = np.searchsorted(last, np.r_[0, np.cumsum([len(t) + 1 for t in texts])])
        word[last + 1] = True  # one space after each word stays
        raw = raw[word]
        self.data = raw.tobytes()
        self.ends = np.flatnonzero(raw == 32)
        self.begins = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        n = len(self.ends)
        h = word_hashes(raw, self.begins, self.ends)
        for s in (1, 2, 4):  # eight words
            h = mixed(h * M1 + np.r_[h[s:], np.zeros(min(s, n), np.uint64)])
        self.gram = h
        super().__init__(ids, starts, (mixed(h) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))

    def key(self, at: np.ndarray) -> np.ndarray:
        return self.gram[at] & KEY_BITS

    def content(self, a: int, b: int) -> bytes:
        return self.data[self.begins[a] : self.ends[b - 1]]

    merged = True

    @staticmethod
    def symbols(content: bytes) -> int:
        return content.count(b" ") + 1

    def kept(self, t: int, gone: np.ndarray) -> bytes:
        a, b = int(self.starts[t]), int(self.starts[t + 1])
        if a == b:
            return b""
        whole = self.data[self.begins[a] : self.ends[b - 1]]
        return whole if not gone.any() else b" ".join(w for w, g in zip(whole.split(b" "), gone.tolist(), strict=True) if not g)


class BitVector:
    """Bits in words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), "<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletTree:
    """Ranks of symbols in a sequence: a level of bits for each bit of the symbols, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), int(len(symbols) - ones.sum())))
            symbols = np.r_[symbols[~ones], symbols[ones]]
        self.begin = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            up = ones.rank(i)
            i = np.where(symbol >> bit & 1, zeros + up, i - up)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i."""
        return self._walk(symbol, i) - self.begin[symbol]


class FMIndex:
    """A shard's words, compressed: the runs of their Burrows-Wheeler transform with a wavelet tree over the runs' words.
    0 ends each content and is never searched for. Suffixes are sorted over ``depth`` words; longer patterns are not
    asked for, and the suffix array itself isn't kept. A table holds the intervals of the text's first few words from
    each place on, so that searches need not begin with one word, whose interval is large."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        ids, d = [text.astype(np.int64)], 1
        names = [(ids[0], 1)]
        while d < depth:  # each round reads the names of the one before at a later place
            step = min(d, depth - d)
            at = np.minimum(np.arange(n) + step, n)
            later = np.r_[names[-1][0] + 1, 0][at]
            _, name = np.unique(names[-1][0] * (n + int(text.max()) + 2) + later, return_inverse=True)
            d += step
            names.append((name, d))
        seed, self.seed = next(x for x in reversed(names) if x[1] <= SEED and x[1] < depth)
        self.seeds, self.seed_bound = seed.astype(np.int32), np.r_[0, np.cumsum(np.bincount(seed))]
        order = np.argsort(names[-1][0], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.zeros(n - 1, np.int64)
        for name, size in reversed(names):  # words that neighbours share: the largest size that agrees, then what follows
            fits = (a + size <= n) & (b + size <= n) & (same + size < depth)
            fits &= name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)]
            same += np.where(fits, size, 0)
            a += np.where(fits, size, 0)
            b += np.where(fits, size, 0)
        new = np.r_[True, same < depth - 1]
        self.group = np.cumsum(new, dtype=np.int32) - 1  # of suffixes that share all words but one of a pattern
        self.bound = np.r_[np.flatnonzero(new), n]
        last = text[order - 1]
        self.n, self.smaller = n, np.r_[0, np.cumsum(np.bincount(text))]
        begins = np.r_[True, last[1:] != last[:-1]]
        self.starts, self.begun = np.flatnonzero(begins), BitVector(begins)
        self.words = last[self.starts]
        lengths = np.diff(np.r_[self.starts, n])
        by = np.argsort(self.words, kind="stable")
        self.total = np.r_[0, np.cumsum(lengths[by])]  # places in the runs before a run, word by word
        self.runs = np.r_[0, np.cumsum(np.bincount(self.words, minlength=len(self.smaller) - 1))]
        self.tree = WaveletTree(self.words, int(text.max()))

    def occurrences(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each word stands among the first i of the transform."""
        run = self.begun.rank(i + 1) - 1
        k = self.runs[word]
        before = self.total[k + self.tree.rank(word, run)] - self.total[k]
        return before + np.where(self.words[run] == word, i - self.starts[run], 0)

    def extended(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the matches with one more word in front."""
        both = self.occurrences(np.r_[word, word], np.r_[low, high])
        return self.smaller[word] + both[: len(word)], self.smaller[word] + both[len(word) :]

    def matching(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the lanes text[begin:end], streamed from the right, held at ``depth`` words: the
        places from which that many words stand ``least`` times in the index or more, with their lane and the
        interval's start.

        A lane's match grows to the left. One of ``depth`` words is reported and goes on without its last word; where
        a match can't grow, no longer one ends at this place, and the search begins anew one word before. It begins
        with the table's interval of the words before that place.
        """
        live = np.flatnonzero(end - begin >= self.depth)
        lane, begin, stop, least = live, begin[live], end[live], least[live]
        left, low, high = stop.copy(), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        fresh, found = np.arange(len(live)), []
        while len(lane):
            while len(fresh):  # places whose last words stand less often are passed over
                left[fresh] = stop[fresh] - self.seed
                seed = self.seeds[left[fresh]]
                low[fresh], high[fresh] = self.seed_bound[seed], self.seed_bound[seed + 1]
                fresh = fresh[high[fresh] - low[fresh] < least[fresh]]
                stop[fresh] -= 1
                fresh = fresh[stop[fresh] - begin[fresh] >= self.depth]
            on = stop - begin >= self.depth
            if not on.all():
                lane, begin, stop, least, left, low, high = (x[on] for x in (lane, begin, stop, least, left, low, high))
            low, high = self.extended(text[left - 1], low, high)
            met = high - low >= least
            left = left - met
            full = met & (stop - left == self.depth)
            if full.any():
                found.append((lane[full], left[full], low[full]))
                group = self.group[low[full]]
                low[full], high[full] = self.bound[group], self.bound[group + 1]
            stop = stop - (full | ~met)
            fresh = np.flatnonzero(~met & (stop - begin >= self.depth))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


#: Words of the table that searches begin with.
SEED = 8
#: Windows of a lane: lanes are streamed side by side, each from ``length - 1`` words behind its last window on.
LANE = 16


def window_classes(contents: list[bytes], copies: np.ndarray | None = None, length: int = LENGTH) -> np.ndarray:
    """For each window of the contents, one after another: its interval in the index of all, -1 where it stands alone.
    A content is indexed once, however many copies there are; where there are several, no window stands alone."""
    if not contents:
        return np.zeros(0, np.int64)
    sizes = np.array([Words.symbols(c) for c in contents], np.int64)
    words = pc.split_pattern(pa.array([b" ".join(contents)], pa.large_binary()), " ").values.dictionary_encode()
    text = np.zeros(len(words) + len(contents), np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(contents)), sizes)] = words.indices.to_numpy() + 1
    index = FMIndex(text, length)
    many = sizes - length + 1
    lanes = -(-many // LANE)
    owner = np.repeat(np.arange(len(sizes)), lanes)
    begins = np.cumsum(sizes + 1) - sizes - 1
    begin = begins[owner] + spans(np.zeros(len(sizes), np.int64), lanes) * LANE
    end = np.minimum(begin + LANE + length - 1, (begins + sizes)[owner])
    least = np.full(len(owner), 2) if copies is None else np.where(copies > 1, 1, 2)[owner]
    lane, place, first = index.matching(text, begin, end, least)
    own = owner[lane]
    classes = np.full(int(many.sum()), -1, np.int64)
    classes[(np.cumsum(many) - many)[own] + place - begins[own]] = first
    return classes


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, starts, ends (removed runs of words), kept (the rest, bytes).

    A null text has no words. A word goes when a window of 20 words over it also starts earlier: in a row with a
    smaller doc_id (null: larger than all), or earlier in the same row; windows are judged on the input. Rows that repeat
    a doc_id (or have none) are read as one document: the window that starts at the smaller word is the earlier one.
    """
    return remove_repeats(docs, LENGTH, GRAM, Words, window_classes, same_text=True).withColumnRenamed("n_symbols", "n_words")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


_NEXT = ", ".join(f"lead(word, {k}) OVER w" for k in range(1, LENGTH))
SQL = {
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        x AS (SELECT doc_id, i, word, CASE WHEN lead(word, {LENGTH - 1}) OVER w IS NOT NULL THEN concat_ws(' ', word, {_NEXT}) END AS x FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, word, (x IS NOT NULL AND row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1)::INTEGER AS again FROM x),
        c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM g),
        k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
