r"""Exact token counts at every prefix, by dynamic programming over a BPE vocabulary.

For BPE the last token of the encoding of a prefix is the only vocabulary piece that ends there and whose pair with
the last token of the shorter prefix survives encoding. So the count at a prefix is the count at the prefix that the
last token leaves, plus one: a table that answers truncation and budget questions without encoding again.

No piece of the vocabulary spans the border before a space (or an unknown character such as a line feed), so counts
add up over pieces of text between such borders, and a table is made once per distinct piece and worker. The work is
one pass over the rows, without a shuffle.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Memory bounds of a worker, without effect on counts: longest piece of text whose count is remembered (a text without
#: spaces is one piece), bytes of remembered pieces with what each entry takes, and remembered pairs of tokens.
REMEMBERED_LENGTH, REMEMBERED_BYTES, ENTRY_BYTES = 48, 240_000_000, 160
REMEMBERED_PAIRS = 300_000


class Ring(list):
    """The latest of many entries by their place."""

    def __getitem__(self, i):
        return super().__getitem__(i % len(self))

    def __setitem__(self, i, value):
        super().__setitem__(i % len(self), value)


class PrefixCounter:
    """Counts of a sentencepiece BPE model with byte fallback, dummy prefix and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space after another character: counts would not add up over words")
        inside = {c for p in self.rank for c in p}
        self.breaks = "".join(c for c in "\n\t\r" if c not in inside)
        self.pieces = re.compile(f"[{self.breaks}]|{SPACE}*[^{SPACE}{self.breaks}]+|{SPACE}+" if self.breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        #: What can be the last token: every piece that encodes to itself, and every single character.
        self.tokens = {p for p in self.rank if len(p) == 1 or self.encode(p) == [p]} | inside
        self.ends = {p[i:] for p in self.tokens for i in range(len(p))}
        self.longest = max(map(len, self.ends), default=1)
        self.counts: dict[str, int] = {}
        self.held = 0

    def encode(self, piece: str) -> list[str]:
        """BPE by repeatedly merging the best-ranked pair, leftmost first: for the short strings that pairs make."""
        out = list(piece)
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: (self.rank.get(out[i] + out[i + 1], 1e18), i))
            if out[best] + out[best + 1] not in self.rank:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def prefixes(self, piece: str) -> list[int] | array:
        """Token counts of piece[:0], piece[:1], ..., piece[:n]."""
        rank, ends, tokens, pairs, n = self.rank, self.ends, self.tokens, self.pairs, len(piece)
        if n <= REMEMBERED_LENGTH:
            count, last = [0] * (n + 1), [""] * (n + 1)
        else:  # last tokens of as many prefixes as a token can span
            count, last = array("q", bytes(8 * (n + 1))), Ring([""] * (self.longest + 1))
        for j in range(1, n + 1):
            i, found = j - 1, []
            token = piece[i:j]
            while token in ends:  # as long as some piece ends like this
                if token in tokens:
                    found.append((i, token))
                if not i:
                    break
                i -= 1
                token = piece[i:j]
            if not found:  # no piece has this character: one token per byte
                found.append((j - 1, piece[j - 1]))
            for i, token in reversed(found):
                if i:
                    pair = last[i], token
                    if (fits := pairs.get(pair)) is None:
                        if len(pairs) >= REMEMBERED_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.encode(pair[0] + token) == [*pair]
                    if not fits:
                        continue
                last[j] = token
                count[j] = count[i] + (1 if token in rank else self.cost(token))
                break
        return count

    def cost(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode("utf-8", "surrogatepass"))

    def split(self, text: str) -> list[str]:
        return self.pieces.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def sums(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a text and the count of each."""
        pieces, counts, out = self.split(text), self.counts, []
        for p in pieces:
            if (c := counts.get(p)) is None:
                c = self.prefixes(p)[-1]
                if len(p) <= REMEMBERED_LENGTH:
                    self.held += ENTRY_BYTES + 4 * len(p)
                    if self.held > REMEMBERED_BYTES:
                        counts.clear()
                        self.held = ENTRY_BYTES + 4 * len(p)
                    counts[p] = c
            out.append(c)
        return pieces, out

    def count(self, text: str) -> int:
        return sum(self.sums(text)[1])

    def at_every_prefix(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ..., text[:n]."""
        out, total = [0], 0
        for p in self.split(text):
            own = self.prefixes(p)
            out += [total + c for c in own[1:]]
            total += own[-1]
        return [0, *out[2:]] if text else [0]  # the first entry belongs to the dummy prefix

    def longest_within(self, pieces: list[str], counts: list[int], budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        total = at = 0
        for k, c in enumerate(counts):
            if total + c > budget:
                last = k
                break
            total, at = total + c, at + len(pieces[k])
        else:
            return max(0, at - 1)
        # a prefix that ends inside a later piece can only fit while the pieces before it do
        own = self.prefixes(pieces[last])
        best = max(j for j, c in enumerate(own) if total + c <= budget)
        return max(0, at + best - 1)


_counter: dict[str, PrefixCounter] = {}


def counter(path: str | None) -> PrefixCounter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _counter:
        _counter[path] = PrefixCounter(str(path))
    return _counter[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, limit_chars.

    ``n_tokens`` is the library's count of the whole text without added tokens; ``limit_chars`` the length of the
    longest prefix within ``limit`` tokens. A null or empty text has no tokens. Any number of rows may share a doc_id.
    """

    def counted(batches):
        own = counter(path)
        for batch in batches:
            tokens, chars = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                pieces, counts = own.sums(text)
                tokens.append(total := sum(counts))
                chars.append(len(text) if total <= limit else own.longest_within(pieces, counts, limit))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array(chars, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
