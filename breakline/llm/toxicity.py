"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding maps look-alike letters of other scripts and digits written for letters to the letter meant, and everything
between words to one space. The lexicon holds words and beginnings of words with the log-odds that labelled toxic
documents have them. Exceptions count nothing: words that start like an entry but stand in clean documents, and phrases
of two words around an entry (one before or after it) that do.
The lexicon is learned from a bounded sample of labelled rows (``SAMPLE``), counted by Spark with the counts of each
batch summed before the shuffle; scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Labelled rows that the lexicon and the two curves are fitted on, at most: those with the smallest hashed doc_ids.
SAMPLE = 16_000
#: Toxic documents that an entry must stand in (and their share), log-odds it must reach, and clean documents and log-odds
#: of an exception.
SUPPORT = 4
SHARE = 0.005
ODDS = 2.5
CLEAN = 2
CLEAN_ODDS = 1.0
PREFIXES = (4, 5, 6, 7, 8)

#: Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝвкмнтгλαβεηικνορτυχɑɡｏ", "aeopcyxijsdhqwbkmhtrlabenikvoptuxago", strict=True))
DIGITS = dict(zip("0134578@$", "oieastbas", strict=True))


def folding() -> dict[int, str]:
    out = {c: " " for c in range(128) if not chr(c).isalnum()}
    out |= {ord(c): x for c, x in LOOKALIKES.items()} | {ord(c): x for c, x in DIGITS.items()}
    return out | {ord("'"): "", 0x2019: "", 0x200B: "", 0x200C: "", 0x200D: "", 0xAD: ""}


FOLD = folding()


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def spaced(text: str) -> str:
    """Folded words with a space before, between and after them."""
    return " " + " ".join(fold(text).split()) + " "


def features(words: set[str]) -> set[str]:
    """Whole words as "word " and their beginnings as "word"."""
    out = {w + " " for w in words if len(w) > 2}
    for n in PREFIXES:
        out |= {w[:n] for w in words if len(w) >= n}
    return out


def _counted(batches, found_in):
    for batch in batches:
        docs, toxic = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = found_in(text or "")
            docs.update(found)
            if label:
                toxic.update(found)
        names = list(docs)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[k] for k in names], pa.int64()), pa.array([toxic[k] for k in names], pa.int64())], ["feature", "docs", "toxic"])


@dataclass
class Model:
    """``entries``: folded word beginnings ("word" or whole "word ") and weights; 0 for exceptions. ``curve``: the
    weights of the logistic curve over (strength, density, length)."""

    entries: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)
    prior: float = 0.1

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            a.add_word(" " + entry, (len(entry), weight, entry.find(" ", 0, -1) + 1))
        if self.entries:
            a.make_automaton()
        return a

    def hits(self, folded: str, a) -> dict[int, float]:
        """Weights by the place before each word hit. At a word the longest entry decides; an exception phrase clears
        both of its words."""
        at: dict[int, tuple[int, float]] = {}
        clear: set[int] = set()
        for end, (n, weight, second) in a.iter(folded):
            start = end - n
            if second:
                clear |= {start, start + second}
            elif start not in at or at[start][0] < n:
                at[start] = n, weight
        return {start: weight for start, (_, weight) in at.items() if weight > 0 and start not in clear}

    def describe(self, text: str, a) -> tuple[float, int, int]:
        """Sum of weights, number of hits, number of words."""
        folded = spaced(text)
        words = folded.count(" ") - 1 if folded != "  " else 0
        found = self.hits(folded, a) if self.entries and words else {}
        return sum(found.values()), len(found), words

    def phrases(self, text: str, a) -> set[str]:
        """The word pairs around each hit of a text."""
        folded, out = spaced(text), set()
        for start in self.hits(folded, a) if self.entries else ():
            end = folded.index(" ", start + 1)
            if end + 1 < len(folded):
                out.add(folded[start + 1 : folded.index(" ", end + 1) + 1])
            if start:
                out.add(folded[folded.rindex(" ", 0, start) + 1 : end + 1])
        return out

    def score(self, strength: float, hits: int, words: int) -> float:
        x = inputs(strength, hits, words)
        z = sum(c * v for c, v in zip(self.curve, x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def inputs(strength: float, hits: int, words: int) -> tuple[float, ...]:
    """Intercept, strength of the hits, their weight per word (the normalisation by length), logarithm of the length."""
    return 1.0, math.log1p(strength), min(1.0, 10 * strength / max(10.0, math.sqrt(words) * 10)), math.log1p(words) / 10


def log_odds(docs: Column, toxic: Column, n: int, n_toxic: int) -> Column:
    """Smoothed, against those of all labelled rows."""
    return F.log((toxic + 0.1) / (docs - toxic + 0.1)) - math.log((n_toxic + 0.5) / (n - n_toxic + 0.5))


def lexicon(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """Entries from (feature, toxic docs, log-odds), widest first, without those that another implies."""
    out: dict[str, float] = {}
    for f, _, odds in sorted(rows, key=lambda r: (-r[1], len(r[0]), r[0])):
        if not any(f[:k] in out for k in range(min(PREFIXES), len(f))):
            out[f] = odds
    return out


def fit_curve(x, y, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out. Without toxic labels: no entries.

    Labels with a null doc_id or a null ``toxic`` are left out; of repeated labels the largest counts; a null text is
    empty.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two integers
    rows = cut(rows.select("text", "toxic"), "labelled")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return Model(prior=0.0 if not n_toxic else 1.0, curve=(-4.0 if not n_toxic else 4.0, 0.0, 0.0, 0.0))
    odds = log_odds(F.col("docs"), F.col("toxic"), n, n_toxic)
    counted = lambda found_in: rows.mapInArrow(lambda b: _counted(b, found_in), "feature string, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    counts = cut(counted(lambda text: features(set(fold(text).split()))).filter("docs >= 2"), "features")
    # what reaches the driver are features of the bounded sample that clear the bars
    good = counts.filter((F.col("toxic") >= max(SUPPORT, SHARE * n_toxic)) & (odds >= ODDS)).select("feature", "toxic", odds).collect()
    model = Model(lexicon([tuple(r) for r in good]), prior=n_toxic / n)
    clean = (F.col("docs") - F.col("toxic") >= CLEAN) & (odds < CLEAN_ODDS)
    begins = [(e,) for e in model.entries if not e.endswith(" ")]
    if begins:
        heads = counts.filter(F.col("feature").endswith(" ") & clean).select("feature", F.explode(F.array(*[F.substring("feature", 1, k) for k in PREFIXES])).alias("head"))
        model.entries |= {r[0]: 0.0 for r in heads.join(docs.sparkSession.createDataFrame(begins, "head string"), "head").select("feature").distinct().collect()}
    if model.entries:
        first = model

        def around(text: str) -> set[str]:
            return first.phrases(text, _automaton(first))

        model = Model(first.entries | {r[0]: 0.0 for r in counted(around).filter(clean).select("feature").collect()}, prior=first.prior)
    described = rows.mapInArrow(lambda b: _described(b, model, ("toxic",)), "toxic int, strength double, hits int, words int").collect()  # at most ``sample`` rows of numbers
    model.curve = fit_curve([inputs(r["strength"], r["hits"], r["words"]) for r in described], [r["toxic"] for r in described])
    return model


_built: dict[int, tuple] = {}


def _automaton(model: Model):
    """A model's automaton, built once per worker."""
    if id(model) not in _built:
        _built.clear()
        _built[id(model)] = model, model.automaton()
    return _built[id(model)][1]


def _described(batches, model: Model, keep: tuple[str, ...], scored: bool = False):
    a = model.automaton()
    for batch in batches:
        found = [model.describe(t.as_py() or "", a) for t in batch.column("text")]
        columns = [batch.column(k) for k in keep] + [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())]
        names = [*keep, "strength", "hits", "words"]
        if scored:
            scores = [model.score(*f) for f in found]
            columns += [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            names += ["score", "predicted"]
        if "toxic" in keep:
            columns[0] = columns[0].cast(pa.int32())
        yield pa.RecordBatch.from_arrays(columns, names)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, hits, words.

    A null text scores as an empty one. Nothing but the text enters the score; equal texts score alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(lambda b: _described(b, model, ("doc_id", "held_out"), scored=True), "doc_id long, held_out boolean, strength double, hits int, words int, score double, predicted int")
    return out.select("doc_id", "held_out", "score", "predicted", "hits", "words")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``least``, all columns, in one pass without a join."""

    def kept(batches):
        a = model.automaton()
        for batch in batches:
            scores = [model.score(*model.describe(t.as_py() or "", a)) for t in batch.column("text")]
            yield batch.filter(pa.array([s < least for s in scores], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
