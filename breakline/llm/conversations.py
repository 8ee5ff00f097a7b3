"""Repair of damaged conversations by a time-major tensor dynamic programme.

A conversation is a row of one-byte codes, one for each turn. Conversations of like length are laid side by side, time
first, and all their states' cheapest costs are updated per turn at once, from the last turn back; the stored costs then
lead the edits forward, again for all conversations at once. A long conversation is cut into blocks that are lanes of
their own: each is solved for every state it may end in, the blocks' small cost matrices are composed, and each block is
traced from every state it may begin in.

Spark deals the rows by conversation, sorts them, and streams them twice: once without texts (a digest and a code a
row), for the edits, and once with texts, which are hashed as they come. No conversation's texts are gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Turns of a lane; a longer conversation is cut into lanes of so many.
LANE = 512
#: Turns that a task lays side by side at once.
PORTION = 200_000
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Characters between words, the sentence ends, roles by initial.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
FINAL = np.array([0, FAR, FAR, 0], np.int64)
#: State after keeping a row of initial s, u, a or another, by state; -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: State after a row's role has been set to what fits, and after an inserted one.
NEXT = np.array([USER, USER, ASSISTANT, USER])
FAULT_BIT, TRUNCATED_BIT, PAD = 4, 8, 16  # beside the initial's two bits


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after damage: with ``copy`` (0, and 1 for a repeat) and ``gone`` (the row is
    dropped, and kept as a mark that its conversation exists). Null roles and texts are one space, and so are null
    conv_ids and turns within the key whose checksum decides."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(what == 1, "").when(what == 2, F.translate(text, ENDS, "")).otherwise(text)
    role = F.when(what == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (what == 0).alias("gone"), (what == 3).alias("_twice"))
    copies = F.when(F.col("_twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode(copies).alias("copy"))


def _named(rows: DataFrame) -> DataFrame:
    """With a digest of role and text, which settles the order of rows of one turn."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)))


def _coded(rows: DataFrame) -> DataFrame:
    """Rows in order with one byte each: initial, fault, truncated."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    last = F.substring(trimmed, -1, 1)
    keys = rows.select("conv_id", "turn", "copy", "gone", "digest", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~last.isin(list(ENDS))).alias("open")).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "gone", "digest").orderBy(F.asc_nulls_first("turn"), "copy")
    return keys.withColumn("again", F.row_number().over(seen) > 1).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "digest", "copy")


def backward(codes: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Cheapest costs to the end, time first: (turns + 1, lanes, states); ``codes`` is (turns, lanes), ``final`` the cost
    of each lane's last states. A padded turn changes nothing."""
    turns, lanes = codes.shape
    out = np.empty((turns + 1, lanes, 4), np.int64)
    out[turns] = _inserted(final)
    for t in range(turns - 1, -1, -1):
        code, later = codes[t], out[t + 1]
        own = later + DELETE
        fit = np.where((code & FAULT_BIT) > 0, FAR, (code & TRUNCATED_BIT) // TRUNCATED_BIT)[:, None]
        after = KEPT[:, code & 3].T
        kept = np.where(after >= 0, np.take_along_axis(later, np.maximum(after, 0), 1), FAR) + KEEP + fit
        rerole = later[:, NEXT] + REROLE + fit
        own = _inserted(np.minimum(np.minimum(own, kept), rerole))
        out[t] = np.where((code & PAD)[:, None] > 0, later, np.minimum(own, FAR))
    return out


def _inserted(own: np.ndarray) -> np.ndarray:
    """Costs by state where rows may be inserted first: at most one or two pay."""
    out = own.copy()
    out[:, USER] = np.minimum(own[:, USER], own[:, ASSISTANT] + INSERT)
    out[:, ASSISTANT] = np.minimum(own[:, ASSISTANT], own[:, USER] + INSERT)
    for state in (START, SYSTEM):
        out[:, state] = np.minimum(own[:, state], out[:, USER] + INSERT)
    return np.minimum(out, FAR)


def forward(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits of each turn, time first, as up to three letters (0: none): two inserts and the row's own; the last turn
    holds the inserts at the end. Of equally cheap ones the least letter comes first. Also each lane's last state."""
    turns, lanes = codes.shape
    letters, each = np.zeros((turns + 1, lanes, 3), np.uint8), np.arange(lanes)
    state = state.copy()
    for t in range(turns + 1):
        ended = t == turns
        later = final if ended else costs[t + 1]
        code = np.full(lanes, PAD) if ended else codes[t]
        live = np.ones(lanes, bool) if ended else (code & PAD) == 0
        for k in range(2):
            own = costs[t][each, state]
            stop = later[each, state] == own if ended else later[each, state] + DELETE == own
            insert = live & ~stop & (costs[t][each, NEXT[state]] + INSERT == own)
            letters[t, insert, k] = ord("I")
            state = np.where(insert, NEXT[state], state)
        if ended:
            break
        own = costs[t][each, state]
        drop = later[each, state] + DELETE == own
        after = KEPT[state, code & 3]
        extra = (code & TRUNCATED_BIT) // TRUNCATED_BIT
        fits = (code & FAULT_BIT) == 0
        keep = ~drop & fits & (after >= 0) & (later[each, np.maximum(after, 0)] + extra + KEEP == own)
        letters[t, :, 2] = np.where(live, np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R"))), 0)
        state = np.where(live & ~drop, np.where(keep, after, NEXT[state]), state)
    return letters, state


def repaired(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and audit of each conversation's codes, those of like length side by side."""
    out: list = [None] * len(conversations)
    short = [i for i, c in enumerate(conversations) if len(c) <= LANE]
    by_size: dict[int, list[int]] = {}
    for i in short:
        by_size.setdefault(int(len(conversations[i])).bit_length(), []).append(i)
    for own in by_size.values():
        turns = max(len(conversations[i]) for i in own)
        codes = np.full((turns, len(own)), PAD, np.int64)
        for lane, i in enumerate(own):
            codes[: len(conversations[i]), lane] = conversations[i]
        final = np.repeat(FINAL[None], len(own), 0)
        costs = backward(codes, final)
        letters, _ = forward(codes, costs, np.zeros(len(own), np.int64), final)
        by_lane = letters.transpose(1, 0, 2)
        for lane, i in enumerate(own):
            found = by_lane[lane].ravel()
            out[i] = int(costs[0, lane, START]), found[found > 0].tobytes().decode()
    for i in range(len(conversations)):
        if out[i] is None:
            out[i] = _long(conversations[i])
    return out


def _long(codes: np.ndarray) -> tuple[int, str]:
    """The same for one conversation of several lanes."""
    blocks = -(-len(codes) // LANE)
    lanes = np.full((blocks * LANE,), PAD, np.int64)
    lanes[: len(codes)] = codes
    lanes = lanes.reshape(blocks, LANE).T
    # cost from each first state to each last one: without inserts at a border, which belong to the block after it
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)
    matrix = np.stack([backward(lanes, np.repeat(ends[j][None], blocks, 0))[0] for j in range(4)], 2)
    border = np.empty((blocks + 1, 4), np.int64)
    border[blocks] = _inserted(FINAL[None])[0]
    for b in range(blocks - 1, -1, -1):
        border[b] = np.minimum((matrix[b] + border[b + 1]).min(1), FAR)
    final = border[1:]
    costs = backward(lanes, final)
    raw = np.where(np.arange(blocks)[:, None] == blocks - 1, FINAL, final)
    traced = [forward(lanes, costs, np.full(blocks, s), raw) for s in range(4)]
    state, parts = START, []
    for b in range(blocks):
        letters, last = traced[state]
        found = letters[:, b].ravel() if b == blocks - 1 else letters[:-1, b].ravel()
        parts.append(found[found > 0].tobytes())
        state = int(last[b])
    return int(border[0, START]), b"".join(parts).decode()


EDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _runs(batches) -> Iterator[tuple[int | None, bool, pa.RecordBatch]]:
    """Sorted batches cut where conv_id changes: id, whether it begins here, rows."""
    last, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        values, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (null[1:] != null[:-1])])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
            key = ids[a].as_py()
            yield key, not begun or key != last, batch.slice(a, b - a)
            last, begun = key, True


class _Facts:
    """What one conversation's rows add up to, piece by piece."""

    def __init__(self, key):
        self.key, self.codes, self.blank, self.duplicate, self.truncated, self.illegal = key, [], 0, 0, 0, 0
        self.least = self.most = self.turn = None
        self.turns, self.initial = 0, None

    def add(self, rows: pa.RecordBatch) -> None:
        rows = rows.filter(pc.invert(rows.column("gone")))
        if not rows.num_rows:
            return
        blank, again, open_ = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("blank", "again", "open"))
        initials = rows.column("initial").to_pylist()
        kind = np.array([{"s": 0, "u": 1, "a": 2}.get(x, 3) for x in initials])
        twice, cut_ = again & ~blank, open_ & ~blank & ~again
        self.codes.append((kind | np.where(blank | twice, FAULT_BIT, 0) | np.where(cut_, TRUNCATED_BIT, 0)).astype(np.uint8))
        self.blank, self.duplicate, self.truncated = self.blank + int(blank.sum()), self.duplicate + int(twice.sum()), self.truncated + int(cut_.sum())
        before = np.r_[kind[:1] if self.initial is None else [self.initial], kind[:-1]]
        legal = ((before == 0) | (before == 2)) & (kind == 1) | (before == 1) & (kind == 2)
        self.illegal += int((~legal[1 if self.initial is None else 0 :]).sum())
        self.initial = int(kind[-1])
        turns = rows.column("turn").drop_null().to_numpy(zero_copy_only=False)
        if len(turns):
            self.turns += int((turns[1:] != turns[:-1]).sum()) + (self.turn is None or self.turn != int(turns[0]))
            self.least, self.most = int(turns[0]) if self.least is None else self.least, int(turns[-1])
            self.turn = self.most

    @property
    def gaps(self) -> int:
        return self.most - self.least + 1 - self.turns if self.turns else 0


def _edits(batches):
    waiting: list[_Facts] = []
    size = 0

    def out() -> pa.RecordBatch:
        found = repaired([np.concatenate(f.codes) if f.codes else np.zeros(0, np.uint8) for f in waiting])
        numbers = [[f.key for f in waiting], [f.gaps for f in waiting], [f.blank for f in waiting], [f.duplicate for f in waiting], [f.truncated for f in waiting], [f.illegal for f in waiting], [c for c, _ in found]]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in numbers], pa.array([a for _, a in found], pa.string())], [c.split()[0] for c in EDITS.split(", ")])

    for key, new, rows in _runs(batches):
        if new:
            if size >= PORTION:
                yield out()
                waiting, size = [], 0
            waiting.append(_Facts(key))
        waiting[-1].add(rows)
        size += rows.num_rows
    if waiting:
        yield out()


class _Text:
    """The repaired text of one conversation, hashed as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, START, hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = int(NEXT[self.state]), self.at + 1
            self.line(ROLES["u" if self.state == USER else "a"], "")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = int(KEPT[self.state, {"s": 0, "u": 1, "a": 2}[role[0]]])
            self.line(role, text)
        elif edit == "R":
            self.state = int(NEXT[self.state])
            self.line(ROLES["u" if self.state == USER else "a"], text)

    def end(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _hashed(batches):
    ids, hashes, own = [], [], None
    for key, new, rows in _runs(batches):
        if new:
            if own is not None:
                hashes.append(own.end())
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
                ids, hashes = [], []
            own = _Text(rows.column("audit")[0].as_py())  # the mark with the edits sorts first
            ids.append(key)
        for audit, role, text in zip(*[rows.column(c) for c in ("audit", "role", "text")], strict=True):
            if not audit.is_valid:
                own.add(role.as_py(), text.as_py())
    if own is not None:
        hashes.append(own.end())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (those of ``damaged``): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows stand by turn (nulls first); rows of one turn by a digest of role and text, a repeat next to its original. A
    null conv_id is a conversation like others. Blank and repeated rows are deleted; roles but system, user and
    assistant (by their initials) are set anew or deleted. A conversation without rows has zeros, an empty audit and the
    hash of nothing; an empty table gives no rows. The largest conversation's rows pass through one task (without texts
    about fifty bytes each, sorted by Spark; its codes, one byte each, are held), since its hash reads them in order.
    """
    named = _named(rows)
    edits = cut(_coded(named).mapInArrow(_edits, EDITS), "edits")
    null = lambda kind: F.lit(None).cast(kind)
    marks = edits.select("conv_id", null("long").alias("turn"), null("int").alias("copy"), null("binary").alias("digest"), null("string").alias("role"), null("string").alias("text"), "audit")
    texts = named.filter("NOT gone").select("conv_id", "turn", "copy", "digest", "role", "text", null("string").alias("audit"))
    both = marks.union(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "digest", "copy")
    hashes = both.select("conv_id", "audit", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    return edits.join(hashes.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
