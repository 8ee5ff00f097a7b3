"""Whitening, conversation repair and language-model scores against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from breakline.llm import conversations, lm_score, whitening

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- whitening --------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    """With extra columns whose names the operator might use itself."""
    return spark.createDataFrame([(i, v, 1, [9.0], 7) for i, v in rows], "vec_id long, embedding array<float>, line int, v array<float>, n int")


def brute_whitening(rows, d):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = (x - s / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], n, deviation, centred, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [1, 3, 40])
def test_whitening_equals_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    rows = [(k % 190, (rng.normal(size=d) * np.linspace(1, 5, d)).tolist()) for k in range(200)]
    rows += [(500, None), (501, [None] * d), (502, [float("nan")] * d), (503, [float("inf")] * d), (504, []), (505, [1.0] * (d + 1)), (None, [0.5] * d), (None, [0.5] * d)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    ids, n, deviation, centred, e, u = brute_whitening(rows, d)
    k = min(32, d)
    assert len(got) == n * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = collections.defaultdict(list)
    for r in got:
        by[r.component].append((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened, r.explained))
    for c in range(1, k + 1):
        z = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
        want = [(-1 if i is None else i, int(dev), float(w)) for i, dev, w in zip(ids, deviation, z, strict=True)]
        sign = 1 if abs(sum(g[2] for g in sorted(by[c]) if g[0] == 5) - sum(w[2] for w in sorted(want) if w[0] == 5)) < 1e-6 else -1
        a, b = sorted((i, dev, round(w, 6)) for i, dev, w, _ in by[c]), sorted((i, dev, round(sign * w, 6)) for i, dev, w in want)
        assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-6)
        assert abs(by[c][0][3] - e[c - 1] / e.sum()) < 1e-9


def test_whitening_of_flat_directions_and_of_nothing(spark):
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 5.0]), (3, [1.0, 2.0, 3.0])])).collect()
    assert len(got) == 9 and {r.whitened for r in got if r.component > 1} == {0.0} and {r.explained for r in got if r.component == 1} == {1.0} and all(r.identity_error < 1e-12 for r in got)
    assert {r.whitened for r in whitening.whiten(vectors(spark, [(1, [4.0, 4.0])])).collect()} == {0.0}
    assert whitening.whiten(vectors(spark, [])).collect() == [] == whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect()
    odd = whitening.whiten(vectors(spark, [(1, [1e30]), (2, [-1e30]), (3, [0.0])])).collect()
    assert len(odd) == 3 and all(math.isfinite(r.whitened) for r in odd) and {r.deviation for r in odd if r.vec_id == 1} == {None}


def test_jacobi_keeps_small_eigenvalues():
    e, q = whitening.jacobi(np.diag([1e-12, 1.0, 1e6]) + 1e-9 * np.ones((3, 3)))
    assert np.allclose(q.T @ q, np.eye(3), atol=1e-14)
    hilbert = 1 / (np.arange(6)[:, None] + np.arange(6) + 1)
    e, q = whitening.jacobi(hilbert)
    assert (e[:-1] > e[1:]).all() and abs(e[-1] / 1.082799484565550e-07 - 1) < 1e-8 and np.allclose(q @ np.diag(e) @ q.T, hilbert, atol=1e-15)


# --- conversations ----------------------------------------------------------------------------------------------------


def brute_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, what = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        out[conv] += []
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out[conv] += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits by carrying every state's (cost, audit, lines) forward; among equals the least audit."""
    seen, faults = set(), []
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for c in "ua":
                    if (state, c) in step:
                        best[c] = min(best.get(c, (10**9,)), (cost + 2, audit + "I", [*lines, f"{names[c]}:"]))
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in best.items():
            offers = [(state, cost + 3, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                own = cost + (fault == "truncated")
                if (state, role[:1]) in step:
                    offers.append((step[state, role[:1]], own, audit + "K", [*lines, f"{role}:{text}"]))
                offers += [(c, own + 2, audit + "R", [*lines, f"{names[c]}:{text}"]) for c in "ua" if (state, c) in step]
            for to, *offer in offers:
                new[to] = min(new.get(to, (10**9,)), tuple(offer))
        best = inserted(new)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = ["".join(r[:1] for _, r, _ in rows[k : k + 2]) for k in range(len(rows) - 1)]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def conversation_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, copy int, gone int")


def assert_repaired(spark, rows):
    got = {r.conv_id: r.asDict() for r in conversations.repair(conversations.damaged(conversation_rows(spark, rows))).collect()}
    want = brute_damage(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        expected = brute_repair(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))
        assert {k: got[conv][k] for k in expected} == expected, conv


def test_repair_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert_repaired(spark, rows)


@pytest.mark.parametrize("lane", [512, 3])
def test_repair_of_odd_and_long_conversations(spark, monkeypatch, lane):
    monkeypatch.setattr(conversations, "LANE", lane)
    rng = np.random.default_rng(5)
    texts, roles = ["Yes.", "No", "What?", "", " \n", "end!  ", "Yes."], ["user", "assistant", "system", "tool", "", "User", "assistant", "user"]
    rows = [(c, t, roles[rng.integers(len(roles))], f"{texts[rng.integers(len(texts))]}") for c in range(60) for t in range(int(rng.integers(1, 14)))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (901, None, "user", "Hi."), (902, None, None, None), (902, 5, None, "x."), (903, 1, "system", None), (904, 10**15, "user", "far " * 30_000 + "."), (904, 5, "system", "near.")]
    assert_repaired(spark, rows)


def test_repair_of_nothing(spark):
    assert conversations.repair(conversations.damaged(conversation_rows(spark, []))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = conversations.repair(conversations.damaged(conversation_rows(spark, [(1, gone, "user", "Hi.")]))).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- language-model scores --------------------------------------------------------------------------------------------


def lm_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, batch int, keys string, words long, tokens long")


def brute_lm(rows):
    """Base scores, and the scores that exact counts of pairs give."""
    tokens = [[*SPACED.findall((t or "").translate(LOW)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for own, h in zip(tokens, held, strict=True):
        if not h:
            one.update(own)
            two.update(zip([None, *own], own, strict=False))
    n, v = sum(one.values()), len(one)
    kind = lambda w: one[w].bit_length()
    singles, every = collections.Counter(), collections.Counter()
    for (a, _), c in two.items():
        singles[kind(a)] += c == 1
        every[kind(a)] += c
    free = {k: (singles[k] + 1) / (every[k] + 2) for k in range(64)}
    out = []
    for (i, _), own, h in zip(rows, tokens, held, strict=True):
        base = [(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in own]
        score = 0.0
        for a, b, p in zip([None, *own], own, base, strict=False):
            seen = 0.0
            if two[a, b]:
                seen = min(lm_score.COUNT_OF_LEVEL[1 + math.floor(math.log(two[a, b]) / math.log(1.5) + 1e-9)], one[a], one[b])
            score += math.log10((1 - free[kind(a)]) * seen / one[a] + free[kind(a)] * p if one[a] else p)
        out.append((i, h, len(own), sum(one[w] > 0 for w in own), n, sum(map(math.log10, base)), score))
    return out


@pytest.fixture(scope="module")
def lm_rows(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120").collect()]
    return rows + [(None, None), (None, "Some words"), (3000, ""), (3001, "a\x0bB\tc d É"), (3001, "a\x0bB\tc d É"), (3002, "zz " * 40_000)]


@pytest.mark.parametrize("way", ["broadcast", "shards", "batches"])
def test_lm_scores(spark, lm_rows, monkeypatch, way):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 2_000)
    if way == "shards":
        monkeypatch.setattr(lm_score, "BROADCAST_BYTES", 0)
    if way == "batches":
        monkeypatch.setattr(lm_score, "BATCH_BYTES", 20_000)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(map(tuple, lm_score.lm_scores(lm_docs(spark, lm_rows)).collect()), key=key)
    want = sorted(brute_lm(lm_rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # a pair that the filter wrongly knows only adds to a score
    apart = [(g[6] - w[6]) / g[2] for g, w in zip(got, want, strict=True)]
    assert min(apart) > -1e-9 and np.mean(apart) < 0.05 and np.median(apart) < 0.01
    new = [(g[5], g[6]) for g in got if g[1] and g[2] > 20]
    assert sum(s for _, s in new) > sum(b for b, _ in new)


def test_lm_of_nothing_and_of_held_out_rows_only(spark):
    assert lm_score.lm_scores(lm_docs(spark, [])).collect() == []
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = lm_score.lm_scores(lm_docs(spark, [(only, "alone here")])).collect()
    assert tuple(row) == (only, True, 3, 0, 0, 0.0, 0.0)


def test_filter_never_forgets_and_seldom_errs():
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 2**32, 50_000, dtype=np.uint32))
    counts = rng.zipf(1.6, len(names)).clip(1, 10**6)
    bits = lm_score.filter_of(names, counts)
    levels, found = lm_score.levels_of(counts), lm_score.probed(bits, names)
    assert (found >= levels).all() and (found > levels).mean() < 0.01
    others = np.setdiff1d(rng.integers(0, 2**32, 50_000, dtype=np.uint32), names)
    assert (lm_score.probed(bits, others) > 0).mean() < 0.01
