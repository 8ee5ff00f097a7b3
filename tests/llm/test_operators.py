"""Training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns,
each against a brute-force version."""

import collections
import hashlib
import re
import zlib

import pytest

import breakline.llm.ngram_join as join
import breakline.llm.repeats as repeats
from breakline.llm import decontaminate, exact_dedup, html_text, licenses, mixing, substring_dedup, suffix_dedup, token_counts, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """With extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, batch string")


@pytest.fixture(scope="module")
def rows(spark, sf):
    base = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 90").collect()]
    text = base[3][1]
    extra = [(1000, None, None), (1001, "", "src1"), (1002, text, "src1"), (1003, text.upper(), "src2"), (1004, " ".join(text.split()[5:]), "src2"), (1005, "one two", "src3"), (1006, "One  TWO", "src3"), (None, "null id row", "src3"), (1007, ("long " * 3000 + text) * 2, "src4"), (1008, "é\U0001f600 " * 40, "src4"), (1009, "a" * 120, None), (1010, "a" * 130, None)]
    return base + extra


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).cache()


@pytest.fixture(params=["", "many"])
def batches(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(repeats, "BATCH_BYTES", 20_000)
        monkeypatch.setattr(join, "BATCH_BYTES", 20_000)
        monkeypatch.setattr(join, "SET_BATCH_BYTES", 5_000)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_suffix_dedup(rows):
    """Per row (doc_id, bytes, removed spans, rest): a null doc_id is larger than all."""
    least, out = {}, []
    ordered = sorted(rows, key=lambda r: r[0] if r[0] is not None else 2**62)
    for i, t, _ in ordered:
        b, own = (t or "").encode(), i if i is not None else 2**62
        for p in range(len(b) - 49):
            least.setdefault(b[p : p + 50], own)
    for i, t, _ in ordered:
        b, own = (t or "").encode(), i if i is not None else 2**62
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < own:
                gone[p : p + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), [a for a, _ in spans], [e for _, e in spans], bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def brute_substring_dedup(rows):
    """Per row (doc_id, words, removed words, rest); rows of one doc_id are one document."""
    least, out = {}, []
    own = lambda i, p: (i if i is not None else 2**62, p)
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            least[key] = min(own(i, p), least.get(key, own(i, p)))
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - 19):
            if least[tuple(w[p : p + 20])] < own(i, p):
                gone[p : p + 20] = b"\1" * 20
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def both_dedups(df):
    one = [(r.doc_id, r.n_bytes, list(r.starts), list(r.ends), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()]
    three = [(r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends, strict=True)), bytes(r.kept)) for r in substring_dedup.substring_dedup(df).collect()]
    return one, three


def assert_dedups(df, rows):
    one, three = both_dedups(df)
    assert sorted(map(repr, one)) == sorted(map(repr, brute_suffix_dedup(rows)))
    assert sorted(map(repr, three)) == sorted(map(repr, brute_substring_dedup(rows)))


def test_suffix_and_substring_dedup(docs, rows, batches):
    assert_dedups(docs, rows)


def test_dedups_of_null_and_repeated_ids(spark, rows, monkeypatch):
    """A third of the rows without an id, ids that repeat with other texts and with the same text."""
    monkeypatch.setattr(repeats, "BATCH_BYTES", 20_000)
    mixed = [(None if k % 3 == 0 else k // 4, t, s) for k, (_, t, s) in enumerate(rows[:60])]
    mixed += mixed[:12] + [(7, rows[5][1], "s"), (7, "x " + rows[5][1], "s"), (7, rows[5][1], "s"), (1, None, "s"), (1, "", "s")]
    assert_dedups(documents(spark, mixed), mixed)


def test_dedups_of_a_common_phrase_with_ever_new_surroundings(spark, monkeypatch):
    """Anchors of many batches are split by what stands beside them; nothing is lost."""
    import random

    monkeypatch.setattr(repeats, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(repeats, "HOT_BATCHES", 2)
    rng = random.Random(3)
    phrase = "one common phrase that stands in most of the texts here"
    rows = []
    for i in range(150):
        side = lambda: " ".join(rng.choice(("alpha", "beta", "gamma")) + str(rng.randint(0, 2)) for _ in range(rng.randint(0, 12)))
        rows.append((i, f"{side()} {phrase} {side()}", "s"))
    assert_dedups(documents(spark, rows), rows)


def dedup_in_steps(rows, n, operator):
    """The steps of ``remove_repeats`` one after another on n batches: rows, and the symbols that each step indexed."""
    import pyarrow as pa

    indexed = collections.Counter()
    read = {substring_dedup: "Words", suffix_dedup: "Bytes"}[operator]

    def classes(contents, *anchors, **copies):
        indexed[step] += sum(map(job.read.symbols, contents))
        return operator.window_classes(contents, *anchors, **copies)

    def grouped(tables, by, *values):
        whole = pa.concat_tables([pa.table({by: pa.array([], pa.int32()), **{v: pa.array([], pa.binary()) for v in values}}), *(t.select([by, *values]) for t in tables)])
        return collections.defaultdict(lambda: whole.slice(0, 0), {k: whole.filter(pa.compute.equal(whole.column(by), k)) for k in set(whole.column(by).to_pylist())})

    job = repeats.Job(operator.LENGTH, operator.GRAM, getattr(operator, read), classes, operator is substring_dedup, n)
    schema = pa.schema({"doc_id": pa.int64(), "text": pa.binary(), "batch": pa.int32()})
    texts = {b: pa.Table.from_pylist([{"doc_id": i, "text": t if t is None else t.encode(), "batch": b} for i, t, _ in rows[b::n]], schema) for b in range(n)}
    named = collections.defaultdict(list)
    for t in texts.values():
        for r in job.name_anchors(t).to_pylist():
            named[r["bucket"]].append(r)
    shared = grouped([job.share_anchors(pa.table({"batch": pa.array([r["batch"] for r in own], pa.int32()), "keys": [r["keys"] for r in own]})) for own in named.values()], "batch", "keys", "hot")
    step, sent = "cut", collections.defaultdict(list)
    for b, t in texts.items():
        for r in job.cut_stretches(t, shared[b]).to_pylist():
            sent[r["bucket"]].append(r)
    step = "compare"
    told = grouped([job.compare(pa.table({"batch": pa.array([r["batch"] for r in own], pa.int32()), "stretches": [r["stretches"] for r in own]})) for own in sent.values()], "batch", "told")
    step = "remove"
    return [r for b, t in texts.items() for r in job.remove(t, told[b]).to_pylist()], indexed


@pytest.mark.parametrize("operator", (substring_dedup, suffix_dedup))
def test_dedups_index_copies_once(operator):
    """Batches that hold a text once each index nothing of it; what they send of it is indexed once, not per batch."""
    rows = [(i, " ".join(f"w{k}" for k in range(400)), "s") for i in range(8)]
    out, indexed = dedup_in_steps(rows, 8, operator)
    alone, _ = dedup_in_steps(rows[:2], 2, operator)
    assert [bytes(r["kept"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [rows[0][1].encode()] + [bytes(alone[1]["kept"])] * 7
    assert indexed["cut"] == indexed["remove"] == 0
    assert indexed["compare"] == dedup_in_steps(rows[:2], 2, operator)[1]["compare"]


@pytest.mark.parametrize("hot", (1, 64))
@pytest.mark.parametrize("seed", range(6))
def test_dedups_of_passages_within_and_across_batches(seed, hot, monkeypatch):
    """Passages that stand in a text again and again, in one batch or in several, whole or in parts, behind others."""
    import random

    monkeypatch.setattr(repeats, "HOT_BATCHES", hot)
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randint(0, 9)}" for _ in range(rng.randint(15, 70))] for k in range(4)]
    rows = [(9, None, "s"), (10, "", "s"), (11, " \t\n\v\f\r", "s"), (None, " ".join(passages[0]), "s")]
    for i in range(24):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.choice((0, 0, rng.randint(0, 9)))
            words += p[a : rng.choice((len(p), len(p), a + 30))] + [f"u{rng.randint(0, 3)}" for _ in range(rng.randint(0, 3))]
        rows.append((100 - i // 2 * 2 if i % 7 == 0 else 200 - i, "".join(w + rng.choice((" ", "  ", "\t", " \x0b\n", "\x1c ")) for w in words), "s"))
    for operator, brute in ((suffix_dedup, brute_suffix_dedup), (substring_dedup, brute_substring_dedup)):
        for n in (1, 3, 9):
            out, _ = dedup_in_steps(rows, n, operator)
            spans = (lambda r: (r["starts"], r["ends"])) if operator is suffix_dedup else (lambda r: (sum(r["ends"]) - sum(r["starts"]),))
            assert sorted(repr((r["doc_id"], r["n_symbols"], *spans(r), r["kept"])) for r in out) == sorted(map(repr, brute(rows)))


def windows(contents, cut, length):
    return [tuple(cut(c)[i : i + length]) for c in contents for i in range(len(cut(c)) - length + 1)]


def same_partition(classes, keys):
    """Equal numbers for equal windows, -1 for those without an equal."""
    count, named = collections.Counter(keys), {}
    for c, k in zip(classes.tolist(), keys, strict=True):
        assert (c == -1) == (count[k] == 1) and (c == -1 or named.setdefault(k, c) == c)
    return len(set(named.values())) == len(named)


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_find_equal_windows(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    base = [b"w%d" % x for x in rng.integers(0, 3, 300)]
    contents = []
    for _ in range(rng.integers(1, 8)):
        a = rng.integers(0, 100)
        contents.append(b" ".join(base[a : a + rng.integers(20, 180)] + [b"w%d" % x for x in rng.integers(0, 3, rng.integers(0, 40))]))
    assert same_partition(substring_dedup.window_classes(contents), windows(contents, bytes.split, 20))


@pytest.mark.parametrize("seed", range(10))
def test_windows_of_copied_contents_never_stand_alone(seed):
    """Contents indexed once with the number of their copies: the same classes as with the copies written out."""
    import numpy as np

    rng = np.random.default_rng(seed)
    base = [b"w%d" % x for x in rng.integers(0, 3, 200)]
    contents = list({b" ".join(base[a : a + k]) for a, k in rng.integers([0, 20], [120, 60], (6, 2)).tolist()})
    copies = rng.integers(1, 3, len(contents))
    once = substring_dedup.window_classes(contents, copies=copies)
    ends = np.cumsum([len(c.split()) - 19 for c in contents])
    classes = [c for c, k in zip(np.split(once, ends[:-1]), copies, strict=True) for _ in range(k)]
    whole = [c for c, k in zip(contents, copies, strict=True) for _ in range(k)]
    assert same_partition(np.concatenate(classes), windows(whole, bytes.split, 20))


def test_fm_index_counts_all_places():
    import numpy as np

    text = np.r_[np.random.default_rng(0).integers(1, 4, 300), 0]
    index = substring_dedup.FMIndex(text, 5)
    low, high = np.zeros(290, int), np.full(290, 301)
    for k in range(4, -1, -1):
        low, high = index.extended(text[np.arange(290) + k], low, high)
    every = windows([text[:300].tolist()], list, 5)
    assert (high - low).tolist() == [every.count(every[i]) for i in range(290)]


@pytest.mark.parametrize("seed", range(20))
def test_bucket_refinement_names_equal_windows(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    some = lambda n: bytes(rng.integers(97, 99, n).astype(np.uint8))
    gram, before, after = some(24), [some(26) for _ in range(3)], [some(26) for _ in range(3)]
    contents, anchors = [], []
    for _ in range(rng.integers(1, 30)):
        anchors.append(int(rng.integers(0, 27)))
        contents.append(before[rng.integers(3)][26 - anchors[-1] :] + gram + after[rng.integers(3)][: int(rng.integers(26 - anchors[-1], 27))])
    assert same_partition(suffix_dedup.window_classes(contents, np.array(anchors)), windows(contents, list, 50))


@pytest.mark.parametrize("length", (3, 8, 13, 26, 50, 70))
def test_bucket_pointers_sort_suffixes(length):
    import numpy as np

    rng = np.random.default_rng(length)
    data = np.tile(rng.integers(97, 99, 40).astype(np.uint8), 5)
    at = np.unique(rng.integers(0, 200, 60))
    found = suffix_dedup.BucketPointers(data, length)
    order, key = found.refine(at, length), lambda i: (data.tobytes() + bytes(80))[i : i + length]
    assert [key(i) for i in order] == sorted(key(i) for i in at)
    assert all((found.pointer[i] == found.pointer[j]) == (key(i) == key(j)) for i in at for j in at)


def test_token_counts(docs, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    own = token_counts.counter(None)
    for r in token_counts.token_counts(docs, limit=100).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        n = len(sp.encode(text))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 100, len(text.encode()))
        if n > 100 and len(text) < 3000:
            fits = [k for k in range(len(text) + 1) if len(sp.encode(text[:k])) <= 100]
            assert r.limit_chars == max(fits)
    for text in ("", " ", "  a  b ", "\n\n x\ty\r\n", "日本 語▁x ﬁ", "<s> </s> <0x0A>", "é" * 5 + " \U0001f600x"):
        assert own.at_every_prefix(text) == [len(sp.encode(text[:k])) for k in range(len(text) + 1)]


def test_toxicity(spark):
    bad = ["you {} idiot", "what a m0ron {}", "{} trash talk", "clоwn {} here"]  # digits and a Cyrillic letter inside
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        filler = " ".join(f"w{(i * 7 + k) % 50}" for k in range(12))
        rows.append((i, bad[i // 4 % 4].format(filler) if toxic else filler + " idiomatic trashcan", "s"))
        labels.append((i, 1, int(toxic)))
    docs, table = documents(spark, [*rows, (9000, None, None), (9001, "", "s"), (None, "nothing", "s")]), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.fit(docs, table)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in held) for i in range(600))
    assert sum(out[i].predicted == labels[i][2] for i in held) / len(held) > 0.98
    assert out[9000].score == out[9001].score < 0.5 and all(0 <= r.score <= 1 for r in out.values())
    none = toxicity.fit(docs, table.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}


def test_license_scan(spark):
    texts = ["Released under the MIT License. CC-BY cc by", "GNU General Public License v3 or later", "apache license, Version 2.0 GNU GENERAL PUBLIC LICENSE", None, "", "permit licensee"]
    out = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].last_word, out[0].base_labels) == (3, 3, 7, "cc-by,mit")
    assert out[1].base_labels == "gpl" and "gpl-3.0" in out[1].labels
    assert out[2].base_labels == "apache,gpl" and out[3].n_words == 0 and out[4].first_word is None and out[3].score == 0
    assert len(licenses.rules()) > 200 and all(0 <= r.score <= 1 for r in out.values())


def spellings(parsed):
    """Shortest matches of a parsed expression: every alternative, options with and without, wildcards empty."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            own = [chr(arg)]
        elif op == "IN":
            own = [chr(v) for kind, v in arg if str(kind) == "LITERAL"] or ["7"]
        elif op == "BRANCH":
            own = [x for branch in arg[1] for x in spellings(branch)]
        elif op == "SUBPATTERN":
            own = spellings(arg[3])
        elif op == "MAX_REPEAT":
            own = [""] * (arg[0] == 0) + (spellings(arg[2]) if str(arg[2][0][0]) != "ANY" else [])
        else:
            assert op == "ASSERT"
            own = [""]
        out = [a + b for a in out for b in own]
    return out


def test_a_minimal_match_of_every_license_rule_yields_its_label():
    scanner = licenses.Scanner()
    for rule in scanner.rules:
        for text in spellings(re._parser.parse(rule.pattern.pattern.decode())):
            assert rule.label in scanner.scan(text.encode())[5].split(","), (rule.label, text)
    for phrase, label in licenses.BASE.items():
        assert scanner.scan(phrase.encode())[4] == label


def test_license_names_that_stand_alone(spark):
    texts = {"Released under the LGPL": "lgpl", "lgpl 2.1": "lgpl-2.1", "agpl-3.0": "agpl-3.0", "the Unlicense": "unlicense", "this product includes PHP software, freely available": "php-3.01", "you just do what the fuck you want to": "wtfpl", "nothing of it": ""}
    out = [r.labels.split(",") for r in licenses.scan_licenses(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert len(out) == len(texts) and all(label in found for label, found in zip(texts.values(), out, strict=True))


def brute_components(rows, n=4, need=85):
    sets, parent = {}, {}
    for k, (_, t, _) in enumerate(rows):
        w = SPACED.findall((t or "").translate(LOW))
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for k, s in sets.items():
        shared = collections.Counter(j for g in s for j in places[g])
        for j, o in shared.items():
            if 100 * o >= need * (len(s) + len(sets[j]) - o):
                parent[find(k)] = find(j)
        for g in s:
            places[g].append(k)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least.get(find(k))) for k, (i, _, _) in enumerate(rows)}


def test_ngram_join(docs, rows, batches):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_classes(docs).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_one_large_group(spark):
    """Copies with a few words changed, so that many link only through others."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        w[(i * 7) % 60] = f"x{i % 3}"
        w[(i * 11 + 5) % 60] = f"y{i % 5}"
        rows.append((i, " ".join(w), "s"))
    for need in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_classes(documents(spark, rows), need=need).collect()}
        assert got == brute_components(rows, need=need)


def test_html_text(spark):
    page = "<html><head><title>t</title></head><body class='b'><div id=header><h1>Site</h1></div><nav>menu</nav><div class='content'><p>One &amp; two<br>three</p><div class=comments><p>no</p></div><p>Fo<b>ur</b></div><script>x()</script><footer>f</footer></body></html>"
    pages = [(1, "http://a.example/1", page), (2, "http://a.example/2", page.replace("Fo", "Ga")), (3, None, None), (4, "odd", ""), (5, "http://b.example", "plain &lt;text"), (5, "http://b.example", "plain &lt;text")]
    out = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = collections.defaultdict(list)
    for r in out:
        texts[r.page_id].append((r.text, r.n_chars))
    assert texts[1] == [("One & two three Four", 20)] and texts[2] == [("One & two three Gaur", 20)]
    assert texts[3] == [("", 0)] and texts[4] == [("", 0)] and texts[5] == [("plain <text", 11)] * 2


ARTICLE = " ".join(f"word{k} of the article" for k in range(12)) + "."


@pytest.mark.parametrize("shape", ["wrapper has-sidebar", "no-sidebar", "layout-with-sidebar", "football-news", "commentary", "page-header-content", "navy", "content social-science", "site search-results", "entry notice", "post-shared", "promotion", "banner", "comments", "footnotes", "hasSidebar mainContent"])
def test_html_text_keeps_articles_in_marked_containers(shape):
    """A mark in a class, id or role does not hide the page's text."""
    plain = f"<html><body><div class='{shape}'><p>{ARTICLE}</p></div></body></html>"
    beside = f"<html><body><div>My site</div><div class='{shape}'><h1>Head</h1><p>{ARTICLE}</p><div class=sidebar>side {ARTICLE}</div><div class='comment-list'><p>{ARTICLE} {ARTICLE}</p></div></div><footer>foot</footer></body></html>"
    for source, want in ((plain, ARTICLE), (plain.replace("class=", "id="), ARTICLE), (beside, f"My site Head {ARTICLE}")):
        page = html_text.Page(source)
        assert page.text(page.path(page.best()[0])) == want or shape == "comments" and source is beside


def test_html_text_of_forms_heads_and_halves():
    cases = [
        (f"<body><form id=aspnetForm action=x><input type=hidden><div id=header><h1>Site name</h1></div><div class=main><h2>T</h2><p>{ARTICLE}</p></div><div class=footer>foot</div></form></body>", f"T {ARTICLE}"),
        (f"<body><form action=x><p>Search: <input></p></form><p>{ARTICLE}</p></body>", ARTICLE),
        (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by someone</p></header><p>{ARTICLE}</p></article></body>", f"Title {ARTICLE}"),
        (f"<body><main><div class='entry-header'><h1>Title</h1> <a href=x>share</a></div><p>{ARTICLE}</p></main></body>", f"Title {ARTICLE}"),
        (f"<body><h1 class='page-header'>Title</h1><p>{ARTICLE}</p></body>", f"Title {ARTICLE}"),
        ("<body>" + f"<div class='entry notice'><p>{ARTICLE}</p></div>" * 3 + "</body>", " ".join([ARTICLE] * 3)),
        (f"<body><p>Short text.</p><div class=comments><p>{ARTICLE * 20}</p></div><div class='related-posts'><p>{ARTICLE}</p></div></body>", "Short text."),
        (f"<body><div class=sidebar><div class=widget><p>{ARTICLE}</p></div><div class=comments><p>{ARTICLE}</p></div></div></body>", ARTICLE),
        (f"<body><nav><p>{ARTICLE}</p></nav></body>", ""),
    ]
    for source, want in cases:
        page = html_text.Page(source)
        assert page.text(page.path(page.best()[0])) == want, source


def test_html_text_ties_of_host_votes(spark):
    """Two templates of one host with as many votes: each page keeps its whole article."""
    a, b = f"<body><div class=a><p>{ARTICLE}</p></div></body>", f"<body><div class=b><p>{ARTICLE}</p></div></body>"
    pages = [(k, "http://tie.example/x", (a, b)[k % 2]) for k in range(10)]
    assert {r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {ARTICLE}


def test_html_text_keeps_lead_and_heading(spark):
    """Text beside the largest container is the article's, on pages whose host agrees and on pages of another template."""
    lead, body = "lead " * 35, "body " * 65
    parts = f"<nav>menu</nav><div class=content><div class=lead>{lead}</div><div class=body>{body}</div></div>"
    article = f"<ul><li><a href=x>other page</a></li></ul><article><h1>Title</h1><p>first</p><div class=body>{body * 9}</div></article>"
    plain = f"<div class=content><div class=text><p>{body}</p></div></div>"
    empty = f"<div class=content><div class=text></div><div class=old><p>{body}</p></div></div>"
    tiny = f"<div class=content><div class=text>x</div><div class=old><p>{body}</p></div></div>"
    pages = [(1, "http://a/1", parts), (2, "http://a/2", parts), (3, "http://b/1", article), (4, "http://b/2", article)] + [(10 + i, f"http://c/{i}", plain) for i in range(5)] + [(20, "http://c/x", empty), (21, "http://c/y", tiny), (22, "http://c/z", parts)]
    out = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1] == out[2] == out[22] == (lead + body).strip()
    assert out[3] == out[4] == "Title first " + (body * 9).strip()
    assert out[10] == out[20] == body.strip() and out[21] == "x " + body.strip()


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, fixed = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 2 * sizes[s] for s in over}


def test_targets_of_many_sources(spark):
    """As many stops as sources, in one sort."""
    import random

    rng = random.Random(1)
    sizes = {f"s{k:03d}": rng.choice((0, 1, 7, rng.randint(1, 10_000))) for k in range(250)}
    rows = [(s, (3, 1, 2)[k % 3], n, False) for k, (s, n) in enumerate(sorted(sizes.items()))]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, weight int, source_size long, _no_source boolean")).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in out) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs).collect())
    source = {i: s for i, _, s in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        assert r.size == len(SPACED.findall(next(t for i, t, _ in rows if i == r.doc_id) or "")) and 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = brute_targets({s: sizes[s] for s in set(source.values())})
    for r in out:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_exact_dedup(docs, rows, monkeypatch):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOW)].append(i)
    want = {}
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {i: (keep, len(ids), i == keep, sha(t.encode())) for i in ids}
    for block in (4096, 37):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, block).collect()}
        assert got == want


def test_exact_dedup_of_repeated_rows(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (2, "A", "s"), (None, "b", "s")]
    kept = exact_dedup.keep_distinct(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "b"), (2, "A")]


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    edited = " ".join([*w[:5], "new", *w[6:9], *w[10:]])
    rows = [(1, "before " * 30 + item.upper() + "! after", "s"), (2, "x y " + edited + " z", "s"), (3, "alpha beta gamma delta and then nothing of it", "s"), (4, None, "s"), (5, "", "s"), (6, item, "s"), (6, item, "s")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "two words"), (None, item)], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert set(out) == {(1, 7), (2, 7), (6, 7)} and out[1, 7].score == 1.0 and (out[1, 7].first_word, out[1, 7].end_word) == (30, 42)
    assert decontaminate.LEAST <= out[2, 7].score < 1
    assert {r.doc_id for r in decontaminate.drop_contaminated(documents(spark, rows), bench).collect()} == {3, 4, 5}


def test_decontamination_of_lone_seeds_in_many_documents(spark):
    """A passage that many documents hold by a single seed is found in each, and nothing below the score is."""
    item, short, w = "one two three four five six seven eight nine ten eleven twelve", "alpha beta gamma delta", "one two three four five six seven eight nine ten eleven twelve".split()
    edited = " ".join([*w[:3], "x", *w[4:8], "y", *w[9:]])
    rows = [(i, f"lead{i} {edited} end", "s") for i in range(40)] + [(100 + i, f"lead{i} {short} end", "s") for i in range(40)] + [(200 + i, f"{' '.join(w[:4])} and no more of it {i}", "s") for i in range(40)]
    bench = spark.createDataFrame([(7, item), (8, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    scores = {(d, i): decontaminate.align(decontaminate.folded_words(b), decontaminate.folded_words(t))[0] for d, t, _ in rows for i, b in ((7, item), (8, short))}
    assert got == {k: x for k, x in scores.items() if x >= decontaminate.LEAST} and set(got) == {(i, 7) for i in range(40)} | {(100 + i, 8) for i in range(40)}


def test_decontamination_of_repeated_and_null_item_ids(spark):
    a, b, c, d = "one two three four five six", "red green blue white black pink", "north south east west up down", "iron gold zinc lead tin mercury"
    bench = spark.createDataFrame([(7, a), (7, b), (7, b), (8, b), (None, c), (None, d), (None, a), (9, None)], "item_id long, text string")
    docs = documents(spark, [(1, f"x {a} y", "s"), (2, f"x {b} y", "s"), (3, f"x {c} y", "s"), (4, f"{d} y", "s"), (5, "none of it", "s"), (None, c, "s"), (6, f"{a.replace('four', 'x')} {b}", "s")])
    rows = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.score) for r in rows) == [(0, 0, 1.0), (1, 7, 1.0), (2, 7, 1.0), (2, 8, 1.0), (3, 0, 1.0), (4, 0, 1.0), (6, 7, 1.0), (6, 8, 1.0)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [5]


@pytest.mark.parametrize("seed", range(30))
def test_candidate_bound_is_never_below_the_score(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    x, y = (rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
    assert decontaminate.most(np.unique(x, return_counts=True), y) >= decontaminate.align([b"%d" % i for i in x], [b"%d" % i for i in y])[0]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_the_plain_recurrence(seed):
    import random

    rng = random.Random(seed)
    x, y = ([rng.choice(b"abc") for _ in range(rng.randint(1, 12))] for _ in range(2))
    x, y = [bytes([c]) for c in x], [bytes([c]) for c in y]
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    score, a, b = decontaminate.align(x, y)
    assert abs(score - max(map(max, h)) / (2 * len(x))) < 1e-9 and (score == 0 or a < b)


def test_empty_tables(spark):
    none, pages = documents(spark, [(1, "a", "s")]).filter("false"), spark.createDataFrame([], "page_id long, url string, html string")
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.suffix_dedup(none), substring_dedup.substring_dedup(none), token_counts.token_counts(none), toxicity.toxicity(none, toxicity.fit(none, labels)), licenses.scan_licenses(none), join.jaccard_classes(none), html_text.extract_text(pages), mixing.mix(none, mixing.label_weights(labels)), exact_dedup.exact_dedup(none), decontaminate.contaminated(none, bench)):
        assert df.collect() == []


def plain_toxicity(model, text):
    """Sum of weights and number of hits, word by word."""
    words = toxicity.fold(text or "").split()
    clear = set()
    for i in range(len(words) - 1):
        if model.entries.get(f"{words[i]} {words[i + 1]} ") == 0:
            clear |= {i, i + 1}
    found = []
    for i, w in enumerate(words):
        at = [e for e in model.entries if " " not in e[:-1] and (w + " ").startswith(e)]
        if at and i not in clear and model.entries[max(at, key=len)] > 0:
            found.append(model.entries[max(at, key=len)])
    return sum(found), len(found)


def test_toxicity_scores_equal_a_plain_scan_of_the_lexicon(spark):
    """Entries, their exceptions and exception phrases, on short, long, empty and null texts and repeated rows."""
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = f"you {'scum' if i % 2 else 'killer'} {i % 7} clean" if toxic else f"clean you {'killer whale' if i % 60 == 1 else 'scumble' if i % 70 == 2 else 'fine'} boy {i % 5}"
        rows.append((i, text, "s"))
        labels.append((i, 1, int(toxic)))
    texts = ["", None, "scum", "a killer whale", "killer", "killing scum", "Sc\u0443m k1ller wh\u0430le", "clean " * 20_000 + "scum", "killer whale killer", "killer whale killer"]
    docs = documents(spark, rows + [(5000 + k, t, "s") for k, t in enumerate(texts)])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(w > 0 for w in model.entries.values()) and any(" " in e[:-1] for e in model.entries)
    for r in toxicity.toxicity(docs, model).collect():
        text = dict((i, t) for i, t, _ in rows).get(r.doc_id, texts[r.doc_id - 5000] if r.doc_id >= 5000 else None)
        strength, hits = plain_toxicity(model, text)
        assert r.hits == hits and abs(r.score - model.score(strength, hits, len(toxicity.fold(text or "").split()))) < 1e-9, text


def plain_scan(scanner, text):
    """Every rule on every text, every earlier detection against every later one."""
    joined = b" " + b" ".join(text.translate(licenses.WORDS).split()) + b" "
    taken = []
    for rule in scanner.rules:
        for m in rule.pattern.finditer(joined):
            a, b = m.start() + 1, m.end()
            if not any(x <= a and b <= y for x, y, _ in taken):
                taken.append((a, b, rule.label))
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} ".encode() in joined}
    return ",".join(sorted(base | {label for _, _, label in taken}))


def test_license_scan_equals_every_rule_on_every_text(rows):
    scanner = licenses.Scanner()
    texts = [(t or "").encode() for _, t, _ in rows] + [b"GPL-3.0 GNU General Public License version 3 or later, CC BY-SA 4.0; cc by", b"apache license apache license 2.0 mit license " * 5, b"the mit license (mit) copyright (c) 2020 all rights reserved permission is hereby granted, free of charge, to any person obtaining a copy"]
    for text in texts:
        assert scanner.scan(text)[5] == plain_scan(scanner, text)
    assert sum(len(lines.strip().splitlines()) for lines in licenses.SIGNATURES.values()) > 200


def test_license_scan_of_a_very_long_text_takes_linear_time():
    import time

    text = b"released under the mit license, all rights reserved, copyright 2020 gnu general public license version 3 " * 20_000  # 2 MB
    began = time.process_time()
    found = licenses.Scanner().scan(text)
    assert found[1] == 40_000 and time.process_time() - began < 30


def test_html_text_of_deep_and_very_long_pages():
    import time

    began = time.process_time()
    for source in ("<div class=a>" * 40_000 + "<p>text</p>" + "</b>" * 40_000, "<body><p>" + "word " * 400_000, "<p>" * 100_000 + "text"):
        page = html_text.Page(source)
        text = page.text(page.path(page.best()[0]))
        assert text in ("text", ("word " * 400_000).strip())
    assert time.process_time() - began < 60


def test_html_text_against_planted_articles(spark):
    """Articles put into three templates with what surrounds articles: words of the article kept, others left out."""
    import random

    rng = random.Random(5)
    templates = [
        "<html><head><title>{t}</title><style>.x{{}}</style></head><body><header>site {junk}</header><nav><a href=/>home</a></nav><main><article class='post p{n}'><h1>{t}</h1>{body}</article></main><aside>{junk}</aside><footer>{junk}</footer></body></html>",
        "<body><div id=top class=menu><ul><li><a href=a>{junk}</a></ul></div><div class='content c{n}'>{body}<div class=share>{junk}</div></div><div class=comments><p>{junk}</p></div><script>{junk}</script></body>",
        "<body><table><tr><td class=sidebar>{junk}<td class=text><div class=entry><p>{t}</p>{body}</div></table><div class=cookie-notice>{junk}</div></body>",
    ]
    pages, want = [], {}
    for i in range(90):
        words = [f"art{rng.randint(0, 400)}" for _ in range(rng.choice((3, 40, 300)))]
        cuts = sorted(rng.sample(range(1, len(words)), min(2, len(words) - 1)))
        parts = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]
        kind = i % 3
        body = f"<p>{parts[0]} &amp; <b>so</b></p>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        junk = " ".join(f"junk{rng.randint(0, 50)}" for _ in range(rng.randint(1, 25)))
        title = f"title{i}"
        pages.append((i, f"http://host{kind}.example/{i}", templates[kind].format(t=title, n=i, body=body, junk=junk)))
        text = " ".join([parts[0], "& so", *parts[1:]])
        want[i] = text if kind == 1 else f"{title} {text}"
    df = spark.createDataFrame(pages + pages[:5], "page_id long, url string, html string").withColumns({"host": html_text.F.lit("x"), "path": html_text.F.lit("y")})
    got = html_text.extract_text(df).collect()
    assert len(got) == 95 and all(r.text == want[r.page_id] for r in got)


def search(rows, items, least=decontaminate.LEAST):
    """What the search of one batch finds, without Spark."""
    import types

    import pyarrow as pa

    block = types.SimpleNamespace(value=decontaminate._item_seeds(items, least))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    return sorted(r for b in decontaminate._search([batch], block, least) for r in zip(*b.to_pydict().values(), strict=True))


def test_decontamination_by_rarest_words_loses_nothing(monkeypatch):
    """Seeds that many items share: the same passages as with every item followed."""
    import random

    rng = random.Random(9)
    opening = "which of the following best describes the main idea of"
    items = [(k, f"{opening} {' '.join(f'w{rng.randint(0, 60)}' for _ in range(rng.randint(0, 30)))} the the") for k in range(120)]
    rows = []
    for k in range(200):
        w = items[rng.randint(0, 119)][1].split()
        w = [x if rng.random() > rng.choice((0, 0.1, 0.4)) else f"w{rng.randint(0, 60)}" for x in w]
        rows.append((k, f"before {' '.join(w)} after {opening if k % 3 else ''} more w{rng.randint(0, 60)}"))
    got = search(rows, items)
    monkeypatch.setattr(decontaminate, "HOT_SEED", 10**9)
    assert got == search(rows, items) and len(got) > 100


def test_decontamination_of_a_seed_that_all_items_share():
    """20,000 items with one opening cost no more than twice what items without it do."""
    import time

    opening = "which of the following statements is true about"
    tails = [" ".join(f"t{k}x{j}" for j in range(12)) for k in range(20_000)]
    texts = [(i, f"some words {opening} and {' '.join(f'u{i}y{j}' for j in range(60))}") for i in range(200)] + [(900, f"{opening} {tails[7]}")]
    took = []
    for shared in (False, True):
        items = [(k, f"{opening} {t}" if shared or k == 7 else f"o{k} p{k} q{k} r{k} {t}") for k, t in enumerate(tails)]
        import types

        import pyarrow as pa

        block = types.SimpleNamespace(value=decontaminate._item_seeds(items, decontaminate.LEAST))
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([t for _, t in texts], pa.string())], ["doc_id", "text"])
        began = time.process_time()
        found = [r for b in decontaminate._search([batch], block, decontaminate.LEAST) for r in zip(*b.to_pydict().values(), strict=True)]
        took.append(time.process_time() - began)
        assert [(r[0], r[1]) for r in found] == [(900, 7)]
    assert took[1] < 2 * took[0] + 0.5


def test_decontamination_with_clashing_columns(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"x {item} y", 5, "a", 0.1)], "doc_id long, text string, item long, passage string, score double")
    bench = spark.createDataFrame([(7, item, 3, True, 2, 4)], "item_id long, text string, item long, named boolean, size int, doc_id int")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 7)]
    assert decontaminate.drop_contaminated(docs, bench).collect() == []


def test_labels_with_clashing_columns(spark, rows):
    labels = spark.createDataFrame([(i, k % 2, k % 3 == 0, "t", 1.0, 4) for k, (i, _, _) in enumerate(rows)], "doc_id long, quality int, toxic_ boolean, text string, weight double, size int").withColumn("toxic", html_text.F.col("toxic_").cast("int"))
    docs = documents(spark, rows)
    assert mixing.mix(docs, mixing.label_weights(labels)).count() == len(rows)
    assert toxicity.toxicity(docs, toxicity.fit(docs, labels)).count() == len(rows)


def test_token_counts_of_texts_without_spaces():
    """20,000 distinct texts without spaces, long ones among them, in one worker's memory, and long texts in linear memory."""
    import random
    import tracemalloc

    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    own, sp, rng = token_counts.PrefixCounter(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path)), random.Random(3)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(rng.choice((5, 40, 60)))) for _ in range(20_000)]
    own.count("warm up")
    tracemalloc.start()
    counts = [own.count(t) for t in texts]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2 * token_counts.REMEMBERED_BYTES and sum(map(len, own.counts)) <= 48 * len(own.counts)
    assert counts[:300] == [len(sp.encode(t)) for t in texts[:300]]
    long = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    assert own.count(long) == len(sp.encode(long)) and own.at_every_prefix(long[:200]) == [len(sp.encode(long[:k])) for k in range(201)]


def test_decontamination_recall_of_edited_copies(spark):
    """Copies with 10 and 20 % of their words changed, against aligning every text with every item."""
    import random

    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(("ka", "lo", "mi", "re", "su", "ta")) + rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(20, 40)))) for k in range(20)]
    rows = []
    for share in (0.1, 0.2):
        for k, text in items:
            for copy in range(3):
                w = [x if rng.random() >= share else f"new{rng.randint(0, 99)}" for x in text.split()]
                rows.append((len(rows), f"lead {copy} words {' '.join(w)} and what follows", "s"))
    rows += [(len(rows) + k, " ".join(rng.sample(text.split(), len(text.split()))), "s") for k, (_, text) in enumerate(items)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    every = {(d, k) for d, t, _ in rows for k, i in items if decontaminate.align(decontaminate.folded_words(i), decontaminate.folded_words(t))[0] >= decontaminate.LEAST}
    assert got <= every and len(got) >= 0.95 * len(every)
    assert sum((d, k) in got for d in range(60) for k, _ in items if d // 3 == k) == 60  # a tenth changed: all
    assert sum((d, k) in got for d in range(60, 120) for k, _ in items if (d - 60) // 3 == k) >= 54  # a fifth changed


def test_ngram_join_of_one_common_shingle(spark, monkeypatch):
    """Texts that differ in all but one very common shingle: an index entry of many classes is dealt to several tasks."""
    monkeypatch.setattr(join, "SPREAD", 10)
    rows = [(None if i % 3 == 0 else i, f"one two three four w{i % 40} v{i % 7} u{i % 11}", "s") for i in range(160)]
    unique = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_classes(documents(spark, unique)).collect()}
    assert got == brute_components(unique)
    assert join.jaccard_classes(documents(spark, rows)).count() == 160
