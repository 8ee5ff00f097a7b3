"""Main text of web pages by consensus host paths.

First pass: every page names the smallest container that holds all its running text outside of boilerplate by a
generalised path of tags and classes. Running text is all but links that stand outside of headings and paragraphs. Spark adds up the votes per host and path (partial sums, so a
host with a third of all pages is no hot group) and picks each host's winning path. Second pass: the pages are
extracted again from the containers on their host's path; a page uses its own best container where that path is
absent or does not hold all of its running text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Hosts up to which the winning paths (one short string each) are broadcast; beyond it they are joined by host.
BROADCAST_HOSTS = 50_000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?:/?[a-zA-Z])[^>]*\Z|([^<]+)|(<)""", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("body main article section div td".split())
SKIPPED = frozenset("head nav footer aside button select iframe object menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their text is the article's even where it is a link.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption dd".split())
LOOSE, BLOCK, LINK = range(3)
#: Words that mark boilerplate when they are the whole of a word in class, id or role, alone or with one of
#: the endings; readers' comments; page heads; words beside which a mark says what a thing has, not what it is; and words
#: that content is named by.
MARKS = "nav menu sidebar foot footer ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie consent notice gdpr promo share sharing social related recommend recommended recommendation breadcrumb subscribe subscription newsletter popup modal login signup search pagination pager toolbar widget copyright skip alert contentinfo complementary navigation"
COMMENTS = "comment disqus respond reply replies"
HEADS = "head header masthead"
ENDINGS = "s bar box list link links area wrap block form section nav menu item items thread slot"
MARK, COMMENT, HEAD = (re.compile(rf"(?:{'|'.join(words.split())})(?:{'|'.join(ENDINGS.split())})?") for words in (MARKS, COMMENTS, HEADS))
BESIDE = frozenset("has no with without".split())
CONTENT = frozenset("entry post article content main story body text page wrapper layout site container inner result results hentry document".split())

NOTHING, WEAK, STRONG, READERS, ALWAYS, ONLY_HEADINGS = range(6)
#: What a weak mark must hold of the running text outside of strong ones to stay, and what must be left beside a strong one.
MOST, LEFT = 0.8, 0.03


def marked(tag: str, names: list[str]) -> tuple[int, bool]:
    """How surely an element is boilerplate by its tag and the values of class, id and role, and whether it is a page's head."""
    if tag in SKIPPED:
        return ALWAYS, False
    if tag == "header":
        return STRONG, True
    found, head, content = WEAK if tag == "form" else NOTHING, False, False
    for name in (x for value in names for x in value.split()):
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        if BESIDE.intersection(words):
            continue
        own = CONTENT.intersection(words)
        if any(COMMENT.fullmatch(w) for w in words):
            return READERS, False
        if any(HEAD.fullmatch(w) for w in words):
            found, head = max(found, WEAK if own else STRONG), True
        elif any(MARK.fullmatch(w) for w in words):
            found = max(found, WEAK if own else STRONG)
        content = content or len(own) == len(words) > 0
    return (WEAK if content and found == STRONG else found), head


#: A heading, list item or paragraph closes an open paragraph.
CLOSES_P = frozenset("p div article section main ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure hr form nav header footer aside address fieldset".split())

#: An opening tag ends an open one of the first set, unless one of the second lies between.
IMPLIED = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


def _step(tag: str, names: str) -> str:
    """A tag with its classes, without numbers."""
    words = sorted({re.sub(r"[\d/]+", "", w) for w in names.lower().split()} - {""})
    return ".".join([tag, *words[:3]])


def _named(parent: bytes, step: str) -> bytes:
    return hashlib.blake2b(parent + step.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Page:
    """One walk over the mark-up: text pieces with the innermost container of each and the mark that they stand under;
    which marks hide what they hold is decided when the whole page is known."""

    def __init__(self, source: str):
        self.pieces: list[tuple[int, str, int]] = []  # container, text, kind; a space stands for the border of a block
        self.steps: list[str] = [""]
        self.parents: list[int] = [-1]
        self.names: list[bytes] = [b""]  # digests of the paths: whole paths of a deep page would grow with depth squared
        self.marks: list[tuple[int, int]] = [(NOTHING, -1)]  # how sure, and the mark around it
        self.under: list[int] = []  # the mark that each piece stands under
        self._read(source)
        shown = self._shown()
        self.pieces = [p for p, m in zip(self.pieces, self.under, strict=True) if shown[m]]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, LOOSE)]  # tag, container, mark, kind of text
        open_ = Counter()

        def put(text: str) -> None:
            _, here, mark, kind = stack[-1]
            if self.marks[mark][0] not in (ALWAYS, ONLY_HEADINGS):
                self.pieces.append((here, text, kind))
                self.under.append(mark)

        def close(k: int) -> None:
            open_.subtract(t for t, *_ in stack[k:])
            del stack[k:]

        for m in TOKEN.finditer(source):
            text, tag = m[5] or m[6], m[3]
            if text is not None:
                put(html.unescape(text) if "&" in text else text)
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                put(" ")
            if m[2]:
                if open_[tag] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            if tag in VOID or m[4].endswith("/") and tag in INLINE:
                continue
            if tag == "body" and open_["head"] > 0:
                close(next(k for k, s in enumerate(stack) if s[0] == "head"))
            if tag in CLOSES_P and open_["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in IMPLIED:
                ended, between = IMPLIED[tag]
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ended or stack[k][0] in between), 0) if any(open_[t] > 0 for t in ended) else 0
                if at and stack[at][0] in ended:
                    close(at)
            _, here, mark, kind = stack[-1]
            names = [a or b or c for a, b, c in NAMES.findall(m[4])] if m[4] else []
            if tag in HEADINGS and self.marks[mark][0] == ONLY_HEADINGS:
                mark = self.marks[mark][1]
            elif self.marks[mark][0] not in (ALWAYS, ONLY_HEADINGS) and tag not in ("html", "body", "article", "main"):
                sure, head = marked(tag, names)
                if head and tag in HEADINGS:
                    sure = NOTHING
                elif head and (open_["article"] > 0 or open_["main"] > 0):
                    sure = ONLY_HEADINGS
                if sure != NOTHING:
                    self.marks.append((sure, mark))
                    mark = len(self.marks) - 1
            if tag in CONTAINERS:
                step = _step(tag, " ".join(names))
                self.steps.append(step)
                self.names.append(_named(self.names[here], step))
                self.parents.append(here)
                here = len(self.steps) - 1
            kind = BLOCK if tag in BLOCKS else LINK if tag == "a" and kind == LOOSE else kind
            stack.append((tag, here, mark, kind))
            open_[tag] += 1

    def _shown(self) -> list[bool]:
        """Which marks leave their text in. A strong one hides it unless next to nothing is left of the page (readers'
        comments: nothing); a weak one (a form, or a mark beside a word for content) unless it holds most of what strong
        ones leave, or next to nothing would be left."""
        sure, around = [s for s, _ in self.marks], [m for _, m in self.marks]
        own = [0] * len(sure)
        for (_, text, kind), m in zip(self.pieces, self.under, strict=True):
            if kind != LINK and any(x.isalnum() for x in text):
                own[m] += len(text.strip())

        def held() -> list[int]:
            """Running text inside each mark that no strong mark within it hides; at 0: of the page."""
            out = own.copy()
            for k in range(len(sure) - 1, 0, -1):
                if sure[k] < STRONG:
                    out[around[k]] += out[k]
            return out

        inside = held()
        while best := max((k for k in range(1, len(sure)) if sure[k] in (STRONG, READERS)), key=lambda k: (inside[k] > 0, -sure[k], inside[k]), default=0):
            if inside[0] >= (LEFT * inside[best] if sure[best] == STRONG else 1) or not inside[best]:
                break
            while best > 0:  # what stands around it lets it through
                sure[best], best = min(sure[best], WEAK), around[best]
            inside = held()

        def shown(weak: bool) -> list[bool]:
            out = [True] * len(sure)
            for k in range(1, len(sure)):
                out[k] = out[around[k]] and (sure[k] == NOTHING or sure[k] == WEAK and (weak or inside[k] > MOST * inside[0]))
            return out

        out = shown(False)
        left = sum(n for n, s in zip(own, out, strict=True) if s)
        return out if left > LEFT * inside[0] else shown(True)

    def path(self, c: int) -> str:
        """The steps from the root to a container."""
        out = []
        while c > 0:
            out.append(self.steps[c])
            c = self.parents[c]
        return "".join(f"/{step}" for step in reversed(out))

    def running(self) -> list[tuple[int, int, int]]:
        """Container, length and kind of each piece of running text; of all text on a page of nothing but links."""
        found = [(c, len(text.strip()), kind) for c, text, kind in self.pieces if any(x.isalnum() for x in text)]
        return [x for x in found if x[2] != LINK] or found

    def best(self) -> tuple[int, float]:
        """The smallest container with all of the page's running text, and the length of that text."""
        held = [0] * len(self.steps)
        for c, size, _ in self.running():
            held[c] += size
        for c in range(len(held) - 1, 0, -1):
            held[self.parents[c]] += held[c]
        top = 0
        for c in range(1, len(held)):
            if self.parents[c] == top and held[c] == held[0]:
                top = c
        return top, float(held[top])

    def _on(self, path: str) -> list[bool] | None:
        """Which containers are on ``path`` or within; None if running text lies outside or there is none such."""
        wanted = b""
        for step in path.split("/")[1:]:
            wanted = _named(wanted, step)
        inside = self._within([name == wanted for name in self.names])
        return inside if any(inside) and all(inside[c] for c, _, _ in self.running()) else None

    def _within(self, inside: list[bool]) -> list[bool]:
        for c in range(1, len(inside)):
            inside[c] = inside[c] or inside[self.parents[c]]
        return inside

    def text(self, path: str | None) -> str:
        """Text of the containers on ``path``, nested ones included; of the best container where the path does not do."""
        inside = self._on(path) if path else None
        if inside is None:
            top = self.best()[0]
            inside = self._within([c == top for c in range(len(self.steps))])
        out, was = [], True
        for c, text, _ in self.pieces:
            if inside[c]:
                out.append(text if was else " " + text)
            was = inside[c]
        return " ".join("".join(out).split())


def _voted(batches):
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
            page = Page(source.as_py() or "")
            top, score = page.best()
            if score:
                hosts.append(host.as_py())
                paths.append(page.path(top))
                scores.append(float(score))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def _extracted(batches):
    for batch in batches:
        texts = [Page(s.as_py() or "").text(p.as_py()) for s, p in zip(batch.column("html"), batch.column("path"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): per host the path with the most votes, weighed by the logarithm of the text behind them."""
    votes = pages.select("host", "html").mapInArrow(_voted, "host string, path string, score double")
    sums = votes.groupBy("host", "path").agg(F.sum(F.log1p("score")).alias("votes"))
    return sums.groupBy("host").agg(F.max(F.struct(F.round("votes", 6), "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null html gives an empty text; a null or odd url counts as a host of its own name ("" if null). Repeated rows
    are extracted each. White space (no-break spaces included) inside and between blocks becomes one space.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    paths = cut(winning_paths(rows), "paths")
    small = paths.count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(paths) if small else paths, "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
