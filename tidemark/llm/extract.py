"""Main text of web pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into blocks: runs of text between block-level borders, each with its open elements.  Features are the
tags of these elements, words of their class, id and role, the block's own tag, its length, link share and
punctuation.  The field labels each block as article or not; it is trained on labelled pages (made below from seeded
templates of many layouts) by exact gradients, and decoded by Viterbi over all pages of a slice at once.

Text of scripts, styles and the like is never a block.  Character references are decoded, white space inside a block
becomes one space, and the article's blocks are joined by one space in page order.

Edge cases: null, empty or tagless pages are pages of no or one block; cut-off tags and unclosed elements end with the
page; null ids and urls stay null; repeated rows repeat; extra columns are ignored.  Work is linear in the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c
from tidemark.llm import _crf

# HTML's block-level and raw-text elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul button label".split()
)
RAW = frozenset("script style template textarea noscript iframe noembed noframes svg math xmp object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open element a start tag ends by itself.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An attribute as HTML's states read it: a name, and behind `=` a value, which a quote opens only as its first character.  A quote
#: that never closes is part of the name that follows; none of its kind comes later, so it is sought once.
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+)>?)""", re.S)
COMMENT_ENDS = re.compile("--!?>")
NAME = re.compile(r"[a-z]{2,}")


def blocks(page: str) -> list[tuple[str, tuple, str, int]]:
    """(text, features of the open elements, own tag, characters in links) of every leaf block."""
    out: list = []
    stack: list[tuple[str, frozenset]] = []
    open_: dict[str, int] = {}
    text: list[str] = []
    link, links = 0, 0
    pos = 0

    def flush():
        nonlocal links
        if text:
            got = "".join(text)
            if "&" in got:
                got = html.unescape(got)
            got = " ".join(got.split())
            if got:
                out.append((got, stack[-1][1] if stack else frozenset(), stack[-1][0] if stack else "", links))
            text.clear()
        links = 0

    def close(to: int):
        while len(stack) > to:
            open_[stack.pop()[0]] -= 1

    while m := TAG.search(page, pos):  # from pos, so that nothing inside a comment or raw text counts as a tag
        if m.start() > pos:
            piece = page[pos : m.start()]
            text.append(piece)
            if link:
                links += len(piece)
        pos = m.end()
        if m[1]:
            empty = re.compile("-?>").match(page, pos)  # <!--> and <!---> are whole
            end = empty or COMMENT_ENDS.search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if m[2]:
            end = page.find(">", pos)
            pos = len(page) if end < 0 else end + 1
            continue
        tag = m[4].lower()
        if m[3]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK:
                flush()
                if open_.get(tag, 0):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, pos)
                pos = end.start() if end else len(page)
            continue
        if tag == "a":
            link += 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            flush()
            if open_.get("p", 0) and stack[-1][0] == "p":
                close(len(stack) - 1)
            ends = ENDS.get(tag)
            while ends and stack and stack[-1][0] in ends:
                close(len(stack) - 1)
            if tag in VOID:
                continue
            own = {f"<{tag}"}
            for a in ATTR.finditer(m[5]):
                if a[1].lower() in ("class", "id", "role"):
                    own.update(f".{w}" for w in NAME.findall((a[2] or a[3] or a[4] or "").lower()))
            above = stack[-1][1] if stack else frozenset()
            stack.append((tag, above if own <= above else above | own))
            open_[tag] = open_.get(tag, 0) + 1
    if pos < len(page):
        text.append(page[pos:])
    flush()
    return out


def _own(text: str, tag: str, links: int, k: int, n: int) -> list[str]:
    words = text.count(" ") + 1
    share = min(4, 4 * links // max(1, len(text)))
    return [
        f"tag {tag}", f"words {min(words, 200).bit_length()}", f"links {share}", f"stop {text[-1] in '.!?:”\"'}",
        f"sign {'©' in text}", "first" if k == 0 else "last" if k == n - 1 else "inner",
    ]


class Extractor:
    """Weights by feature for the two labels, and transitions; label 1 is the article."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(names) + 1, 2))  # the last row: features never seen
        self.step, self.begin = np.zeros((2, 2)), np.zeros(2)
        self._sets: dict = {}

    def features(self, pages: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers of all blocks, where each block's begin, and first block and length of each page."""
        flat: list[int] = []
        at, first, size = [0], [], []
        get, none = self.names.get, len(self.names)
        if len(self._sets) > 50_000:
            self._sets.clear()
        for page in pages:
            if page:
                first.append(len(at) - 1)
                size.append(len(page))
            for k, (text, above, tag, links) in enumerate(page):
                known = self._sets.get(above)
                if known is None:
                    known = self._sets[above] = [i for i in (get(f) for f in above) if i is not None]
                flat += known
                flat += [get(f, none) for f in _own(text, tag, links, k, len(page))]
                at.append(len(flat))
        return np.array(flat, np.int64), np.array(at), np.array(first, np.int64), np.array(size, np.int64)

    def emissions(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros((0, 2))
        return np.add.reduceat(self.weights[flat], at[:-1], 0)

    def texts(self, pages: list[str | None]) -> list[str]:
        cut = [blocks(p) if p else [] for p in pages]
        flat, at, first, size = self.features(cut)
        label = _crf.viterbi(self.emissions(flat, at), first, size, self.step, self.begin)
        out, k = [], 0
        for page in cut:
            out.append(" ".join(b[0] for b, y in zip(page, label[k : k + len(page)]) if y))
            k += len(page)
        return out


# ---------------------------------------------------------------- labelled pages
_MARK = ""


def labelled_pages(n: int = 540) -> list[str]:
    """Pages of many layouts; the blocks of the article begin with U+E000."""
    rng = np.random.Generator(np.random.PCG64(2718))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    syl = ["th", "er", "on", "an", "re", "la", "que", "sch", "ung", "ti", "mar", "o", "é", "ein", "de", "os"]

    def prose(lo=1, hi=60):
        words = ["".join(pick(*syl) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(lo, hi + 1)))]
        odd = rng.random()
        if odd < 0.08:
            words = [w + pick(" |", "$$$", "!!", "***", ",") for w in words]
        elif odd < 0.1:
            words = [w.upper() for w in words] + [pick("©", "12", "3.5", "&amp;")]
        return " ".join(words).capitalize() + pick(".", ".", ".", "", "!", "?")

    def inline(t):
        return pick(t, t, f"<b>{t}</b>", f"<b>{t}<br>", f'{t} <a href="/x">{prose(1, 3)}</a>', f"<em>{t}</em>")

    def links(k=None):
        return "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(k or int(rng.integers(2, 9))))

    def cls(*names):
        return f'{pick("class", "class", "id")}="{pick(*names)}"'

    def replies(tags=("section", "div", "div", "ol")):
        names = ("comments", "comment-list", "comment", "disqus", "replies", "discussion", "responses", "feedback", "thread", "user-comments", "reader-comments", "talkback", "conversation", "opinions", "remarks", "respond")
        outer, inner = pick(*tags), pick("div", "p", "li", "article")
        head = pick("", f"<h3>{prose(1, 3)}</h3>", f"<h2>{prose(1, 4)}</h2>")
        one = lambda: f"<{inner}{pick('', f' {cls("comment", "reply", "message", "comment-body")}')}>{pick('', f'<b>{prose(1, 2)}</b> ', f'<a href="/u">{prose(1, 2)}</a> ')}{prose()}</{inner}>"
        return f"<{outer} {cls(*names)}>{head}{''.join(one() for _ in range(int(rng.integers(1, 5))))}</{outer}>"

    def noise():
        return pick(
            lambda: f"<div {cls('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')}>{prose()}</div>",
            lambda: f"<aside><h3>{prose(1, 4)}</h3><p>{prose()}</p><ul>{links()}</ul></aside>",
            lambda: f"<div {cls('sidebar', 'related', 'widget', 'share', 'social', 'recommended')}><h4>{prose(1, 4)}</h4><p>{prose()}</p></div>",
            lambda: f"<div {cls('cookie-notice', 'cookie', 'notice', 'consent', 'popup', 'newsletter', 'subscribe')}><p>{prose()}</p><button>{prose(1, 2)}</button></div>",
            lambda: f"<form action='/s'><label>{prose(1, 3)}</label><p>{prose(1, 20)}</p><button>{prose(1, 2)}</button></form>",
            lambda: f"<nav><ul>{links()}</ul></nav>",
            lambda: f"<div {cls('menu', 'navbar', 'breadcrumb', 'nav')}><ul>{links()}</ul></div>",
            replies,
        )()

    def body(end):
        parts = []
        if rng.random() < 0.9:
            parts.append(f"<{(h := pick('h1', 'h1', 'h2'))}>{_MARK}{prose(1, 14)}</{h}>")
        for _ in range(int(rng.integers(1, 9))):
            r = rng.random()
            if r < 0.75:
                parts.append(f"<p>{_MARK}{inline(prose())}{end}")
            elif r < 0.8:
                parts.append(f"<h2>{_MARK}{prose(1, 8)}</h2>")
            elif r < 0.85:
                parts.append("<ul>" + "".join(f"<li>{_MARK}{prose(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.9:
                parts.append(f"<blockquote>{_MARK}{prose()}</blockquote>")
            elif r < 0.91:
                parts.append(f"<div>{_MARK}{prose()}</div>")
            elif r < 0.92:
                parts.append(f"{_MARK}{prose()}<hr>")
            elif r < 0.94:
                parts.append(f"<table><tr><td>{_MARK}{prose(1, 4)}</td><td>{_MARK}{prose(1, 4)}</td></tr></table>")
            else:
                parts.append(noise())
        return "".join(parts)

    pages = []
    for _ in range(n):
        end = pick("</p>", "</p>", "")
        top = pick("", f"<header><h2>{prose(1, 5)}</h2><p>{prose(1, 20)}</p><nav><ul>{links()}</ul></nav></header>", f"<nav><ul>{links()}</ul></nav>", f"<header><div>{prose(1, 6)}</div></header>", f"<div {cls('header', 'masthead', 'top')}>{prose(1, 8)}</div><div {cls('menu', 'nav')}><ul>{links()}</ul></div>")
        foot = pick("", f"<footer>&copy; {prose(1, 4)} &middot; {prose(1, 30)}</footer>", f"<footer><p>{prose()}</p><ul>{links()}</ul></footer>", f"<div {cls('footer', 'copyright', 'bottom')}><p>&copy; {prose(1, 20)}</p></div>")
        kind = pick("article", "article", "article", "main", "div", "both", "plain", "section", "bare", "role", "center", "table", "nested")
        main = body(end)
        if rng.random() < 0.25:
            main += replies()
        if kind == "article":
            main = f"<article>{main}</article>"
        elif kind == "main":
            main = f"<main>{main}</main>"
        elif kind == "both":
            main = f"<main {cls('content', 'main')}>{noise() if rng.random() < 0.3 else ''}<article>{main}</article>{noise() if rng.random() < 0.3 else ''}</main>"
        elif kind == "div":
            main = f"<div {cls('content', 'post', 'entry-content', 'article-body', 'story', 'main', 'post-content')}>{main}</div>"
        elif kind == "section":
            main = f"<section>{main}</section>"
        elif kind == "bare":
            main = f"<div>{main}</div>"
        elif kind == "nested":
            main = f"<div><section><div>{main}</div></section></div>"
        elif kind == "role":
            main = f'<div role="main">{main}</div>'
        elif kind == "center":
            main = f"<center>{main}</center>"
        elif kind == "table":
            side = f"<td>{pick(lambda: f'<ul>{links()}</ul>', lambda: ' '.join(f'<a href=/{i}>{prose(1, 2)}</a>' for i in range(int(rng.integers(2, 6)))), lambda: '<br>'.join(f'<a href=/{i}>{prose(1, 2)}</a>' for i in range(int(rng.integers(2, 6)))))()}</td>"
            main = f"<table><tr>{pick(side, '')}<td>{main}</td>{pick(side, '', '')}</tr></table>"
        mess = [noise() for _ in range(int(rng.integers(0, 3)))]
        mid = "".join([*mess[:1], main, *mess[1:]])
        page = f"<!DOCTYPE html><html><head><title>{prose(1, 14)}</title></head><body>{top}{mid}{foot}</body></html>"
        if rng.random() < 0.1:
            page = page[: int(rng.integers(len(page) // 2, len(page)))]
        pages.append(page)
    pages += [f"{_MARK}{prose(3, 60)}" for _ in range(8)] + [f"<p>{_MARK}{prose(3, 60)}</p><p>{_MARK}{prose(3, 60)}" for _ in range(8)]
    return pages


def train(pages: list[str] | None = None, steps: int = 200, ridge: float = 3e-4) -> Extractor:
    """Fit the field to labelled pages."""
    cut = [blocks(p) for p in pages or labelled_pages()]
    gold = np.array([b[0].startswith(_MARK) for page in cut for b in page], np.int64)
    cut = [[(b[0].replace(_MARK, "").strip() or "x", *b[1:]) for b in page] for page in cut]
    count: dict[str, int] = {}
    for page in cut:
        for k, (text, above, tag, links) in enumerate(page):
            for f in (*above, *_own(text, tag, links, k, len(page))):
                count[f] = count.get(f, 0) + 1
    e = Extractor({f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 3))})
    flat, at, first, size = e.features(cut)
    block = np.repeat(np.arange(len(at) - 1), np.diff(at))
    theta = {"weights": e.weights, "step": e.step, "begin": e.begin}

    def grads():
        delta, d_step, d_begin = _crf.gradient(e.emissions(flat, at), first, size, e.step, e.begin, gold)
        g = np.stack([np.bincount(flat, delta[block, y], len(e.weights)) for y in (0, 1)], 1)
        return {p: x / len(first) - ridge * theta[p] for p, x in (("weights", g), ("step", d_step), ("begin", d_begin))}

    _crf.adam(theta, grads, steps, 0.2)
    return e


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = pages.sparkSession.sparkContext.broadcast(train())
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            for lo, hi in c.slices(c.buffers(b["html"])[1]):
                texts = model.value.texts(b["html"].slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b["page_id"].slice(lo, hi - lo), b["url"].slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
