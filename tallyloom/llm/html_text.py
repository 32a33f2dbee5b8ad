"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags. Each block has features of its ancestors' tags,
class and id words, and of its text. The chain labels blocks as main text or not; it is trained by gradient descent on
the exact likelihood over labelled pages, and decoded by Viterbi. The labelled pages are composed by
:func:`labelled_pages` from layouts of public web pages (articles, blogs, shops, forums) with random words, so that
position, markup and text shape are all there is to learn from.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import struct_of, table

#: Tags that end a block, and tags whose content is raw and no text of the page (textarea is a form's).
BLOCK = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript object ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul video".split()
)
RAW = frozenset("script style template textarea title".split())
#: Tags that an opening tag of the same group ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CUES = {
    "copyright": re.compile(r"©|\bcopyright\b|all rights reserved", re.I),
    "notice": re.compile(r"\bcookies?\b|\bconsent\b|\bprivacy\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b", re.I),
    "reply": re.compile(r"\breply\b|\bcomments?\b|\bposted by\b|\bsays:", re.I),
    "share": re.compile(r"\bshare\b|\btweet\b|\brelated\b|\bread more\b|\badvertisement\b|\bsponsored\b", re.I),
}


@dataclass
class Block:
    """``under`` has the ancestors' tags and ``inner`` the nearest one; ``marks`` words of their classes, ids, roles."""

    text: str
    under: frozenset[str]
    inner: str
    marks: frozenset[str]
    linked: float


class _Tags:
    """Where the tags of a page end. A quote counts only as the start of an attribute's value; one that is never
    closed is an ordinary character, and so are all once a tag has been found open at the end of the page. So each
    character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.lost, self.plain = page, set(), False

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 if there is none."""
        i = at
        while not self.plain and (m := _STOP.search(self.page, i)):
            i = m.start()
            c = self.page[i]
            if c == ">":
                return i
            if c not in self.lost and self._after_equals(at, i):
                close = self.page.find(c, i + 1)
                if close < 0:
                    self.lost.add(c)
                else:
                    i = close
            i += 1
        self.plain = True
        return self.page.find(">", at)

    def _after_equals(self, at: int, i: int) -> bool:
        i -= 1
        while i > at and self.page[i].isspace():
            i -= 1
        return self.page[i] == "="


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order, with character references decoded and white space made single.

    ``known`` bounds the marks that are kept to those that a model has weights for. Time is linear in the page.
    """
    page = page or ""
    out: list[Block] = []
    none: frozenset[str] = frozenset()
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    in_link, size_linked, link_depth = False, 0, 0
    tags, endless = _Tags(page), set()

    def flush() -> None:
        nonlocal size_linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                inner, under, marks = stack[-1] if stack else ("", none, none)
                out.append(Block(text, under, inner, marks, min(1.0, size_linked / len(text))))
        size_linked = 0

    def put(piece: str) -> None:
        nonlocal size_linked
        if piece:
            parts.append(piece)
            size_linked += len(piece) if in_link else 0

    at = seek = 0
    while (start := page.find("<", seek)) >= 0:
        m = _NAME.match(page, start + 1)
        if m is None and page[start + 1 : start + 2] not in ("!", "?"):
            seek = start + 1
            continue
        put(page[at:start])
        if m is None:
            comment = page.startswith("<!--", start)
            stop = page.find("-->" if comment else ">", start + 2)
            if stop < 0 and not comment:
                at = start
                break
            at = seek = len(page) if stop < 0 else stop + (3 if comment else 1)
            continue
        stop = tags.end(m.end())
        if stop < 0:  # no tag ends from here on: the rest is text
            at = start
            break
        attrs, name, at = page[m.end() : stop], m[0].lower(), stop + 1
        seek = at
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                in_link = False
            elif name in BLOCK:
                flush()
                if opened[name]:
                    while True:
                        tag = stack.pop()[0]
                        opened[tag] -= 1
                        if tag == name:
                            break
                if len(stack) < link_depth:
                    in_link = False
            continue
        empty = attrs.rstrip().endswith("/")
        if name in RAW and not empty and name not in endless:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if end:
                stop = page.find(">", end.end())
                at = seek = stop + 1 if stop >= 0 else len(page)
            elif name == "template":
                endless.add(name)
            else:
                at = seek = len(page)
        elif name == "a":
            in_link, link_depth = True, len(stack)
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            if name == "hr" or empty:
                continue
            while stack and (stack[-1][0] in CLOSES.get(name, ()) or stack[-1][0] == "p" and name != "button"):
                opened[stack.pop()[0]] -= 1
            _, under, marks = stack[-1] if stack else ("", none, none)
            if attrs:
                new = {w for a in _ATTR.finditer(attrs) for w in _SPLIT.split(a[2].lower()) if len(w) > 1 and w not in marks and (known is None or w in known)}
                marks = marks | new if new else marks
            stack.append((name, under if name in under else under | {name}, marks))
            opened[name] += 1
    put(page[at:])
    flush()
    return out


def block_features(bs: list[Block]) -> list[list[str]]:
    """Names of the features of each block, by itself and by its place in the page."""
    out = []
    n = len(bs)
    for k, b in enumerate(bs):
        words = b.text.split()
        f = ["bias"]
        f += [f"under:{t}" for t in b.under] + [f"mark:{w}" for w in b.marks]
        f.append(f"in:{b.inner}")
        f.append(f"words:{np.searchsorted((2, 4, 8, 15, 30, 60), len(words), side='right')}")
        f.append(f"linked:{np.searchsorted((0.01, 0.2, 0.5, 0.9), b.linked, side='right')}")
        f.append("stop:" + str(b.text[-1] in ".!?…。"))
        f.append("commas:" + str(min(2, b.text.count(","))))
        f.append(f"place:{4 * k // n}")
        f += [f"cue:{c}" for c, p in _CUES.items() if len(words) < 40 and p.search(b.text)]
        if not {"article", "main"} & b.under:
            f.append(f"loose:{len(words) > 15}")
        out.append(f)
    return out


_SYLLABLES = "ra le mi ton ser va dor ki nu pel sta ver bo lin gra mo ti sen cal fo re".split()


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for k in range(len(words) - 1):
        if r.random() < 0.08:
            words[k] += ","
    return " ".join(words).capitalize() + r.choice(("...", ".", ".", ".", "!", "?", "")[0 if r.random() < 0.05 else 1 :])


def _text(r: random.Random, sentences: int) -> str:
    return " ".join(_sentence(r, 4, 18) for _ in range(sentences))


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_sentence(r, 1, 3).rstrip(".!?")}</a></{tag}>' for i in range(n))


def _page(r: random.Random) -> str:
    """A page whose main blocks begin with a mark character; the marks are taken out after the blocks are cut."""
    m = "\x00"
    pick = r.choice
    small = lambda: _text(r, r.randint(1, 3))

    def body() -> str:
        out = [f"<h1>{m}{_sentence(r, 3, 9)}</h1>"] * (r.random() < 0.85)
        if r.random() < 0.3:
            out.append(f'<div class="{pick(("share", "social", "share-buttons", "toolbar"))}">{_links(r, 3, "span")}</div>')
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.06:
                out.append(f"<p>{m}{pick(('Copyright', '©', 'Licensed under', 'All rights reserved', 'Please subscribe', 'Read more', 'The comments', 'Your cookies'))} {_sentence(r, 1, 6)}</p>")
            elif kind < 0.1:
                out.append(f"<p>{m}{pick(('All rights reserved.', 'Copyright 2020.', _sentence(r, 1, 2)))}</p>")
            elif kind < 0.68:
                t = f"{m}{_text(r, r.randint(1, 6))}"
                t = t.replace(" ", "<br>", 1) if r.random() < 0.1 else t
                t = f"<b>{t}" if r.random() < 0.08 else t
                t = t + f' <a href="#">{_sentence(r, 1, 3)}</a> {_sentence(r, 3, 8)}' if r.random() < 0.15 else t
                out.append(f"<p>{t}" + "</p>" * (r.random() < 0.85))
            elif kind < 0.76:
                level = pick("2234")
                out.append(f"<h{level}>{m}{_sentence(r, 1, 6)}</h{level}>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{m}{_sentence(r, 2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{m}{small()}</blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{m}{_sentence(r, 1, 3)}</td><td>{m}{_sentence(r, 1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.92:
                out.append(f"<pre>{m}{small()}</pre>")
            elif kind < 0.97:
                out.append(f'<div class="{pick(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "related", "newsletter"))}">{pick((small(), "<p>" + small() + "</p>"))}</div>')
            else:
                out.append(f"<figure><figcaption>{m}{_sentence(r, 3, 12)}</figcaption></figure>")
        return "".join(out)

    def comments() -> str:
        wrap, name = pick((("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "discussion responses"), ("div", "reader-comments")))
        item = "li" if wrap == "ol" else pick(("div", "article"))
        return f'<{wrap} {pick(("class", "id"))}="{name}"><h3>{pick(("Comments", "3 comments", "Responses"))}</h3>' + "".join(f'<{item} class="comment"><p>{small()}</p></{item}>' for _ in range(r.randint(1, 4))) + f"</{wrap}>"

    def form() -> str:
        return f'<form action="/s">{pick(("", "<label>" + _sentence(r, 1, 3) + "</label>"))}<p>{_sentence(r, 2, 10)}</p><select><option>{_sentence(r, 1, 2)}</select><button>{_sentence(r, 1, 2)}</button></form>'

    def notice() -> str:
        return f'<div {pick(("class", "id"))}="{pick(("cookie", "cookie-banner", "notice", "alert", "consent", "gdpr", "popup", "modal", "notification", "disclaimer", "warning"))}"><p>{small()}</p></div>'

    def aside() -> str:
        tag = pick(("aside", "div", "div", "section"))
        inner = pick((f"<ul>{_links(r, r.randint(2, 6))}</ul>", f"<p>{small()}</p>", f"<h3>{_sentence(r, 1, 3)}</h3><p>{small()}</p>"))
        mark = "" if tag == "aside" and r.random() < 0.5 else f' class="{pick(("sidebar", "side", "widget", "widget-area", "related", "related-posts", "recommended", "promo", "trending", "popular", "toc", "author-bio"))}"'
        return f"<{tag}{mark}>{inner}</{tag}>"

    def ad() -> str:
        return f'<!-- ad --><div {pick(("class", "id"))}="{pick(("ad", "ads", "advert", "advertisement", "adsbox", "sponsor", "sponsored", "banner-ad", "promo", "ad-slot"))}">{pick((small(), "<p>" + small() + "</p>"))}</div>'

    def nav() -> str:
        tag, mark = pick((("nav", ""), ("nav", ""), ("div", "nav"), ("div", "menu"), ("ul", "main-menu"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "breadcrumbs"), ("div", "pagination")))
        mark = f' class="{mark}"' * bool(mark)
        return f"<{tag}{mark}>" + (_links(r, r.randint(2, 8)) if tag == "ul" else f"<ul>{_links(r, r.randint(2, 8))}</ul>" if r.random() < 0.7 else _links(r, r.randint(2, 6), "span")) + f"</{tag}>"

    def header() -> str:
        tag, mark = pick((("header", ""), ("header", ""), ("div", "header"), ("div", "site-header"), ("div", "masthead"), ("div", "top-bar")))
        mark = f' id="{mark}"' * bool(mark)
        return f"<{tag}{mark}><{pick(('h1', 'div', 'p', 'h2'))}>{_sentence(r, 1, 6)}</div>{pick(('', '<p>' + _sentence(r, 3, 9) + '</p>'))}</{tag}>"

    def footer() -> str:
        tag, mark = pick((("footer", ""), ("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "legal"), ("div", "bottom copyright")))
        mark = f' class="{mark}"' * bool(mark)
        inner = pick((f"&copy; {_sentence(r, 1, 3)} &middot; {_sentence(r, 2, 9)}", f"<p>{small()}</p>", f"<ul>{_links(r, 4)}</ul><p>&copy; {_sentence(r, 1, 4)}</p>", small()))
        return f"<{tag}{mark}>{inner}</{tag}>"

    head = "".join(f() for f in r.sample([nav, header, notice, ad, form], r.randint(1, 5)))
    tail = "".join(f() for f in r.sample([comments, aside, form, ad, notice, footer, footer], r.randint(1, 6))) + footer() * (r.random() < 0.6)
    tag, mark = pick((("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("div", "article-body"), ("div", "story"), ("section", "post-body"), ("main", "content"), ("div", "main"), ("div", "")))
    mark = f' {pick(("class", "id"))}="{mark}"' * bool(mark)
    main = f"<{tag}{mark}>{body()}{comments() if r.random() < 0.12 else ''}</{tag}>"
    if r.random() < 0.4:
        main = f'<div {pick(("class", "id"))}="{pick(("wrapper", "container", "page", "layout", "row", "site"))}">{main}{aside() if r.random() < 0.5 else ""}</div>'
    if r.random() < 0.2:
        main = f"<main>{main}</main>"
    return f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 6)}</title><style>p{{}}</style></head><body>{head}{main}{tail}</body></html>"


def labelled_pages(n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """n pages as blocks, each labelled 1 for main text and 0 for all else."""
    r, out = random.Random(seed), []
    while len(out) < n:
        bs = blocks(_page(r))
        y = [int("\x00" in b.text) for b in bs]
        for b in bs:
            b.text = " ".join(b.text.replace("\x00", "").replace("�", "").split()) or "."
        out.append((bs, y))
    return out


@dataclass
class Crf:
    """``weights`` per feature and label, ``step`` from label to label, ``ends`` for the first and the last block."""

    weights: dict[str, np.ndarray]
    step: np.ndarray
    ends: np.ndarray

    @functools.cached_property
    def known(self) -> frozenset[str]:
        return frozenset(f[5:] for f in self.weights if f.startswith("mark:"))

    def scores(self, bs: list[Block]) -> np.ndarray:
        get, none = self.weights.get, np.zeros(2)
        return np.array([sum((get(f, none) for f in fs), none) for fs in block_features(bs)]).reshape(len(bs), 2)

    def decode(self, bs: list[Block]) -> list[int]:
        """The best labels by Viterbi; ties take label 0."""
        if not bs:
            return []
        s = self.scores(bs)
        v, back = self.ends[0] + s[0], []
        for t in range(1, len(s)):
            via = v[:, None] + self.step
            back.append(via.argmax(0))
            v = via.max(0) + s[t]
        y = [int((v + self.ends[1]).argmax())]
        for b in back[::-1]:
            y.append(int(b[y[-1]]))
        return y[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 150, decay: float = 0.002) -> Crf:
    """Gradient ascent (Adam) on the log likelihood of all pages at once, by forward and backward sums."""
    pages = [p for p in pages if p[0]]
    feats = [block_features(bs) for bs, _ in pages]
    index: dict[str, int] = {}
    row, col = [], []
    n, longest = len(pages), max(len(bs) for bs, _ in pages)
    y, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (bs, labels) in enumerate(pages):
        y[p, : len(bs)], real[p, : len(bs)] = labels, True
        for t, fs in enumerate(feats[p]):
            for f in fs:
                row.append(p * longest + t)
                col.append(index.setdefault(f, len(index)))
    row, col = np.array(row), np.array(col)
    last = real.sum(1) - 1
    size = len(index)
    theta = np.zeros(2 * size + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n)[:, None], np.arange(longest), y] = real
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
    for k in range(1, steps + 1):
        w, step, ends = theta[: 2 * size].reshape(size, 2), theta[2 * size : 2 * size + 4].reshape(2, 2), theta[2 * size + 4 :].reshape(2, 2)
        s = np.stack([np.bincount(row, w[col, c], n * longest) for c in (0, 1)], 1).reshape(n, longest, 2)
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = ends[0] + s[:, 0]
        for t in range(1, longest):
            fwd[:, t] = _logsum(fwd[:, t - 1, :, None] + step, 1) + s[:, t]
        bwd[np.arange(n), last] = ends[1]
        for t in range(longest - 2, -1, -1):
            inner = t < last
            bwd[inner, t] = _logsum(step[None] + (s[inner, t + 1] + bwd[inner, t + 1])[:, None, :], 2)
        z = _logsum(fwd[np.arange(n), last] + ends[1], 1)
        seen = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        e = (gold - seen).reshape(-1, 2)
        g = np.stack([np.bincount(col, e[row, c], size) for c in (0, 1)], 1).ravel()
        two = np.exp(fwd[:, :-1, :, None] + step + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        g_ends = np.stack([gold[:, 0].sum(0) - seen[:, 0].sum(0), (gold - seen)[np.arange(n), last].sum(0)])
        g = np.concatenate((g, (pairs - two.sum((0, 1))).ravel(), g_ends.ravel())) / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    w = theta[: 2 * size].reshape(size, 2)
    return Crf({f: w[i].copy() for f, i in index.items()}, theta[2 * size : 2 * size + 4].reshape(2, 2), theta[2 * size + 4 :].reshape(2, 2))


@functools.lru_cache(1)
def trained(pages: int = 500) -> Crf:
    return fit(labelled_pages(pages))


def main_text(page: str | None, model: Crf) -> str:
    """Main blocks of a page, joined by a space; empty for null and empty pages and for pages without main text."""
    bs = blocks(page, model.known)
    return " ".join(b.text for b, y in zip(bs, model.decode(bs)) if y)


def extract(pages: DataFrame, model: Crf | None = None, html_col: str = "html", out: str = "extracted") -> DataFrame:
    """``pages`` with a struct of the main text and its length in code points.

    Null html is empty. Unclosed tags, stray ends and cut pages are read as far as they go. Rows are read one by one:
    repeated rows repeat their text, an empty table gives an empty result. A column named ``out`` is replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf(struct_of("text string, n_chars long"))
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in parts:
            text = [main_text(h, sent.value) for h in html]
            yield pd.DataFrame({"text": text, "n_chars": list(map(len, text))})

    return pages.withColumn(out, read.asNondeterministic()(html_col))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "extracted.text", "extracted.n_chars")
