"""HTML extraction by a tree-structured graphical model over the DOM.

Each element and each run of text is a node with two states, content or not. Node potentials are a logistic
model over what a node shows by itself (tag, class and id words, length, share of links, place); edge
potentials say how a child's state goes with its parent's. Sum-product messages go up the tree and down again
and leave exact marginals; a text node is content where its marginal reaches one half.

Both kinds of potentials are trained together, by maximum likelihood, on labelled pages: a bounded sample of pages
with an article element, whose text outside unwanted parts is content; each is shown once more with an unwanted
part and another form of content put in. All pages are then scored in one pass over the table.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: Labelled pages that the model is trained on, at most, and steps of the training.
TRAIN_PAGES, STEPS = 100, 150
#: A start tag: name, attributes. A quote is one only after an equals sign; no part is ever read twice.
_START = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+|=)*+)>""")
_PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"</([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "noframes", "template", "iframe", "xmp")}
_SILENT = {"script", "style", "noscript", "template", "iframe", "textarea", "select", "option", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "xmp"}
#: Start tags that leave an open head open; any other one ends it, and so does text.
_IN_HEAD = {"html", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "button", "select", "label",
}
#: A start tag ends an open element of these kinds (nearest first), as HTML has it.
_ENDS_P = _BLOCK - {"br", "button", "select", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "aside", "body", "html", "nav", "header", "footer", "form", "blockquote"}
#: What an end tag of a block does not reach beyond, and the parts of tables, which do.
_CELLS = {"table", "td", "th", "object"}
_TABLE = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "object", "body", "html"}
_GOOD, _BAD = ("article", "content", "story", "post", "entry", "text", "main", "body"), (
    "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "comment", "comments", "disqus", "replies", "reply", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "sidebar", "widget", "related", "share", "social", "footer", "header", "masthead", "cookie", "cookies", "consent",
    "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "form", "copyright", "legal", "pagination", "pager", "toolbar", "skip", "hidden",
)
_UNWANTED_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_UNWANTED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
_KINDS = ({""}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "table", "tr", "td"}, {"a"}, {"div", "section"}, {"body", "html", "#root", "head"}, {"b", "i", "em", "strong", "span", "code"})
_BY_TAG = {tag: (1.0, *(float(tag in kind) for kind in _KINDS)) for kind in _KINDS for tag in kind}
_OTHER = (1.0, *(0.0 for _ in _KINDS))
_MAIN = len(_OTHER)
_FEATURES = _MAIN + 7


class Page:
    """A page's nodes in page order, so that a parent stands before its children. Text nodes have no tag."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.role, self.text, self.hidden = [-1], ["#root"], [()], [""], [""], [False]
        #: Open elements, the depths of those of each name, of the scopes and the cells among them, and how many are silent.
        self.stack, self.depths, self.scopes, self.cells, self.silent = [0], {}, [0], [0], 0
        at, n, last, start_tag, once = 0, len(source), source.rfind(">"), _START, set()
        while at < n:
            sign = source.find("<", at)
            while 0 <= sign < last and not (source[sign + 1].isalpha() or source[sign + 1] in "/!?"):  # a lone sign is text
                sign = source.find("<", sign + 1)
            if sign < 0 or sign > last and not source.startswith("<!--", sign):  # no tag that opens here ends
                sign = n
            if sign > at:
                self._say(source[at:sign])
            if sign == n:
                break
            mark = source[sign + 1]
            if mark in "!?":
                end = source.find("-->", sign + 2) if source.startswith("<!--", sign) else source.find(">", sign)
                at = n if end < 0 else end + (3 if source.startswith("<!--", sign) else 1)
                continue
            if mark == "/":
                at = source.find(">", sign) + 1
                if m := _NAME.match(source, sign):
                    self._end(m[1].lower())
                continue
            m = start_tag.match(source, sign)
            if not m and start_tag is _START:  # a quote hides the last ends of tags: from here on none does
                start_tag = _PLAIN
                m = start_tag.match(source, sign)
            if not m:  # a letter that no tag begins with
                self._say(source[sign])
                at = sign + 1
                continue
            at, name = m.end(), m[1].lower()
            if name in ("html", "head", "body"):
                if name in once or name == "head" and "body" in once:
                    continue
                once.add(name)
            if self.silent and name not in _IN_HEAD:
                self._close(("head",))
            if name in _ENDS_P:
                self._close(("p",))
            if name in _ENDS:
                self._close(_ENDS[name])
            raw = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(m[2])} if m[2] else {}
            node = self._add(self.stack[-1], name, raw)
            if name in _VOID or m[2].endswith("/") and name in ("svg", "path", "use", "math"):
                continue
            if name in _RAW:
                end = _RAW[name].search(source, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    break
                continue  # the others are left out alone, without an end tag
            self._open(node)

    def _say(self, text: str) -> None:
        if self.silent and self.tag[self.stack[-1]] == "head" and text.strip():
            self._close(("head",))
        if not self.silent:
            self._add(self.stack[-1], "", text=text)

    def _open(self, node: int) -> None:
        name, depth = self.tag[node], len(self.stack)
        self.stack.append(node)
        self.depths.setdefault(name, []).append(depth)
        if name in _SCOPE:
            self.scopes.append(depth)
        if name in _CELLS:
            self.cells.append(depth)
        self.silent += name in _SILENT

    def _pop_to(self, depth: int) -> None:
        """Ends the element at this depth and what is open in it."""
        while len(self.stack) > depth:
            name = self.tag[self.stack.pop()]
            self.depths[name].pop()
            if name in _SCOPE:
                self.scopes.pop()
            if name in _CELLS:
                self.cells.pop()
            self.silent -= name in _SILENT

    def _close(self, names) -> None:
        """Ends the nearest open element of these names, if no scope lies between."""
        depth = max((self.depths[x][-1] for x in names if self.depths.get(x)), default=-1)
        if depth > 0 and depth >= self.scopes[-1]:
            self._pop_to(depth)

    def _end(self, name: str) -> None:
        """An end tag: of a block up to the next cell, of another element up to the next scope."""
        depth = self.depths[name][-1] if self.depths.get(name) else -1
        wall = 0 if name in _TABLE else self.cells[-1] if name in _BLOCK and name not in ("p", "li") else self.scopes[-1]
        if depth > 0 and depth >= wall:
            self._pop_to(depth)
        elif name in ("p", "br"):
            self._add(self.stack[-1], "br")

    def _add(self, parent: int, tag: str, raw: dict | None = None, text: str = "") -> int:
        raw = raw or {}
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(tuple(re.findall(r"[a-z]+", f"{raw.get('class', '')} {raw.get('id', '')}".lower())))
        self.role.append(raw.get("role", "").lower())
        self.text.append(html.unescape(text) if "&" in text else text)
        self.hidden.append("hidden" in raw or raw.get("aria-hidden") == "true" or "display:none" in raw.get("style", "").replace(" ", ""))
        return len(self.tag) - 1

    def features(self) -> list[tuple]:
        """A row per node; lengths and links of an element are those of what it holds."""
        n, parent, tags = len(self.tag), self.parent, self.tag
        chars, linked, stops, in_link = [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            in_link[k] = in_link[parent[k]] or tags[k] == "a"
            if not tags[k]:
                text = self.text[k]
                chars[k] = size = len(text.strip())
                linked[k] = size if in_link[k] else 0
                stops[k] = text.count(".") + text.count(",")
        for k in range(n - 1, 0, -1):
            up = parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            stops[up] += stops[k]
        rows = []
        for k in range(n):
            tag, words = tags[k], self.words[k]
            main = tag in ("article", "main") or self.role[k] in ("article", "main")
            size = chars[k] or 1
            rows.append((
                *_BY_TAG.get(tag, _OTHER), main, self.unwanted(k), bool(words) and any(w in _GOOD for w in words), bool(words) and any(w in _BAD for w in words),
                min(1.0, chars[k] / 200), linked[k] / size, min(1.0, 10 * stops[k] / size),
            ))
        return rows

    def unwanted(self, k: int) -> bool:
        return self.tag[k] in _UNWANTED_TAGS or self.role[k] in _UNWANTED_ROLES or self.hidden[k]

    def labels(self) -> np.ndarray | None:
        """1 for what an article holds outside unwanted parts; none for a page without an article."""
        state, seen = np.zeros(len(self.tag), dtype=int), False
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            if self.tag[k] in ("article", "main") or self.role[k] == "main":
                state[k], seen = 1, True
            elif state[up] and not self.unwanted(k) and not any(w in _BAD for w in self.words[k]):
                state[k] = 1
        return state if seen else None

    def blocks(self, content: list[bool]) -> str:
        """Text of the content nodes; blocks are joined by one space, inline elements by nothing."""
        parts, block = [], [0] * len(self.tag)
        last, fresh = -1, False
        for k in range(1, len(self.tag)):
            tag, up = self.tag[k], self.parent[k]
            if tag:
                block[k] = k if tag in _BLOCK else block[up]
                fresh |= tag in _BLOCK
                continue
            if not content[k]:
                parts.append(" ")
                continue
            if fresh or block[up] != last:
                parts.append(" ")
            parts.append(self.text[k])
            last, fresh = block[up], False
        return " ".join("".join(parts).split())


def messages(parent: list[int], unary: list[float], edge: tuple[float, float, float]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product over trees: (log odds of content of each node, of its subtree alone, its message to its parent).

    Parents stand before their children; a root's parent is -1. unary: log potential of content against not; edge: log
    potentials of (parent, child) = (0, 1), (1, 0), (1, 1) against (0, 0).
    """
    e01, e10, e11 = map(math.exp, edge)
    n, exp, log = len(parent), math.exp, math.log
    own, sent = list(unary), [0.0] * n
    for k in range(n - 1, -1, -1):  # upward: children before parents
        up = parent[k]
        if up >= 0:
            v = exp(min(max(own[k], -200.0), 200.0))
            sent[k] = m = log((e10 + e11 * v) / (1 + e01 * v))
            own[up] += m
    odds = list(own)
    for k in range(n):  # downward: what the parent believes without this child
        up = parent[k]
        if up >= 0:
            v = exp(min(max(odds[up] - sent[k], -200.0), 200.0))
            odds[k] = own[k] + log((e01 + e11 * v) / (1 + e10 * v))
    return odds, own, sent


#: Parts that no article wants, put into labelled pages so that the model sees them there too.
_NOISE = (
    '<section class="comments"><h3>Comments</h3><p>{0}</p><p>{1}</p></section>', '<div id="comments"><div class="comment"><p>{0}</p></div></div>', '<aside><p>{0}</p></aside>',
    '<div class="ad"><p>{0}</p></div>', "<form><label>{1}</label><input><button>Go</button></form>", '<div class="share"><a href="/x">Share</a></div>', "<header><h2>{1}</h2></header>",
    '<div class="notice">{0}</div>', '<nav class="breadcrumb"><a href="/">Home</a> {1}</nav>', "<footer><p>{0}</p></footer>", '<div class="related"><ul><li><a href="/y">{1}</a></li></ul></div>',
)
#: Content in other dress than most pages have.
_CONTENT = (
    "<ul><li>{0}</li><li>{1}</li></ul>", "<table><tr><td>{1}</td><td>{0}</td></tr></table>", "<div><p>{0}</p></div>", "<blockquote>{0}</blockquote>", "<section><h2>{1}</h2><p>{0}</p></section>",
    "<p><a href='/z'>{1}</a> {0}</p>", "<div>{0}</div>", "<pre>{0}</pre>", "<p>{1}</p>", "<span>{1}</span>", "<ol><li><em>{0}</em></li></ol>",
)


def _augmented(source: str, k: int) -> str:
    """The page with some unwanted parts and some other forms of content inside its article."""
    text = re.sub(r"<[^>]*>", " ", source[source.find("<article") : source.find("</article")])
    long, short = text[:300].strip() or "Text.", text[20:40].strip() or "Text"
    at = source.find("</p>", source.find("<article"))
    at = at + 4 if at > 0 else source.find("</article")
    parts = [_NOISE[(k + 3 * i) % len(_NOISE)] for i in range(1 + k % 6)] + [_CONTENT[(k // 2 + 5 * i) % len(_CONTENT)] for i in range(1 + k % 4)]
    parts = parts[k % len(parts) :] + parts[: k % len(parts)]
    return source[:at] + "".join(x.format(long, short) for x in parts) + source[at:] if at > 0 else source


def train(pages: list[str]) -> tuple[list[float], tuple[float, float, float]]:
    """(node weights, edge logs) of most likelihood over labelled pages: expected features by sum-product against those seen."""
    xs, ys, parent = [], [], []
    for i, source in enumerate(pages):
        for page in (Page(source), Page(_augmented(source, i))):
            y = page.labels()
            if y is not None:
                base = len(parent)
                parent += [k + base if k >= 0 else -1 for k in page.parent]
                xs.append(np.array(page.features(), dtype=float))
                ys.append(y)
    if not xs:  # no labelled page: an article and what it holds
        weights = dict.fromkeys(range(_FEATURES), 0.0) | {0: -1.0, _MAIN: 12.0, _MAIN + 1: -12.0, _MAIN + 3: -12.0}
        return [weights[k] for k in range(_FEATURES)], (-4.0, -1.0, 2.0)
    x, y = np.concatenate(xs), np.concatenate(ys)
    up = np.array(parent)
    child = np.flatnonzero(up >= 0)
    up = up[child]
    seen = np.array([np.sum((y[up] == a) & (y[child] == b)) for a, b in ((0, 1), (1, 0), (1, 1))], dtype=float)
    w, first, second = np.zeros(_FEATURES + 3), np.zeros(_FEATURES + 3), np.zeros(_FEATURES + 3)
    w[_FEATURES:] = -2, -1, 1
    for turn in range(1, STEPS + 1):  # Adam's steps, shorter towards the end
        odds, own, sent = map(np.array, messages(parent, (x @ w[:_FEATURES]).tolist(), tuple(w[_FEATURES:])))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        a, b = np.exp(np.clip(odds[up] - sent[child], -50, 50)), np.exp(np.clip(own[child], -50, 50))
        both = np.exp(w[_FEATURES:])[:, None] * np.stack([b, a, a * b])
        expected = (both / (1 + both.sum(axis=0))).sum(axis=1)
        slope = (np.concatenate([x.T @ (y - p), seen - expected]) - 0.05 * w) / len(pages)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w += 0.5 * (1 - turn / (STEPS + 1)) * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return w[:_FEATURES].tolist(), tuple(w[_FEATURES:].tolist())


def extract(source: str, weights: list[float], edge: tuple[float, float, float]) -> str:
    """The main text of a page."""
    page = Page(source)
    unary = (np.array(page.features(), dtype=float) @ weights).tolist()
    return page.blocks([v >= 0 for v in messages(page.parent, unary, edge)[0]])


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """The main text of every page, by the model trained on up to `train_pages` of them.

    pages: page_id, url, html; other columns are ignored. Pages without id are extracted, but not learned from. Null html is empty; an empty page has the text ''. Result, a
    row for each row of pages: page_id, url, text, n_chars (code points).
    """
    pages = common.spread(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")))
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    # The narrow columns are ranked, then the few pages are fetched: tasks never send whole pages to be thrown away.
    chosen = common.materialize(labelled.select("page_id", F.xxhash64("page_id").alias("o")).orderBy("o", "page_id").limit(train_pages).select("page_id").distinct())
    sample = labelled.join(F.broadcast(chosen), "page_id", "left_semi").limit(train_pages).select("page_id", "html").collect()
    weights, edge = train([r.html for r in sorted(sample, key=lambda r: (r.page_id, r.html))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights, edge) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`."""
    return main_text(common.read(spark, sf_dir, "pages"))


#: The same rows by plain SQL, for pages of one article that holds no unwanted part and no characters beyond those references.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '(?i)</?(a|abbr|b|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|u)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
