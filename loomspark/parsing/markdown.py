"""HTML to markdown and fenced code, as functions over one text; columns get them by Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import batches

_DROP = {"script", "style", "nav", "header", "footer", "button", "form", "noscript", "svg", "template"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_CALLOUT = re.compile(r"\b(note|tip|caution|warning)\b")
_SPECIAL = re.compile(r"([\\`*_\[\]])")


class _Converter(HTMLParser):
    """Writes markdown while the page is read: ATX headings, * bullets, fences, tables, links, callouts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.links: list[tuple[str | None, int]] = []
        self.pre: tuple[str, int] | None = None
        self.row: list[str] | None = None
        self.cell: int | None = None
        self.rows = 0
        self.quotes: list[tuple[str, int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        if self.skip or tag in _DROP or at.get("aria-hidden") == "true":
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("p", "article", "section", "main", "table"):
            self.out.append("\n\n")
            self.rows = 0 if tag == "table" else self.rows
        elif tag in ("div", "aside", "blockquote"):
            kind = _CALLOUT.search(at.get("class", "").lower())
            self.out.append("\n\n")
            if kind or tag == "blockquote":
                self.quotes.append((tag, len(self.out), kind[1].upper() if kind else ""))
        elif tag == "br":
            self.out.append("\n" if self.pre else "  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("del", "s", "strike"):
            self.out.append("~~")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = "*" if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
            self.out.append("\n" + "  " * (len(self.lists) - 1) + mark + " ")
        elif tag == "input" and at.get("type") == "checkbox":
            self.out.append("[x] " if "checked" in at else "[ ] ")
        elif tag == "pre":
            self.pre = (at.get("class", ""), len(self.out))
        elif tag == "code" and self.pre is None:
            self.out.append("`")
        elif tag == "code" and self.pre is not None:
            self.pre = (self.pre[0] + " " + at.get("class", ""), self.pre[1])
        elif tag == "a":
            self.links.append((at.get("href"), len(self.out)))
        elif tag == "img" and at.get("src"):
            self.out.append(f"![{at.get('alt', '')}]({at['src']})")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = len(self.out)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("del", "s", "strike"):
            self.out.append("~~")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag == "pre" and self.pre is not None:
            css, at = self.pre
            code = "".join(self.out[at:]).strip("\n")
            del self.out[at:]
            self.out.append(f"\n\n```{language(code, css)}\n{code}\n```\n\n")
            self.pre = None
        elif tag == "code" and self.pre is None:
            self.out.append("`")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = "".join(self.out[at:])
            if href:
                del self.out[at:]
                self.out.append(f"[{label.strip()}]({href})")
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.out[self.cell :]).split()).replace("|", "\\|"))
            del self.out[self.cell :]
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.out.append(("" if self.rows else "\n") + "| " + " | ".join(self.row) + " |\n" + ("" if self.rows else "| " + " | ".join("---" for _ in self.row) + " |\n"))
            self.rows, self.row = self.rows + 1, None
        elif tag in ("div", "aside", "blockquote") and self.quotes and self.quotes[-1][0] == tag:
            _, at, kind = self.quotes.pop()
            inner = "".join(self.out[at:]).strip()
            del self.out[at:]
            head = f"> [!{kind}]\n" if kind else ""
            self.out.append("\n\n" + head + "\n".join(("> " + x).rstrip() for x in inner.splitlines()) + "\n\n")
        elif tag[0] == "h" and tag[1:].isdigit() or tag == "p":
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.pre is not None:
            self.out.append(data)
        else:
            self.out.append(_SPECIAL.sub(r"\\\1", re.sub(r"\s+", " ", data)))


def language(code: str, css: str = "") -> str:
    """A code block's language by its class, else by what it holds; '' if nothing tells."""
    if m := re.search(r"(?:lang|language)-([a-zA-Z0-9_-]+)", css):
        return m[1].lower()
    for name, rule in (("sql", r"SELECT|FROM|WHERE|JOIN|INSERT|UPDATE|CREATE TABLE"), ("python", r"def |import |print\(|class "), ("bash", r"bq |gcloud |curl |npm |git |pip "), ("json", r"^\s*\{[\s\S]*\}\s*$")):
        if re.search(rule, code, 0 if name == "json" else re.I):
            return name
    return ""


def html_to_markdown(source: str | None) -> str:
    """A page's article (else its main element, else its body) as markdown; runs of blank lines and empty headings go."""
    source = source or ""
    for tag in ("article", "main", "body"):
        m = re.search(rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\Z)", source)
        if m and (tag == "body" or len(re.sub(r"<[^>]*>", "", m[1]).strip()) > 100):
            source = m[1]
            break
    c = _Converter()
    c.feed(source)
    c.close()
    text = re.sub(r"(?m)^#{1,6}[ \t]*$", "", "".join(c.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", text)).strip()


_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^\s`]*)[^\n]*\n(.*?)^\1\2[ \t]*$", re.M | re.S)


def code_blocks(markdown: str | None) -> list[dict]:
    """Fenced blocks of over ten characters: id, language, code, is_executable."""
    found = []
    for m in _FENCE.finditer((markdown or "").replace("\r\n", "\n")):
        code = m[4].strip()
        if len(code) > 10:
            lang = m[3].lower() or language(code) or "text"
            found.append({"id": f"code-{len(found) + 1}", "language": lang, "code": code, "is_executable": lang in ("sql", "python", "bash", "sh")})
    return found


def absolute_links(body: str | None, base: str, root: str = "") -> str:
    """Relative links and images resolved against a document's address, root-relative ones against the repository's root."""
    from urllib.parse import urljoin

    if "://" not in (base or ""):
        return body or ""

    def to(m: re.Match) -> str:
        href = m[2]
        if re.match(r"(?i)(https?:|mailto:|#|data:|upload:|git:)", href):
            return m[0]
        return m[1] + (urljoin(root, href.lstrip("/")) if href.startswith("/") and root else urljoin(base, href)) + m[3]

    return re.sub(r'(!?\[[^\]]*\]\()([^)\s]+)(\s*(?:"[^"]*")?\))', to, body or "")


# ---------------------------------------------------------------- columns


def markdown_of(c: Column) -> Column:
    """html_to_markdown over a column."""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(html_to_markdown, na_action=None)

    batches.small()
    return run(c)


def absolute_links_of(body: Column, base: Column, root: Column) -> Column:
    """absolute_links over columns."""

    @F.pandas_udf("string")
    def run(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, bases, roots in series:
            yield pd.Series([absolute_links(b, x or "", r or "") for b, x, r in zip(bodies, bases, roots)], dtype=object)

    batches.small()
    return run(body, base, root)


def code_blocks_of(c: Column) -> Column:
    """code_blocks over a column."""

    @F.pandas_udf("array<struct<id:string,language:string,code:string,is_executable:boolean>>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(code_blocks, na_action=None)

    batches.small()
    return run(c)
