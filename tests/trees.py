"""Pages read as trees, by hand: what the queries over the table of nodes are held against."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from loomspark.functions.classify import TAG_WORDS
from loomspark.operators import structure as S
from loomspark.parsing import markdown as M

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class Node:
    """An element, or a text (without a tag)."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, text: str = ""):
        self.tag, self.attrs, self.parent, self.text, self.children = tag, attrs, parent, text, []
        if parent is not None:
            parent.children.append(self)

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag and test(n)]

    def said(self, skip: Callable[[Node], bool] | None = None) -> str:
        if skip is None:
            return "".join(n.text for n in self.walk())
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag and node is not self and skip(node):
                continue
            out.append(node.text)
            stack += reversed(node.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("p", "li") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        Node("", {}, self.at, data)


def tree(source: str | None) -> Node:
    """The page's tree; unclosed elements end with what holds them."""
    parser = _Tree()
    parser.feed(source or "")
    parser.close()
    return parser.root


def _clutter(n: Node) -> bool:
    return n.tag in S.CLUTTER_TAGS or bool(n.classes & set(S.CLUTTER_CLASSES)) or n.attrs.get("role") == "button" or n.attrs.get("aria-hidden") == "true"


def page(source: str | None, url: str | None, as_of: str) -> dict:
    """All that structure.parse_pages says of a page. `as_of` is the date of pages that give none."""
    root = tree(source)
    elements = [n for n in root.walk() if n.tag]
    meta = {n.attrs.get("name") or n.attrs.get("property"): n.attrs.get("content", "") for n in reversed(elements) if n.tag == "meta"}
    first = lambda test: next((n for n in elements if test(n)), None)
    heading, named = first(lambda n: n.tag == "h1"), first(lambda n: n.tag == "title")
    title = heading.said().strip() if heading else ""
    if not title:
        title = re.sub(r"\s*\|.*$", "", meta.get("og:title") or (named.said().strip() if named else "")).strip()
    description = meta.get("description") or meta.get("og:description") or ""
    if not description:
        within = lambda n: n is not None and (n.tag in ("article", "main", "body") or "devsite-article-body" in n.classes or within(n.parent))
        if paragraph := first(lambda n: n.tag == "p" and within(n.parent)):
            said = paragraph.said().strip()
            description = said.split(".")[0] + "." if len(said) > 20 else ""
    description = " ".join(description.split())
    in_crumbs = lambda n: n is not None and ("breadcrumbs" in n.classes or n.attrs.get("aria-label") == "Breadcrumb" or in_crumbs(n.parent))
    crumbs = [t for n in elements if n.classes & {"devsite-breadcrumb-item", "breadcrumb", "breadcrumbs__link"} or n.tag == "li" and in_crumbs(n.parent) if (t := n.said().strip()) and t not in ("/", ">")]
    section = crumbs[-2] if len(crumbs) > 1 else ""
    if not section and (n := first(lambda n: n.classes & {"devsite-nav-heading", "devsite-nav-title-no-path"})):
        section = n.said().strip()
    if not section and (m := re.match(r"(?i)https?://[^/?#]+([^?#]*)", url or "")):
        parts = [p for p in m[1].split("/") if p]
        section = re.sub("[-_]", " ", parts[-2]) if len(parts) >= 2 else ""
    section = section or "General"
    dashed = lambda t: re.sub("[^a-z0-9]+", "-", t.lower())
    words = re.split(r"[\s,–—\(\):;]+", title.lower())
    tags = [k.strip().lower() for k in meta.get("keywords", "").split(",") if k.strip()] + [dashed(b) for b in crumbs if 2 < len(b) < 30] + [dashed(section)] + [w for w in TAG_WORDS if w in words or w in description.lower()]
    site = meta.get("og:site_name") or meta.get("application-name") or ""
    dated = first(lambda n: n.tag == "time" and n.attrs.get("datetime"))
    modified = meta.get("last-modified") or meta.get("article:modified_time") or (dated.attrs["datetime"] if dated else as_of)
    content = None
    for kind, value in S.CONTAINERS:
        found = [n for n in elements if (n.tag == value if kind == "tag" else value in n.classes if kind == "class" else n.attrs.get(kind) == value)]
        if found and sum(len(n.said().strip()) for n in found) > 100:
            content = found[0]
            break
    content = content or first(lambda n: n.tag == "body") or root
    blocks, heads, stack = [], [], [content]
    k = 0
    while stack:
        n = stack.pop()
        if n is not content and n.tag and _clutter(n):
            continue
        if n.tag in ("pre", "code-snippet", "devsite-code"):
            k += 1
            code = n.said(_clutter).strip()
            css = n.attrs.get("class", "") + " " + " ".join(c.attrs.get("class", "") for c in n.children if c.tag == "code")
            if len(code) > 10:
                lang = M.language(code, css) or "text"
                blocks.append({"id": f"snippet-{k}", "language": lang, "code": code, "is_executable": lang in ("sql", "python", "bash", "sh")})
        if n.tag in ("h1", "h2", "h3", "h4") and (said := n.said(_clutter).strip()):
            heads.append({"level": int(n.tag[1]), "text": said})
        stack += reversed(n.children)
    return {
        "title": title, "description": description, "breadcrumbs": crumbs, "section": section, "tags": list(dict.fromkeys(tags)), "site": site, "author": meta.get("author") or meta.get("article:author") or site or "Documentation Team",
        "last_modified": modified.split("T")[0], "headings": heads, "code_blocks": blocks, "main_text": " ".join(content.said(_clutter).split()),
    }


def links(source: str | None, url: str | None) -> list[dict]:
    """Anchors of four passes, first pass first: article bodies (1), nav groups around the page or on set topics (2), other nav (5), sidebars (8).

    An href counts in the first pass that has it; hrefs are as the page has them.
    """
    root = tree(source)
    elements = [n for n in root.walk() if n.tag]
    path = re.sub(r"^(?i:https?)://[^/?#]+|[?#].*$", "", url or "") or "/"
    found: dict[str, dict] = {}

    def add(holder: Node, context: str, priority: int, section_of: Callable[[Node], str]) -> None:
        for a in holder.find(lambda n: n.tag == "a" and n.attrs.get("href")):
            found.setdefault(a.attrs["href"], {"href": a.attrs["href"], "text": " ".join(a.said().split()), "context": context, "section": section_of(a).strip(), "priority": priority})

    def heading_before(a: Node) -> str:
        mine = a.parent.children
        return next((n.said() for n in reversed(mine[: mine.index(a)]) if n.tag in ("h1", "h2", "h3", "h4")), "") or "Overview"

    def near(a: Node) -> str:
        holder = a.parent
        while holder is not None and holder.tag not in ("li", "div", "section"):
            holder = holder.parent
        inside = holder.find(lambda n: n.tag in ("span", "h2", "h3", "h4")) if holder else []
        return inside[0].said() if inside else ""

    def title_in(n: Node, test: Callable[[Node], bool]) -> str:
        inside = n.find(test)
        return inside[0].said() if inside else ""

    for n in elements:
        if n.tag in ("article", "main") or n.classes & set(S.BODY_CLASSES):
            add(n, "body", 1, heading_before)
    for n in (n for n in elements if n.classes & set(S.GROUP_CLASSES)):
        here = any(path in a.attrs.get("href", "") for a in n.find(lambda x: x.tag == "a"))
        if here or re.search("migrate|load|transform|export|api|quickstart", n.said(), re.I):
            title = title_in(n, lambda x: x.tag == "span" or bool(x.classes & {"devsite-nav-title", "menu__link--sublist"}))
            add(n, "active-section-nav", 2, lambda a, t=title: t)
    for n in (n for n in elements if n.classes & set(S.ITEM_CLASSES)):
        title = title_in(n, lambda x: "devsite-nav-title" in x.classes)
        add(n, "nav-item", 5, lambda a, t=title: t)
    for n in (n for n in elements if n.tag in ("nav", "aside") or n.classes & set(S.SIDE_CLASSES)):
        add(n, "sidebar", 8, near)
    return sorted(found.values(), key=lambda x: x["priority"])
