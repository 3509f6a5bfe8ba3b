"""Text functions over columns: slugs, stripped markup, first sentences, prose length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript and Java differ on it: spelled out.
_WS = r"[ \t\n\r\f\x0B ]"
#: Entities that page titles hold; decoded before a slug is made.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _s(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def decode_entities(c: Column | str) -> Column:
    """`c` with the usual entities decoded; the ampersand last."""
    c = _s(c)
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def slug(c: Column | str) -> Column:
    """Lower case, word characters and single dashes; 'item' where nothing is left or `c` is null."""
    c = F.regexp_replace(F.trim(F.lower(_s(c))), r"[^A-Za-z0-9_ \t\n\r\f\x0B-]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\n\r\f\x0B_-]+", "-"), r"^-+|-+$", "")
    return F.when(c == "", "item").otherwise(c)


def truncate_slug(c: Column | str, size: int = 60) -> Column:
    """A slug of at most `size` characters, cut at the last dash if that is past the middle."""
    c = _s(c)
    cut = F.substring(c, 1, size)
    dash = F.length(cut) - F.locate("-", F.reverse(cut))  # characters before the last dash
    dash = F.when(F.contains(cut, F.lit("-")), dash).otherwise(-1)
    short = F.when(dash > size / 2, F.left(cut, dash)).otherwise(cut)
    return F.when(F.length(c) <= size, c).otherwise(F.regexp_replace(short, "-+$", ""))


def path_slug(c: Column | str) -> Column:
    """The slug of an API path: braces are spaces, runs of / _ . are dashes."""
    return slug(F.regexp_replace(F.regexp_replace(_s(c), r"[{}]", " "), r"[/_.]+", "-"))


def strip_html(c: Column | str) -> Column:
    """Tags become spaces, white space is collapsed."""
    c = F.replace(F.regexp_replace(_s(c), "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(c, rf"{_WS}+", " "))


def strip_markdown(c: Column | str) -> Column:
    """Images and emptied links go, links keep their text, emphasis signs and tags go."""
    c = F.regexp_replace(_s(c), r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\[\s*\]\([^)]*\)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"[*_`~]", "")
    return strip_html(c)


def first_paragraph(c: Column | str) -> Column:
    """The first block, parted by blank lines, that is prose of over 20 characters; '' if none is."""
    blocks = F.transform(F.split(_s(c), r"\r?\n\s*\r?\n"), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    prose = F.filter(blocks, lambda b: (b != "") & ~b.rlike(r"^(#|>|[-*+]\s|[0-9]+\.\s|\||`{3,}|~{3,}|---|<)"))
    return F.coalesce(F.get(F.filter(F.transform(prose, strip_markdown), lambda b: F.length(b) > 20), F.lit(0)), F.lit(""))


def first_sentence(c: Column | str, size: int = 300) -> Column:
    """The first prose paragraph up to a full stop, question or exclamation mark before white space or the end."""
    whole = first_paragraph(c)
    found = F.regexp_extract(whole, r"^(.*?[.!?])(?=\s|$)", 1)
    sentence = F.trim(F.when(found != "", found).otherwise(whole))
    return F.when(F.length(sentence) > size, F.concat(F.rtrim(F.left(sentence, F.lit(size - 1))), F.lit("…"))).otherwise(sentence)


def capitalised(c: Column) -> Column:
    """Each word's first letter in upper case; other letters stay."""
    words = F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)))
    return F.array_join(words, " ")


def title_from_path(c: Column | str) -> Column:
    """A readable title from the last part of a URL's path or of a file path."""
    path = F.regexp_replace(F.regexp_replace(_s(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    stem = F.regexp_replace(F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit("")), r"(?i)\.(md|mdx|markdown|txt|docx|pdf)$", "")
    words = F.trim(capitalised(F.regexp_replace(stem, "[-_]+", " ")))
    return F.when(stem == "", "Untitled Document").when(F.lower(stem) == "readme", "Overview").otherwise(words)


def folder_title(c: Column | str) -> Column:
    """A folder's dash-parted words, capitalised."""
    return capitalised(F.replace(_s(c), F.lit("-"), F.lit(" ")))


def prose_length(c: Column | str) -> Column:
    """Characters of prose: without fences, images, link targets, tags, URLs, heading marks, signs and runs of white space."""
    c = F.regexp_replace(_s(c), r"(?m)^ {0,3}(`{3,}|~{3,})[\s\S]*?^ {0,3}\1[^\n]*$", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"https?://\S+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^ {0,3}#{1,6}\s+", ""), r"[*_`~>|-]", " ")
    return F.length(F.trim(F.regexp_replace(c, rf"{_WS}+", " ")))


def sanitize_filename(c: Column | str) -> Column:
    """A name for an archive: other than word characters and dashes become single dashes, a .zip ending goes."""
    c = F.regexp_replace(F.regexp_replace(_s(c), r"(?i)\.zip$", ""), r"[^A-Za-z0-9_-]", "-")
    return F.regexp_replace(c, "-+", "-")


def string_agg(column: str, separator: str, order: str) -> Column:
    """The strings of a group's column in the order of another, joined; null if there is none."""
    sep = separator.replace("\n", "\\n")
    return F.expr(f"listagg({column}, '{sep}') WITHIN GROUP (ORDER BY {order})")
