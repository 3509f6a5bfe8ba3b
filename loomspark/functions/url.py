"""URL functions over columns. Anything that is no absolute http(s) URL gives null or the documented default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import _s, slug

_URL = r"^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"
#: Path parts that say nothing about a bundle, and endings of hosts.
BUNDLE_STOP_WORDS = ("docs", "doc", "en", "v1", "v2", "latest", "index", "html")
SECTION_STOP_WORDS = ("docs", "doc", "main", "master", "blob", "raw")
ASSET_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".pdf", ".zip", ".tar", ".gz", ".mp4", ".xml", ".json", ".ico")


def origin(c: Column) -> Column:
    """Scheme and host, lower-cased; null for no http(s) URL."""
    found = F.lower(F.regexp_extract(_s(c), r"(?i)^(https?://[^/?#]+)", 1))
    return F.when(found != "", found)


def host(c: Column) -> Column:
    """The host without a port."""
    return F.regexp_replace(F.regexp_replace(origin(c), "^https?://", ""), ":[0-9]+$", "")


def path(c: Column) -> Column:
    """The path, '/' if empty."""
    found = F.regexp_extract(_s(c), "(?i)" + _URL, 3)
    return F.when(origin(c).isNotNull(), F.when(found == "", "/").otherwise(found))


def path_parts(c: Column) -> Column:
    """The parts of the path that are not empty."""
    return F.filter(F.split(F.coalesce(path(c), F.lit("")), "/"), lambda p: p != "")


def normalize_url(c: Column) -> Column:
    """Without fragment, `hl` parameter and trailing slash (but for the root); null for no http(s) URL."""
    query = F.regexp_extract(_s(c), "(?i)" + _URL, 4)
    kept = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike("^hl(=|$)"))
    query = F.when(query.rlike(r"[?&]hl(=|&|$)"), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")).otherwise(F.when(query == "?", "").otherwise(query))
    where = F.when(path(c) == "/", path(c)).otherwise(F.regexp_replace(path(c), "/$", ""))
    return F.concat(origin(c), where, query)


def resolve_url(href: Column, base: Column) -> Column:
    """An href of a page at `base`: absolute, host-relative, or relative to the page's folder; null for other schemes and bare fragments."""
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    h = F.trim(_s(href))
    joined = F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(origin(base), "^(https?:)", 1), h)).when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
    return joined.when(h.startswith("#") | (h == ""), None).when(h.startswith("/"), F.concat(origin(base), h)).otherwise(F.concat(origin(base), folder, F.regexp_replace(h, r"^(\./)+", "")))


def source_id(c: Column) -> Column:
    """The slug of the host, without www, and the path's first part; of anything else the slug of the text."""
    name = F.regexp_replace(host(c), r"^www\.", "")
    first = F.get(path_parts(c), F.lit(0))
    return F.when(name.isNull(), slug(c)).otherwise(slug(F.when(first.isNull(), name).otherwise(F.concat(name, F.lit("-"), first))))


def url_section(c: Column) -> Column:
    """The last part but one of the path, dashes and underscores as spaces; null if there are fewer parts."""
    parts = path_parts(c)
    return F.regexp_replace(F.get(parts, F.size(parts) - 2), "[-_]", " ")


def markdown_section(c: Column) -> Column:
    """The section of a markdown file: its folder unless that is generic, else Guides."""
    parts = path_parts(c)
    parent = F.get(parts, F.size(parts) - 2)
    return F.coalesce(F.when(~F.lower(parent).isin(*SECTION_STOP_WORDS), F.regexp_replace(parent, "[-_]+", " ")), F.lit("Guides"))


def to_raw_url(c: Column) -> Column:
    """The raw form of a repository's page of a file."""
    c = _s(c)
    hub = F.regexp_replace(c, r"(?i)^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")
    return F.when(hub != c, hub).otherwise(F.regexp_replace(c, r"(?i)^(https?://[^/]*gitlab[^/]*/.+?)/-/blob/(.+)$", "$1/-/raw/$2"))


def link_root(c: Column) -> Column:
    """What links from the root mean in a repository's file; '' elsewhere."""
    rules = (r"(?i)^(https?://raw\.githubusercontent\.com/[^/]+/[^/]+/[^/]+/)", r"(?i)^(https?://github\.com/[^/]+/[^/]+/(?:blob|raw)/[^/]+/)", r"(?i)^(https?://[^/]*gitlab[^/]*/.+?/-/(?:blob|raw)/[^/]+/)")
    return F.coalesce(*(F.nullif(F.regexp_extract(_s(c), r, 1), F.lit("")) for r in rules), F.lit(""))


def is_google_doc(c: Column) -> Column:
    """Whether it is a document of the online editor."""
    return _s(c).rlike(r"(?i)^https?://docs\.google\.com/document/d/")


def google_doc_export(c: Column) -> Column:
    """The address of such a document as text; null for others."""
    found = F.regexp_extract(_s(c), r"/document/d/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", F.concat(F.lit("https://docs.google.com/document/d/"), found, F.lit("/export?format=docx")))


def parse_repo(c: Column) -> Column:
    """struct<host, hostname, owner, repo, ref, sub_path, web_url, full_name> of a repository reference; null if it is none."""
    raw = F.regexp_replace(F.trim(_s(c)), r"(?i)\.git$", "")
    scp = r"(?i)^(?:git\+)?(?:ssh://)?git@([^:/]+)[:/](.+)$"
    is_scp = raw.rlike(scp)
    web = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    name = F.when(is_scp, F.regexp_extract(raw, scp, 1)).otherwise(host(web))
    parts = F.when(is_scp, F.filter(F.split(F.regexp_extract(raw, scp, 2), "/"), lambda p: p != "")).otherwise(path_parts(web))
    tree = F.when(is_scp, F.lit(0)).otherwise(F.coalesce(F.get(F.filter(F.transform(parts, lambda p, i: F.when((p == "tree") & (i >= 2), i + 1).otherwise(0)), lambda i: i > 0), F.lit(0)), F.lit(0)))
    mine = F.when(tree > 0, F.filter(F.slice(parts, 1, F.greatest(tree - 1, F.lit(0))), lambda p: p != "-")).otherwise(parts)
    owner, repo = F.get(mine, F.lit(0)), F.array_join(F.slice(mine, 2, 1 << 20), "/")
    ref = F.when(tree > 0, F.coalesce(F.get(parts, tree), F.lit(""))).otherwise("")
    sub = F.when(tree > 0, F.array_join(F.slice(parts, tree + 2, 1 << 20), "/")).otherwise("")
    kind = F.when(name.rlike(r"(?i)(^|\.)github\.com$"), "github").when(name.rlike("(?i)gitlab"), "gitlab").otherwise("other")
    out = F.struct(kind.alias("host"), name.alias("hostname"), owner.alias("owner"), repo.alias("repo"), ref.alias("ref"), sub.alias("sub_path"), F.concat(F.lit("https://"), name, F.lit("/"), owner, F.lit("/"), repo).alias("web_url"), F.concat(owner, F.lit("/"), repo).alias("full_name"))
    return F.when(F.size(parts) >= 2, out)


def bundle_name(url: Column, title: Column, site: Column) -> Column:
    """A bundle's name from its start URL, root title and site."""
    base = F.when((_s(site) != "") & (F.lower(_s(site)) != "documentation team"), slug(site))
    parts = F.filter(path_parts(url), lambda p: ~F.lower(p).isin(*BUNDLE_STOP_WORDS))
    of_path = F.when(F.size(parts) > 0, slug(F.array_join(parts, "-")))
    short = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"\.(com|org|io|net|dev|app|ai)$", "")
    both = F.when(base.isNotNull() & ~of_path.contains(F.coalesce(base, F.lit(""))) & (F.length(base) < 25), F.concat(base, F.lit("-"), of_path)).otherwise(of_path)
    of_title = F.when(_s(title) != "", slug(title))
    return F.when(host(url).isNull(), F.coalesce(of_title, F.lit("bundle"))).otherwise(F.coalesce(both, base, of_title, slug(short)))


def in_scope(candidate: Column, seed: Column, scope: str = "subtree") -> Column:
    """Whether a link is no asset, of the seed's origin and, but for the scope `domain`, under its first path part or path."""
    asset = F.lower(path(candidate)).rlike("(" + "|".join(e.replace(".", r"\.") for e in ASSET_ENDINGS) + ")$")
    same = origin(candidate) == origin(seed)
    if scope != "domain":
        one, other = F.get(path_parts(seed), F.lit(0)), F.get(path_parts(candidate), F.lit(0))
        same = same & ((one == other) | path(candidate).startswith(path(seed)))
    return F.coalesce(~asset & same, F.lit(False))
