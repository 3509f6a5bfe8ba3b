"""Ordered rules over columns: source types, code languages, concept types, folders, file roles, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import url as U
from loomspark.functions.text import _s, slug

#: Words that become tags where a title has them as a word or a description anywhere.
TAG_WORDS = ("bigquery", "dataform", "sql", "migration", "export", "load", "transform", "elt", "etl", "pipeline", "storage", "dataset", "table")
EXECUTABLE = ("sql", "python", "bash", "sh")
SPEC_PATH = r"(?i)(^|/)(openapi|swagger)[^/]*\.(json|ya?ml)$"


def source_type(c: Column) -> Column:
    """webpage, upload, git, markdown or openapi of a source given as text."""
    v = F.trim(_s(c))
    rest = F.regexp_extract(v, r"(?i)^https?://(?:www\.)?(?:github\.com|[^/]*gitlab[^/]*)/[^/]+/[^/]+(/.*)?$", 1)
    repo = v.rlike(r"(?i)^https?://(?:www\.)?(?:github\.com|[^/]*gitlab[^/]*)/[^/]+/[^/]+(/.*)?$") & ~rest.rlike("(?i)^/(blob|raw)/")
    where = F.coalesce(U.path(v), v)
    kind = F.when(v == "", "webpage").when(U.is_google_doc(v), "upload").when(v.rlike(r"^(?:git\+|ssh://)?git@[^:/]+[:/]") | v.rlike(r"(?i)\.git$"), "git").when(repo, "git")
    web = F.when(where.rlike(r"(?i)\.(md|mdx|markdown)$"), "markdown").when(where.rlike(r"(?i)\.(json|ya?ml)$") | where.rlike("(?i)(openapi|swagger|api-docs)"), "openapi").otherwise("webpage")
    text = F.when(v.rlike(r"^\s*\{") | v.rlike(r"(?m)^\s*(openapi|swagger)\s*:"), "openapi").otherwise("markdown")
    return kind.when(v.rlike("(?i)^https?://"), web).otherwise(text)


def code_language(code: Column, css: Column | None = None) -> Column:
    """The language of a code block: a class token, else the first rule that its text meets."""
    code = _s(code)
    told = F.lower(F.regexp_extract(_s(css), "(?:lang|language)-([a-zA-Z0-9_-]+)", 1)) if css is not None else F.lit("")
    rules = (("sql", "(?i)SELECT|FROM|WHERE|JOIN|GROUP BY|INSERT|UPDATE|CREATE TABLE"), ("python", r"(?i)def |import |print\(|class "), ("bash", "(?i)bq |gcloud |curl |npm |git "))
    out = F.when(told != "", told)
    for name, rule in rules:
        out = out.when(code.rlike(rule), name)
    return out.when(code.startswith("{") & code.rlike(r"\{[\s\S]*\}|\[[\s\S]*\]"), "json").when(code.rlike(r"(?m)^[a-zA-Z0-9_-]+:\s+"), "yaml").otherwise("text")


def is_executable(language: Column) -> Column:
    """Whether blocks of a language can be run."""
    return language.isin(*EXECUTABLE)


def concept_type(title: Column) -> Column:
    """Overview, Reference, Playbook, BigQuery Table or Guide by what a title holds."""
    t = F.lower(_s(title))
    has = lambda *words: F.greatest(*(t.contains(w) for w in words))
    out = F.when(has("introduction", "overview", "concept"), "Overview").when(has("reference", "syntax", "schema", "api"), "Reference")
    return out.when(has("how to", "step", "playbook", "triage", "incident"), "Playbook").when(has("table", "dataset"), "BigQuery Table").otherwise("Guide")


def folder(section: Column, name: Column, root: Column | None = None) -> Column:
    """The folder of a concept: none for the root, its section, else by words in its slug."""
    s, n = F.lower(_s(section)), F.lower(_s(name))
    has = lambda *words: F.greatest(*(n.contains(w) for w in words), F.lit(False))
    out = F.when(~s.isin("", "general", "overview"), slug(s)).when(has("migrat"), "migrate-data").when(has("load", "transfer", "storage"), "load-data")
    out = out.when(has("dataform", "pipeline", "prep"), "transform-data").when(has("reverse-etl", "extract"), "export-data").otherwise("guides")
    return out if root is None else F.when(root, "").otherwise(out)


def file_role(path: Column) -> Column:
    """root_index, index, log or concept."""
    return F.when(path == "index.md", "root_index").when(path.endswith("/index.md"), "index").when((path == "log.md") | path.endswith("/log.md"), "log").otherwise("concept")


def actor_kind(actor: Column) -> Column:
    """human, process or producer of an actor's name; unknown for none."""
    a = _s(actor)
    return F.when(a.startswith("human:"), "human").when(a.startswith("process:"), "process").when(a.rlike("^[^/ ]+/[^/ ]+$"), "producer").otherwise("unknown")


def trust_tier(actors: Column) -> Column:
    """unverified without verification, humanReviewed with a human one, else machineConfirmed."""
    some = F.size(F.coalesce(actors, F.array().cast("array<string>"))) > 0
    return F.when(~some, "unverified").when(F.exists(actors, lambda a: F.coalesce(a.startswith("human:"), F.lit(False))), "humanReviewed").otherwise("machineConfirmed")


def resource_kind(value: Column) -> Column:
    """url, bundle, relative or scope: what a path-valued field holds."""
    v = _s(value)
    return F.when(v.rlike("(?i)^[a-z][a-z0-9+.-]*://"), "url").when(v.startswith("/"), "bundle").when(v.rlike(r"^\.{0,2}/|\.md$|/"), "relative").otherwise("scope")


def repo_rank(path: Column) -> Column:
    """0 for the root readme, 1 for docs, 2 for specifications, 3 for other readmes, 4 for the rest."""
    p = _s(path)
    return F.when(p.rlike(r"(?i)^readme\.mdx?$"), 0).when(p.rlike("(?i)^docs?/"), 1).when(p.rlike(SPEC_PATH), 2).when(p.rlike(r"(?i)readme\.mdx?$"), 3).otherwise(4)


def is_ingestible(path: Column) -> Column:
    """Whether a repository's file becomes a concept."""
    p = _s(path)
    return ~p.rlike(r"(?i)(^|/)(node_modules|vendor|\.git|dist|build|\.github/ISSUE_TEMPLATE)/") & (p.rlike(r"(?i)\.mdx?$") | p.rlike(SPEC_PATH))


def repo_section(path: Column) -> Column:
    """The section of a repository's file."""
    parts = F.split(_s(path), "/")
    n = F.size(parts)
    spaced = lambda c: F.regexp_replace(c, "[-_]+", " ")
    docs = F.when(n > 2, spaced(F.get(parts, F.lit(1)))).otherwise("Documentation")
    return F.when(_s(path).rlike(r"(?i)^readme\.mdx?$"), "Overview").when(F.get(parts, F.lit(0)).rlike("(?i)^docs?$"), docs).when(n > 1, spaced(F.get(parts, n - 2))).otherwise("Repository")
