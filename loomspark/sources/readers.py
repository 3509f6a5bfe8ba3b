"""Sources as rows of one document shape, and the bundle's sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import classify, text, url
from loomspark.operators import graph, openapi

#: The document shape that every source is brought into.
DOCUMENT = "source_id string, source_type string, url string, section string, is_root boolean, html string, markdown string, title string, author string, last_modified string, slug_hint string, description string, type string, tags array<string>, splittable boolean, absolute_links boolean, link_root string, site string"
UPLOADS = ("md", "mdx", "markdown", "txt", "docx", "pdf")
MAX_UPLOAD = 25 * 1024 * 1024
LABELS = {"webpage": "Web page", "openapi": "API specification", "git": "Git repository", "markdown": "Markdown", "upload": "Uploaded document"}


def split_list(inputs: DataFrame) -> DataFrame:
    """(src_ord, value): inputs (ord, value) split at line feeds and commas, trimmed, without empty ones; a comma in a query string splits too."""
    each = inputs.select("ord", F.posexplode(F.split(F.coalesce("value", F.lit("")), r"[\n,]+")).alias("k", "value"))
    each = each.select("ord", "k", F.trim("value").alias("value")).where("value != ''")
    return each.select(F.row_number().over(Window.orderBy("ord", "k")).alias("src_ord"), "value")  # what a user typed


def resolve_inputs(values: list[str]) -> tuple[list[str], list[str]]:
    """(sources, files) of what a user typed: addresses and texts, and names of existing local files, which are uploads."""
    from pathlib import Path

    def is_file(value: str) -> bool:
        try:
            return not re.match(r"(?i)[a-z][a-z0-9+.-]*://|git@", value) and "\n" not in value and Path(value).is_file()
        except (OSError, ValueError):  # a text is no name of a file
            return False

    kept = [v.strip() for v in values if v and v.strip()]
    return [v for v in kept if not is_file(v)], [v for v in kept if is_file(v)]


def local_kind(value: str) -> str | None:
    """What a path is read as: a table of pages, a checked-out repository, a specification or an upload; none for addresses and texts."""
    from pathlib import Path

    if re.match(r"(?i)(?!file:)[a-z][a-z0-9+.-]*://|git@", value) and not value.rstrip("/").endswith(".parquet") or "\n" in value:
        return None
    if value.rstrip("/").endswith(".parquet"):
        return "webpage"
    try:
        at = Path(value.removeprefix("file://"))
        known = at.is_dir() or at.is_file() or value.startswith(("file:", "/", "./", "../"))
        return None if not known else "git" if at.is_dir() else "openapi" if value.lower().endswith((".json", ".yaml", ".yml")) else "upload"
    except (OSError, ValueError):  # a text is no name of a file
        return None


def local(spark: SparkSession, value: str, kind: str, max_files: int) -> tuple[DataFrame, DataFrame]:
    """(documents, errors (source, error)) of a path of a kind."""
    none = spark.createDataFrame([], "source string, error string")
    if kind == "upload":
        return uploads(spark, value)
    return (pages(spark.read.parquet(value)) if kind == "webpage" else repository(spark, value, max_files) if kind == "git" else specifications(spark, value)), none


def describe(inputs: DataFrame) -> DataFrame:
    """(src_ord, value, type, label): what each source would be read as."""
    kinds = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return split_list(inputs).withColumn("type", classify.source_type(F.col("value"))).withColumn("label", kinds[F.col("type")])


def unique_ids(docs: DataFrame, key: str) -> DataFrame:
    """source_id made unique with -2, -3, ... in the order of `key`."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(key))
    return docs.withColumn("n", n).withColumn("source_id", F.when(F.col("n") == 1, F.col("source_id")).otherwise(F.concat_ws("-", "source_id", F.col("n").cast("string")))).drop("n")


def pages(table: DataFrame, key: str | None = None) -> DataFrame:
    """A table of page_id, url, html as documents; the first page is the root. With `key`, page_id stays as a column of that name."""
    first = table.agg(F.min("page_id").alias("first"))
    df = table.join(F.broadcast(first))  # one row
    return _shaped(df.select(url.source_id(F.col("url")).alias("source_id"), F.lit("webpage").alias("source_type"), "url", url.url_section(F.col("url")).alias("section"), (F.col("page_id") == F.col("first")).alias("is_root"), "html", *([F.col("page_id").alias(key)] if key else [])))


def crawled(results: DataFrame) -> DataFrame:
    """Documents of crawl results (start_url, pages of url, html, section), the shape that older bundles were made of.

    The root is the page of the start address, else the first one; a page's section counts if it has one.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/$", "")
    at = F.coalesce(F.nullif(F.array_position(F.transform("pages", lambda p: plain(p["url"])), plain(F.col("start_url"))), F.lit(0)), F.lit(1))
    each = results.select((at - 1).alias("root"), F.posexplode("pages").alias("pos", "p"))
    return _shaped(each.select(url.source_id(F.col("p.url")).alias("source_id"), F.lit("webpage").alias("source_type"), "p.url", F.coalesce(F.nullif("p.section", F.lit("")), url.url_section(F.col("p.url"))).alias("section"), (F.col("pos") == F.col("root")).alias("is_root"), "p.html"))


def seeds(inputs: DataFrame) -> DataFrame:
    """(url, ord): the valid addresses of inputs (ord, value), normalised, in order, each once. Raises ValueError if there is none."""
    each = split_list(inputs).select(url.normalize_url(F.col("value")).alias("url"), "src_ord").where("url is not null")
    found = each.groupBy("url").agg(F.min("src_ord").alias("ord"))
    if found.isEmpty():
        raise ValueError("no valid address to start from")
    return found


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder, a document each."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("url"))
    files = files.where(F.col("url").rlike(r"(?i)\.(md|mdx|markdown)$"))
    return _shaped(files.select(text.slug(text.title_from_path("url")).alias("source_id"), F.lit("markdown").alias("source_type"), "url", url.markdown_section(F.regexp_replace("url", "^file:/+", "https://local/")).alias("section"), F.col("url").rlike(r"(?i)readme\.md$").alias("is_root"), F.col("value").alias("markdown"), text.title_from_path("url").alias("title")))


def repository(spark: SparkSession, path: str, max_files: int = 100, sub_path: str = "") -> DataFrame:
    """Documents of a checked-out repository: the first `max_files` ingestible files by rank; file names are ranked before any content is read.

    Files outside `sub_path` are left out, unless nothing is inside. Specifications become a document per endpoint and model.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    names = listing.withColumn("name", F.regexp_replace("path", "^.*?" + re.escape(path.removeprefix("file://").strip("/")) + "/", "")).where(classify.is_ingestible(F.col("name")))
    inside = names.where(F.startswith("name", F.lit(sub_path.strip("/") + "/"))) if sub_path else names
    if sub_path and inside.isEmpty():
        inside = names
    chosen = inside.orderBy(classify.repo_rank(F.col("name")), "name").limit(max_files)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    df = graph.cut_lineage(content.join(F.broadcast(chosen), "path"))  # at most max_files names
    return repository_documents(df, text_slug(path))


def repository_documents(files: DataFrame, source_id: str) -> DataFrame:
    """Documents of a repository's files (path, name, content): markdown as it is, specifications by endpoint and model."""
    name = F.col("name")
    spec = name.rlike(classify.SPEC_PATH)
    apis = _api_documents(files.where(spec).select(F.col("path").alias("spec_id"), F.decode("content", "UTF-8").alias("text"))).withColumn("source_id", F.lit(source_id)).withColumn("source_type", F.lit("git"))
    own = files.where(~spec).select(
        F.lit(source_id).alias("source_id"), F.lit("git").alias("source_type"), F.col("path").alias("url"), classify.repo_section(name).alias("section"), name.rlike(r"(?i)^readme\.mdx?$").alias("is_root"), F.decode("content", "UTF-8").alias("markdown"),
    )
    return apis.unionByName(_shaped(own))


def specifications(spark: SparkSession, path: str) -> DataFrame:
    """API specifications, JSON or YAML, as documents: one per endpoint and tag, then one per model. Files that are none give no row."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("spec_id"), F.col("value").alias("text"))
    return _api_documents(files.where(F.col("spec_id").rlike(r"(?i)\.(json|ya?ml)$")))


def _api_documents(files: DataFrame, keep: bool = False) -> DataFrame:
    """Documents of specifications (spec_id, text); with `keep`, spec_id stays as a column."""
    specs = graph.cut_lineage(openapi.of_text(files))
    head = openapi.heads(specs).select("spec_id", "api", "contact")
    df = openapi.documents(specs).join(head, "spec_id")
    author = F.coalesce(F.col("contact")["name"], F.lit("API Provider"))
    return _shaped(df.select(text.slug("api").alias("source_id"), F.lit("openapi").alias("source_type"), F.coalesce("url", "spec_id").alias("url"), "section", F.lit(False).alias("is_root"), "markdown", "title", author.alias("author"), F.col("slug").alias("slug_hint"), "description", "type", "tags", F.lit(False).alias("splittable"), F.lit(False).alias("absolute_links"), F.col("api").alias("site"), *(["spec_id"] if keep else [])))


def text_slug(path: str) -> str:
    """The slug of a folder's name, as source id."""
    return re.sub(r"[^a-z0-9]+", "-", path.rstrip("/").rsplit("/", 1)[-1].lower()).strip("-") or "source"


def converted(ext: Column, content: Column) -> Column:
    """struct<markdown, error> of files' bytes by their endings; null bytes are an error."""

    @F.pandas_udf("markdown string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for exts, data in batches:
            yield pd.DataFrame([_convert(e, d) for e, d in zip(exts, data)], columns=["markdown", "error"])

    return run(ext, content)


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of uploaded files: markdown and text as they are, docx and pdf converted; others, large and empty ones are errors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))

    fits = (F.col("length") <= MAX_UPLOAD) & ext.isin(*UPLOADS)
    df = files.where(fits).select("path", converted(ext, F.col("content")).alias("c"))
    refused = files.where(~fits).select(F.col("path").alias("source"), F.when(F.col("length") > MAX_UPLOAD, "file is too large").otherwise("file type is not supported").alias("error"))
    good = df.where("c.error is null").select(text.slug(text.title_from_path("path")).alias("source_id"), F.lit("upload").alias("source_type"), F.concat(F.lit("upload://"), F.element_at(F.split("path", "/"), -1)).alias("url"), F.lit("Guides").alias("section"), F.lit(None).cast("boolean").alias("is_root"), F.col("c.markdown").alias("markdown"), text.title_from_path("path").alias("title"))
    return _shaped(good), refused.unionByName(df.where("c.error is not null").select(F.col("path").alias("source"), F.col("c.error").alias("error")))


def _shaped(df: DataFrame) -> DataFrame:
    empty = df.sparkSession.createDataFrame([], DOCUMENT)
    return empty.unionByName(df, allowMissingColumns=True)


def _convert(ext: str, data: bytes) -> tuple[str | None, str | None]:
    try:
        out = docx_to_markdown(data) if ext == "docx" else pdf_to_markdown(data) if ext == "pdf" else bytes(data).decode("utf-8", "replace")
    except Exception as e:  # one unreadable file is a row of errors
        return None, str(e) or type(e).__name__
    return (out, None) if out.strip() else (None, "no text found")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_to_markdown(data: bytes) -> str:
    """Headings, paragraphs with bold and italic runs, lists and tables of a word-processor file."""
    if not bytes(data[:2]) == b"PK":
        raise ValueError("not a docx file")
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def paragraph(p) -> str:
        parts = []
        for run in p.iter(f"{_W}r"):
            said = "".join((t.text or "") if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else "" for t in run)
            style = run.find(f"{_W}rPr")
            if said.strip() and style is not None:
                said = f"**{said}**" if style.find(f"{_W}b") is not None else said
                said = f"_{said}_" if style.find(f"{_W}i") is not None else said
            parts.append(said)
        said, props = "".join(parts).strip(), p.find(f"{_W}pPr")
        style = props.find(f"{_W}pStyle") if props is not None else None
        name = style.get(f"{_W}val", "") if style is not None else ""
        if said and (m := re.fullmatch(r"(?i)heading ?([1-6])|(title)", name)):
            return "#" * int(m[1] or 1) + " " + said.replace("**", "")
        return "* " + said if said and props is not None and props.find(f"{_W}numPr") is not None else said

    out = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            out.append(paragraph(block))
        elif block.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(paragraph, cell.iter(f"{_W}p")))) for cell in row.iter(f"{_W}tc")] for row in block.iter(f"{_W}tr")]
            if rows:
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(filter(None, out))


def pdf_to_markdown(data: bytes) -> str:
    """Lines of a PDF's text operators; text much larger than the median becomes headings. Simple encodings only."""
    import zlib

    data, runs = bytes(data), []
    if not data.startswith(b"%PDF"):
        raise ValueError("not a pdf file")
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m[1]
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        size, x, y = 12.0, 0.0, 0.0
        for op in re.finditer(rb"/\S+\s+([\d.]+)\s+Tf|([-\d.]+)\s+([-\d.]+)\s+T[dD]|(?:[-\d.]+\s+){4}([-\d.]+)\s+([-\d.]+)\s+Tm|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')|\[(.*?)\]\s*TJ", raw, re.S):
            if op[1]:
                size = float(op[1])
            elif op[2]:
                x, y = x + float(op[2]), y + float(op[3])
            elif op[4]:
                x, y = float(op[4]), float(op[5])
            else:
                said = op[6] if op[6] is not None else b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", op[7] or b""))
                runs.append((y, size, re.sub(rb"\\(.)", rb"\1", said).decode("latin-1")))
    lines: list[tuple[float, float, str]] = []
    for y, size, said in runs:
        if lines and abs(lines[-1][0] - y) <= 2:
            lines[-1] = (y, max(size, lines[-1][1]), lines[-1][2] + said)
        else:
            lines.append((y, size, said))
    heights = sorted(s for _, s, t in lines if t.strip())
    median = heights[len(heights) // 2] if heights else 0
    mark = lambda s: "# " if s > 1.45 * median else "## " if s > 1.18 * median else ""
    return "\n\n".join(mark(s) + " ".join(t.split()) for _, s, t in lines if t.strip())
