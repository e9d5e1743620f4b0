"""Files to titled, located sections.

``parse`` takes rows of ``source_uri`` and ``content`` (binary) and gives ``source_uri``, ``title``, ``sections`` (array of loc, text, metadata) and
``metadata``. Formats are told by suffix: Markdown and plain text, CSV and TSV, PDF, images, code; other files are one section
of text. Only YAML, PDF and quoted CSV need Python, in Arrow batches; all else is expressions.
"""

from __future__ import annotations

import csv
import io
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.text import file_name, stem, strip, suffix, title_case

# Type objects, since type strings need a session when this module is imported.
FIELDS = T.MapType(T.StringType(), T.StringType())
SECTIONS = T.ArrayType(T.StructType([T.StructField("loc", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", FIELDS)]))
# Suffixes by format, and those that a directory scan takes.
MARKDOWN = (".md", ".txt", ".markdown")
TABULAR = (".csv", ".tsv")
CODE = (".py", ".sh", ".json", ".yaml", ".yml", ".sql", ".js", ".ts")
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".svg", ".gif")
LISTED = (".md", ".txt", ".markdown", ".pdf", ".csv", ".tsv", ".py", ".sh", ".json", ".yaml", ".yml", ".sql", ".png", ".jpg", ".jpeg", ".webp", ".svg")
ROWS_PER_SECTION = 20


def _root(path: str) -> str:
    """How the paths of files below a folder begin, but for their scheme."""
    local = f"/{path.removeprefix('file:').lstrip('/')}" if path.startswith("file:") else path
    return local.rstrip("/") + "/"


def scan_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = LISTED) -> DataFrame:
    """``path``, ``source_uri`` (relative), ``content`` and ``size`` of the files below ``path`` with a listed suffix, whatever its case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = _root(path)
    return files.where(suffix("path").isin(*suffixes)).select("path", F.regexp_replace("path", f"^.*?\\Q{root}\\E", "").alias("source_uri"), "content", F.col("length").alias("size"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """``rel``, ``slug`` and ``text`` of the Markdown pages below ``path`` but for ``index.md``."""
    root = _root(path)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), f"^.*?\\Q{root}\\E", "").alias("rel"), F.col("value").alias("text"))
    return files.where(file_name("rel") != "index.md").select("rel", stem("rel").alias("slug"), "text")


def split_frontmatter(text: Column | str) -> tuple[Column, Column]:
    """YAML block and body of a page; null without a block."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = text.rlike(pattern)
    return F.when(has, F.regexp_extract(text, pattern, 1)), F.when(has, F.regexp_extract(text, pattern, 2))


@F.pandas_udf(FIELDS)
def yaml_fields(blocks: pd.Series) -> pd.Series:
    """Fields of YAML mappings as text, lists as JSON; null for anything else."""
    import json

    import yaml

    def one(block: str | None) -> dict | None:
        try:
            found = yaml.safe_load(block) if block else None
        except yaml.YAMLError:
            return None
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for k, v in found.items()} if isinstance(found, dict) else None

    return blocks.map(one)


def load_pages(df: DataFrame) -> DataFrame:
    """``rel``, ``slug``, ``present`` (field names), ``source_keys`` (those of each source), the fields, ``sources`` and ``body`` of scanned pages; pages without frontmatter are left out."""
    block, body = split_frontmatter("text")
    rows = df.select("rel", "slug", body.alias("body"), yaml_fields(block).alias("f")).where("f is not null")
    get = lambda name: F.col("f")[name]
    entities = F.coalesce(F.from_json(get("entities"), "array<string>"), F.array().cast("array<string>"))
    sources = F.coalesce(F.from_json(get("sources"), "array<struct<path: string, loc: string, hint: string>>"), F.array().cast("array<struct<path: string, loc: string, hint: string>>"))
    keys = F.transform(F.coalesce(F.from_json(get("sources"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")), F.map_keys)
    return rows.select("rel", "slug", F.map_keys("f").alias("present"), keys.alias("source_keys"), *(get(n).alias(n) for n in ("type", "title", "summary", "department", "last_compiled")), entities.alias("entities"), sources.alias("sources"), "body")


def markdown_sections(body: Column, respect_fences: bool = False) -> Column:
    """Sections begin at lines that start with ``#``, also within code fences unless these are respected; text before is ``Intro``.

    One regular expression cuts the body before every heading, so time is linear in lines and sections.
    """
    text = F.regexp_replace(body, r"\r\n?", "\n")
    if respect_fences:  # a heading is no cut while an odd number of fences stands before it: fenced blocks are taken whole
        piece = r"(?s)(?:\A|(?<=\n)(?=#))(?:```[^\n]*(?:\n(?!```)[^\n]*)*+(?:\n```[^\n]*)?+|[^\n]*)(?:\n(?:```[^\n]*(?:\n(?!```)[^\n]*)*+(?:\n```[^\n]*)?+|(?!#)[^\n]*))*+\n?"
    else:
        piece = r"[^\n]*(?:\n(?!#)[^\n]*)*+(?:\n|\z)"
    pieces = F.filter(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), lambda t: strip(t) != "")

    def section(t: Column) -> Column:
        head = F.regexp_extract(t, r"\A#+([^\n]*)", 1)
        name = F.when(~t.startswith("#"), "Intro").when(strip(head) == "", "Section").otherwise(strip(head))
        return _section(name, t)

    found = F.transform(pieces, section)
    return F.when(F.size(found) > 0, found).otherwise(F.array(_plain(F.lit("Full Document"), strip(body))))


def _section(heading: Column, text: Column) -> Column:
    return F.struct(F.concat(F.lit("Section "), heading).alias("loc"), strip(text).alias("text"), F.create_map(F.lit("heading"), heading).alias("metadata"))


def _plain(loc: Column, text: Column) -> Column:
    return F.struct(loc.alias("loc"), text.alias("text"), F.create_map().cast("map<string,string>").alias("metadata"))


@F.pandas_udf(SECTIONS)
def table_sections(texts: pd.Series, delimiters: pd.Series) -> pd.Series:
    """Rows as ``Row n: column: value | ...`` in blocks of 20 under a line with the columns; no rows give the text itself."""

    def one(text: str, delimiter: str) -> list[dict]:
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter)]
        head = rows[0] if rows else []
        lines = [f"Row {n}: " + " | ".join(f"{c}: {v}" for c, v in zip(head, row, strict=False)) for n, row in enumerate(rows[1:], 1)]
        out = []
        for at in range(0, len(lines), ROWS_PER_SECTION):
            part = lines[at : at + ROWS_PER_SECTION]
            out.append({"loc": f"Rows {at + 1}-{at + len(part)}", "text": "\n".join([f"Columns: {', '.join(head)}", *part]), "metadata": {}})
        return out or [{"loc": "All Rows", "text": text.strip(), "metadata": {}}]

    return pd.Series([one(t, d) for t, d in zip(texts, delimiters, strict=True)])


@F.pandas_udf(SECTIONS)
def pdf_sections(contents: pd.Series) -> pd.Series:
    """A section for each page; blank pages and unreadable files say so."""

    def one(content: bytes) -> list[dict]:
        try:
            from pypdf import PdfReader

            pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
        except Exception as error:
            return [{"loc": "Full PDF", "text": f"PDF could not be read: {type(error).__name__}", "metadata": {"error": "true"}}]
        return [{"loc": f"Page {n}", "text": t.strip() or f"Page {n} holds no text.", "metadata": {"is_image_page": str(not t.strip()).lower()}} for n, t in enumerate(pages, 1)]

    return contents.map(one)


def parse(files: DataFrame, respect_fences: bool = False) -> DataFrame:
    """Parses each file by its suffix; each format is a branch of its own, so files meet only the Python they need."""
    rows = files.select("source_uri", "content").withColumn("ext", suffix("source_uri"))
    spoken = title_case(F.replace(stem("source_uri"), F.lit("-"), F.lit(" ")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    parts = []
    front, body = split_frontmatter("text")
    marked = rows.where(F.col("ext").isin(*MARKDOWN)).select("source_uri", text.alias("text")).select("source_uri", F.coalesce(body, "text").alias("body"), yaml_fields(front).alias("f"))
    none = F.create_map().cast("map<string,string>")
    parts.append(marked.select("source_uri", F.coalesce(F.col("f")["title"], spoken).alias("title"), markdown_sections(F.col("body"), respect_fences).alias("sections"), F.coalesce("f", none).alias("metadata")))
    tables = rows.where(F.col("ext").isin(*TABULAR))
    parts.append(tables.select("source_uri", spoken.alias("title"), table_sections(text, F.when(F.col("ext") == ".tsv", "\t").otherwise(",")).alias("sections"), none.alias("metadata")))
    parts.append(rows.where(F.col("ext") == ".pdf").select("source_uri", spoken.alias("title"), pdf_sections("content").alias("sections"), none.alias("metadata")))
    picture = rows.where(F.col("ext").isin(*IMAGES))
    name = title_case(F.regexp_replace(stem("source_uri"), "[-_]", " "))
    kind = F.upper(F.substring("ext", 2, 16))
    about = F.format_string("Image: %s (%s). Format: %s, size: %d bytes. Stored at %s.", name, file_name("source_uri"), kind, F.length("content"), F.col("source_uri"))
    meta = F.create_map(F.lit("format"), kind, F.lit("size_bytes"), F.length("content").cast("string"))
    parts.append(picture.select("source_uri", name.alias("title"), F.array(F.struct(F.lit("Image Asset").alias("loc"), about.alias("text"), meta.alias("metadata"))).alias("sections"), F.create_map(F.lit("type"), F.lit("image"), F.lit("format"), kind).alias("metadata")))
    code = rows.where(F.col("ext").isin(*CODE))
    fenced = F.concat(F.lit("```"), F.substring("ext", 2, 16), F.lit("\n"), strip(text), F.lit("\n```"))
    parts.append(code.select("source_uri", file_name("source_uri").alias("title"), F.array(_plain(F.lit("Full Source Code"), fenced)).alias("sections"), none.alias("metadata")))
    other = rows.where(~F.col("ext").isin(*MARKDOWN, *TABULAR, ".pdf", *IMAGES, *CODE))
    parts.append(other.select("source_uri", stem("source_uri").alias("title"), F.array(_plain(F.lit("Full Document"), F.when(F.length("content") > 0, strip(text)).otherwise("Binary file asset"))).alias("sections"), none.alias("metadata")))
    return reduce(DataFrame.unionByName, parts)
