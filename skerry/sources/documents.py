"""Document sources: folders of text, HTML, Markdown and PDF files; page tables; embedding files; made corpora."""

from __future__ import annotations

import re
from html import escape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import file_stem, file_suffix, is_blank
from ..operators.numbering import numbered

#: File suffixes and the source type that reads them.
SOURCE_TYPES = {".txt": "txt", ".pdf": "pdf", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown"}
ALL_SOURCE_TYPES = ("txt", "pdf", "html", "markdown", "web")


class _Text(HTMLParser):
    """Text nodes outside script and style, and the first title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hidden = 0
        self.title: str | None = None
        self.in_title = False

    def handle_starttag(self, tag, attributes):
        self.hidden += tag in ("script", "style")
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "title":
            self.in_title = False

    def handle_startendtag(self, tag, attributes):
        pass

    def handle_data(self, data):
        if not self.hidden:
            self.nodes.append(data)
        if self.in_title:
            self.title = (self.title or "") + data


def _parsed(html: str | None) -> _Text:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser


def text_of(html: str | None) -> str:
    """The text nodes of a page, a line each, lines stripped and blank ones dropped."""
    lines = "\n".join(_parsed(html).nodes).splitlines()
    return "\n".join(s for line in lines if (s := line.strip()))


def title_of(html: str | None) -> str | None:
    """The first title, stripped; None if absent or empty."""
    return (_parsed(html).title or "").strip() or None


_REFERENCE = re.compile(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def closed_only(html: str | None) -> str | None:
    """The page with such ampersands escaped as begin no character reference that its semicolon closes; these then stay as they are written."""
    return html and _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


_INLINE = (
    (re.compile(r"(`+)(.+?)\1", re.DOTALL), lambda m: f"<code>{escape(m[2].strip(), False)}</code>"),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), lambda m: ""),
    (re.compile(r"\[([^\]]+)\]\([^)]*\)"), lambda m: f"<a>{m[1]}</a>"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.DOTALL), lambda m: f"<b>{m[2]}</b>"),
    (re.compile(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", re.DOTALL), lambda m: f"<i>{m[2]}</i>"),
)


def markdown_to_html(text: str) -> str:
    """Headings, lists, quotes, rules, indented code, emphasis, code spans and links of Markdown as HTML; fences are code spans."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        if not block.strip():
            continue
        if re.match(r"(    |\t)", block):
            out.append(f"<pre>{escape(block, False)}</pre>")
            continue
        lines = []
        for line in block.split("\n"):
            if re.fullmatch(r"[ \t]*([-*_][ \t]*){3,}|[ \t]*=+[ \t]*|[ \t]*-+[ \t]*", line):
                continue
            if m := re.match(r"[ \t]{0,3}#{1,6}[ \t]*(.*?)[ \t]*#*[ \t]*$", line):
                lines.append(f"<h1>{m[1]}</h1>")
            elif m := re.match(r"[ \t]*(?:[-*+]|\d+\.)[ \t]+(.*)", line):
                lines.append(f"<li>{m[1]}</li>")
            else:
                lines.append(re.sub(r"^[ \t]*>[ \t]?", "", line))
        block = "\n".join(lines)
        for pattern, new in _INLINE:
            block = pattern.sub(new, block)
        out.append(f"<p>{block}</p>")
    return "\n".join(out)


def _pdf_text(content: bytes) -> str:
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("the package pypdf is needed to read PDF files") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(text_of)


@F.pandas_udf(StringType())
def html_title(html: pd.Series) -> pd.Series:
    return html.map(title_of)


@F.pandas_udf(StringType())
def closed_html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: text_of(closed_only(x)))


@F.pandas_udf(StringType())
def closed_html_title(html: pd.Series) -> pd.Series:
    return html.map(lambda x: title_of(closed_only(x)))


@F.pandas_udf(StringType())
def markdown_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: text_of(markdown_to_html(t or "")))


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    return content.map(_pdf_text)


def markdown_title(text: Column) -> Column:
    """The first line that is a heading of the first level, even inside code; null without one."""
    found = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*# [ \t]*(\S.*)$", 1))
    return F.when(found != "", found)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 with U+FFFD for what is none, line ends as \\n."""
    return F.regexp_replace(content.cast("string"), "\r\n?", "\n")


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)


def load_folder(spark: SparkSession, folder: str, skip_empty: bool = True) -> DataFrame:
    """documents(doc_id, source_path, source_type, title, raw_text, metadata) of a folder, with all below it.

    Files of unknown suffixes are left out; a missing folder is an error. Ids follow the paths, compared part by part, and are given
    after files without text are dropped, from 1. With skip_empty off a file without text is an error.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(folder)
    return documents_from_files(with_source_type(_files(spark, folder).select("path", "content")), skip_empty)


def with_source_type(files: DataFrame) -> DataFrame:
    """files(path, ...) with the source type that their suffix, whatever its case, names; those of unknown suffixes are left out."""
    types = F.create_map(*(F.lit(x) for pair in SOURCE_TYPES.items() for x in pair))
    return files.withColumn("source_type", types[file_suffix(F.col("path"))]).where(F.col("source_type").isNotNull())


def documents_from_files(files: DataFrame, skip_empty: bool = True) -> DataFrame:
    """The same from files(path, content, source_type). Each source type is a branch of its own, so only HTML, Markdown and PDF reach Python."""
    text = decoded(F.col("content"))
    stem = file_stem(F.col("path"))
    branches = {
        "txt": (text, stem),
        "html": (html_text(text), F.coalesce(html_title(text), stem)),
        "markdown": (markdown_text(text), F.coalesce(markdown_title(text), stem)),
        "pdf": (pdf_text(F.col("content")), stem),
    }
    read = None
    for kind, (body, title) in branches.items():
        rows = files.where(F.col("source_type") == kind).select("path", "source_type", title.alias("title"), body.alias("raw_text"))
        read = rows if read is None else read.unionByName(rows)
    if skip_empty:
        read = read.where(~is_blank(F.col("raw_text")))
    else:
        read = read.withColumn("raw_text", F.when(is_blank(F.col("raw_text")), F.raise_error(F.concat(F.lit("no text in "), F.col("path"))).cast("string")).otherwise(F.col("raw_text")))
    path = F.regexp_replace("path", "^file:/*", "/")
    read = numbered(read, [F.split("path", "/")], "doc_id")
    return read.select("doc_id", path.alias("source_path"), "source_type", "title", "raw_text", F.create_map().cast("map<string,string>").alias("metadata"))


def load_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of files, read in parallel by the scan itself."""
    return _files(spark, paths).select("path", decoded(F.col("content")).alias("text"))


def documents_from_table(table: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A table of texts as documents; the source column plays the source type."""
    return table.select(F.col(doc_id).alias("doc_id"), F.concat(F.lit("doc-"), F.col(doc_id).cast("string")).alias("source_path"), F.col(source).alias("source_type"), F.concat(F.lit("doc-"), F.col(doc_id).cast("string")).alias("title"), F.col(text).alias("raw_text"))


def documents_from_pages(pages: DataFrame, open_references: bool = True) -> DataFrame:
    """Fetched pages(url, html, crawl_order) as documents of type web. open_references: whether character references without a semicolon are decoded too, as browsers do."""
    text, title = (html_text, html_title) if open_references else (closed_html_text, closed_html_title)
    return pages.select(F.col("crawl_order").cast("long").alias("doc_id"), F.col("url").alias("source_path"), F.lit("web").alias("source_type"), F.coalesce(title("html"), "url").alias("title"), text("html").alias("raw_text"))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(key, embedding) of a JSON file that maps keys to vectors; an empty one is an error, as are vectors of different lengths."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("key", "embedding"))
    sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if not sizes["b"]:
        raise ValueError(f"no embeddings in {path}")
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of {sizes['a']} and of {sizes['b']} parts in {path}")
    return rows


def synthetic_corpus(spark: SparkSession, documents: int, length: int = 100, vocabulary: int = 500, seed: int = 42) -> DataFrame:
    """(doc_id, tokens) of words word0.. chosen by a seeded hash; the same on any cluster."""
    place = F.sequence(F.lit(0), F.lit(length - 1))
    digest = lambda i: F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string")))
    pick = lambda i: F.concat(F.lit("word"), F.pmod(F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("long"), F.lit(vocabulary)).cast("string"))
    return spark.range(documents).select(F.col("id").alias("doc_id"), F.transform(place, pick).alias("tokens"))


