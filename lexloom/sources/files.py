"""Documents from files: text, DOCX and PDF by suffix, HTML to text, per-file errors as rows instead of failures."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def _plain(content: bytes) -> str:
    text = content.decode("utf-8")
    if not text.strip():
        raise ValueError("the file is empty")
    return text


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _blocks(root: ElementTree.Element) -> list[str]:
    """Paragraphs, and table rows with cells joined by ' | ' (a merged cell once), in order; blank ones are left out."""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for block in root:
        if block.tag == f"{_W}p":
            out.append(text(block))
        elif block.tag == f"{_W}tbl":
            out += [" | ".join(text(c).strip() for c in row.iter(f"{_W}tc")) for row in block.iter(f"{_W}tr")]
    return [x for x in out if x.strip()]


def docx_text(content: bytes, headers: bool = False, footers: bool = False) -> str:
    """The body's blocks in order, after the headers and before the footers where asked for. Headers and footers are parts of the file, so
    one that several sections share is told once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        part = lambda kind: [x for n in sorted(z.namelist(), key=lambda n: (len(n), n)) if n.startswith(f"word/{kind}") and n.endswith(".xml") for x in _blocks(ElementTree.fromstring(z.read(n)))]
        above, below = part("header") if headers else [], part("footer") if footers else []
    return "\n".join([*above, *(_blocks(body) if body is not None else []), *below])


def docx_loader(headers: bool = False, footers: bool = False) -> Callable[[bytes], str]:
    """A loader for ``load_files`` that also reads headers or footers."""
    return lambda content: docx_text(content, headers, footers)


def pdf_text(content: bytes) -> str:
    """Text layer of a PDF, pages joined by blank lines; needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs the optional package pypdf") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


LOADERS: dict[str, Callable[[bytes], str]] = {".txt": _plain, ".docx": docx_text, ".pdf": pdf_text}


def load_files(spark: SparkSession, path: str, loaders: dict[str, Callable[[bytes], str]] = LOADERS) -> DataFrame:
    """(path, filename, suffix, size, full_text, error) for the files of a folder; unknown suffixes and unreadable files give an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b.column(2).to_pylist(), b.column(4), strict=True):
                try:
                    if kind not in loaders:
                        raise ValueError(f"unsupported file type {kind!r}")
                    texts.append(loaders[kind](content.as_py()))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "filename", "suffix", "size", "full_text", "error"])

    raw = spark.read.format("binaryFile").load(path)
    src = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), suffix(F.col("path")).alias("suffix"), F.col("length").alias("size"), "content")
    return src.mapInArrow(run, "path string, filename string, suffix string, size long, full_text string, error string")


class _Text(HTMLParser):
    SKIP = frozenset({"script", "style", "noscript", "head"})
    BLOCK = frozenset({"p", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li"})

    def __init__(self):
        super().__init__()
        self.out, self.deep = [], 0

    def handle_starttag(self, tag, attrs):
        self.deep += tag in self.SKIP
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.deep:
            self.deep -= 1

    def handle_data(self, data):
        if not self.deep:
            self.out.append(data)


def strip_html(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text of HTML pages: no scripts, styles and heads, a line for every block."""
    return html.map(strip_html, na_action="ignore")


def json_text(c: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text."""
    return F.get_json_object(c, "$." + path)


def next_link(header: Column, body: Column) -> Column:
    """Address of the next page: rel=next of a Link header, else the usual keys of the body."""
    rel = F.regexp_extract(header, r"""<([^>]+)>[^,]*;\s*rel=["']?next["']?""", 1)
    keys = [F.get_json_object(body, f"$.{k}") for k in ("next", "next_url", "nextPage", "next_cursor")]
    return F.coalesce(F.nullif(rel, F.lit("")), *keys)


def from_pages(pages: DataFrame, doc: str = "source", order: str = "page", content: str = "page_content") -> DataFrame:
    """(doc, text): documents of other libraries' loaders, which come in pages: their contents in order with blank lines between; null
    pages add nothing."""
    parts = F.array_sort(F.collect_list(F.when(F.col(content).isNotNull(), F.struct(F.col(order).alias("o"), F.col(content).alias("t")))))
    return pages.groupBy(F.col(doc).alias("doc")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def bootstrap(files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, counts) of a first ingest: files (filename, text, error) whose name is not stored; a file that could not be read fails
    alone. Of several files with one name the one of the smallest text counts."""
    one = files.groupBy("filename").agg(F.min_by(F.struct("text", "error"), F.struct(F.col("error").isNotNull().alias("e"), "text")).alias("f")).select("filename", "f.*")
    known = stored.select("filename", F.lit(True).alias("known")).distinct()
    status = F.when(F.col("known"), "skipped").when(F.col("error").isNotNull() | F.col("text").isNull(), "failed").otherwise("inserted")
    told = one.join(known, "filename", "left").withColumn("status", status)
    return told.filter("status = 'inserted'").select("filename", F.col("text").alias("extracted_text"), F.sha2("text", 256).alias("file_hash")), told.groupBy("status").agg(F.count("*").alias("files"))
