"""Reports and documents in files: readers by suffix, JSON scans, writers."""

from __future__ import annotations

import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import is_ancillary, is_sentinel, split
from ..plans import schema as S

# The suffixes that can be read, and in which order a report is looked for.
SUFFIXES = ("pdf", "html", "htm")
PRIORITY = ("pdf", "html", "txt")
#: Pages whose texts are Python strings at a time.
PAGES = 64
#: The names of files of JSON lines.
PART = r"^part-[0-9]{5}-"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


class _Text(HTMLParser):
    """Title, and the text nodes of the whole page and of the first element of each kind that can hold the report."""

    #: Elements in the order in which they are preferred; a role stands for any element.
    PLACES = ("article", "main", "body", "role=main")
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.open: list[str] = []
        self.inside: dict[str, int] = {}
        self.parts: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            return
        self.open.append(tag)
        for place in (tag, "role=main" if ("role", "main") in attrs else ""):
            if place in self.PLACES and place not in self.parts:
                self.parts[place] = []
                self.inside[place] = len(self.open)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.inside = {p: n for p, n in self.inside.items() if n <= len(self.open)}

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "title" and self.title is None:
            self.title = data.strip()
        if data.strip() and not (self.open and self.open[-1] in ("script", "style", "title")):
            for place in ("", *self.inside):
                self.parts.setdefault(place, []).append(data.strip())


def html_report(html: str) -> tuple[str | None, str]:
    """Title, and the text of the page's main part: its stripped text nodes, a line each."""
    p = _Text()
    p.feed(html)
    p.close()
    best = next((x for x in p.PLACES if x in p.parts), "")
    return p.title, "\n".join(p.parts.get(best, []))


@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def html_text(pages: pa.Array) -> pa.Array:
    """Title and text; pages are read from Arrow one at a time, so a batch is held once and never as Python strings."""
    slices = []
    for i in range(0, len(pages), PAGES):
        read = [html_report(x.as_py()) if x.is_valid else (None, None) for x in pages.slice(i, PAGES)]
        slices.append(pa.StructArray.from_arrays([pa.array([r[k] for r in read], pa.string()) for k in (0, 1)], names=["title", "text"]))
    return pa.concat_arrays(slices) if slices else pa.array([], pa.struct([("title", pa.string()), ("text", pa.string())]))


def load_html(pages: DataFrame, doc_id: Column, html: Column) -> DataFrame:
    """doc_id, title (doc_id if the page has none), text."""
    read = pages.select(doc_id.cast("string").alias("doc_id"), html_text(html).alias("_h"))
    return read.select("doc_id", F.when(F.coalesce("_h.title", F.lit("")) != "", F.col("_h.title")).otherwise(F.col("doc_id")).alias("title"), F.col("_h.text").alias("text"))


def pdf_report(content: bytes, name: str) -> tuple[str, str]:
    """Title and text of a PDF; needs PyMuPDF."""
    import fitz

    with fitz.open(stream=io.BytesIO(content), filetype="pdf") as doc:
        spans = [s["text"].strip() for b in doc[0].get_text("dict")["blocks"][:3] if b.get("lines") for s in b["lines"][0]["spans"][:1]] if len(doc) else []
        return next((s for s in spans if len(s) > 5), name), "\n\n".join(p.get_text() for p in doc).strip()


def load_reports(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """doc_id, title, text of the PDF and HTML files of a folder (or one file), a row each; other files are left out.

    strict: a path without any report is an error, and so is a single file of another kind. Rows come in no order; sort by doc_id where order matters."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, kind, content in zip(batch["doc_id"], batch["kind"], batch["content"]):
                title, text = pdf_report(content, name) if kind == "pdf" else html_report(content.decode("utf-8", "replace"))
                rows.append((name, title or name, text))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "text"])

    ending = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[1:]
    if strict and ending and 1 < len(ending[0]) < 5 and ending[0].isalpha() and ending[0].lower() not in SUFFIXES:
        raise ValueError(f"unsupported format: {path}")
    files = spark.read.format("binaryFile").load(path).where(suffix(F.col("path")).isin(*SUFFIXES))
    if strict and not files.select("path").limit(1).count():
        raise ValueError(f"no {', '.join(SUFFIXES)} report at {path}")
    return files.select(stem(F.col("path")).alias("doc_id"), suffix(F.col("path")).alias("kind"), "content").mapInPandas(read, "doc_id string, title string, text string")


def find_reports(documents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the path of their report, documents without one); files: path. Of several files the first kind of PRIORITY counts."""
    rank = F.array_position(F.array(*(F.lit(s) for s in PRIORITY)), suffix(F.col("path")))
    best = files.where(rank > 0).groupBy(stem(F.col("path")).alias("doc_id")).agg(F.min_by("path", rank).alias("path"))
    return documents.join(best, "doc_id"), documents.join(best, "doc_id", "left_anti")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, json: one JSON text for each file, logs and reports left out by their name, and one for each line of the files that write_documents writes
    (PART), whose doc_id stands in the line."""
    name = F.col("_metadata.file_name")
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").where(~name.rlike(PART)).select(stem(name).alias("doc_id"), F.col("value").alias("json"))
    lines = spark.read.text(path, pathGlobFilter="*.json").where(name.rlike(PART) & (F.col("value") != "")).select(F.get_json_object("value", "$.doc_id").alias("doc_id"), F.col("value").alias("json"))
    return whole.where(~is_ancillary(F.col("doc_id"))).union(lines)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, doc of gold files; an invalid one fails the read."""
    docs = read_json(spark, path).withColumn("doc", S.parse(F.col("json")))
    broken = S.violations(F.col("doc"))
    checked = F.when(F.size(broken) == 0, F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("invalid gold document "), F.col("doc_id"), F.lit(": "), F.array_join(broken, ", "))).cast(S.DOCUMENT))
    return docs.select("doc_id", checked.alias("doc"))


def load_system(spark: SparkSession, path: str, validated: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, failures, sentinels) of a variant's output folder; without validation every object is a document."""
    raw = read_json(spark, path).withColumn("sentinel", is_sentinel(F.col("json")))
    real = raw.where(~F.col("sentinel")).withColumn("doc", S.parse(F.col("json")))
    rows = real.withColumn("violations", S.violations(F.col("doc")) if validated else F.array().cast("array<string>"))
    ok, bad = split(rows)
    sent = raw.where("sentinel").select("doc_id", F.get_json_object("json", "$.error").alias("error"), F.coalesce(F.get_json_object("json", "$.context_overflow").try_cast("boolean"), F.lit(False)).alias("context_overflow"))
    return ok.select("doc_id", "doc"), bad.select("doc_id", "json", "violations"), sent


def write_documents(docs: DataFrame, path: str, sentinels: DataFrame | None = None) -> None:
    """Documents (doc_id, doc) as JSON lines in files that read_json reads; absent fields are written as null. sentinels (doc_id, error, context_overflow): the
    documents that failed, a line each. With a column `variant`, a folder for each."""
    by = ["variant"] if "variant" in docs.columns else []

    def write(rows: DataFrame, mode: str) -> None:
        writer = rows.write.mode(mode).option("ignoreNullFields", "false")
        (writer.partitionBy(*by) if by else writer).json(path)

    write(docs.select(*by, "doc_id", "doc.*"), "overwrite")
    if sentinels is not None:
        write(sentinels.select(*by, "doc_id", "error", "context_overflow"), "append")


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Each result table as Parquet in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
