"""Readers that give ``pages(source, page, text)``."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import repair_encoding, unless_blank

log = logging.getLogger(__name__)

PAGE_SCHEMA = "source string, page int, text string"
# Suffixes read as one whole text, and suffixes holding a table of page text.
WHOLE_TEXT = ("txt",)
PAGE_TABLES = ("json", "jsonl", "parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer splits than there are cores is dealt out to all of them, since work per
    text is heavy. Larger inputs have more splits than cores and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _glob(suffix: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)


def _file_name() -> Column:
    """Name of the file a row came from; Spark reports it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each UTF-8 text file as one row without a page number; ``source`` is the file name."""
    files = spark.read.option("pathGlobFilter", _glob("txt")).text(path, wholetext=True)
    return files.select(
        _file_name().alias("source"), F.lit(None).cast("int").alias("page"),
        F.col("value").alias("text"),
    )


def read_page_tables(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Page text that another tool took out of its documents, one row per page.

    A missing ``source`` is the name of the file that holds the row.
    """
    reader = spark.read.schema(PAGE_SCHEMA).option("pathGlobFilter", _glob(suffix))
    rows = reader.parquet(path) if suffix == "parquet" else reader.json(path)
    return rows.select(
        F.coalesce("source", _file_name()).alias("source"), "page",
        F.explode(unless_blank(repair_encoding(F.col("text")))).alias("text"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(name, suffix)`` of the visible files; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(_file_name().alias("name"))
    return files.withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Everything readable in a folder, as pages. Hidden files are skipped, other formats are
    reported and skipped."""
    suffixes = {r["suffix"] for r in list_files(spark, path).select("suffix").distinct().collect()}
    for other in sorted(suffixes - set(WHOLE_TEXT) - set(PAGE_TABLES)):
        log.warning("skipped files with suffix %r in %s", other, path)
    parts = [read_texts(spark, path)] if suffixes & set(WHOLE_TEXT) else []
    parts += [read_page_tables(spark, path, s) for s in PAGE_TABLES if s in suffixes]
    pages = parts[0] if parts else spark.createDataFrame([], PAGE_SCHEMA)
    for part in parts[1:]:
        pages = pages.unionByName(part)
    return pages


def from_documents(documents: DataFrame) -> DataFrame:
    """A table of whole documents ``(source, text)`` as pages without numbers."""
    return documents.select("source", F.lit(None).cast("int").alias("page"), "text")


# Character entities of HTML text, decoded in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

# HTML to Markdown text, as (pattern, replacement), applied in this order. Both Java
# and RE2 read these patterns the same way.
MARKDOWN_RULES = (
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?is)<nav\b.*?</nav>", ""),
    (r"(?is)<head\b.*?</head>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"[ \t\r\n]+", " "),
    (r"(?i)<h1\b[^>]*>", "\n# "),
    (r"(?i)<h2\b[^>]*>", "\n## "),
    (r"(?i)<h3\b[^>]*>", "\n### "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<tr\b[^>]*>", "\n|"),
    (r"(?i)</t[dh]>", "|"),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)</(h[1-6]|p|div|article|section|ul|ol|table)>", "\n"),
    (r"(?i)<p\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
)


def html_to_markdown(html: Column) -> Column:
    """Readable text of a web page; headings, list items and table rows keep Markdown marks."""
    text = html
    for pattern, replacement in MARKDOWN_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def from_html(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as pages; the source is the host of the address. An id
    beyond the range of page numbers gives no page number."""
    return pages.select(
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("source"),
        F.expr("try_cast(page_id AS int)").alias("page"),
        F.explode(unless_blank(html_to_markdown(F.col("html")))).alias("text"),
    )
