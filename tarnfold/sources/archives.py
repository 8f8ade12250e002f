"""Packages and documents as bytes: the report page of a ZIP, and pages of a PDF through a reader that is handed in."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..schemas import PAGES
from .files import over_files


_PAGE = re.compile(r"\.x?html$", re.I)


def report_page(content: bytes | None) -> tuple[str | None, bool]:
    """(text of the first .xhtml or .html member, whether the archive is sound); (None, False) for what is no archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            pages = [i for i in z.infolist() if _PAGE.search(i.filename)]
            return (z.read(pages[0]).decode("utf-8", "ignore") if pages else None), z.testzip() is None
    except Exception:  # noqa: BLE001 - any damage means that there is no page
        return None, False


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, actual_sha, zip_ok, esg_flag) of every package. Bytes stay in the task that read them; the phrase search is a built-in expression."""

    def unpack(name: str, content: bytes) -> list[tuple]:
        page, ok = report_page(content)
        return [(name, len(content), hashlib.sha256(content).hexdigest(), page, ok)]

    opened = over_files(spark, folder, unpack, "file string, size long, actual_sha string, page string, zip_ok boolean", "*.zip")
    return opened.select("file", "size", "actual_sha", "zip_ok", expr.has_anchor(F.col("page")).alias("esg_flag"))


def pdf_pages(content: bytes) -> list[tuple[str, float, float, bool]]:
    """(text, width, height, has a table) of each page, by pdfplumber where it is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [(p.extract_text(x_tolerance=1, y_tolerance=3) or "", float(p.width), float(p.height), bool(p.find_tables())) for p in pdf.pages]


def documents(spark: SparkSession, folder: str, reader: Callable[[bytes], list[tuple[str, float, float, bool]]] = pdf_pages, glob: str = "*.pdf") -> DataFrame:
    """Rows of PAGES, with the file's hash, of every document; report_id is the file's name without its ending."""

    def read(name: str, content: bytes) -> Iterator[tuple]:
        report, sha = re.sub(r"(?<=.)\.[^.]*$", "", name), hashlib.sha256(content).hexdigest()
        for i, (text, width, height, table) in enumerate(reader(content)):
            yield report, i, text, width, height, table, sha

    from ..operators.evidence import page_flags

    pages = over_files(spark, folder, read, PAGES.replace("quality_flags array<string>", "has_table boolean") + ", sha256 string", glob)
    return pages.withColumn("quality_flags", page_flags(F.col("native_text"), F.col("has_table"))).drop("has_table")


def table_shape(cells):
    """(rows, columns) of a table as an array of rows of cells."""
    return F.struct(F.size(cells).alias("row_count"), F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0)).alias("column_count"))
