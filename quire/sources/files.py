"""Files to convert: listing, and pages of PDF files where a reader is installed."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_SCHEMA = (
    "path string, page_no int, width double, height double, word_no int, text string, x0 double, top double, x1 double, bottom double, "
    "size double, bold boolean, italic boolean, font string, upright boolean, error string"
)
#: How near characters join into a word.
X_TOLERANCE, Y_TOLERANCE = 1.6, 2.6


def list_files(spark: SparkSession, paths: Sequence[str], pattern: str = "*.pdf") -> DataFrame:
    """(path, length, ordinal) of the files that paths (folders, files, wildcards) name; the first mention of a file counts."""
    found = None
    for i, p in enumerate(paths):
        part = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(p).select("path", "length", F.lit(i).alias("given"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "path string, length long, ordinal long")
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("given"))).where("n = 1")
    return once.select("path", "length", F.row_number().over(Window.orderBy("given", "path")).cast("long").alias("ordinal"))


def can_read_pdf() -> bool:
    return importlib.util.find_spec("pdfplumber") is not None


def pdf_words(spark: SparkSession, paths: Sequence[str], pages: str = "") -> DataFrame:
    """Words of PDF pages (WORD_SCHEMA). A page that fails is a row with its error, not the end of the job.

    Needs pdfplumber on the executors; untested where it isn't installed.
    """
    if not can_read_pdf():
        raise RuntimeError("reading PDF files needs pdfplumber")
    from ..functions.text import BOLD_FONT, ITALIC_FONT

    def read(batches):
        import io
        import re

        import pandas as pd
        import pdfplumber

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                with pdfplumber.open(io.BytesIO(content)) as doc:
                    for no, page in enumerate(doc.pages, 1):
                        try:
                            words = page.extract_words(x_tolerance=X_TOLERANCE, y_tolerance=Y_TOLERANCE, extra_attrs=["fontname", "size", "upright"])
                            rows += [
                                (path, no, page.width, page.height, i, w["text"], w["x0"], w["top"], w["x1"], w["bottom"], w["size"], bool(re.search(BOLD_FONT, w["fontname"])), bool(re.search(ITALIC_FONT, w["fontname"])), w["fontname"], w["upright"], None)
                                for i, w in enumerate(words)
                            ]
                        except Exception as e:
                            rows.append((path, no, *[None] * 13, str(e)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORD_SCHEMA.split(", ")])

    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(list(paths)).select("path", "content")
    return source.mapInPandas(read, WORD_SCHEMA)
