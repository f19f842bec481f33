"""A folder into which pages are dropped, scanned as they come.

An extension: the batch operators run unchanged inside each micro-batch, and the
checkpoint of the stream makes every file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import build_rules, scrub
from ..operators.scan import detector_hits

PAGES = "doc string, page long, text string"


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of pages(doc, page, text) as a stream."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counts_by_kind(pages: DataFrame) -> DataFrame:
    """Running number of hits for each document and kind."""
    return detector_hits(pages).groupBy("doc", "kind").agg(F.count("*").alias("hits"))


def redact_stream(pages: DataFrame, out: str, checkpoint: str, detectors: tuple[str, ...], style: str = "mask") -> StreamingQuery:
    """Write redacted pages to the folder out; stateless, so each file is done when its batch is."""
    clean = pages.withColumn("text", scrub(F.col("text"), build_rules(detectors=detectors), style))
    return clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
