"""Words from the tab-separated output of an OCR engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

#: The columns of that output; level 5 is a word.
COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
WORD_LEVEL = 5


def _cells(pages: DataFrame, key: str, tsv: str, scale: float) -> DataFrame:
    rows = pages.select(key, F.posexplode(F.split(tsv, "\n")).alias("row_no", "row")).where("row_no > 0").withColumn("c", F.split("row", "\t", -1))
    number = lambda name: F.get("c", F.lit(COLUMNS.index(name))).try_cast("double")
    cells = rows.select(key, "row_no", clean(F.get("c", F.lit(COLUMNS.index("text")))).alias("text"), *(number(k).alias(k) for k in ("level", "left", "top", "width", "height", "conf")))
    known = cells.where((F.col("level") == WORD_LEVEL) & (F.col("text") != "") & (F.col("conf") >= 0) & F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())
    return known.select(
        key, "row_no", "text", "conf", (F.col("left") / scale).alias("x0"), (F.col("top") / scale).alias("top"),
        ((F.col("left") + F.col("width")) / scale).alias("x1"), ((F.col("top") + F.col("height")) / scale).alias("bottom"), (F.col("height") / scale).alias("size"),
    )


def words(pages: DataFrame, key: str = "doc_id", tsv: str = "tsv", scale: float = 1.0, min_conf: float = 40.0) -> DataFrame:
    """Words of confidence min_conf and more, in points."""
    return _cells(pages, key, tsv, scale).where(F.col("conf") >= min_conf)


def mean_confidence(pages: DataFrame, key: str = "doc_id", tsv: str = "tsv", scale: float = 1.0) -> DataFrame:
    """Mean over all words, those below any threshold included; 0 for pages without one."""
    got = _cells(pages, key, tsv, scale).groupBy(key).agg(F.avg("conf").alias("mean_conf"))
    return pages.select(key).join(got, key, "left").select(key, F.coalesce("mean_conf", F.lit(0.0)).alias("mean_conf"))


def resolve_languages(requested, installed):
    """Requested languages that are installed, in the order asked for; else Spanish, English or any."""
    want = F.filter(F.split(requested, r"\+"), lambda x: x != "")
    have = F.filter(want, lambda x: F.array_contains(installed, x))
    fallback = F.when(F.array_contains(installed, F.lit("spa")), "spa").when(F.array_contains(installed, F.lit("eng")), "eng").otherwise(F.array_min(installed))
    return F.when(F.size(installed) == 0, requested).when(F.size(have) > 0, F.array_join(have, "+")).otherwise(fallback)
