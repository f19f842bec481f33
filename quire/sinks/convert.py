"""Elements to files of several formats, with redaction before and a leak check after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.redact import Rule, leaks, scrub, scrub_rows
from . import render

WRITERS = {"md": render.documents_md, "txt": render.documents_txt, "html": render.documents_html, "json": render.documents_json}


def scrubbed(elements: DataFrame, rules: Sequence[Rule], style: str = "mask", drop_images: bool = False) -> DataFrame:
    """elements with texts, cells and captions scrubbed; images go if asked."""
    kept = elements.where(F.col("type") != "image") if drop_images else elements
    return kept.withColumns({"text": scrub(F.col("text"), rules, style), "rows": scrub_rows(F.col("rows"), rules, style), "caption": scrub(F.col("caption"), rules, style)})


def convert(elements: DataFrame, out: str, formats: Sequence[str] = ("md",), rules: Sequence[Rule] = (), style: str = "mask", terms: Sequence[str] = ()) -> dict[str, str]:
    """Write one Parquet folder (doc, content) for each format under out; the paths, or an error, by format.

    An unknown format is an error of that format alone. With terms, outputs that
    still hold one raise after all formats are written.
    """
    clean = scrubbed(elements, rules, style) if rules else elements
    done, left = {}, 0
    for name in formats:
        if name not in WRITERS:
            done[name] = f"unknown format {name}"
            continue
        made = WRITERS[name](clean)
        path = f"{out}/{name}"
        made.select("doc", F.col(made.columns[-1]).alias("content")).write.mode("overwrite").parquet(path)
        done[name] = path
        if terms:
            left += leaks(elements.sparkSession.read.parquet(path), terms, text="content").where("size(leaked) > 0").count()
    if left:
        raise ValueError(f"{left} outputs still hold a listed term")
    return done
