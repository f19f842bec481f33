"""Sheets of a workbook as frames, and the workbook itself where openpyxl is installed."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import coerce, sheet_base
from ..operators.tables import n_cols, normalized

#: The longest name of a sheet, and the columns of the index.
SHEET_NAME, INDEX = 31, ("Hoja", "Pagina", "Filas", "Columnas", "Deteccion", "Fiabilidad")


def unique_names(sheets: DataFrame, doc: str = "doc", name: str = "name", order: str = "ordinal") -> DataFrame:
    """sheets with sheet: names made valid, and unique in their document whatever the case, by a number behind them."""
    base = sheets.withColumn("__b", sheet_base(F.col(name)))
    n = F.row_number().over(Window.partitionBy(doc, F.lower("__b")).orderBy(order))
    suffix = F.concat(F.lit("_"), n.cast("string"))
    return base.withColumn("sheet", F.when(n == 1, F.col("__b")).otherwise(F.concat(F.left("__b", F.lit(SHEET_NAME) - F.length(suffix)), suffix))).drop("__b")


def index_sheet(tables: DataFrame) -> DataFrame:
    """(doc, sheet, page, n_rows, n_columns, source, confidence) of tables(doc, page, table_no, rows, source, confidence)."""
    named = tables.withColumn("name", F.format_string("p%d_t%d", F.col("page"), F.col("table_no"))).withColumn("ordinal", F.struct("page", "table_no"))
    return unique_names(named).select("doc", "sheet", "page", F.size("rows").alias("n_rows"), n_cols(F.col("rows")).alias("n_columns"), "source", F.round("confidence", 2).alias("confidence"))


def cells(tables: DataFrame) -> DataFrame:
    """(doc, page, table_no, row, column, number, text): every cell as a number or as text."""
    rows = tables.select("doc", "page", "table_no", F.posexplode(normalized(F.col("rows"))).alias("row", "r"))
    flat = rows.select("doc", "page", "table_no", "row", F.posexplode("r").alias("column", "cell"))
    return flat.select("doc", "page", "table_no", "row", "column", coerce(F.col("cell")).alias("v")).select("doc", "page", "table_no", "row", "column", "v.number", "v.text")


def write_workbooks(tables: DataFrame, folder: str) -> None:
    """One workbook for each document, written by the task that holds it. Needs openpyxl; untested where it isn't installed."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("writing workbooks needs openpyxl")
    listed = index_sheet(tables).select("doc", "sheet", "page")
    grouped = cells(tables).join(listed, ["doc", "page"]).groupBy("doc").agg(F.collect_list(F.struct("sheet", "row", "column", "number", "text")).alias("cells"))

    def write(rows):
        import os

        from openpyxl import Workbook

        for r in rows:
            book = Workbook()
            book.remove(book.active)
            for c in sorted(r["cells"], key=lambda c: c["sheet"]):
                sheet = book[c["sheet"]] if c["sheet"] in book.sheetnames else book.create_sheet(c["sheet"])
                sheet.cell(c["row"] + 1, c["column"] + 1, c["text"] if c["number"] is None else c["number"])
            book.save(os.path.join(folder, f"{r['doc']}.xlsx"))

    grouped.foreachPartition(write)
