"""Numbers, page ranges, names of sheets and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Fixed values of sheets and files.
EXCEL_MAX_CELL, MAX_COL_WIDTH, SHEET_BASE = 32767, 60, 28
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def coerce(c: Column) -> Column:
    """struct(number, text): a cell as a number, written the Spanish or the English way, or else as text."""
    text = strip(F.coalesce(c, F.lit("")))
    bare = strip(F.regexp_replace(text, "[%€$]", ""))
    commas, dots = (F.length(F.regexp_replace(bare, f"[^{x}]", "")) for x in (",", "."))
    last_comma = F.instr(F.reverse(bare), ",")
    last_dot = F.instr(F.reverse(bare), ".")
    plain = (
        F.when((commas > 0) & (dots > 0) & (last_comma < last_dot), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((commas > 0) & (dots > 0), F.replace(bare, F.lit(","), F.lit("")))
        .when(commas == 1, F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(F.replace(bare, F.lit(","), F.lit("")))
    )
    numeric = (text != "") & (F.length(text) <= 40) & bare.rlike(r"^[-+]?[\d.,]+$") & plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$")
    number = F.when(numeric, plain.try_cast("double"))
    return F.struct(number.alias("number"), F.when(number.isNull(), F.left(text, F.lit(EXCEL_MAX_CELL))).alias("text"))


def selected_pages(spec: Column, total: Column) -> Column:
    """Page numbers that a range such as '1-3,7,10-' selects of total; nothing selected means all."""
    chunks = F.filter(F.split(F.replace(F.coalesce(spec, F.lit("")), F.lit(" "), F.lit("")), ","), lambda x: x != "")

    def pages(x: Column) -> Column:
        dash = F.instr(x, "-")
        a = F.when(dash > 1, F.substr(x, F.lit(1), dash - 1)).when(dash == 0, x).otherwise("1").cast("int")
        b = F.when(dash == 0, x.cast("int")).when(dash < F.length(x), F.substr(x, dash + 1, F.length(x)).cast("int")).otherwise(total)
        lo, hi = F.greatest(F.lit(1), F.least(a, b)), F.least(total, F.greatest(a, b))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(chunks, pages))))
    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(chosen) > 0, chosen).otherwise(every)


def capped_dpi(width: Column, height: Column, dpi: Column, max_pixels: int = 40_000_000) -> Column:
    px = (width / 72 * dpi) * (height / 72 * dpi)
    return F.when(px <= max_pixels, dpi.cast("int")).otherwise(F.greatest(F.lit(120), F.floor(dpi * F.sqrt(F.lit(float(max_pixels)) / px)).cast("int")))


def sheet_base(name: Column) -> Column:
    """A sheet's name before it is made unique."""
    out = F.left(strip(F.regexp_replace(name, r"[\\/*?:\[\]]", "-")), F.lit(SHEET_BASE))
    return F.when(out == "", "Hoja").otherwise(out)


def safe_stem(name: Column, fallback: str = "documento") -> Column:
    stem = F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" ."))
    stem = F.when(F.upper(stem).isin(*RESERVED), F.concat(F.lit("_"), stem)).otherwise(stem)
    return F.when(stem == "", fallback).otherwise(F.left(stem, F.lit(120)))


def _one_decimal(x: Column) -> Column:
    """A double from 0 on with one decimal, its exact value rounded half to even as C's printf does.

    format_string rounds the shortest digits of a double half up. Ten times the
    fraction is taken in two parts that are exact wherever a half is near.
    """
    whole = F.floor(x)
    part = x - whole
    head = F.floor(part * 2.0**26) / 2.0**26
    ten, rest = head * 10, (part - head) * 10
    low = F.floor(ten + rest)
    half = (low - ten) + 0.5
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    tenths = low + up.cast("long")
    shown = F.format_string("%d.%d", whole + F.floor(tenths / 10), tenths % 10)
    return F.when(x < 2.0**53, shown).otherwise(F.format_string("%.1f", x))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, halves rounded to even."""
    d = n.cast("double")
    in_unit = lambda size, name: F.concat(_one_decimal(d / size), F.lit(name))
    return (
        F.when(d < 1024, F.format_string("%.0f B", F.rint(d))).when(d < 1024**2, in_unit(1024, " KB"))
        .when(d < 1024**3, in_unit(1024**2, " MB")).otherwise(in_unit(1024**3, " GB"))
    )


def pages_shown(pages: Column) -> Column:
    """The first six pages of a sorted list, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(pages, 1, 6), lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) <= 6, shown).otherwise(F.concat(shown, F.lit("... (+"), (F.size(pages) - 6).cast("string"), F.lit(")")))
