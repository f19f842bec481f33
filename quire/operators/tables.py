"""Tables as array<array<string>>: grids, gates, headers, and tables without rules.

Everything is a higher-order expression over the row that holds the table, so a
gate over a billion tables is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.numbers import MAX_COL_WIDTH
from ..functions.text import clean, escape_md, strip

#: Gates of table detection.
MIN_FILL, MIN_QUALITY, PROSE_LENGTH = 0.30, 0.35, 55
WS_BINS, WS_MIN_ROWS, WS_MIN_COLS = 300, 3, 2


def _empty() -> Column:
    return F.array().cast("array<array<string>>")


def n_cols(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def normalized(rows: Column) -> Column:
    """Rows padded on the right to the widest."""
    return let(n_cols(rows), lambda n: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))))


def clean_grid(rows: Column) -> Column:
    """Cleaned cells without the rows and columns that are empty throughout."""
    tidy = F.transform(F.coalesce(rows, _empty()), lambda r: F.transform(r, lambda c: clean(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    full = F.filter(tidy, lambda r: F.exists(r, lambda c: c != ""))

    def columns(p: Column) -> Column:
        used = F.filter(F.sequence(F.lit(0), F.greatest(n_cols(p) - 1, F.lit(0))), lambda i: F.exists(p, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
        return let(used, lambda keep: F.transform(p, lambda r: F.transform(keep, lambda i: F.get(r, i))))

    return let(normalized(full), lambda p: F.when(F.size(p) > 0, columns(p)).otherwise(_empty()))


def splits_words(rows: Column) -> Column:
    """Whether more than 30 % of the rows cut a word between two cells."""
    def broken(r: Column) -> Column:
        pairs = F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.exists(pairs, lambda x: F.rtrim(x["a"]).rlike(r"\p{L}$") & F.ltrim(x["b"]).rlike(r"^\p{Ll}"))

    return (F.size(rows) > 0) & (F.size(F.filter(rows, broken)) > F.size(rows) * 0.30)


def _prose_cells(rows: Column) -> Column:
    return F.size(F.filter(F.flatten(rows), lambda c: (F.length(c) > PROSE_LENGTH) & c.rlike("[.;:]")))


def is_prose(rows: Column) -> Column:
    return _prose_cells(rows) > F.size(rows) * 0.5


def filled(r: Column) -> Column:
    return F.size(F.filter(r, lambda c: strip(c) != ""))


def quality(rows: Column) -> Column:
    """0 to 1: how much a grid looks like a table."""
    n, cols = F.size(rows), n_cols(rows)
    fill = F.aggregate(rows, F.lit(0), lambda a, r: a + filled(r)) / F.greatest(n * cols, F.lit(1))
    consistent = F.size(F.filter(rows, lambda r: filled(r) >= 2)) / F.greatest(n, F.lit(1))
    fine = (n >= 2) & (cols >= 2) & (fill >= MIN_FILL) & ~splits_words(rows) & ~is_prose(rows)
    return F.when(fine, F.least(F.lit(1.0), fill * 0.6 + consistent * 0.4)).otherwise(F.lit(0.0))


def looks_like_header(rows: Column) -> Column:
    """A first row that is mostly filled and hardly numeric."""
    first = F.get(rows, F.lit(0))
    numeric = F.size(F.filter(first, lambda c: F.regexp_replace(strip(c), "[,.]", "").rlike(r"^\p{N}+$")))
    good = (filled(first) >= F.greatest(F.lit(2.0), F.size(first) * 0.6)) & (numeric <= F.size(first) * 0.3)
    return F.when(F.size(rows) >= 2, good).otherwise(F.lit(False))


def widths(rows: Column, scan: int = 200) -> Column:
    """Width of each column of a sheet."""
    cols = F.sequence(F.lit(0), F.greatest(n_cols(rows) - 1, F.lit(0)))
    seen = F.slice(rows, 1, scan)
    return F.transform(cols, lambda i: F.aggregate(seen, F.lit(8), lambda a, r: F.greatest(a, F.least(F.length(F.coalesce(F.get(r, i), F.lit(""))), F.lit(MAX_COL_WIDTH)))) + 2)


def to_markdown(rows: Column, has_header: Column) -> Column:
    """A GitHub table; a grid without a header gets an empty one."""
    def line(r: Column) -> Column:
        cells = F.transform(r, lambda c: let(strip(F.replace(escape_md(c), F.lit("\n"), F.lit("<br>"))), lambda x: F.when(x == "", " ").otherwise(x)))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def whole(p: Column) -> Column:
        n = F.size(F.get(p, F.lit(0)))
        headed = has_header & (F.size(p) > 1)
        head = F.when(headed, F.get(p, F.lit(0))).otherwise(F.array_repeat(F.lit(""), n))
        body = F.when(headed, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1)))).otherwise(p)
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))
        return F.array_join(F.concat(F.array(line(head), rule), F.transform(body, line)), "\n")

    return let(normalized(rows), lambda p: F.when(F.size(p) > 0, whole(p)).otherwise(F.lit("")))


def to_html(rows: Column, has_header: Column) -> Column:
    from ..functions.text import escape_html

    def cells(r: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    def whole(p: Column) -> Column:
        headed = has_header & (F.size(p) > 1)
        head = F.when(headed, F.concat(F.lit("<thead>"), cells(F.get(p, F.lit(0)), "th"), F.lit("</thead>"))).otherwise("")
        body = F.when(headed, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1)))).otherwise(p)
        return F.concat(F.lit('<div class="tablewrap"><table>'), head, F.lit("<tbody>"), F.array_join(F.transform(body, lambda r: cells(r, "td")), ""), F.lit("</tbody></table></div>"))

    return let(normalized(rows), lambda p: F.when(F.size(p) > 0, whole(p)).otherwise(F.lit("")))


def suppress(candidates: Column, threshold: float = 0.35) -> Column:
    """Boxes (structs x0, top, x1, bottom) in order, without those that overlap one kept before."""
    def area(b: Column) -> Column:
        return (b["x1"] - b["x0"]) * (b["bottom"] - b["top"])

    def clash(a: Column, b: Column) -> Column:
        w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
        h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
        small = F.least(area(a), area(b))
        return F.when((w > 0) & (h > 0) & (small > 0), w * h / small > threshold).otherwise(F.lit(False))

    nothing = F.slice(candidates, 1, 0)
    return F.aggregate(candidates, nothing, lambda kept, c: F.when(F.exists(kept, lambda k: clash(c, k)), kept).otherwise(F.concat(kept, F.array(c))))


def whitespace_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that may be rows of a table without rules, with run_no.

    lines(keys, line_no, words array<struct<text,x0,x1>>, x0, top, x1, bottom). A
    line fits if a gap between words is wide; a run breaks at a line that doesn't
    fit or lies far below the one before, which depends on that line only.
    """
    words = F.col("words")
    gaps = F.zip_with(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda b, a: b["x0"] - a["x1"])
    per_char = F.sort_array(F.transform(words, lambda w: (w["x1"] - w["x0"]) / F.greatest(F.length(w["text"]), F.lit(1))))
    n = F.size(per_char)
    median = (F.get(per_char, F.floor((n - 1) / 2).cast("int")) + F.get(per_char, F.floor(n / 2).cast("int"))) / 2
    fits = (F.size(words) >= 2) & (F.array_max(gaps) >= median * 1.4 * 2.2)
    order = Window.partitionBy(*keys).orderBy("line_no")
    before_bottom, before_top = F.lag("bottom").over(order), F.lag("top").over(order)
    far = F.col("top") - before_bottom > F.greatest(before_bottom - before_top, F.lit(6.0)) * 2.2
    marked = lines.withColumn("fits", fits).withColumn("breaks", ~F.col("fits") | F.coalesce(far, F.lit(True)) | ~F.coalesce(F.lag("fits").over(order), F.lit(False)))
    return marked.withColumn("run_no", F.sum(F.col("breaks").cast("int")).over(order)).where("fits").drop("fits", "breaks")


def whitespace_tables(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Tables found by white columns: keys, run_no, box, rows, confidence."""
    runs = whitespace_runs(lines, keys)
    by = [*keys, "run_no"]
    row = F.struct("line_no", "words")
    run = runs.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("lines"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).where(F.size("lines") >= WS_MIN_ROWS)
    step = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) / WS_BINS
    bin_of = lambda x: F.greatest(F.lit(0), F.least(F.lit(WS_BINS - 1), F.floor((x - F.col("x0")) / step).cast("int")))
    all_words = F.flatten(F.transform("lines", lambda x: x["words"]))
    used = F.array_distinct(F.flatten(F.transform(all_words, lambda w: F.sequence(bin_of(w["x0"]), F.greatest(bin_of(w["x0"]), bin_of(w["x1"]))))))
    least_gap = max(2, int(WS_BINS * 0.012))
    cell = lambda ws, lo, hi: clean(F.array_join(F.transform(F.filter(ws, lambda w: ((w["x0"] + w["x1"]) / 2 >= lo) & ((w["x0"] + w["x1"]) / 2 < hi)), lambda w: w["text"]), " "))

    def edges(u: Column) -> Column:
        # A separator is a run of empty bins between two used ones.
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(u) - 1, F.lit(1))), lambda i: F.coalesce(F.get(u, i) - F.get(u, i - 1) - 1, F.lit(0)) >= least_gap)
        separators = F.transform(places, lambda i: F.col("x0") + (F.get(u, i - 1) + 1 + F.get(u, i)) / 2 * step)
        return F.concat(F.array(F.col("x0") - 1.0), separators, F.array(F.col("x1") + 1.0))

    def grid(e: Column) -> Column:
        cols = F.sequence(F.lit(0), F.size(e) - 2)
        return F.transform("lines", lambda x: F.transform(cols, lambda i: cell(x["words"], F.get(e, i), F.get(e, i + 1))))

    def judged(r: Column) -> Column:
        n, width = F.size(r), F.size(F.get(r, F.lit(0)))
        multi = F.size(F.filter(r, lambda x: F.size(F.filter(x, lambda c: c != "")) >= 2))
        every = F.forall(F.sequence(F.lit(0), width - 1), lambda i: F.size(F.filter(r, lambda x: F.get(x, i) != "")) >= n * 0.6)
        confidence = F.size(F.filter(F.flatten(r), lambda c: c != "")) / (n * width)
        good = (width >= WS_MIN_COLS) & (multi >= n * 0.7) & (multi >= WS_MIN_COLS) & every & (_prose_cells(r) <= n * 0.5) & (confidence >= 0.55)
        return F.when(good, F.array(F.struct(r.alias("rows"), F.round(confidence, 3).alias("confidence"))))

    # Each step is bound once, and the explode keeps the optimiser from computing it for every use.
    table = let(F.sort_array(used), lambda u: let(edges(u), lambda e: let(grid(e), judged)))
    return run.select(*by, "x0", "top", "x1", "bottom", F.explode(table).alias("t")).select(*by, "x0", "top", "x1", "bottom", "t.rows", "t.confidence")
