"""Markdown files as classified lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of lines, tried in this order.
FENCE = r"^\s*(```+|~~~+)\s*(\w+)?\s*$"
FORMS = (
    ("comment", r"^\s*<!--"),
    ("hr", r"^\s*([-*_])\s*(?:\1\s*){2,}$"),
    ("image", r"^\s*!\[([^\]]*)\]\(([^)]+)\)\s*$"),
    ("heading", r"^(#{1,6})\s+(.*)$"),
    ("quote", r"^\s*>\s?(.*)$"),
    ("ul", r"^(\s*)[-*+]\s+(.*)$"),
    ("ol", r"^(\s*)(\d{1,3})[.)]\s+(.*)$"),
    ("table", r"^\s*\|"),
)
#: The forms of spans inside a line, in the order in which they are told apart.
SPANS = {"code": r"`[^`]+`", "bold": r"\*\*[^*]+\*\*|__[^_]+__", "link": r"\[[^\]]*\]\([^)]+\)"}


def spans(line: Column) -> Column:
    """The marked spans of a line in order, as structs (kind, text); code hides what looks marked inside it."""
    found = F.regexp_extract_all(line, F.lit("|".join(SPANS.values())), F.lit(0))
    inner = lambda m: F.when(m.startswith("`"), F.btrim(m, F.lit("`"))).when(m.startswith("["), F.regexp_extract(m, r"^\[([^\]]*)\]", 1)).otherwise(F.substr(m, F.lit(3), F.length(m) - 4))
    kind = lambda m: F.when(m.startswith("`"), "code").when(m.startswith("["), "link").otherwise("bold")
    return F.transform(found, lambda m: F.struct(kind(m).alias("kind"), inner(m).alias("text")))


def line_class(line: Column) -> Column:
    out = F.when(line.rlike(r"^\s*$"), F.lit("blank"))
    for name, pattern in FORMS:
        out = out.when(line.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("paragraph"))


def parse(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, class, line) of every line; what stands between fences is code, whatever it looks like."""
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("i", "line")).select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line")
    order = Window.partitionBy(key).orderBy("line_no")
    fence = F.col("line").rlike(FENCE)
    opened = F.sum(fence.cast("int")).over(order)
    kind = F.when(fence, "fence").when(opened % 2 == 1, "code").otherwise(line_class(F.col("line")))
    return lines.withColumn("class", kind)


def table_cells(line: Column) -> Column:
    """Cells of a row of a table."""
    inner = F.regexp_replace(F.regexp_replace(F.btrim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.replace(F.btrim(c), F.lit("\\|"), F.lit("|")), F.lit("<br>"), F.lit(" ")))


def front_matter(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, value) of the fields between two lines of --- at the head of a file of lines(key, line_no, line)."""
    rule = F.rtrim("line") == "---"
    order = Window.partitionBy(key).orderBy("line_no")
    seen = lines.withColumn("rules", F.sum(rule.cast("int")).over(order)).withColumn("last", F.sum(rule.cast("int")).over(Window.partitionBy(key)))
    opens = F.first(rule).over(order)
    inside = seen.withColumn("opens", opens).where(F.col("opens") & (F.col("rules") == 1) & (F.col("last") > 1) & ~rule)
    name, value = F.regexp_extract("line", r"^([^:]+?)\s*:", 1), F.regexp_extract("line", r"^[^:]+:\s*(.*?)\s*$", 1)
    return inside.select(key, name.alias("name"), F.btrim(value, F.lit("\"'")).alias("value")).where("name <> ''")


def paragraphs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, text): neighbouring lines of class paragraph of parse()'s lines folded into one."""
    order = Window.partitionBy(key).orderBy("line_no")
    new = (F.col("class") != "paragraph") | F.coalesce(F.lag("class").over(order) != "paragraph", F.lit(True))
    blocks = lines.withColumn("block", F.sum(new.cast("int")).over(order)).where(F.col("class") == "paragraph")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.btrim("line").alias("t")))), lambda x: x["t"]), " ")
    return blocks.groupBy(key, "block").agg(F.min("line_no").alias("line_no"), text.alias("text")).select(key, "line_no", "text")
