"""Queries of the text functions (inventory F1-F16, S5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Registry, sql_collapse, sql_fold, sql_lines, sql_strip, table

query = Registry()


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as (doc_id, line_no from 1, line)."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


_RICH = "chr(8220) || text || chr(8221) || ' ' || chr(8211) || chr(160) || chr(9) || chr(9) || chr(64257) || 'n' || chr(8230) || chr(7) || '  '"


def _sql_clean(x: str) -> str:
    out = x
    for k, v in T.CLEAN_CHARS.items():
        shown = v.replace("'", "''")
        out = f"replace({out}, chr({ord(k)}), '{shown}')"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    return sql_strip(f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')")


@query("txt_clean", f"SELECT doc_id, {_sql_clean(_RICH)} AS cleaned FROM documents")
def txt_clean(spark, sf_dir):
    rich = F.concat(F.lit("“"), F.col("text"), F.lit("” – \t\tﬁn…\x07  "))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(rich).alias("cleaned"))


@query("txt_fold", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def txt_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(
    "txt_dehyphenate",
    f"""
SELECT doc_id, line_no, CASE WHEN regexp_matches(p, '\\p{{L}}-$') AND length(p) >= 3 AND regexp_matches(nxt, '^\\p{{L}}') AND NOT regexp_matches(nxt, '^\\p{{Lu}}')
  THEN left(p, length(p) - 1) || nxt END AS joined
FROM (SELECT doc_id, line_no, rtrim(line, '.') || '-' AS p,
  CASE WHEN line_no % 2 = 0 THEN lower(lead(line) OVER w) ELSE lead(line) OVER w END AS nxt FROM ({sql_lines()}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
WHERE nxt IS NOT NULL""",
)
def txt_dehyphenate(spark, sf_dir):
    from pyspark.sql import Window

    following = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    pairs = lines_of(spark, sf_dir).select("doc_id", "line_no", F.concat(F.rtrim("line", F.lit(".")), F.lit("-")).alias("p"), F.when(F.col("line_no") % 2 == 0, F.lower(following)).otherwise(following).alias("nxt"))
    return pairs.where("nxt is not null").select("doc_id", "line_no", T.dehyphenate(F.col("p"), F.col("nxt")).alias("joined"))


#: Openings put before lines, by line number, so that every form occurs.
_OPENINGS = ("", "• ", "12) ", "(iv. ", "b- ", "1994. ", "- ", "3.2 ", "2.1.4. ", "Figura 7: ", "Tabla. 3 ", "Foto ")


def _opened(line, no):
    return F.concat(F.element_at(F.array(*(F.lit(x) for x in _OPENINGS)), (no % len(_OPENINGS) + 1).cast("int")), line)


_SQL_OPENED = f"({str(list(_OPENINGS))}[(line_no % {len(_OPENINGS)})::INTEGER + 1] || line)"
_SQL_BULLETS = "".join(c for c in T.BULLETS if c != "-") + "\\-"


@query(
    "txt_list_marker",
    f"""
SELECT doc_id, line_no, CASE WHEN bullet <> '' THEN bullet WHEN whole <> '' AND length(body) <= 3 THEN {sql_strip('whole')} END AS marker,
  CASE WHEN bullet <> '' THEN false WHEN whole <> '' AND length(body) <= 3 THEN true END AS ordered
FROM (SELECT doc_id, line_no, regexp_extract(t, '^([{_SQL_BULLETS}])\\s+', 1) AS bullet, regexp_extract(t, '{T.ORDERED}', 0) AS whole, regexp_extract(t, '{T.ORDERED}', 1) AS body
  FROM (SELECT doc_id, line_no, {_SQL_OPENED} AS t FROM ({sql_lines()})))""",
)
def txt_list_marker(spark, sf_dir):
    lines = lines_of(spark, sf_dir).select("doc_id", "line_no", _opened(F.col("line"), F.col("line_no")).alias("t"))
    m = T.list_marker(F.col("t"))
    return lines.select("doc_id", "line_no", m.alias("m")).select("doc_id", "line_no", "m.marker", "m.ordered")


@query("txt_heading_number", f"SELECT doc_id, line_no, nullif(regexp_extract({_SQL_OPENED}, '{T.HEADING_NUMBER}', 1), '') AS number FROM ({sql_lines()})")
def txt_heading_number(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "line_no", T.heading_number(_opened(F.col("line"), F.col("line_no"))).alias("number"))


@query("txt_caption", f"SELECT doc_id, line_no, regexp_matches({sql_fold(_SQL_OPENED)}, '{T.CAPTION}') AS caption FROM ({sql_lines()})")
def txt_caption(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "line_no", T.is_caption(_opened(F.col("line"), F.col("line_no"))).alias("caption"))


def _sql_garbage(x: str) -> str:
    return f"(length({x}) >= 40 AND (length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length({x}), 1) < 0.35 OR (length({x}) - length(regexp_replace({x}, '[\\x{{fffd}}\\x{{e000}}-\\x{{f8ff}}]', '', 'g'))) / greatest(length({x}), 1) > 0.05))"


@query("txt_garbage", f"SELECT doc_id, {_sql_garbage('text')} AS garbage, {_sql_garbage('holed')} AS garbage_holed FROM (SELECT *, regexp_replace(text, '[a-o]', '#', 'g') AS holed FROM documents)")
def txt_garbage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", "[a-o]", "#").alias("holed"))
    return docs.select("doc_id", T.looks_like_garbage(F.col("text")).alias("garbage"), T.looks_like_garbage(F.col("holed")).alias("garbage_holed"))


@query(
    "txt_slugify",
    "SELECT doc_id, CASE WHEN s = '' THEN 'sin-titulo' ELSE s END AS slug FROM (SELECT doc_id, rtrim(left(lower(trim(regexp_replace(strip_accents(coalesce(text, '')), '[^a-zA-Z0-9]+', '-', 'g'), '-')), 40), '-') AS s FROM documents)",
)
def txt_slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


_MIXED = "replace(text, ' ', ' a|b\\<c>&\"d\" ')"


@query(
    "txt_escape",
    f"""
SELECT doc_id, replace(replace(m, '\\', '\\\\'), '|', '\\|') AS md, replace(replace(replace(m, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
  '"' || {sql_strip("replace(replace(m, '\"', ''''), chr(10), ' ')")} || '"' AS yaml
FROM (SELECT doc_id, {_MIXED} AS m FROM documents)""",
)
def txt_escape(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit(' a|b\\<c>&"d" ')).alias("m"))
    return docs.select("doc_id", T.escape_md(F.col("m")).alias("md"), T.escape_html(F.col("m")).alias("html"), T.escape_yaml(F.col("m")).alias("yaml"))


@query("txt_token_estimate", "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def txt_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_FONTS = ("Arial-BoldMT", "Times-Oblique", "Calibri", "Roboto-Black", "DemiItalic", "Helvetica")


@query("txt_font_style", f"SELECT p_partkey, regexp_matches(f, '{T.BOLD_FONT}') AS bold, regexp_matches(f, '{T.ITALIC_FONT}') AS italic FROM (SELECT p_partkey, {list(_FONTS)}[(p_partkey % {len(_FONTS)})::INTEGER + 1] || p_type AS f FROM part)")
def txt_font_style(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    font = F.concat(F.element_at(F.array(*(F.lit(x) for x in _FONTS)), (F.col("p_partkey") % len(_FONTS) + 1).cast("int")), F.col("p_type"))
    return parts.select("p_partkey", T.font_style(font).alias("s")).select("p_partkey", "s.bold", "s.italic")


@query(
    "txt_context",
    f"""
SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || {sql_collapse('text[a + 1:b]')} || CASE WHEN b < length(text) THEN '...' ELSE '' END AS around
FROM (SELECT doc_id, text, greatest(0, length(text) // 3 - 46) AS a, least(length(text), length(text) // 3 + 10 + 46) AS b FROM documents)""",
)
def txt_context(spark, sf_dir):
    third = F.floor(F.length("text") / 3)
    return table(spark, sf_dir, "documents").select("doc_id", T.context(F.col("text"), third, third + 10).alias("around"))
