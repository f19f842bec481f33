"""Queries of numbers, table grids and page filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import looks_like_garbage
from ..operators import tables as G
from ..sources import tsv
from .registry import Registry, sql_strip, table

query = Registry()

# ---- numbers -----------------------------------------------------------------
_AMOUNT = """
SELECT o_orderkey, CASE o_orderkey % 12
  WHEN 0 THEN a || '.' || b || ',' || c WHEN 1 THEN a || ',' || b || '.' || c WHEN 2 THEN a || '%' WHEN 3 THEN '€ ' || a WHEN 4 THEN a || '.' || b
  WHEN 5 THEN a || ',' || b WHEN 6 THEN a || ',' || b || ',' || b WHEN 7 THEN '-' || a || ',' || c || ' $' WHEN 8 THEN a || '.' || b || '.' || c
  WHEN 9 THEN o_orderpriority WHEN 10 THEN ' +' || c || '. ' ELSE '' END AS cell
FROM (SELECT o_orderkey, o_orderpriority, CAST(1 + o_orderkey % 97 AS VARCHAR) AS a, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS b, lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS c FROM orders)
"""


@query(
    "num_coerce_es_en",
    f"""
WITH cells AS ({_AMOUNT}),
s AS (SELECT o_orderkey, {sql_strip('cell')} AS t FROM cells),
b AS (SELECT *, {sql_strip("regexp_replace(t, '[%€$]', '', 'g')")} AS x FROM s),
p AS (SELECT *, CASE
  WHEN contains(x, ',') AND contains(x, '.') AND position(',' IN reverse(x)) < position('.' IN reverse(x)) THEN replace(replace(x, '.', ''), ',', '.')
  WHEN contains(x, ',') AND contains(x, '.') THEN replace(x, ',', '')
  WHEN length(x) - length(replace(x, ',', '')) = 1 THEN replace(x, ',', '.') ELSE replace(x, ',', '') END AS y FROM b)
SELECT o_orderkey, CASE WHEN ok THEN TRY_CAST(y AS DOUBLE) END AS number, CASE WHEN NOT ok THEN t END AS text
FROM (SELECT *, t <> '' AND length(t) <= 40 AND regexp_matches(x, '^[-+]?[\\d.,]+$') AND regexp_matches(y, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)$') AS ok FROM p)""",
)
def num_coerce(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b, c = (1 + F.col("o_orderkey") % 97).cast("string"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0")
    j = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    forms = [j(a, ".", b, ",", c), j(a, ",", b, ".", c), j(a, "%"), j("€ ", a), j(a, ".", b), j(a, ",", b), j(a, ",", b, ",", b), j("-", a, ",", c, " $"), j(a, ".", b, ".", c), F.col("o_orderpriority"), j(" +", c, ". "), F.lit("")]
    cell = F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return o.select("o_orderkey", N.coerce(cell).alias("v")).select("o_orderkey", "v.number", "v.text")


@query("num_human_size", "SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 97 + o_orderkey % 900)::DOUBLE AS b FROM orders)")
def num_human_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 97 + F.col("o_orderkey") % 900).alias("size"))


_STEM = "CASE p_partkey % 7 WHEN 0 THEN 'con' WHEN 1 THEN ' a/b:c* ' || p_name || '.' WHEN 2 THEN '...' WHEN 3 THEN 'COM3' ELSE repeat(p_name || '?', 12) END"


@query("num_safe_stem", f"SELECT p_partkey, CASE WHEN s = '' THEN 'documento' WHEN upper(s) IN {N.RESERVED} THEN '_' || s ELSE left(s, 120) END AS stem FROM (SELECT p_partkey, trim(regexp_replace({_STEM}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .') AS s FROM part)")
def num_safe_stem(spark, sf_dir):
    k, n = F.col("p_partkey") % 7, F.col("p_name")
    name = F.when(k == 0, "con").when(k == 1, F.concat(F.lit(" a/b:c* "), n, F.lit("."))).when(k == 2, "...").when(k == 3, "COM3").otherwise(F.repeat(F.concat(n, F.lit("?")), F.lit(12)))
    return table(spark, sf_dir, "part").select("p_partkey", N.safe_stem(name).alias("stem"))


# ---- grids from lineitem -----------------------------------------------------
_GRID = """
SELECT l_orderkey, list_concat([['Line', 'Flag', 'Qty', '', 'Note']], list([
  CAST(l_linenumber AS VARCHAR), CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_returnflag || ' ' || lower(l_linestatus) END,
  CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE CAST(l_quantity::INTEGER AS VARCHAR) END, '',
  CASE l_partkey % 11 WHEN 0 THEN 'A long remark about the part; it says: the delivery was late again, as ever.' WHEN 1 THEN 'cut|off' WHEN 2 THEN 'two' || chr(10) || 'lines' ELSE '' END]
  ORDER BY l_linenumber, l_partkey, l_suppkey)) AS rows
FROM lineitem GROUP BY l_orderkey
"""


def grids(spark, sf_dir):
    """A table for each order, with empty cells, an empty column and remarks."""
    k = F.col("l_partkey")
    note = F.when(k % 11 == 0, "A long remark about the part; it says: the delivery was late again, as ever.").when(k % 11 == 1, "cut|off").when(k % 11 == 2, "two\nlines").otherwise("")
    row = F.array(
        F.col("l_linenumber").cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat("l_returnflag", F.lit(" "), F.lower("l_linestatus"))),
        F.when(k % 5 == 0, " ").otherwise(F.col("l_quantity").cast("int").cast("string")), F.lit(""), note,
    )
    head = F.array(F.array(*(F.lit(x) for x in ("Line", "Flag", "Qty", "", "Note"))))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")))).alias("x"))
    return listed.select("l_orderkey", F.concat(head, F.transform("x", lambda v: v["row"])).alias("rows"))


def _shown(rows):
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "¦")), "⏎")


_SQL_SHOWN = "array_to_string(list_transform({}, lambda r: array_to_string(r, '¦')), '⏎')"
_SQL_CELL = sql_strip("regexp_replace(replace(c, chr(10), ' '), '[ \\t]{2,}', ' ', 'g')")
_SQL_CLEAN = f"""
g AS ({_GRID}),
t AS (SELECT l_orderkey, list_filter(list_transform(rows, lambda r: list_transform(r, lambda c: {_SQL_CELL})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM g),
k AS (SELECT *, list_filter(range(1, len(rows[1]) + 1), lambda i: len(list_filter(rows, lambda r: r[i] <> '')) > 0) AS keep FROM t),
cg AS (SELECT l_orderkey, list_transform(rows, lambda r: list_transform(keep, lambda i: r[i])) AS rows FROM k)
"""


@query("tbl_clean_grid", f"WITH {_SQL_CLEAN} SELECT l_orderkey, {_SQL_SHOWN.format('rows')} AS grid FROM cg")
def tbl_clean_grid(spark, sf_dir):
    return grids(spark, sf_dir).select("l_orderkey", _shown(G.clean_grid(F.col("rows"))).alias("grid"))


_SQL_FILLED = "len(list_filter(r, lambda c: trim(c) <> ''))"
_SQL_FILL = f"list_sum(list_transform(rows, lambda r: {_SQL_FILLED})) / (len(rows) * len(rows[1]))"
_SQL_SPLITS = "(len(list_filter(rows, lambda r: len(list_filter(range(1, len(r)), lambda i: regexp_matches(rtrim(r[i]), '\\p{L}$') AND regexp_matches(ltrim(r[i + 1]), '^\\p{Ll}'))) > 0)) > len(rows) * 0.30)"
_SQL_PROSE = "(len(list_filter(flatten(rows), lambda c: length(c) > 55 AND regexp_matches(c, '[.;:]'))) > len(rows) * 0.5)"


@query("tbl_splits_words", f"WITH {_SQL_CLEAN} SELECT l_orderkey, {_SQL_SPLITS} AS splits FROM cg")
def tbl_splits_words(spark, sf_dir):
    return grids(spark, sf_dir).select("l_orderkey", G.clean_grid(F.col("rows")).alias("rows")).select("l_orderkey", G.splits_words(F.col("rows")).alias("splits"))


@query("tbl_prose", f"WITH {_SQL_CLEAN} SELECT l_orderkey, {_SQL_PROSE} AS prose FROM cg")
def tbl_prose(spark, sf_dir):
    return grids(spark, sf_dir).select("l_orderkey", G.clean_grid(F.col("rows")).alias("rows")).select("l_orderkey", G.is_prose(F.col("rows")).alias("prose"))


@query(
    "tbl_quality",
    f"""WITH {_SQL_CLEAN}
SELECT l_orderkey, round(CASE WHEN len(rows) >= 2 AND len(rows[1]) >= 2 AND {_SQL_FILL} >= 0.30 AND NOT {_SQL_SPLITS} AND NOT {_SQL_PROSE}
  THEN least(1.0, {_SQL_FILL} * 0.6 + len(list_filter(rows, lambda r: {_SQL_FILLED} >= 2)) / len(rows) * 0.4) ELSE 0.0 END, 6)::DOUBLE AS quality FROM cg""",
)
def tbl_quality(spark, sf_dir):
    return grids(spark, sf_dir).select("l_orderkey", G.clean_grid(F.col("rows")).alias("rows")).select("l_orderkey", F.round(G.quality(F.col("rows")), 6).alias("quality"))


@query(
    "tbl_header",
    f"""WITH g AS ({_GRID}), f AS (SELECT l_orderkey, len(rows) AS n, rows[1] AS a, rows[2] AS b FROM g)
SELECT l_orderkey, n >= 2 AND len(list_filter(a, lambda c: trim(c) <> '')) >= greatest(2.0, len(a) * 0.6) AND len(list_filter(a, lambda c: regexp_matches(regexp_replace(trim(c), '[,.]', '', 'g'), '^\\p{{N}}+$'))) <= len(a) * 0.3 AS header,
  n >= 3 AND len(list_filter(b, lambda c: trim(c) <> '')) >= greatest(2.0, len(b) * 0.6) AND len(list_filter(b, lambda c: regexp_matches(regexp_replace(trim(c), '[,.]', '', 'g'), '^\\p{{N}}+$'))) <= len(b) * 0.3 AS header_below FROM f""",
)
def tbl_header(spark, sf_dir):
    below = F.slice("rows", 2, F.size("rows") - 1)
    return grids(spark, sf_dir).select("l_orderkey", G.looks_like_header(F.col("rows")).alias("header"), G.looks_like_header(below).alias("header_below"))


_RAGGED = "list_transform(rows, lambda r, i: r[1:1 + (i + l_orderkey) % 5])"


@query("tbl_normalize", f"WITH g AS ({_GRID}), r AS (SELECT l_orderkey, {_RAGGED} AS rows FROM g), n AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS w FROM r) SELECT l_orderkey, {_SQL_SHOWN.format(chr(40) + 'list_transform(rows, lambda r: list_concat(r, list_transform(range(w - len(r)), lambda i: chr(8709)))))')} AS grid FROM n".replace("chr(8709)", "''"))
def tbl_normalize(spark, sf_dir):
    ragged = F.transform("rows", lambda r, i: F.slice(r, F.lit(1), (F.lit(1) + (i + 1 + F.col("l_orderkey")) % 5).cast("int")))
    return grids(spark, sf_dir).select("l_orderkey", ragged.alias("rows")).select("l_orderkey", _shown(G.normalized(F.col("rows"))).alias("grid"))


_SQL_MD_LINE = "'| ' || array_to_string(list_transform({}, lambda c: CASE WHEN trim(replace(replace(replace(c, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>')) = '' THEN ' ' ELSE trim(replace(replace(replace(c, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>')) END), ' | ') || ' |'"


@query(
    "tbl_markdown",
    f"""WITH g AS ({_GRID}), h AS (SELECT *, l_orderkey % 3 <> 0 AND len(rows) > 1 AS headed FROM g)
SELECT l_orderkey, array_to_string(list_concat([{_SQL_MD_LINE.format("CASE WHEN headed THEN rows[1] ELSE list_transform(rows[1], lambda x: '') END")}, '|---|---|---|---|---|'],
  list_transform(CASE WHEN headed THEN rows[2:] ELSE rows END, lambda r: {_SQL_MD_LINE.format('r')})), chr(10)) AS md FROM h""",
)
def tbl_markdown(spark, sf_dir):
    return grids(spark, sf_dir).select("l_orderkey", G.to_markdown(F.col("rows"), F.col("l_orderkey") % 3 != 0).alias("md"))


@query("tbl_autosize", f"WITH g AS ({_GRID}) SELECT l_orderkey, array_to_string(list_transform(range(1, 6), lambda i: greatest(8, list_max(list_transform(rows[1:200], lambda r: least(length(r[i]), 60)))) + 2), ',') AS widths FROM g")
def tbl_autosize(spark, sf_dir):
    return grids(spark, sf_dir).select("l_orderkey", F.array_join(F.transform(G.widths(F.col("rows")), lambda x: x.cast("string")), ",").alias("widths"))


@query(
    "tbl_sheet_index",
    f"""WITH g AS ({_GRID})
SELECT l_orderkey, 'p' || (1 + l_orderkey % 7) || '_t' || row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY l_orderkey) AS sheet, (1 + l_orderkey % 7)::BIGINT AS page, len(rows)::BIGINT AS n_rows, 5::BIGINT AS n_columns FROM g""",
)
def tbl_sheet_index(spark, sf_dir):
    page = 1 + F.col("l_orderkey") % 7
    # Sheets are numbered within their page.
    t = F.row_number().over(Window.partitionBy(page).orderBy("l_orderkey"))
    made = grids(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), page.cast("string"), F.lit("_t"), t.cast("string")))
    return made.select("l_orderkey", N.sheet_base(F.col("name")).alias("sheet"), page.cast("long").alias("page"), F.size("rows").cast("long").alias("n_rows"), G.n_cols(F.col("rows")).cast("long").alias("n_columns"))


# ---- filters -----------------------------------------------------------------
_SPECS = ("", "1-3", "2-", "-2", "5-3", "1,3,9", "9-12", " 1 - 2 , 4")


@query(
    "page_range",
    f"""
WITH c AS (SELECT conv_id, max(turn) + 1 AS total, {list(_SPECS)}[conv_id % {len(_SPECS)} + 1] AS spec FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, total, unnest(string_split(replace(spec, ' ', ''), ',')) AS x FROM c),
b AS (SELECT conv_id, total, CASE WHEN contains(x, '-') THEN coalesce(TRY_CAST(split_part(x, '-', 1) AS BIGINT), 1) ELSE TRY_CAST(x AS BIGINT) END AS a,
  CASE WHEN contains(x, '-') THEN coalesce(TRY_CAST(split_part(x, '-', 2) AS BIGINT), total) ELSE TRY_CAST(x AS BIGINT) END AS z FROM k WHERE x <> ''),
p AS (SELECT DISTINCT conv_id, unnest(range(greatest(1, least(a, z)), least(total, greatest(a, z)) + 1)) AS page FROM b),
every AS (SELECT conv_id, unnest(range(1, total + 1)) AS page FROM c WHERE conv_id NOT IN (SELECT conv_id FROM p))
SELECT * FROM p UNION ALL SELECT * FROM every""",
)
def page_range(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("total"))
    spec = F.element_at(F.array(*(F.lit(x) for x in _SPECS)), (F.col("conv_id") % len(_SPECS) + 1).cast("int"))
    return c.select("conv_id", F.explode(N.selected_pages(spec, F.col("total"))).alias("page")).select("conv_id", F.col("page").cast("long").alias("page"))


_SQL_USABLE = f"length(regexp_replace(text, '[\\s]', '', 'g')) >= 60 AND NOT (length(text) >= 40 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(text), 1) < 0.35)"


def usable(text, threshold: int = 60):
    return (F.length(F.regexp_replace(text, r"\s", "")) >= threshold) & ~looks_like_garbage(text)


@query("page_usable_text", f"SELECT conv_id, turn, {_SQL_USABLE} AS usable FROM conversations")
def page_usable_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", usable(F.col("text")).alias("usable"))


@query(
    "ocr_mode_split",
    f"SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 OR (conv_id % 3 = 1 AND {_SQL_USABLE}) THEN 'text' WHEN conv_id % 2 = 0 THEN 'empty' ELSE 'ocr' END AS source FROM conversations",
)
def ocr_mode_split(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("never"), F.lit("auto"), F.lit("always")), (F.col("conv_id") % 3 + 1).cast("int"))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", (((mode == "never") | ((mode == "auto") & usable(F.col("text"))))).alias("native"), (F.col("conv_id") % 2 == 1).alias("engine"))
    # Two filtered branches: what costs an OCR run is never evaluated for native pages.
    native = pages.where("native").select("conv_id", "turn", F.lit("text").alias("source"))
    scanned = pages.where("not native").select("conv_id", "turn", F.when(F.col("engine"), "ocr").otherwise("empty").alias("source"))
    return native.unionByName(scanned)


@query("dpi_cap", "SELECT p_partkey, CASE WHEN px <= 40000000 THEN 300 ELSE greatest(120, floor(300 * sqrt(40000000.0 / px))) END::INTEGER AS dpi FROM (SELECT p_partkey, (p_size * 100.0 / 72 * 300) * (p_size * 140.0 / 72 * 300) AS px FROM part)")
def dpi_cap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.capped_dpi(F.col("p_size") * 100.0, F.col("p_size") * 140.0, F.lit(300)).alias("dpi"))


@query(
    "image_dedup",
    """SELECT page, n_kept, pixels FROM (SELECT page, count(*) AS n_kept, sum(w * h)::BIGINT AS pixels FROM (
  SELECT page, w, h, row_number() OVER (PARTITION BY page, w, h, x, y ORDER BY p_partkey) AS rn FROM (
    SELECT p_partkey, p_partkey % 50 AS page, p_size * 4 AS w, (p_size + p_partkey % 3) * 3 AS h, p_partkey % 4 AS x, p_size % 5 AS y FROM part) WHERE w >= 64 AND h >= 64) WHERE rn = 1 GROUP BY page)""",
)
def image_dedup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("page"), (F.col("p_size") * 4).alias("w"), ((F.col("p_size") + F.col("p_partkey") % 3) * 3).alias("h"), (F.col("p_partkey") % 4).alias("x"), (F.col("p_size") % 5).alias("y"))
    kept = part.where("w >= 64 and h >= 64").dropDuplicates(["page", "w", "h", "x", "y"])
    return kept.groupBy("page").agg(F.count("*").alias("n_kept"), F.sum(F.col("w") * F.col("h")).alias("pixels"))


_TSV_ROWS = "concat_ws(chr(9), CASE WHEN p_partkey % 9 = 0 THEN 4 ELSE 5 END, 1, 1, 1, 1, p_partkey, p_size, p_size * 2, 30, 10, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey % 100 END, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_brand END)"


def _tsv_pages(spark, sf_dir):
    k = F.col("p_partkey")
    row = F.concat_ws("\t", F.when(k % 9 == 0, "4").otherwise("5"), *(F.lit("1") for _ in range(4)), k.cast("string"), F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"), F.lit("30"), F.lit("10"), F.when(k % 7 == 0, "-1").otherwise((k % 100).cast("string")), F.when(k % 13 == 0, " ").otherwise(F.col("p_brand")))
    rows = table(spark, sf_dir, "part").groupBy((k % 20).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), row.alias("row")))).alias("x"))
    return rows.select("doc_id", F.concat(F.lit("\t".join(tsv.COLUMNS) + "\n"), F.array_join(F.transform("x", lambda v: v["row"]), "\n")).alias("tsv"))


@query(
    "tsv_words",
    """WITH w AS (SELECT p_partkey % 20 AS doc_id, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS row_no, p_brand AS text, p_partkey % 100 AS conf, p_size AS l FROM part),
ok AS (SELECT p_partkey % 20 AS doc_id, p_partkey, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS row_no, p_brand AS text, (p_partkey % 100)::DOUBLE AS conf, p_size FROM part)
SELECT doc_id, row_no::BIGINT AS row_no, text, conf, p_size / 2.0 AS x0, (p_size + 30) / 2.0 AS x1 FROM ok WHERE p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0 AND conf >= 40""",
)
def tsv_words(spark, sf_dir):
    return tsv.words(_tsv_pages(spark, sf_dir), scale=2.0).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "text", "conf", "x0", "x1")


@query("tsv_mean_conf", "SELECT p_partkey % 20 AS doc_id, round(coalesce(avg(p_partkey % 100) FILTER (p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0), 0), 6) AS mean_conf FROM part GROUP BY 1")
def tsv_mean_conf(spark, sf_dir):
    return tsv.mean_confidence(_tsv_pages(spark, sf_dir)).select("doc_id", F.round("mean_conf", 6).alias("mean_conf"))


_LANGS = ("spa+eng", "deu", "fra+eng+spa", "", "eng+ita")


@query(
    "ocr_languages",
    f"""SELECT p_partkey, CASE WHEN len(have) = 0 THEN req WHEN len(ok) > 0 THEN array_to_string(ok, '+') WHEN list_contains(have, 'spa') THEN 'spa' WHEN list_contains(have, 'eng') THEN 'eng' ELSE list_min(have) END AS langs FROM (
  SELECT p_partkey, req, have, list_filter(string_split(req, '+'), lambda x: x <> '' AND list_contains(have, x)) AS ok FROM (
    SELECT p_partkey, {list(_LANGS)}[(p_partkey % 5)::INTEGER + 1] AS req, CASE p_partkey % 4 WHEN 0 THEN ['eng', 'spa'] WHEN 1 THEN ['eng'] WHEN 2 THEN ['ita', 'deu'] ELSE []::VARCHAR[] END AS have FROM part))""",
)
def ocr_languages(spark, sf_dir):
    k = F.col("p_partkey")
    installed = F.when(k % 4 == 0, F.array(F.lit("eng"), F.lit("spa"))).when(k % 4 == 1, F.array(F.lit("eng"))).when(k % 4 == 2, F.array(F.lit("ita"), F.lit("deu"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", tsv.resolve_languages(F.element_at(F.array(*(F.lit(x) for x in _LANGS)), (k % 5 + 1).cast("int")), installed).alias("langs"))
