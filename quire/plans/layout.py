"""Queries of the layout operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import layout as L
from ..operators import tables as TB
from .registry import Registry, sql_fold, sql_lines, sql_strip, table
from .text import _SQL_BULLETS, _SQL_OPENED, _opened, lines_of

query = Registry()

# ---- words laid out on a grid: 6 points a character, 12 points a line ---------------
_SQL_WORDS = f"""SELECT doc_id, line_no, k AS word_no, parts[k] AS text, 6.0 * o AS x0, 6.0 * (o + length(parts[k])) AS x1, 12.0 * (line_no - 1) AS top, 12.0 * (line_no - 1) + 10 AS bottom
FROM (SELECT *, length(array_to_string(parts[1:k - 1], ' ')) + CASE WHEN k > 1 THEN 1 ELSE 0 END AS o FROM (
  SELECT doc_id, line_no, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, line_no, string_split(line, ' ') AS parts FROM ({sql_lines()})))) WHERE parts[k] <> ''"""


def words_of(spark, sf_dir):
    w = lines_of(spark, sf_dir).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("i", "text"))
    # Where a word starts is the length of what stands before it in its line.
    before = Window.partitionBy("doc_id", "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("o", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where("text <> ''")
    o = F.col("o")
    top = (F.col("line_no") - 1) * F.lit(12.0)
    return w.select("doc_id", "line_no", (F.col("i") + 1).cast("long").alias("word_no"), "text", (o * F.lit(6.0)).alias("x0"), ((o + F.length("text")) * F.lit(6.0)).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


@query("geo_overlap_anti", f"WITH w AS ({_SQL_WORDS}) SELECT doc_id, line_no, word_no FROM w WHERE NOT ((greatest(0, least(x1, 200.0 + doc_id % 300) - greatest(x0, 30.0)) * greatest(0, least(bottom, 58.0) - greatest(top, 17.0))) / greatest((x1 - x0) * (bottom - top), 1e-6) > 0.55)")
def geo_overlap_anti(spark, sf_dir):
    w = words_of(spark, sf_dir)
    boxes = w.select("doc_id").distinct().select(F.col("doc_id").alias("b_doc"), F.lit(30.0).alias("b_x0"), F.lit(17.0).alias("b_top"), (200.0 + F.col("doc_id") % 300).alias("b_x1"), F.lit(58.0).alias("b_bottom"))
    inside = (F.col("doc_id") == F.col("b_doc")) & (G.overlap_ratio(G.box(), G.box("b_")) > 0.55)
    return w.join(boxes, inside, "left_anti").select("doc_id", "line_no", "word_no")


_XS, _YS = (0.0, 120.0, 300.0, 600.0), (0.0, 30.0, 60.0, 120.0)


@query("geo_word_cell", f"WITH w AS ({_SQL_WORDS}) SELECT doc_id, row_no, col_no, count(*) AS words FROM (SELECT doc_id, len(list_filter({list(_YS)}, lambda y: y <= (top + bottom) / 2)) AS row_no, len(list_filter({list(_XS)}, lambda x: x <= (x0 + x1) / 2)) AS col_no, x0, x1, top, bottom FROM w) WHERE row_no BETWEEN 1 AND 3 AND col_no BETWEEN 1 AND 3 GROUP BY ALL")
def geo_word_cell(spark, sf_dir):
    # A word's cell is the number of edges before its centre: no join at all.
    of = lambda edges, c: sum(((c >= e).cast("long") for e in edges), F.lit(0).cast("long"))
    cells = words_of(spark, sf_dir).select("doc_id", of(_YS, G.centre_y(G.box())).alias("row_no"), of(_XS, G.centre_x(G.box())).alias("col_no"))
    return cells.where(F.col("row_no").between(1, 3) & F.col("col_no").between(1, 3)).groupBy("doc_id", "row_no", "col_no").agg(F.count("*").alias("words"))


@query("geo_occupancy", f"WITH w AS ({_SQL_WORDS}) SELECT doc_id, bin, count(*) AS words FROM (SELECT doc_id, unnest(range(a, greatest(a, b) + 1)) AS bin FROM (SELECT doc_id, greatest(0, least(399, floor(x0 / 1.5)::BIGINT)) AS a, greatest(0, least(399, floor(x1 / 1.5)::BIGINT)) AS b FROM w)) GROUP BY ALL")
def geo_occupancy(spark, sf_dir):
    return L.occupancy(words_of(spark, sf_dir), ["doc_id"], F.lit(600.0)).select("doc_id", F.col("bin").cast("long").alias("bin"), "words")


# ---- two columns: even lines on the right, long ones go on at the left of their column -----------------------------
_SQL_TWO = f"SELECT doc_id, text, x + c AS x0, least(x + 6.0 * length(text), 282) + c AS x1, 12.0 * ((line_no - 1) // 2) AS top, 12.0 * ((line_no - 1) // 2) + 10 AS bottom FROM (SELECT *, x0 % 252 AS x, CASE WHEN line_no % 2 = 0 THEN 320 ELSE 0 END AS c FROM ({_SQL_WORDS}))"
_SQL_GUTTERS = f"""
w AS ({_SQL_TWO}),
u AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, least(399, floor(x0 / 1.5)::BIGINT)), greatest(0, least(399, floor(x1 / 1.5)::BIGINT)) + 1)) AS bin FROM w),
g AS (SELECT doc_id, a * 1.5 AS gx0, bin * 1.5 AS gx1 FROM (SELECT doc_id, bin, lag(bin, 1, -1) OVER (PARTITION BY doc_id ORDER BY bin) + 1 AS a FROM u) WHERE bin - a >= 11 AND a > 60 AND bin < 340),
s AS (SELECT doc_id, gx0, gx1, count(*) AS n, count(*) FILTER (x0 < gx1 AND x1 > gx0) AS c, count(*) FILTER (x1 <= gx0) AS nl, count(*) FILTER (x0 >= gx1) AS nr,
  greatest(max(bottom) FILTER (x1 <= gx0) - min(top) FILTER (x1 <= gx0), max(bottom) FILTER (x0 >= gx1) - min(top) FILTER (x0 >= gx1)) AS span, greatest(max(bottom) - min(top), 1) AS h FROM w JOIN g USING (doc_id) GROUP BY ALL),
ok AS (SELECT doc_id, (gx0 + gx1) / 2 AS cut, row_number() OVER (PARTITION BY doc_id ORDER BY gx0) AS no FROM s WHERE n >= 40 AND c <= greatest(2, n * 0.04) AND nl >= 15 AND nr >= 15 AND span / h >= 0.55),
cuts AS (SELECT doc_id, list(cut ORDER BY cut) AS cuts FROM ok WHERE no <= 2 GROUP BY doc_id)
"""


def two_columns(spark, sf_dir):
    right, row = F.when(F.col("line_no") % 2 == 0, 320.0).otherwise(0.0), F.floor((F.col("line_no") - 1) / 2) * F.lit(12.0)
    x0, x1 = F.col("x0") % 252, F.least(F.col("x0") % 252 + F.length("text") * 6.0, F.lit(282.0))
    return words_of(spark, sf_dir).select("doc_id", "text", (x0 + right).alias("x0"), (x1 + right).alias("x1"), row.alias("top"), (row + 10).alias("bottom"))


@query("geo_columns", f"WITH {_SQL_GUTTERS} SELECT doc_id, column_no, count(*) AS words FROM (SELECT doc_id, coalesce(len(list_filter(cuts, lambda c: c <= (x0 + x1) / 2)), 0) AS column_no FROM w LEFT JOIN cuts USING (doc_id)) GROUP BY ALL")
def geo_columns(spark, sf_dir):
    assigned = L.assign_columns(two_columns(spark, sf_dir), ["doc_id"], 600.0)
    return assigned.groupBy("doc_id", F.col("column_no").cast("long").alias("column_no")).agg(F.count("*").alias("words"))


@query("geo_column_assign", "SELECT p_partkey, coalesce(CASE WHEN cx < 200 THEN NULL WHEN cx < 400 THEN 1 WHEN cx < 600 THEN 2 END, 0)::BIGINT AS column_no FROM (SELECT p_partkey, p_size * 14.0 + p_partkey % 7 AS cx FROM part)")
def geo_column_assign(spark, sf_dir):
    """An element's column by its centre; outside all of them it goes with the first."""
    columns = spark.createDataFrame([(0, 0.0, 200.0), (1, 200.0, 400.0), (2, 400.0, 600.0)], "column_no long, lo double, hi double")
    e = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 14.0 + F.col("p_partkey") % 7).alias("cx"))
    return e.join(F.broadcast(columns), (F.col("cx") >= F.col("lo")) & (F.col("cx") < F.col("hi")), "left").select("p_partkey", F.coalesce("column_no", F.lit(0)).cast("long").alias("column_no"))


@query("geo_bullets", f"WITH b AS (SELECT doc_id, line_no, length(line) % 30 * 1.0 AS x, CASE WHEN line_no % 3 = 0 THEN 'o' ELSE left(line, 1) END AS f FROM ({sql_lines()})), c AS (SELECT * FROM b WHERE length(f) = 1 AND contains('{L.BULLET_LETTERS}', f)) SELECT doc_id, line_no FROM (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id ORDER BY x RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS n FROM c) WHERE n >= 2")
def geo_bullets(spark, sf_dir):
    lines = lines_of(spark, sf_dir).select("doc_id", "line_no", (F.length("line") % 30 * 1.0).alias("first_x0"), F.when(F.col("line_no") % 3 == 0, "o").otherwise(F.left("line", F.lit(1))).alias("first_word"), F.lit(3.0).alias("gap"), F.lit(10.0).alias("height"))
    return L.bullet_lines(lines, ["doc_id"]).select("doc_id", "line_no")


@query("geo_lines")
def geo_lines(spark, sf_dir):
    """Words of a conversation's turns, their centres shifted a little: the fold must give the lines back."""
    w = words_of(spark, sf_dir).withColumn("shift", (F.col("word_no") % 3) * 0.4)
    w = w.select("doc_id", "text", "x0", "x1", (F.col("top") + F.col("shift")).alias("top"), (F.col("bottom") + F.col("shift")).alias("bottom"))
    return L.group_lines(w, ["doc_id"]).select("doc_id", "line_no", "text", F.round("top", 3).alias("top"), F.round("bottom", 3).alias("bottom"))


# ---- lines with sizes: the first one large and bold, gaps after every fifth ----------
_SQL_STYLED = f"""SELECT doc_id, line_no, CASE WHEN line_no % 9 = 0 THEN upper(replace(t, 'ß', 'ss')) ELSE t END AS text, CASE WHEN line_no = 1 THEN 14.0 WHEN line_no % 9 = 0 THEN 11.5 ELSE 10.0 END AS size,
  CASE WHEN line_no = 1 OR line_no % 7 = 0 THEN 1.0 ELSE 0.0 END AS bold_ratio, 18.0 * (line_no % 3) AS x0, 18.0 * (line_no % 3) + least(540.0, 6.0 * length(t)) AS x1,
  13.0 * line_no + 9 * (line_no // 5) AS top, 13.0 * line_no + 9 * (line_no // 5) + 10 AS bottom FROM (SELECT doc_id, line_no, {_SQL_OPENED} AS t FROM ({sql_lines()}))"""


def styled(spark, sf_dir):
    n, t = F.col("line_no"), F.col("t")
    base = lines_of(spark, sf_dir).select("doc_id", "line_no", _opened(F.col("line"), n).alias("t"))
    top, x0 = n * 13.0 + F.floor(n / 5) * 9, (n % 3) * 18.0
    return base.select(
        "doc_id", "line_no", F.when(n % 9 == 0, F.upper(F.replace(t, F.lit("ß"), F.lit("ss")))).otherwise(t).alias("text"), F.when(n == 1, 14.0).when(n % 9 == 0, 11.5).otherwise(10.0).alias("size"),
        F.when((n == 1) | (n % 7 == 0), 1.0).otherwise(0.0).alias("bold_ratio"), x0.alias("x0"), (x0 + F.least(F.lit(540.0), F.length(t) * 6.0)).alias("x1"), top.alias("top"), (top + 10).alias("bottom"),
    )


_SQL_BODY = f"""
st AS ({_SQL_STYLED}),
smp AS (SELECT doc_id, size, unnest(range(length(text) // 12)) FROM st WHERE length(text) >= 12),
body AS (SELECT doc_id, coalesce(b, a, 10.0) AS body FROM (SELECT doc_id, quantile_cont(size, 0.5) AS a FROM st GROUP BY doc_id) LEFT JOIN (SELECT doc_id, quantile_cont(size, 0.5) AS b FROM smp GROUP BY doc_id) USING (doc_id)),
gap AS (SELECT doc_id, coalesce(quantile_cont(CASE WHEN g > -2 AND g < 60 THEN g END, 0.5), 2.0) AS gap FROM (SELECT doc_id, top - lag(bottom) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM st) GROUP BY doc_id)
"""
_NUM = f"nullif(regexp_extract(t, '{T.HEADING_NUMBER}', 1), '')"
_SQL_HEADED = f"""
r0 AS (SELECT st.*, {sql_strip('text')} AS t, body, gap FROM st JOIN body USING (doc_id) JOIN gap USING (doc_id)),
r1 AS (SELECT *, size / body AS ratio, (x1 - x0) / 600 < 0.85 AND length(t) <= 120 AS short, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS nl, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS nu, {_NUM} AS num FROM r0 WHERE t <> ''),
r2 AS (SELECT *, length(t) <= 160 AND NOT (regexp_matches(t, '[.;,]$') AND length(t) > 60) AND ((ratio >= 1.18 AND short) OR (bold_ratio > 0.65 AND short AND ratio >= 0.98) OR (num IS NOT NULL AND short AND (ratio >= 1.05 OR bold_ratio > 0.4))
  OR (nl > 0 AND nu / greatest(nl, 1) > 0.85 AND length(t) BETWEEN 3 AND 80 AND ratio >= 1.02)) AS heading FROM r1),
sz AS (SELECT doc_id, list_reverse_sort(list_distinct(list(round(size, 1)) FILTER (heading))) AS sizes FROM r2 GROUP BY doc_id),
r3 AS (SELECT r2.*, CASE WHEN heading THEN CASE WHEN num IS NOT NULL THEN least(6, length(num) - length(replace(num, '.', '')) + 2)
  ELSE coalesce(least(6, list_min(list_filter(list_transform(sizes, lambda s, i: CASE WHEN abs(size - s) < 0.35 THEN i END), lambda x: x IS NOT NULL))), CASE WHEN ratio >= 1.6 THEN 1 WHEN ratio >= 1.35 THEN 2 WHEN ratio >= 1.15 THEN 3 ELSE 4 END) END END AS level FROM r2 JOIN sz USING (doc_id))
"""


@query("geo_body_size", f"WITH {_SQL_BODY} SELECT doc_id, body, gap FROM body JOIN gap USING (doc_id)")
def geo_body_size(spark, sf_dir):
    lines = styled(spark, sf_dir)
    return L.body_size(lines, ["doc_id"], 1).join(L.median_gap(lines, ["doc_id"], 1), "doc_id")


_SQL_BLOCKS = f"""WITH {_SQL_BODY}, {_SQL_HEADED},
m AS (SELECT *, CASE WHEN NOT heading THEN CASE WHEN regexp_extract(t, '^([{_SQL_BULLETS}])\\s+', 1) <> '' THEN regexp_extract(t, '^([{_SQL_BULLETS}])\\s+', 1)
  WHEN regexp_extract(t, '{T.ORDERED}', 0) <> '' AND length(regexp_extract(t, '{T.ORDERED}', 1)) <= 3 THEN {sql_strip(f"regexp_extract(t, '{T.ORDERED}', 0)")} END END AS marker,
  min(x0) OVER (PARTITION BY doc_id) AS lft, lag(heading) OVER w AS ph, lag(level) OVER w AS pl, lag(bottom) OVER w AS pb, lag(size) OVER w AS ps, lag(x0) OVER w AS px, lag(text) OVER w AS pt FROM r3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
o AS (SELECT *, coalesce(CASE WHEN heading THEN NOT (ph AND pl = level AND top - pb < greatest(size, 6) * 0.9 AND abs(size - ps) < 0.4)
  ELSE marker IS NOT NULL OR ph OR top - pb > greatest(gap * 1.8, gap + 3) OR (x0 - px > 10 AND regexp_matches(rtrim(pt), '[.:?!]$')) END, true) AS opens FROM m),
b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block_no FROM o),
a AS (SELECT doc_id, block_no, arg_min({{'h': heading, 'l': level, 'm': marker, 'x': x0, 'e': lft}}, line_no) AS f, string_agg(t, ' ' ORDER BY line_no) AS text, min(top) AS top FROM b GROUP BY doc_id, block_no),
blk AS (SELECT doc_id, block_no, CASE WHEN f.h THEN 'heading' WHEN f.m IS NOT NULL THEN 'list_item' WHEN regexp_matches({sql_fold('text')}, '{T.CAPTION}') AND length(text) < 200 THEN 'caption' ELSE 'paragraph' END AS kind,
  coalesce(f.l, 0)::BIGINT AS level, coalesce(f.m, '') AS marker, CASE WHEN f.m IS NOT NULL THEN floor(greatest(0, f.x - f.e) / 18) ELSE 0 END::BIGINT AS indent, text, top FROM a)
"""


@query("geo_blocks", f"{_SQL_BLOCKS} SELECT doc_id, block_no, kind, level, marker, indent, text, top FROM blk")
def geo_blocks(spark, sf_dir):
    b = L.blocks(styled(spark, sf_dir), ["doc_id"], 600.0, 1)
    return b.select("doc_id", "block_no", "kind", F.col("level").cast("long").alias("level"), "marker", F.col("indent").cast("long").alias("indent"), "text", "top")


@query("geo_heading_level", f"{_SQL_BLOCKS} SELECT kind, level, count(*) AS blocks FROM blk GROUP BY ALL")
def geo_heading_level(spark, sf_dir):
    return geo_blocks(spark, sf_dir).groupBy("kind", "level").agg(F.count("*").alias("blocks"))


_ELEMENTS = "SELECT p_partkey % 100 AS page, p_partkey, p_partkey % 2 AS column_no, CASE p_partkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'table' ELSE 'image' END AS type, p_size * 10.0 AS top, (p_size % 4) * 5.0 AS x0 FROM part"


@query("geo_reading_order", f"SELECT page, p_partkey, row_number() OVER (PARTITION BY page ORDER BY column_no, round(top, 1), round(x0, 1), CASE type WHEN 'block' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, p_partkey) AS element_no FROM ({_ELEMENTS})")
def geo_reading_order(spark, sf_dir):
    k = F.col("p_partkey")
    e = table(spark, sf_dir, "part").select((k % 100).alias("page"), k, (k % 2).alias("column_no"), F.when(k % 3 == 0, "block").when(k % 3 == 1, "table").otherwise("image").alias("type"), (F.col("p_size") * 10.0).alias("top"), ((F.col("p_size") % 4) * 5.0).alias("x0"), k.alias("ordinal"))
    return L.reading_order(e, ["page"]).select("page", "p_partkey", "element_no")


_SQL_WS = """WITH l AS (SELECT p_partkey % 50 AS page, p_partkey AS line_no, trunc(p_partkey / 50) * CASE WHEN p_partkey % 50 > 25 THEN 16.0 ELSE 13.0 END AS top,
  list_filter([{'t': p_partkey::VARCHAR, 'x': 0.0}, {'t': p_brand, 'x': 150.0}, {'t': CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END, 'x': 320.0}], lambda w: w.t <> '') AS ws FROM part),
w0 AS (SELECT page, line_no, top, unnest(range(1, len(ws) + 1)) AS k, ws FROM l),
w AS (SELECT page, line_no, top, k, ws[k].t AS t, ws[k].x::DOUBLE AS x0, ws[k].x + length(ws[k].t) * 5.0::DOUBLE AS x1 FROM w0),
g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, line_no ORDER BY k) AS gap FROM w),
f AS (SELECT page, line_no, any_value(top) AS top, any_value(top) + 10 AS bottom, max(x1) AS x1, count(*) >= 2 AND coalesce(max(gap), 0) >= quantile_cont((x1 - x0) / greatest(length(t), 1), 0.5) * 1.4 * 2.2 AS fits FROM g GROUP BY page, line_no),
b AS (SELECT *, NOT fits OR coalesce(top - lag(bottom) OVER o > greatest(lag(bottom) OVER o - lag(top) OVER o, 6) * 2.2, true) OR NOT coalesce(lag(fits) OVER o, false) AS br FROM f WINDOW o AS (PARTITION BY page ORDER BY line_no)),
r AS (SELECT page, line_no, x1, sum(br::INT) OVER (PARTITION BY page ORDER BY line_no)::BIGINT AS run_no, fits FROM b),
run AS (SELECT page, run_no, count(*) AS n, greatest(max(x1), 1) / 300 AS step FROM r WHERE fits GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT page, run_no, n, step, line_no, k, t, x0, x1, greatest(0, least(299, floor(x0 / step)))::BIGINT AS lo, greatest(0, least(299, floor(x1 / step)))::BIGINT AS hi FROM run JOIN (SELECT page, line_no, run_no FROM r WHERE fits) USING (page, run_no) JOIN w USING (page, line_no)),
u AS (SELECT DISTINCT page, run_no, step, unnest(range(lo, greatest(lo, hi) + 1)) AS bin FROM c),
s AS (SELECT page, run_no, list((a + 1 + bin) / 2 * step) AS cuts FROM (SELECT *, lag(bin) OVER (PARTITION BY page, run_no ORDER BY bin) AS a FROM u) WHERE bin - a - 1 >= 3 GROUP BY ALL),
cell AS (SELECT page, run_no, any_value(n) AS n, line_no, len(list_filter(cuts, lambda x: x <= (x0 + x1) / 2)) AS col, any_value(len(cuts)) + 1 AS width, string_agg(t, ' ' ORDER BY k) AS t FROM c JOIN s USING (page, run_no) GROUP BY page, run_no, line_no, col),
by_line AS (SELECT page, run_no, count(*) FILTER (k >= 2) AS multi FROM (SELECT page, run_no, line_no, count(*) AS k FROM cell GROUP BY ALL) GROUP BY ALL),
by_col AS (SELECT page, run_no, min(k) AS least, count(*) AS cols FROM (SELECT page, run_no, col, count(*) AS k FROM cell GROUP BY ALL) GROUP BY ALL),
whole AS (SELECT page, run_no, any_value(n) AS n, any_value(width) AS width, count(*) AS filled, count(*) FILTER (length(t) > 55 AND regexp_matches(t, '[.;:]')) AS prose FROM cell GROUP BY ALL)
SELECT page, run_no, n AS n_rows, width::BIGINT AS n_columns, round(filled / (n * width), 3) AS confidence FROM whole JOIN by_line USING (page, run_no) JOIN by_col USING (page, run_no)
WHERE multi >= n * 0.7 AND multi >= 2 AND cols = width AND least >= n * 0.6 AND prose <= n * 0.5 AND filled / (n * width) >= 0.55"""


@query("geo_ws_tables", _SQL_WS)
def geo_ws_tables(spark, sf_dir):
    """Three cells in a row of wide gaps, runs of lines by part brand."""
    k = F.col("p_partkey")
    cells = [(F.col("p_partkey").cast("string"), F.lit(0.0)), (F.col("p_brand"), F.lit(150.0)), (F.when(k % 5 == 0, "").otherwise(F.col("p_type")), F.lit(320.0))]
    words = F.filter(F.array(*(F.struct(t.alias("text"), x.alias("x0"), (x + F.length(t) * 5.0).alias("x1")) for t, x in cells)), lambda w: w["text"] != "")
    top = (k / 50).cast("int") * F.when(k % 50 > 25, 16.0).otherwise(13.0)
    lines = table(spark, sf_dir, "part").select((k % 50).alias("page"), k.alias("line_no"), words.alias("words"), F.lit(0.0).alias("x0"), top.alias("top"), F.array_max(F.transform(words, lambda w: w["x1"])).alias("x1"), (top + 10).alias("bottom"))
    found = TB.whitespace_tables(lines, ["page"])
    return found.select("page", F.col("run_no").cast("long").alias("run_no"), F.size("rows").cast("long").alias("n_rows"), F.size(F.get("rows", F.lit(0))).cast("long").alias("n_columns"), "confidence")
