"""Queries of documents, sinks and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..sinks import render as W
from ..sources import markdown as M
from .layout import _SQL_BLOCKS, geo_blocks
from .registry import Registry, table

query = Registry()

# ---- elements: ten blocks of a document are a page, every fourth page ends in a table --
_SQL_ELEMENTS = f"""{_SQL_BLOCKS},
el AS (SELECT doc_id AS doc, 1 + (block_no - 1) // 10 AS page, block_no AS element_no, kind, level, marker, indent, text FROM blk)"""


def elements_of(spark, sf_dir):
    b = geo_blocks(spark, sf_dir)
    none = F.lit(None)
    return b.select(
        F.col("doc_id").alias("doc"), (F.floor((F.col("block_no") - 1) / 10) + 1).cast("long").alias("page"), F.col("block_no").alias("element_no"), F.lit("block").alias("type"), "kind", "level", "marker",
        F.col("marker").rlike("^[(]?[0-9a-zA-Z]").alias("ordered"), "indent", "text", none.cast("array<array<string>>").alias("rows"), none.cast("boolean").alias("has_header"), none.cast("string").alias("path"), none.cast("string").alias("caption"),
    )


_SQL_HASH = "repeat('#', greatest(1, least(6, CASE WHEN level = 0 THEN 2 ELSE level END))::INTEGER)"
_SQL_BODY = "CASE WHEN marker <> '' AND starts_with(text, marker) THEN ltrim(text[length(marker) + 1:]) ELSE text END"
_SQL_ORDERED = "regexp_matches(marker, '^[(]?[0-9a-zA-Z]')"
_SQL_CHUNK = f"CASE kind WHEN 'heading' THEN {_SQL_HASH} || ' ' || text WHEN 'list_item' THEN repeat('  ', least(indent, 4)::INTEGER) || CASE WHEN {_SQL_ORDERED} THEN '1.' ELSE '-' END || ' ' || {_SQL_BODY} WHEN 'caption' THEN '*' || text || '*' ELSE text END"


@query("doc_counters", f"{_SQL_ELEMENTS} SELECT doc, count(DISTINCT page) AS n_pages, count(*) FILTER (kind = 'heading') AS n_headings, count(*) FILTER (kind = 'list_item') AS n_items, sum(length(text))::BIGINT AS chars FROM el GROUP BY doc")
def doc_counters(spark, sf_dir):
    e = elements_of(spark, sf_dir)
    return e.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.count_if(F.col("kind") == "list_item").alias("n_items"), F.sum(F.length("text")).alias("chars"))


@query("doc_title", f"{_SQL_ELEMENTS} SELECT doc, CASE WHEN f.k = 'heading' AND f.l <= 2 AND length(trim(f.t)) BETWEEN 4 AND 120 THEN trim(f.t) ELSE '' END AS title FROM (SELECT doc, arg_min({{'k': kind, 'l': level, 't': text}}, element_no) AS f FROM el WHERE page <= 2 GROUP BY doc)")
def doc_title(spark, sf_dir):
    first = elements_of(spark, sf_dir).where("page <= 2").groupBy("doc").agg(F.min_by(F.struct("kind", "level", "text"), "element_no").alias("f"))
    fits = (F.col("f.kind") == "heading") & (F.col("f.level") <= 2) & F.length(F.btrim("f.text")).between(4, 120)
    return first.select("doc", F.when(fits, F.btrim("f.text")).otherwise("").alias("title"))


@query("doc_outline", f"{_SQL_ELEMENTS}, h AS (SELECT doc, list({_SQL_HASH} || ' ' || text ORDER BY element_no) AS hs FROM el WHERE kind = 'heading' AND text <> '' GROUP BY doc) SELECT doc, array_to_string(hs[1:60], chr(10)) AS outline, greatest(len(hs) - 60, 0)::BIGINT AS more FROM h")
def doc_outline(spark, sf_dir):
    return W.outline(elements_of(spark, sf_dir)).select("doc", F.array_join("outline", "\n").alias("outline"), "more")


@query(
    "md_render",
    f"""{_SQL_ELEMENTS},
c AS (SELECT *, {_SQL_CHUNK} AS md, kind = 'list_item' AND coalesce(lag(kind = 'list_item') OVER w, false) AS close, row_number() OVER w AS rn FROM el WHERE text <> '' WINDOW w AS (PARTITION BY doc, page ORDER BY element_no)),
p AS (SELECT doc, page, '<!-- pagina ' || page || ' -->' || string_agg(CASE WHEN close AND rn > 1 THEN chr(10) ELSE chr(10) || chr(10) END || md, '' ORDER BY element_no) AS md FROM c GROUP BY doc, page)
SELECT doc, rtrim(string_agg(md, chr(10) || chr(10) ORDER BY page)) || chr(10) AS md FROM p GROUP BY doc""",
)
def md_render(spark, sf_dir):
    return W.documents_md(elements_of(spark, sf_dir))


@query("txt_render", f"{_SQL_ELEMENTS}, p AS (SELECT doc, page, '===== PAGINA ' || page || ' =====' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY element_no) AS t FROM el WHERE text <> '' GROUP BY doc, page) SELECT doc, rtrim(string_agg(t, chr(10) || chr(10) ORDER BY page)) || chr(10) AS txt FROM p GROUP BY doc")
def txt_render(spark, sf_dir):
    return W.documents_txt(elements_of(spark, sf_dir))


_SQL_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SQL_H = "'h' || least(6, greatest(1, least(6, CASE WHEN level = 0 THEN 2 ELSE level END)) + 1)"


@query(
    "html_render",
    f"""{_SQL_ELEMENTS},
t AS (SELECT *, CASE WHEN kind = 'list_item' THEN CASE WHEN {_SQL_ORDERED} THEN 'ol' ELSE 'ul' END END AS tag FROM el WHERE text <> ''),
n AS (SELECT *, coalesce(lag(page) OVER w <> page, true) AS np, tag IS NOT NULL AND (coalesce(lag(page) OVER w <> page, true) OR coalesce(lag(tag) OVER w <> tag, true)) AS op, tag IS NOT NULL AND (coalesce(lead(page) OVER w <> page, true) OR coalesce(lead(tag) OVER w <> tag, true)) AS sh FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, element_no))
SELECT doc, string_agg(CASE WHEN np THEN '<div class=''pagemark''>PAGINA ' || page || '</div>' ELSE '' END || CASE WHEN op THEN '<' || tag || '>' ELSE '' END ||
  CASE WHEN kind = 'heading' THEN '<' || {_SQL_H} || '>' || {_SQL_ESC.format('text')} || '</' || {_SQL_H} || '>' WHEN tag IS NOT NULL THEN '<li>' || {_SQL_ESC.format(_SQL_BODY)} || '</li>'
  WHEN kind = 'caption' THEN '<em class=''caption''>' || {_SQL_ESC.format('text')} || '</em>' ELSE '<p>' || {_SQL_ESC.format('text')} || '</p>' END || CASE WHEN sh THEN '</' || tag || '>' ELSE '' END, '' ORDER BY page, element_no) AS html FROM n GROUP BY doc""",
)
def html_render(spark, sf_dir):
    return W.documents_html(elements_of(spark, sf_dir))


@query("json_doc", f"{_SQL_ELEMENTS}, p AS (SELECT doc, page, list({{'tipo': kind, 'nivel': nullif(level, 0), 'texto': text}} ORDER BY element_no) AS e FROM el GROUP BY doc, page) SELECT doc, to_json({{'doc': doc, 'paginas': list({{'numero': page, 'elementos': e}} ORDER BY page)}})::VARCHAR AS json FROM p GROUP BY doc")
def json_doc(spark, sf_dir):
    return W.documents_json(elements_of(spark, sf_dir))


_PREFIXES = ("# ", "- ", "3) ", "> ", "| a | ", "<!-- ", "", "![x](y)", "```", "---", "**b** ")
_SQL_MD_LINES = f"SELECT doc_id, i AS line_no, CASE WHEN pre IN ('```', '---', '![x](y)') THEN pre ELSE pre || l END AS line FROM (SELECT doc_id, i, ls[i] AS l, {list(_PREFIXES)}[(i % {len(_PREFIXES)})::INTEGER + 1] AS pre FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_SQL_CLASS = "CASE WHEN regexp_matches(line, '^\\s*$') THEN 'blank' " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in M.FORMS if n != "hr") + " ELSE 'paragraph' END"
_SQL_CLASS = _SQL_CLASS.replace("WHEN regexp_matches(line, '^\\s*!", "WHEN regexp_matches(line, '^\\s*(-\\s*){3,}$') OR regexp_matches(line, '^\\s*(\\*\\s*){3,}$') OR regexp_matches(line, '^\\s*(_\\s*){3,}$') THEN 'hr' WHEN regexp_matches(line, '^\\s*!")


@query("md_parse", f"WITH l AS ({_SQL_MD_LINES}), f AS (SELECT *, regexp_matches(line, '{M.FENCE}') AS fence FROM l), o AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM f) SELECT doc_id, line_no, CASE WHEN fence THEN 'fence' WHEN n % 2 = 1 THEN 'code' ELSE {_SQL_CLASS} END AS class, line FROM o")
def md_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    pre = lambda i: F.element_at(F.array(*(F.lit(p) for p in _PREFIXES)), ((i + 1) % len(_PREFIXES) + 1).cast("int"))
    made = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(pre(i).isin("```", "---", "![x](y)"), pre(i)).otherwise(F.concat(pre(i), x))), "\n")
    return M.parse(docs.select("doc_id", made.alias("text"))).select("doc_id", "line_no", "class", "line")


# ---- rasters: an embedding is an image of eight rows -------------------------------
_SQL_PX = "SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.6) * 200)))::BIGINT AS px FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)"
_SQL_OTSU = f"""
p AS ({_SQL_PX}),
hist AS (SELECT vec_id, px, count(*) AS n FROM p GROUP BY ALL),
acc AS (SELECT vec_id, px, sum(n) OVER u AS w, sum(n * px) OVER u AS m, sum(n) OVER (PARTITION BY vec_id) AS wt, sum(n * px) OVER (PARTITION BY vec_id) AS mt FROM hist WINDOW u AS (PARTITION BY vec_id ORDER BY px)),
sig AS (SELECT vec_id, px, CASE WHEN w < wt THEN (mt / wt * (w / wt) - m / wt) * (mt / wt * (w / wt) - m / wt) / ((w / wt) * (1 - w / wt)) ELSE 0.0 END AS s FROM acc),
otsu AS (SELECT vec_id, CASE WHEN max(s) > 0 THEN arg_max(px, {{'s': round(s, 9), 'p': -px}}) ELSE 0 END::BIGINT AS threshold FROM sig GROUP BY vec_id),
inked AS (SELECT p.*, px < threshold AS ink FROM p JOIN otsu USING (vec_id))
"""


def pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where("i < 64")
    px = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.6) * 200)))
    return e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), px.cast("long").alias("px"))


@query("ras_otsu", f"WITH {_SQL_OTSU} SELECT vec_id, threshold FROM otsu")
def ras_otsu(spark, sf_dir):
    return R.otsu(pixels(spark, sf_dir), "vec_id")


@query("ras_profile", f"WITH {_SQL_OTSU} SELECT vec_id, round(var_pop(d), 6) AS score FROM (SELECT vec_id, n - lag(n) OVER (PARTITION BY vec_id ORDER BY y) AS d FROM (SELECT vec_id, y, count(*) FILTER (ink) AS n FROM inked GROUP BY ALL)) GROUP BY vec_id")
def ras_profile(spark, sf_dir):
    return R.profile_score(R.ink(pixels(spark, sf_dir), "vec_id"), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("ras_contrast", f"WITH p AS ({_SQL_PX}), e AS (SELECT vec_id, quantile_cont(px, 0.02) AS lo, quantile_cont(px, 0.98) AS hi FROM p GROUP BY vec_id) SELECT vec_id, y, x, CASE WHEN hi - lo >= 20 THEN floor(round(greatest(0.0, least(255.0, (px - lo) * (255.0::DOUBLE / (hi - lo)))), 6)) ELSE px END::BIGINT AS px FROM p JOIN e USING (vec_id)")
def ras_contrast(spark, sf_dir):
    return R.contrast(pixels(spark, sf_dir), "vec_id").select("vec_id", "y", "x", "px")


@query("ras_opening", f"WITH {_SQL_OTSU}, e AS (SELECT *, count(*) FILTER (ink) OVER w = 3 AS er FROM inked WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT vec_id, y, x, count(*) FILTER (er) OVER w > 0 AS opened FROM e WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def ras_opening(spark, sf_dir):
    return R.opening(R.ink(pixels(spark, sf_dir), "vec_id"), ["vec_id", "y"], "x", 3).select("vec_id", "y", "x", "opened")


_SQL_RUNS = "SELECT vec_id, y, min(x) AS a, max(x) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY vec_id, y ORDER BY x) AS r FROM (SELECT *, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY vec_id, y ORDER BY x) > 1, true) THEN 1 ELSE 0 END AS nw FROM inked WHERE ink)) GROUP BY vec_id, y, r"


@query("ras_bands", f'WITH {_SQL_OTSU}, runs AS ({_SQL_RUNS}) SELECT vec_id, y, r.a AS start, r.b AS "end" FROM (SELECT vec_id, y, arg_max({{\'a\': a, \'b\': b}}, {{\'n\': b - a, \'s\': -a}}) AS r FROM runs GROUP BY vec_id, y)')
def ras_bands(spark, sf_dir):
    return R.longest_run(R.ink(pixels(spark, sf_dir), "vec_id").where("ink"), ["vec_id", "y"], "x", 1)


@query("ras_cluster", "SELECT page, round(avg(v), 6) AS position FROM (SELECT *, sum(nw) OVER (PARTITION BY page ORDER BY v) AS c FROM (SELECT *, CASE WHEN coalesce(v - lag(v) OVER (PARTITION BY page ORDER BY v) > 2, true) THEN 1 ELSE 0 END AS nw FROM (SELECT DISTINCT p_partkey % 40 AS page, p_size * 3.0 + p_partkey % 5 AS v FROM part))) GROUP BY page, c")
def ras_cluster(spark, sf_dir):
    points = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("page"), (F.col("p_size") * 3.0 + F.col("p_partkey") % 5).alias("v")).distinct()
    return R.cluster_positions(points, ["page"], "v", 2.0).select("page", F.round("position", 6).alias("position"))


@query("ras_components")
def ras_components(spark, sf_dir):
    return R.components(R.ink(pixels(spark, sf_dir), "vec_id").where("ink"), "vec_id")


@query("ras_merge_close")
def ras_merge_close(spark, sf_dir):
    """Components as boxes of six points a cell, merged where they are near."""
    box = F.struct((F.col("y0") * 6.0).alias("top0"), (F.col("x0") * 6.0).alias("x0"), (F.col("y0") * 6.0).alias("top"), ((F.col("x1") + 1) * 6.0).alias("x1"), ((F.col("y1") + 1) * 6.0).alias("bottom"), (F.col("cells") * 1.0).alias("ink"))
    listed = ras_components(spark, sf_dir).groupBy("vec_id").agg(F.sort_array(F.collect_list(box)).alias("b"))
    boxes = F.transform("b", lambda b: F.struct(*(b[k].alias(k) for k in ("x0", "top", "x1", "bottom", "ink"))))
    return listed.select("vec_id", F.explode(R.merge_close(boxes, 1.0)).alias("m")).select("vec_id", "m.*")
