"""Queries of the detectors and of the candidate scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions.text import context
from ..operators import scan as S
from .registry import Registry, sql_collapse, sql_fold, sql_strip, table

query = Registry()

#: Put behind texts by doc_id, so that every detector has something to find and to refuse.
_TAILS = (
    "", " mail a.b-c+d@ex-ample.org or x@y.z.", " iban ES9121000418450200051332 and XX12 3456.", " card 4111 1111 1111 1111 or 4111-1111-1111-1112!",
    " see https://ex.org/a?b=c(d) or www.ex.net/x>y", " host 10.0.255.1 or 10.0.256.1", " NIF 12345678Z, X1234567L", " at 40.41678, -3.70379 now",
)


def tailed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tail = F.element_at(F.array(*(F.lit(x) for x in _TAILS)), (F.col("doc_id") % len(_TAILS) + 1).cast("int"))
    return docs.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


_SQL_TAILED = f"SELECT doc_id, source, coalesce(text, '') || {list(_TAILS)}[(doc_id % {len(_TAILS)})::INTEGER + 1] AS text FROM documents"
_SQL_DIGITS = "regexp_replace(h, '\\D', '', 'g')"
_SQL_LUHN = f"(list_sum(list_transform(string_split(reverse({_SQL_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN (2 * c::INTEGER) // 10 + (2 * c::INTEGER) % 10 ELSE c::INTEGER END)) % 10 = 0)"
_SQL_VALID = {
    "card": f"length({_SQL_DIGITS}) IN (13, 14, 15, 16, 19) AND {_SQL_LUHN}",
    "iban": "length(regexp_replace(h, '\\s', '', 'g')) BETWEEN 15 AND 34",
    "ip": "len(list_filter(string_split(h, '.'), lambda p: p::INTEGER > 255)) = 0",
}
#: Kinds whose pattern needs no look-around, which the oracle's engine lacks.
SQL_KINDS = ("email", "iban", "card", "url", "ip", "id_fiscal", "coord")


def _sql_pattern(kind: str) -> str:
    return D.PATTERNS[kind].replace("'", "''")


def _detector(kind: str) -> None:
    sql = None
    if kind in SQL_KINDS:
        valid = _SQL_VALID.get(kind, "true")
        sql = f"SELECT doc_id, len(hs)::BIGINT AS n_hits, array_to_string(hs, '¦') AS hits FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{_sql_pattern(kind)}'), lambda h: {valid}) AS hs FROM ({_SQL_TAILED}))"
    detector = next(d for d in D.DETECTORS if d.name == kind)

    @query(f"det_{'card_luhn' if kind == 'card' else 'fiscal' if kind == 'id_fiscal' else kind}", sql)
    def run(spark, sf_dir):
        hits = F.filter(F.regexp_extract_all("text", F.lit(detector.pattern), F.lit(0)), detector.valid)
        return tailed(spark, sf_dir).select("doc_id", hits.alias("hs")).select("doc_id", F.size("hs").cast("long").alias("n_hits"), F.array_join("hs", "¦").alias("hits"))


for _kind in D.PATTERNS:
    _detector(_kind)

_WORD = "\\p{L}\\p{M}\\p{Nd}_"
_SQL_PROPER = f"(?:^|[^{_WORD}])((?:[A-ZÁÉÍÓÚÜÑ][{_WORD}.&''-]+[ \\t\\r\\x0b\\x0c]+){{0,3}}[A-ZÁÉÍÓÚÜÑ][{_WORD}.&''-]*[{_WORD}])"


@query("det_proper", f"SELECT doc_id, len(hs)::BIGINT AS n_hits, md5(array_to_string(hs, '¦')) AS hits FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SQL_PROPER}', 1) AS hs FROM documents)")
def det_proper(spark, sf_dir):
    hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(D.unicode(D.PROPER)), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hs")).select("doc_id", F.size("hs").cast("long").alias("n_hits"), F.md5(F.array_join("hs", "¦").cast("binary")).alias("hits"))


@query("det_acronym")
def det_acronym(spark, sf_dir):
    hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(D.unicode(D.ACRONYM)), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hs")).select("doc_id", F.size("hs").cast("long").alias("n_hits"), F.array_join("hs", "¦").alias("hits"))


def _sql_hits(kind: str) -> str:
    """(doc_id, source, kind, s, h, text) with the places of the hits."""
    p = _sql_pattern(kind)
    return f"""SELECT doc_id, source, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, hits[i] AS h, text
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, source, text, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM ({_SQL_TAILED}))) WHERE {_SQL_VALID.get(kind, 'true')}"""


_SQL_CONTEXT = f"CASE WHEN s > 46 THEN '...' ELSE '' END || {sql_collapse('text[greatest(0, s - 46) + 1:least(length(text), s + length(h) + 46)]')} || CASE WHEN s + length(h) + 46 < length(text) THEN '...' ELSE '' END"


@query("det_context", f"SELECT doc_id, s AS start, h AS hit, {_SQL_CONTEXT} AS around FROM ({_sql_hits('email')})")
def det_context(spark, sf_dir):
    email = D.DETECTORS[0]
    rows = tailed(spark, sf_dir).select("doc_id", "text", F.explode(D.matches(F.col("text"), email.pattern)).alias("m"))
    return rows.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.hit").alias("hit"), context(F.col("text"), F.col("m.start"), F.col("m.start") + F.length("m.hit")).alias("around"))


# ---- the scan: a document is a source, a page is one of its texts -------------
def pages_of(spark, sf_dir):
    return tailed(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(F.lit("Corpus of source "), "source", F.lit("\n"), "text").alias("text"))


_SQL_HITS = " UNION ALL ".join(_sql_hits(k) for k in SQL_KINDS)
_SQL_CANDIDATES = f"""
allhits AS ({_SQL_HITS}),
shown AS (SELECT *, regexp_replace({sql_collapse('h')}, '^[ .,;:]+|[ .,;:]+$', '', 'g') AS t, list_position({list(D.PATTERNS)}, kind) AS phase FROM allhits),
keyed AS (SELECT *, {sql_fold('t')} AS key FROM shown WHERE length(t) BETWEEN 3 AND 90),
cand AS (
  SELECT source AS doc, kind, key, min(phase) AS phase, min({{'a': doc_id, 'b': s}}) AS pos, arg_min(t, {{'a': doc_id, 'b': s}}) AS text, count(*) AS n, list_sort(list_distinct(list(doc_id))) AS pages
  FROM keyed GROUP BY source, kind, key
),
heads AS (
  SELECT source AS doc, 'encabezado' AS kind, {sql_fold('line')} AS key, 10 AS phase, min({{'a': doc_id, 'b': i}}) AS pos, arg_min(line, {{'a': doc_id, 'b': i}}) AS text, count(DISTINCT doc_id) AS n, list_sort(list_distinct(list(doc_id))) AS pages
  FROM (SELECT source, doc_id, unnest(e) AS line, generate_subscripts(e, 1)::BIGINT AS i FROM (
    SELECT source, doc_id, list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):]) AS e FROM (
      SELECT source, doc_id, list_filter(list_transform(string_split('Corpus of source ' || source || chr(10) || text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls FROM ({_SQL_TAILED}))))
  WHERE length(line) BETWEEN 6 AND 110 GROUP BY source, {sql_fold('line')}
),
np AS (SELECT source AS doc, count(DISTINCT doc_id) AS n_pages FROM documents GROUP BY source),
every AS (SELECT * FROM cand UNION ALL SELECT heads.* FROM heads JOIN np USING (doc) WHERE n_pages >= 3 AND len(pages) >= greatest(2.0, n_pages * 0.5)),
scored AS (
  SELECT e.*, (CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in S.BASE_SCORE.items())} ELSE {S.OTHER_SCORE} END + least(20, n * 2) + len(pages) / n_pages * 15)::DOUBLE AS score,
    kind IN {S.SUGGESTED} OR (kind = 'encabezado' AND len(pages) >= 3) AS suggested
  FROM every e JOIN np USING (doc)
),
best AS (
  SELECT doc, key, arg_max({{'kind': kind, 'text': text, 'score': score, 'suggested': suggested}}, {{'s': score, 'p': -phase, 'a': -pos.a, 'b': -pos.b}}) AS w, max(n) AS n, list_sort(list_distinct(flatten(list(pages)))) AS pages, min({{'p': phase, 'a': pos.a, 'b': pos.b}}) AS pos
  FROM scored GROUP BY doc, key
),
ranked AS (SELECT doc, key, w.kind AS kind, w.text AS text, n, pages, w.score AS score, w.suggested AS suggested, row_number() OVER (PARTITION BY doc ORDER BY w.score DESC, n DESC, lower(w.text), pos) AS rank FROM best)
"""
_PAGES = "array_to_string(pages, ',')"


def _pages_text():
    return F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")


@query("scan_candidates", f"WITH {_SQL_CANDIDATES} SELECT doc, rank, kind, text, n AS count, {_PAGES} AS pages, round(score, 6) AS score, suggested FROM ranked WHERE rank <= 400")
def scan_candidates(spark, sf_dir):
    found = S.scan(pages_of(spark, sf_dir), SQL_KINDS, names=False)
    return found.select("doc", F.col("rank").cast("long").alias("rank"), "kind", "text", "count", _pages_text().alias("pages"), F.round("score", 6).alias("score"), "suggested")


@query("scan_full")
def scan_full(spark, sf_dir):
    """Names and acronyms too: what the command line shows for review."""
    found = S.scan(pages_of(spark, sf_dir))
    return found.select("doc", F.col("rank").cast("long").alias("rank"), "kind", "text", "count", F.size("pages").cast("long").alias("n_pages"), F.round("score", 6).alias("score"), "suggested")


@query("scan_headers", f"WITH {_SQL_CANDIDATES} SELECT doc, key, text, len(pages)::BIGINT AS n_pages FROM every WHERE kind = 'encabezado'")
def scan_headers(spark, sf_dir):
    return S.repeated_lines(pages_of(spark, sf_dir)).select("doc", "key", "text", F.size("pages").cast("long").alias("n_pages"))


@query("scan_score", f"WITH {_SQL_CANDIDATES} SELECT doc, kind, key, n AS count, round(score, 6) AS score, suggested FROM scored WHERE kind <> 'encabezado'")
def scan_score(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    return S.score(S.gather(S.detector_hits(pages, SQL_KINDS)), pages).select("doc", "kind", "key", "count", F.round("score", 6).alias("score"), "suggested")


@query("scan_dedup", f"WITH {_SQL_CANDIDATES} SELECT doc, key, w.kind AS kind, n AS count, {_PAGES} AS pages FROM best")
def scan_dedup(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    found = S.gather(S.detector_hits(pages, SQL_KINDS))
    found = found.unionByName(S.repeated_lines(pages).select(found.columns))
    return S.one_kind_each(S.score(found, pages)).select("doc", "key", "kind", "count", _pages_text().alias("pages"))


@query("scan_topk", f"WITH {_SQL_CANDIDATES} SELECT doc, rank, kind, text FROM ranked WHERE rank <= 6")
def scan_topk(spark, sf_dir):
    """The six best of each document."""
    return S.scan(pages_of(spark, sf_dir), SQL_KINDS, names=False, n=6).select("doc", F.col("rank").cast("long").alias("rank"), "kind", "text")


@query(
    "scan_merge_docs",
    f"""WITH {_SQL_CANDIDATES} SELECT kind, lower(text) AS key, arg_min(text, {{'d': doc, 'r': rank}}) AS text, sum(n)::BIGINT AS count, count(DISTINCT doc) AS documents, len(list_distinct(flatten(list(pages))))::BIGINT AS n_pages
FROM ranked WHERE rank <= 400 GROUP BY kind, lower(text)""",
)
def scan_merge_docs(spark, sf_dir):
    merged = S.merge_documents(S.scan(pages_of(spark, sf_dir), SQL_KINDS, names=False))
    return merged.select("kind", "key", "text", "count", "documents", F.size("pages").cast("long").alias("n_pages"))
