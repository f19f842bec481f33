"""Queries of redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import redact as R
from . import scan as P
from .registry import Registry, sql_fold, table
from .tables import _SQL_SHOWN, _shown

query = Registry()

#: Detectors in the order in which the command line applies them.
KINDS = tuple(sorted(P.SQL_KINDS))
_HASHED = f"'[REF:' || upper(left(sha256({sql_fold('h')}), 6)) || ']'"


def _sql_scrubbed(token: str, source: str = P._SQL_TAILED, kinds=KINDS) -> str:
    """Texts of source(doc_id, text) with the rules applied one after the other; token is SQL over the hit h."""
    steps, before = [], f"(SELECT doc_id, text FROM ({source}))"
    for k in kinds:
        p, valid = P._sql_pattern(k), P._SQL_VALID.get(k, "true")
        # The hits are written first, so that the inner lambdas don't mix.
        written = f"list_transform(regexp_extract_all(text, '{p}'), lambda h: CASE WHEN {valid} THEN {token} ELSE h END)"
        steps.append(f"s_{k} AS (SELECT doc_id, array_to_string(list_transform(g, lambda x, i: x || coalesce(w[i], '')), '') AS text FROM (SELECT doc_id, regexp_split_to_array(text, '{p}') AS g, {written} AS w FROM {before}))")
        before = f"s_{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, text FROM {before}"


_DOT = "CASE WHEN h LIKE '%.' THEN '.' ELSE '' END"


def _scrubbed(style):
    def run(spark, sf_dir):
        rules = R.build_rules(detectors=KINDS)
        return P.tailed(spark, sf_dir).select("doc_id", R.scrub(F.col("text"), rules, style).alias("text"))

    return run


query("red_mask", _sql_scrubbed(f"'{R.MASK}' || {_DOT}"))(_scrubbed("mask"))
query("red_hash", _sql_scrubbed(f"{_HASHED} || {_DOT}"))(_scrubbed("hash"))
query("red_remove", _sql_scrubbed("''"))(_scrubbed("remove"))

_ALL = ("card", "coord", "email", "iban", "id_fiscal", "ip", "phone", "serial", "url")


@query("red_label")
def red_label(spark, sf_dir):
    """A document is a source, its pages are its texts."""
    pages = P.tailed(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    labelled, _ = R.label(pages, R.build_rules(terms=("thereou", "de la"), detectors=_ALL))
    return labelled


_REPORTED = ("card", "email", "ip")
_SQL_REPORT = f"""
WITH hits AS ({' UNION ALL '.join(f"SELECT *, {i} AS rule FROM ({P._sql_hits(k)})" for i, k in enumerate(_REPORTED))}),
c AS (SELECT source AS doc, {sql_fold('h')} AS canon, h, kind, {{'p': doc_id, 'r': rule, 's': s}} AS pos FROM hits),
e AS (SELECT doc, canon, arg_min(h, pos) AS surface, arg_min(kind, pos) AS kind, count(*) AS n, min(pos) AS pos FROM c GROUP BY doc, canon),
l AS (SELECT *, '[' || upper(kind) || '_' || row_number() OVER (PARTITION BY doc ORDER BY pos) || ']' AS label FROM e)
SELECT doc, surface, kind, n AS count, label, row_number() OVER (PARTITION BY doc ORDER BY n DESC, pos) AS rank FROM l
"""


@query("red_report", _SQL_REPORT)
def red_report(spark, sf_dir):
    pages = P.tailed(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    _, entities = R.label(pages, R.build_rules(detectors=_REPORTED))
    return R.report(entities).select("doc", "surface", "kind", "count", "label", F.col("rank").cast("long").alias("rank"))


_TERMS = ("Thereou", "of the", "the thereon.")
_LETTERS = {k: f"[{v}{v.upper()}]" for k, v in R.ACCENTED.items()}


def _sql_term(term: str) -> str:
    body = "".join(r"\s+" if c == " " else _LETTERS.get(c.lower(), c if c.isalnum() else f"\\{c}") for c in term)
    return f"(?i)\\b{body}" + ("\\b" if term[-1].isalnum() else "")


_SQL_FUZZY = "text"
for _t in _TERMS:
    _SQL_FUZZY = f"regexp_replace({_SQL_FUZZY}, '{_sql_term(_t)}', '{R.MASK}{'.' if _t.endswith('.') else ''}', 'g')"


@query("red_fuzzy_terms", f"SELECT doc_id, {_SQL_FUZZY} AS text FROM documents")
def red_fuzzy_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.scrub(F.col("text"), R.build_rules(terms=_TERMS)).alias("text"))


@query("red_verify", f"SELECT doc_id, array_to_string(list_filter({list(_TERMS)}, lambda t: contains(hay, lower(t))), '¦') AS leaked FROM (SELECT doc_id, lower(strip_accents({_SQL_FUZZY})) AS hay FROM documents)")
def red_verify(spark, sf_dir):
    return R.leaks(red_fuzzy_terms(spark, sf_dir), _TERMS).select("doc_id", F.array_join("leaked", "¦").alias("leaked"))


_CELLS = "[[CAST(doc_id AS VARCHAR), source], [regexp_extract(text, '[^ ]+$'), right(text, 60)]]"
_CELL_DOT = f"CASE WHEN {P._SQL_VALID['card']} THEN '{R.MASK}' || {_DOT} ELSE h END"


@query(
    "red_cells",
    f"""
WITH c AS (SELECT doc_id, unnest(flatten({_CELLS})) AS text, unnest(range(4)) AS k FROM ({P._SQL_TAILED})),
s AS ({_sql_scrubbed(f"'{R.MASK}' || {_DOT}", "SELECT doc_id * 4 + k AS doc_id, text FROM c", ("card", "email"))})
SELECT doc_id // 4 AS doc_id, string_agg(text, '¦' ORDER BY doc_id % 4) FILTER (doc_id % 4 < 2) || '⏎' || string_agg(text, '¦' ORDER BY doc_id % 4) FILTER (doc_id % 4 >= 2) AS cells FROM s GROUP BY doc_id // 4""",
)
def red_cells(spark, sf_dir):
    rows = F.array(F.array(F.col("doc_id").cast("string"), F.col("source")), F.array(F.regexp_extract("text", "[^ ]+$", 0), F.right("text", F.lit(60))))
    return P.tailed(spark, sf_dir).select("doc_id", _shown(R.scrub_rows(rows, R.build_rules(detectors=("card", "email")))).alias("cells"))


del _SQL_SHOWN
