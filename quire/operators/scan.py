"""Proposals of sensitive terms: matches, candidates, scores, and one entry for each text.

pages(doc, page, text) may hold any number of documents; everything is grouped by
doc. Matches are exploded early, so that trimming and folding run as columns, and
the candidates are partial aggregates before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import text as T
from ..functions.expressions import let

#: The base of a candidate's score, kinds suggested at once, and limits.
BASE_SCORE = {
    "email": 100, "iban": 100, "card": 100, "id_fiscal": 95, "coord": 90, "phone": 85, "empresa": 80, "encabezado": 70,
    "serial": 60, "url": 55, "ip": 55, "marca": 45, "nombre": 30,
}
OTHER_SCORE = 25
SUGGESTED = ("email", "phone", "iban", "card", "id_fiscal", "coord", "empresa")
MAX_CANDIDATES, SAMPLES = 400, 3
HEADER_MIN, HEADER_MAX, HEADER_LINES = 6, 110, 2

_PHASE = {d.name: i for i, d in enumerate(D.DETECTORS)}
_NAMES, _HEADERS = len(_PHASE), len(_PHASE) + 1


def _order(phase: Column, page: Column, sub: Column, start: Column) -> Column:
    """Where a match stands in the order in which a scan meets matches."""
    return F.struct(phase.cast("int").alias("phase"), page.cast("long").alias("page"), sub.cast("int").alias("sub"), start.cast("int").alias("start"))


def detector_hits(pages: DataFrame, kinds: Sequence[str] = tuple(_PHASE)) -> DataFrame:
    """(doc, page, kind, ord, hit, context) of every valid match; one pass over the text for all detectors."""
    def tagged(d: D.Detector) -> Column:
        hits = F.filter(D.matches(F.col("text"), d.pattern), lambda m: d.valid(m["hit"]))
        return F.transform(hits, lambda m: F.struct(F.lit(d.name).alias("kind"), F.lit(_PHASE[d.name]).alias("phase"), m["start"].alias("start"), m["hit"].alias("hit")))

    chosen = [tagged(d) for d in D.DETECTORS if d.name in kinds]
    rows = pages.select("doc", "page", "text", F.explode(F.concat(*chosen)).alias("m"))
    around = T.context(F.col("text"), F.col("m.start"), F.col("m.start") + F.length("m.hit"))
    return rows.select("doc", "page", "m.kind", _order(F.col("m.phase"), F.col("page"), F.lit(0), F.col("m.start")).alias("ord"), "m.hit", around.alias("context"))


def _fold_word(c: Column) -> Column:
    return F.btrim(T.fold(c), F.lit(".,"))


def trim_stop_words(phrase: Column) -> Column:
    """phrase without the stop words at its ends."""
    tokens = F.filter(F.split(phrase, f"[{T.SPACE_CLASS}]+"), lambda x: x != "")

    def between(ts: Column, useful: Column) -> Column:
        first, last = F.array_position(useful, True), F.size(useful) - F.array_position(F.reverse(useful), True) + 1
        return F.when(first > 0, F.array_join(F.slice(ts, first.cast("int"), (last - first + 1).cast("int")), " ")).otherwise(F.lit(""))

    return let(tokens, lambda ts: let(F.transform(ts, lambda x: ~_fold_word(x).isin(*D.STOP_WORDS)), lambda useful: between(ts, useful)))


def looks_like_company(phrase: Column) -> Column:
    last = F.element_at(F.split(F.btrim(F.replace(T.fold(phrase), F.lit(","), F.lit(" "))), " +"), -1)
    return F.btrim(last, F.lit(".")).isin(*D.COMPANY_ENDINGS)


def name_hits(pages: DataFrame) -> DataFrame:
    """Proper names ('nombre') and likely companies ('empresa')."""
    found = pages.select("doc", "page", "text", F.explode(D.matches(F.col("text"), D.unicode(D.PROPER))).alias("m")).select("doc", "page", "text", F.col("m.start").alias("start"), F.col("m.hit").alias("raw"))
    found = found.withColumn("hit", trim_stop_words(T.strip(F.col("raw")))).where("hit <> ''")
    words = F.split(F.col("hit"), f"[{T.SPACE_CLASS}]+")
    before = T.strip(F.substr("text", F.greatest(F.col("start") - 1, F.lit(1)), F.least(F.col("start"), F.lit(2))))
    opens = (F.col("start") == 0) | (before == "") | before.rlike(r"[.:]$")
    useful = F.exists(words, lambda w: ~F.btrim(T.fold(w), F.lit(".")).isin(*D.STOP_WORDS))
    single = F.size(words) == 1
    kept = found.where((F.size(words) <= 4) & useful & ~(single & (opens | T.fold(F.col("hit")).isin(*D.STOP_WORDS))))
    around = T.context(F.col("text"), F.col("start"), F.col("start") + F.length("raw"))
    return kept.select("doc", "page", F.when(looks_like_company(F.col("hit")), "empresa").otherwise("nombre").alias("kind"), _order(F.lit(_NAMES), F.col("page"), F.lit(0), F.col("start")).alias("ord"), "hit", around.alias("context"))


def acronym_hits(pages: DataFrame) -> DataFrame:
    found = pages.select("doc", "page", "text", F.explode(D.matches(F.col("text"), D.unicode(D.ACRONYM))).alias("m"))
    kept = found.where(~T.fold(F.col("m.hit")).isin(*D.STOP_WORDS) & ~F.col("m.hit").rlike(r"^\p{N}+$"))
    around = T.context(F.col("text"), F.col("m.start"), F.col("m.start") + F.length("m.hit"))
    return kept.select("doc", "page", F.lit("marca").alias("kind"), _order(F.lit(_NAMES), F.col("page"), F.lit(1), F.col("m.start")).alias("ord"), "m.hit", around.alias("context"))


def gather(hits: DataFrame) -> DataFrame:
    """Candidates by (doc, kind, folded text): first surface, count, pages, first contexts."""
    shown = F.regexp_replace(T.collapse(F.col("hit")), "^[ .,;:]+|[ .,;:]+$", "")
    rows = hits.withColumn("shown", shown).where(F.length("shown").between(3, 90)).withColumn("key", T.fold(F.col("shown")))
    by = ["doc", "kind", "key"]
    # The first contexts are ranked, not collected: a limit by group drops the others before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    firsts = rows.select(*by, "ord", "context", rank.alias("n")).where(F.col("n") <= SAMPLES)
    samples = firsts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "context"))), lambda x: x["context"]).alias("samples"))
    found = rows.groupBy(*by).agg(F.min("ord").alias("ord"), F.min_by("shown", "ord").alias("text"), F.count("*").alias("count"), F.sort_array(F.collect_set("page")).alias("pages"))
    return found.join(samples, by)


def repeated_lines(pages: DataFrame) -> DataFrame:
    """Lines that open or close half of a document's pages, as candidates of kind 'encabezado'."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), T.strip), lambda x: x != "")
    n = F.size("lines")
    edge = F.concat(F.slice("lines", 1, HEADER_LINES), F.slice("lines", F.greatest(n - (HEADER_LINES - 1), F.lit(1)), F.lit(HEADER_LINES)))
    rows = pages.select("doc", "page", lines.alias("lines")).select("doc", "page", F.posexplode(edge).alias("i", "line"))
    rows = rows.where(F.length("line").between(HEADER_MIN, HEADER_MAX)).withColumn("key", T.fold(F.col("line")))
    total = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    seen = rows.groupBy("doc", "key").agg(F.min_by("line", F.struct("page", "i")).alias("text"), F.min(F.struct("page", "i")).alias("at"), F.sort_array(F.collect_set("page")).alias("pages"))
    often = seen.join(total, "doc").where((F.col("n_pages") >= 3) & (F.size("pages") >= F.greatest(F.lit(2.0), F.col("n_pages") * 0.5)))
    return often.select(
        "doc", F.lit("encabezado").alias("kind"), "key", _order(F.lit(_HEADERS), F.col("at.page"), F.lit(0), F.col("at.i")).alias("ord"), "text",
        F.size("pages").cast("long").alias("count"), "pages", F.array("text").alias("samples"),
    )


def score(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates with score and suggested; lone names and acronyms are dropped as noise."""
    total = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    base = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in BASE_SCORE.items()), F.lit(OTHER_SCORE))
    value = base + F.least(F.lit(20), F.col("count") * 2) + F.size("pages") / F.greatest("n_pages", F.lit(1)) * 15
    suggested = F.col("kind").isin(*SUGGESTED) | ((F.col("kind") == "encabezado") & (F.size("pages") >= 3))
    kept = (F.col("count") >= 2) | ~F.col("kind").isin("nombre", "marca") | ((F.col("kind") == "nombre") & (F.size(F.split("text", " +")) >= 2))
    return candidates.join(total, "doc").select(*candidates.columns, value.cast("double").alias("score"), suggested.alias("suggested")).where(kept)


def one_kind_each(scored: DataFrame) -> DataFrame:
    """One candidate for each (doc, folded text): the best score wins, then the first met; counts and pages join."""
    best = F.struct(F.col("score"), (-F.col("ord.phase")).alias("a"), (-F.col("ord.page")).alias("b"), (-F.col("ord.sub")).alias("c"), (-F.col("ord.start")).alias("d"))
    pick = F.max_by(F.struct("kind", "text", "score", "suggested", "samples"), best).alias("w")
    merged = scored.groupBy("doc", "key").agg(pick, F.max("count").alias("count"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.min("ord").alias("ord"))
    return merged.select("doc", "key", "w.kind", "w.text", "count", "pages", "w.samples", "w.score", "w.suggested", "ord")


def top(candidates: DataFrame, n: int = MAX_CANDIDATES) -> DataFrame:
    """The n best of each document, with their rank."""
    order = Window.partitionBy("doc").orderBy(F.desc("score"), F.desc("count"), F.lower("text"), "ord")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def scan(pages: DataFrame, kinds: Sequence[str] = tuple(_PHASE), names: bool = True, headers: bool = True, n: int = MAX_CANDIDATES) -> DataFrame:
    """The whole scan: doc, rank, kind, text, count, pages, samples, score, suggested."""
    hits = detector_hits(pages, kinds)
    if names:
        hits = hits.unionByName(name_hits(pages)).unionByName(acronym_hits(pages))
    found = gather(hits)
    if headers:
        found = found.unionByName(repeated_lines(pages).select(found.columns))
    return top(one_kind_each(score(found, pages)), n).select("doc", "rank", "kind", "text", "count", "pages", "samples", "score", "suggested")


def merge_documents(candidates: DataFrame) -> DataFrame:
    """Candidates of several documents as one list by (kind, text in lower case)."""
    first = F.struct("doc", "rank")
    return candidates.groupBy("kind", F.lower("text").alias("key")).agg(
        F.min_by("text", first).alias("text"), F.sum("count").alias("count"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.min_by("score", first).alias("score"), F.min_by("suggested", first).alias("suggested"), F.countDistinct("doc").alias("documents"),
    )
