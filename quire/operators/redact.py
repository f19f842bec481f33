"""Redaction: rules, replacement styles, stable pseudonyms, report and leak check.

Rules run one after the other on the rewritten text. Styles whose token follows
from the hit alone (mask, hash, remove) are one expression. Labels are numbered by
first appearance in a document, which no row can know: a first pass puts private
characters where the hits were, a second numbers the entities of each document, a
third writes the labels. No pass needs more than one row of text at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import text as T
from ..functions.expressions import let

#: Tokens, and letters that stand for their accented forms.
MASK, REF = "[OCULTO]", "[REF:%s]"
DEFAULT_PREFIX = "CONFIDENCIAL"
ACCENTED = {"a": "aáàäâã", "e": "eéèëê", "i": "iíìïî", "o": "oóòöôõ", "u": "uúùüû", "n": "nñ", "c": "cç"}

#: Private characters that mark hits between the passes; texts with them can't be labelled.
_MARK0, _BASE = 0xF0000, 1000
_MARKS = "".join(chr(_MARK0 + i) for i in range(_BASE))
_MARKED = f"[{_MARKS[0]}-{_MARKS[-1]}]{{3}}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    valid: Callable[[Column], Column] = field(default=lambda hit: F.lit(True))


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def term_pattern(term: str, fuzzy: bool = True, whole_word: bool = True) -> str:
    """Pattern of a literal term: any accents, case and spacing if fuzzy; word limits only beside letters and digits."""
    if fuzzy:
        body = ""
        for part in re.split(r"(\s+)", term):
            if part.isspace():
                body += r"\s+"
                continue
            for ch in part:
                forms = ACCENTED.get(_plain(ch).lower()) if ch.isalpha() else None
                body += f"[{forms}{forms.upper()}]" if forms else _quoted(ch)
    else:
        body = "".join(map(_quoted, term))
    left = r"\b" if whole_word and term[0].isalnum() else ""
    right = r"\b" if whole_word and term[-1].isalnum() else ""
    return f"(?{'iu' if fuzzy else ''}U){left}{body}{right}"


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() or ch == "_" or ord(ch) > 127 else f"\\{ch}" if not ch.isspace() else f"\\x{ord(ch):02x}"


def build_rules(terms: Sequence[str] = (), detectors: Sequence[str] = (), patterns: Sequence[str] = (), fuzzy: bool = True, whole_word: bool = True) -> list[Rule]:
    """Rules in order: terms, detectors as listed, then patterns. Blank, unknown and broken ones are skipped."""
    rules = [Rule("termino", term_pattern(t.strip(), fuzzy, whole_word)) for t in terms if t.strip()]
    known = {d.name: d for d in D.DETECTORS}
    rules += [Rule(n, known[n].pattern, known[n].valid) for n in detectors if n in known]
    for raw in patterns:
        raw = raw.strip()
        try:
            re.compile(raw)
        except re.error:
            continue
        if raw:
            rules.append(Rule("regex", f"(?{'iu' if fuzzy else ''}U){raw}"))
    return rules


def canon(hit: Column, fuzzy: bool = True) -> Column:
    """What makes two hits the same entity."""
    return T.fold(hit) if fuzzy else T.collapse(hit)


def _token(style: str, hit: Column, fuzzy: bool) -> Column:
    if style == "remove":
        return F.lit("")
    if style == "mask":
        token = F.lit(MASK)
    elif style == "hash":
        digest = F.upper(F.left(F.sha2(canon(hit, fuzzy).cast("binary"), 256), F.lit(6)))
        token = F.concat(F.lit(REF.split("%s")[0]), digest, F.lit(REF.split("%s")[1]))
    else:
        raise ValueError(f"{style} isn't a style of one row")
    # A sentence whose last word was hidden keeps its dot.
    return F.when(F.endswith(hit, F.lit(".")), F.concat(token, F.lit("."))).otherwise(token)


def _replace(text: Column, rule: Rule, token: Callable[[Column], Column]) -> Column:
    """text with the valid hits of rule replaced."""
    def body(t: Column) -> Column:
        written = F.transform(F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0)), lambda h: F.when(rule.valid(h), token(h)).otherwise(h))
        laid = F.zip_with(F.split(t, rule.pattern, -1), written, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
        return F.when(t.rlike(rule.pattern), F.array_join(laid, "")).otherwise(t)

    return let(text, body)


def scrub(text: Column, rules: Sequence[Rule], style: str = "mask", fuzzy: bool = True) -> Column:
    """text with all rules applied in turn; style mask, hash or remove."""
    out = text
    for rule in rules:
        out = _replace(out, rule, lambda h: _token(style, h, fuzzy))
    return out


def scrub_rows(rows: Column, rules: Sequence[Rule], style: str = "mask", fuzzy: bool = True) -> Column:
    """A table with every cell scrubbed by itself."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: scrub(c, rules, style, fuzzy)))


def _digit(n: Column) -> Column:
    return F.substr(F.lit(_MARKS), n + 1, F.lit(1))


def mark(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows(..., text) with text marked, and hits array<struct<rule, no, mark, hit>> in the order they were met."""
    state = F.struct(F.col("text").alias("text"), F.array().cast("array<struct<rule:int,no:int,mark:string,hit:string>>").alias("hits"))
    for i, rule in enumerate(rules):
        state = let(state, _marker(i, rule))
    return rows.withColumn("__state", state).withColumn("text", F.col("__state.text")).withColumn("hits", F.col("__state.hits")).drop("__state")


def _marker(i: int, rule: Rule) -> Callable[[Column], Column]:
    """One rule's step from state(text, hits) to the next."""
    def sign(no):
        n = no.cast("int")
        return F.concat(F.lit(_MARKS[i]), _digit(F.floor(n / _BASE).cast("int")), _digit(n % _BASE))

    def entry(hit, no):
        return F.when(rule.valid(hit), F.struct(F.lit(i).alias("rule"), no.cast("int").alias("no"), sign(no).alias("mark"), hit.alias("hit")))

    def write(gap, hit, found):
        dot = F.when(F.endswith(hit, F.lit(".")), F.lit(".")).otherwise(F.lit(""))
        return F.concat(gap, F.when(found.isNotNull(), F.concat(found["mark"], dot)).otherwise(F.coalesce(hit, F.lit(""))))

    def step(s):
        def laid(hits):
            def both(found):
                pairs = F.zip_with(hits, found, lambda h, f: F.struct(h.alias("hit"), f.alias("found")))
                text = F.array_join(F.zip_with(F.split(s["text"], rule.pattern, -1), pairs, lambda g, p: write(g, p["hit"], p["found"])), "")
                return F.struct(text.alias("text"), F.concat(s["hits"], F.array_compact(found)).alias("hits"))

            return let(F.transform(hits, entry), both)

        return F.when(s["text"].rlike(rule.pattern), let(F.regexp_extract_all(s["text"], F.lit(rule.pattern), F.lit(0)), laid)).otherwise(s)

    return step


def label(pages: DataFrame, rules: Sequence[Rule], fuzzy: bool = True, prefix: str = DEFAULT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """(pages with text labelled, entities) for pages(doc, page, text), one row for each (doc, page).

    entities(doc, canon, label, surface, kind, count) is the report: surface and kind
    are those of the first hit. Numbers restart in every document.
    """
    marked = mark(pages.select("doc", "page", "text"), rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules)) if rules else F.array().cast("array<string>")
    hits = marked.select("doc", "page", F.explode("hits").alias("h")).select("doc", "page", "h.rule", "h.no", "h.mark", T.collapse(F.col("h.hit")).alias("surface"))
    hits = hits.withColumn("canon", canon(F.col("surface"), fuzzy)).withColumn("kind", F.get(kinds, F.col("rule")))
    at = F.struct("page", "rule", "no")
    entities = hits.groupBy("doc", "canon").agg(F.min(at).alias("at"), F.min_by("surface", at).alias("surface"), F.min_by("kind", at).alias("kind"), F.count("*").alias("count"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("at"))
    name = F.when(F.col("kind").isin("termino", "regex"), F.lit(prefix)).otherwise(F.upper("kind"))
    entities = entities.withColumn("label", F.concat(F.lit("["), name, F.lit("_"), number.cast("string"), F.lit("]")))
    names = hits.join(entities.select("doc", "canon", "label"), ["doc", "canon"]).groupBy("doc", "page").agg(F.map_from_entries(F.collect_list(F.struct("mark", "label"))).alias("names"))
    joined = marked.select("doc", "page", "text").join(names, ["doc", "page"], "left")
    laid = F.zip_with(F.split("text", _MARKED, -1), F.regexp_extract_all("text", F.lit(_MARKED), F.lit(0)), lambda g, m: F.concat(g, F.coalesce(F.try_element_at("names", m), m, F.lit(""))))
    out = joined.select("doc", "page", F.when(F.col("names").isNull(), F.col("text")).otherwise(F.array_join(laid, "")).alias("text"))
    return out, entities.select("doc", "canon", "label", "surface", "kind", "count", "at")


def report(entities: DataFrame) -> DataFrame:
    """entities with their rank: the most frequent first, then the first met."""
    order = Window.partitionBy("doc").orderBy(F.desc("count"), "at")
    return entities.withColumn("rank", F.row_number().over(order)).drop("at", "canon")


def leaks(outputs: DataFrame, terms: Sequence[str], fuzzy: bool = True, text: str = "text") -> DataFrame:
    """outputs with leaked: the listed terms that still occur literally."""
    pairs = [(t.strip(), _plain(t.strip()).lower() if fuzzy else t.strip()) for t in terms if t.strip()]
    hay = F.lower(T.strip_accents(F.col(text))) if fuzzy else F.col(text)
    listed = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(n).alias("needle")) for t, n in pairs if n)) if pairs else F.array().cast("array<struct<term:string,needle:string>>")
    held = outputs.withColumn("__hay", hay)
    found = F.transform(F.filter(listed, lambda p: F.contains(F.col("__hay"), p["needle"])), lambda p: p["term"])
    return held.withColumn("leaked", found).drop("__hay")
