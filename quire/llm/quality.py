"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a Catalyst expression over the whole text, and a document is
kept if it passes the base rules and no row of the table fails. No user function
runs; the verdict of a hundred rules is still one projection over one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table, words

WINDOW = 5

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auf auch das dem den der des die ein eine es für ist im in mit nicht sich sie und von werden zu "
    "al como con de del el en es la las lo los no o para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """metric must lie in [low, high]; judged from min_words words on."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")
    min_words: int = 0


#: The table: what is applied where the base rules pass.
RULES = (
    Rule("short words", "mean_word", low=2.0),
    Rule("long words", "mean_word", high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("function words", "stop_ratio", low=0.06, min_words=50),
    Rule("repeated lines", "dup_line_ratio", high=0.4),
    Rule("exclamation", "shout_ratio", high=0.5),
)


def repeat_words(word_list: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the list.

    Windows are hashed to 64 bits; only a list with a repeated hash is sorted by
    (hash, place), and the union of the repeated windows is folded over the
    sorted places.
    """
    hashes = F.when(
        F.size(word_list) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(word_list) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(word_list, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, k: same(F.get(pairs, k - 1), x) | same(F.get(pairs, k + 1), x))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts, zero,
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(let(pairs, places)))

    return let(hashes, count)


def measure(docs: DataFrame) -> DataFrame:
    """Counts of the whole text: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_shouts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = tuple(dict.fromkeys(STOP_WORDS.split()))
    prepared = docs.select(
        "doc_id", text.alias("text"), words(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda s: F.length(F.regexp_replace(s, SPACE, "")) > 0).alias("lines"),
    )
    return prepared.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))).isin(*stop))).cast("long").alias("n_stop"),
        F.length(F.regexp_replace("text", r"[^!]+", "")).cast("long").alias("n_shouts"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The table as (all rules pass, names of the rules that fail)."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    metrics = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "shout_ratio": per("n_shouts", "n_words"),
    }
    fails = [
        (r.name, (F.col("n_words") >= r.min_words) & ((metrics[r.metric] < F.lit(r.low)) | (metrics[r.metric] > F.lit(r.high))))
        for r in rules
    ]
    passed = F.lit(True)
    for _, fail in fails:
        passed = passed & ~fail
    names = F.array_compact(F.array(*(F.when(fail, F.lit(name)) for name, fail in fails))) if fails else F.array().cast("array<string>")
    return passed, names


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each of docs: the counts, base_failed, kept and failed_rules.

    A null or empty text has no words, fails the base and isn't kept. Very long
    texts are measured whole.
    """
    passed, names = compile_rules(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passed).alias("kept"), names.alias("failed_rules"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("failed_rules")


def _sql_rules() -> str:
    """The same table as SQL, for the oracle."""
    metric = {
        "mean_word": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_ratio": "n_stop / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)",
    }
    parts = []
    for r in RULES:
        if r.low != float("-inf"):
            parts.append(f"(n_words >= {r.min_words} AND {metric[r.metric]} < {r.low}::DOUBLE)")
        if r.high != float("inf"):
            parts.append(f"(n_words >= {r.min_words} AND {metric[r.metric]} > {r.high}::DOUBLE)")
    return " OR ".join(parts)


OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
),
wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: list_contains(string_split('{" ".join(dict.fromkeys(STOP_WORDS.split()))}', ' '), lower(trim(x, '.,;:!?"''()'))))) AS n_stop,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts
  FROM w LEFT JOIN rep USING (doc_id)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_sql_rules()}) AS kept
FROM b
"""
