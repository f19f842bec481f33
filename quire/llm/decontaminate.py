"""Benchmark decontamination by winnowing (DataFrame functions only).

A window is SPAN consecutive words of an item (a shorter item is one window).
For windows of m words, k-grams of k = m // 2 + 1 words are hashed and every
window is named by its smallest k-gram hash. The name depends on the words of
the window alone, so every shared window has the same name on both sides: any
shared span of m words is found. Neighbouring windows mostly share their name,
and a document sends only its runs of equal names (about one for four words) to
the join with the names of the test items. Hits are then extended: the windows
of a hit run are compared whole, by a 64-bit hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored, table

SPAN = 13
#: Up to this many windows of test items (24 bytes each) are broadcast; more are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: What parts words: everything in ASCII but letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def hashed_words(text: Column) -> Column:
    return F.transform(item_words(text), lambda w: F.xxhash64(w))


def _grams(array: Column, k: int, body, span: int = 1) -> Column:
    """body of the hashes of k neighbours from each place on, by doubling; the last k - 1 entries mean nothing."""
    if span == k:
        return body(array)
    step = min(span, k - span)
    return let(F.transform(array, lambda x, i: F.xxhash64(x, F.get(array, i + step))), lambda a: _grams(a, k, body, span + step))


def runs(hashed: Column, m: int) -> Column:
    """Runs of windows of m (hashed) words with one name: array of (name, start from 1, k-grams of the run)."""
    k = m // 2 + 1
    w = m - k + 1
    upto = lambda n: F.sequence(F.lit(1), n)

    def named(names: Column, grams: Column) -> Column:
        first = lambda j: F.coalesce(F.get(names, j - 1) != F.get(names, j - 2), F.lit(True))
        cut = lambda starts: F.transform(
            starts,
            lambda j, i: F.struct(
                F.get(names, j - 1).alias("name"), j.alias("start"),
                F.slice(grams, j, F.coalesce(F.get(starts, i + 1), F.size(names) + 1) - j + (w - 1)).alias("grams"),
            ),
        )
        return let(F.filter(upto(F.size(names)), first), cut)

    def smallest(h: Column, j: Column) -> Column:
        return F.least(*(F.get(h, j + i) for i in range(-1, w - 1))) if w > 1 else F.get(h, j - 1)

    names = lambda h: F.transform(upto(F.size(hashed) - (m - 1)), lambda j: smallest(h, j))
    found = _grams(hashed, k, lambda h: let(names(h), lambda n: named(n, h)))
    return F.when(F.size(hashed) >= m, found).otherwise(F.array().cast("array<struct<name:bigint,start:int,grams:array<bigint>>>"))


def windows_of(m: Column, grams: Column) -> Column:
    """Hashes of the windows of a run: the first and the last k-gram of a window hold all its words."""
    last = m - F.floor(m / 2).cast("int") - 1
    return F.transform(F.slice(grams, F.lit(1), F.size(grams) - last), lambda g, i: F.xxhash64(m, g, F.get(grams, i + last)))


def _all_runs(hashed: Column, spans: list[int]) -> Column:
    def tag(m: int):
        return lambda r: F.struct(F.lit(m).alias("m"), r["name"].alias("name"), r["start"].alias("start"), r["grams"].alias("grams"))

    tagged = [F.transform(runs(hashed, m), tag(m)) for m in spans]
    return tagged[0] if len(tagged) == 1 else F.concat(*tagged)


def find_overlaps(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for each of docs: doc_id, text_hash, n_words, n_hit, n_items, item_ids.

    docs(doc_id, text) and items(item_id, text). Null texts have no words; items
    without words have no window. item_ids are strings in string order. Rows with
    equal doc_id, or none, are told apart by their text (text_hash); repeated rows repeat.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")
    rows = docs.select("doc_id", key, hashed_words(F.col("text")).alias("words"))
    tests = items.select(F.col("item_id").cast("string").alias("item_id"), hashed_words(F.col("text")).alias("words")).withColumn("m", F.least(F.size("words"), F.lit(span))).where("m > 0")
    # At most span values.
    spans = sorted(r["m"] for r in tests.select("m").distinct().collect())
    sizes = docs.select("doc_id", key, F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    if not spans:
        return sizes.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"))

    own = tests.select("item_id", F.explode(F.filter(_all_runs(F.col("words"), spans), lambda r: r["m"] == F.col("m"))).alias("r"))
    windows = own.select("item_id", F.explode(windows_of(F.col("r.m"), F.col("r.grams"))).alias("window")).distinct()
    names = own.select("r.name").distinct()
    small = windows.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda x: x)

    sent = rows.select("doc_id", "text_hash", F.explode(_all_runs(F.col("words"), spans)).alias("r")).select("doc_id", "text_hash", "r.*")
    near = sent.join(hint(names), "name", "left_semi").select("doc_id", "text_hash", "m", F.posexplode(windows_of(F.col("m"), F.col("grams"))).alias("i", "window"), "start")
    hits = near.select("doc_id", "text_hash", "m", (F.col("start") + F.col("i")).alias("start"), "window").join(hint(windows.select("window").distinct()), "window", "left_semi").distinct()
    # Used twice below; the scan of the texts runs once.
    hits = stored(hits, "hits")

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    union = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "m"))), zero,
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["m"] - F.greatest(x["start"], a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    covered = hits.groupBy("doc_id", "text_hash").agg(union.cast("long").alias("n_hit"))
    matched = hits.select("doc_id", "text_hash", "window").distinct().join(hint(windows), "window").select("doc_id", "text_hash", "item_id").distinct()
    listed = matched.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    listed = listed.withColumnsRenamed({"doc_id": "__i", "text_hash": "__t"})
    found = covered.join(listed, covered["doc_id"].eqNullSafe(listed["__i"]) & (covered["text_hash"] == listed["__t"])).drop("__i", "__t")
    found = found.withColumnsRenamed({"doc_id": "__id", "text_hash": "__th"})
    same = sizes["doc_id"].eqNullSafe(found["__id"]) & (sizes["text_hash"] == found["__th"])
    return sizes.join(found, same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones, columns as they are."""
    bad = find_overlaps(docs, items).where(contaminated()).select("doc_id", "text_hash").distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    on = (docs["doc_id"].eqNullSafe(bad["doc_id"])) & (key == bad["text_hash"])
    if bad.count() <= BROADCAST_WINDOWS:
        bad = F.broadcast(bad)
    return docs.join(bad, on, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, ws, least(len(ws), 13) AS m FROM (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
spans AS (SELECT DISTINCT m FROM items),
dwins AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, spans WHERE len(ws) >= m)
),
hits AS (SELECT DISTINCT doc_id, d.m, i, item_id FROM dwins d JOIN wins w ON d.m = w.m AND d.g = w.g),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""
