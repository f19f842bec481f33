"""Secret scans over an incremental ledger of content-addressed texts.

Every version of a text is a blob named by its SHA-256. The ledger holds one row
for each (blob, rule version) that was ever scanned. A scan takes the blobs of
the given documents that the ledger lacks for the current rule version, scans
each once, appends them, and joins the findings back to every document (path)
that has the blob. Copies therefore cost one hash each, and a second run over an
unchanged corpus scans nothing.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, small_batches, stored, table

#: The kinds in their order, and the base patterns of the contract.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "provider_key")
BASE = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),  # a whole run of 32 and more
}
#: What the method adds to the base.
ADDED = {
    "private_key": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "provider_key": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"),
}
#: What follows the heading of a private key, where its END line is missing: lines of headers, base64, a short last line.
_GAP = r"(?:\s|\\[rn])"
_KEY_BODY = re.compile(
    rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info|Comment|Version|Hash):[^\r\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"(?:{_GAP}++(?:[A-Za-z0-9+/]++={{1,2}}|[A-Za-z0-9+/]++(?=[^\S\n]*(?:[\r\n\"']|\\[rn]|\Z))))?"
)
#: Changes with any change of a pattern.
RULE_VERSION = hashlib.sha256("\n".join(f"{k} {r.pattern}" for k, r in (BASE | ADDED | {"key_body": _KEY_BODY}).items()).encode()).hexdigest()[:12]

FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: A scan list up to this many blobs (about 100 bytes each) is broadcast, a longer one is shuffled with the texts.
BROADCAST_BLOBS = 400_000


def _private_keys(text: str):
    """(start, end) of private keys: to the END line of the same name before the next heading, else to the end of the base64 block."""
    heads = list(ADDED["private_key"].finditer(text))
    for m, stop in zip(heads, [h.start() for h in heads[1:]] + [len(text)], strict=True):
        last = m[0].replace("BEGIN", "END", 1)
        end = text.find(last, m.end(), stop)
        body = None if end >= 0 else _KEY_BODY.match(text, m.end(), stop)
        yield m.start(), end + len(last) if end >= 0 else body.end() if body else m.end()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all spans, sorted."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in BASE["access"].finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in BASE["hex"].finditer(text)]
    for i, kind in enumerate(KINDS[3:], 3):
        if kind != "private_key":
            found += [(m.start(), i, m.end()) for m in ADDED[kind].finditer(text)]
        elif "PRIVATE KEY" in text:
            found += [(a, i, b) for a, b in _private_keys(text)]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for batch in (part for b in released(batches) for part in slices(b, 1000)):
        out = []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), strict=True):
            spans = find_spans(text or "")
            base = [s for s in spans if s[1] < 3]
            n = [sum(s[1] == k for s in base) for k in range(3)]
            out.append((blob, RULE_VERSION, *n, written(base), written(spans)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_spans", "spans"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _blob():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (FINDINGS) for the blobs of docs that ledger lacks for RULE_VERSION.

    Only names of blobs are compared; a text is read by the scan only if its row
    was chosen to stand for its blob. A null text is the empty blob; a null doc_id
    is a document like any other.
    """
    small_batches(docs.sparkSession)
    keys = docs.select("doc_id", _blob().alias("blob"))
    chosen = keys.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        chosen = chosen.join(known, "blob", "left_anti")
    chosen = stored(chosen, "unseen")
    if chosen.count() <= BROADCAST_BLOBS:
        chosen = F.broadcast(chosen)
    rows = docs.select("doc_id", "text", _blob().alias("blob"))
    texts = rows.join(chosen, (rows["blob"] == chosen["blob"]) & rows["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi").select("blob", "text")
    # Repeated rows of one document would be scanned twice; the ledger keeps one.
    return texts.mapInArrow(_scan, FINDINGS).dropDuplicates(["blob"])


def update_ledger(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Scan what is unseen, append it to the ledger at path, and return the whole ledger.

    Without a path the ledger of this run alone is written to the shared folder.
    """
    if path is None:
        return stored(scan_unseen(docs), "ledger")
    try:
        known = spark.read.schema(FINDINGS).parquet(path)
    except Exception as e:  # a first run has no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    scan_unseen(docs, known).write.mode("append").parquet(path)
    return spark.read.schema(FINDINGS).parquet(path)


def find_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Findings of every document (path) through the ledger: doc_id and FINDINGS without its keys.

    Documents without findings have zeros and empty strings. Empty and very long
    texts are scanned whole; repeated rows each get their row.
    """
    ledger = update_ledger(docs.sparkSession, docs, ledger_path).where(F.col("rule_version") == RULE_VERSION)
    hits = ledger.where("spans <> ''").drop("rule_version")
    joined = docs.select("doc_id", _blob().alias("blob")).join(hits, "blob", "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return joined.select(
        "doc_id", *(F.coalesce(n, zero).alias(n) for n in ("n_assign", "n_access", "n_hex")),
        *(F.coalesce(n, none).alias(n) for n in ("base_spans", "spans")),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span that the ledger lists replaced by mark.

    Overlapping spans become one mark. All rows and columns stay; a column
    n_chars follows the changed text. Texts without a span pass unread. Rows without
    a doc_id are read if one of them has a span.
    """
    hits = stored(find_secrets(docs).where("spans <> ''").select(F.col("doc_id").alias("__id")).distinct(), "hits")
    flag = hits.withColumn("__hit", F.lit(True))
    if hits.count() <= BROADCAST_BLOBS:
        flag = F.broadcast(flag)
    columns, schema = docs.columns, docs.schema

    def cut(batches):
        for batch in (part for b in released(batches) for part in slices(b, 1000)):
            at = batch.schema.get_field_index("text")
            flags, texts = batch.column(batch.schema.get_field_index("__hit")).to_pylist(), batch.column(at).to_pylist()
            for i, (hit, text) in enumerate(zip(flags, texts, strict=True)):
                if hit and text:
                    out, end = [], 0
                    for a, _, b in find_spans(text):
                        if a >= end:
                            out += [text[end:a], mark]
                        end = max(end, b)
                    texts[i] = "".join([*out, text[end:]])
            arrays = [pa.array(texts, batch.schema.field(at).type) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    marked = docs.join(flag, docs["doc_id"].eqNullSafe(flag["__id"]), "left").drop("__id").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    clean = marked.mapInArrow(cut, schema)
    return clean.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else clean


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def _sql_kind(kind: str, pattern: str, keep: str) -> str:
    """Matches with code-point places: gaps between matches and matches, added up in turn."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS k, s - 1 AS s, s - 1 + length(m) AS e, m FROM (
    SELECT doc_id, hits[i] AS m,
      1 + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s
    FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL))
  ) WHERE {keep}"""


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
OP8_SQL = f"""
WITH found AS (
  {_sql_kind("assign", _ASSIGN, "length(regexp_extract(m, '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8")}
  UNION ALL {_sql_kind("access", "AKIA[A-Z0-9]+", "length(m) >= 16")}
  UNION ALL {_sql_kind("hex", "[0-9a-f]+", "length(m) >= 32")}
  UNION ALL {_sql_kind("private_key", ADDED["private_key"].pattern, "true")}
  UNION ALL {_sql_kind("web_token", ADDED["web_token"].pattern, "true")}
  UNION ALL {_sql_kind("provider_key", ADDED["provider_key"].pattern, "true")}
),
per AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""
