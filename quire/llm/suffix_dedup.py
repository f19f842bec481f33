"""Removal of repeated 100-byte strings with two-stage suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a
document of smaller doc_id, or before in the same one). Suffixes are sorted in
pieces that surely hold all equal strings together:

1. Every string is named by the smallest hash of the GRAM-byte grams in it, and
   by where that gram lies. Equal strings have equal names. Neighbouring strings
   share their gram (an anchor), about one for 35 bytes.
2. Each batch of texts sorts the suffixes whose anchor occurs twice in it and
   marks what repeats inside the batch. Only the first of equal strings goes on,
   so a passage of a third of all documents is sent once for each batch.
3. Anchors meet by hash. Those of one batch alone are dropped; for the others the
   bytes of their strings are fetched, dealt by hash and sorted again.

Sorting is in two stages: suffixes smaller than their successor are sorted
directly; the others are induced by scanning the buckets of first bytes in
order, where the predecessor of each suffix is put next into its own bucket.
Then adjacent suffixes are compared, and a common prefix of LENGTH bytes makes
the later one a repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, stored, table

LENGTH, GRAM = 100, 32
#: Bytes of text that are hashed at once, and that make a batch.
CHUNK, BATCH_BYTES = 1 << 20, 8 << 20
#: Suffixes that are sorted at once, if the hashes let them be parted.
SORTED_AT_ONCE = 300_000
#: Anchors in a bucket of the first shuffle, strings in a bucket of the second.
ANCHORS_PER_BUCKET, STRINGS_PER_BUCKET = 250_000, 1_000_000

_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPAN = LENGTH - GRAM + 1  # grams of a string
_LOW = np.uint64((1 << 21) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place of data on, by doubling."""
    h, step = _BYTE[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, count) of the runs of strings with one anchor.

    bounds are the ends of the texts in data, from 0 on; strings that cross one
    are left out. The anchor of a string is the leftmost of its smallest grams.
    """
    out = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        h = gram_hashes(part)
        order = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        best = (_window_min(order, _SPAN) & _LOW).astype(np.int64)
        new = np.empty(len(best), bool)
        new[:1], new[1:] = True, best[1:] != best[:-1]
        # A run is cut where a text ends, and holds no string that crosses an end.
        ends = bounds[np.searchsorted(bounds, at + 1) : np.searchsorted(bounds, at + len(part), "right")] - at
        for e in ends[ends < len(best)]:
            new[e] = True
        good = np.ones(len(best) + 1, np.int32)
        cross = np.zeros(len(best) + 1, np.int32)
        inner = ends[(ends > 0) & (ends < len(part))]
        np.add.at(cross, np.clip(inner - LENGTH + 1, 0, len(best)), 1)
        np.add.at(cross, np.clip(inner, 0, len(best)), -1)
        good = np.cumsum(cross)[:-1] == 0
        flips = np.flatnonzero(good[1:] != good[:-1]) + 1
        new[flips] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(best)))
        keep = good[first]
        first, count = first[keep], count[keep]
        out.append((h[best[first]], first + at, count))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all runs, run after run."""
    total = int(count.sum())
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)


def suffix_order(buf: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of the mask wanted, and some more, in the order of the first LENGTH bytes of their suffixes.

    buf must begin with a byte that isn't wanted and end with LENGTH + 8 bytes
    that aren't either.
    """
    n = len(buf)
    # S: smaller than the successor. It is decided by the next byte that differs.
    differs = np.append(buf[1:] != buf[:-1], True)
    places = np.flatnonzero(differs)
    runs = np.diff(np.append(-1, places))
    follow = np.append(buf[1:], 0)
    small = np.repeat(buf[places] < follow[places], runs)
    small[n - runs[-1] :] = True  # the padding, equal bytes up to the end
    # An induced suffix needs its successors up to one that is sorted directly.
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    sorted_at = np.flatnonzero(small)
    stops = sorted_at[np.searchsorted(sorted_at, ends)]
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, ends, 1)
    np.add.at(cover, stops + 1, -1)
    need = wanted | (np.cumsum(cover)[:-1] > 0)

    direct = np.flatnonzero(need & small)
    windows = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(LENGTH + 8, np.uint8)), LENGTH + 4)
    rows = np.ascontiguousarray(windows[direct]).view(f"S{LENGTH + 4}").ravel()
    direct = direct[np.argsort(rows)]
    del rows
    heads = buf[direct]
    cuts = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending = need & ~small
    result = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):  # runs of the byte c itself
            before = front - 1
            front = before[pending[before] & (buf[before] == c)]
            bucket.append(front)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        result.append(whole)
        before = whole - 1
        before = before[pending[before] & (buf[before] > c)]
        if len(before):
            chars = buf[before]
            by = np.argsort(chars, kind="stable")
            present, begin = np.unique(chars[by], return_index=True)
            for ch, part in zip(present, np.split(before[by], begin[1:]), strict=True):
                induced[ch].append(part)
    return np.concatenate(result) if result else np.zeros(0, np.int64)


def repeats(buf: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the strings at starts: whether an equal one has a smaller order."""
    data = np.concatenate([np.zeros(1, np.uint8), buf, np.zeros(LENGTH + 8, np.uint8)])
    wanted = np.zeros(len(data), bool)
    wanted[starts + 1] = True
    sa = suffix_order(data, wanted)
    sa = sa[wanted[sa]]
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.zeros(len(sa), bool)
    for at in range(1, len(sa), 100_000):
        rows = np.ascontiguousarray(windows[sa[at - 1 : at + 100_000]]).view(np.uint32)
        same[at : at + 100_000] = (rows[1:] == rows[:-1]).all(1)
    place = np.full(len(data), -1, np.int64)
    place[starts + 1] = np.arange(len(starts))
    rank = order[place[sa]]
    out = np.zeros(len(starts), bool)
    if len(sa):
        groups = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(rank, groups), np.diff(np.append(groups, len(sa))))
        out[place[sa]] = rank > least
    return out


def _pieces(h: np.ndarray, count: np.ndarray):
    """Slices of runs sorted by h that part no hash and hold about SORTED_AT_ONCE strings."""
    edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    sums = np.append(0, np.cumsum(count))[edges]
    at = 0
    while at < len(edges) - 1:
        to = max(int(np.searchsorted(sums, sums[at] + SORTED_AT_ONCE, "right")) - 1, at + 1)
        yield slice(edges[at], edges[to])
        at = to


def _gathered(buf: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the runs' strings one after the other, and where each string starts in them."""
    span = count + LENGTH - 1
    return buf[expand(first, span)], expand(np.cumsum(span) - span, count)


def mark_batch(data: np.ndarray, h: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Strings of data (by place) that repeat one of smaller order in the same batch."""
    gone = np.zeros(len(data), bool)
    by = np.argsort(h, kind="stable")
    hs = h[by]
    twin = np.zeros(len(hs), bool)
    twin[1:] = hs[1:] == hs[:-1]
    twin[:-1] |= twin[1:]
    by, hs = by[twin], hs[twin]
    for s in _pieces(hs, count[by]) if len(by) else ():
        f, c = first[by[s]], count[by[s]]
        text, starts = _gathered(data, f, c)
        places = expand(f, c)
        gone[places[repeats(text, starts, order[places])]] = True
    return gone


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _pack(*cols: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    types = [np.dtype(k) for k in kinds.split()]
    n, at, out = len(blob) // sum(t.itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * t.itemsize
    return out


ANCHOR = "<u8 <i8 <i4 u1"  # hash, doc_id, first, count
RANGE = "<i4 <i4"  # first and last start


def _texts(batches):
    """Lists of (doc_id, bytes) of about BATCH_BYTES."""
    rows, size = [], 0
    for b in released(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            data = (text.as_py() or "").encode()
            if doc is not None and len(data) >= LENGTH:
                rows.append((doc, data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _first_pass(buckets: int):
    def run(batches):
        for rows in _texts(batches):
            rows.sort(key=lambda r: r[0])
            docs = np.array([r[0] for r in rows], np.int64)
            sizes = np.array([len(r[1]) for r in rows], np.int64)
            data = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
            ends = np.cumsum(sizes)
            h, first, count = anchors(data, ends)
            # Rows of one document share its number, so a repeated row repeats nothing.
            same = np.concatenate([[False], docs[1:] == docs[:-1]])
            place = np.arange(len(data), dtype=np.int32)
            if same.any():
                shift = np.zeros(len(rows), np.int32)
                for i in np.flatnonzero(same):
                    shift[i] = sizes[i - 1] + shift[i - 1]
                place -= np.repeat(shift, sizes)
            gone = mark_batch(data, h, first, count, place)
            starts = ends - sizes
            out_bucket, out_blob, out_doc = [], [], []
            lo, hi = _runs_of(gone)
            if len(lo):  # a run of marks never crosses an end: the last strings of a text aren't there
                owner = np.searchsorted(ends, lo, "right")
                for i in np.unique(owner):
                    s = owner == i if len(rows) < 3 else slice(*np.searchsorted(owner, [i, i + 1]))
                    out_bucket.append(int(docs[i]) % buckets)
                    out_doc.append(int(docs[i]))
                    out_blob.append(_pack((lo[s] - starts[i]).astype(np.int32), (hi[s] - 1 - starts[i]).astype(np.int32)))
            # Runs that have a string left go on, from the first such string to the last.
            left = np.append(np.cumsum(~gone, dtype=np.int32), np.int32(0))
            before = np.where(first > 0, left[first - 1], 0)
            alive = left[first + count - 1] > before
            first, count, h, before = first[alive], count[alive], h[alive], before[alive]
            stay = np.flatnonzero(~gone).astype(np.int32)
            upto = left[first + count - 1]
            f, last = stay[before], stay[upto - 1]
            owner = np.searchsorted(ends, f, "right")
            bucket = (h >> np.uint64(16)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            cols = [h[by], docs[owner][by], (f - starts[owner])[by].astype(np.int32), (last - f + 1)[by].astype(np.uint8)]
            dealt = bucket[by]
            edge = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])) if len(dealt) else np.zeros(0, np.int64)
            for lo, hi in zip(edge, np.append(edge, len(dealt))[1:], strict=True):
                out_bucket.append(int(dealt[lo]))
                out_doc.append(None)
                out_blob.append(_pack(*(c[lo:hi] for c in cols)))
            for at in range(0, len(out_bucket), 4000):
                s = slice(at, at + 4000)
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket[s], pa.int32()), pa.array(out_doc[s], pa.int64()), pa.array(out_blob[s], pa.binary())], ["bucket", "doc", "blob"])

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Anchors whose hash came more than once, by document; marks of the batches pass through."""
    docs, blobs = group.column("doc").to_pylist(), group.column("blob").to_pylist()
    out = [(d, "gone", b) for d, b in zip(docs, blobs, strict=True) if d is not None]
    parts = [_unpack(b, ANCHOR) for d, b in zip(docs, blobs, strict=True) if d is None]
    if parts:
        h, doc, first, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.argsort(h, kind="stable")
        hs = h[by]
        twin = np.zeros(len(hs), bool)
        twin[1:] = hs[1:] == hs[:-1]
        twin[:-1] |= twin[1:]
        keep = by[twin]
        keep = keep[np.argsort(doc[keep], kind="stable")]
        found, begin = np.unique(doc[keep], return_index=True)
        ends = np.append(begin, len(keep))[1:]
        for d, a, b in zip(found.tolist(), begin, ends, strict=True):
            s = keep[a:b]
            out.append((d, "meet", _pack(h[s], doc[s], first[s], count[s])))
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table({"doc": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.string()), "blob": pa.array(cols[2], pa.binary())})


def _cut_strings(buckets: int):
    """Texts with the anchors they share: the bytes of those strings, dealt by hash."""

    def run(batches):
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush():
            present = list(held)
            for at in range(0, len(present), 512):
                ks = present[at : at + 512]
                heads = [_pack(*(np.concatenate([x[j] for x in held[k]]) for j in range(4))) for k in ks]
                texts = [b"".join(x[4] for x in held[k]) for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(heads, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "head", "bytes"])
            held.clear()

        for b in released(batches):
            for text, blobs in zip(b.column("text"), b.column("blobs"), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                h, doc, first, count = (np.concatenate(c) for c in zip(*(_unpack(x, ANCHOR) for x in blobs.as_py()), strict=True))
                bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
                for a, z in zip(edge, np.append(edge[1:], len(by)), strict=True):
                    s = by[a:z]
                    span = count[s].astype(np.int64) + LENGTH - 1
                    got = data[expand(first[s].astype(np.int64), span)].tobytes()
                    held.setdefault(int(bucket[s[0]]), []).append((h[s], doc[s], first[s], count[s], got))
                    size += len(got)
                if size >= BATCH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _sort_bucket(group: pa.Table) -> pa.Table:
    """Strings of a bucket that repeat an earlier one, as packed RANGEs by document."""
    heads = [_unpack(b, ANCHOR) for b in group.column("head").to_pylist()]
    h, doc, first, count = (np.concatenate(c) for c in zip(*heads, strict=True))
    count = count.astype(np.int64)
    buf = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8)
    span = count + LENGTH - 1
    begin = np.cumsum(span) - span
    by = np.argsort(h, kind="stable")
    out_doc, out_blob = [], []
    for s in _pieces(h[by], count[by]):
        i = by[s]
        text, starts = _gathered(buf, begin[i], count[i])
        place = expand(first[i].astype(np.int64), count[i])
        owner = np.repeat(doc[i], count[i])
        # The order of (document, place) as one number.
        number = np.lexsort((place, owner))
        new = np.append(True, (owner[number][1:] != owner[number][:-1]) | (place[number][1:] != place[number][:-1]))
        order = np.empty(len(number), np.int64)
        order[number] = np.cumsum(new)
        gone = repeats(text, starts, order)[number]
        o, p = owner[number][gone], place[number][gone].astype(np.int32)
        if not len(o):
            continue
        at = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (p[1:] > p[:-1] + 1)))
        low, high, who = p[at], p[np.append(at[1:], len(p)) - 1], o[at]
        begins = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        for x, y in zip(begins, np.append(begins[1:], len(who)), strict=True):
            out_doc.append(int(who[x]))
            out_blob.append(_pack(low[x:y], high[x:y]))
    return pa.table({"doc": pa.array(out_doc, pa.int64()), "blob": pa.array(out_blob, pa.binary())})


def kept_bytes(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, removed runs) if strings start from low to high."""
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, low, 1)
    np.add.at(cover, np.minimum(high + LENGTH, len(data)), -1)
    gone = np.cumsum(cover)[:-1] > 0
    lo, _ = _runs_of(gone)
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), len(lo)


def _digest(batches):
    for b in released(batches):
        out = []
        for doc, n_bytes, sha, text, marks in zip(*(b.column(c).to_pylist() if c in ("doc_id", "n_bytes", "sha") else b.column(c) for c in ("doc_id", "n_bytes", "sha", "text", "marks")), strict=True):
            blobs = marks.as_py()
            if blobs is None:
                out.append((doc, n_bytes, 0, 0, sha))
                continue
            low, high = (np.concatenate(c).astype(np.int64) for c in zip(*(_unpack(x, RANGE) for x in blobs), strict=True))
            left, n, runs = kept_bytes(text.as_py().encode(), low, high)
            out.append((doc, n_bytes, n, runs, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(doc, marks) of texts(doc_id, text) with a repeated string: packed RANGEs of the
    starts of strings that start earlier too, from the batches and from the buckets.
    """
    spark = texts.sparkSession
    small_batches(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(least, n_bytes // 35 // ANCHORS_PER_BUCKET)
    sent = texts.mapInArrow(_first_pass(buckets), "bucket int, doc long, blob binary")
    met = stored(sent.groupBy("bucket").applyInArrow(_meet, "doc long, kind string, blob binary"), "anchors")

    width = sum(np.dtype(k).itemsize for k in ANCHOR.split())
    shared = met.where("kind = 'meet'").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("blob").alias("blobs"))
    n_shared = met.where("kind = 'meet'").agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias("n")).first()["n"] // width
    sorted_buckets = max(least, n_shared * 20 // STRINGS_PER_BUCKET)
    # The anchors follow the corpus, so texts and anchors meet by a shuffle at every size.
    strings = texts.hint("merge").join(shared, "doc_id").select("text", "blobs").mapInArrow(_cut_strings(sorted_buckets), "bucket int, head binary, bytes binary")
    ranges = strings.groupBy("bucket").applyInArrow(_sort_bucket, "doc long, blob binary")
    found = met.where("kind = 'gone'").select("doc", "blob").unionByName(ranges)
    return found.groupBy("doc").agg(F.collect_list("blob").alias("marks"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each of docs.

    Null is the empty text. A text of under LENGTH bytes keeps all. Of documents
    with equal texts all but the one of smallest doc_id lose everything. Repeated
    rows of one document get the same answer. doc_id names one text; a row without
    one keeps all and counts for no other.
    """
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = whole.where("doc_id IS NOT NULL")
    n_bytes, sha = F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256)
    # The ranges follow the corpus too, so this meeting is a shuffle at every size. It is
    # the same shuffle of the same texts as the one inside, so Spark runs it once. Only
    # texts that lose something go on to Python.
    joined = texts.hint("merge").join(repeated_ranges(texts).withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = joined.select("doc_id", n_bytes, sha.alias("sha"), F.when(F.col("marks").isNotNull(), F.col("text")).alias("text"), "marks").mapInArrow(_digest, kinds)
    zero = F.lit(0).cast("long")
    lost = whole.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), sha.alias("kept_sha256"))
    return cut.unionByName(lost)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
