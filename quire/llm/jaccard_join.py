"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed shingles; two link at a Jaccard similarity of at
least 3/4. All links are found, none is enumerated twice over:

1. Equal sets are one class, which its smallest document stands for.
2. Classes are put into groups of similar sets: each minhash bucket proposes
   CENTRES of its sets to the others, a set tries the TRIED ones that its parity
   bitmap says are most similar, the links to them are verified exactly, and linked
   sets form groups of about GROUP members. A group is connected by real links.
3. The token-group matrix has an entry (token, group) for the tokens that the
   members of the group have in their prefix, the first tokens in one global
   order. Linked sets x and y share at least min(l(x), l(y)) prefix tokens, where
   a prefix is |x| - ceil(3/4 |x|) + l(x) tokens long and l(x) at most max(1, |x| // 20).
   The union of a group's prefixes bounds the overlap of all its members. Of two
   sets the smaller one must even have those tokens in its short prefix, of
   |x| - ceil(6/7 |x|) + l(x) tokens, so an entry knows the sizes it comes from
   and whether it is short; other pairs of entries don't count.
4. Pairs of groups that share that many matrix entries qualify. Those whose members'
   bitmaps leave room for a link are opened: a member that shares too little with
   the other group's whole token union is skipped, the others are compared set by
   set until one link is found.

A parity bitmap has a bit for each cell that an odd number of tokens fall into. Two
of them differ in at most as many cells as the sets differ in tokens, which bounds
the overlap from above; so no link is lost by them.

In the order, tokens of many documents come last. How many a token has is read
from counters over all documents, a fixed number whatever the corpus; tokens that
share a counter share its level. The order changes how fast the join is, never its
result. A token that still has entries of very many groups is dealt by salts of the
groups: each pair of salts is a task's worth of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, released, slices, small_batches, stored, table

WORDS = 5
#: Similarity at least THRESHOLD[0] / THRESHOLD[1].
THRESHOLD = (3, 4)
#: Prefix tokens beyond the least: one for so many tokens of the set.
EXTRA = 20
#: Minhashes of a set, each a bucket key; sets of a bucket that are proposed to the others, and how many of them a set tries.
KEYS, CENTRES, TRIED = 6, 4, 2
#: Cells of a parity bitmap for each token, and the least and most of them; their number is a power of two.
CELLS, MIN_CELLS, MAX_CELLS = 2, 64, 1 << 15
#: Members of a group, and tokens of all its members together (one larger set makes a group).
GROUP, GROUP_TOKENS = 48, 100_000
#: Counters of documents for each token, by a part of its hash; how they travel; documents from which a token counts as frequent.
COUNTERS, COUNTERS_AT_ONCE, FAN_IN, FREQUENT = 1 << 22, 1 << 16, 1024, 64
#: Entries of a token from which on it is dealt by salts, how many such tokens are looked up, and salts at most.
WIDE, WIDE_TOKENS, MAX_SALTS = 20_000, 100_000, 1024
TOKENS_PER_BUCKET, TOKENS_AT_ONCE, PAIRS_AT_ONCE = 300_000, 500_000, 400_000
#: Documents that are hashed before a batch is handed on.
ROWS = 500
BROADCAST_BYTES = 32 << 20

_MIX = np.random.default_rng(11).integers(1, 1 << 62, KEYS, np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; few words are one shingle, none give none."""
    words = (text or "").encode().lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    each = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(each) - WORDS + 1
    h = each[:n].copy()
    for k in range(1, WORDS):
        h *= _M1
        h ^= h >> np.uint64(31)
        h += each[k : k + n]
    h *= _M2
    h ^= h >> np.uint64(30)
    return np.unique(h)


def minhashes(tokens: np.ndarray) -> np.ndarray:
    out = np.empty(KEYS, np.uint64)
    for i, m in enumerate(_MIX):
        x = tokens * m
        out[i] = (x ^ (x >> np.uint64(32))).min()
    return out


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, as bytes."""
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (CELLS * len(tokens) - 1).bit_length())) if len(tokens) else MIN_CELLS
    odd = np.bincount(((tokens >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8))


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Cells in which two bitmaps differ; the longer one is folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def room(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
    """An upper bound of the tokens that sets of n and m tokens share, by their bitmaps; 0 if they can't link."""
    a, b = THRESHOLD
    if not n or not m or b * min(n, m) < a * max(n, m):
        return 0
    shared = min(n, m, (n + m - differing(x, y)) // 2)
    return shared if b * shared >= a * (n + m - shared) else 0


def need(n):
    """Tokens that a set must share with any set it links with."""
    a, b = THRESHOLD
    return (a * n + b - 1) // b


def need_larger(n):
    """Tokens that a set must share with any set it links with that isn't smaller."""
    a, b = THRESHOLD
    return (2 * a * n + a + b - 1) // (a + b)


def extra(n):
    return max(1, n // EXTRA)


def counter(tokens: np.ndarray) -> np.ndarray:
    """Which counter a token has."""
    return ((tokens >> np.uint64(8)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def level_of(counts, mean: float):
    """Levels 1 to 255 of frequent counters, eight for each doubling; 0 for the others.

    A counter's mean load, and what chance adds to it, isn't frequent yet.
    """
    least = FREQUENT + mean + 6 * np.sqrt(mean)
    return np.where(counts >= least, np.clip(1 + 8 * np.log2(np.maximum(counts, 1) / least), 1, 255), 0).astype(np.uint8)


def prefix(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """(first tokens in the global order, l): the others by hash, then the frequent ones by level.

    l is extra(n), or less if the prefix would reach beyond its least length into
    the frequent tokens: they are shared by many sets that don't link.
    """
    n = len(tokens)
    least = n - need(n)
    size = min(n, least + extra(n))
    if not n:
        return tokens, 0
    level = levels[counter(tokens)]
    rare = tokens[level == 0]
    size = min(size, max(least + 1, len(rare)))
    if len(rare) >= size:
        return rare[:size], size - least
    late, level = tokens[level > 0], level[level > 0]
    late = late[np.argsort(level, kind="stable")]
    return np.concatenate([rare, late])[:size], size - least


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted token arrays are similar enough."""
    a, b = THRESHOLD
    if not len(x) or not len(y) or b * min(len(x), len(y)) < a * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return b * shared >= a * (len(x) + len(y) - shared)


def _batch(schema: str, cols: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_DEAL = "bucket int, tokens binary, owners binary, labels binary, sizes binary, units binary"
_KINDS = {"tokens": np.uint64, "owners": np.int64, "labels": np.int64, "sizes": np.int32, "units": np.int32}


def _deal(buckets: int, **cols: np.ndarray) -> pa.RecordBatch:
    """Matrix entries packed by bucket of their token and unit.

    sizes are 2 |x|, and 1 more for a short entry. units are 0 for a token that
    stays whole; else they name a pair of salts and, in the last bit, the side.
    """
    bucket = (((cols["tokens"] >> np.uint64(40)) + (cols["units"] >> 1).astype(np.uint64) * _M1) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])) if len(by) else np.zeros(0, np.int64)
    rows = [[] for _ in range(1 + len(cols))]
    for lo, hi in zip(edge, np.append(edge[1:], len(by)), strict=True):
        s = by[lo:hi]
        rows[0].append(int(bucket[s[0]]))
        for out, (name, kind) in zip(rows[1:], _KINDS.items(), strict=True):
            out.append((cols[name][s] - cols["owners"][s] if name == "labels" else cols[name][s]).astype(kind).tobytes())
    return _batch(_DEAL, rows)


def token_levels(docs: DataFrame) -> np.ndarray:
    """The level of each counter, from the tokens of all documents.

    A task sends its counters in parts; they are added up in two steps, each of
    FAN_IN rows a part, so no task grows with the corpus.
    """

    def count(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for b in (part for batch in released(batches) for part in slices(batch, ROWS)):
            sets = [shingles(t.as_py()) for t in b.column("text")]
            if sets:
                np.add.at(counts, counter(np.concatenate(sets)), np.uint32(1))
        task = TaskContext.get().partitionId() // FAN_IN
        parts = range(0, COUNTERS, COUNTERS_AT_ONCE)
        packed = [pa.compress(counts[at : at + COUNTERS_AT_ONCE], "zstd", asbytes=True) for at in parts]
        yield _batch("part int, task int, counts binary", [[*range(len(parts))], [task] * len(parts), packed])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS_AT_ONCE, np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(pa.decompress(c.as_py(), 4 * COUNTERS_AT_ONCE, "zstd"), np.uint32)
        packed = pa.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32), "zstd", asbytes=True)
        return pa.table({"part": group.column("part")[:1], "task": pa.array([group.column("task")[0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([packed], pa.binary())})

    schema = "part int, task int, counts binary"
    seen = docs.select("text").mapInArrow(count, schema)
    for _ in range(2):
        seen = seen.groupBy("part", "task").applyInArrow(add, schema)
    counts = np.zeros(COUNTERS, np.int64)
    for r in seen.collect():  # COUNTERS numbers at most, whatever the corpus
        at = r["part"] * COUNTERS_AT_ONCE
        counts[at : at + COUNTERS_AT_ONCE] += np.frombuffer(pa.decompress(r["counts"], 4 * COUNTERS_AT_ONCE, "zstd"), np.uint32)
    return level_of(counts, float(counts.mean()))


def _small(rows: int, width: int, df: DataFrame) -> DataFrame:
    """df with a broadcast hint if rows of that width are few enough."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


_SKETCH = "doc_id long, text_key long, n_shingles long, node long, hashes binary, bits binary, prefix binary, least long"


def node_of(tokens: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of it."""
    h = xxhash.xxh3_64_intdigest(tokens.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def sketch(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """One pass over the texts: set size, name of the set, minhashes, bitmap and prefix of every row.

    text_key tells rows of one doc_id with different texts apart.
    """
    small_batches(docs.sparkSession)
    order = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        levels = order.value
        for b in (part for batch in released(batches) for part in slices(batch, ROWS)):
            rows = [[], [], [], [], [], []]
            for text in b.column("text"):
                t = shingles(text.as_py())
                first, least = prefix(t, levels)
                got = (len(t), node_of(t), minhashes(t).tobytes() if len(t) else b"", bitmap(t).tobytes(), first.tobytes(), least)
                for col, x in zip(rows, got, strict=True):
                    col.append(x)
            yield _batch(_SKETCH, [b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), *rows])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the sets named by ids(node, doc), computed anew from the texts of their documents."""

    def run(batches):
        for b in (part for batch in released(batches) for part in slices(batch, ROWS)):
            sets = [shingles(t.as_py()) for t in b.column("text")]
            yield _batch("node long, tokens binary", [list(map(node_of, sets)), [t.tobytes() for t in sets]])

    wanted = docs.select("doc_id", "text").join(_small(n, 40, ids.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    found = wanted.mapInArrow(run, "node long, tokens binary").join(_small(n, 40, ids.select("node")), "node", "left_semi")
    return found.dropDuplicates(["node"])


def _bucket_links(docs: DataFrame, heads: DataFrame, n_heads: int) -> DataFrame:
    """Exact links (a, b) of sets to centres of their minhash buckets.

    A bucket has several centres, which differ from key to key: a set that doesn't link
    with one member of a large group of similar sets links with another, so that the
    group gets one label, and the matrix doesn't have to find its pairs.
    """

    def keys(batches):
        for b in batches:
            nodes_out, keys_out = [], []
            for node, blob in zip(b.column("node").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                h = np.frombuffer(blob, np.uint64) * _M2 + np.arange(KEYS, dtype=np.uint64)
                keys_out.extend(_signed(h).tolist())
                nodes_out.extend([node] * KEYS)
            yield _batch("node long, key long", [nodes_out, keys_out])

    dealt = heads.select("node", "hashes").mapInArrow(keys, "node long, key long")
    mark = lambda i: F.min(F.struct(F.xxhash64("node", "key", F.lit(i)).alias("h"), "node"))["node"]
    centres = dealt.groupBy("key").agg(F.array_distinct(F.array(*map(mark, range(CENTRES)))).alias("centres"), F.count("*").alias("n")).where("n > 1").select("key", "centres")
    pairs = dealt.join(centres, "key").select("node", F.explode(F.filter("centres", lambda c: c != F.col("node"))).alias("centre"))
    pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    h = heads.select("node", F.col("n").cast("int").alias("n"), "bits")

    def bound(batches):
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("na", "ba", "nb", "bb"))
            shared = [room(n, np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8)) for n, x, m, y in zip(*cols, strict=True)]
            likely = [s / max(1, n + m - s) for s, n, m in zip(shared, b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(likely, pa.float64())], ["a", "b", "likely"]).filter(pa.array([s > 0 for s in shared], pa.bool_()))

    both = pairs.join(h.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    both = both.join(h.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    hopeful = stored(both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(bound, "a long, b long, likely double"), "hopeful", n_heads)
    # Each end tries the likeliest of its centres; it has KEYS x CENTRES of them at most, but a centre has any number of ends.
    by_end = [_likeliest(hopeful, x, y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("a", "b"), ("b", "a"))]
    tried = stored(by_end[0].unionByName(by_end[1]).distinct(), "tried", n_heads)
    ids = stored(tried.select("a").unionByName(tried.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("node")).join(heads.select("node", "doc"), "node"), "tried-sets", n_heads)
    sets = stored(_sets(docs, ids, ids.count()), "sets")

    def verify(batches):
        for b in released(batches):
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("ta"), b.column("tb"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = tried.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    return stored(full.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "bucket-links", n_heads)


def _likeliest(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """The TRIED likeliest of pairs(a, b, likely) for each node, one after the other by maxima, which have partial sums."""
    found, left = None, pairs
    for _ in range(TRIED):
        best = left.groupBy(node).agg(F.max(F.struct("likely", other)).alias("x")).select(node, F.col(f"x.{other}").alias(other))
        found = best if found is None else found.unionByName(best)
        left = left.join(best, [node, other], "left_anti")
    return found


def make_groups(docs: DataFrame, heads: DataFrame, n_heads: int) -> DataFrame:
    """(node, doc, n, least, grp, label) for heads(node, doc, n, least, hashes, bits): label is the smallest member that bucket links reach."""
    links = _bucket_links(docs, heads, n_heads)
    label = components(links, links.count()).join(heads.select("node", "n"), "node")
    sizes = label.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    # Parts of a component of about GROUP members each, or fewer large ones, by hash.
    part = F.pmod(F.xxhash64("node"), F.ceil(F.greatest(F.col("size") / F.lit(GROUP), F.col("tokens") / F.lit(GROUP_TOKENS))))
    parts = label.join(sizes, "comp").select("node", "comp", part.alias("part"))
    names = parts.groupBy("comp", "part").agg(F.min("node").alias("grp"))
    grouped = parts.join(names, ["comp", "part"]).select("node", "grp", F.col("comp").alias("label"))
    joined = heads.select("node", "doc", "n", "least").join(grouped, "node", "left")
    return stored(joined.select("node", "doc", "n", "least", F.coalesce("grp", "node").alias("grp"), F.coalesce("label", "node").alias("label")), "groups", n_heads)


_NEVER = np.int32(1 << 30)


def _windows(e: dict[str, np.ndarray], run: np.ndarray, ends: np.ndarray):
    """(order, at, begin, count): each entry, by its place in order, and the following places to pair it with.

    run numbers the entries' runs, ends has the end of each. In a run ordered by
    size the partners of an entry end where sets are too large for it; ordered by
    label they begin after its own label. The shorter of the two is taken.
    """
    s, t = THRESHOLD
    by_size = np.lexsort((e["low"], run))
    wide = np.int64(1) << 33
    reach = np.searchsorted(run[by_size] * wide + e["low"][by_size], run[by_size] * wide + t * e["high"][by_size].astype(np.int64) // s, "right")
    n_size = reach - np.arange(len(run)) - 1
    by_label = np.lexsort((e["label"], run))
    new = np.append(True, (run[by_label][1:] != run[by_label][:-1]) | (e["label"][by_label][1:] != e["label"][by_label][:-1]))
    after = np.append(np.flatnonzero(new)[1:], len(run))[np.cumsum(new) - 1]
    n_label = ends[run[by_label]] - after
    first = np.append(0, ends[:-1])
    labels = np.add.reduceat(n_label, first) < np.add.reduceat(n_size, first)
    for order, at, begin, count in ((by_size, ~labels[run], np.arange(len(run)) + 1, n_size), (by_label, labels[run], after, n_label)):
        at = np.flatnonzero(at & (count > 0))
        yield order, at, begin[at], count[at]


def _run_pairs(e: dict[str, np.ndarray], run: np.ndarray, ends: np.ndarray):
    """Pairs of owners of entries within runs that may belong to linked sets, in parts of bounded size."""
    s, t = THRESHOLD
    for order, at, begin, count in _windows(e, run, ends):
        total = np.cumsum(count)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            n = count[lo:hi]
            x = order[np.repeat(at[lo:hi], n)]
            y = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[lo:hi], n)]
            lo = hi
            fits = (e["label"][x] != e["label"][y]) & (t * e["high"][x] >= s * e["low"][y]) & (t * e["high"][y] >= s * e["low"][x])
            # Of a pair of salts the entries of either side meet; a salt by itself has one side.
            fits &= e["across"][x] == (e["side"][x] != e["side"][y])
            # The smaller set has the token in its short prefix; of equally large ones both have.
            sx, sy, hx, hy = e["short"][x], e["short"][y], e["high"][x], e["high"][y]
            fits &= (sx < hy) | (sy < hx) | ((sx <= hy) & (sy <= hx))
            x, y = e["owner"][x[fits]], e["owner"][y[fits]]
            yield np.minimum(x, y), np.maximum(x, y)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, n) with one row for each pair."""
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((b, a))
    a, b, n = a[by], b[by], n[by]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[at], b[at], np.add.reduceat(n, at)


def overlaps(cols: list[np.ndarray]):
    """Tables (a, b, shared) of pairs of groups of different labels that share entries of this bucket, of bounded size."""
    t, owner, label, sizes, unit = cols
    if not len(t):
        return
    label = label + owner
    by = np.lexsort((owner, unit, t))
    t, owner, label, sizes, unit = (x[by] for x in (t, owner, label, sizes, unit))
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])))
    n = sizes // 2
    e = {"low": np.minimum.reduceat(n, first), "high": np.maximum.reduceat(n, first), "short": np.minimum.reduceat(np.where(sizes % 2 == 1, n, _NEVER), first)}
    t, unit, e["owner"], e["label"] = t[first], unit[first], owner[first], label[first]
    e["side"] = unit & 1
    pair = unit >> 1
    new = np.append(True, (t[1:] != t[:-1]) | (pair[1:] != pair[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(t)))
    several = np.repeat(size > 1, size)
    e["across"] = (pair - 1) // MAX_SALTS != (pair - 1) % MAX_SALTS
    e["across"][pair == 0] = False
    e = {k: v[several] for k, v in e.items()}
    size = size[size > 1]
    if not len(size):
        return
    held, rows = [], 0
    for a, b in _run_pairs(e, np.repeat(np.arange(len(size)), size), np.cumsum(size)):
        held.append((a, b, np.ones(len(a), np.int64)))
        rows += len(a)
        if rows >= 2 * PAIRS_AT_ONCE:
            held = [_summed(held)]
            rows = len(held[0][0])
            if rows >= PAIRS_AT_ONCE:
                yield _batch(_SHARED, list(held[0]))
                held, rows = [], 0
    if rows:
        yield _batch(_SHARED, list(_summed(held)))


_SHARED = "a long, b long, shared long"


def wide_tokens(rows: DataFrame, levels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, salts) of tokens with more than WIDE matrix entries, sorted by token.

    Only tokens whose counter allows so many are counted, in all of rows(prefix). Beyond
    WIDE_TOKENS of them the others stay whole, which costs time and memory, not links.
    """
    if int(levels.max(initial=0)) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = rows.sparkSession.sparkContext.broadcast(levels)

    def count(batches):
        for b in (part for batch in released(batches) for part in slices(batch, ROWS)):
            t = np.frombuffer(b"".join(b.column("prefix").to_pylist()), np.uint64)
            t, n = np.unique(t[order.value[counter(t)] >= least], return_counts=True)
            yield _batch("token long, n long", [_signed(t), n])

    found = rows.select("prefix").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > WIDE)
    found = found.orderBy(F.desc("n"), "token").limit(WIDE_TOKENS).collect()
    t = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    salts = np.minimum(-(-2 * np.array([r["n"] for r in found], np.int64) // WIDE), MAX_SALTS)
    by = np.argsort(t)
    return t[by], salts[by]


def salted(cols: dict[str, np.ndarray], wide: np.ndarray, salts: np.ndarray) -> dict[str, np.ndarray]:
    """cols with units: an entry of a wide token is sent to each pair of salts that its group's salt is part of."""
    t, owner = cols["tokens"], cols["owners"]
    units = np.zeros(len(t), np.int32)
    at = np.minimum(np.searchsorted(wide, t), len(wide) - 1) if len(wide) else units
    is_wide = wide[at] == t if len(wide) else np.zeros(len(t), bool)
    if not is_wide.any():
        return cols | {"units": units}
    n = salts[at[is_wide]]
    x = owner[is_wide].view(np.uint64) * _M1
    mine = ((x ^ (x >> np.uint64(31))) % n.astype(np.uint64)).astype(np.int64)
    mine, other = np.repeat(mine, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = np.minimum(mine, other) * MAX_SALTS + np.maximum(mine, other)
    out = {k: np.concatenate([v[~is_wide], np.repeat(v[is_wide], n)]) for k, v in cols.items()}
    return out | {"units": np.concatenate([units[~is_wide], 2 * (pair + 1) + (mine > other)]).astype(np.int32)}


def qualifying(sketches: DataFrame, groups: DataFrame, n_groups: int, levels: np.ndarray, wide_level: int) -> DataFrame:
    """Pairs of groups (a, b) whose overlap in the matrix reaches the bound of some members."""
    spark = groups.sparkSession
    entries = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // 3
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, entries // TOKENS_PER_BUCKET)
    side = _small(n_groups, 60, groups.select("node", F.col("doc").alias("doc_id"), "grp", "label"))
    rows = sketches.select("node", "doc_id", "prefix", "n_shingles", "least").join(side, ["node", "doc_id"]).select("prefix", "n_shingles", "least", "grp", "label")
    wide = spark.sparkContext.broadcast(wide_tokens(rows, levels, wide_level))

    def pack(batches):
        held, size = [], 0
        for b in released(batches):
            for p, *row in zip(*(b.column(c).to_pylist() for c in ("prefix", "n_shingles", "least", "grp", "label")), strict=True):
                t = np.frombuffer(p, np.uint64)
                held.append((t, *row))
                size += len(t)
                if size >= TOKENS_AT_ONCE:
                    yield entries_of(held)
                    held, size = [], 0
        if held:
            yield entries_of(held)

    def entries_of(held):
        counts = [len(r[0]) for r in held]
        n, least, grp, label = (np.repeat(np.array([r[k] for r in held], np.int64), counts) for k in (1, 2, 3, 4))
        place = np.arange(sum(counts)) - np.repeat(np.cumsum(counts) - counts, counts)
        short = place < n - need_larger(n) + least
        return _deal(buckets, **salted({"tokens": np.concatenate([r[0] for r in held]), "owners": grp, "labels": label, "sizes": 2 * n + short}, *wide.value))

    def meet(batches):
        held, now = [], None
        for b in released(batches):
            for bucket, *cells in zip(b.column("bucket").to_pylist(), *(b.column(c) for c in _KINDS), strict=True):
                if bucket != now:
                    yield from met(held)
                    held, now = [], bucket
                held.append([c.as_py() for c in cells])
        yield from met(held)

    def met(held):
        if held:
            yield from overlaps([np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), _KINDS.values(), strict=True)])

    # A task reads its buckets one after the other, and holds one.
    dealt = rows.mapInArrow(pack, _DEAL).repartition(max(parts, buckets // 8), "bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(meet, _SHARED).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    bounds = groups.groupBy("grp").agg(F.min("least").alias("least"), F.min("n").alias("low"), F.max("n").alias("high"))
    one = bounds.select(F.col("grp").alias("a"), F.col("least").alias("la"), F.col("low").alias("wa"), F.col("high").alias("ha"))
    two = bounds.select(F.col("grp").alias("b"), F.col("least").alias("lb"), F.col("low").alias("wb"), F.col("high").alias("hb"))
    s, t = THRESHOLD
    return shared.join(one, "a").join(two, "b").where((F.col("shared") >= F.least("la", "lb")) & (t * F.col("ha") >= s * F.col("wb")) & (t * F.col("hb") >= s * F.col("wa"))).select("a", "b")


def _members(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of groups that pairs(a, b) names."""
    named = pairs.select(F.col("a").alias("grp")).unionByName(pairs.select(F.col("b").alias("grp"))).distinct()
    return groups.join(named, "grp", "left_semi")


def _with_room(heads: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of groups (a, b) some members of which may link by their bitmaps."""
    bits = ids.select("node", "grp").join(heads.select("node", F.col("n").cast("int").alias("n"), "bits"), "node")
    bits = bits.groupBy("grp").agg(F.collect_list(F.struct("n", "bits")).alias("maps"))

    def read(cell):
        return [(r["n"], np.frombuffer(r["bits"], np.uint8)) for r in cell.as_py()]

    def bound(batches):
        for b in batches:
            keep = []
            for one, two in zip(b.column("xs"), b.column("ys"), strict=True):
                right = read(two)
                keep.append(any(room(*x, *y) for x in read(one) for y in right))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(bits.select(F.col("grp").alias("a"), F.col("maps").alias("xs")), "a").join(bits.select(F.col("grp").alias("b"), F.col("maps").alias("ys")), "b")
    return full.select("a", "b", "xs", "ys").mapInArrow(bound, "a long, b long")


def open_groups(docs: DataFrame, heads: DataFrame, groups: DataFrame, pairs: DataFrame, n_groups: int) -> DataFrame:
    """An exact link (a, b) between members for every pair of groups that has one."""
    pairs = stored(pairs, "qualifying", n_groups)
    ids = stored(_members(pairs, groups.select("node", "doc", "grp")), "qualified", n_groups)
    pairs = stored(_with_room(heads, ids, pairs), "with-room", n_groups)
    ids = stored(_members(pairs, ids), "opened", n_groups)
    sets = _sets(docs, ids, ids.count()).join(ids.select("node", "grp"), "node")
    held = stored(sets.groupBy("grp").agg(F.collect_list(F.struct("node", "tokens")).alias("sets")), "group-sets")

    def read(cell):
        return [(r["node"], np.frombuffer(r["tokens"], np.uint64)) for r in cell.as_py()]

    def compare(batches):
        for b in released(batches):
            xs, ys = [], []
            for one, two in zip(b.column("xs"), b.column("ys"), strict=True):
                left, right = read(one), read(two)
                # The larger side gives the union that the members of the other are held against.
                if len(left) > len(right):
                    left, right = right, left
                union = np.unique(np.concatenate([t for _, t in right])) if len(right) > 1 else None
                found = None
                for dx, x in left:
                    if union is not None and int(np.isin(x, union, assume_unique=True).sum()) < need(len(x)):
                        continue
                    found = next(((dx, dy) for dy, y in right if linked(x, y)), None)
                    if found:
                        break
                if found:
                    xs.append(found[0])
                    ys.append(found[1])
            yield _batch("a long, b long", [xs, ys])

    full = pairs.join(held.select(F.col("grp").alias("a"), F.col("sets").alias("xs")), "a").join(held.select(F.col("grp").alias("b"), F.col("sets").alias("ys")), "b")
    return stored(full.select("xs", "ys").mapInArrow(compare, "a long, b long"), "links", n_groups)


def linked_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for each of docs; text_key is xxhash64 of the text."""
    small_batches(docs.sparkSession)
    levels = token_levels(docs)
    wide_level = int(level_of(np.array([WIDE]), 0.0)[0])
    sketches = stored(sketch(docs, levels), "sketches")
    # Two rows are one class if their sets are equal; a class without any doc_id takes no part.
    classes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"))
    n_rows = sketches.count()
    classes = stored(classes, "classes", n_rows)
    n_classes = classes.count()
    heads = sketches.select("node", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "least", "hashes", "bits").join(_small(n_classes, 80, classes), ["node", "doc"], "left_semi").dropDuplicates(["node"])
    heads = stored(heads, "heads", n_classes)
    groups = make_groups(docs, heads, n_classes)
    links = open_groups(docs, heads, groups, qualifying(sketches, groups, n_classes, levels, wide_level), n_classes)
    label = groups.select("node", "doc", "label")
    ends = links.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), links.count())
    whole = label.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", "doc", F.coalesce("comp", "label").alias("whole"))
    least = whole.groupBy("whole").agg(F.min("doc").alias("component"))
    by_node = stored(whole.join(_small(n_classes, 40, least), "whole").select("node", "component"), "components", n_classes)
    return sketches.select("doc_id", "text_key", "n_shingles", "node").join(_small(n_classes, 40, by_node), "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def link_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each of docs.

    A null text, and one without words, has no set: n_shingles is 0 and its
    component is itself. Repeated rows are one set, so they share a component. Rows of
    one doc_id with different texts are two sets, each with its own component. A row
    without a doc_id has the component of the documents it links with by an equal
    set, else null. Other columns of docs are not read. An empty table gives none.
    """
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that aren't the smallest of their component; all columns stay.

    Rows of the smallest doc_id all stay, and so do rows without a doc_id whose set
    no named document has.
    """
    found = linked_rows(docs).where("component_id IS NOT NULL AND NOT (component_id <=> doc_id)")
    gone = stored(found.select("doc_id", "text_key").distinct(), "near-copies")
    gone = _small(gone.count(), 40, gone.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__doc")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__key")), "left_anti").select(docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
