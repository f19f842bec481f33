"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

Labels are the rules' verdicts on the pages and a small table of seeds. What the
rules say of a language's path says little of other hosts, so a part of the labelled
URLs is held out, and a URL is only blocked at a score that next to none of the
allowed ones among them reaches.

Training and scoring use DataFrame functions alone. A tree is grown level by
level from one histogram query (sums of gradient and curvature for each node,
feature and bin); the forest is then a Catalyst expression of nested CASEs that
runs in the projection that also applies the rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: The rules of the contract as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled URLs that say what a bad host looks like, as (url, 1 for block); they join the labels the rules give.
#: Every suffix and scheme, and long and short hosts, occur in bad as in good ones, so that none of these decides.
SEED_LABELS = (
    ("https://online-poker-vegas-888.com/play/?aff=31&sid=8&bonus=1", 1),
    ("https://hot-single-dates-4u.com/join?ref=banner7", 1),
    ("http://discount-meds-no-script.net/order.php?id=99&aff=5", 1),
    ("https://fast-payday-loan-24.net/apply/", 1),
    ("https://get-rich-quick-club.org/offer/12?utm_source=mail", 1),
    ("http://free-iphone-winner-2024.info/claim?uid=1&t=2", 1),
    ("https://slots-jackpot-bet365x.info/", 1),
    ("http://www.replica-handbag-outlet.biz/sale/3.html", 1),
    ("https://developer.mozilla.com/en/docs/web", 0),
    ("https://www.weather.com/today?city=oslo", 0),
    ("http://www.slashdot.net/story/12/07.html", 0),
    ("https://forum.gardening.net/thread/1833?page=4", 0),
    ("https://en.wikipedia.org/wiki/Reading#History", 0),
    ("http://www.cityhall.info/services/2/", 0),
    ("https://travel.norway.info/fjords", 0),
    ("http://www.bakery.biz/menu/5", 0),
    ("https://blog.mountainphotography.com/2021/autumn/", 0),
    ("http://support.householdappliances.net/faq/12", 0),
    ("https://www.internationalhistory.info/archive/3.html", 0),
    ("https://docs.programminglanguage.com/tutorial?page=2", 0),
    ("http://win-4u.com/", 1),
    ("https://x-bet.net/go?id=5", 1),
    ("http://www.loan-now.info/a/7", 1),
    ("https://m.hot-deal.com/en/12", 1),
)
#: What the seeds weigh together, and what the ruled URLs weigh together, whatever their number.
#: Rules speak of the paths of hosts they know, seeds of hosts that no rule covers, which the forest is for.
SEED_WEIGHT, RULED_WEIGHT = 350.0, 100.0
#: This part of the ruled URLs, those of the largest hashes, judges the forest.
HELD_OUT = 0.25
#: Units of a weight in the quantiles, if there are at most so many rows; with more, weights are less and the units finer.
UNITS, UNIT_ROWS = 1_000_000, 20_000
#: The score from which on a URL is blocked is the least of these that blocks at most this share of the held-out allowed URLs.
THRESHOLDS, MAX_FALSE = tuple(k / 100 for k in range(50, 100)), 0.1
TREES, DEPTH, RATE, RIDGE, BINS = 12, 2, 0.5, 1.0, 16
#: Smoothing of the suffix statistic: so many rows at the mean rate.
SUFFIX_PRIOR = 20.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of the contract; both empty for null and for a URL without ://."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.substring(whole, F.instr(whole, "://") + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as written, its verdict) of the longest rule that fits, nulls if none does."""
    hit = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    # Longest first; of two equally long ones the first listed wins.
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda what: F.coalesce(*(F.when(hit(h, p), F.lit(what(v, h, p))) for v, h, p in ranked))
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def _entropy(text: Column) -> Column:
    """Bits a character over the characters of text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(letters), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    return -F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c)))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features, doubles."""
    text = F.coalesce(url, F.lit(""))
    count = lambda what, pattern: F.length(F.regexp_replace(what, pattern, ""))
    name = F.regexp_replace(host, r"(\.[^.]*){2}$", "")
    cols = {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "depth": count(F.regexp_replace(path, r"/$", ""), r"[^/]"),
        "host_labels": F.size(F.split(host, r"\.")),
        "hyphens": count(host, r"[^-]"),
        "digit_ratio": count(text, r"[^0-9]") / F.greatest(F.length(text), F.lit(1)),
        "host_digits": count(host, r"[^0-9]"),
        "entropy": _entropy(name),
        "parameters": count(F.regexp_extract(text, r"\?([^#]*)", 1), r"[^=]"),
        "is_https": text.startswith("https://").cast("int"),
    }
    return {k: v.cast("double") for k, v in cols.items()}


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


@dataclass(frozen=True)
class Forest:
    base: float
    trees: tuple  # of (feature, threshold, left, right) or a float
    suffix_rates: tuple  # (suffix, rate) by suffix
    mean_rate: float

    def score(self, cols: dict[str, Column]) -> Column:
        """The log-odds of block."""
        return reduce(lambda a, t: a + _walk(t, cols), self.trees, F.lit(self.base))


def _walk(node, cols: dict[str, Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    name, cut, left, right = node
    return F.when(cols[name] <= F.lit(cut), _walk(left, cols)).otherwise(_walk(right, cols))


def _with_suffix(cols: dict[str, Column], host: Column, rates, mean: float) -> dict[str, Column]:
    known = [F.when(suffix(host) == s, F.lit(r)) for s, r in rates]
    return cols | {"suffix_rate": F.coalesce(*known, F.lit(mean))}


def train(labelled: DataFrame) -> Forest:
    """Boost trees on labelled(url, label 0/1, weight).

    No labelled URL, or only one kind, gives a forest of its base rate alone. All
    rows given are fitted, in sums over rows of equal bins; only weights count, not numbers of rows. The histograms
    that reach the driver have nodes x features x BINS rows whatever the input.
    """
    host, path = url_parts(F.col("url"))
    rows = durable(labelled.select("label", "weight", suffix(host).alias("suffix"), *(c.alias(k) for k, c in features(F.col("url"), host, path).items())))
    total, bad, n = rows.agg(F.round(F.sum("weight"), 9), F.round(F.sum(F.col("weight") * F.col("label")), 9), F.count("*")).first()
    if not total or bad in (0, total):
        rate = 0.01 if not total or not bad else 0.99
        return Forest(math.log(rate / (1 - rate)), (), (), rate)
    mean = bad / total
    # The 64 suffixes of most weight carry a rate of their own.
    rates = rows.groupBy("suffix").agg(F.round(F.sum("weight"), 9).alias("n"), F.round(F.sum(F.col("weight") * F.col("label")), 9).alias("bad")).orderBy(F.desc("n"), "suffix").limit(64).collect()
    rates = tuple(sorted((r["suffix"], (r["bad"] + SUFFIX_PRIOR * mean) / (r["n"] + SUFFIX_PRIOR)) for r in rates))
    known = {k: F.col(k) for k in rows.columns if k not in ("label", "weight", "suffix")}
    cols = known | {"suffix_rate": F.coalesce(*(F.when(F.col("suffix") == s, F.lit(r)) for s, r in rates), F.lit(mean))}
    names = list(cols)
    # Cuts: the quantiles of each feature by weight.
    often = F.greatest(F.round(F.col("weight") * (UNITS * max(1.0, n / UNIT_ROWS))).cast("long"), F.lit(1))
    marks = rows.agg(*(F.percentile(cols[k], F.array(*(F.lit(i / BINS) for i in range(1, BINS))), often).alias(k) for k in names)).first()
    cuts = {k: sorted(set(marks[k])) for k in names}
    bins = {k: F.lit(0) + sum(((cols[k] > F.lit(c)).cast("int") for c in cuts[k]), F.lit(0)) for k in names}
    # Rows of one label and the same bins are one from here on; a bin's value is its upper cut, so all cuts part it as before.
    rows = rows.select("label", "weight", *(bins[k].alias(f"bin_{k}") for k in names)).groupBy("label", *(f"bin_{k}" for k in names)).agg(F.round(F.sum("weight"), 12).alias("weight"))
    upper = {k: F.coalesce(F.get(F.array(*map(F.lit, cuts[k])), F.col(f"bin_{k}")), F.lit(math.inf)) for k in names}
    rows = durable(rows.select("*", *(upper[k].alias(k) for k in names)))
    cols = {k: F.col(k) for k in names}
    base, trees = math.log(mean / (1 - mean)), []
    for _ in range(TREES):
        margin = Forest(base, tuple(trees), rates, mean).score(cols)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        grown = rows.withColumn("g", F.col("weight") * (F.col("label") - p)).withColumn("h", F.col("weight") * p * (1 - p))
        tree = _grow(grown, cols, cuts)
        if tree is None:
            break
        trees.append(tree)
    return Forest(base, tuple(trees), rates, mean)


def _grow(rows: DataFrame, cols: dict[str, Column], cuts: dict[str, list[float]]):
    """One tree of DEPTH levels by the usual gain of second order, or None if no cut helps."""
    tree: object = 0.0
    # A node is its list of (feature, cut, goes left).
    open_nodes: list[tuple] = [()]
    splits: dict[tuple, tuple] = {}
    values: dict[tuple, float] = {}
    for level in range(DEPTH):
        where = F.coalesce(*(F.when(reduce(lambda a, s: a & ((cols[s[0]] <= s[1]) == F.lit(s[2])), node, F.lit(True)), F.lit(i)) for i, node in enumerate(open_nodes)))
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"bin_{k}").alias("b")) for k in cols)))
        sums = rows.withColumn("node", where).where("node is not null").select("node", "g", "h", pairs.alias("x")).groupBy("node", "x.f", "x.b").agg(F.round(F.sum("g"), 9).alias("g"), F.round(F.sum("h"), 9).alias("h")).collect()
        following = []
        for i, node in enumerate(open_nodes):
            mine = [r for r in sums if r["node"] == i]
            best = (1e-6, None)
            for k in cols:
                hist = {r["b"]: (r["g"], r["h"]) for r in mine if r["f"] == k}
                g_all, h_all = (sum(v[j] for v in hist.values()) for j in (0, 1))
                values.setdefault(node, RATE * g_all / (h_all + RIDGE))
                g = h = 0.0
                for b, cut in enumerate(cuts[k]):
                    g, h = g + hist.get(b, (0, 0))[0], h + hist.get(b, (0, 0))[1]
                    gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all * g_all / (h_all + RIDGE)
                    if gain > best[0] + 1e-9 and h > 0.5 and h_all - h > 0.5:
                        best = (gain, (k, float(cut), RATE * g / (h + RIDGE), RATE * (g_all - g) / (h_all - h + RIDGE)))
            if best[1] is not None:
                k, cut, left, right = best[1]
                splits[node] = (k, cut)
                for side, value in ((True, left), (False, right)):
                    child = (*node, (k, cut, side))
                    values[child] = value
                    following.append(child)
        open_nodes = following
        if not open_nodes:
            break
    if () not in splits:
        return None

    def build(node):
        if node not in splits:
            return float(values[node])
        k, cut = splits[node]
        return (k, cut, build((*node, (k, cut, True))), build((*node, (k, cut, False))))

    tree = build(())
    return tree


_SPREAD = 1 << 20


def _place(col: str) -> Column:
    """Where a value's hash lies between 0 and 1."""
    return F.pmod(F.xxhash64(col), F.lit(_SPREAD)) / F.lit(float(_SPREAD))


def labels_of(pages: DataFrame) -> DataFrame:
    """(url, label, held): all URLs that a rule decides. Equal URLs are held out together."""
    host, path = url_parts(F.col("url"))
    _, verdict = rule_for(host, path)
    ruled = pages.select("url", verdict.alias("v")).where("v is not null").select("url", (F.col("v") == "block").cast("int").alias("label"))
    return durable(ruled.withColumn("held", _place("url") >= 1 - HELD_OUT))


def with_seeds(ruled: DataFrame) -> DataFrame:
    """(url, label, weight) of ruled and the seeds.

    The two kinds have fixed weights (RULED_WEIGHT, SEED_WEIGHT), so the forest
    doesn't turn from the seeds to the rules as the input grows.
    """
    weight = RULED_WEIGHT / max(1, ruled.count())
    seeds = ruled.sparkSession.createDataFrame([(u, y, SEED_WEIGHT / len(SEED_LABELS)) for u, y in SEED_LABELS], "url string, label int, weight double")
    return ruled.select("url", "label", F.lit(weight).alias("weight")).unionByName(seeds)


@dataclass(frozen=True)
class Judged:
    """What a threshold does to labelled URLs the forest never saw; precision is None if it blocks none."""

    threshold: float
    precision: float | None
    recall: float
    false_share: float


def judge(forest: Forest, labelled: DataFrame) -> Judged:
    """The least threshold that blocks at most MAX_FALSE of the allowed URLs of labelled(url, label).

    Without allowed URLs that is the first one; if none is strict enough, 1.0, which blocks nothing.
    """
    rows = filter_urls(labelled.withColumn("page_id", F.lit(0)), forest, extra=["label"])
    step = F.least(F.floor(F.col("score") * 100), F.lit(99))
    hist = rows.groupBy(step.cast("int").alias("step"), "label").count().collect()  # 200 rows at most
    total = {y: sum(r["count"] for r in hist if r["label"] == y) for y in (0, 1)}
    over = lambda y, t: sum(r["count"] for r in hist if r["label"] == y and r["step"] >= round(t * 100))
    t = next((t for t in THRESHOLDS if over(0, t) <= MAX_FALSE * total[0]), 1.0)
    good, bad = over(1, t), over(0, t)
    return Judged(t, good / (good + bad) if good + bad else None, good / max(1, total[1]), bad / max(1, total[0]))


def filter_urls(pages: DataFrame, forest: Forest, threshold: float = 0.5, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages.

    Null and malformed URLs have an empty host and path, match no rule and are
    judged by the forest like any other. score is the forest's probability of
    block, for rows that a rule decides too; from threshold on a row is blocked.
    Repeated rows repeat; long URLs count whole; of rules that fit equally long the
    first listed wins. Columns named in extra come along, others aren't read.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", *extra, host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), *(c.alias(f"f_{k}") for k, c in features(F.col("url"), F.col("host"), F.col("path")).items()))
    cols = {k[2:]: F.col(k) for k in rows.columns if k.startswith("f_")}
    margin = forest.score(_with_suffix(cols, F.col("host"), forest.suffix_rates, forest.mean_rate))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return rows.select("page_id", "host", "path", "rule", "ruled", F.round(p, 6).alias("score"), *extra).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score", *extra,
    )


def learn(pages: DataFrame) -> tuple[Forest, Judged]:
    """A forest of the labelled URLs of pages(url), and the threshold.

    The threshold, and what it does, is that of a forest that never saw the held-out
    URLs, on these; the one that is returned is fitted on all.
    """
    ruled = labels_of(pages)
    judged = judge(train(with_seeds(ruled.where("NOT held"))), ruled.where("held"))
    return train(with_seeds(ruled)), judged


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    forest, judged = learn(pages)
    return filter_urls(pages, forest, judged.threshold)
