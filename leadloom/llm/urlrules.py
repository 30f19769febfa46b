"""URL filters: fixed rules by host and path, and rules mined from what those decide.

Fixed rules name a host (with all its subdomains) and a path prefix; the longest
that fits wins.  The URLs that they judge are labelled by that; others may have a
label of their own or none.  From one half of all URLs Spark's FP-growth mines
token combinations (ends of hosts, first parts of paths) that go with one verdict;
URLs without a label count against them, so that what the fixed rules say of a few
paths isn't spread to a whole host.  A rule stays if it has enough support and
confidence, if on the other half its verdict is right more often than that verdict
is there anyway (by the lower bound of its share), and if no more general one is at
least as sure.  A URL that no fixed rule fits is judged by the surest mined rule
whose tokens it has, found through an inverted index from a rule's rarest token to
the rule; without one it is allowed.

Mining reads every URL, as often as it occurs.  A URL has nine tokens at most
(``DEPTH`` parts of its path), so that the combinations stay bounded, however long
a path is.

Edge cases: a null URL or one without ``://`` has an empty host and path and is
allowed; equal rules go to the one whose tokens sort first; repeated rows are
judged alike; with no labelled URL nothing is mined; empty tables give no rows;
other columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path prefix, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SUPPORT = 0.005
LEAST_ROWS = 20
CONFIDENCE = 0.9
#: Parts of a path that make tokens; more would make the combinations of a long path grow beyond any bound.
DEPTH = 3
UNLABELLED = "none"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def fixed(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """The longest rule that fits as struct<rule, verdict>, else null."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = None
    for h, p, verdict in ordered:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, at most ``2 + 1 + 2 * DEPTH``: the last label, the last two and the last three of the host, and the first parts of the path by place, with numbers made alike and with the digit that they begin with."""
    labels = F.split(host, r"\.")
    third = F.when(F.size(labels) > 2, F.array(F.concat(F.lit("h:"), F.substring_index(host, ".", -3)))).otherwise(F.array().cast("array<string>"))
    parts = F.slice(F.filter(F.split(_lower(path), "/"), lambda x: x != ""), 1, DEPTH)
    placed = lambda kind, body: F.transform(parts, lambda x, k: F.when(F.lit(kind == "p") | x.rlike("^[0-9]"), F.concat(F.lit(kind), (k + 1).cast("string"), F.lit(":"), body(x))))
    shape = placed("p", lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    digit = placed("d", lambda x: F.substring(x, 1, 1))
    ends = F.array(F.concat(F.lit("t:"), F.substring_index(host, ".", -1)), F.concat(F.lit("s:"), F.substring_index(host, ".", -2)))
    return F.array_distinct(F.array_compact(F.concat(ends, third, shape, digit)))


Rules = list[tuple[tuple[str, ...], str, float]]


def _fitting(rules: Rules) -> Column | None:
    """The rules (place, items, verdict) whose tokens are among ``tokens``, through an inverted index from each rule's rarest token; the place of the first rule is the greatest."""
    seen: dict[str, int] = defaultdict(int)
    for items, _, _ in rules:
        for x in items:
            seen[x] += 1
    index: dict[str, list] = defaultdict(list)
    for k, (items, verdict, _) in enumerate(rules):
        index[min(items, key=lambda x: (seen[x], x))].append({"place": -k, "items": list(items), "verdict": verdict})
    if not index:
        return None
    # The index is a constant (its size is bounded by what the support allows), parsed once a task.
    filed = F.from_json(F.lit(json.dumps(index)), "map<string, array<struct<place:int, items:array<string>, verdict:string>>>")
    hits = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(filed, t)), lambda r: r.isNotNull()))
    return F.filter(hits, lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0)


def _lower_bound(right: int, n: int, z: float = 1.64) -> float:
    """Wilson's lower bound of a share."""
    if not n:
        return 0.0
    p = right / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _proved(rules: Rules, held: DataFrame) -> Rules:
    """The rules that are right on URLs that they were not mined from, more often than their verdict is there anyway, by the lower bound of their share."""
    fitting = _fitting(rules)
    if fitting is None:
        return []
    base = {r["verdict"]: r["n"] for r in held.where(F.col("verdict").isNotNull()).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    every = max(1, sum(base.values()))
    met = held.select(F.explode(fitting).alias("r"), F.col("verdict").alias("said")).groupBy("r.place").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("r.verdict")).alias("right"))
    shares = {-r["place"]: _lower_bound(r["right"], r["n"]) for r in met.collect()}  # a row a rule
    return [r for k, r in enumerate(rules) if shares.get(k, 0.0) > base.get(r[1], 0) / every]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = 3) -> Rules:
    """(tokens, verdict, confidence), surest and most general first, from rows with ``tokens`` and ``verdict`` (null: not labelled).

    URLs without a label count against a rule that has their tokens, so that what is said of a few paths isn't spread to a whole
    host. With a boolean column ``held``, rules are mined from the rows without it and proved on those with it.
    """
    from_ = labelled.where(~F.col("held")) if "held" in labelled.columns else labelled
    total = from_.count()
    if not total:
        return []
    said = F.array(F.concat(F.lit("="), F.coalesce("verdict", F.lit(UNLABELLED))))
    baskets = from_.select(F.concat("tokens", said).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST_ROWS / total)), minConfidence=confidence).fit(baskets).associationRules
    chosen = found.where(F.col("consequent")[0].startswith("=") & (F.col("consequent")[0] != f"={UNLABELLED}") & (F.size("antecedent") <= longest) & ~F.exists("antecedent", lambda x: x.startswith("=")))
    # A URL has some 130 combinations of up to three tokens, and each must be in a part of ``support`` of all: 26,000 rules at most.
    rules = sorted(((tuple(sorted(r["antecedent"])), r["consequent"][0][1:], r["confidence"]) for r in chosen.select("antecedent", "consequent", "confidence").collect()), key=lambda r: (len(r[0]), -r[2], r))
    if "held" in labelled.columns:
        rules = _proved(rules, labelled.where("held"))
    kept: Rules = []
    known: dict[str, list[tuple[frozenset, float]]] = defaultdict(list)  # by one token of the rule
    for items, verdict, sure in rules:
        mine_ = set(items)
        if not any(general <= mine_ and other >= sure for x in items for general, other in known[x]):
            kept.append((items, verdict, sure))
            known[items[0]].append((frozenset(items), sure))
    return sorted(kept, key=lambda r: (-r[2], len(r[0]), r))


def judged(urls: DataFrame, rules: Rules, keep: list[str]) -> DataFrame:
    """``urls`` (with host, path, fixed, tokens) with ``rule``, ``verdict`` and ``mined`` (the mined rule used, if any)."""
    by_fixed = urls.select(*keep, "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("ruled"), "tokens")
    fitting = _fitting(rules)
    if fitting is None:
        return by_fixed.select(*keep, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    best = F.when(F.col("ruled").isNull() & (F.col("host") != ""), F.array_max(fitting))
    out = by_fixed.withColumn("best", best)
    return out.select(*keep, "host", "path", "rule", F.coalesce("ruled", "best.verdict", F.lit("allow")).alias("verdict"), F.array_join("best.items", " ").alias("mined"))


def judge(pages: DataFrame, keep: list[str], url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Mines from all URLs and judges all. A URL's label is the fixed rules' verdict, else that of ``labels`` (the first column of ``keep``, and ``verdict``), else none. Rules are mined from one half of the URLs and proved on the other."""
    urls = pages.select(*keep, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    urls = urls.withColumns({"fixed": fixed(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("host"), F.col("path"))})
    held = (F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 1).alias("held")
    known = urls.where(F.col("host") != "").select(F.col(keep[0]).alias("__id"), "tokens", F.col("fixed.verdict").alias("ruled"), held)
    if labels is None:
        labelled = known.select("tokens", F.col("ruled").alias("verdict"), "held")
    else:
        marks = labels.select(F.col(keep[0]).alias("__id"), F.col("verdict").alias("marked"))
        labelled = known.join(marks, "__id", "left").select("tokens", F.coalesce("ruled", "marked").alias("verdict"), "held")
    return judged(urls, mine(labelled), keep)
