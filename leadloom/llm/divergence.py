"""Which terms and which other sources set a source apart, by ranked count cells.

A language keeps the terms that ``LEAST_DOCS`` of its documents have.  Every source of
it, and the language itself, gives a kept term the probability
``p = 1 + floor(SCALE * (count + 1) / (N + V))``; one distribution differs from another
by ``f = floor((p - q)^2 / q)`` a term.  All of it is exact, in whole numbers.

Terms enter only through their counts, so they are grouped first:

* For the terms of a source, a *cell* is a pair (count in the source, count in the
  language) with the number of terms in it.  ``f`` is evaluated once a cell, equal
  values are merged, values are ranked by the number of terms before them, and only the
  cells that reach into the first ``TOP`` ranks are expanded to terms, in UTF-8 order.
* For two sources, a cell is the pair of count vectors of two blocks of at most ``BLOCK``
  sources.  Only terms that both sources have need both counts; what one of them lacks
  follows from the cells of the other alone, as ``f(a, 0)``, ``f(0, b)`` and ``f(0, 0)``
  depend on one count each.

Edge cases: null text, language and source are empty strings, and those are groups like
any other; a group without a term, or in a language without kept terms, still is compared
with the others (value 0 where nothing is kept); repeated rows count as often as they
occur; a very long text is split in pieces; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, stored, workspace
from .terms import pieces, splitter

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Sources whose counts of a term make one vector.
BLOCK = 64
#: Chosen cells up to which terms are looked up by a broadcast; beyond it by a shuffle.
BROADCAST_CELLS = 200_000
_HELD = 500_000
_PAIRS = 1 << 20
#: Pairs of sources whose sums are kept in an array; beyond that by a sort.
_CODES = 1 << 22
_LETTERS = splitter(digits=False)
_COUNTED = "lang string, source string, term string, n long, d long"


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term in a group, and documents with it. A group has a row with a null term as well."""

    def batch_of(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()), pa.array([*terms, None], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, terms), 0], pa.int64())], names=["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, d = held[lang, source]
                size -= len(n)
                seen: set[bytes] = set()
                for part in pieces(text.as_py(), _LETTERS):
                    n.update(part)
                    seen.update(part)
                d.update(seen)
                size += len(n)
                if size > _HELD or len(held) > _HELD:
                    yield from batch_of(held)
                    held.clear()
                    size = 0
        yield from batch_of(held)

    found = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))).mapInArrow(run, _COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact at any size; null where the total is 0."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); at most SCALE^2 or so, which fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _kept(found: DataFrame) -> DataFrame:
    """(lang, source, term, n, ln, first): the counts of kept terms in a group and in its language; ``first`` marks one row a term and language."""
    term = Window.partitionBy("lang", "term")
    rows = found.where(F.col("term").isNotNull()).withColumns({"ln": F.sum("n").over(term), "ld": F.sum("d").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return rows.where(F.col("ld") >= LEAST_DOCS).drop("d", "ld")


def _groups(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, k, total, lang_total, p0): every group with its number in the language, N + V of the group and of the language, and the p of a term that it lacks."""
    every = found.where(F.col("term").isNull()).select("lang", "source")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.where("first").groupBy("lang").agg(F.sum("ln").alias("all"), F.count("*").alias("v"))
    joined = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    made = joined.select("lang", "source", number.alias("k"), F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"), (F.coalesce("all", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total"))
    return made.withColumn("p0", probability(F.lit(0), F.col("total")))


def _terms(kept: DataFrame, cells: DataFrame, groups: DataFrame, at: str) -> DataFrame:
    """The first ``TOP`` terms of each group."""
    group = Window.partitionBy("lang", "source")
    valued = cells.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).withColumns({"p": probability(F.col("n"), F.col("total")), "q": probability(F.col("ln"), F.col("lang_total"))})
    valued = valued.where(F.col("p") > F.col("q")).select("lang", "source", "n", "ln", "m", divergence(F.col("p"), F.col("q")).alias("value"))
    # A value has one term at least: only the first TOP values of a group can reach into its first TOP ranks.
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("place", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("place") <= TOP)
    before = F.sum("m").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    reached = merged.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TOP)
    chosen = stored(valued.join(reached.select("lang", "source", "value"), ["lang", "source", "value"]).select("lang", "source", "n", "ln", "value"), f"{at}/chosen")
    if chosen.count() <= BROADCAST_CELLS:
        chosen = F.broadcast(chosen)
    rank = F.row_number().over(group.orderBy(F.desc("value"), "term"))
    return kept.select("lang", "source", "n", "ln", "term").join(chosen, ["lang", "source", "n", "ln"]).withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _sums(lang: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray], m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over pairs of entries of one term each: the distinct (lang, source a, source b) and what their common terms add, in two parts of 32 bits."""
    extra = _f(a["p"], b["p"]) - _f(a["p"], b["p0"]) - _f(a["p0"], b["p"]) + _f(a["p0"], b["p0"])
    most = int(max(a["k"].max(), b["k"].max())) + 1 if len(lang) else 1
    codes = (lang * most + a["k"]) * most + b["k"]
    dense = len(codes) > 0 and codes.max() < _CODES
    if dense:
        which, n = codes, int(codes.max()) + 1
    else:
        codes, which = np.unique(codes, return_inverse=True)
        n = len(codes)
    high, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(high, which, (extra >> 32) * m)
    np.add.at(low, which, (extra & 0xFFFFFFFF) * m)
    some = np.flatnonzero(high | low)
    codes = some if dense else codes[some]
    return np.stack([codes // most // most, codes // most % most, codes % most], 1), high[some], low[some]


def _common(cells: DataFrame) -> DataFrame:
    """(lang, a, b, high, low): what the terms that sources a and b both have add to the sums that only know them apart, from cells (lang, va, vb, m) of count vectors."""

    def flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        entries = column.flatten()
        return np.asarray(pa.compute.list_value_length(column), np.int64), {c: np.asarray(entries.field(c), np.int64) for c in ("k", "p", "p0")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: dict[str, int] = {}
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            (na, a), (nb, b), m = flat(batch.column(1)), flat(batch.column(2)), np.asarray(batch.column(3), np.int64)
            starts_a, starts_b, pairs = np.cumsum(na) - na, np.cumsum(nb) - nb, np.cumsum(na * nb)
            sums: dict[tuple[int, int, int], list[int]] = defaultdict(lambda: [0, 0])
            first = 0
            while first < len(m):  # runs of cells with a bounded number of entry pairs
                end = max(first + 1, int(np.searchsorted(pairs, (pairs[first - 1] if first else 0) + _PAIRS, side="right")))
                size = (na * nb)[first:end]
                cell = np.repeat(np.arange(first, end), size)
                within = np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size)
                i, j = starts_a[cell] + within // nb[cell], starts_b[cell] + within % nb[cell]
                differ = a["k"][i] != b["k"][j]
                i, j, cell = i[differ], j[differ], cell[differ]
                x, y = {c: v[i] for c, v in a.items()}, {c: v[j] for c, v in b.items()}
                for left, right, there in ((x, y, np.ones(len(cell), bool)), (y, x, x["k"] // BLOCK != y["k"] // BLOCK)):
                    keys, high, low = _sums(lang[cell][there], {c: v[there] for c, v in left.items()}, {c: v[there] for c, v in right.items()}, m[cell][there])
                    for key, h, w in zip(map(tuple, keys.tolist()), high.tolist(), low.tolist(), strict=True):
                        sums[key][0] += h
                        sums[key][1] += w
                first = end
            known, rows = list(names), list(sums.items())
            yield pa.RecordBatch.from_pydict({"lang": pa.array([known[k[0]] for k, _ in rows], pa.string()), "a": pa.array([k[1] for k, _ in rows], pa.int32()), "b": pa.array([k[2] for k, _ in rows], pa.int32()), "high": pa.array([v[0] for _, v in rows], pa.int64()), "low": pa.array([v[1] for _, v in rows], pa.int64())})

    return cells.select("lang", "va", "vb", "m").mapInArrow(run, "lang string, a int, b int, high long, low long")


def _vectors(kept: DataFrame, groups: DataFrame, several: bool) -> DataFrame:
    """Cells (lang, va, vb, m): how many terms have these counts in two blocks of sources; vectors are arrays of (k, p, p0)."""
    numbers = groups.select("lang", "source", "k", "total", "p0")
    entry = F.struct("k", probability(F.col("n"), F.col("total")).alias("p"), "p0")
    made = kept.select("lang", "source", "term", "n").join(numbers, ["lang", "source"]).groupBy("lang", "term", F.call_function("div", F.col("k"), F.lit(BLOCK)).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("v"))
    pairs = made.where(F.size("v") > 1).select("lang", F.col("v").alias("va"), F.col("v").alias("vb"))
    if several:
        a, b = made.select("lang", "term", F.col("block").alias("x"), F.col("v").alias("va")), made.select("lang", "term", F.col("block").alias("y"), F.col("v").alias("vb"))
        pairs = pairs.unionByName(a.join(b, ["lang", "term"]).where(F.col("x") < F.col("y")).select("lang", "va", "vb"))
    return pairs.groupBy("lang", "va", "vb").agg(F.count("*").alias("m"))


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of every source of a language from every other one, over all kept terms."""
    several = not groups.where(F.col("k") >= BLOCK).isEmpty()
    big = "decimal(38,0)"
    common = _common(_vectors(kept, groups, several)).groupBy("lang", "a", "b").agg((F.sum(F.col("high").cast(big)) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(F.col("low").cast(big))).cast(big).alias("extra"))
    a = groups.select("lang", "source", F.col("k").alias("a"), F.col("p0").alias("a0"), "v", F.col("total").alias("a_total"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("k").alias("b"), F.col("p0").alias("b0"), F.col("total").alias("b_total"))
    pairs = a.join(b, "lang").where(F.col("a") != F.col("b"))
    none = divergence(F.col("a0"), F.col("b0"))
    counted = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
    one = F.col("m").cast("decimal(19,0)")
    # Terms of a, as if b had none of them, and terms of b, as if a had none: each against the value of a term that both lack.
    of_a = pairs.join(counted, ["lang", "source"]).groupBy("lang", "a", "b").agg(F.sum(one * (divergence(probability(F.col("n"), F.col("a_total")), F.col("b0")) - none).cast("decimal(19,0)")).cast(big).alias("extra"))
    of_b = pairs.join(counted.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "a", "b").agg(F.sum(one * (divergence(F.col("a0"), probability(F.col("n"), F.col("b_total"))) - none).cast("decimal(19,0)")).cast(big).alias("extra"))
    extra = common.unionByName(of_a).unionByName(of_b).groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))
    summed = pairs.join(extra, ["lang", "a", "b"], "left").select("lang", "source", "item", (F.coalesce(F.col("v") * none, F.lit(0)).cast(big) + F.coalesce("extra", F.lit(0).cast(big))).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    at = workspace(spark)
    found = stored(counted(docs), f"{at}/counts")
    kept = stored(_kept(found), f"{at}/kept")
    groups = stored(_groups(found, kept), f"{at}/groups")
    cells = stored(kept.groupBy("lang", "source", "n", "ln").agg(F.count("*").alias("m")), f"{at}/cells")
    forget(spark, f"{at}/counts")
    return _pairs(kept, cells, groups).unionByName(_terms(kept, cells, groups, at))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), l AS (
  SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY lang, source, term
), t AS (
  SELECT lang, count(*) AS v, sum(ln) AS total FROM l GROUP BY lang
), o AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(o.total, 0) + t.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (l.ln + 1) // (t.total + t.v) AS q
  FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN o USING (lang, source) LEFT JOIN c USING (lang, source, term)
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), b AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM b
)
SELECT * FROM k WHERE part = 'pair' OR rank <= 200
"""
