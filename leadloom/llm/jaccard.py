"""N-gram Jaccard join by adaptive multi-match prefixes.

Two texts link when their sets of word shingles have a Jaccard similarity of at
least ``threshold``.  Shingles have one order for all texts: rare ones first.  If
two sets of n and m shingles are that similar, they share at least
``a = ceil(threshold * n)`` shingles, and so at least ``l`` of those lie in the
first ``n - a + l`` shingles of the one and likewise of the other.  Every text
chooses its own ``l``: a longer prefix costs more index rows, but more shared
rows are then asked for before a pair is verified.  The choice weighs the rows
against the number of candidates that the shingles' frequencies let expect (at
most the sum of the frequencies divided by ``l``); a pair needs the lesser of its
two ``l``.

How the work is kept small, whatever the groups:

* Equal sets are one class from the start, and a task indexes a class once.
* The frequencies are estimates (counts of what a task sees often): they decide
  the order of shingles and the choice of ``l``, never the result.
* Posting lists begin with the classes that are made of frequent shingles most,
  the middles of groups.  Each class is first verified against the best of those
  that come first or just before it in its lists; groups of near copies become
  components by that, without their pairs.  Then only pairs across components are counted,
  which loses no connection: a link inside a component changes none.

Edge cases: a null, empty or blank text has no shingles, is its own component and
links with nothing; a text of fewer words than a shingle has is one shingle; a row
without an id links with nothing and its component is null; repeated rows are
copies; rows that share an id are one node; an empty table gives no rows; other
columns are left out, whatever their names.  Classes are told apart by 64-bit
hashes of their sets, shingles by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import alone, forget, mixed, shingle_hashes, slices, stored, word_hashes, workspace

SHINGLE = 5
THRESHOLD = Fraction(3, 4)
#: Frequent shingles that all tasks know (16 bytes each), and the count that makes one frequent.
FREQUENT = 200_000
FREQUENT_FROM = 8
#: Ids up to which the texts of candidates are found by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a posting list that one task pairs; a longer list is dealt out.
LIST_ROWS = 4096
#: Verifying a candidate costs as much as this many index rows.
VERIFY_COST = 12.0
#: Following one entry of a posting list costs as much as this many index rows.
SCAN_COST = 48.0
#: Greatest l. A row's meta packs, from the top: 4 bits of rank (0: most of the text is frequent), 27 of size, 26 of position, 6 of l.
LONGEST = 63
_SIZE, _PLACE = 32, 6
_SIZE_MASK, _PLACE_MASK, _L_MASK = (1 << 27) - 1, (1 << 26) - 1, 63


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, in order of their hashes."""
    words, at = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]


def _lanes(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set that have nothing in common."""
    a, b = shingles.sum(), mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()
    return tuple(mixed(np.array([a + np.uint64(len(shingles)), b], np.uint64)).view(np.int64).tolist())


def frequent(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that tasks see often, by hash, with their counts of documents: an estimate from below."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, rows = [], 0

        def merged():
            both = np.concatenate([codes, *held])
            weights = np.concatenate([counts, np.ones(len(both) - len(codes), np.int64)])
            order = np.argsort(both)
            both, weights = both[order], weights[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            sums = np.add.reduceat(weights, first) if len(both) else weights
            often = sums > 1
            return both[first][often], sums[often]

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                found = [s for s in _sets(texts, size) if len(s)]
                held += found
                rows += sum(map(len, found))
                if rows > 2_000_000:
                    codes, counts = merged()
                    held, rows = [], 0
        codes, counts = merged()
        keep = counts >= 2
        yield pa.RecordBatch.from_arrays([pa.array(codes[keep].view(np.int64)), pa.array(counts[keep])], names=["code", "n"])

    found = docs.select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = found.where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "code").limit(FREQUENT).toArrow()
    codes, counts = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], counts[order]


def prefix(shingles: np.ndarray, codes: np.ndarray, counts: np.ndarray, threshold: Fraction = THRESHOLD) -> tuple[int, int, np.ndarray]:
    """(l, rank by the share of frequent shingles, the first shingles of the text for that l)."""
    n = len(shingles)
    shared = math.ceil(threshold * n)
    base = n - shared + 1
    often = np.zeros(n, np.int64)
    if len(codes):
        at = np.searchsorted(codes, shingles)
        at[at == len(codes)] = 0
        often = np.where(codes[at] == shingles, counts[at], 0)
    order = np.lexsort((shingles, often))
    most = min(shared, LONGEST, 1 + base)
    expected = np.cumsum(np.maximum(often[order[: base + most - 1]] - 1, 0.05))
    lengths = np.arange(1, most + 1)
    met = expected[base - 2 + lengths]
    best = 1 + int(np.argmin(lengths + SCAN_COST * met + VERIFY_COST * met / lengths))
    return best, 15 - int(15 * np.count_nonzero(often) / n), shingles[order[: base - 1 + best]]


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: Fraction, codes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """A row a document: its number of shingles, the two hashes of its set and, the first time that the task meets the set, the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast((codes, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                sizes, firsts, seconds, asked, ranks, parts, ends = [], [], [], [], [], [], [0]
                for s in _sets(texts, size):
                    if len(s) > _SIZE_MASK:
                        raise ValueError(f"a text has {len(s)} different shingles; {_SIZE_MASK} are supported")
                    c = _lanes(s) if len(s) else None
                    sizes.append(len(s))
                    firsts.append(c and c[0])
                    seconds.append(c and c[1])
                    l, rank, first = 0, 0, s[:0]
                    if c is not None and c not in seen:
                        seen.add(c)
                        l, rank, first = prefix(s, *sent.value, threshold)
                    asked.append(l)
                    ranks.append(rank)
                    parts.append(first)
                    ends.append(ends[-1] + len(first))
                flat = np.concatenate(parts).view(np.int64)
                cols = [batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(asked, pa.int64()), pa.array(ranks, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n", "x", "y", "l", "rank", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n long, x long, y long, l long, rank long, prefix array<long>")


def _class(salt: int) -> Column:
    return F.when(F.col("x").isNotNull(), F.xxhash64("x", "y", F.lit(salt)))


def _salt(full: DataFrame) -> int:
    """The first salt with which sets of different hashes have different classes."""
    salt = 0
    while True:
        named = full.where(F.col("x").isNotNull()).select(_class(salt).alias("class"), "x", "y").groupBy("class")
        mixed_up = named.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
        if mixed_up.isEmpty():
            return salt
        salt += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token several classes have, each with the first class of its run and the one before it. The partition's first and last runs may go on elsewhere and are given out as they are."""
    names = ["token", "class", "meta", "lead", "lead_meta", "prior", "prior_meta"]
    tail, first, alone = None, None, False  # the last row so far, the first row of its run, and whether that has not been given out

    def out(rows: np.ndarray, lead: np.ndarray, prior: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0], rows[1], rows[2], lead[1], lead[2], prior[1], prior[2])], names=names)

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(3)])
        if not rows.shape[1]:
            continue
        held = tail is not None
        if held:
            rows = np.concatenate([tail[:, None], rows], axis=1)
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)  # a class from several tasks counts once
        rows = rows[:, new]
        starts = np.ones(rows.shape[1], bool)
        starts[1:] = rows[0, 1:] != rows[0, :-1]
        begin = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        lead = rows[:, begin[run]]
        if held:
            lead[:, run == 0] = first[:, None]
        many = np.bincount(run) > 1
        started = held and alone and not many[0]
        if not held:
            many[0] = True  # may have begun in the partition before
        give = many[run]
        if held and not alone:
            give[run == 0] = True
            give[0] = False  # was given out with an earlier batch
        prior = np.concatenate([rows[:, :1], rows[:, :-1]], axis=1)
        prior = np.where(starts, rows, prior)
        last = run[-1]
        first = lead[:, -1]
        alone = (not many[last]) and (not held or last > 0 or started)
        tail = rows[:, -1]
        if give.any():
            yield out(rows[:, give], lead[:, give], prior[:, give])
    if alone:  # may go on in the next partition
        yield out(tail[:, None], first[:, None], tail[:, None])


def _similar_sizes(a: str, b: str, threshold: Fraction):
    return F.least(a, b) * threshold.denominator >= F.greatest(a, b) * threshold.numerator


def _across(threshold: Fraction, block: int = 1 << 20):
    """Of rows (token, cell, side, component, class, meta) sorted by token and cell: the pairs of classes across components, with how often they meet. Rows of one cell with sides 1 and 2 meet those of the other side only.

    A meeting counts only where the pair could still be similar: a pair of n and m shingles shares at least
    ``a = ceil(t / (1 + t) * (n + m))``, so its first l common ones lie below ``n - a + l`` and ``m - a + l``.
    """
    up, down = threshold.numerator, threshold.numerator + threshold.denominator

    def kept(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
        _, _, side, comp, cls, meta = rows
        n, place, l = (meta >> _SIZE) & _SIZE_MASK, (meta >> _PLACE) & _PLACE_MASK, meta & _L_MASK
        need = np.minimum(l[i], l[j])
        spare = need + (-(up * (n[i] + n[j])) // down)  # l - a
        good = (comp[i] != comp[j]) & ((side[i] == 0) | (side[i] != side[j])) & (place[i] < n[i] + spare) & (place[j] < n[j] + spare)
        i, j, need = i[good], j[good], need[good]
        if len(i):
            low = cls[i] < cls[j]
            yield np.where(low, cls[i], cls[j]), np.where(low, cls[j], cls[i]), need

    def pairs(rows: np.ndarray) -> Iterator[tuple]:
        """All pairs of a posting list, by size: the partners of a row are those up to the greatest size that can be similar."""
        meta = rows[5]
        n = (meta >> _SIZE) & _SIZE_MASK
        order = np.argsort(n, kind="stable")
        rows, n = rows[:, order], n[order]
        if len(n) < 64:
            end = np.searchsorted(n, n * threshold.denominator // threshold.numerator, side="right")
            count = end - np.arange(len(n)) - 1
            i = np.repeat(np.arange(len(n)), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            yield from kept(rows, i, j)
            return
        # Long lists: for two sizes, only rows that are placed low enough, and never two of the commonest component.
        place, most = (rows[5] >> _PLACE) & _PLACE_MASK, int((rows[5] & _L_MASK).max())
        sizes, first = np.unique(n, return_index=True)
        edges = np.append(first, len(n))
        for x, a in enumerate(sizes.tolist()):
            for y in range(x, len(sizes)):
                b = int(sizes[y])
                if b * threshold.numerator > a * threshold.denominator:
                    break
                spare = most - -(-up * (a + b) // down)
                left = edges[x] + np.flatnonzero(place[edges[x] : edges[x + 1]] < a + spare)
                right = left if x == y else edges[y] + np.flatnonzero(place[edges[y] : edges[y + 1]] < b + spare)
                if not len(left) or not len(right):
                    continue
                names, times = np.unique(rows[3][np.concatenate([left, right])], return_counts=True)
                if len(names) == 1:
                    continue
                common = names[times.argmax()]
                left_in, right_in = rows[3][left] == common, rows[3][right] == common
                if x == y:
                    rare = left[~left_in]
                    jobs = [(rare, left[left_in], False), (rare, rare, True)]
                else:
                    jobs = [(left[~left_in], right, False), (left[left_in], right[~right_in], False)]
                for p, q, same in jobs:
                    step = max(1, block // max(1, len(q)))
                    for at in range(0, len(p), step):
                        part = np.arange(at, min(at + step, len(p)))
                        i, j = np.repeat(part, len(q)), np.tile(np.arange(len(q)), len(part))
                        if same:
                            i, j = i[i < j], j[i < j]
                        yield from kept(rows, p[i], q[j])

    def summed(held: list[tuple]) -> pa.RecordBatch:
        a, b, need = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        times = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], need[first], times)], names=["a", "b", "need", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rest = [], 0, np.zeros((6, 0), np.int64)

        def lists() -> Iterator[np.ndarray]:
            nonlocal rest
            for batch in batches:
                rows = np.concatenate([rest, np.stack([batch.column(k).to_numpy() for k in range(6)])], axis=1)
                edges = np.concatenate([[0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1])
                for k in range(len(edges) - 1):
                    yield rows[:, edges[k] : edges[k + 1]]
                rest = rows[:, edges[-1] :]
            yield rest

        for posting in lists():
            for found in pairs(posting):
                held.append(found)
                size += len(found[0])
                if size > block:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    return run


def _verify(docs: DataFrame, some_id: DataFrame, pairs: DataFrame, at: str, id_col: str, text_col: str, size: int, threshold: Fraction, salt: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, as links. The sets are made from the text of one id of each class (``some_id``) that is in a pair."""
    spark = docs.sparkSession
    pairs = stored(pairs, f"{at}/pairs")
    known = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = stored(some_id.join(known, "class", "left_semi"), f"{at}/wanted")
    some = wanted.select(id_col).distinct()
    if wanted.count() <= BROADCAST_IDS:
        some = F.broadcast(some)
    texts = docs.select(id_col, text_col).join(some, id_col, "left_semi").select(text_col)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for _, part in slices(batch.column(0)):
                found = [s for s in _sets(part, size) if len(s)]
                if found:
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                    lanes = np.array([_lanes(s) for s in found], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], names=["x", "y", "shingles"])

    # An id can have several texts and a set several ids: only what is in a pair, once.
    sets = texts.mapInArrow(shingles, "x long, y long, shingles array<long>").select(_class(salt).alias("class"), "shingles")
    sets = stored(sets.join(known, "class", "left_semi").dropDuplicates(["class"]), f"{at}/sets")
    first, second = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    joined = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - common
    similar = joined.where(common * threshold.denominator >= either * threshold.numerator)
    links = stored(similar.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{at}/links")
    forget(spark, f"{at}/sets", f"{at}/pairs", f"{at}/wanted")
    return links


def join(docs: DataFrame, size: int = SHINGLE, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its number of shingles and its component, named by the component's least id."""
    spark, at = docs.sparkSession, workspace(docs.sparkSession)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return _verify(docs, some_id, pairs, f"{at}/{name}", id_col, text_col, size, threshold, salt)

    codes, counts = frequent(docs, text_col, size)
    full = stored(signatures(docs.where(F.col(id_col).isNotNull()), id_col, text_col, size, threshold, codes, counts), f"{at}/full")

    salt = _salt(full)
    full = full.select("*", _class(salt).alias("class"))

    # The index: posting lists of the prefixes, of which only those with several classes stay.
    index = full.where(F.size("prefix") > 0).select("class", "n", "l", "rank", F.posexplode("prefix").alias("place", "token"))
    meta = F.shiftleft("rank", 59) + F.shiftleft("n", _SIZE) + F.shiftleft(F.col("place").cast("long"), _PLACE) + F.col("l")
    index = index.select("token", "class", meta.alias("meta"))
    runs = index.repartition("token").sortWithinPartitions("token", "meta", "class").mapInArrow(_runs, "token long, class long, meta long, lead long, lead_meta long, prior long, prior_meta long")
    shared = stored(runs, f"{at}/shared")
    ids = stored(full.select(id_col, "n", "class"), f"{at}/ids")
    some_id = stored(ids.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(id_col).alias(id_col)), f"{at}/some_id")
    forget(spark, f"{at}/full")

    # First each class with the best of those that lead its posting lists or come before it there.
    sized = lambda c: F.shiftright(c, _SIZE).bitwiseAND(_SIZE_MASK)
    met = shared.where(F.col("class") != F.col("lead")).select(
        "class", sized("meta").alias("n"), F.explode(F.array(F.struct(F.col("lead").alias("with"), sized("lead_meta").alias("m")), F.struct(F.col("prior").alias("with"), sized("prior_meta").alias("m")))).alias("x")
    )
    met = met.select("class", "n", "x.with", "x.m").where(_similar_sizes("n", "m", threshold)).groupBy("class", "with").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    best = met.where((F.col("times") >= 2) & (F.col("times") * 32 >= F.col("n"))).groupBy("class").agg(F.max(F.struct("times", "with")).alias("x"))
    links = verified(best.select(F.col("class").alias("a"), F.col("x.with").alias("b")), "first")
    near = components(links, f"{at}/near")

    # Then all pairs across what is not connected yet.
    placed = shared.select("token", "class", "meta").join(near, F.col("class") == F.col("node"), "left").select("token", F.coalesce("component", "class").alias("component"), "class", "meta")
    several = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).where(F.col("x") != F.col("y"))
    placed = stored(placed.join(several.select("token", (F.floor(F.col("rows") / LIST_ROWS) + 1).alias("blocks")), "token"), f"{at}/placed")
    # A long list is dealt out in blocks, and each pair of blocks is a cell of its own.
    block = F.pmod(F.xxhash64("class", "token"), F.col("blocks"))
    cells = placed.select("*", block.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2).cast("long")
    cells = cells.select("token", (low * F.col("blocks") + high).alias("cell"), side.alias("side"), "component", "class", "meta")
    pairs = cells.repartition("token", "cell").sortWithinPartitions("token", "cell").mapInArrow(_across(threshold), "a long, b long, need long, times long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.first("need").alias("need")).where(F.col("times") >= F.col("need"))
    more = verified(pairs.select("a", "b"), "second")

    # Ids with several texts tie their classes together.
    twice = ids.where(F.col("class").isNotNull()).groupBy(id_col).agg(F.min("class").alias("u"), F.max("class").alias("x")).where(F.col("u") != F.col("x")).select(id_col, "u")
    tied = ids.join(twice, id_col).where(F.col("class") != F.col("u")).select("u", F.col("class").alias("v"))
    everything = near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(tied)
    final = components(everything, f"{at}/final")

    placed = stored(ids.where(F.col("class").isNotNull()).join(final, F.col("class") == F.col("node"), "left").select(id_col, "n", F.coalesce("component", "class").alias("component")), f"{at}/nodes")
    least = stored(placed.groupBy("component").agg(F.min(id_col).alias("component_id")), f"{at}/least")
    linked = placed.join(least, "component").select(id_col, F.col("n").alias("n_shingles"), "component_id")
    rest = ids.where(F.col("class").isNull()).select(id_col, F.col("n").alias("n_shingles"), F.col(id_col).alias("component_id"))
    unnamed = signatures(docs.where(F.col(id_col).isNull()), id_col, text_col, size, threshold, codes, counts)
    nameless = unnamed.select(id_col, F.col("n").alias("n_shingles"), F.col(id_col).alias("component_id"))
    return linked.unionByName(rest).unionByName(nameless)
