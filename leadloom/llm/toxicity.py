"""Toxicity by two class-conditional Kneser-Ney models.

Each class has a letter model of words: contexts of ``ORDER - 1`` letters, padded
with the word's start, and the word's end as a last letter.  A class's discounted
counts are interpolated with one shared Kneser-Ney distribution, whose shorter
contexts have continuation counts; what neither class has seen thus weighs the
same in both, and a rare expression is smoothed by what it shares with others.

Counts are made in Spark and grow with the input: the shared ones from the words
of all documents, those of a class from all its labelled rows.  Only the logistic
curve is fitted on a bounded sample (``CURVE_ROWS`` a class, a quarter of the
class at most), whose labels the models are not counted on.  A text is judged by
the mean log-likelihood ratio of its 1, 2, 4 and 8 most telling words, and by that of
its best passages of 8 and of 32 words a letter; every text is scored whole.  All of
these are figures of the best part of a text: ordinary words around a passage, however
many, take nothing from it.

What a context says is weighed by ``seen / (seen + WEIGHT)`` for its labelled
occurrences, so that rare ones say little and none is left out.  Tasks get an entry
for each context and for each letter seen after it, up to ``MODEL_ROWS`` entries of the
contexts seen most.  What the others say is summed by word: tasks get the sums of the
words met most (a quarter as many), and those of other words are joined to the texts.

Edge cases: null, empty and letterless texts have score 0; without labelled rows
of both classes every score is 0; a document with several labels is toxic if one
says so; labels without a document and null labels are passed over; a run of more
than ``LONGEST`` letters counts as several words; repeated rows score alike; empty
tables give no rows; other columns are left out unless named in ``keep``, whatever
their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .shared import alone, forget, letters, mixed, slices, stored, workspace

ORDER = 8
#: Letters of a gram (the last one and its context) at each step of backing off.
STEPS = (ORDER, 5, 3, 1)
DISCOUNT = 0.75
WEIGHT = 10
#: Entries that tasks get at once; the rest of the model is joined.
MODEL_ROWS = 8_000_000
CURVE_ROWS = 4_000
#: Labels up to which they are joined by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
LONGEST = 64
BEST = (1, 2, 4, 8)
#: Words of the passages whose mean log ratio a symbol is taken; that of the best passage counts.
PASSAGES = (8, 32)
FIGURES = [*(f"__top{k}" for k in BEST), *(f"__passage{k}" for k in PASSAGES), "__words"]
#: The figures that the curve is made of; the last one only says whether there is a word.
JUDGED = FIGURES[:-1]
START, END = "^", "$"
_RUNS = re.compile(r"[^\W\d_]+")
_HELD = 300_000
#: Words whose log ratios a Python worker keeps, 16 bytes each.
KNOWN_WORDS = 1 << 19
_TERM = np.uint64(0x9E3779B97F4A7C15)


def _terms(points: np.ndarray, back: int) -> np.ndarray:
    """The part of a gram's key that its symbol ``back`` places before the last one makes."""
    most = int(points.max()) + 1 if len(points) else 0
    if most < len(points):  # each symbol once
        return mixed((np.arange(most, dtype=np.uint64) + np.uint64(back << 24)) * _TERM)[points]
    return mixed((points.astype(np.uint64) + np.uint64(back << 24)) * _TERM)


def _placed(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each symbol with its place in a word, so that words of the same letters differ."""
    most = int(points.max()) + 1
    if most * LONGEST < len(points):  # each symbol and place once
        table = np.arange(most, dtype=np.uint64) + (np.arange(LONGEST, dtype=np.uint64)[:, None] << np.uint64(24))
        return mixed(table * _TERM)[place, points]
    return mixed((points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24))) * _TERM)


def _keys(grams: list[str]) -> np.ndarray:
    """Keys of grams of ``ORDER`` symbols, or of their contexts (one symbol less)."""
    if not grams:
        return np.zeros(0, np.uint64)
    size = len(grams[0])
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, size)
    return sum(_terms(points[:, k], ORDER - 1 - k) for k in range(size))


def _words_of(found: Counter) -> Iterator[tuple[str, int]]:
    """Words of letters only, as ``Texts`` has them; a run with other signs in it is several words, as is a long one."""
    for word, n in found.items():
        if len(word) <= LONGEST and word.isalpha():
            yield word, n
        else:
            for part in "".join(c if c.isalpha() else " " for c in word).split():
                for k in range(0, len(part), LONGEST):
                    yield part[k : k + LONGEST], n


def words(docs: DataFrame) -> DataFrame:
    """(word, n, n0, n1): occurrences in all rows of ``docs`` (text, kind), in those of kind 0 and in those of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        sums: dict[int | None, Counter] = {None: Counter(), 0: Counter(), 1: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, found in sums.items():
                rows = list(_words_of(found))
                found.clear()
                if rows:
                    names, n = (list(x) for x in zip(*rows, strict=True))
                    none = pa.array(np.zeros(len(n), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(n, pa.int64()) if kind == 0 else none, pa.array(n, pa.int64()) if kind == 1 else none], names=["word", "n", "n0", "n1"])

        for batch in batches:
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[kind].update(_RUNS.findall((text.as_py() or "").lower()))
                if sum(map(len, sums.values())) > _HELD:
                    yield from out()
        yield from out()

    found = docs.select("text", "kind").mapInArrow(run, "word string, n long, n0 long, n1 long")
    return found.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")))


def counted(words: DataFrame) -> DataFrame:
    """(gram, n, n0, n1) of all grams of ``ORDER`` symbols."""
    padded = F.concat(F.lit(START * (ORDER - 1)), "word", F.lit(END))
    each = words.select("n", "n0", "n1", padded.alias("s"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at"))
    return each.groupBy(F.substring("s", F.col("at"), F.lit(ORDER)).alias("gram")).agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")))


def shared(grams: DataFrame) -> DataFrame:
    """(gram, common): the shared Kneser-Ney probability of each gram's last symbol after its context."""
    levels = [grams.select("gram", F.col("n").alias("raw"), F.col("n").alias("count"))]
    for size in STEPS[1:]:
        made = levels[-1].groupBy(F.substring("gram", -size, size).alias("gram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("types"))
        # In how many longer contexts the symbol follows; a context that begins with the word has one only and keeps its count.
        levels.append(made.select("gram", "raw", F.when(F.col("gram").startswith(START), F.col("raw")).otherwise(F.col("types")).alias("count")))
    total, types = levels[-1].agg(F.sum("count"), F.count("*")).first()
    known = levels[-1].select("gram", ((F.col("count") + 1) / F.lit(float((total or 0) + types + 1))).alias("common"))
    for size, shorter, level in zip(STEPS[-2::-1], STEPS[:0:-1], levels[-2::-1], strict=True):
        context = F.substring("gram", 1, size - 1)
        sums = level.groupBy(context.alias("context")).agg(F.sum("count").alias("total"), F.count("*").alias("types"))
        below = known.select(F.col("gram").alias("tail"), F.col("common").alias("lower"))
        joined = level.select("gram", "count", context.alias("context"), F.substring("gram", -shorter, shorter).alias("tail")).join(sums, "context").join(below, "tail")
        known = joined.select("gram", ((F.greatest(F.col("count") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("lower")) / F.col("total")).alias("common"))
    return known


def ratios(grams: DataFrame) -> DataFrame:
    """(gram, value, seen): the log ratio of toxic to ordinary probability of each gram that a class has, and of each context (one symbol less) before a symbol new to it. ``seen``: labelled occurrences of the context."""
    own = grams.where(F.col("n0") + F.col("n1") > 0).withColumn("context", F.substring("gram", 1, ORDER - 1))
    sums = own.groupBy("context").agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in (0, 1)), *(F.count_if(F.col(f"n{k}") > 0).alias(f"t{k}") for k in (0, 1)))
    spare = [F.when(F.col(f"s{k}") > 0, DISCOUNT * F.col(f"t{k}") / F.col(f"s{k}")).otherwise(1.0) for k in (0, 1)]
    sums = sums.select("context", "s0", "s1", spare[0].alias("spare0"), spare[1].alias("spare1"), (F.col("s0") + F.col("s1")).alias("seen"))

    def p(k: int) -> Column:
        mine = F.when(F.col(f"s{k}") > 0, F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{k}")).otherwise(0.0)
        return mine + F.col(f"spare{k}") * F.col("common")

    full = own.join(sums, "context").join(shared(grams), "gram").select("gram", F.log(p(1) / p(0)).alias("value"), "seen")
    return full.unionByName(sums.select(F.col("context").alias("gram"), F.log(F.col("spare1") / F.col("spare0")).alias("value"), "seen"))


def weighed(ratios: DataFrame) -> DataFrame:
    """``ratios`` with what each context says weighed by how often it was seen."""
    return ratios.withColumn("value", F.col("value") * F.col("seen") / (F.col("seen") + WEIGHT))


#: Keys and values of whole grams, those of contexts and, where these are not all, hashes of words and what the rest of the model adds to them.
Model = tuple[np.ndarray, ...]


def keyed(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of grams, and which of them are whole ones and not contexts."""
    whole, keys = np.fromiter((len(g) == ORDER for g in grams), bool, len(grams)), np.zeros(len(grams), np.uint64)
    for kind in (True, False):
        keys[whole == kind] = _keys([g for g, w in zip(grams, whole.tolist(), strict=True) if w == kind])
    return keys, whole


def packed(keys: np.ndarray, whole: np.ndarray, values: np.ndarray) -> Model:
    """Sorted keys with values, of whole grams and of contexts."""
    out: list[np.ndarray] = []
    for kind in (whole, ~whole):
        order = np.argsort(keys[kind])
        out += [keys[kind][order], values[kind][order].astype(np.float32)]
    return tuple(out)


def _coded(grams: DataFrame) -> DataFrame:
    """(key, whole, value) of (gram, value): what is sent to the driver are numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whole = keyed(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(whole), batch.column(1).cast(pa.float32())], names=["key", "whole", "value"])

    return grams.select("gram", "value").mapInArrow(run, "key long, whole boolean, value float")


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among ``keys``, and their values (0 for others)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


class Texts:
    """The words of some texts: their letters, where each word begins and ends, and each text's first word."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = letters()[points]
        begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        pieces = -(-(ends - begins) // LONGEST)
        if len(pieces) and pieces.max() > 1:  # a long run is several words
            owner = np.repeat(np.arange(len(pieces)), pieces)
            begins = begins[owner] + LONGEST * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            ends = np.minimum(begins + LONGEST, ends[owner])
        self.points, self.begins, self.lengths = points, begins, ends - begins
        self.first = np.searchsorted(begins, np.cumsum([0, *(len(p) + 1 for p in parts)]))


class Known:
    """The log ratios of words that were met before, by a hash of the word; beyond ``KNOWN_WORDS`` they are forgotten and made again."""

    def __init__(self):
        self.names, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        if len(self.names) + len(names) > KNOWN_WORDS:
            self.names, self.values = np.zeros(0, np.uint64), np.zeros(0)
        at = np.searchsorted(self.names, names)
        self.names, self.values = np.insert(self.names, at, names), np.insert(self.values, at, values)


def _distinct(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words in order, a place where each one is, and which of these each word is."""
    n = len(texts.begins)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), texts.lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(texts.lengths) - texts.lengths, texts.lengths)
    points = texts.points[texts.begins[owner] + place]
    names = np.add.reduceat(_placed(points, place), np.cumsum(texts.lengths) - texts.lengths)
    return np.unique(names, return_index=True, return_inverse=True)


Rest = tuple[np.ndarray, np.ndarray]


def word_ratios(texts: Texts, model: Model, known: Known | None = None, rest: Rest | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The log ratios of the distinct words, and which of these each word is. ``rest``: sorted hashes of words, and what is beyond the model adds to them."""
    names, some, which = _distinct(texts)
    if not len(names):
        return np.zeros(0), which
    if known is None:
        values = _sums_of(texts, names, some, model)
    else:
        hit, values = _found(known.names, known.values, names)
        if not hit.all():
            values[~hit] = _sums_of(texts, names[~hit], some[~hit], model)
            known.add(names[~hit], values[~hit])
    return (values if rest is None else values + _found(*rest, names)[1]), which


def _symbols(texts: Texts, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of these words, their ends included: where each word's first one is, and the keys of all contexts and grams."""
    size = texts.lengths[some] + 1
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(some)), size)
    place = np.arange(len(owner)) - start[owner]
    symbols = np.where(place + 1 == size[owner], ord(END), texts.points[np.minimum(texts.begins[some][owner] + place, len(texts.points) - 1)])
    context = np.zeros(len(symbols), np.uint64)
    for back in range(1, ORDER):
        before = np.full(len(symbols), ord(START), np.uint32)
        there = place >= back
        before[there] = symbols[np.flatnonzero(there) - back]
        context += _terms(before, back)
    return start, context, context + _terms(symbols, 0)


def _ratios_of(texts: Texts, some: np.ndarray, model: Model) -> np.ndarray:
    """The log ratios of these words: the sum over a word's symbols."""
    start, context, gram = _symbols(texts, some)
    hit, value = _found(model[0], model[1], gram)
    value[~hit] = _found(model[2], model[3], context[~hit])[1]
    return np.add.reduceat(value, start).astype(float)


def _sums_of(texts: Texts, names: np.ndarray, some: np.ndarray, model: Model) -> np.ndarray:
    """The log ratios of these words with what the rest of the model adds to them, as far as tasks get it."""
    values = _ratios_of(texts, some, model)
    return values + _found(model[4], model[5], names)[1] if len(model) > 4 else values


def lacking(texts: Texts, model: Model, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, word's hash) of the distinct words of each text that have a symbol after a context that the model lacks, and no sum in it. ``known`` has 1 for such words and 0 for others."""
    names, some, which = _distinct(texts)
    if not len(names):
        return np.zeros(0, np.int64), names
    hit, lacks = _found(known.names, known.values, names)
    if not hit.all():
        start, context, _ = _symbols(texts, some[~hit])
        lacks[~hit] = np.logical_or.reduceat(~_found(model[2], model[3], context)[0], start) & ~_found(model[4], model[5], names[~hit])[0]
        known.add(names[~hit], lacks[~hit])
    at = np.flatnonzero(lacks[which])
    pairs = np.unique((np.searchsorted(texts.first, at, side="right") - 1) * len(names) + which[at])
    return pairs // len(names), names[pairs % len(names)]


def figures_of(texts: list[str | None], model: Model, known: Known | None = None, rest: Rest | None = None) -> np.ndarray:
    """A row of ``FIGURES`` a text."""
    found = Texts(texts)
    values, which = word_ratios(found, model, known, rest)
    out = np.zeros((len(texts), len(FIGURES)))
    for k, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        v = values[which[a:b]]
        top = np.sort(np.partition(v, len(v) - BEST[-1])[len(v) - BEST[-1] :] if len(v) > BEST[-1] else v)[::-1]
        sums = np.cumsum(top)
        total, size = np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(found.lengths[a:b] + 1)])
        means = [((total[j:] - total[:-j]) / (size[j:] - size[:-j])).max() for j in (min(j, b - a) for j in PASSAGES)]
        out[k] = [*(sums[min(j, len(top)) - 1] / j for j in BEST), *means, b - a]
    return out


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve, by Newton's method on standardised figures; the last is the intercept."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, curve_rows: int = CURVE_ROWS) -> tuple | None:
    """The model (a broadcast) and (what is beyond it, the curve), or None if a class has no rows."""
    spark, at = docs.sparkSession, workspace(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(min(0.25, curve_rows / sizes[1]))).otherwise(F.lit(min(0.25, curve_rows / sizes[0])))
    marked = marked.select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 32)) < share * (1 << 32)).alias("curve"))
    if sum(sizes.values()) <= BROADCAST_IDS:
        marked = F.broadcast(marked)
    rows = docs.select("doc_id", "text").join(marked, "doc_id", "left").select("text", "toxic", "curve")
    found = stored(words(rows.select("text", F.when(~F.col("curve"), F.col("toxic")).alias("kind"))), f"{at}/words")
    grams = stored(counted(found), f"{at}/grams")
    table = stored(weighed(ratios(grams)), f"{at}/ratios")
    least = _least(table, "seen", MODEL_ROWS)
    made = _coded(table.where(F.col("seen") >= least)).toArrow()  # MODEL_ROWS entries at most, 13 bytes each
    known = packed(made.column(0).to_numpy().view(np.uint64), made.column(1).to_numpy(), made.column(2).to_numpy())
    model, rest = spark.sparkContext.broadcast(known), None
    if least > 1:
        more = stored(added(found, model, _coded(table.where(F.col("seen") < least))), f"{at}/more")
        often = _least(more, "n", MODEL_ROWS // 4)
        made = more.where(F.col("n") >= often).select("name", "more").toArrow()  # 16 bytes each
        names = made.column(0).to_numpy().view(np.uint64)
        order = np.argsort(names)
        model.unpersist()
        model = spark.sparkContext.broadcast((*known, names[order], made.column(1).to_numpy()[order]))
        forget(spark, f"{at}/words", f"{at}/grams", f"{at}/ratios")
        rest = stored(lists(docs, model, more.where(F.col("n") < often).select("name", "more")), f"{at}/rest") if often > 1 else None
    forget(spark, *(f"{at}/{x}" for x in ("words", "grams", "ratios", "more")))
    shown = figures(rows.where("curve"), model, ["toxic"], rest=rest).toArrow()
    y = shown.column("toxic").to_numpy()
    if len(set(y.tolist())) < 2:
        return model, (rest, np.array([float(c == "__top4") for c in JUDGED] + [-4.0]))
    return model, (rest, fitted(np.column_stack([shown.column(c).to_numpy() for c in JUDGED]), y))


def _least(table: DataFrame, column: str, most: int) -> int:
    """The power of two that ``column`` must reach so that no more than ``most`` rows do; 1 if all are taken."""
    power = F.length(F.bin(column)) - 1
    sizes = {r["power"]: r["count"] for r in table.groupBy(power.alias("power")).count().collect()}
    least, total = 1 << 62, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            return least
        least = 1 << k
    return 1


def added(words: DataFrame, model, rest: DataFrame) -> DataFrame:
    """(name, n, more): what ``rest`` (key, whole, value), which the model lacks, adds to the log ratio of each of ``words`` (word, n) that has some of it; by the word's hash."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = alone(name, lambda: model.value)
        for batch in batches:
            texts = Texts(batch.column(0).to_pylist())  # one word each
            names, _, which = _distinct(texts)
            start, context, gram = _symbols(texts, np.arange(batch.num_rows))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.append(start, len(context))))
            at = np.flatnonzero(~_found(tables[2], tables[3], context)[0])
            yield pa.RecordBatch.from_arrays([pa.array(names[which[owner[at]]].view(np.int64)), batch.column(1).take(pa.array(owner[at])), pa.array(gram[at].view(np.int64)), pa.array(context[at].view(np.int64))], names=["name", "n", "key", "context"])

    symbols = words.select("word", "n").mapInArrow(run, "name long, n long, key long, context long")
    whole = rest.where("whole").select("key", F.col("value").alias("own"))
    spare = rest.where("NOT whole").select(F.col("key").alias("context"), F.col("value").alias("spare"))
    valued = symbols.join(spare, "context").join(whole, "key", "left")
    return valued.groupBy("name").agg(F.max("n").alias("n"), F.sum(F.coalesce("own", "spare").cast("double")).alias("more"))


def lists(docs: DataFrame, model, rest: DataFrame) -> DataFrame:
    """(of, rest): the rows of ``rest`` (name, more) for the words of each text, by the text's hash. Texts ask for words that the model lacks some of; equal ones ask alike, and those of one hash share a list."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, met = alone(name, lambda: (model.value, Known()))
        for batch in batches:
            of, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            for at, texts in slices(batch.column(1), 1 << 19):
                owner, names = lacking(Texts(texts.to_pylist()), tables, met)
                yield pa.RecordBatch.from_arrays([pa.array(of[at + owner]), pa.array(names.view(np.int64))], names=["of", "name"])

    asked = docs.select(F.xxhash64("text").alias("of"), "text").mapInArrow(run, "of long, name long")
    return asked.join(rest, "name").groupBy("of").agg(F.collect_set(F.struct("name", "more")).alias("rest"))


def with_rest(docs: DataFrame, rest: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__rest``, its list of ``lists``."""
    held = rest.select(F.col("of").alias("__of"), F.col("rest").alias("__rest"))
    return docs.withColumn("__of", F.xxhash64(text_col)).join(held, "__of", "left").drop("__of")


def _rest_of(found: pa.Array) -> Rest:
    """The distinct rows of some texts, by name."""
    rows = found.flatten()
    names, first = np.unique(rows.field("name").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_index=True)
    return names, rows.field("more").to_numpy(zero_copy_only=False).astype(float)[first]


def figures(docs: DataFrame, model, keep: list[str], text_col: str = "text", rest: DataFrame | None = None) -> DataFrame:
    """Adds ``FIGURES`` to the columns in ``keep``. ``rest``: what the words of texts have beyond the model, as ``lists`` has it."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = alone(name, lambda: (model.value, Known()))
        for batch in batches:
            for first, texts in slices(batch.column(at), 1 << 19):
                rows = batch.slice(first, len(texts))
                found = figures_of(texts.to_pylist(), tables, known, _rest_of(rows.columns[-1]) if more else None)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(FIGURES)))], names=[*keep, *FIGURES])

    at, more = keep.index(text_col) if text_col in keep else len(keep), rest is not None
    held = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, *[text_col][: at == len(keep)])
    return (with_rest(rows, rest, text_col) if more else rows).mapInArrow(run, held + "".join(f", `{c}` double" for c in FIGURES))


def score(docs: DataFrame, labels: DataFrame, keep: list[str], folds: int = 5, held: int = 0, score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` (0 to 1) to the columns in ``keep``. Learns from the labels outside fold ``held``."""
    found = train(docs, labels, folds, held)
    if found is None:
        return docs.select(*keep, F.lit(0.0).alias(score_col))
    model, (rest, w) = found
    z = F.lit(float(w[-1]))
    for c, weight in zip(JUDGED, w[:-1].tolist(), strict=True):
        z = z + F.col(c) * weight
    curve = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return figures(docs, model, keep, rest=rest).select(*keep, F.when(F.col("__words") == 0, 0.0).otherwise(curve).alias(score_col))
