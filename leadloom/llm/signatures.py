"""Ranked lexical search over bit-sliced Bloom signatures.

``index`` writes, once for all questions, blocks of documents of like size.  A block is a
matrix of bits, one row a signature bit and one column a document: a document sets the
bits of each of its terms, and of "the term at least twice", "three times" and so on
(``LEVELS``).  A question looks up a term's rows and cuts them: the documents that may
have the term so often.  No document that has it is missed, a few others are let in.

``search`` weighs these bitmaps.  The weights of a question's terms, summed over the
slices and scaled by what a term can add at that level in a document of that length, are
an upper bound of every document's score.  The documents with the best bounds are scored
from their texts; the tenth best of these scores is a lower bound of the result's, and
every document whose bound reaches it is scored from its text.  What is left out cannot
be among the ten, so the answer is exact, however many bits collide.

Questions go in blocks of about ``ITEMS``; a further block reads the index again, not the
texts.  On the driver are a block's questions, the figures of their terms and ten scores
each; ids of documents to score go by a broadcast up to ``BROADCAST_IDS``, beyond it by a
shuffle.

Edge cases: null and empty texts, and texts without a term, are not counted and never
found; a question without a term, or whose terms no document has, has no rows; equal
questions are asked once; rows that share an id are documents of their own, ranked by
their scores; rows without an id come last among equals; very long texts are split in
pieces; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import alone, forget, mixed, stored, workspace
from .terms import counts, splitter

TOP = 10
#: How often a term occurs at least, for each level of a signature.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512)
#: Bits that a key sets, and bits of a signature for each key of the largest document of its class.
PROBES, BITS_A_KEY = 5, 10
#: The sizes of signatures: each is so much larger than the one before.
GROWTH = 1.25
BLOCK_DOCS, BLOCK_BITS = 512, 1 << 23
ITEMS = 1_024
#: Documents with the best bounds that give a question its first scores.
SEEDS = 32
BROADCAST_IDS = 200_000
_HELD_KEYS, _HELD_TERMS, _KNOWN = 2_000_000, 300_000, 1 << 19
_CELLS = 1 << 22
_LEVEL = 0x9E3779B97F4A7C15
_TABLE = splitter(digits=True)


def _probes(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The rows of a signature of ``bits`` bits that each term sets at a level."""
    key = mixed(hashes + np.uint64((level + 1) * _LEVEL & (1 << 64) - 1))
    one, two = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)) | np.uint64(1)
    at = (one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]) & np.uint64(0xFFFFFFFF)
    return (at * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _class(keys: int) -> int:
    """The size class of a document with so many keys."""
    return int(np.ceil(np.log(max(keys, 16)) / np.log(GROWTH)))


def _bits(size: int) -> int:
    return int(BITS_A_KEY * GROWTH**size) + 1


def signed(docs: list[tuple[np.ndarray, np.ndarray]], bits: int) -> bytes:
    """The slices of some documents, given their terms' hashes and numbers: bit after bit, a packed bitmap of the documents."""
    hashes, often = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    out = np.zeros((bits, len(docs)), bool)
    for level, least in enumerate(LEVELS):
        there = often >= least
        if not there.any():
            break
        out[_probes(hashes[there], level, bits), owner[there][:, None]] = True
    return np.packbits(out, axis=1).tobytes()


class _Hashes(dict):
    """64-bit hashes of terms, kept for a while."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        found = self[term] = xxhash.xxh64_intdigest(term)
        return found


def index(docs: DataFrame) -> DataFrame:
    """Blocks (bits, ids, sizes, slices) of all documents with a term, and (term, df): how many documents of a part have a term."""
    kind = docs.schema["doc_id"].dataType
    names = ["term", "df", "bits", "ids", "sizes", "slices"]
    types = [pa.string(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        known, df = _Hashes(), Counter()
        held: dict[int, list[tuple]] = defaultdict(list)
        weight: Counter = Counter()

        def block(size: int) -> pa.RecordBatch:
            rows = held.pop(size)
            weight.pop(size)
            bits = _bits(size)
            columns = [pa.array([None], types[0]), pa.array([None], types[1]), pa.array([bits], types[2]), pa.array([[r[0] for r in rows]], pa.list_(id_type)), pa.array([[r[1] for r in rows]], types[4]), pa.array([signed([r[2:] for r in rows], bits)], types[5])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def frequencies() -> pa.RecordBatch:
            terms, n = pa.array(list(df), pa.binary()).cast(pa.string()), pa.array(list(df.values()), pa.int64())
            df.clear()
            return pa.RecordBatch.from_arrays([terms, n, *(pa.nulls(len(n), t) for t in (types[2], pa.list_(id_type), types[4], types[5]))], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = counts(text.as_py() or b"", _TABLE)
                if not found:
                    continue
                df.update(found.keys())
                hashes, often = np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                keys = int(np.searchsorted(LEVELS, often, side="right").sum())
                size = _class(keys)
                held[size].append((doc, int(often.sum()), hashes, np.minimum(often, LEVELS[-1]).astype(np.int32)))
                weight[size] += keys
                if len(held[size]) >= min(BLOCK_DOCS, max(1, BLOCK_BITS // _bits(size) // 8 * 8)):
                    yield block(size)
                elif weight.total() > _HELD_KEYS:
                    yield block(weight.most_common(1)[0][0])
                if len(df) > _HELD_TERMS:
                    yield frequencies()
        for size in list(held):
            yield block(size)
        if df:
            yield frequencies()

    return docs.select("doc_id", "text").mapInArrow(run, f"term string, df long, bits long, ids array<{kind.simpleString()}>, sizes array<long>, slices binary")


class Asked:
    """Some questions: their terms, and the weights and figures that scores are made of."""

    def __init__(self, texts: list[str | None]):
        found = [counts((t or "").encode(), _TABLE) for t in texts]
        self.terms = sorted(set().union(*found)) if found else []
        number = {t: k for k, t in enumerate(self.terms)}
        self.of = [np.array(sorted(map(number.__getitem__, f)), np.int64) for f in found]
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], np.uint64)
        self.weights, self.documents, self.length = np.zeros(len(self.terms), np.int64), 0, 1

    def weigh(self, df: dict[bytes, int], documents: int, length: int) -> None:
        """Takes the corpus's figures in: documents with each term, documents with a term, and terms of all of them."""
        self.documents, self.length = documents, max(length, 1)
        ratio = [(2 * documents + 2) / (2 * df.get(t, 0) + 1) for t in self.terms]
        self.weights = np.array([int(np.floor(1000 * np.log(r))) for r in ratio], np.int64)

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {t: k for k, t in enumerate(self.terms)}

    def damping(self, n: int) -> int:
        """8 * m for a document of n terms."""
        return 8 * (100 - 90 + 90 * n * self.documents // self.length)

    def score(self, found: Counter, item: int, damping: int) -> int:
        """The exact score of a document with these terms."""
        total = 0
        for k in self.of[item].tolist():
            tf = found.get(self.terms[k])
            if tf:
                total += int(self.weights[k]) * (1_000_000_000 * tf // (1000 * tf + damping))
        return total


def bounds(asked: Asked, bits: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
    """An upper bound of each document's score for each question."""
    d = len(sizes)
    rows = np.frombuffer(slices, np.uint8).reshape(bits, -1)
    damping = np.array([asked.damping(n) for n in sizes.tolist()], np.int64)
    owner = np.repeat(np.arange(len(asked.of)), [len(x) for x in asked.of])
    term = np.concatenate(asked.of) if asked.of else np.zeros(0, np.int64)
    out = np.zeros((len(asked.of), d), np.int64)
    here, maps, before = np.arange(len(asked.terms)), None, np.zeros(d, np.int64)
    for level, _ in enumerate(LEVELS):
        found = np.bitwise_and.reduce(rows[_probes(asked.hashes[here], level, bits)], axis=1)
        if maps is not None:
            found &= maps  # so often only where it is less often, too
        some = found.any(axis=1)
        here, maps = here[some], found[some]
        if not len(here):
            break
        most = np.array(LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else np.maximum(sizes, LEVELS[level])
        worth = 1_000_000_000 * most // (1000 * most + damping)
        place = np.full(len(asked.terms), -1)
        place[here] = np.arange(len(here))
        there = place[term] >= 0
        items, which = owner[there], place[term[there]]
        weights = asked.weights[here].astype(np.int32)
        step = max(1, _CELLS // d)
        for at in range(0, len(items), step):  # a bounded number of (term, document) cells at once
            part = items[at : at + step]
            of_part = which[at : at + step]
            cells = np.unpackbits(maps[of_part], axis=1, count=d).astype(np.int32)
            cells *= weights[of_part][:, None]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out[part[starts]] += np.add.reduceat(cells, starts, axis=0, dtype=np.int64) * (worth - before)
        before = worth
    return out


def _over(blocks: DataFrame, asked, kind: str, floors: list[int] | None = None) -> DataFrame:
    """(item, doc_id, bound): all documents whose bounds reach the floor of a question or, without floors, the best ``SEEDS`` of each part of the index."""
    name = uuid.uuid4().hex

    def rows(docs: pa.Array, at: np.ndarray, bound: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
        item, column = np.nonzero(chosen)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), docs.take(pa.array(at[item, column])), pa.array(bound[item, column], pa.int64())], names=["item", "doc_id", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = alone(name, lambda: asked.value)
        kept, at, best = None, None, None
        for batch in batches:
            for bits, ids, sizes, slices in zip(*(batch.column(k) for k in range(4)), strict=True):
                docs = ids.values
                now = bounds(questions, bits.as_py(), np.asarray(sizes.values, np.int64), slices.as_py())
                number = np.broadcast_to(np.arange(len(docs)), now.shape)
                if floors is not None:
                    yield rows(docs, number, now, now >= np.array(floors)[:, None])
                    continue
                if kept is not None:
                    at, best = np.concatenate([at, number + len(kept)], 1), np.concatenate([best, now], 1)
                    kept = pa.concat_arrays([kept, docs])
                else:
                    kept, at, best = docs, number, now
                if best.shape[1] > SEEDS:
                    chosen = np.argpartition(best, -SEEDS, axis=1)[:, -SEEDS:]
                    at, best = np.take_along_axis(at, chosen, 1), np.take_along_axis(best, chosen, 1)
                used, at = np.unique(at, return_inverse=True)
                kept, at = kept.take(pa.array(used)), at.reshape(best.shape)
        if best is not None:
            yield rows(kept, at, best, best > 0)

    return blocks.mapInArrow(run, f"item int, doc_id {kind}, bound long")


def _scored(docs: DataFrame, wanted: DataFrame, asked, kind: str, at: str) -> DataFrame:
    """(item, doc_id, score): the exact scores above 0 of the wanted (item, doc_id) pairs, from the texts."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = alone(name, lambda: asked.value)
        for batch in batches:
            items, places, scores = [], [], []
            for place, (text, wants) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True)):
                found = counts(text.as_py() or b"", _TABLE)
                damping = questions.damping(found.total())
                for item in wants:
                    score = questions.score(found, item, damping)
                    if score > 0:
                        items.append(item)
                        places.append(place)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), batch.column(0).take(pa.array(places, pa.int64())), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    grouped = stored(wanted.groupBy("doc_id").agg(F.collect_set("item").alias("items")), at)
    small = grouped.count() <= BROADCAST_IDS
    grouped = grouped.select(F.col("doc_id").alias("wanted"), "items")
    joined = docs.join(F.broadcast(grouped) if small else grouped, F.col("doc_id").eqNullSafe(F.col("wanted")))
    return joined.select("doc_id", "text", "items").mapInArrow(run, f"item int, doc_id {kind}, score long")


def _first(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, found: DataFrame, items: DataFrame, top: int = TOP, at: str | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each question of ``items`` (item_id, text), by an ``index`` of ``docs`` that was stored."""
    spark, at = docs.sparkSession, at or workspace(docs.sparkSession)
    docs, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    asked_for = items.select("item_id", "text").distinct()
    many = -(-asked_for.count() // ITEMS)
    blocks = found.where(F.col("bits").isNotNull())
    documents, length = blocks.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    out = None
    for part in range(many):
        mine = asked_for.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == part).toArrow()  # about ITEMS questions
        one = _search(spark, docs, blocks, found, mine, (documents or 0, length or 0), kind, top, f"{at}/{part}")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    return out


def _search(spark: SparkSession, docs: DataFrame, blocks: DataFrame, found: DataFrame, mine: pa.Table, size: tuple[int, int], kind: str, top: int, at: str) -> DataFrame:
    asked = Asked(mine.column("text").to_pylist())
    terms = spark.createDataFrame([(t.decode(),) for t in asked.terms], "term string")
    df = found.where(F.col("term").isNotNull()).select("term", "df").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term of these questions
    asked.weigh(dict(zip((t.encode() for t in df.column("term").to_pylist()), df.column("df").to_pylist(), strict=True)), *size)
    sent = spark.sparkContext.broadcast(asked)
    blocks = blocks.select("bits", "ids", "sizes", "slices")
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    seeds = _over(blocks, sent, kind).withColumn("place", F.row_number().over(best)).where(F.col("place") <= SEEDS).select("item", "doc_id")
    floors, last = [1] * len(asked.of), [None] * len(asked.of)
    for row in _first(_scored(docs, seeds, sent, kind, f"{at}/seeds"), top).where(F.col("rank") == top).collect():  # one row a question
        floors[row["item"]], last[row["item"]] = row["score"], row["doc_id"]
    limits = spark.createDataFrame(list(zip(range(len(floors)), floors, last, strict=True)), f"item int, floor long, last {kind}")
    # A bound that only equals the tenth score lets in smaller ids alone.
    open_ = (F.col("bound") > F.col("floor")) | F.coalesce(F.col("doc_id") <= F.col("last"), F.col("last").isNull())
    wanted = _over(blocks, sent, kind, floors).join(F.broadcast(limits), "item").where(open_).select("item", "doc_id")
    first = _first(_scored(docs, wanted, sent, kind, f"{at}/wanted"), top)
    names = spark.createDataFrame(mine.select(["item_id"]).append_column("item", pa.array(range(len(mine)), pa.int32())))
    return first.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (
  SELECT DISTINCT i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM b
), n AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), o AS (
  SELECT r, unnest(w) AS term FROM d
), t AS (
  SELECT r, term, count(*) AS tf FROM o SEMI JOIN q USING (term) GROUP BY r, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, n GROUP BY term, docs
), s AS (
  SELECT q.i, t.r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (r), n GROUP BY q.i, t.r
), k AS (
  SELECT b.item_id, CAST(row_number() OVER (PARTITION BY s.i ORDER BY score DESC, d.doc_id NULLS LAST) AS INTEGER) AS rank, d.doc_id, score FROM s JOIN d USING (r) JOIN b USING (i) WHERE score > 0
)
SELECT * FROM k WHERE rank <= 10
"""
