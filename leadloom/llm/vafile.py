"""Exact top-k search with vector-approximation files.

Every partition is a vector-approximation file: each component of each vector is
quantised to one of ``2 ** bits`` cells between the component's least and
greatest value in that file.  For a block of queries the cells alone give bounds
for all scores (cell centres, plus or minus the half widths).  The exact vectors
are then read in the order of their bounds, best first, and reading stops for a
query once its k-th exact score beats every bound that is left, so that what is
found is exact.  The files' results meet by query: k rows a file.

Queries are taken in blocks of at most ``query_block`` rows, which bounds what a
task gets; more queries make more passes, not larger ones.

Scores are integer inner products.  Ties go to the smaller id.  Null vectors,
vectors with null or non-finite components and rows without an id take no part;
nor do vectors of another dimension than the query's.  Vectors with components so
large that scores could leave 64 bits are bounded in doubles and scored in whole
numbers of any size; their places are exact, and ``score`` is null where it does
not fit.  Empty vectors score 0 with one another.  Repeated rows are candidates
as often as they occur, but a query meets no row of its own id.  Equal query rows
are one query; query rows of one id with other vectors each have their own ranks.
Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 8
QUERY_BLOCK = 8192
_ROWS = 4096
SCALE = 256
_BYTES = 264  # of the largest score: products of doubles, a sum of up to 2 ** 31 of them


def scaled(vector: Column) -> Column:
    """Each component as double, rounded down to a whole number of ``SCALE``ths; null where the vector takes no part."""
    x256 = lambda x: F.floor(x * SCALE) / SCALE
    made = F.transform(F.transform(vector, lambda x: x.cast("double")), lambda x: F.when(F.abs(x) < 1 << 45, x256(x)).otherwise(x))
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, made)


def _whole(vector: np.ndarray) -> list[int]:
    """``SCALE`` times each component, exact."""
    return [int(x * SCALE) if abs(x) < 1 << 60 else int(x) * SCALE for x in vector.tolist()]


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """Which rows have scores with one another that fit 64 bits, and components that fit 32."""
    limit = min(1 << 26, math.isqrt((1 << 62) // max(1, vectors.shape[1])))
    return (np.abs(vectors) < limit / SCALE).all(axis=1)


class Cells:
    """The approximations of some vectors of one dimension."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low = low.astype(np.float64)
        self.width = np.maximum(1.0, np.ceil((high - low + 1) / (1 << bits)))  # whole numbers a cell
        self.codes = ((vectors - low) // self.width).astype(np.uint8 if bits <= 8 else np.uint16)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each query can have with each vector. Halves are exact in doubles."""
        half = (self.width - 1) / 2
        centre = self.low + half + self.codes * self.width
        middle = queries @ centre.T
        slack = (np.abs(queries) @ half)[:, None]
        most = np.abs(queries) @ np.abs(centre).max(axis=0)  # of which a sum in doubles is wrong by a small part
        slack = slack + ((len(half) + 2) * 2.0**-51 * most + 1e-9)[:, None]
        return middle - slack, middle + slack


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _floor(low: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> np.ndarray:
    """What at least k rows of other ids reach for each query, by their least scores."""
    if len(ids) <= k:
        return np.full(len(low), -np.inf)
    others = np.where(ids == query_ids[:, None], -np.inf, low)
    return np.partition(others, len(ids) - k, axis=1)[:, len(ids) - k]


def search_wide(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its k best (less the score, id) of some vectors of any size. Doubles bound the scores; what could be among the best is scored exactly."""
    out, whole = [], {}
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            middle, most = block @ vectors.T, np.abs(block) @ np.abs(vectors).T
            slack = most * ((block.shape[1] + 2) * 2.0**-51)
            known = np.isfinite(most) & np.isfinite(middle)
            low, high = np.where(known, middle - slack, -np.inf), np.where(known, middle + slack, np.inf)
        floor = _floor(low, ids, query_ids[at : at + 256], k)
        for i, query in enumerate(block):
            near = np.flatnonzero((high[i] >= floor[i]) & (ids != query_ids[at + i]))
            mine = _whole(query)
            for j in near.tolist():
                if j not in whole:
                    whole[j] = _whole(vectors[j])
            out.append(heapq.nsmallest(k, ((-sum(x * y for x, y in zip(mine, whole[j], strict=True)), int(ids[j])) for j in near.tolist())))
    return out


def search_file(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bits: int = BITS, known: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best (ids, scores) of one file and of those ``known`` from files before, whose k-th score is what cells must reach."""
    cells, exact = Cells(vectors, bits), vectors.astype(np.int64)
    known = known or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    least = np.array([scores[-1] if len(scores) == k else -np.inf for _, scores in known])
    out = []
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        low, high = cells.bounds(block.astype(np.float64))
        floor = np.maximum(_floor(low, ids, query_ids[at : at + 256], k), least[at : at + 256])
        for i, query in enumerate(block.astype(np.int64)):
            near = np.flatnonzero((high[i] >= floor[i]) & (ids != query_ids[at + i]))
            near = near[np.argsort(-high[i, near], kind="stable")]
            best_ids, best = known[at + i]
            step = 4 * k
            for j in range(0, len(near), step):
                if len(best) == k and high[i, near[j]] < best[-1]:
                    break
                read = near[j : j + step]
                best_ids, best = _top(np.concatenate([best_ids, ids[read]]), np.concatenate([best, exact[read] @ query]), k)
                step = 64 * k
            out.append((best_ids, best))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = BITS, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors`` for each of ``queries``; both have an id and a vector as ``scaled`` makes it."""
    queries = queries.select(id_col, vector_col).distinct()
    total = queries.count()
    blocks = max(1, -(-total // query_block))
    parts = []
    for b in range(blocks):
        mine = queries
        if blocks > 1:
            mine = mine.where(F.pmod(F.xxhash64(id_col, vector_col, F.lit(7)), F.lit(blocks)) == b)
        parts.append(_pass(vectors, mine.toArrow(), b << 32, k, bits, id_col, vector_col))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("wide"), F.desc("score"), F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grouped(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, places, ids, matrix) of the rows of each dimension."""
    sizes = vectors.value_lengths().to_numpy()
    flat, ids = vectors.flatten().to_numpy(), ids.to_numpy()
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, ids[rows], flat[starts[rows][:, None] + np.arange(size)]


def _pass(vectors: DataFrame, table: pa.Table, number: int, k: int, bits: int, id_col: str, vector_col: str) -> DataFrame:
    """(query, query_id, vec_id, score, wide, key): the k best of each file; queries are numbered from ``number`` on. A score outside 64 bits is null, with its sign in ``wide`` and its order in ``key``."""
    spark = vectors.sparkSession
    table = table.combine_chunks()
    mine = {}
    if table.num_rows:
        numbers = np.arange(number, number + table.num_rows)
        for size, rows, ids, m in _grouped(table.column(0).chunk(0), table.column(1).chunk(0)):
            small = _narrow(m)
            # Smaller numbers where they fit: this is what each executor gets.
            mine[size] = (numbers[rows][small], ids[small], (m[small] * SCALE).astype(np.int32)), (numbers[rows][~small], ids[~small], m[~small])
    sent = spark.sparkContext.broadcast(mine)  # query_block vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        large: dict[int, dict[int, list]] = {}
        held: dict[int, list] = {}

        def search_large(size: int, queries: tuple, ids: np.ndarray, matrix: np.ndarray) -> None:
            numbers, query_ids, asked = queries
            if not len(asked) or not len(ids):
                return
            known = large.setdefault(size, {})
            for n, query_id, found in zip(numbers.tolist(), query_ids.tolist(), search_wide(query_ids, asked, ids, matrix, k), strict=True):
                known[n] = (query_id, heapq.nsmallest(k, found + known.get(n, (0, []))[1]))

        def search(size: int) -> None:
            small, wide = sent.value[size]
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
            fits = _narrow(matrix)
            search_large(size, wide, ids, matrix)
            if not fits.all():
                search_large(size, (small[0], small[1], small[2] / SCALE), ids[~fits], matrix[~fits])
                ids, matrix = ids[fits], matrix[fits]
            if len(ids) and len(small[1]):
                best[size] = search_file(small[1], small[2], ids, (matrix * SCALE).astype(np.int64), k, bits, best.get(size))

        for batch in batches:
            for size, _, ids, matrix in _grouped(batch.column(0), batch.column(1)):
                if size in sent.value:
                    held.setdefault(size, []).append((ids, matrix))
                    if sum(len(x[0]) for x in held[size]) >= _ROWS:
                        search(size)
        for size in list(held):
            search(size)
        names = ["query", "query_id", "vec_id", "score", "wide", "key"]
        for size, found in best.items():
            numbers, query_ids, _ = sent.value[size][0]
            counts = [len(f[0]) for f in found]
            total = sum(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, counts)), pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.zeros(total, np.int32)), pa.nulls(total, pa.binary())], names=names)
        for known in large.values():
            rows = [(n, query_id, vec_id, *_ordered(-less)) for n, (query_id, found) in known.items() for less, vec_id in found]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return vectors.select(id_col, vector_col).mapInArrow(run, "query long, query_id long, vec_id long, score long, wide int, key binary")


def _ordered(score: int) -> tuple[int | None, int, bytes | None]:
    """(score, wide, key): the score if 64 bits hold it, else its sign and bytes that sort as it does."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    return None, 1 if score > 0 else -1, (score + (1 << (8 * _BYTES - 1))).to_bytes(_BYTES, "big")
