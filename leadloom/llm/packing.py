"""Packing documents into sequences: shortest pack first over the length histogram.

Documents are tokenized and cut into pieces of at most ``capacity`` ids.  Only
the histogram of piece lengths (at most ``capacity`` rows) reaches the driver.
Lengths are placed longest first, each into the packs that are filled least, a
whole group of equal packs at a time; what comes out is a list of packing
patterns with counts.  Pieces meet their places by rank: the r-th piece of a
length takes the r-th place that the patterns offer for it.

Edge cases: null and empty texts are one piece that holds the end id alone; long
texts make several pieces; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded
from .shared import stored, workspace

CAPACITY = 4096
_RANK_BITS = 44


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remember: int | None = None) -> DataFrame:
    """One row a piece; ``part`` and ``nth`` count the pieces of a length within the task that made them."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(spec, remember), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                owner, starts, lengths, sums, totals, nth = [], [], [], [], [], []
                for i, text in enumerate(rows.column(1).to_pylist()):
                    ids = bpe.encode(text) + end
                    for k in range(0, len(ids), width):
                        cut = ids[k : k + width]
                        n = len(cut) // 4
                        owner.append(i)
                        starts.append(k // 4)
                        lengths.append(n)
                        sums.append(zlib.crc32(cut))
                        totals.append(len(ids) // 4)
                        nth.append(int(seen[n]))
                        seen[n] += 1
                cols = [rows.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)), pa.array([part] * len(owner), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(packs, lengths in order) by shortest-pack-first. Work depends on the number of lengths, not on that of pieces."""
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # space left -> groups of equal packs, pattern as a linked list
    top = 0  # no group has more room than this
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        top = max(room, default=0)
        while left:
            while top >= length and not room.get(top):
                room.pop(top, None)
                top -= 1
            if top >= length:
                packs, held = room[top].pop()
                used = min(packs, left)
                if used < packs:
                    room[top].append((packs - used, held))
                room[top - length].append((used, (length, held)))
            else:  # nothing has room: new packs, one piece in each
                used = left
                room[capacity - length].append((used, (length, ())))
            left -= used
    out = []
    for groups in room.values():
        for packs, held in groups:
            lengths = []
            while held:
                lengths.append(held[0])
                held = held[1]
            out.append((packs, lengths[::-1]))
    return out


def places(found: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first sequence and its offset there. Sorted by length and rank."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for packs, lengths in found:
        offset = 0
        for length in lengths:
            rows.append(((length << _RANK_BITS) + taken[length], base, offset))
            taken[length] += packs
            offset += length
        base += packs
    rows.sort()
    key, first, offset = np.array(rows, np.int64).reshape(-1, 3).T
    return {"key": key.copy(), "first": first.copy(), "offset": offset.copy()}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remember: int | None = None) -> DataFrame:
    """One row a piece with its sequence and offset. The texts are read once and never shuffled. ``remember``: bytes of words that a worker keeps (speed only)."""
    spark, at = docs.sparkSession, workspace(docs.sparkSession)
    made = stored(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, remember), f"{at}/pieces")
    counts = made.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    slots = places(patterns(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = made.join(bases, ["part", "length"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("length").to_numpy() << _RANK_BITS) + batch.column("rank").to_numpy()
            k = np.searchsorted(slots["key"], key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slots["first"][k] + (key - slots["key"][k])), pa.array(slots["offset"][k])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
