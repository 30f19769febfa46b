"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (n = 1 to 3, words bounded by
spaces) of a language in order of frequency.  A text's own list is compared with
each profile by out-of-place distance: the sum over the text's n-grams of how
far the ranks lie apart, ``profile_size`` for one that the profile lacks.  The
nearest profile wins; equal distances go to the language that sorts first.

Profiles are learned from all training rows; every text is predicted whole.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is
every text when nothing could be learned; empty tables give no rows; repeated
rows are predicted alike; other columns are left out, whatever their names.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import alone, letters

UNKNOWN = "und"
PROFILE_SIZE = 400
#: A task passes its sums on when it holds so many codes.
_HELD = 2_000_000
_SPACE = np.uint64(32)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as 63-bit codes (21 bits a character) and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = letters()[points]
    if not good.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = good.copy()
    keep[1:] |= good[:-1]  # one space after each word
    line = np.where(good, points, 32)[keep].astype(np.uint64)
    line = np.concatenate([[_SPACE], line] if line[-1] == 32 else [[_SPACE], line, [_SPACE]])
    two = line[:-1] << np.uint64(21) | line[1:]
    three = two[:-1] << np.uint64(21) | line[2:]
    return np.unique(np.concatenate([line[line != 32], two, three[line[1:-1] != 32]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes in order; equal counts by code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """language -> its n-gram codes in order, counted over all rows of ``docs``."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        sums: dict[str, list] = defaultdict(list)
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in sums.items():
                codes, counts = _added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = sums[lang]
                parts.append(ngrams(text))
                held += len(parts[-1][0])
                if len(parts) > 500:
                    held -= sum(len(p[0]) for p in parts)
                    sums[lang] = [_added(parts)]
                    held += len(sums[lang][0][0])
                if held > _HELD:
                    yield from out()
                    sums.clear()
                    held = 0
        yield from out()

    found = known.select(F.col(lang_col).cast("string"), text_col).mapInArrow(count, "lang string, code long, n long")
    found = found.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # The best of 16 shares of the codes by language hold the best of all: the driver gets 16 * size rows a language at most.
    best = Window.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(16))).orderBy(F.desc("n"), "code")
    rows = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["code"], r["n"]))
    return {lang: ranked(*(np.array(x) for x in zip(*by[lang], strict=True)), size).tolist() for lang in sorted(by)}


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, places = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(places, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text", size: int = PROFILE_SIZE, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds ``pred_col`` and ``score_col`` (1 less the distance as a part of the greatest possible) to the columns in ``keep``."""
    names = list(profiles)
    codes = np.array(sorted({c for p in profiles.values() for c in p}), np.uint64)
    place = np.full((max(1, len(names)), len(codes) + 1), sys.maxsize, np.int64)
    for k, p in enumerate(profiles.values()):
        place[k, np.searchsorted(codes, np.array(p, np.uint64))] = np.arange(len(p))

    def one(text: str | None) -> tuple[str, float]:
        if not text or not names:
            return UNKNOWN, 0.0
        mine = ranked(*ngrams(text), size)
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.searchsorted(codes, mine)
        at[at == len(codes)] = 0
        at[codes[at] != mine] = len(codes)
        there = place[:, at]
        apart = np.where(there == sys.maxsize, size, np.abs(there - np.arange(len(mine)))).sum(axis=1)
        k = int(apart.argmin())
        return names[k], 1.0 - float(apart[k]) / (size * len(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(at)]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*keep, pred_col, score_col])

    at = keep.index(text_col) if text_col in keep else len(keep)
    held = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *[text_col][: at == len(keep)]).mapInArrow(run, f"{held}, `{pred_col}` string, `{score_col}` double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, by ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def identify(docs: DataFrame, keep: list[str], folds: int = 4, held: int = 2, **names: str) -> DataFrame:
    """Learns from the rows outside fold ``held`` and predicts all."""
    profiles = train(docs.where(fold("doc_id", folds) != held))
    return predict(docs, profiles, keep, **names)
