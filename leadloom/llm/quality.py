"""Quality rules as learned decision lists.

Statistics of a text become an ordered list of rules, each a conjunction of
thresholds with a verdict, learned by sequential covering: a rule is grown by the
threshold that adds most information on one half of the labelled rows, pruned
backwards on the other half, kept while it is better than the rest's prior, and
the rows that it covers are taken away.  The list is a ``CASE WHEN`` in Spark, so
that it can be read, edited and pushed around like any other column.

At most about ``train_rows`` labelled rows (chosen by a hash of the id) are read
for learning; statistics are made of whole texts.

Edge cases: a null or blank text has no words and fails the base rules; a text
of one endless word is one word; without labels (or with one class) the list is
empty and its verdict is "keep"; several labels of a document keep it if one
does; repeated rows get the same verdict; empty tables give no rows; other columns
are left out unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
TRAIN_ROWS = 8_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_short", "n_stops"]
_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words which the text has twice or more."""
    n = len(words)
    if n < window + 1:
        return 0
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Ranks of runs of 1, 2, 4, ... words: equal ranks are equal runs, exactly.
    ranks, length = codes, 1
    while length < window:
        step = min(length, window - length)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        length += step
        ranks = np.unique(pairs, return_inverse=True)[1] if length < window else pairs
    order = np.argsort(ranks, kind="stable")
    same = ranks[order[1:]] == ranks[order[:-1]]
    hit = np.zeros(len(ranks), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    if not hit.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The figures of ``COUNTS`` for one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = _WORDS.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            again += 1
        elif _WORDS.search(line):
            seen.add(line)
    distinct = set(words)
    symbols = sum(map(text.count, SYMBOLS))
    short = sum(len(w) <= 3 for w in words)
    stops = sum(w[-1] in ".!?" for w in words)
    return len(words), sum(map(len, words)), symbols, again, repeated_words(words), len(lines), len(distinct), short, stops


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds the columns of ``COUNTS`` to those in ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*keep, *COUNTS])

    held = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, held + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict[str, Column]:
    """What rules are made of: figures that don't depend on the length, and the length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbols_a_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_words": F.col("n_repeat_words") / n,
        "distinct_words": F.col("n_distinct") / n,
        "short_words": F.col("n_short") / n,
        "stops_a_word": F.col("n_stops") / n,
        "words_a_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }


Rule = tuple[list[tuple[str, str, float]], int]


def _covers(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in conditions:
        out &= x[:, k] > t if above else x[:, k] <= t
    return out


def learn(x: np.ndarray, y: np.ndarray, names: list[str], most: int = 24, longest: int = 4, least: int = 8, sure: float = 0.8, cuts: int = 64) -> list[Rule]:
    """An ordered list of (conditions, verdict) for verdict 0; what no rule covers is 1."""
    rules: list[Rule] = []
    half = np.arange(len(y)) % 3 != 2  # grown on two thirds, pruned on the rest
    left = np.ones(len(y), bool)
    grid = [np.unique(np.quantile(x[:, k], np.linspace(0.005, 0.995, cuts))) for k in range(x.shape[1])] if len(y) else []
    bad = y == 0
    while len(rules) < most and bad[left].sum() >= least:
        prior = bad[left].mean()
        conditions: list[tuple[int, bool, float]] = []
        inside = left & half
        while len(conditions) < longest and bad[inside].any() and not bad[inside].all():
            best, choice = 0.0, None
            p0, n0 = bad[inside].sum(), inside.sum()
            rows, hits = x[inside], bad[inside]
            for k in range(x.shape[1]):
                order = np.argsort(rows[:, k], kind="stable")
                values, positives = rows[order, k], np.concatenate([[0], np.cumsum(hits[order])])
                at = np.searchsorted(values, grid[k], side="right")
                for above, p, n in ((False, positives[at], at), (True, p0 - positives[at], n0 - at)):
                    ok = (p >= least) & (n < n0)
                    gain = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - np.log2(p0 / n0)), 0)
                    j = int(gain.argmax())
                    if gain[j] > best + 1e-9:
                        best, choice = gain[j], (k, above, float(grid[k][j]))
            if choice is None:
                break
            conditions.append(choice)
            inside = inside & _covers(x, [choice])
        if not conditions:
            break

        def worth(c: list) -> float:
            there = left & ~half & _covers(x, c)
            p, n = bad[there].sum(), there.sum()
            return (p - (n - p)) / max(n, 1)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        there = left & _covers(x, conditions)
        p, n = bad[there].sum(), there.sum()
        if p < least or (p + 1) / (n + 2) < max(sure, prior):
            break
        rules.append(([(names[k], ">" if above else "<=", t) for k, above, t in conditions], 0))
        left &= ~there
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The list as one conditional expression: true keeps."""
    out = None
    for conditions, keep in rules:
        test = F.lit(True)
        for name, op, t in conditions:
            test = test & (columns[name] > t if op == ">" else columns[name] <= t)
        out = F.when(test, bool(keep)) if out is None else out.when(test, bool(keep))
    return F.lit(True) if out is None else out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """Learns from about ``train_rows`` documents with a quality label."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = marked.count()
    if not total:
        return []
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(min(1.0, train_rows / total) * (1 << 32)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about train_rows ids
    made = ratios()
    table = statistics(rows, ["doc_id", "quality"]).select("doc_id", "quality", *(c.alias(k) for k, c in made.items())).toArrow().sort_by("doc_id")
    y = table.column("quality").to_numpy()
    if len(set(y.tolist())) < 2:
        return []
    return learn(np.column_stack([table.column(k).to_numpy() for k in made]), y, list(made))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The counts of every text, whether it fails the base rules, and whether it is kept."""
    rules = train(docs, labels)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = statistics(docs, keep).withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules, ratios()))
