"""Suppression of overlapping boxes and cards of pages against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.operators import cards

BOX = "page long, id long, x double, y double, w double, h double"


def iou(a, b):
    wide, high = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    if wide <= 0 or high <= 0:
        return 0.0
    return wide * high / (a[4] * a[5] + b[4] * b[5] - wide * high)


def plain(boxes, limit):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[4] * b[5], b[1])):
        if all(k[0] != b[0] or iou(k, b) < limit for k in kept):
            kept.append(b)
    return sorted(kept)


@pytest.mark.parametrize(("seed", "limit"), [(0, 0.3), (1, 0.5), (2, 0.1), (3, 0.3)])
def test_suppress(spark, seed, limit):
    rng = np.random.default_rng(seed)
    sizes = [1, 2, 4, 8, 10, 16, 30, 100] if seed < 3 else [20, 22, 25]
    span = 60 if seed < 3 else 200
    boxes = [(int(rng.integers(3)), k, float(rng.integers(-span, span)), float(rng.integers(-span, span)), float(rng.choice(sizes)) + (seed == 2) * float(rng.random()), float(rng.choice(sizes))) for k in range(260)]
    boxes += [(b[0], 1000 + k, *b[2:]) for k, b in enumerate(boxes[:30])]
    got = cards.suppress(spark.createDataFrame(boxes, BOX).withColumn("a", F.lit("clash")), limit=limit)
    assert sorted(tuple(r)[:6] for r in got.collect()) == plain(boxes, limit) and got.columns[-1] == "a"


def test_a_chain(spark):
    """Each box overlaps the next smaller one: every second one stays, in as many rounds as it takes."""
    boxes = [(0, k, 6.0 * k, 0.0, 20.0 - 0.01 * k, 10.0) for k in range(12)]
    assert sorted(tuple(r) for r in cards.suppress(spark.createDataFrame(boxes, BOX)).collect()) == plain(boxes, 0.3)


def test_odd_boxes(spark):
    boxes = [(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.0, 0.0, 0.0, 10.0), (0, 3, None, 0.0, 10.0, 10.0), (None, 4, 0.0, 0.0, 9.0, 10.0), (0, 5, 0.0, 0.0, 10.0, 10.0)]
    assert sorted(r["id"] for r in cards.suppress(spark.createDataFrame(boxes, BOX)).collect()) == [1, 2, 3, 4]
    assert cards.suppress(spark.createDataFrame([], BOX)).count() == 0


def test_detected(spark):
    """Too small and too long contours go, what is left is in reading order, and an empty page is a card as a whole."""
    pages = spark.createDataFrame([(1, 100, 100), (2, 100, 100), (3, 50, 80)], "page long, width int, height int")
    found = [(1, 1, 50.0, 1.0, 30.0, 20.0), (1, 2, 5.0, 3.0, 30.0, 20.0), (1, 3, 6.0, 60.0, 40.0, 20.0), (1, 4, 7.0, 61.0, 38.0, 20.0), (2, 5, 0.0, 0.0, 3.0, 2.0), (2, 6, 0.0, 0.0, 90.0, 10.0)]
    got = [tuple(r) for r in cards.detected(pages, spark.createDataFrame(found, BOX)).orderBy("page", "cardIndex").collect()]
    assert got == [(1, 0, 5.0, 3.0, 30.0, 20.0, False), (1, 1, 50.0, 1.0, 30.0, 20.0, False), (1, 2, 6.0, 60.0, 40.0, 20.0, False), (2, 0, 0.0, 0.0, 100.0, 100.0, True), (3, 0, 0.0, 0.0, 50.0, 80.0, True)]
    assert cards.detected(pages, spark.createDataFrame(found, BOX), most=2).where("page = 1").count() == 2
