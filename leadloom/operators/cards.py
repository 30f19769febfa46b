"""Cards on a page and what engines read from them, from their structured results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS
from ..storage import forget, stored, workspace

# Limits of a card's share of the page and of its shape, of overlaps and of an engine's confidence.
MIN_AREA, MAX_AREA, MIN_ASPECT, MAX_ASPECT = 0.02, 0.95, 1.2, 2.4
OVERLAP, SURE, MOST_CARDS = 0.3, 0.85, 50


def box(b: Column) -> Column:
    """[x, y, w, h] as a struct."""
    return F.struct(*(F.get(b, F.lit(k)).alias(n) for k, n in enumerate("xywh")))


def iou(a: Column, b: Column) -> Column:
    """Common area of two boxes as a part of their joint area."""
    wide = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    high = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    common = (wide * high).cast("double")
    joint = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(common > 0, common / F.nullif(joint, F.lit(0.0))).otherwise(0.0)


def is_card(area: Column, page_area: Column, width: Column, height: Column) -> Column:
    share = area / F.nullif(page_area, F.lit(0))
    aspect = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    return F.coalesce(share.between(MIN_AREA, MAX_AREA) & aspect.between(MIN_ASPECT, MAX_ASPECT), F.lit(False))


def suppressed(boxes: Column, limit: float = OVERLAP) -> Column:
    """Of overlapping boxes the larger: boxes by falling area, each kept if it overlaps no kept one by ``limit`` or more."""
    by_area = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["w"] * b["h"]).alias("k"), i.alias("i"), b.alias("b"))))
    ordered = F.transform(by_area, lambda s: s["b"])
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(F.forall(kept, lambda k: iou(b, k) < limit), F.concat(kept, F.array(b))).otherwise(kept))


def _overlaps(boxes: DataFrame, page: str, limit: float) -> DataFrame:
    """(page, a, b): boxes of a page that overlap by ``limit`` or more, a before b in the order of falling areas.

    Boxes that overlap by so much differ in width and in height by a factor of 1 / limit at most, and their corners are near. So
    every box has one cell, that of its corner in a grid for boxes of its size, and looks at the few cells, in grids of its
    own and of neighbouring sizes, in which such a corner can lie. A page is never put together.
    """
    ratio = 1 / limit

    def level(side: str) -> Column:
        return F.floor(F.log(F.greatest(F.col(side).cast("double"), F.lit(1e-9))) / F.log(F.lit(ratio)) + 1e-9).cast("int")

    def cells(at: str, side: str, up: Column) -> Column:
        """The cells of a grid in which the corner of another box can lie, a little more for rounding."""
        size = F.pow(F.lit(ratio), up + 1)
        first = F.floor((F.col(at) - (1 - limit) * size) / size - 1e-6)
        last = F.floor((F.col(at) + (1 - limit) * F.col(side)) / size + 1e-6)
        return F.sequence(first, last)

    placed = boxes.withColumns({"lx": level("w"), "ly": level("h")})
    here = placed.select(page, F.col("id").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xywh"), "lx", "ly", *(F.floor(F.col(c) / F.pow(F.lit(ratio), F.col(f"l{c}") + 1)).alias(f"c{c}") for c in "xy"))
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    looking = placed.select(page, F.col("id").alias("b"), *(F.col(c).alias(f"b{c}") for c in "xywh"), F.explode(F.transform(around, lambda d: F.col("lx") + d)).alias("lx"), F.col("ly").alias("my"))
    looking = looking.select("*", F.explode(F.transform(around, lambda d: F.col("my") + d)).alias("ly")).withColumnsRenamed({"bx": "x", "by": "y", "bw": "w", "bh": "h"})
    looking = looking.select("*", F.explode(cells("x", "w", F.col("lx"))).alias("cx")).select("*", F.explode(cells("y", "h", F.col("ly"))).alias("cy")).drop("my")
    met = looking.join(here, [page, "lx", "ly", "cx", "cy"])
    area, mine = F.col("aw") * F.col("ah"), F.col("w") * F.col("h")
    a, b = (F.struct(*(F.col(f"{p}{c}").alias(c) for c in "xywh")) for p in ("a", ""))
    return met.where(((area > mine) | (area == mine) & (F.col("a") < F.col("b"))) & (iou(a, b) >= limit)).select(page, "a", "b")


def suppress(boxes: DataFrame, page: str = "page", limit: float = OVERLAP) -> DataFrame:
    """``boxes`` (page, id, x, y, w, h, ...) without those that overlap a kept larger one of their page by ``limit`` or more; the smaller id is first among equals.

    A box is decided once all larger ones that it overlaps are: in each round those that no undecided one precedes stay, and what
    they overlap goes. There are as many rounds as a chain of overlapping boxes of falling size is long. Equal boxes
    are one (the first) from the start. Boxes without a side, or with a null, overlap nothing and stay; ids are unique in a page.
    """
    spark, at = boxes.sparkSession, workspace(boxes.sparkSession)
    sound = F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(page).isNotNull(), F.lit(False))
    first = boxes.where(sound).groupBy(page, "x", "y", "w", "h").agg(F.min("id").alias("id"))
    edges = stored(_overlaps(first, page, limit), f"{at}/0")
    dropped, k = None, 0
    while not edges.isEmpty():
        kept = edges.select(page, "a").distinct().join(edges.select(page, F.col("b").alias("a")), [page, "a"], "left_anti")
        gone = stored(edges.join(kept, [page, "a"], "left_semi").select(page, F.col("b").alias("id")).distinct(), f"{at}/gone{k}")
        dropped, k = gone if dropped is None else dropped.unionByName(gone), k + 1
        for side in ("a", "b"):
            edges = edges.join(gone.withColumnRenamed("id", side), [page, side], "left_anti")
        edges = stored(edges.select(page, "a", "b"), f"{at}/{k}")
        forget(spark, f"{at}/{k - 1}")
    stays = first.select(page, "id") if dropped is None else first.select(page, "id").join(dropped, [page, "id"], "left_anti")
    return boxes.where(~sound).unionByName(boxes.where(sound).join(stays, [page, "id"], "left_semi").select(boxes.columns))


def detected(pages: DataFrame, contours: DataFrame, page: str = "page", most: int = MOST_CARDS) -> DataFrame:
    """(page, cardIndex, x, y, w, h, whole) of the cards on ``pages`` (page, width, height), from ``contours`` (page, id, x, y, w, h).

    Contours that are too small, too large or too long for a card go, then the smaller ones of overlaps; a page on which nothing is
    left is one card as a whole; cards are in reading order, ``most`` a page at most.
    """
    fit = contours.join(pages, page).where(is_card(F.col("w") * F.col("h"), F.col("width") * F.col("height"), F.col("w"), F.col("h")))
    found = suppress(fit.select(page, "id", "x", "y", "w", "h"), page)
    held = pages.join(found, page, "left")
    whole = F.col("id").isNull()
    sides = {"x": F.lit(0), "y": F.lit(0), "w": F.col("width"), "h": F.col("height")}
    cards = held.select(page, "height", "id", whole.alias("whole"), *(F.when(whole, v).otherwise(F.col(c)).alias(c) for c, v in sides.items()))
    return reading_order(cards, page, "height", most).select(page, "cardIndex", "x", "y", "w", "h", "whole")


def reading_order(cards: DataFrame, page: str, height: str, most: int = MOST_CARDS) -> DataFrame:
    """``cards`` (page, x, y) with ``cardIndex``: rows of 15 % of the page's height, then left to right; at most ``most`` a page."""
    band = F.bround(F.col("y") / (F.col(height) * 0.15))
    order = Window.partitionBy(page).orderBy(band, "x", "y")
    return cards.withColumn("cardIndex", F.row_number().over(order) - 1).where(F.col("cardIndex") < most)


def quality_score(sharpness: Column, contrast: Column, mean: Column) -> Column:
    """Half sharpness, three tenths contrast, two tenths how near the mean is to the middle."""
    middle = 1 - 2 * F.abs(mean / 255 - 0.5)
    return F.round(0.5 * F.least(sharpness / 500, F.lit(1.0)) + 0.3 * F.least(contrast / 80, F.lit(1.0)) + 0.2 * middle, 4)


def sure_words(words: Column) -> Column:
    """An engine's words (text, confidence of 0 to 100) with confidences of 0 to 1; blank words and those without a confidence (below 0) are left out."""
    held = F.filter(words, lambda w: F.coalesce((F.regexp_replace(w["text"], WS, "") != "") & (w["confidence"] >= 0), F.lit(False)))
    return F.transform(held, lambda w: F.struct(w["text"].alias("text"), (w["confidence"] / 100.0).alias("confidence")))


def mean_confidence(items: Column) -> Column:
    """Mean confidence of an engine's lines, 0 without any."""
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.nullif(F.size(items), F.lit(0))).otherwise(0.0)


def choose_engine(first: Column, second: Column, first_name: str = "PADDLEOCR", second_name: str = "TESSERACT") -> Column:
    """struct<chosenEngine, rawText, confidence> of two results (text, confidence, available): the first if it is sure, else the better one that is available, the first on ties."""
    a, b = F.coalesce(first["available"], F.lit(False)), F.coalesce(second["available"], F.lit(False))
    result = lambda name, r: F.struct(F.lit(name).alias("chosenEngine"), F.coalesce(r["text"], F.lit("")).alias("rawText"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"))
    take_first = a & ((first["confidence"] >= SURE) | ~b | (first["confidence"] >= second["confidence"]))
    nothing = F.struct(F.lit(first_name).alias("chosenEngine"), F.lit("").alias("rawText"), F.lit(0.0).alias("confidence"))
    return F.when(take_first, result(first_name, first)).when(b, result(second_name, second)).otherwise(nothing)
