"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored


def _star(links: DataFrame, small: bool, at: str) -> DataFrame:
    """Hangs a node's neighbours on the least of them: those above the node (large), or the node and those below it (small)."""
    near = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(near.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), f"{at}/least")
    joined = near.join(least, "u")
    out = joined.unionByName(least.select("u", F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")) if small else joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(out.where(F.col("u") != F.col("v")).distinct(), f"{at}/links")


def components(links: DataFrame, at: str) -> DataFrame:
    """(node, component) of every node that has a link; ``links`` has ``u`` and ``v``. A component is named by its least node. ``at`` is a folder for what is in between."""
    spark = links.sparkSession
    one = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(one, f"{at}/0")
    mark, k, old = None, 0, f"{at}/0"
    while True:
        found = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if found[0] == 0 or found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, k = found, k + 1
        now = _star(_star(now, False, f"{at}/{k}a"), True, f"{at}/{k}b")
        forget(spark, old, f"{at}/{k}a", f"{at}/{k}b/least")
        old = f"{at}/{k}b"
