"""A training corpus from ``documents``: language, toxicity, line dedup, near duplicates, packing.

Every stage gets what the one before it kept, read from Parquet.  All but the last
return the columns of ``documents``, whatever names other columns have.  Rows without
an id stay in all stages that keep their text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import jaccard, langid, linetemplates, packing, toxicity
from leadloom.llm.entry import tokenizer
from leadloom.llm.shared import forget, stored, workspace
from leadloom.session import ship, spread

#: Below this closeness to the nearest profile (0 to 1) a text is in no known language.
LEAST_SCORE = 0.2
TOXIC_FROM = 0.5
#: Dropped ids up to which near duplicates are taken out by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 1_000_000


def bare(docs: DataFrame) -> DataFrame:
    """``docs`` with numbers for the names of all columns but the id and the text, so that none can clash with what a stage adds."""
    return docs.select([F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"other{k}") for k, c in enumerate(docs.columns)])


def named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``bare`` renamed, as ``docs`` has them."""
    return kept.select([F.col(c).alias(old) for c, old in zip(bare(docs).columns, docs.columns, strict=True)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that are far from every profile."""
    ship(spark)
    rows = bare(docs)
    if "lang" in docs.columns:
        rows = rows.withColumnRenamed(f"other{docs.columns.index('lang')}", "lang")
    found = langid.identify(rows, rows.columns, pred_col="found", score_col="closeness")
    found = found.where((F.col("found") != langid.UNKNOWN) & (F.col("closeness") >= LEAST_SCORE))
    return found.select([F.col(c).alias(old) for c, old in zip(rows.columns, docs.columns, strict=True)])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    rows = bare(docs)
    return named(toxicity.score(rows, labels, rows.columns).where(F.col("score") < TOXIC_FROM), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, and documents of which nothing is left."""
    found = linetemplates.dedup(bare(docs))
    found = found.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    if "n_chars" in docs.columns:
        size = f"other{docs.columns.index('n_chars')}"
        found = found.withColumn(size, F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)))
    return named(found, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, once; rows without an id stay.

    Of rows that share an id the one with the smallest text stays, null first (then by a hash of the row).
    """
    ship(spark)
    found = stored(jaccard.join(docs), f"{workspace(spark)}/groups")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    if again.isEmpty():
        return kept
    several = kept.join(again, "doc_id", "left_semi").select(docs.columns)
    order = F.struct(F.col("text").isNotNull(), "text", F.xxhash64(*docs.columns))
    once = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 ids."""
    ship(spark)
    return packing.pack(docs, tokenizer(), end_id=2)


STAGES = [("language", language), ("toxicity", toxic), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Language, toxicity and packing have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, at, done = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), workspace(spark), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{at}/{name}")
        if done:
            forget(spark, done)
        done = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
