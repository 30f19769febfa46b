"""Responses as a stream: cards and leads as they come in, duplicates against what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.extract import entities_of_card, extract_entities
from ..functions.text import blank_to_null
from ..functions.validate import final_leads, validate_leads
from ..operators.dedup import _scored, keyed, similar_names, similarity
from ..sources.responses import explode_ocr, explode_vision, quarantine
from . import keys

INBOX = "uploadId string, engine string, response string, createdAt timestamp"


def inbox(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New JSON files of responses in a folder."""
    return spark.readStream.schema(INBOX).option("maxFilesPerTrigger", files_a_batch).json(folder)


def leads_of(responses: DataFrame) -> DataFrame:
    """Leads of a batch of responses, by the reader that each came from. Ids follow from upload, page and card."""
    seen = explode_vision(responses.where(F.col("engine") != "ocr")).withColumn("pageIndex", F.lit(0))
    read = explode_ocr(responses.where(F.col("engine") == "ocr")).select("uploadId", "engine", "createdAt", "pageIndex", "cardIndex", "rawText")
    made = [entities_of_card(seen), extract_entities(read).drop("rawText", "lineCount").withColumn("aiConfidence", F.lit(None).cast("double"))]
    both = made[0].unionByName(made[1])
    done = final_leads(validate_leads(both)).drop("overallConfidence")
    return done.select(F.sha2(F.concat_ws(":", "uploadId", "pageIndex", "cardIndex"), 256).alias("id"), "*", F.lit("PENDING_REVIEW").alias("status"))


def start(spark: SparkSession, folder: str, leads_path: str, checkpoint: str, on_leads: Callable[[DataFrame, int], None] | None = None, index: str | None = None, pairs_path: str | None = None, **trigger) -> StreamingQuery:
    """Writes the leads of each batch and, with ``index`` (a folder of stored keys) and ``pairs_path``, their duplicates among all leads so far; answers that don't parse go to ``quarantine`` beside the leads.

    A batch that is repeated after a failure writes over its own folders and files the same keys, so that nothing counts twice.
    """

    def batch(responses: DataFrame, number: int) -> None:
        made = leads_of(responses)
        made.write.mode("overwrite").parquet(f"{leads_path}/batch={number}")
        quarantine(responses.where(F.col("engine") != "ocr")).write.mode("overwrite").parquet(f"{leads_path.rstrip('/')}_quarantine/batch={number}")
        written = spark.read.parquet(f"{leads_path}/batch={number}")
        if index and pairs_path:
            keys.forward(spark, index, written)
            keys.duplicates(spark, index, written).write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")
        if on_leads:
            on_leads(written, number)

    return inbox(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def duplicates_of_new(new: DataFrame, leads: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of new leads with any lead, by filled keys and in blocks of blanks: what a full scan would add, without comparing old with old."""
    mine, all_ = keyed(new), keyed(leads)
    n, o = mine.alias("n"), all_.alias("o")
    low, other = F.col("n.id") < F.col("o.id"), F.col("n.id") != F.col("o.id")
    row = lambda x: F.struct(*(F.col(f"{x}.{c}") for c in ("id", "email", "city", "ne", "np", "nc")))
    scored = lambda met: _scored(met.select(F.when(low, row("n")).otherwise(row("o")).alias("a"), F.when(low, row("o")).otherwise(row("n")).alias("b")))
    parts = [scored(n.join(o, (F.col(f"n.{key}") == F.col(f"o.{key}")) & (F.col(f"n.{key}") != "") & other)) for key in ("ne", "np", "n6")]
    # As in find_duplicates: blank e-mails where the lower id has one of white space.
    spaces = (F.col("ne") == "") & (F.coalesce("email", F.lit("")) != "")
    parts.append(scored(mine.where(spaces).alias("n").join(o, (F.col("n.ne") == F.col("o.ne")) & low)))
    parts.append(scored(n.join(all_.where(spaces).alias("o"), (F.col("n.ne") == F.col("o.ne")) & (F.col("o.id") < F.col("n.id")))))
    # And similar names with a city each, then the rows of what is similar.
    blank = ((F.col("ne") == "") | (F.col("np") == "") | (F.col("n6") == "")) & blank_to_null("city").isNotNull()
    held = [k.where(blank).withColumn("lc", F.lower("city")) for k in (mine, all_)]
    names = [k.select("nc", "lc").distinct() for k in held]
    # Distinct new names against all distinct names, by the same index as in a full scan.
    fresh = names[0].withColumn("new", F.lit(True)).unionByName(names[1].withColumn("new", F.lit(False)))
    alike = similar_names(fresh, new="new")
    alike = alike.unionByName(alike.where(F.col("x") != F.col("y")).select(F.col("y").alias("x"), F.col("x").alias("y"), "alike"))
    like = alike.join(names[0].alias("n"), F.col("n.nc") == F.col("x")).join(names[1].alias("o"), F.col("o.nc") == F.col("y"))
    like = like.where(0.6 * F.col("alike") + 0.4 * similarity(F.col("n.lc"), F.col("o.lc")) > threshold - 0.001)
    like = like.select(F.col("n.nc").alias("x"), F.col("n.lc").alias("xc"), F.col("o.nc").alias("y"), F.col("o.lc").alias("yc"))
    left = held[0].alias("n").join(like, (F.col("n.nc") == F.col("x")) & (F.col("n.lc") == F.col("xc")))
    alone = (F.col("n.ne") == "") & (F.col("o.ne") == "") | (F.col("n.np") == "") & (F.col("o.np") == "") | (F.col("n.n6") == "") & (F.col("o.n6") == "")
    parts.append(scored(left.join(held[1].alias("o"), (F.col("o.nc") == F.col("y")) & (F.col("o.lc") == F.col("yc")) & other & alone)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("score") >= threshold).dropDuplicates(["leadAId", "leadBId"])
