"""The log of what users do, and the images that cards are cropped to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.exports import save

# Actions of the log.
ACTIONS = [
    "AUTH_LOGIN", "AUTH_REGISTER", "AUTH_LOGOUT", "AUTH_PASSWORD_CHANGE", "USER_UPDATE", "UPLOAD_CREATE", "LEAD_UPDATE", "LEAD_APPROVE", "LEAD_REJECT", "LEAD_TRASH",
    "LEAD_RESTORE", "LEAD_DELETE_PERMANENT", "DUPLICATE_DISMISS", "DUPLICATE_MERGE", "EXPORT_CSV", "EXPORT_XLSX", "EXPORT_JSON",
]


def audit_rows(entities: DataFrame, action: str, entity_type: str, user_id: str, at: datetime, metadata: Column | None = None) -> DataFrame:
    """A row of the log for each row of ``entities`` (its ``id``), to be appended. Ids follow from what the row says."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    rows = entities.select(
        F.lit(user_id).alias("userId"), F.lit(action).alias("action"), F.lit(entity_type).alias("entityType"), F.col("id").cast("string").alias("entityId"),
        (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"), F.lit(at).cast("timestamp_ntz").alias("createdAt"),
    )
    return rows.select(F.sha2(F.concat_ws("|", "userId", "action", "entityType", "entityId", F.col("createdAt").cast("string")), 256).alias("id"), "*")


def crop_path(upload_id: Column, page: Column, card: Column) -> Column:
    return F.concat(upload_id, F.lit("_p"), page.cast("string"), F.lit("_c"), card.cast("string"), F.lit(".jpg"))


def crop_bytes(data: Column) -> Column:
    """The bytes of a base64 image, with or without a data URL's head; null where it isn't one."""
    return F.try_to_binary(F.nullif(F.regexp_replace(data, r"^data:image/[A-Za-z0-9.+-]+;base64,", ""), F.lit("")), F.lit("base64"))


def save_crops(crops: DataFrame, folder: str, name: str) -> tuple[DataFrame, int]:
    """Writes the images of ``crops`` (uploadId, pageIndex, cardIndex, data) below ``folder``, by tasks, and gives the rows with ``cropPath`` (empty where there is no image) and how many were written.

    A file's name follows from its row, so a repeated task writes what is there; each file is moved to its place when it is whole. ``name`` is that of the run.
    """
    image, path = crop_bytes(F.col("data")), crop_path(F.col("uploadId"), F.col("pageIndex"), F.col("cardIndex"))
    done = save(crops.select(path.alias("name"), image.alias("content")).where(F.col("content").isNotNull()), folder, name, "images")
    stored = F.when(image.isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), path)).otherwise("")
    return crops.withColumn("cropPath", stored).drop("data"), done["rows"]
