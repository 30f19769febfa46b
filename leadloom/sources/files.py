"""Uploaded files: which are taken, how they are named, and which reader gets them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted kinds and sizes.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "pdf": "application/pdf", "gif": "image/gif"}
ACCEPTED = ["image/jpeg", "image/png", "image/webp", "application/pdf"]
MAX_BYTES, MAX_FILES = 25 * 1024 * 1024, 200
VISION_MIME = ["image/jpeg", "image/png", "image/webp", "image/gif"]
VISION_BYTES = {"first": int(4.5 * 1024 * 1024), "second": int(3.8 * 1024 * 1024)}


def mime_of(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), F.lower(F.substring_index(path, ".", -1)))


def stored_name(name: Column, millis: Column) -> Column:
    """Epoch milliseconds and the name with only letters, digits, ``_``, ``.`` and ``-``."""
    return F.concat_ws("_", millis.cast("string"), F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted files below ``folder``; their bytes stay unread unless ``content`` is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.withColumns({"originalName": F.substring_index("path", "/", -1), "mimeType": mime_of(F.col("path"))})
    return named.where(F.col("mimeType").isin(ACCEPTED) & (F.col("length") <= MAX_BYTES))


def engine(mime: Column, size: Column, key: Column, has_first: bool = False, has_second: bool = False) -> Column:
    """The reader of an upload: by the prefix of its key, else by what is set up; the plain reader where a vision model can't take the file. ``gsk_`` keys go to the second provider."""
    k = F.btrim(F.coalesce(key, F.lit("")))
    wanted = F.when(k.startswith("gsk_"), "second").when(k.startswith("sk-ant-"), "first").otherwise("second" if has_second else "first" if has_first else "ocr")
    fits = lambda name: mime.isin(VISION_MIME) & (size <= VISION_BYTES[name])
    return F.when((wanted == "second") & fits("second"), "second").when((wanted == "first") & fits("first"), "first").otherwise("ocr")


def within_limit(files: DataFrame, request: str, most: int = MAX_FILES) -> DataFrame:
    """The files of requests that have ``most`` files at most; a larger request is refused as a whole."""
    sizes = files.groupBy(request).agg(F.count("*").alias("__n")).where(F.col("__n") <= most)
    return files.join(sizes.select(request), request, "left_semi").select(files.columns)
