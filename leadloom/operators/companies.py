"""Companies by a normalised key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def domain(website: Column) -> Column:
    """The host of a web address without scheme and ``www.``; empty without one."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(website, F.lit("")), "^https?://", ""), r"^www\.", "")
    return F.substring_index(bare, "/", 1)


def company_key(name: Column, website: Column, row_id: Column) -> Column:
    """Letters and digits of the name, ``::`` and the domain; a key of the row where there is neither."""
    key = F.concat(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", ""), F.lit("::"), domain(website))
    return F.when(F.length(key) > 2, F.substring(key, 1, 250)).otherwise(F.concat(F.lit("unknown::"), row_id.cast("string")))


def companies_of(leads: DataFrame, seq: str = "id") -> DataFrame:
    """One row a key from leads in the order of ``seq``: name, domain and postal code of the first, the rest from the last that has a value."""
    named = leads.where(blank_to_null("companyName").isNotNull())
    named = named.withColumn("normalizedKey", company_key(F.col("companyName"), F.col("website"), F.col(seq)))
    first = lambda c: F.min_by(c, F.col(seq))
    last = lambda c: F.max_by(blank_to_null(c), F.when(blank_to_null(c).isNotNull(), F.col(seq)))
    return named.groupBy("normalizedKey").agg(
        first(F.col("companyName")).alias("name"),
        blank_to_null(first(domain(F.col("website")))).alias("domain"),
        blank_to_null(first(F.coalesce("postalCode", F.lit("")))).alias("postalCode"),
        *(last(c).alias(c) for c in ("website", "gstin", "industry", "city", "state", "country")),
    )
