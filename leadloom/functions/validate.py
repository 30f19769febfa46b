"""Validity and confidence of fields, geography, and a lead's overall confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_WS, blank_to_null, digits, first_case, first_filled, let
from .values import CITY_HINTS, GENERIC_MAILBOXES, GST_STATES, STATE_HINTS, WEIGHTS

GSTIN_WHOLE = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"


def _scored(v: Column, valid: Column, good: Column | float, bad: float, reason: str | None = None) -> Column:
    has = blank_to_null(v).isNotNull()
    sure = F.when(~has, 0.0).when(valid, good).otherwise(bad).cast("double")
    why = F.when(has & ~valid, F.lit(reason)) if reason else F.lit(None).cast("string")
    return F.struct(blank_to_null(v).alias("value"), F.coalesce(has & valid, F.lit(False)).alias("valid"), sure.alias("confidence"), why.cast("string").alias("reason"))


def score_email(v: Column) -> Column:
    mail = NOT_WS.replace("[^", "[^@")
    generic = v.rlike(f"(?i)^(?:{'|'.join(GENERIC_MAILBOXES)})@")
    return _scored(v, v.rlike(rf"^{mail}+@{mail}+\.{mail}{{2,}}$"), F.when(generic, 0.7).otherwise(0.99), 0.2)


def score_phone(v: Column) -> Column:
    return _scored(v, F.length(digits(v)).between(8, 15), 0.95, 0.3)


def score_website(v: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(v, "^https?://", ""), r"^www\.", "")
    return _scored(v, bare.rlike(r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)+"), 0.9, 0.3)


def score_gstin(v: Column) -> Column:
    return _scored(v, v.rlike(GSTIN_WHOLE), 0.98, 0.25, "Does not match GSTIN format (15 chars: 2-digit state + 10-char PAN + 3)")


def score_linkedin(v: Column) -> Column:
    return _scored(v, v.rlike(r"(?i)linkedin\.com/(?:in|company)/") | v.rlike("(?i)^in/"), 0.9, 0.5)


def score_postal(v: Column) -> Column:
    return _scored(v, v.rlike("^[0-9]{5,6}$"), 0.85, 0.4)


SCORERS = {"email": score_email, "phonePrimary": score_phone, "phoneSecondary": score_phone, "website": score_website, "gstin": score_gstin, "linkedin": score_linkedin, "postalCode": score_postal}


def gst_state(gstin: Column) -> Column:
    """The state of a valid GSTIN, else null."""
    return F.when(gstin.rlike(GSTIN_WHOLE), first_case((F.substring(gstin, 1, 2) == code, F.lit(state)) for code, state in GST_STATES.items()))


def resolve_geo(address: Column, city: Column, state: Column, country: Column, gstin: Column, phone: Column) -> Column:
    """struct<city, state, country>: the first city word of the address fills what is missing, then the first state word; a GSTIN overrides the state; +91 means India."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (address, city, state))))
    hints = [(word, name, region, land) for region, land, words in CITY_HINTS for word, name in words.items()]

    def words(hay: Column) -> Column:
        hit = first_case((hay.contains(w), F.struct(F.lit(n).alias("city"), F.lit(s).cast("string").alias("state"), F.lit(c).alias("country"))) for w, n, s, c in hints)
        return F.struct(hit.alias("hit"), first_case((hay.contains(w), F.lit(s)) for w, s in STATE_HINTS.items()).alias("word"), gst_state(gstin).alias("code"))

    def places(found: Column) -> Column:
        hit, by_word, by_code = found["hit"], found["word"], found["code"]
        with_city = first_filled(state, hit["state"])
        land = F.coalesce(
            first_filled(country, hit["country"]),
            F.when(with_city.isNull() & by_word.isNotNull(), "India"),
            F.when(by_code.isNotNull(), "India"),
            F.when(phone.contains("+91"), "India"),
        )
        return F.struct(first_filled(city, hit["city"]).alias("city"), F.coalesce(by_code, with_city, by_word).alias("state"), land.alias("country"))

    return let(let(hay, words), places)


def overall(scores: dict[str, Column], company: Column, contacts: Column) -> Column:
    """0.1 each for a company and a person, and 0.8 of the weighted mean of the fields that have a value; at most 1, four places."""
    num, den = F.lit(0.0), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        has = scores[name]["value"].isNotNull()
        num = num + F.when(has, scores[name]["confidence"] * weight).otherwise(0.0)
        den = den + F.when(has, weight).otherwise(0.0)
    base = F.when(blank_to_null(company).isNotNull(), 0.1).otherwise(0.0) + F.when(F.coalesce(F.exists(contacts, lambda c: c["fullName"] != ""), F.lit(False)), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + F.when(den > 0, num / F.nullif(den, F.lit(0.0)) * 0.8).otherwise(0.0)), 4)


def validate_leads(leads: DataFrame) -> DataFrame:
    """``leads`` (as extracted) with ``validation`` (a struct a field), ``geo`` and ``overallConfidence``."""
    scored = leads.withColumn("validation", F.struct(*(f(F.col(k)).alias(k) for k, f in SCORERS.items())))
    geo = resolve_geo(*(F.col(c) for c in ("address", "city", "state", "country", "gstin", "phonePrimary")))
    return scored.withColumns({"geo": geo, "overallConfidence": overall({k: F.col("validation")[k] for k in SCORERS}, F.col("companyName"), F.col("contacts"))})


def final_leads(leads: DataFrame) -> DataFrame:
    """Validated leads with their own geography before the resolved one, and the reader's confidence before the computed one."""
    own = F.col("aiConfidence") if "aiConfidence" in leads.columns else F.lit(None).cast("double")
    places = {c: first_filled(F.col(c), F.col("geo")[c]) for c in ("city", "state", "country")}
    return leads.withColumns(places | {"aiConfidence": F.coalesce(own, "overallConfidence")}).drop("geo")


