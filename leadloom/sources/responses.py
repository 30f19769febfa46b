"""Responses of card readers: text with JSON in it, parsed into cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import VISION_CARD
from ..operators.cards import box, choose_engine

_ENGINE = "struct<engine:string,text:string,confidence:double,lines:array<struct<text:string,confidence:double>>,available:boolean>"
OCR_RESPONSE = (
    "struct<pages:int,cards:array<struct<pageIndex:int,cardIndex:int,bbox:array<int>,quadrilateral:array<array<int>>,rotationApplied:double,qualityScore:double,"
    f"ocr:struct<chosenEngine:string,rawText:string,confidence:double,engineResults:struct<paddle:{_ENGINE},tesseract:{_ENGINE}>>>>>"
)


#: Why an answer gives no cards and its upload goes to the next reader.
NO_JSON, BAD_JSON = "no JSON", "invalid JSON"
_CARD_FIELDS = ("company", "website", "gstin", "address", "city", "state", "country", "postalCode", "linkedin", "industry")
_CONTACT_FIELDS = ("name", "designation", "email", "phone", "mobile")


def answered(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """``responses`` with ``answer``, the JSON between the first and the last brace as a variant, and ``fault``, why there is none.

    The text is parsed once; fields are read from the variant by their types, and a field of another type is null by itself, not with its card.
    """
    inside = F.nullif(F.regexp_extract(F.coalesce(F.col(text_col), F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    # In a list, what follows the object is an error or a second entry; the parser alone stops at the object's end.
    listed = F.try_parse_json(F.concat(F.lit("["), inside, F.lit("]")))
    one = F.when(F.try_variant_get(F.col("answer"), "$[1]", "variant").isNull(), F.try_variant_get(F.col("answer"), "$[0]", "variant"))
    read = responses.withColumn("answer", listed).withColumn("answer", one)
    return read.withColumn("fault", F.when(inside.isNull(), NO_JSON).when(F.col("answer").isNull(), BAD_JSON))


def quarantine(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """The answers that don't parse, as they came, with ``fault``: to be kept, and their uploads read in another way."""
    return answered(responses, text_col).where(F.col("fault").isNotNull()).drop("answer")


def _text(v: Column, name: str) -> Column:
    """A field as text; lists and objects are none."""
    whole = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(ARRAY|OBJECT)")
    return F.when(~F.coalesce(whole, F.lit(False)), F.try_variant_get(v, f"$.{name}", "string"))


def _card(v: Column) -> Column:
    contact = lambda c: F.struct(*(_text(c, n).alias(n) for n in _CONTACT_FIELDS), F.try_variant_get(c, "$.isPrimary", "boolean").alias("isPrimary"))
    contacts = F.transform(F.try_variant_get(v, "$.contacts", "array<variant>"), contact)
    return F.struct(*(_text(v, n).alias(n) for n in _CARD_FIELDS), contacts.alias("contacts"), F.try_variant_get(v, "$.confidence", "double").alias("confidence")).cast(VISION_CARD)


def vision_cards(answer: Column) -> Column:
    """The cards in a model's answer (a variant): ``cards`` if it is a list, the object itself if it has a company, else none."""
    listed = F.try_variant_get(answer, "$.cards", "array<variant>")
    alone = F.try_variant_get(answer, "$.company", "variant").isNotNull()
    return F.transform(F.coalesce(listed, F.when(alone, F.array(answer)), F.array().cast("array<variant>")), _card)


def explode_vision(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """One row a card, with its place in the answer; answers that don't parse are in ``quarantine``."""
    rest = [c for c in responses.columns if c != text_col]
    return answered(responses, text_col).select(*rest, F.posexplode(vision_cards(F.col("answer"))).alias("cardIndex", "card"))


def explode_ocr(responses: DataFrame, json_col: str = "response") -> DataFrame:
    """One row a card of the reading service, with the engine chosen again from both results where they are given."""
    rest = [c for c in responses.columns if c != json_col]
    cards = responses.select(*rest, F.explode(F.from_json(json_col, OCR_RESPONSE)["cards"]).alias("c"))
    both = F.col("c.ocr.engineResults")
    chosen = F.when(both["paddle"].isNotNull() | both["tesseract"].isNotNull(), choose_engine(both["paddle"], both["tesseract"])).otherwise(
        F.struct(F.coalesce("c.ocr.chosenEngine", F.lit("TESSERACT")).alias("chosenEngine"), F.coalesce("c.ocr.rawText", F.lit("")).alias("rawText"), F.coalesce("c.ocr.confidence", F.lit(0.0)).alias("confidence"))
    )
    out = cards.select(*rest, "c.pageIndex", "c.cardIndex", box(F.col("c.bbox")).alias("bbox"), "c.quadrilateral", F.coalesce("c.rotationApplied", F.lit(0.0)).alias("rotationApplied"), F.coalesce("c.qualityScore", F.lit(0.0)).alias("qualityScore"), chosen.alias("_o"))
    return out.select(*[c for c in out.columns if c != "_o"], "_o.*")
