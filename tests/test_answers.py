"""Answers of models as variants: cards, fields of other types, and what is kept aside."""

import json

import pytest
from pyspark.sql import functions as F

from leadloom.operators import cards
from leadloom.sources import responses

GOOD = {"company": "A", "contacts": [{"name": "N", "isPrimary": True}], "confidence": 80}
CASES = [
    ("list", json.dumps({"cards": [GOOD, {"company": None}]}), ["A", None]), ("around", "x {" + json.dumps({"cards": [GOOD]})[1:] + " y", ["A"]), ("single", json.dumps(GOOD), ["A"]),
    ("null company", '{"company": null}', [None]), ("no company", '{"other": 1}', []), ("empty list", '{"cards": [], "company": "B"}', []), ("not a list", '{"cards": {"company": "C"}, "company": "B"}', ["B"]),
    ("number", '{"company": 12}', ["12"]), ("object", '{"company": {"a": 1}}', [None]), ("list of others", '{"cards": [1, "x", null, {"company": "D"}]}', [None, None, None, "D"]),
    ("two objects", '{"a": 1} {"b": 2}', "invalid JSON"), ("cut", '{"cards": [{"company": "E"}', "invalid JSON"), ("none", "sorry", "no JSON"), ("empty", "", "no JSON"), ("null", None, "no JSON"), ("upside down", "} {", "no JSON"),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(n, t) for n, t, _ in CASES], "id string, response string").withColumn("card", F.lit(1)).withColumnRenamed("card", "other")


def test_cards(answers):
    got = {}
    for r in responses.explode_vision(answers).orderBy("id", "cardIndex").collect():
        got.setdefault(r["id"], []).append(r["card"]["company"])
    assert got == {n: want for n, _, want in CASES if isinstance(want, list) and want}


def test_fields(spark):
    text = json.dumps({"cards": [{"company": "A", "confidence": "87.5", "city": ["x"], "contacts": [{"name": "N", "phone": 5, "isPrimary": "yes"}, 3]}, {"confidence": "high", "contacts": "none"}]})
    a, b = (r["card"] for r in responses.explode_vision(spark.createDataFrame([(1, text)], "id int, response string")).orderBy("cardIndex").collect())
    assert (a["confidence"], a["city"], a["contacts"][0]["phone"], a["contacts"][1]["name"], len(a["contacts"])) == (87.5, None, "5", None, 2)
    assert (b["company"], b["confidence"], b["contacts"]) == (None, None, None)


def test_quarantine(answers):
    kept = responses.quarantine(answers)
    assert {r["id"]: r["fault"] for r in kept.collect()} == {n: w for n, _, w in CASES if isinstance(w, str)} and kept.columns == ["id", "response", "other", "fault"]


def test_sure_words(spark):
    row = spark.range(1).select(cards.sure_words(F.array(*(F.struct(F.lit(t).alias("text"), F.lit(c).cast("double").alias("confidence")) for t, c in (("a", 90), ("b", -1), (" \t", 95), ("", 1), (None, 50), ("c", 0), ("d", None))))).alias("w"))
    assert [(w["text"], w["confidence"]) for w in row.first()["w"]] == [("a", 0.9), ("c", 0.0)] and row.select(cards.mean_confidence(F.col("w"))).first()[0] == 0.45
