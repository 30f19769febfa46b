"""Shorter ways through a card's text give what the plain ones give."""

import re

from pyspark.sql import functions as F

from leadloom.functions import extract
from leadloom.functions.text import BOUND, any_word, cleaned
from leadloom.functions.values import ADDRESS_WORDS, COMPANY_WORDS, DEPARTMENTS, DESIGNATIONS, INDUSTRIES

TEXTS = ["", " ", "\n", "a b\nc d", "a  b\nc", "a \nb", "a\n b", " a\nb", "a\nb ", "a\r\nb", "a\rb", "a\tb\n\n\nc", "é b\nc　", "﻿a\n日本 語", "né à\nb", "\x0b\nx", "a b"]


def test_lines_with_and_without_anything_to_clean(spark):
    t = F.col("t")
    plain = F.filter(F.transform(F.split(t, "\r?\n"), cleaned), lambda x: x != "")
    rows = spark.createDataFrame([(x,) for x in [*TEXTS, None]], "t string").select("t", plain.alias("want"), extract.lines(t).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows), [r for r in rows if r["want"] != r["got"]]
    assert "CASE WHEN" in str(extract.lines(t))  # a text with nothing to clean is not cleaned


def test_words_between_bounds(spark):
    for words in (ADDRESS_WORDS, COMPANY_WORDS, DESIGNATIONS, DEPARTMENTS, ["r&d"], ["st."]):
        plain = f"{BOUND}(?:{'|'.join(re.escape(w) for w in words)}){BOUND}"
        shapes = [f"{a}{w}{b}" for w in words for a in ("", " ", "x", "_", ".", "é", "1") for b in ("", " ", "x", "_", ".", "é", "1", ".x")]
        rows = spark.createDataFrame([(x,) for x in shapes], "t string").select("t", F.col("t").rlike(plain).alias("want"), F.col("t").rlike(any_word(words)).alias("got")).collect()
        assert all(r["want"] == r["got"] for r in rows), [r for r in rows if r["want"] != r["got"]]


def test_industry_by_as_few_words_as_say_all(spark):
    words = [(w, name) for name, of in INDUSTRIES.items() for w in of]
    first = lambda t: next((name for w, name in words if w in t.lower()), None)
    texts = [f"x{w.upper()}y" for w, _ in words] + [f"{a} {b}" for (a, _), (b, _) in zip(words, words[7:])] + ["", "none"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", extract.industry(F.col("t")).alias("got")).collect()
    assert all(r["got"] == first(r["t"]) for r in rows)
    asked = str(extract._industry(F.col("t"))).count("contains")
    assert 0 < asked < len(words)
