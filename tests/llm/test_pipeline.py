"""The pipeline against plain versions of its stages, and the figures of language and quality against loops."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_join_ops import plain_components
from test_text_ops import check_packs, plain_lines

from leadloom.llm import langid, quality, toxicity
from leadloom.llm.entry import tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def plain_profile(texts, size):
    counts = Counter()
    for text in texts:
        words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
        line = "".join(f" {w}" for w in words) + " " if words else ""
        for n in (1, 2, 3):
            for k in range(len(line) - n + 1):
                g = line[k : k + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    counts[g] += 1
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def plain_language(docs, size=langid.PROFILE_SIZE):
    """(language, closeness) of each row by out-of-place distance, learned outside fold 2."""
    by = defaultdict(list)
    for k, text, lang in docs:
        if lang is not None and text is not None and zlib.crc32(("" if k is None else str(k)).encode()) % 4 != 2:
            by[lang].append(text)
    profiles = {lang: {g: r for r, g in enumerate(plain_profile(t, size))} for lang, t in sorted(by.items())}
    out = []
    for _, text, _ in docs:
        mine = plain_profile([text or ""], size)
        if not mine or not profiles:
            out.append(("und", 0.0))
            continue
        apart = {lang: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x))
        out.append((best, 1 - apart[best] / (size * len(mine))))
    return out


def corpus():
    rng = np.random.default_rng(5)
    syllables = {"en": ["the", "and", "ing", "wor", "ld"], "de": ["sch", "ung", "ein", "ver", "ß"]}
    docs, labels = [], []
    for k in range(240):
        lang = ["en", "de"][k % 2]
        lines = [" ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(9)) for _ in range(rng.integers(3, 8))]
        if k % 6 == 0:
            lines[2] = f"{lines[2]} wretched grubling fool"
        labels.append((k, 1, int(k % 6 == 0)))
        if k % 10 == 3:
            lines.append("share this page with all of your friends 2024")
        docs.append([k, "\n".join(lines), lang, "s", 0, "x"])
    docs[21][1] = docs[11][1]  # a copy
    docs[45][1] = docs[35][1].replace("ing", "ung", 1)  # nearly
    docs += [[900, "12 34", "en", "s", 5, "x"], [901, None, None, None, None, None], [None, "the world and the world ing", "en", "s", 1, "x"], [7, "the ing world and theing", "en", "s", 1, "y"], [7, "the ing world and theing", "en", "s", 1, "y"]]
    return docs, labels


def test_language_by_loops(spark):
    docs = [(k, t, lang) for k, t, lang, *_ in corpus()[0]] + [(950, "\U00031350\U00031351 𐐀", None), (951, "ΑΣ Σ", None)]
    for size in (400, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        profiles = langid.train(df.where(langid.fold("doc_id", 4) != 2), size=size)
        got = [(r["lang_pred"], r["score"]) for r in langid.predict(df, profiles, ["doc_id"], size=size).collect()]
        want = plain_language(docs, size)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, again = (text or "").split("\n"), [], 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.append(line)
    runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    cover = {j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text or ""), again, len(cover)


def test_quality_counts_by_loops(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", " \n\n ", "a\u00a0b c\x85d", "😀 <b> & |", "x\n\n x\nx\n x\r\nx\r"] + ["".join(rng.choice(["a ", "b ", "#", "c\n", "\n", "é\t", "a b c d e f g h "], rng.integers(1, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r[0]: tuple(r)[1:6] for r in quality.statistics(df, ["doc_id"]).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_pipeline(spark, tmp_path):
    docs, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    order = lambda rows: sorted(rows, key=str)
    want = [tuple(d) for d in docs]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        assert order(before) == order(want)
        if name == "toxicity":  # the scores themselves are tested on their own
            scores = toxicity.score(now, spark.read.parquet(f"{at}/labels.parquet"), ["doc_id", "text"], score_col="p").collect()
        now = stage(spark, now, at)
        now.write.parquet(f"{at}/{name}")
        now = spark.read.parquet(f"{at}/{name}")
        if name == "language":
            want = [d for d, (lang, close) in zip(before, plain_language([d[:3] for d in before]), strict=True) if lang != "und" and close >= corpus_pipeline.LEAST_SCORE]
            assert len(want) == len(docs) - 2
        elif name == "toxicity":
            marked = {(r["doc_id"], r["text"]) for r in scores if r["p"] >= 0.5}
            want = [d for d in before if d[:2] not in marked]
            toxic = {k for k, _, t in labels if t}
            assert {k for k, _ in marked} == toxic
        elif name == "lines":
            left = plain_lines([d[:2] for d in before if d[0] != 7])  # rows that share an id are one document
            left[7] = None
            want = [d if d[0] in (7, None) or left[d[0]] == d[1] else (d[0], left[d[0]], *d[2:4], len(left[d[0]]), *d[5:]) for d in before]
            want = [d for d in want if d[1].strip() or (d[0] in left and d in before)]
        elif name == "near_duplicates":
            group = {k: c for k, _, c in plain_components([d[:2] for d in before])}
            want, seven = [d for d in before if d[0] is None or (group[d[0]] == d[0] and d[0] != 7)], [d for d in before if d[0] == 7]
            want += [min(seven, key=lambda d: d[1])] if group[7] == 7 else []
            assert 21 not in {d[0] for d in want} and 45 not in {d[0] for d in want}
    theirs = tokenizers.Tokenizer.from_file(tokenizer())
    theirs.no_truncation()
    theirs.no_padding()
    check_packs(now.collect(), [d[:2] for d in want], theirs, 2)
    total = lambda rows: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert total(corpus_pipeline.run(spark, at).collect()) == total(now.collect())


def test_pipeline_empty(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
