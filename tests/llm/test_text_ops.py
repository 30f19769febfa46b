"""BPE, line dedup, quality rules, language, toxicity and packing against plain versions."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import bpe, langid, linetemplates, packing, quality
from leadloom.llm.entry import tokenizer
from leadloom.llm.shared import shingle_hashes, word_hashes

tokenizers = pytest.importorskip("tokenizers")
ODD = [None, "", " ", "a", "Σας ΟΔΟΣ İx <|endoftext|>hi<|startoftext|> don't WE'LL it's 'S '' 12ab３", "\x1c a\x1db \x85 c\xa0d", "日本語テキスト 😀😀 !!??.. é", "x" * 3000, "ab, cd. " * 2000, "a\x00b\x7f\ttab\r\nline"]


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    with open(tokenizer(), encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def ids(ours, text):
    return np.frombuffer(ours.encode(text), "<u4").tolist()


def test_bpe_odd_texts(ours, theirs):
    for text in ODD:
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert ids(ours, text) == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeilnorstABT '.,!?0123\n\té"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60))
def test_bpe_any_text(ours, theirs, text):
    assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids


def test_bpe_code_points(ours, theirs):
    """Every seventh code point, assigned or not, between letters and after a full stop; and runs of combining marks in any order."""
    for c in range(3, 0x32000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}B.X{chr(c)}. {chr(c)}"
            assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids, hex(c)
    rng = np.random.default_rng(0)
    marks = [chr(c) for c in range(0x300, 0x1E95B) if unicodedata.category(chr(c))[0] == "M"]
    for _ in range(4000):
        text = "".join(rng.choice(["e", "Å", " ", "ا", *rng.choice(marks, 6)], rng.integers(2, 9)))
        assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids, ascii(text)


def test_bpe_cache_generations():
    words = bpe.Words(lambda w: w.encode(), 1000)
    assert [words[w] for w in "abcabcdeab"] == [w.encode() for w in "abcabcdeab"] and len(words) + len(words.old) <= 6


def test_bpe_columns(spark, theirs):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(3, "a", "x")], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, tokenizer(), keep=["doc_id"]), tokenizer()).collect()
    assert len(got) == len(docs.collect())
    for r in got:
        want = theirs.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == theirs.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), tokenizer()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_patterns_place_all(histogram):
    found = packing.patterns(dict(histogram), 64)
    placed = Counter()
    for packs, lengths in found:
        assert sum(lengths) <= 64 and packs > 0
        for n in lengths:
            placed[n] += packs
    assert placed == Counter(histogram)


def check_packs(rows, docs, theirs, end):
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for k, text in docs:
        want = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    return seqs


def test_packing(spark, theirs):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "the quick fox " * k) for k in range(0, 3000, 97)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = packing.pack(df.withColumn("length", F.lit("clash")), tokenizer(), 2).collect()
    seqs = check_packs(rows, docs, theirs, 2)
    assert sum(r["length"] for r in rows) > 0.9 * packing.CAPACITY * len(seqs)
    assert packing.pack(df.limit(0), tokenizer(), 2).count() == 0


def plain_lines(docs):
    """Line dedup with loops."""
    seen, keys = defaultdict(list), {}
    lt = linetemplates
    for k, text in docs:
        for line in (text or "").split("\n") if text is not None and k is not None else []:
            t = ["<*>" if re.search("[0-9]", x) else x for x in re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r"))]
            n = len(t)
            cuts = [lt.DEPTH + max(n - lt.DEPTH, 0) * s // lt.SEGMENTS for s in range(lt.SEGMENTS + 1)]
            kinds = list(combinations(range(4), 2)) if n >= lt.LONG else [(), (0,), (1,), (2,), (3,)] if n >= lt.MIDDLE else [()]
            found = [(n, kind, tuple(None if any(cuts[s] <= i < cuts[s + 1] for s in kind) else x for i, x in enumerate(t))) for kind in kinds] if line.strip(" \t\x0b\f\r") else []
            keys[line] = found
            for f in found:
                seen[f].append(k)
    least = lambda f: lt.SHORT_FROM if f[0] < lt.SHORT else lt.MIDDLE_FROM if f[0] < lt.LONG and f[1] else 2
    first = {f: min(ks) for f, ks in seen.items() if len(set(ks)) > 1 and len(ks) >= least(f)}
    out = {}
    for k, text in docs:
        if text is None or k is None:
            out[k] = text
            continue
        out[k] = "\n".join(x for x in text.split("\n") if not any(f in first and first[f] != k for f in keys[x]))
    return out


def test_lines(spark):
    long = "alpha beta gamma one two three four five six seven eight nine ten eleven twelve"
    swap = lambda w: long.replace("seven", w)
    docs = [
        (1, f"own line here\n{long}\nversion 3 of it\nhi"), (2, f"{swap('zzz')}\nversion 4  of\tit\nhi\nother text here"), (3, f"{swap('yyy')}\nhi"), (4, None), (5, ""), (6, "same same same\nsame same same"),
        (7, "\n\n"), (8, f"{long}\n{long}"), (9, "x " * 5000 + "\nhi"), (None, long), (10, long.replace("gamma", "G").replace("twelve", "T")),
        (11, "Posted by Alice in the News"), (12, "Posted by Bob in the News"), (13, "Posted by Cy in the News\nRead more"), (14, "Posted under Cy in the News"), (15, "Sent by Al at noon\nSent by Bo at noon"),
    ] + [(100 + k, f"Read more\n \t\nown{k} text{'abcdefghijklmnopqrstuvwxy'[k]} stays{k}x") for k in range(25)] + [(200, "hi\nown"), (201, "own")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n_lines", "__left", "drops", "id", "line", "a", "doc", "__n")}).repartition(3)
    found = linetemplates.dedup(df)
    assert sorted(found.columns) == sorted([*df.columns, "n_dropped"])
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    want = plain_lines(docs)
    assert got == want
    assert got[8] == "" and got[None] == long and got[6] == docs[5][1] and "version" not in got[2] and "zzz" not in got[2] and got[10] == ""
    assert got[11] == docs[11][1] and got[12] == "" and got[13] == "Read more" and got[14] == docs[14][1] and got[101].startswith(" \t\n")
    assert linetemplates.dedup(df.limit(0), lines_col="x", dropped_col="y").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_lines_of_few_words(spark, seed):
    """Random lines of few words, in which templates of all kinds recur."""
    rng = np.random.default_rng(seed)
    line = lambda: " ".join(rng.choice(list("ab1"), rng.choice([0, 1, 2, 4, 6, 7, 11, 12, 13])))
    docs = [(int(k), "\n".join(line() for _ in range(rng.integers(0, 5)))) for k in rng.integers(0, 60, 80)]
    docs = list(dict(docs).items())
    got = {r["doc_id"]: r["text"] for r in linetemplates.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_lines(docs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    want = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    assert quality.repeated_words(words) == len(want)


def test_quality(spark):
    good, bad = "plain words of a quiet text that goes on for a while without any odd signs in it at all, said once {k}.", "he%%% the&&& this*** that### odd$$$ sign%%% here&&& and%%% there*** so### on$$$ it%%% goes&&& for*** a### while$$$ still%%% more&&& of*** it{k}###"
    docs = [(k, (bad if k % 3 == 0 else good).format(k=k)) for k in range(150)] + [(200, None), (201, ""), (202, "few words"), (203, "a b c d e f g h " * 20), (204, "y" * 5000)]
    labels = [(k, int(k % 3 != 0), 0) for k in range(100)] + [(5, 1, 0), (None, 1, 0), (7, None, 0), (999, 0, 0)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(df, marks, ["doc_id"]).collect()}
    assert all(got[k]["kept"] == (k % 3 != 0) for k in range(150))
    assert [got[k]["base_failed"] for k in range(200, 205)] == [True] * 5 and got[203]["n_repeat_words"] == 160
    assert quality.train(df, marks.limit(0)) == [] and quality.judge(df.limit(0), marks, ["doc_id"]).count() == 0


def test_language(spark):
    words = {"en": "the and with this from have which their would there", "de": "der und nicht werden schon über zwischen durch gegen möchte", "fr": "les être avec pour dans leur été où aussi même"}
    rng = np.random.default_rng(0)
    docs = [(k, " ".join(rng.choice(w.split(), 30)), lang) for k, (lang, w) in enumerate(list(words.items()) * 40)]
    docs += [(900, None, "en"), (901, "123 !! 456", None), (902, "", "de"), (903, "über " * 3000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(df, ["doc_id"]).collect()}
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang in docs if k < 900 and zlib.crc32(str(k).encode()) % 4 == 2]) > 0.95
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).collect()} == {"und"}


def test_language_of_few_rows(spark, monkeypatch):
    """A language's profile is that of all its rows, however many rows others have."""
    monkeypatch.setattr(langid, "_HELD", 5_000)
    rare = spark.createDataFrame([(10**6 + k, f"kivi {chr(97 + k)}omena{chr(97 + k)} pöytä", "fi") for k in range(20)], "doc_id long, text string, lang string")
    common = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the and with").alias("text"), F.lit("en").alias("lang"))
    learned = langid.train(common.unionByName(rare))
    assert learned["fi"] == langid.train(rare)["fi"] and learned["en"] == langid.train(common.limit(10))["en"]


def test_word_hashes():
    texts = ["A b\tC", None, "", " \n ", "a  b c", "xab", "\x0bq", "a b c d e f"]
    words, at = word_hashes(pa.array(texts))
    mine = [words[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(m) for m in mine] == [3, 0, 0, 0, 3, 1, 1, 6] and mine[0] == mine[4] and len(set(words.tolist())) == 8
    assert word_hashes(pa.array(texts).slice(4))[0].tolist() == words[at[4] :].tolist()
    assert len(shingle_hashes(np.array(mine[7], np.uint64), 5)) == 2 and len(shingle_hashes(np.array(mine[0], np.uint64), 5)) == 1


def test_lines_of_a_very_long_text(spark):
    """Tens of thousands of recurring lines in one text are looked up, not compared one by one."""
    import time

    from leadloom.llm.linetemplates import dedup

    text = "\n".join(f"word{k} stays{k} the{k} same{k} all{k} through{k} here{k} and{k} there{k} it{k} recurs{k} always{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nand one more")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in dedup(df).collect()}
    assert got == {1: (40_000, 0, text), 2: (40_001, 40_000, "and one more")} and time.time() - began < 60


def test_decoding_lists(spark):
    """Null, empty and sliced lists of ids."""
    import pyarrow as pa

    from leadloom.llm.bpe import joined

    tokens = pa.array(["a", "b</w>", "", "d"])
    lists = pa.array([[9], [0, 1], None, [], [3, 3, 2], [1]], pa.list_(pa.int32()))
    assert joined(lists.slice(1), tokens).to_pylist() == ["a b</w>", None, "", "d d ", "b</w>"]
    assert joined(lists.slice(3, 1), tokens).to_pylist() == [""] and joined(lists.slice(0, 0), tokens).to_pylist() == []
