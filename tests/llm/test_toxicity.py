"""The Kneser-Ney models and the scores against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import toxicity as tox


def plain_ratios(words):
    """words: (word, n, n0, n1). By recursion over strings: (gram or context) -> log ratio."""
    levels = [Counter()]
    own = [Counter(), Counter()]
    for word, n, *of in words:
        s = "^" * 7 + word + "$"
        for k in range(len(word) + 1):
            levels[0][s[k : k + 8]] += n
            for kind in (0, 1):
                own[kind][s[k : k + 8]] += of[kind]
    raw = levels[0]
    for size in (5, 3, 1):
        more, types = Counter(), Counter()
        for g, n in raw.items():
            more[g[-size:]] += n
            types[g[-size:]] += 1
        raw = more
        levels.append(Counter({g: more[g] if g[0] == "^" else types[g] for g in more}))

    def common(g, level):
        counts = levels[level]
        if level == 3:
            return (counts[g] + 1) / (sum(counts.values()) + len(counts) + 1)
        mine = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        lower = common(g[-(5, 3, 1)[level] :], level + 1)
        return (max(counts[g] - 0.75, 0) + 0.75 * len(mine) * lower) / sum(mine.values())

    out, by = {}, [defaultdict(dict), defaultdict(dict)]
    for kind in (0, 1):
        for g, n in own[kind].items():
            if n:
                by[kind][g[:-1]][g] = n
    seen = {}
    for h in set(by[0]) | set(by[1]):
        spare = [0.75 * len(by[k][h]) / sum(by[k][h].values()) if h in by[k] else 1.0 for k in (0, 1)]
        seen[h] = sum(sum(by[k].get(h, {}).values()) for k in (0, 1))
        out[h] = math.log(spare[1] / spare[0])
        for g in set(by[0].get(h, {})) | set(by[1].get(h, {})):
            p = [max(by[k].get(h, {}).get(g, 0) - 0.75, 0) / sum(by[k][h].values()) if h in by[k] else 0.0 for k in (0, 1)]
            out[g] = math.log((p[1] + spare[1] * common(g, 0)) / (p[0] + spare[0] * common(g, 0)))
    return out, seen


def some_words(seed=0, n=150):
    rng = np.random.default_rng(seed)
    made = {"".join(rng.choice(["ab", "c", "dé", "f", "gh"], rng.integers(1, 7))) for _ in range(n)}
    rows = []
    for w in sorted(made):
        n0, n1 = (int(x) for x in rng.integers(0, 6, 2))
        rows.append((w, n0 + n1 + int(rng.integers(0, 3)) or 1, n0, n1))
    return rows


def test_ratios_of_probabilities(spark):
    words = some_words()
    got = {r["gram"]: (r["value"], r["seen"]) for r in tox.ratios(tox.counted(spark.createDataFrame(words, "word string, n long, n0 long, n1 long"))).collect()}
    want, seen = plain_ratios(words)
    assert set(got) == set(want)
    for g, value in want.items():
        assert math.isclose(got[g][0], value, rel_tol=1e-9, abs_tol=1e-9) and got[g][1] == seen[g[:7]]


def test_shared_probabilities_sum_to_one(spark):
    words = some_words(1)
    rows = tox.shared(tox.counted(spark.createDataFrame(words, "word string, n long, n0 long, n1 long"))).collect()
    sums = defaultdict(float)
    for r in rows:
        sums[r["gram"][:-1]] += r["common"]
    assert all(0 < s <= 1 + 1e-9 for s in sums.values()) and max(sums.values()) > 0.9


def plain_figures(text, table):
    runs, now = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() and len(now) < tox.LONGEST:
            now += c
        else:
            runs += [now] if now else []
            now = c if c.isalpha() else ""
    if not runs:
        return [0.0] * len(tox.FIGURES)
    v = []
    for w in runs:
        s, total = "^" * 7 + w + "$", 0.0
        for k in range(len(w) + 1):
            total += table.get(s[k : k + 8], table.get(s[k : k + 7], 0.0))
        v.append(total)
    top = sorted(v, reverse=True)
    sizes = [len(w) + 1 for w in runs]
    best = [max(sum(v[k : k + j]) / sum(sizes[k : k + j]) for k in range(len(v) - j + 1)) for j in (min(j, len(v)) for j in (8, 32))]
    return [*(sum(top[:j]) / j for j in (1, 2, 4, 8)), *best, len(v)]


def test_figures():
    words = some_words(2)
    table, _ = plain_ratios(words)
    table = {g: float(np.float32(v)) for g, v in table.items()}
    rng = np.random.default_rng(3)
    texts = [None, "", " \n1 2", "ABC", "x" * 200, "ß" * 64 + " ab", "ab²c d_e", "İx ΑΣ 日本語\U00031350"]
    texts += [" ".join(str(w[0]) for w in rng.choice(np.array(words, object), rng.integers(1, 40))) + "!" for _ in range(40)]
    got = tox.figures_of(texts, tox.packed(*tox.keyed(list(table)), np.array(list(table.values()))))
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_figures(text, table), atol=1e-6), text


def corpus(n=400):
    rng = np.random.default_rng(1)
    syllables = ["ta", "re", "mi", "lo", "na", "se"]
    docs, labels = [], []
    for k in range(n):
        parts, toxic = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(rng.integers(3, 14))) for _ in range(4)], k % 4 == 0
        if toxic:
            parts.insert(2, f"you grub{rng.choice(syllables)} scoundrel")
        docs.append((k, " ".join(parts)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark, monkeypatch):
    docs, labels = corpus()
    docs += [(900, None), (901, ""), (902, " ".join(t for k, t in docs if k % 4) + "!" * 100_000), (None, "tare"), (4, docs[4][1])]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("curve", F.lit(1)), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    rows = tox.score(df, marks, ["doc_id"]).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(docs) and len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert got[900] == got[901] == 0.0 and got[902] < 0.5 and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in tox.score(df, marks.where("toxic = 0"), ["doc_id"]).collect()} == {0.0}
    assert tox.score(df.limit(0), marks, ["doc_id"]).count() == 0
    # The same scores by a shuffle join of the labels and with sums passed on early.
    monkeypatch.setattr(tox, "BROADCAST_IDS", 0)
    monkeypatch.setattr(tox, "_HELD", 10)
    again = {r["doc_id"]: r["score"] for r in tox.score(df, marks, ["doc_id"]).collect()}
    assert all(math.isclose(got[k], again[k], abs_tol=1e-6) for k in got)
    # A model that may have few entries has the contexts seen most.
    monkeypatch.setattr(tox, "MODEL_ROWS", 60)
    model, _ = tox.train(df, marks)
    assert 0 < len(model.value[0]) + len(model.value[2]) <= 60


def test_words_of_the_same_letters():
    from collections import Counter

    import numpy as np

    from leadloom.llm import toxicity as t

    words = ["errees", "reeres", "rether", "abba", "baab"]
    padded = [t.START * (t.ORDER - 1) + w + t.END for w in words]
    grams = sorted(Counter(p[i : i + t.ORDER] for p in padded for i in range(len(p) - t.ORDER + 1)))
    model = t.packed(*t.keyed(grams), np.arange(len(grams), dtype=float))
    want = [sum(grams.index(p[i : i + t.ORDER]) for i in range(len(p) - t.ORDER + 1)) for p in padded]
    for text in (" ".join(words), " ".join(words * 900)):  # few letters and many
        values, which = t.word_ratios(t.Texts([text]), model)
        assert values[which][: len(words)].tolist() == want


def test_long_texts_stay_toxic(spark):
    """Ordinary words around a toxic passage take nothing from it."""
    docs, labels = corpus()
    plain = "\n".join(t for k, t in docs if k % 4)[:20_000]
    held = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    more = [(1000 + k, f"{plain}\n{docs[k][1]}\n{plain}") for k in held]
    df, marks = spark.createDataFrame(docs + more, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in tox.score(df, marks, ["doc_id"]).collect()}
    bad = [k for k in held if k % 4 == 0]
    assert all(got[k] >= 0.5 and got[1000 + k] >= 0.5 for k in bad) and np.mean([got[1000 + k] < 0.5 for k in held if k % 4]) > 0.9


def test_a_small_model_scores_alike(spark, monkeypatch):
    """What a bounded model lacks is joined: the scores are those of the whole model, and rare contexts count, too."""
    docs, labels = corpus(200)
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, "x" * 60 + "²" + docs[0][1]), (None, docs[0][1])]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, (rest, _) = tox.train(df, marks)
    want = {r["doc_id"]: r["score"] for r in tox.score(df, marks, ["doc_id"]).collect()}
    assert rest is None
    rare = spark.createDataFrame([("grubta", 1, 0, 1)], "word string, n long, n0 long, n1 long")
    keys = tox.keyed([r["gram"] for r in tox.ratios(tox.counted(rare)).collect()])[0]
    assert np.isin(keys, np.concatenate([whole.value[0], whole.value[2]])).all()
    for most in (0, 400):
        monkeypatch.setattr(tox, "MODEL_ROWS", most)
        model, (rest, _) = tox.train(df, marks)
        assert len(model.value[0]) + len(model.value[2]) <= most and rest.count() > 0
        rows = tox.score(df, marks, ["doc_id"]).collect()
        assert len(rows) == len(docs) and all(math.isclose(r["score"], want[r["doc_id"]], abs_tol=1e-6) for r in rows)
