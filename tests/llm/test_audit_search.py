"""Source divergence, the quality discriminant and signature search against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import discriminant, divergence, signatures, terms
from leadloom.llm.shared import stored, workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text, pattern=LETTERS):
    return pattern.findall((text or "").translate(LOWER))


def corpus(seed, n=150, langs=("en", "de", None), sources=("a", "b", "ß", None)):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"] + ["É", "é", "ÄB", "naïve", "日本", "x1y2", "don't"]
    chances = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for k in range(n):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=chances / chances.sum()))
        out.append((k, text, langs[rng.integers(len(langs))], sources[int(len(sources) * rng.random() ** 2)]))
    return out + [(500, None, "en", "a"), (501, "", "en", "empty"), (502, " \n.", "xx", "only"), (503, "solo", "xx", "other"), (504, "aI " * 3000, "en", "a"), (7, out[7][1], "en", "b"), (None, "AI aj, ak", "", "")]


def plain_audit(docs):
    groups = {(lang or "", source or "") for _, _, lang, source in docs}
    seen, all_n, n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        w = words(text)
        seen[lang or ""].update(set(w))
        all_n[lang or ""].update(w)
        n[lang or "", source or ""].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in seen[lang].items() if c >= 3]
        mine = sorted(s for g, s in groups if g == lang)

        def ps(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        q, p = ps(all_n[lang]), {s: ps(n[lang, s]) for s in mine}
        for s in mine:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in mine if o != s]
            near = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, 10**9), ("term", near, divergence.TOP)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_divergence(spark, seed, monkeypatch):
    docs = corpus(seed)
    if seed == 1:  # several blocks of sources, a short list, few terms held, look-ups by a shuffle
        monkeypatch.setattr(divergence, "BLOCK", 2)
        monkeypatch.setattr(divergence, "TOP", 7)
        monkeypatch.setattr(divergence, "_HELD", 5)
        monkeypatch.setattr(divergence, "_PAIRS", 3)
        monkeypatch.setattr(divergence, "_CODES", 0)
        monkeypatch.setattr(divergence, "BROADCAST_CELLS", 0)
        monkeypatch.setattr(terms, "PIECE", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("clash")}).repartition(5)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == plain_audit(docs)


def test_divergence_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_divergence_large_counts(spark):
    """Counts whose products leave 64 bits."""
    got = spark.range(1).select(divergence.probability(F.lit(7_000_000_000_000), F.lit(9_000_000_000_001)).alias("p"), divergence.probability(F.lit(1), F.lit(0)).alias("none")).first()
    assert tuple(got) == (1 + 10**9 * 7_000_000_000_001 // 9_000_000_000_001, None)


def plain_search(docs, items, top=10):
    found = [(d, Counter(words(t, ALNUM))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for k, (d, c) in enumerate(found):
            m = 100 - 90 + 90 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text, ALNUM)) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, k))
        out += [(item, rank, None if none else d, -score) for rank, (score, none, d, _) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed, monkeypatch):
    docs = [(d, t) for d, t, _, _ in corpus(seed)]
    rng = np.random.default_rng(seed + 50)
    items = [(k, " ".join(rng.choice((docs[rng.integers(150)][1] or "x").split() or ["x"], 12))) for k in range(25)] + [(90, None), (91, ""), (92, "nowhere x1y2"), (93, "EVERYWHERE"), (1, "ai É"), (94, "Solo"), (95, "x1Y2 x1y2"), (None, "ai")]
    if seed == 1:  # crowded signatures, small blocks of documents and questions, few seeds, look-ups by a shuffle
        monkeypatch.setattr(signatures, "BITS_A_KEY", 1)
        monkeypatch.setattr(signatures, "BLOCK_DOCS", 5)
        monkeypatch.setattr(signatures, "ITEMS", 9)
        monkeypatch.setattr(signatures, "BROADCAST_IDS", 0)
        monkeypatch.setattr(signatures, "_CELLS", 7)
        monkeypatch.setattr(signatures, "_HELD_TERMS", 20)
    if seed == 2:
        monkeypatch.setattr(signatures, "SEEDS", 11)
        monkeypatch.setattr(signatures, "_HELD_KEYS", 50)
        monkeypatch.setattr(signatures, "_KNOWN", 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"bits": F.lit("clash"), "item": F.lit(3)}).repartition(5)
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string")
    found = stored(signatures.index(df), f"{workspace(spark)}/index")
    got = sorted((tuple(r) for r in signatures.search(df, found, asked).collect()), key=str)
    assert got == plain_search(docs, items) and got


def test_search_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, asked in ((none, items), (some, items.limit(0)), (none, items.limit(0))):
        got = signatures.search(docs, stored(signatures.index(docs), f"{workspace(spark)}/index"), asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_bounds_hold():
    """No bound is below the exact score, however crowded a signature is."""
    rng = np.random.default_rng(4)
    vocabulary = [f"t{k}" for k in range(60)]
    docs = [Counter(rng.choice(vocabulary, rng.integers(1, 900))) | Counter({"t0": int(rng.integers(0, 700))}) for _ in range(40)]
    docs = [Counter({t.encode(): n for t, n in d.items() if n}) for d in docs]
    asked = signatures.Asked([" ".join(rng.choice(vocabulary, 8)) for _ in range(12)])
    asked.weigh(Counter(t for d in docs for t in d), len(docs), sum(d.total() for d in docs))
    for bits in (40, 400, 20_000):
        made = signatures.signed([(np.array([signatures._Hashes()[t] for t in d], np.uint64), np.array(list(d.values()))) for d in docs], bits)
        bound = signatures.bounds(asked, bits, np.array([d.total() for d in docs]), made)
        exact = np.array([[asked.score(d, k, asked.damping(d.total())) for d in docs] for k in range(12)])
        assert (bound >= exact).all()
    assert (bound < 1.5 * exact + 1).mean() > 0.95


def labelled(n=600):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(5, 80))]
        if not good:
            w = [x + "$$$" for x in w] if rng.random() < 0.5 else w[:4] * 15
        rows.append((k, " ".join(w), f"l{k % 3}"))
        labels.append((k, int(good)))
    return rows, labels


def test_discriminant(spark):
    rows, labels = labelled()
    extra = [(900, None, "x"), (901, "", None), (902, "y" * 100_000, "x"), (None, rows[0][1], "x"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, __size string").repartition(4)
    marks = spark.createDataFrame([*labels, (3, None), (7_000, 1), (None, 0), (4, 0)], "doc_id long, quality int")
    got = discriminant.score(df, marks, ["doc_id"]).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    right = [(by[k] >= discriminant.PREDICT_FROM) == bool(q) for k, q in labels]
    assert sum(right) / len(right) > 0.97
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_discriminant_equals_a_plain_one(spark):
    """The Spark expression, with factors, against densities written out."""
    rows, labels = labelled(200)
    x, y = np.array([discriminant.figures_of(t) for _, t, _ in rows]), np.array([q for _, q in labels])
    model = discriminant.Discriminant({k: (int((y == k).sum()), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)}, 0.3, 0.05)
    z = (x - x.mean(axis=0)) / np.where(x.var(axis=0) > 1e-9, x.std(axis=0), 1)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    both, logs = sum((y == k).mean() * own[k] for k in (0, 1)), []
    for k in (0, 1):
        c = 0.7 * own[k] + 0.3 * both
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))
        far = z - z[y == k].mean(axis=0)
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(c), far))
    want = logs[1] - logs[0]
    assert np.allclose(model.difference(x), want, rtol=1e-6, atol=1e-6)
    df = discriminant.figures(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), ["doc_id"])
    got = {r[0]: r[1] for r in df.select("doc_id", model.column()).collect()}
    assert np.allclose([got[k] for k, _, _ in rows], want, rtol=1e-6, atol=1e-5)


@pytest.mark.parametrize(("marks", "want"), [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 0), (2, 1), (3, 1), (6, 1)], None)])
def test_discriminant_few_labels(spark, marks, want):
    df = spark.createDataFrame([(k, f"some text {k}") for k in range(8)], "doc_id long, text string")
    found = {r["score"] for r in discriminant.score(df, spark.createDataFrame(marks, "doc_id long, quality int"), ["doc_id"], held=9).collect()}
    assert found == {want} if want is not None else len(found) == 1
    assert discriminant.score(df.limit(0), spark.createDataFrame(marks, "doc_id long, quality int"), ["doc_id"]).count() == 0
