"""Jaccard join, top-k search, URL rules, WARC and the pipeline against plain versions."""

import base64
import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import jaccard, shared, urlrules, vafile, warc
from leadloom.llm.components import components
from leadloom.llm.entry import op2_topk, op5_url_rules, op6_warc, op9_jaccard, queries
from leadloom.llm.shared import workspace

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def plain_components(docs):
    sets = [(k, shingles(t)) for k, t in docs if k is not None]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((k, len(s), find(k)) for k, s in sets)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "é"]
    base = [list(rng.choice(vocabulary, size)) for size in (12, 40, 41, 90, 200)]
    common = list(rng.choice(vocabulary, 60))
    docs = []
    for k in range(n):
        words = list(base[rng.integers(len(base))]) if rng.random() < 0.8 else list(rng.choice(vocabulary, rng.integers(1, 60)))
        for _ in range(rng.integers(0, 1 + len(words) // 15)):
            words[rng.integers(len(words))] = str(rng.choice(vocabulary))
        if rng.random() < 0.3:
            words += common
        docs.append((k, " ".join(words)))
    return docs + [(500, None), (501, ""), (502, " \n "), (503, "One two"), (504, "one\tTWO"), (505, "y " * 4000), (506, "y " * 3000), (None, "one two"), (7, docs[7][1]), (8, docs[100][1])]


def test_jaccard_without_ids(spark):
    """The size of a set is there without an id, too, in the SQL as well."""
    import duckdb
    import pandas as pd

    from leadloom.llm.entry import JACCARD_SQL

    rows = [(None, "a b c d e f g"), (None, None), (None, " "), (None, "a B"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x x x x x x x x")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string")})
    with duckdb.connect() as con:
        con.register("documents", documents)
        want = sorted(con.execute(JACCARD_SQL).fetchall(), key=str)
    assert got == want == sorted([(None, 3, None), (None, 0, None), (None, 0, None), (None, 1, None), (1, 3, 1), (2, 3, 1), (None, 1, None)], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard(spark, seed, monkeypatch):
    docs = corpus(seed)
    if seed == 1:
        monkeypatch.setattr(jaccard, "FREQUENT_FROM", 2)
    if seed == 2:
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
        monkeypatch.setattr(jaccard, "LIST_ROWS", 3)
        monkeypatch.setattr(shared, "_PIECE", 50)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(6)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect() if r["doc_id"] is not None)
    assert got == plain_components(docs)


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0


def test_prefix_filter_is_safe():
    """Similar sets share at least the lesser l of their prefixes, at places that the pair test lets through."""
    rng = np.random.default_rng(3)
    codes = np.sort(rng.choice(np.arange(1, 400, dtype=np.uint64), 60, replace=False))
    counts = rng.integers(2, 900, 60)
    cases = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = rng.choice(np.arange(1, 400, dtype=np.uint64), n, replace=False)
        y = np.concatenate([x[rng.integers(0, 1 + n // 6) :], rng.choice(np.arange(400, 800, dtype=np.uint64), rng.integers(0, 1 + n // 6), replace=False)])
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        if not len(y) or common * 4 < 3 * (len(x) + len(y) - common):
            continue
        cases += 1
        (lx, _, px), (ly, _, py) = jaccard.prefix(x, codes, counts), jaccard.prefix(y, codes, counts)
        need, at = min(lx, ly), {t: k for k, t in enumerate(py.tolist())}
        share = -(-3 * (len(x) + len(y)) // 7)
        met = sum(1 for k, t in enumerate(px.tolist()) if t in at and k < len(x) - share + need and at[t] < len(y) - share + need)
        assert met >= need
    assert cases > 500


@pytest.mark.parametrize("sides", [False, True])
def test_long_lists_match_short(sides):
    """The way for long posting lists finds the pairs that comparing all finds."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 300
    size, place, l, comp = rng.integers(20, 30, n), rng.integers(0, 9, n), rng.integers(1, 4, n), rng.choice([1, 1, 1, 2, 3], n)
    meta = (size << 32) | (place << 6) | l
    side = rng.integers(1, 3, n) if sides else np.zeros(n, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, 5), np.full(n, 2), side, comp, np.arange(n), meta)], names=["token", "cell", "side", "component", "class", "meta"])
    got = {(a, b) for out in jaccard._across(Fraction(3, 4), block=1000)(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)}
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            need = min(l[a], l[b])
            spare = need - -(-3 * (size[a] + size[b]) // 7)
            if comp[a] != comp[b] and (not sides or side[a] != side[b]) and place[a] < size[a] + spare and place[b] < size[b] + spare and 4 * min(size[a], size[b]) >= 3 * max(size[a], size[b]):
                want.add((a, b))
    assert got == want and want


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 100), (40, 39)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), workspace(spark)).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {150: 100, 200: 100, 300: 100} | {k: v for k, v in got.items() if k == v}
    assert components(spark.createDataFrame([], "u long, v long"), workspace(spark)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(vafile, "_ROWS", 64)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 6))
    rows = [(k, [float(x) for x in base[k % 20] + (k % 3) * 0.01]) for k in range(400)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1050, []), (None, [0.0] * 6), (1100, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame([(k, v, "c") for k, v in rows], "vec_id long, embedding array<double>, vector string").repartition(4)
    vectors = df.select("vec_id", vafile.scaled(F.col("embedding")).alias("vector")).where("vec_id is not null and vector is not null")
    queries = vectors.where("vec_id % 50 = 0").dropDuplicates(["vec_id"])
    exact = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in rows if k is not None and k not in (1000, 1001, 1002, 1003)]
    want = []
    for q, x in {k: v for k, v in exact if k % 50 == 0}.items():
        scored = sorted((-int(x @ y), k) for k, y in exact if k != q and len(y) == len(x))[:5]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scored)]
    for bits, block in ((8, 8192), (2, 3)):
        got = sorted(map(tuple, vafile.top_k(vectors, queries, 5, bits, block).collect()))
        assert got == sorted(want)
    assert vafile.top_k(vectors.limit(0), queries.limit(0)).count() == 0


def test_top_k_repeated_and_large(spark, tmp_path):
    """Own copies do not push true neighbours out, repeated queries are ranked once, and large components take part."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(1, 50)]
    rows += [(50, [9.0, 9.0, 9.0])] * 4 + [(100, [1.0, 2.0, 3.0]), (100, [-1.0, 2.0, 0.5])]
    rows += [(60, [300000.5, -2.0, 1.0]), (61, [1e18, -1e18, 3.0]), (61, [1e18, -1e18, 3.0]), (62, [-1e308, 5.0, 1e300]), (63, [1.7e308, 1.7e308, 1.0]), (150, [1e308, 1e308, -1e308]), (200, [1e9, -1e9, 1e-3])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    exact = [(k, [int(np.floor(x * 256)) if abs(x) < 1e15 else int(x) * 256 for x in v]) for k, v in rows]
    want = []
    for q, x in sorted({(k, tuple(v)) for k, v in exact if k % 50 == 0}):
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), k) for k, y in exact if k != q)[:5]
        want += [(q, r + 1, k, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, k) in enumerate(found)]
    order = lambda r: tuple(-1 << 70 if x is None else x for x in r)
    assert sorted(map(tuple, op2_topk(spark, str(tmp_path)).collect()), key=order) == sorted(want, key=order)
    # One file in which all rows of the query's id are better than the rest.
    ids, m = np.array([0] * 3 + list(range(1, 8))), np.array([[90], [90], [90], [7], [6], [5], [4], [3], [2], [1]])
    (got,) = vafile.search_file(np.array([0]), np.array([[1]]), ids, m, 5)
    assert got[0].tolist() == [1, 2, 3, 4, 5]


def test_top_k_query(spark, tmp_path):
    spark.createDataFrame([(k, [float(k % 7), float(k % 3)], 0) for k in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op2_topk(spark, str(tmp_path)).count() == 15


def test_url_rules(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://x.Example.com/en/7#t", "https://e.example.com/en/8?x", "http://example.net/de/81", "ftp://net/de/", "http://notnet/de/", "http://b.org/es/z", None, "", "no scheme/en/", "http://com", "http://x.com?/en/", "http://a.com/EN/1"]
    pages = [(k, u, "") for k, u in enumerate(urls)] + [(100 + k, f"http://h{k % 5}.example.com/{['en', 'de'][k % 2]}/{k}", "") for k in range(200)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(100, 300)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["page_id"]: r for r in op5_url_rules(spark, str(tmp_path)).collect()}
    assert len(rows) == len(pages)
    got = {k: (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) for k in range(len(urls))}
    assert got == {
        0: ("a.com", "/en/1", "com/en/"), 1: ("x.example.com", "/en/7", "example.com/en/7"), 2: ("e.example.com", "/en/8", "com/en/"), 3: ("example.net", "/de/81", "example.net/de/8"), 4: ("net", "/de/", "net/de/"),
        5: ("notnet", "/de/", None), 6: ("b.org", "/es/z", "org/es/"), 7: ("", "", None), 8: ("", "", None), 9: ("", "", None), 10: ("com", "", None), 11: ("x.com", "", None), 12: ("a.com", "/EN/1", None),
    }
    ruled = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert all(r["verdict"] == ruled[r["rule"]] for r in rows.values() if r["rule"]) and {r["verdict"] for r in rows.values()} == {"allow", "block"}
    assert [rows[k]["verdict"] for k in (7, 8, 9)] == ["allow"] * 3


def test_url_rules_from_all_rows(spark):
    """No token set is left out of the mining, however many rows there are."""
    host = (F.col("id") % 12).cast("string")
    rows = spark.range(120_000).select(F.array(F.concat(F.lit("h:"), host)).alias("tokens"), F.when(F.col("id") % 12 < 5, "block").otherwise("allow").alias("verdict"))
    assert {(r[0], r[1]) for r in urlrules.mine(rows)} == {((f"h:{k}",), "block" if k < 5 else "allow") for k in range(12)}


def plain_rules(rows, support, confidence):
    """All token sets of up to three by counting, then the ones that no more general one makes needless."""
    from collections import Counter
    from itertools import combinations

    have, said = Counter(), Counter()
    for tokens, verdict in rows:
        for size in (1, 2, 3):
            for items in combinations(sorted(tokens), size):
                have[items] += 1
                said[items, verdict] += 1
    least = support * len(rows)
    found = sorted(((items, v, n / have[items]) for (items, v), n in said.items() if v and n >= least and n / have[items] >= confidence), key=lambda r: (len(r[0]), -r[2], r))
    kept = []
    for items, v, sure in found:
        if not any(set(other) <= set(items) and known >= sure for other, _, known in kept):
            kept.append((items, v, sure))
    return sorted(kept, key=lambda r: (-r[2], len(r[0]), r))


@pytest.mark.parametrize("seed", range(2))
def test_url_rules_against_counting(spark, seed, monkeypatch):
    """The mined rules and their verdicts, held rows and unlabelled ones included."""
    monkeypatch.setattr(urlrules, "LEAST_ROWS", 1)
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(600):
        host, part, digit = rng.integers(4), rng.integers(3), rng.integers(3)
        verdict = None if rng.random() < 0.03 else "block" if (host == 1 and part == 2) or (digit == 0 and host == 3 and rng.random() < 0.95) else "allow" if host == 0 or rng.random() < 0.3 else None
        rows.append(([f"h:{host}", f"p1:{part}", f"d2:{digit}", "t:x"], verdict, bool(rng.integers(2))))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string, held boolean")
    got = [(i, v, round(c, 9)) for i, v, c in urlrules.mine(df.drop("held"), support=0.02)]
    assert got == [(i, v, round(c, 9)) for i, v, c in plain_rules([r[:2] for r in rows], 0.02, 0.9)] and len({v for _, v, _ in got}) == 2
    proved = urlrules.mine(df, support=0.02)
    there = [r for r in rows if r[2]]
    known = [r for r in there if r[1]]
    for items, verdict, _ in proved:
        met = [r for r in there if set(items) <= set(r[0])]
        assert urlrules._lower_bound(sum(r[1] == verdict for r in met), len(met)) > sum(r[1] == verdict for r in known) / len(known)
    urls = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "id int, tokens array<string>").withColumns({"host": F.lit("a"), "path": F.lit("/"), "fixed": F.lit(None).cast("struct<rule:string,verdict:string>")})
    for r in urlrules.judged(urls, proved, ["id"]).collect():
        fits = next(((i, v) for i, v, _ in proved if set(i) <= set(rows[r["id"]][0])), (None, "allow"))
        assert r["verdict"] == fits[1] and (r["mined"] == " ".join(fits[0]) if fits[0] else r["mined"] is None)


def test_long_paths(spark):
    """Many pages of one very long path: the combinations of their tokens stay few."""
    import time

    deep = "/".join(f"part{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.when(F.col("id") < 900, F.lit(f"http://a.com/en/{deep}")).otherwise(F.concat(F.lit("http://b.org/x/"), F.col("id").cast("string"))).alias("url"))
    began = time.time()
    got = urlrules.judge(df, ["page_id"]).groupBy("verdict").count().collect()
    assert {(r["verdict"], r["count"]) for r in got} == {("block", 900), ("allow", 1100)} and time.time() - began < 60


def test_url_rules_without_labels(spark):
    df = spark.createDataFrame([(1, "http://q.de/x")], "page_id long, url string")
    assert [tuple(r)[1:5] for r in urlrules.judge(df, ["page_id"]).collect()] == [("q.de", "/x", None, "allow")]
    assert urlrules.judge(df.limit(0), ["page_id"]).count() == 0
    assert urlrules.mine(spark.createDataFrame([], "tokens array<string>, verdict string")) == []


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    html = ["<p>a</p>", "<p>b</p>", "", None, "<p>a</p>", "x" * 300000, "é\r\n\r\nWARC/1.1", "<p>a</p>"]
    urls = ["http://B.example.com:80/x?q", "https://a.example.com/y\tz\n", None, "", "no scheme", "http://ü.de/", "http://b.example.com/x", "http://b.example.com/x"]
    rows = [(10 - k, u, h) for k, (u, h) in enumerate(zip(urls, html, strict=True))]
    pages = spark.createDataFrame(rows + [(-5, "http://neg.example/", "neg"), (None, "http://none.example/", "<p>b</p>"), (8, None, "")], "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(3)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    first = {}
    everything = sorted([(k, h or "") for k, _, h in rows] + [(-5, "neg")])
    for k, h in everything:
        first.setdefault(h, k)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = {k: (len(h.encode()), digest(h), *(("response", None) if first[h] == k else ("revisit", first[h]))) for k, h in everything}
    found = op6_warc(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + 3
    assert {r["page_id"]: tuple(r)[1:] for r in found if r["page_id"] is not None} == want
    root = workspace(spark)
    directory = warc.index(warc.write(pages, root), root)
    assert directory.count() > 2
    keys = pages.where("page_id = 5 or page_id = 6").select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    back = {r["page_id"]: r["payload"] for r in warc.read(warc.lookup(keys, directory, root), root).collect()}
    assert back == {5: html[5], 6: None}
    assert warc.lookup(spark.createDataFrame([("zzz",), ("",), (None,)], "key string"), directory, root).count() == 0
    empty = workspace(spark)
    assert warc.index(warc.write(pages.limit(0), empty), empty).count() == 0


def test_warc_equal_keys(spark, tmp_path, monkeypatch):
    """Captures with one key come back from all blocks that hold it, and keys with tabs, line ends and their escapes stay apart."""
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(None, "http://n.de/", f"n{k}") for k in range(25)] + [(7, "http://a.de/x", "same")] * 8
    rows += [(k, f"http://a.de/{'x' * (k % 5)}", f"p{k}") for k in range(10, 40)]
    rows += [(None, f"http://t.de/a{c}{d}", f"t{k}") for k, (c, d) in enumerate((c, d) for c in ("\t", "\n", "%09", "%0A", "%", " ", "$", "") for d in ("", "a", "z"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    got = sorted((r["page_id"] or 0, r["payload_digest"]) for r in op6_warc(spark, str(tmp_path)).collect())
    assert got == sorted((k or 0, digest(h)) for k, _, h in rows)


def test_warc_record():
    raw = warc.record(3, "http://x/ä b\r\n", b"pay\r\n\r\nload", "D", None)
    got = warc.parsed(raw)
    assert got["payload"] == b"pay\r\n\r\nload" and got["warc"]["WARC-Target-URI"] == "http://x/%C3%A4%20b%0D%0A" and raw.endswith(b"\r\n\r\n")


def test_jaccard_query(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f"), (2, "A B c d e f"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, op9_jaccard(spark, str(tmp_path)).collect())) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_names():
    assert sorted({int(k[2:].split("_")[0]) for k in queries()}) == list(range(1, 11))


