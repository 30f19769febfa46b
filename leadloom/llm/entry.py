"""The queries of this subpackage: op<N>_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread


#: Bytes of words that a Python worker of operators 1 and 10 remembers; the pipeline's workers, which had other work before, keep less.
REMEMBER = 224 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    coded = encode(table(spark, sf_dir, "documents"), tokenizer(), keep=["doc_id"], remember=REMEMBER)
    return decode(coded, tokenizer(), remember=REMEMBER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vafile import scaled, top_k

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("vector"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linetemplates import dedup

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    marks = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id"))
    bad = F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0))
    verdicts = marks.agg(F.when(bad, "block").otherwise("allow").alias("verdict"))
    return judge(table(spark, sf_dir, "pages"), keep=["page_id"], labels=verdicts)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import workspace
    from .warc import capture_key, index, lookup, read, write

    pages, root = table(spark, sf_dir, "pages"), workspace(spark)
    directory = index(write(pages, root), root)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return read(lookup(keys, directory, root), root).drop("payload")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, identify

    found = identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold
    from .toxicity import score

    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer(), end_id=2, remember=REMEMBER)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .discriminant import PREDICT_FROM, score
    from .langid import fold

    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import forget, stored, workspace
    from .signatures import index, search

    docs, at = table(spark, sf_dir, "documents"), workspace(spark)
    found = search(docs, stored(index(docs), f"{at}/index"), table(spark, sf_dir, "benchmark"), at=at)
    forget(spark, f"{at}/index")
    return found


OPS = [op1_bpe, op2_topk, op3_lines, op4_quality, op5_url_rules, op6_warc, op7_language, op8_toxicity, op9_jaccard, op10_packing, op11_divergence, op12_classifier, op13_search]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in OPS}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOPK_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT DISTINCT id, e FROM v WHERE id % 50 = 0
), s AS (
  SELECT q.id AS query_id, q.e, v.id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q JOIN v ON q.id <> v.id AND len(q.e) = len(v.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p GROUP BY h
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + CAST(i // 8 AS INTEGER) * 10, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)
), reach AS (
  SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
), m AS (
  SELECT x, min(y) AS least FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id WHERE d.doc_id IS NOT NULL
UNION ALL SELECT NULL, CASE WHEN len(w) < 5 THEN least(len(w), 1) ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END, NULL
FROM (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NULL)
"""


def oracle_sql() -> dict[str, str]:
    from .divergence import ORACLE as DIVERGENCE_SQL
    from .linetemplates import ORACLE
    from .signatures import ORACLE as SEARCH_SQL

    return {"op13_search": SEARCH_SQL, "op11_divergence": DIVERGENCE_SQL, "op2_topk": TOPK_SQL, "op3_lines": ORACLE, "op6_warc": WARC_SQL, "op9_jaccard": JACCARD_SQL}
