"""Line dedup with a fixed-depth template tree, in DataFrame operations only.

The tree parses a line by its number of tokens and then by its first ``DEPTH``
tokens; tokens with a digit are variable fields and count as ``<*>``.  In a leaf,
the tokens after the leading ones form ``SEGMENTS`` equal segments, and templates
are lines with variable segments:

* lines of ``LONG`` tokens or more have a template for each pair of segments, which
  are variable in it: fields in any two segments may differ, half of the tokens and
  the leading ones are the same;
* lines of ``MIDDLE`` tokens or more have their exact template and one for each
  segment;
* shorter lines have their exact template only.

A template recurs when two documents have it; one with a variable segment in a line
of middle length also needs ``MIDDLE_FROM`` lines, and a line of fewer than ``SHORT``
tokens ``SHORT_FROM`` lines.  A recurring template belongs to the document with the
smallest id; its lines in all later documents are dropped, so that what is said
somewhere is still said once.

Templates are told apart by 96 bits of hashes (64 and 32).

Edge cases: blank lines and repeats within a document stay; a null text stays null,
an empty one empty; rows without an id are neither counted nor changed; rows that
share an id are one document; empty tables give no rows; all other columns are
passed through, whatever their names, but for those that have the names of the two
new columns.  A document that loses all lines has an empty text.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored, workspace

DEPTH = 2
SEGMENTS = 4
SHORT, SHORT_FROM = 3, 20
MIDDLE, MIDDLE_FROM = 6, 3
LONG = 12
_BLANK = " \t\x0b\f\r"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the number of tokens ``n`` and hashes of the leading tokens and the segments: ``h0`` to ``h4``, and shorter ones ``g0`` to ``g4``.

    Tokens are never made into arrays: with one space between them, runs of tokens are cut out by counting spaces.
    Each step has its own ``select``, so that what many columns share is computed once.
    """
    trimmed = F.btrim(line, F.lit(_BLANK))
    spaced = F.when(trimmed.rlike(r"[\t\x0b\f\r]|  "), F.regexp_replace(trimmed, r"[ \t\x0b\f\r]+", " ")).otherwise(trimmed)
    rest = [F.col(c) for c in lines.columns if c != line]
    now = lines.select(*rest, F.xxhash64(line).alias(line), spaced.alias("__s"))
    masked = F.when(F.col("__s").rlike("[0-9]"), F.regexp_replace("__s", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(F.col("__s"))
    now = now.select(*rest, line, masked.alias("__s"))
    tokens = F.octet_length("__s") - F.octet_length(F.replace("__s", F.lit(" "), F.lit(""))) + 1
    now = now.select(*rest, line, "__s", F.when(F.col("__s") == "", 0).otherwise(tokens).alias("__n"))
    after = f"greatest(__n - {DEPTH}, 0)"
    ends = [f"least(__n, {DEPTH})", *(f"{DEPTH} + cast(floor({after} * {k} / {SEGMENTS}) as int)" for k in range(1, SEGMENTS + 1))]
    begins = ["0", *ends[:-1]]
    cut = [F.expr(f"substring_index(substring_index(__s, ' ', {e}), ' ', ({b}) - ({e}))").alias(f"__p{k}") for k, (b, e) in enumerate(zip(begins, ends, strict=True))]
    now = now.select(*rest, line, "__n", *cut)
    long = [F.xxhash64(F.lit(k), f"__p{k}").alias(f"h{k}") for k in range(SEGMENTS + 1)]
    short = [F.hash(F.lit(k), f"__p{k}").alias(f"g{k}") for k in range(SEGMENTS + 1)]
    return now.select(*rest, line, F.col("__n").alias("n"), *long, *short)


def templates(lines: DataFrame) -> DataFrame:
    """(id, line, a, b) of every template of every line that ``parsed`` made. The last two bits of ``a`` say how often it must occur: 0 in two documents, 1 on ``MIDDLE_FROM`` lines too, 2 on ``SHORT_FROM`` lines.

    Which segments a template holds goes into its key as a number; the hashes of those segments are joined by XOR.
    """
    both = [reduce(Column.bitwiseXOR, (F.col(f"{c}{k}") for k in range(SEGMENTS + 1))) for c in "hg"]
    rows = lines.where(F.col("n") > 0).select("*", both[0].alias("h"), both[1].alias("g"))

    def part(*variable: int) -> Column:
        held = [reduce(Column.bitwiseXOR, [F.col(c), *(F.col(f"{c}{k + 1}") for k in variable)]) for c in "hg"]
        return F.struct(F.lit(sum(1 << k for k in variable)).alias("variable"), held[0].alias("h"), held[1].alias("g"))

    n = F.col("n")
    pairs = F.array(*(part(*pair) for pair in combinations(range(SEGMENTS), 2)))
    single = F.array(part(), *(part(k) for k in range(SEGMENTS)))
    each = rows.select("id", "line", "n", F.explode(F.when(n >= LONG, pairs).when(n >= MIDDLE, single).otherwise(F.array(part()))).alias("x")).select("id", "line", "n", "x.*")
    kind = F.when(n < SHORT, F.lit(2)).when((n < LONG) & (F.col("variable") > 0), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return each.select("id", "line", F.xxhash64("n", "variable", "h").bitwiseAND(F.lit(-4)).bitwiseOR(kind).alias("a"), F.hash("n", "variable", "g").alias("b"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """``docs`` without the lines of recurring templates, with the numbers of lines that each text had and lost."""
    spark, at = docs.sparkSession, workspace(docs.sparkSession)
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = named.select("id", F.explode(F.split("text", "\n")).alias("line"))
    each = templates(stored(parsed(lines), f"{at}/parsed"))
    counted = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    kind = F.col("a").bitwiseAND(F.lit(3))
    often = F.col("n") >= F.when(kind == 1, MIDDLE_FROM).when(kind == 2, SHORT_FROM).otherwise(2)
    recurring = stored(counted.where((F.col("first") != F.col("last")) & often).select("a", "b", "first"), f"{at}/recurring")
    later = each.join(recurring, ["a", "b"]).where(F.col("id") != F.col("first")).select("id", "line").distinct()
    # A text's lines are looked up among its drops: as many lists of them as each list is long, by their remainder, so that a text
    # of very many recurring lines isn't compared line by drop. They are stored, so that the lists are made once.
    held, lists = F.col("held"), F.sqrt(F.size("held")).cast("int")
    sorted_out = F.transform(F.sequence(F.lit(0), lists - 1), lambda k: F.filter(held, lambda h: F.pmod(h, lists.cast("long")) == k))
    drops = stored(later.groupBy("id").agg(F.collect_set("line").alias("held")).select("id", sorted_out.alias("drops")), f"{at}/drops")
    forget(spark, f"{at}/parsed", f"{at}/recurring")

    whole = docs.select(F.struct("*").alias("doc"))  # one name only, so that none of its columns can clash
    joined = whole.join(drops, F.col(f"doc.{id_col}") == F.col("id"), "left")
    text = F.col(f"doc.{text_col}")
    joined = joined.select("doc", "drops", F.split(text, "\n").alias("lines"))
    joined = joined.select("doc", "lines", F.when(F.col("drops").isNotNull(), F.filter("lines", lambda x: ~F.array_contains(F.get("drops", F.pmod(F.xxhash64(x), F.size("drops").cast("long")).cast("int")), F.xxhash64(x)))).alias("left"))
    before = F.when(text.isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    lost = F.when(F.col("left").isNotNull(), before - F.size("left")).otherwise(F.lit(0)).cast("long")
    kept = [(F.coalesce(F.array_join("left", "\n"), text) if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns if c not in (lines_col, dropped_col)]
    return joined.select(*kept, before.alias(lines_col), lost.alias(dropped_col))


def _lists(kinds: list[tuple[int, ...]]) -> str:
    return ", ".join(f"[{', '.join(map(str, k))}]" if k else "[]::INTEGER[]" for k in kinds)


#: DuckDB SQL for (doc_id, n_lines, n_dropped, text_md5) over documents.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, line, list_transform(string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \\t\\x0b\\f\\r]+'),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM (SELECT doc_id, unnest(ls) AS line FROM d WHERE doc_id IS NOT NULL)
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), k AS (
  SELECT doc_id, line, len(t) AS n, t, unnest(CASE WHEN len(t) >= {LONG} THEN [{_lists(list(combinations(range(SEGMENTS), 2)))}]
    WHEN len(t) >= {MIDDLE} THEN [{_lists([(), *((k,) for k in range(SEGMENTS))])}] ELSE [{_lists([()])}] END) AS kind FROM l
), e AS (
  SELECT doc_id, line, n, kind, list_transform(t, lambda x, i: CASE WHEN i > {DEPTH} AND list_contains(kind,
    len(list_filter([{", ".join(map(str, range(1, SEGMENTS)))}], lambda s: i > {DEPTH} + (n - {DEPTH}) * s // {SEGMENTS}))) THEN NULL ELSE x END) AS key FROM k
), r AS (
  SELECT kind, n, key, min(doc_id) AS first FROM e GROUP BY kind, n, key
  HAVING min(doc_id) <> max(doc_id) AND count(*) >= CASE WHEN n < {SHORT} THEN {SHORT_FROM} WHEN n < {LONG} AND len(kind) > 0 THEN {MIDDLE_FROM} ELSE 2 END
), x AS (
  SELECT DISTINCT e.doc_id, e.line FROM e JOIN r ON e.kind = r.kind AND e.n = r.n AND e.key IS NOT DISTINCT FROM r.key WHERE e.doc_id <> r.first
), g AS (
  SELECT doc_id, list(line) AS gone FROM x GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(ls) - len(list_filter(ls, lambda x: NOT list_contains(gone, x))) END AS BIGINT) AS n_dropped,
  md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x: NOT list_contains(gone, x)), chr(10)) END) AS text_md5
FROM d LEFT JOIN g USING (doc_id)
"""
