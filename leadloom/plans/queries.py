"""Named queries over the driver's tables, each with SQL that says the same.

Roles: ``customer`` are users, ``orders`` uploads and their cards, ``lineitem``
leads, ``nation`` cities, ``part`` and ``supplier`` companies, ``events`` an audit
log, ``documents`` card texts, ``conversations`` contacts, ``pages`` web sites.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, validate
from ..functions.text import first_filled
from ..functions.values import COMPANY_WORDS, DESIGNATIONS
from ..operators import analytics, audit, cards, companies, dedup, export, leads
from ..session import spread
from ..sources import files, responses, snapshots
from ..storage import stored, workspace
from ..streaming import keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = datetime(1998, 6, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def users(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"), "c_nationkey", "c_acctbal")


def uploads(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uploadedById"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("price"))


def upload_cards(spark: SparkSession, at: str) -> DataFrame:
    return uploads(spark, at).select("id", F.col("id").alias("uploadId"))


def lines(spark: SparkSession, at: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "F", "APPROVED").otherwise("PENDING_REVIEW")
    return table(spark, at, "lineitem").select(
        F.col("l_orderkey").alias("cardId"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("createdAt"), F.col("l_shipdate").alias("scannedAt"), status.alias("status"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deletedAt"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )


@query("""SELECT c_custkey AS "userId", c_name AS name, c_mktsegment AS email, strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag <> 'R' GROUP BY ALL""")
def employee_report(spark, at):
    return analytics.employee_report(lines(spark, at), upload_cards(spark, at), uploads(spark, at), users(spark, at))


@query("""SELECT (SELECT count(*) FROM orders) AS "totalFiles", (SELECT count(*) FROM lineitem) AS "cardsDetected",
  (SELECT count(*) FROM lineitem WHERE l_linenumber <= 3) AS "cardsProcessed",
  (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS "leadsCreated",
  (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS approved,
  (SELECT count(*) FROM events WHERE event_type = 'click') AS "duplicatesFound", (SELECT count(*) FROM part) AS "exportCount",
  round(100.0 * (SELECT count(*) FROM lineitem WHERE l_linenumber <= 3) / (SELECT count(*) FROM lineitem), 1)::DOUBLE AS "successRate" """)
def dashboard_kpis(spark, at):
    found = lines(spark, at)
    pairs = table(spark, at, "events").select(F.when(F.col("event_type") == "click", "OPEN").otherwise("DISMISSED").alias("status"))
    return analytics.dashboard_kpis(uploads(spark, at), found, found.where(F.col("line") <= 3), found, pairs, table(spark, at, "part"))


def _crm(spark, at):
    """Leads with city (a ship mode), state (an instruction's first word) and keys, companies, pairs and exports, for the dashboard and the reports."""
    found = lines(spark, at)
    raw = table(spark, at, "lineitem")
    leads_ = raw.select(
        F.when(F.col("l_linestatus") == "F", "APPROVED").otherwise("PENDING_REVIEW").alias("status"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deletedAt"), F.col("l_shipdate").alias("scannedAt"),
        (F.col("l_suppkey") % 40).cast("string").alias("city"), F.when(F.col("l_partkey") % 7 > 0, F.concat(F.lit("S"), (F.col("l_partkey") % 7).cast("string"))).when(F.col("l_partkey") % 2 == 0, "").alias("state"),
        F.when(F.col("l_linenumber") < 5, "e").alias("email"), F.when(F.col("l_linenumber") < 3, "p").alias("phonePrimary"), F.when(F.col("l_linenumber") == 1, "").alias("gstin"),
    )
    pairs = table(spark, at, "events").select(F.when(F.col("event_type") == "click", "OPEN").otherwise("DISMISSED").alias("status"))
    companies_ = table(spark, at, "part").select(F.col("p_type").alias("industry"))
    exports = table(spark, at, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "CSV").otherwise("XLSX").alias("format"))
    return uploads(spark, at), found, leads_, companies_, pairs, exports


_SQL_CRM_LEADS = """l AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status, l_returnflag <> 'R' AS live, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(l_suppkey % 40 AS VARCHAR) AS city,
  CASE WHEN l_partkey % 7 > 0 THEN 'S' || l_partkey % 7 WHEN l_partkey % 2 = 0 THEN '' END AS state, l_linenumber AS n FROM lineitem)"""


def _sql_top(part: str, key: str, source: str, n: int, nulls: bool = False) -> str:
    """The n largest groups; with ``nulls`` the null group takes a place at the end."""
    first = f"SELECT {key} AS label, count(*) AS count FROM {source} GROUP BY 1 " + (f"ORDER BY count({key}) DESC, 1 NULLS LAST LIMIT {n}" if nulls else f"HAVING coalesce({key}, '') <> '' ORDER BY 2 DESC, 1 LIMIT {n}")
    return f"SELECT '{part}' AS part, row_number() OVER (ORDER BY count DESC, label) AS place, label, count FROM ({first}) WHERE coalesce(label, '') <> ''"


@query(f"""WITH {_SQL_CRM_LEADS}, a AS (SELECT * FROM l WHERE live)
{_sql_top('topCities', 'city', 'a', 5)} UNION ALL {_sql_top('topStates', 'state', 'a', 5)} UNION ALL {_sql_top('topIndustries', 'p_type', 'part', 5)}
UNION ALL SELECT 'leadsCreated', 1, NULL, count(*) FROM a UNION ALL SELECT 'approved', 1, NULL, count(*) FILTER (status = 'APPROVED') FROM a UNION ALL SELECT 'totalFiles', 1, NULL, count(*) FROM orders
UNION ALL SELECT 'cardsDetected', 1, NULL, count(*) FROM lineitem UNION ALL SELECT 'cardsProcessed', 1, NULL, count(*) FILTER (l_linenumber <= 3) FROM lineitem UNION ALL SELECT 'exportCount', 1, NULL, count(*) FROM supplier
UNION ALL SELECT 'duplicatesFound', 1, NULL, count(*) FILTER (event_type = 'click') FROM events""")
def dashboard_parts(spark, at):
    """Figures and largest groups of the dashboard."""
    files_, found, leads_, companies_, pairs, exports = _crm(spark, at)
    return analytics.dashboard_parts(files_, found, found.where(F.col("line") <= 3), leads_, companies_, pairs, exports)


@query(f"""WITH {_SQL_CRM_LEADS}, e AS (SELECT CASE WHEN event_type = 'click' THEN 'OPEN' ELSE 'DISMISSED' END AS status FROM events), x AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'CSV' ELSE 'XLSX' END AS format FROM supplier)
SELECT 'leadAcquisition' AS part, row_number() OVER (ORDER BY day DESC) AS place, day AS label, count(*) AS count FROM l GROUP BY day QUALIFY place <= 30
UNION ALL {_sql_top('stateDistribution', 'state', 'l', 20, True)} UNION ALL {_sql_top('cityDistribution', 'city', 'l', 20, True)} UNION ALL {_sql_top('industryDistribution', 'p_type', 'part', 20, True)}
UNION ALL {_sql_top('duplicateAnalysis', 'status', 'e', 1000)} UNION ALL {_sql_top('exportStatistics', 'format', 'x', 1000)} UNION ALL {_sql_top('processingStatistics', 'o_orderstatus', 'orders', 1000)}
UNION ALL SELECT 'total', 1, NULL, count(*) FROM l UNION ALL SELECT 'approved', 1, NULL, count(*) FILTER (status = 'APPROVED') FROM l UNION ALL SELECT 'withEmail', 1, NULL, count(*) FILTER (n < 5) FROM l
UNION ALL SELECT 'withPhone', 1, NULL, count(*) FILTER (n < 3) FROM l UNION ALL SELECT 'withGstin', 1, NULL, count(*) FILTER (n = 1) FROM l""")
def report_parts(spark, at):
    """All reports, from one scan a table."""
    files_, _, leads_, companies_, pairs, exports = _crm(spark, at)
    return analytics.report_parts(files_, leads_, companies_, pairs, exports)


@query("""SELECT p_type AS label, count(*) AS count FROM part WHERE p_type <> '' GROUP BY p_type ORDER BY 2 DESC, 1 LIMIT 5""")
def top5_industries(spark, at):
    return analytics.top_n(analytics.group_counts(table(spark, at, "part"), "p_type"), "p_type")


@query("""SELECT n_name AS label, count(*) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE l_returnflag <> 'R' GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 5""")
def top5_cities(spark, at):
    live = analytics.active(lines(spark, at)).groupBy("supplier").agg(F.count("*").alias("n"))
    place = table(spark, at, "supplier").join(F.broadcast(table(spark, at, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("city"))
    return analytics.top_n(live.join(place, "supplier").groupBy("city").agg(F.sum("n").alias("count")), "city")


@query("""SELECT n_name AS label, count AS count FROM (SELECT n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 20)""")
def report_groups_top20(spark, at):
    named = users(spark, at).join(F.broadcast(table(spark, at, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return analytics.top_groups(named.select(F.col("n_name").alias("city")), "city")


@query("""SELECT r_name AS label, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY 2 DESC, 1 LIMIT 20""")
def state_distribution(spark, at):
    place = table(spark, at, "nation").join(table(spark, at, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return analytics.top_groups(users(spark, at).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("state")), "state")


@query("""SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def daily_acquisition(spark, at):
    return analytics.daily(lines(spark, at), "scannedAt").select(F.col("day").cast("timestamp_ntz").alias("day"), "count")


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS approved, round(100.0 * count(*) FILTER (quality = 1) / count(*), 1)::DOUBLE AS "approvedPct",
  round(100.0 * count(toxic) / count(*), 1)::DOUBLE AS "withEmailPct", round(100.0 * count(lang) / count(*), 1)::DOUBLE AS "withPhonePct",
  round(100.0 * count(nullif(source, 'src0')) / count(*), 1)::DOUBLE AS "withGstinPct" FROM documents LEFT JOIN labels USING (doc_id)""")
def data_quality_pct(spark, at):
    found = table(spark, at, "documents").select("doc_id", "lang", "source").join(table(spark, at, "labels"), "doc_id", "left")
    return analytics.data_quality(found.select(F.when(F.col("quality") == 1, "APPROVED").otherwise("PENDING_REVIEW").alias("status"), F.col("toxic").alias("email"), F.col("lang").alias("phonePrimary"), F.nullif("source", F.lit("src0")).alias("gstin")))


@query("""SELECT o_orderstatus AS status, count(*) AS count FROM orders GROUP BY 1""")
def status_breakdown(spark, at):
    return analytics.group_counts(uploads(spark, at), "status")


@query("""SELECT o_orderstatus AS status, count(*) AS count FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) GROUP BY 1""")
def latest200_status(spark, at):
    return analytics.latest_status(uploads(spark, at))


@query("""SELECT o_orderkey AS id, o_orderdate AS "createdAt", o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5""")
def recent_imports(spark, at):
    return uploads(spark, at).orderBy(F.desc("createdAt"), "id").limit(5).select("id", "createdAt", "status")


@query("""SELECT event_id AS id, ts AS "createdAt", event_type AS action FROM events ORDER BY ts DESC, event_id LIMIT 10""")
def recent_activity(spark, at):
    log = table(spark, at, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("createdAt"), F.col("event_type").alias("action"))
    return log.orderBy(F.desc("createdAt"), "id").limit(10)


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS email FROM customer
WHERE (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1')) AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey OFFSET 50 LIMIT 50""")
def lead_list_page(spark, at):
    found = users(spark, at).where(leads.contains_text(["name", "email"], "1") & (F.col("email") == "BUILDING"))
    return leads.page(found, [F.desc("c_acctbal"), F.col("id")], skip=50).select("id", "name", "email")


@query("""SELECT l_orderkey AS "cardId", l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 AND l_returnflag <> 'R'""")
def owner_scoped_leads(spark, at):
    mine = leads.visible(analytics.active(lines(spark, at)), upload_cards(spark, at), uploads(spark, at), 7, "EMPLOYEE")
    return mine.select("cardId", "line", "part", "supplier")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1996-01-01')""")
def uploads_without_leads(spark, at):
    late = lines(spark, at).where(F.col("createdAt") >= F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz"))
    return leads.uploads_without_leads(uploads(spark, at), upload_cards(spark, at), late).select("id", "status")


@query("""SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS uploads FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def user_upload_counts(spark, at):
    return analytics.with_child_counts(users(spark, at).select("id", "name"), uploads(spark, at), "uploadedById", name="uploads")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS "createdAt" FROM orders
WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30 23:59:59.999' ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey""")
def export_filter_sorted(spark, at):
    renamed = uploads(spark, at).withColumn("status", F.when(F.col("status") == "F", "REJECTED").otherwise(F.col("status")))
    found = renamed.where(leads.status_filter(None) & leads.between("createdAt", "1995-01-01", "1996-06-30"))
    return found.orderBy(F.desc_nulls_last("price"), F.desc("createdAt"), "id").select("id", "status", "createdAt")


def _card_leads(spark, at):
    """Conversations as leads with contacts: a turn is a contact, the first of every other conversation is primary."""
    turns = table(spark, at, "conversations")
    primary = (F.col("turn") == 0) & (F.col("conv_id") % 2 == 0)
    contact = F.struct("turn", F.col("role").alias("fullName"), F.lit(None).cast("string").alias("designation"), F.lit(None).cast("string").alias("department"), F.col("text").alias("email"), F.nullif("role", F.lit("user")).alias("mobile"), F.lit(None).cast("string").alias("phone"), primary.alias("isPrimary"))
    held = turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(contact)).alias("contacts"))
    docs = table(spark, at, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("city"), F.col("source").alias("companyName"), F.lit("").alias("website"))
    rest = ("email", "phonePrimary", "industry", "state", "gstin", "address", "country", "postalCode", "linkedin")
    blank = held.join(docs, "id").select("*", *(F.lit(None).cast("string").alias(c) for c in rest), F.lit("99").alias("phoneSecondary"), F.lit(datetime(2024, 1, 2, 3, 4, 5)).cast("timestamp_ntz").alias("createdAt"), F.lit(None).cast("timestamp_ntz").alias("updatedAt"))
    return blank.withColumn("company", F.struct(F.lit("Co").alias("name"), F.lit("co.example").alias("website"), F.lit("Tools").alias("industry"), F.lit("X").alias("city"), F.lit("Y").alias("state"), F.lit("").alias("gstin"), F.lit("India").alias("country"), F.lit("1").alias("postalCode")))


_CRM_SHOWN = {"Company Name": "company", "Website": "website", "Email": "email", "Contact Person": "person", "Mobile": "mobile", "City": "city", "Account Status": "status", "Created At": "created"}
_SQL_CRM = """WITH t AS (SELECT conv_id, turn, role, text AS email, nullif(role, 'user') AS mobile, turn = 0 AND conv_id % 2 = 0 AS prim FROM conversations),
p AS (SELECT conv_id, arg_min(struct_pack(role := role, email := email, mobile := mobile), (CASE WHEN prim THEN 0 ELSE 1 END, turn)) AS c FROM t GROUP BY 1),
l AS (SELECT conv_id, c, source, lang FROM p JOIN documents ON doc_id = conv_id),
x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, email) AS pos, role, email, mobile FROM t WHERE NOT prim)
SELECT conv_id AS "leadId", 0 AS pos, source AS company, 'co.example' AS website, coalesce(nullif(c.email, ''), '') AS email, coalesce(c.role, '') AS person,
  coalesce(c.mobile, '99') AS mobile, lang AS city, 'New Lead' AS status, '2024-01-02 03:04:05' AS created FROM l
UNION ALL SELECT l.conv_id, x.pos, source, 'co.example', coalesce(x.email, ''), coalesce(x.role, ''), coalesce(x.mobile, ''), lang, 'New Lead', '2024-01-02 03:04:05' FROM l JOIN x ON x.conv_id = l.conv_id"""


@query(_SQL_CRM)
def crm_rows(spark, at):
    rows = export.crm_rows(_card_leads(spark, at))
    return rows.select("leadId", "pos", *(F.col(c).alias(n) for c, n in _CRM_SHOWN.items()))


def _first_lines(done: dict) -> list[tuple[str, int]]:
    """(file, rows before it) of the files of an export, by its manifest."""
    rows = [f["rows"] for f in done["files"]]
    return [(f["name"].rsplit("/", 1)[-1], sum(rows[:k])) for k, f in enumerate(done["files"])]


@query(f"""WITH r AS ({_SQL_CRM}) SELECT format, company, website, email, person, mobile, city, status, created, row_number() OVER (PARTITION BY format ORDER BY "leadId", pos) AS line FROM r, (VALUES ('CSV'), ('JSON')) f(format)""")
def export_files(spark, at):
    """The rows as written to CSV and JSON files by tasks, read back, with their lines in the file."""
    rows, folder = export.crm_rows(_card_leads(spark, at)), workspace(spark)
    out = None
    for fmt in ("CSV", "JSON"):
        done = export.write_counted(rows, fmt, folder, AS_OF)
        path = f"{folder}/{done['path']}"
        back = spark.read.csv(path, header=True, multiLine=True, escape='"') if fmt == "CSV" else spark.read.json(path, multiLine=True)
        # Files are numbered in the order of their rows, hold a bounded number of them, and each is read from its begin to its end.
        numbered = back.select(F.lit(fmt).alias("format"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in _CRM_SHOWN.items()), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("at"))
        files, before = spark.createDataFrame(_first_lines(done), "file string, before long"), Window.partitionBy("file").orderBy("at")
        one = numbered.join(F.broadcast(files), "file").withColumn("line", (F.row_number().over(before) + F.col("before")).cast("int")).drop("at", "file", "before")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT page_id, split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1) AS domain FROM pages""")
def domain_normalise(spark, at):
    return table(spark, at, "pages").select("page_id", companies.domain(F.col("url")).alias("domain"))


@query("""SELECT page_id, substring(regexp_replace(lower(split_part(url, '.', 2)), '[^a-z0-9]', '', 'g') || '::' ||
  split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1), 1, 250) AS key FROM pages""")
def company_key(spark, at):
    return table(spark, at, "pages").select("page_id", companies.company_key(F.split_part("url", F.lit("."), F.lit(2)), F.col("url"), F.col("page_id")).alias("key"))


@query("""WITH l AS (SELECT page_id AS id, split_part(url, '.', 2) AS "companyName", split_part(url, '?', 1) AS website, nullif(substring(url, 5, 1), 's') AS state,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE 'c' || (page_id % 7) END AS city FROM pages),
k AS (SELECT *, substring(regexp_replace(lower("companyName"), '[^a-z0-9]', '', 'g') || '::' || split_part(regexp_replace(regexp_replace(website, '^https?://', ''), '^www\\.', ''), '/', 1), 1, 250) AS key FROM l WHERE "companyName" <> '')
SELECT key AS "normalizedKey", arg_min("companyName", id) AS name, arg_max(website, id) AS website, arg_max(city, id) FILTER (city <> '') AS city, arg_max(state, id) FILTER (state <> '') AS state FROM k GROUP BY key""")
def company_upsert(spark, at):
    url, none = F.col("url"), F.lit(None).cast("string")
    made = table(spark, at, "pages").select(F.col("page_id").alias("id"), F.split_part(url, F.lit("."), F.lit(2)).alias("companyName"), F.split_part(url, F.lit("?"), F.lit(1)).alias("website"), F.nullif(F.substring(url, 5, 1), F.lit("s")).alias("state"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.col("page_id") % 7)).alias("city"), *(none.alias(c) for c in ("gstin", "industry", "country", "postalCode")))
    return companies.companies_of(made).select("normalizedKey", "name", "website", "city", "state")


def _texts(spark, at):
    return spread(table(spark, at, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


_SQL_EMAILS = """SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b'), lambda x: lower(x)) AS m FROM documents"""


@query(f"""SELECT DISTINCT doc_id, unnest(m) AS email FROM ({_SQL_EMAILS})""")
def extract_emails(spark, at):
    return _texts(spark, at).select("doc_id", F.explode(extract.emails(F.col("text"))).alias("email"))


_SQL_PHONE = r"(?:(?:\+|00)[0-9]{1,3}[\s-]?)?(?:\([0-9]{1,4}\)[\s-]?)?[0-9](?:[0-9\s-]{6,14}[0-9])"


@query(f"""WITH p AS (SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(coalesce(text, ''), '{_SQL_PHONE}')), ' ' || chr(9) || chr(10) || chr(13)) AS phone FROM documents),
d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM p WHERE length(regexp_replace(phone, '[^0-9+]', '', 'g')) >= 8)
SELECT doc_id, phone FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.doc_id = a.doc_id AND b.phone <> a.phone AND contains(b.digits, a.digits))""")
def extract_phones(spark, at):
    return _texts(spark, at).select("doc_id", F.explode(extract.phones(F.col("text"))).alias("phone"))


_SQL_URL = r"(?i)\b(?:https?://)?(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/\S*)?\b"


@query(f"""WITH e AS ({_SQL_EMAILS}), u AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_SQL_URL}')) AS url FROM documents)
SELECT u.doc_id, url, count(*) AS n FROM u JOIN e USING (doc_id) WHERE NOT contains(url, '@') AND NOT list_bool_or(list_concat([false], list_transform(m, lambda x: contains(split_part(x, '@', 1), regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''))))) GROUP BY ALL""")
def extract_urls(spark, at):
    found = _texts(spark, at).select("doc_id", "text", extract.emails(F.col("text")).alias("emails"))
    return found.select("doc_id", F.explode(extract.urls(F.col("text"), F.col("emails"))).alias("url")).groupBy("doc_id", "url").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '(?i)((?:https?://)?(?:www\.)?linkedin\.com/\S+|in/[A-Za-z0-9-]+)', 1), '') AS linkedin,
  nullif(regexp_extract(coalesce(text, ''), '(?i)((?:https?://)?(?:www\.)?(?:twitter|x)\.com/\S+|@[A-Za-z0-9_]{2,})', 1), '') AS twitter FROM documents""")
def extract_social(spark, at):
    return _texts(spark, at).select("doc_id", extract.social(F.col("text"), "linkedin").alias("linkedin"), extract.social(F.col("text"), "twitter").alias("twitter"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS n FROM documents""")
def extract_lines(spark, at):
    return _texts(spark, at).select("doc_id", F.size(extract.lines(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in extract.INDUSTRIES.items()) + " END AS industry FROM documents")
def infer_industry(spark, at):
    return spread(table(spark, at, "documents").select("doc_id", "text")).select("doc_id", extract.industry(F.col("text")).alias("industry"))


@query()
def card_leads(spark, at):
    """The whole path from text to validated lead, over all texts."""
    done = validate.final_leads(validate.validate_leads(extract.extract_entities(_texts(spark, at).withColumnRenamed("text", "rawText"))))
    first = extract.primary(F.col("contacts"))
    return done.select("doc_id", "companyName", "website", "email", "phonePrimary", "phoneSecondary", "address", "postalCode", "gstin", "industry", "linkedin", "twitter", "city", "state", "country", first["fullName"].alias("person"), F.size("contacts").alias("people"), "aiConfidence")


_SQL_FIELDS = r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'info@' || host WHEN page_id % 4 = 1 THEN 'x' || page_id || '@' || host WHEN page_id % 4 = 2 THEN host ELSE '' END AS email,
  CASE WHEN page_id % 3 = 0 THEN '+91 98765 4' || page_id ELSE cast(page_id AS VARCHAR) END AS phone, url FROM (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)"""


@query(rf"""WITH f AS ({_SQL_FIELDS})
SELECT page_id, CASE WHEN email = '' THEN 0.0 WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]{{2,}}$') THEN 0.2 WHEN regexp_matches(email, '(?i)^(info|sales|contact|admin|office|support|hello|enquiry|inquiry)@') THEN 0.7 ELSE 0.99 END::DOUBLE AS email_confidence,
  CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 THEN 0.95 ELSE 0.3 END::DOUBLE AS phone_confidence,
  CASE WHEN regexp_matches(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+') THEN 0.9 ELSE 0.3 END::DOUBLE AS website_confidence FROM f""")
def validate_fields(spark, at):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    k = F.col("page_id") % 4
    email = F.when(k == 0, F.concat(F.lit("info@"), host)).when(k == 1, F.concat(F.lit("x"), F.col("page_id"), F.lit("@"), host)).when(k == 2, host).otherwise("")
    phone = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("+91 98765 4"), F.col("page_id"))).otherwise(F.col("page_id").cast("string"))
    return table(spark, at, "pages").select("page_id", *(f(c)["confidence"].alias(n) for f, c, n in ((validate.score_email, email, "email_confidence"), (validate.score_phone, phone, "phone_confidence"), (validate.score_website, F.col("url"), "website_confidence"))))


#: (address, city, gstin, phone) and the (city, state, country) that they give; # stands for the row's id.
_GEO = [
    ("MIDC Bhosari Plot # Pune 411026", None, None, "+91 9876543210", "Pune", "Maharashtra", "India"), (None, None, "27ABCDE1234F1Z5", None, None, "Maharashtra", "India"),
    ("#, Vashi, Navi Mumbai", None, None, None, "Mumbai", "Maharashtra", "India"), ("Connaught Place #, New Delhi", None, None, None, "Delhi", "Delhi", "India"),
    ("Sheikh Zayed Rd #, Dubai", None, None, None, "Dubai", None, "UAE"), ("# Kerala", None, None, None, None, "Kerala", "India"), ("Pune", None, "29ABCDE1234F1Z5", None, "Pune", "Karnataka", "India"),
    (None, None, None, "+91 #", None, None, "India"), ("nowhere #", "Oslo", None, None, "Oslo", None, None), (None, None, None, None, None, None, None),
]


def _case(values: list, other: str = "NULL") -> str:
    return "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + f" ELSE {other} END"


@query(f"""SELECT page_id AS id, {_case([g[4] for g in _GEO])} AS city, {_case([g[5] for g in _GEO])} AS state, {_case([g[6] for g in _GEO])} AS country FROM pages""")
def resolve_geo(spark, at):
    """City, state and country of a lead a page, from address, city, tax number and phone."""
    k = F.col("page_id") % 10
    given = lambda n: F.coalesce(*(F.when(k == i, F.replace(F.lit(g[n]), F.lit("#"), F.col("page_id").cast("string"))) for i, g in enumerate(_GEO) if g[n] is not None))
    none = F.lit(None).cast("string")
    rows = table(spark, at, "pages").select(F.col("page_id").alias("id"), *(given(n).alias(c) for n, c in enumerate(("address", "city", "gstin", "phone"))))
    return rows.select("id", validate.resolve_geo(F.col("address"), F.col("city"), none, none, F.col("gstin"), F.col("phone")).alias("g")).select("id", "g.city", "g.state", "g.country")


def _suppliers(spark, at):
    return table(spark, at, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("string").alias("email"), F.concat(F.lit("+1 555 "), (F.col("s_suppkey") % 37).cast("string"), F.lit("0000000")).alias("phonePrimary"), F.col("s_name").alias("companyName"), F.col("s_nationkey").cast("string").alias("city"))


_SQL_SUPPLIERS = """SELECT s_suppkey AS id, '' AS ne, right('1555' || (s_suppkey % 37) || '0000000', 10) AS np,
  regexp_replace(regexp_replace(lower(s_name), '\\b(pvt|private|ltd|limited|llp|llc|inc|corp|co|company)\\b\\.?', '', 'g'), '[^a-z0-9]', '', 'g') AS nc, cast(s_nationkey AS VARCHAR) AS city FROM supplier"""


@query(f"""WITH k AS ({_SQL_SUPPLIERS}) SELECT a.id AS "leadAId", b.id AS "leadBId" FROM k a JOIN k b ON a.id < b.id AND (a.ne = b.ne OR a.np = b.np OR substring(a.nc, 1, 6) = substring(b.nc, 1, 6))""")
def dup_pairs(spark, at):
    return dedup.candidate_pairs(_suppliers(spark, at))


def _parts(spark, at):
    return table(spark, at, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phonePrimary"), F.col("p_name").alias("companyName"), F.col("p_type").alias("city"))


@query(r"""WITH k AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '\b(pvt|private|ltd|limited|llp|llc|inc|corp|co|company)\b\.?', '', 'g'), '[^a-z0-9]', '', 'g') AS nc, lower(p_type) AS c FROM part),
n AS (SELECT DISTINCT nc, c FROM k),
s AS (SELECT x.nc AS xn, x.c AS xc, y.nc AS yn, y.c AS yc, 1 - levenshtein(x.nc, y.nc)::DOUBLE / greatest(length(x.nc), length(y.nc)) AS cs, 1 - levenshtein(x.c, y.c)::DOUBLE / greatest(length(x.c), length(y.c)) AS ci FROM n x, n y)
SELECT a.id AS "leadAId", b.id AS "leadBId", round(0.6 * cs + 0.4 * ci, 3) AS score FROM s JOIN k a ON a.nc = xn AND a.c = xc JOIN k b ON b.nc = yn AND b.c = yc AND a.id < b.id
WHERE cs > 0.85 AND 0.6 * cs + 0.4 * ci > 0.7""")
def dup_scores(spark, at):
    return dedup.find_duplicates(_parts(spark, at)).select("leadAId", "leadBId", "score")


@query(f"""WITH k AS ({_SQL_SUPPLIERS}), m AS (SELECT 'phone' AS kind, np AS class, id FROM k UNION ALL SELECT 'profile', nc || '|' || lower(city), id FROM k)
SELECT kind, id AS "leadId", min(id) OVER w AS representative, count(*) OVER w AS size FROM m WINDOW w AS (PARTITION BY kind, class) QUALIFY size > 1 OR kind = 'profile' AND EXISTS (SELECT 1 FROM k a JOIN k b ON a.id <> b.id AND a.nc || lower(a.city) <> b.nc || lower(b.city)
  WHERE a.id = m.id AND 1 - levenshtein(a.nc, b.nc)::DOUBLE / greatest(length(a.nc), length(b.nc)) > 0.85 AND 0.6 * (1 - levenshtein(a.nc, b.nc)::DOUBLE / greatest(length(a.nc), length(b.nc))) + 0.4 * (1 - levenshtein(a.city, b.city)::DOUBLE / greatest(length(a.city), length(b.city))) > 0.7)""")
def dup_classes(spark, at):
    """Leads by shared phone or profile, a row a lead and class."""
    return dedup.duplicate_classes(_suppliers(spark, at))[0].select("kind", "leadId", "representative", "size")


@query(r"""WITH k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(p_name), '\b(pvt|private|ltd|limited|llp|llc|inc|corp|co|company)\b\.?', '', 'g'), '[^a-z0-9]', '', 'g') AS nc, lower(p_type) AS c FROM part),
s AS (SELECT x.nc AS xn, x.c AS xc, y.nc AS yn, y.c AS yc, 1 - levenshtein(x.nc, y.nc)::DOUBLE / greatest(length(x.nc), length(y.nc)) AS cs, 1 - levenshtein(x.c, y.c)::DOUBLE / greatest(length(x.c), length(y.c)) AS ci FROM k x JOIN k y ON (x.nc, x.c) < (y.nc, y.c))
SELECT round(0.6 * cs + 0.4 * ci, 3) AS score, count(*) AS links FROM s WHERE cs > 0.85 AND 0.6 * cs + 0.4 * ci > 0.7 GROUP BY 1""")
def dup_links(spark, at):
    """How many pairs of profiles are similar, by score."""
    return dedup.duplicate_classes(_parts(spark, at))[1].groupBy("score").agg(F.count("*").alias("links"))


@query(f"""WITH k AS ({_SQL_SUPPLIERS}), p AS (SELECT a.id AS "leadAId", b.id AS "leadBId", a.np = b.np AS phone, 1 - levenshtein(a.nc, b.nc)::DOUBLE / greatest(length(a.nc), length(b.nc)) AS cs, 1 - levenshtein(a.city, b.city)::DOUBLE / greatest(length(a.city), length(b.city)) AS ci FROM k a JOIN k b ON a.id < b.id),
s AS (SELECT *, CASE WHEN cs > 0.85 AND 0.6 * cs + 0.4 * ci > 0.7 THEN round(0.6 * cs + 0.4 * ci, 3) ELSE 0 END AS alike FROM p)
SELECT "leadAId", "leadBId", greatest(alike, CASE WHEN phone THEN 0.9 ELSE 0 END)::DOUBLE AS score FROM s WHERE phone OR alike >= 0.7""")
def dup_batches(spark, at):
    """Duplicates found batch by batch against stored keys: the pairs of all leads, each in the batch of the later one."""
    rows, folder, out = _suppliers(spark, at), workspace(spark), None
    for part in range(3):
        new = rows.where(F.col("id") % 3 == part)
        keys.forward(spark, folder, new, 16)
        found = stored(keys.duplicates(spark, folder, new).select("leadAId", "leadBId", "score"))
        out = found if out is None else out.unionByName(found)
    return out


_SQL_KNOWN = """SELECT a.s_suppkey AS "leadAId", b.s_suppkey AS "leadBId", CASE WHEN a.s_suppkey % 3 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 37"""


def _known(spark, at):
    s = table(spark, at, "supplier").select(F.col("s_suppkey").alias("leadAId"))
    pairs = s.join(s.select((F.col("leadAId") - 37).alias("leadAId"), F.col("leadAId").alias("leadBId")), "leadAId")
    return pairs.select("leadAId", "leadBId", F.lit(0.1).alias("score"), F.array(F.lit("old")).alias("reasons"), F.when(F.col("leadAId") % 3 == 0, "DISMISSED").otherwise("OPEN").alias("status"))


@query(f"""WITH k AS ({_SQL_SUPPLIERS}), f AS (SELECT a.id AS "leadAId", b.id AS "leadBId" FROM k a JOIN k b ON a.id < b.id AND a.np = b.np), o AS ({_SQL_KNOWN})
SELECT "leadAId", "leadBId", CASE WHEN f."leadAId" IS NULL THEN 0.1 ELSE 0.9 END::DOUBLE AS score, coalesce(status, 'OPEN') AS status FROM f FULL JOIN o USING ("leadAId", "leadBId")""")
def dup_scan_keeps_status(spark, at):
    found = _suppliers(spark, at).withColumns({"companyName": F.concat(F.lit("S"), F.sha2(F.col("id").cast("string"), 256)), "deletedAt": F.lit(None).cast("timestamp_ntz"), "status": F.lit("APPROVED")})
    return dedup.scan(found, _known(spark, at)).select("leadAId", "leadBId", "score", "status")


@query(f"""WITH o AS ({_SQL_KNOWN}) SELECT o."leadAId", o."leadBId", a.s_name AS a_name, b.s_name AS b_name FROM o JOIN supplier a ON a.s_suppkey = o."leadAId" JOIN supplier b ON b.s_suppkey = o."leadBId" WHERE status = 'OPEN'""")
def dup_open_list(spark, at):
    found = dedup.open_list(_known(spark, at), _suppliers(spark, at).select("id", F.col("companyName").alias("name")))
    return found.select("leadAId", "leadBId", "a_name", "b_name")


def _merges(spark, at):
    return table(spark, at, "customer").where((F.col("c_custkey") % 10 == 3)).select(F.col("c_custkey").alias("goneId"), (F.col("c_custkey") - 2).alias("keepId"))


_SQL_LEAD_FIELDS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN '' ELSE c_name END AS "companyName", CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE c_mktsegment END AS city FROM customer"""


@query(f"""WITH l AS ({_SQL_LEAD_FIELDS}), m AS (SELECT c_custkey AS gone, c_custkey - 2 AS keep FROM customer WHERE c_custkey % 10 = 3)
SELECT l.id, coalesce(nullif(l."companyName", ''), nullif(g."companyName", ''), l."companyName") AS "companyName", coalesce(nullif(l.city, ''), nullif(g.city, ''), l.city) AS city,
  CASE WHEN w.gone IS NULL THEN 'APPROVED' ELSE 'MERGED' END AS status, w.keep AS "mergedIntoId" FROM l LEFT JOIN m ON m.keep = l.id LEFT JOIN l g ON g.id = m.gone LEFT JOIN m w ON w.gone = l.id""")
def merge_fill(spark, at):
    c = table(spark, at, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 1, "").otherwise(F.col("c_name")).alias("companyName"), F.when(F.col("c_custkey") % 6 != 1, F.col("c_mktsegment")).alias("city"), F.lit("APPROVED").alias("status"), F.lit(None).cast("long").alias("mergedIntoId"), F.lit(None).cast("timestamp_ntz").alias("deletedAt"))
    return dedup.merge_leads(rows, _merges(spark, at), AS_OF).drop("deletedAt")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS "leadId", o_orderdate AS "createdAt", lower(o_orderpriority) || '|' || regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS key, o_orderpriority AS email FROM orders),
m AS (SELECT c_custkey AS gone, c_custkey - 2 AS keep FROM customer WHERE c_custkey % 10 = 3)
SELECT keep AS "leadId", email, arg_min(c.id, (c."createdAt", c.id)) AS id FROM c JOIN m ON c."leadId" = m.gone WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k."leadId" = m.keep AND k.key = c.key) GROUP BY keep, email""")
def merge_contacts(spark, at):
    people = table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("leadId"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("email"), F.lit("").alias("mobile"), F.col("o_orderpriority").alias("phone"), F.lit(True).alias("isPrimary"))
    return dedup.merge_contacts(people, _merges(spark, at)).select("leadId", "email", "id")


@query("""SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY)""")
def purge_old_trash(spark, at):
    old = uploads(spark, at).withColumn("deletedAt", F.when(F.col("status") == "F", F.col("createdAt")))
    out = leads.delete_cascade({"leads": old, "contacts": lines(spark, at)}, "leads", leads.purge_test(AS_OF), {"contacts": ("leads", "cardId")})
    return out["leads"].select("id")


@query("""SELECT count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY)""")
def purge_cascade(spark, at):
    old = uploads(spark, at).withColumn("deletedAt", F.when(F.col("status") == "F", F.col("createdAt")))
    out = leads.delete_cascade({"leads": old, "contacts": lines(spark, at)}, "leads", leads.purge_test(AS_OF), {"contacts": ("leads", "cardId")})
    return out["contacts"].agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (1, 2, 3, 32) THEN 'APPROVED' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey IN (1, 2, 3, 32) THEN 9 END AS "reviewedById" FROM orders""")
def bulk_approve(spark, at):
    rows = uploads(spark, at).withColumns({"reviewedById": F.lit(None).cast("int"), "reviewedAt": F.lit(None).cast("timestamp_ntz")})
    return leads.approve(rows, [1, 2, 3, 32], 9, AS_OF).select("id", "status", "reviewedById")


@query("""SELECT coalesce(a.c_custkey, b.id) AS id, coalesce(nullif(b.name, ''), a.c_name) AS name, coalesce(a.c_mktsegment, b.email) AS email FROM customer a
FULL JOIN (SELECT c_custkey + 500 AS id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new ' || c_custkey END AS name, 'none' AS email FROM customer) b ON a.c_custkey = b.id""")
def upsert_users(spark, at):
    old = users(spark, at).select("id", "name", "email")
    new = old.select((F.col("id") + 500).alias("id"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("new "), F.col("id"))).alias("name"), F.lit("none").alias("email"))
    return leads.upsert(old, new, ["id"], keep=["email"])


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS window_start, user_id, count(*) AS count FROM events GROUP BY ALL""")
def rate_windows(spark, at):
    return analytics.rate_windows(table(spark, at, "events"), "ts", "user_id").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT l.doc_id AS id, CASE WHEN p >= 0.85 OR p >= t THEN 'PADDLEOCR' ELSE 'TESSERACT' END AS engine, CASE WHEN p >= 0.85 OR p >= t THEN p ELSE t END AS confidence
FROM (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS p, (doc_id % 97) / 100.0::DOUBLE AS t FROM labels) l""")
def ocr_choose_engine(spark, at):
    result = lambda m: F.struct(F.lit("t").alias("text"), ((F.col("doc_id") % m) / F.lit(100.0)).alias("confidence"), F.lit(True).alias("available"))
    chosen = table(spark, at, "labels").select("doc_id", cards.choose_engine(result(101), result(97)).alias("c"))
    return chosen.select(F.col("doc_id").alias("id"), F.col("c.chosenEngine").alias("engine"), F.col("c.confidence").alias("confidence"))


@query("""SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY round_even(y / 150.0, 0), x, y) - 1 AS idx
FROM (SELECT doc_id AS id, doc_id // 50 AS page, (doc_id * 7919) % 1009 AS x, (doc_id * 104729) % 997 AS y FROM labels) QUALIFY idx < 50""")
def reading_order(spark, at):
    d = F.col("doc_id")
    boxes = table(spark, at, "labels").select(d.alias("id"), F.call_function("div", d, F.lit(50)).alias("page"), ((d * 7919) % 1009).alias("x"), ((d * 104729) % 997).alias("y"), F.lit(1000).alias("h"))
    return cards.reading_order(boxes, "page", "h").select("id", "page", F.col("cardIndex").cast("long").alias("idx"))


_SQL_BOXES = """SELECT vec_id AS id, vec_id // 50 AS page, CAST(trunc(abs(embedding[1]::DOUBLE) * 400) AS INTEGER) AS x, CAST(trunc(abs(embedding[2]::DOUBLE) * 400) AS INTEGER) AS y,
  20 + CAST(trunc(abs(embedding[3]::DOUBLE) * 400) AS INTEGER) AS w, 20 + CAST(trunc(abs(embedding[4]::DOUBLE) * 400) AS INTEGER) AS h FROM embeddings WHERE embedding IS NOT NULL"""
#: Boxes of a page by falling area, each kept if it overlaps no kept one.
_SQL_KEPT = """SELECT page, unnest(list_reduce(list([{'id': id, 'x': x, 'y': y, 'w': w, 'h': h}] ORDER BY w * h DESC, id), lambda kept, one: CASE WHEN len(list_filter(kept, lambda k:
    greatest(0, least(k.x + k.w, one[1].x + one[1].w) - greatest(k.x, one[1].x)) * greatest(0, least(k.y + k.h, one[1].y + one[1].h) - greatest(k.y, one[1].y)) / CAST(k.w * k.h + one[1].w * one[1].h
    - greatest(0, least(k.x + k.w, one[1].x + one[1].w) - greatest(k.x, one[1].x)) * greatest(0, least(k.y + k.h, one[1].y + one[1].h) - greatest(k.y, one[1].y)) AS DOUBLE) >= 0.3)) = 0 THEN kept || one ELSE kept END)) AS b FROM boxes GROUP BY page"""


def _boxes(spark, at):
    """Boxes of pages, made from the first components of vectors."""
    side = lambda k: (F.abs(F.col("embedding")[k].cast("double")) * 400).cast("int")
    return table(spark, at, "embeddings").where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), F.call_function("div", F.col("vec_id"), F.lit(50)).alias("page"), side(0).alias("x"), side(1).alias("y"), (side(2) + 20).alias("w"), (side(3) + 20).alias("h"))


@query(f"""WITH boxes AS ({_SQL_BOXES}), k AS ({_SQL_KEPT}) SELECT page, b.id AS id, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM k""")
def suppress_overlaps(spark, at):
    """Greedy suppression of overlapping boxes on every page."""
    return cards.suppress(_boxes(spark, at)).select("page", "id", "x", "y", "w", "h")


@query(f"""WITH pages AS (SELECT DISTINCT vec_id // 50 AS page, 300 AS width, 300 + 100 * CAST(vec_id // 50 % 3 AS INTEGER) AS height FROM embeddings), found AS ({_SQL_BOXES}),
boxes AS (SELECT id, page, x, y, w, h FROM found JOIN pages USING (page) WHERE page % 4 <> 1 AND w * h / (width * height)::DOUBLE BETWEEN 0.02 AND 0.95 AND greatest(w, h) / least(w, h)::DOUBLE BETWEEN 1.2 AND 2.4),
k AS ({_SQL_KEPT}), a AS (SELECT page, height, b IS NULL AS whole, coalesce(b.x, 0) AS x, coalesce(b.y, 0) AS y, coalesce(b.w, width) AS w, coalesce(b.h, height) AS h FROM pages LEFT JOIN k USING (page)),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y / (height * 0.15::DOUBLE), 0), x, y) - 1 AS n FROM a)
SELECT page, CAST(n AS INTEGER) AS "cardIndex", x, y, w, h, whole FROM o WHERE n < 50""")
def detect_cards(spark, at):
    """Cards of every page; pages without one are a card as a whole."""
    boxes = _boxes(spark, at)
    sides = F.col("page"), F.lit(300).alias("width"), (300 + 100 * (F.col("page") % 3)).cast("int").alias("height")
    pages = table(spark, at, "embeddings").select(F.call_function("div", F.col("vec_id"), F.lit(50)).alias("page")).distinct().select(*sides)
    return cards.detected(pages, boxes.where(F.col("page") % 4 != 1))


@query("""SELECT doc_id AS id, round(0.5 * least(s / 500.0, 1.0) + 0.3 * least(c / 80.0, 1.0) + 0.2 * (1 - 2 * abs(m / 255.0 - 0.5)), 4)::DOUBLE AS quality
FROM (SELECT doc_id, (doc_id % 700)::DOUBLE AS s, (doc_id % 90)::DOUBLE AS c, (doc_id % 256)::DOUBLE AS m FROM labels)""")
def image_quality(spark, at):
    d = F.col("doc_id")
    return table(spark, at, "labels").select(d.alias("id"), cards.quality_score((d % 700).cast("double"), (d % 90).cast("double"), (d % 256).cast("double")).alias("quality"))


def _answers(spark, at):
    """An answer a page, in the forms that models give: text around a list of cards, a single card, other objects, no JSON, broken JSON, fields of other types."""
    n, host = F.col("page_id"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    name = F.concat(F.lit("Co "), n.cast("string"))
    contact = lambda mail, mobile, prime: F.struct(F.lit("N").alias("name"), mail.alias("email"), mobile.alias("mobile"), F.lit(prime).alias("isPrimary"))
    none = F.lit(None).cast("string")
    first = F.struct(name.alias("company"), host.alias("website"), F.array(contact(F.concat(F.lit("n@"), host), none, False), contact(none, n.cast("string"), True)).alias("contacts"), (n % 100).alias("confidence"))
    listed = F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(first, F.struct(F.lit("B").alias("company"), none.alias("website"), F.array().cast(_CONTACTS).alias("contacts"), none.cast("long").alias("confidence"))).alias("cards"))), F.lit(" done"))
    single = F.to_json(F.struct(name.alias("company"), F.lit(300).alias("confidence"), F.lit("Pune").alias("city")))
    odd = F.concat(F.lit('{"cards": "none", "company": '), n.cast("string"), F.lit(', "confidence": "50", "city": {"name": "Pune"}}'))
    forms = [listed, single, F.lit('{"other": 1}'), host, F.concat(F.lit('{"cards": [{"company": "'), host, F.lit('"}')), odd]
    text = F.coalesce(*(F.when(n % 6 == k, form) for k, form in enumerate(forms)))
    return table(spark, at, "pages").select(n.alias("id"), text.alias("response"))


_CONTACTS = "array<struct<name:string,email:string,mobile:string,isPrimary:boolean>>"
_SQL_HOST = "SELECT page_id AS id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages"


@query(f"""WITH p AS ({_SQL_HOST})
SELECT id, 0 AS "cardIndex", 'Co ' || id AS "companyName", 'n@' || host AS email, CAST(id AS VARCHAR) AS phone, (id % 100) / 100.0::DOUBLE AS confidence, NULL AS city FROM p WHERE id % 6 = 0
UNION ALL SELECT id, 1, 'B', NULL, NULL, NULL, NULL FROM p WHERE id % 6 = 0
UNION ALL SELECT id, 0, 'Co ' || id, NULL, NULL, 1.0, 'Pune' FROM p WHERE id % 6 = 1
UNION ALL SELECT id, 0, CAST(id AS VARCHAR), NULL, NULL, 0.5, NULL FROM p WHERE id % 6 = 5""")
def vision_json_parse(spark, at):
    """Cards from the answers of models, a row a card."""
    rows = responses.explode_vision(_answers(spark, at))
    return extract.entities_of_card(rows).select("id", "cardIndex", "companyName", "email", F.col("phonePrimary").alias("phone"), F.col("aiConfidence").alias("confidence"), "city")


@query(f"""WITH p AS ({_SQL_HOST}) SELECT id, CASE id % 6 WHEN 3 THEN host ELSE '{{"cards": [{{"company": "' || host || '"}}' END AS response, CASE id % 6 WHEN 3 THEN 'no JSON' ELSE 'invalid JSON' END AS fault FROM p WHERE id % 6 IN (3, 4)""")
def answer_quarantine(spark, at):
    """Answers that don't parse, kept as they came."""
    return responses.quarantine(_answers(spark, at))


@query("""WITH w AS (SELECT conv_id, turn, role, text, (conv_id * 31 + turn * 17) % 120 - 10 AS conf FROM conversations),
e AS (SELECT conv_id, turn, role, text, coalesce((SELECT avg(c / 100.0) FROM (SELECT unnest([conf, 60, 90]) AS c) WHERE c >= 0), 0)::DOUBLE AS mean FROM w),
t AS (SELECT *, (conv_id % 100)::DOUBLE / 100 AS other, turn % 3 <> 2 AS there FROM e)
SELECT conv_id AS id, turn AS "cardIndex", CASE WHEN there AND (other >= 0.85 OR other >= mean) THEN 'PADDLEOCR' ELSE 'TESSERACT' END AS engine, CASE WHEN there AND (other >= 0.85 OR other >= mean) THEN role ELSE text END AS "rawText",
  round(CASE WHEN there AND (other >= 0.85 OR other >= mean) THEN other ELSE mean END, 6)::DOUBLE AS confidence, turn * 10 AS x FROM t""")
def ocr_results(spark, at):
    """Cards of a reading service's JSON answers, one a conversation: the surer of two engines, whose words without a confidence don't count."""
    turns = table(spark, at, "conversations")
    conf = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 120 - 10).cast("double")
    words = F.array(*(F.struct(t.alias("text"), c.alias("confidence")) for t, c in ((F.lit("w"), conf), (F.lit("x"), F.lit(60.0)), (F.lit(" "), F.lit(99.0)), (F.lit("y"), F.lit(90.0)))))
    kept = cards.sure_words(words)
    engine = lambda name, text, confidence, lines, there: F.struct(F.lit(name).alias("engine"), text.alias("text"), confidence.alias("confidence"), lines.alias("lines"), there.alias("available"))
    results = F.struct(engine("PADDLEOCR", F.col("role"), (F.col("conv_id") % 100).cast("double") / 100, F.slice(kept, 1, 0), F.col("turn") % 3 != 2).alias("paddle"), engine("TESSERACT", F.col("text"), cards.mean_confidence(kept), kept, F.lit(True)).alias("tesseract"))
    card = F.struct(F.lit(0).alias("pageIndex"), F.col("turn").cast("int").alias("cardIndex"), F.array((F.col("turn") * 10).cast("int"), F.lit(0), F.lit(9), F.lit(9)).alias("bbox"), F.struct(results.alias("engineResults")).alias("ocr"))
    answers = turns.groupBy(F.col("conv_id").alias("id")).agg(F.to_json(F.struct(F.lit(1).alias("pages"), F.collect_list(card).alias("cards"))).alias("response"))
    return responses.explode_ocr(answers).select("id", F.col("cardIndex").cast("long").alias("cardIndex"), F.col("chosenEngine").alias("engine"), "rawText", F.round("confidence", 6).alias("confidence"), F.col("bbox.x").cast("long").alias("x"))


@query("""SELECT page_id AS id, CASE WHEN page_id % 3 = 0 AND size <= 3984588 THEN 'second' WHEN page_id % 3 = 1 AND size <= 4718592 THEN 'first' ELSE 'ocr' END AS engine FROM (SELECT page_id, length(html) * 1000 AS size FROM pages)""")
def engine_routing(spark, at):
    key = F.when(F.col("page_id") % 3 == 0, " gsk_1").when(F.col("page_id") % 3 == 1, "sk-ant-2")
    return table(spark, at, "pages").select(F.col("page_id").alias("id"), files.engine(F.lit("image/png"), F.length("html") * 1000, key).alias("engine"))


@query("""SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), nullif(c_mktsegment, '')) AS name FROM customer""")
def first_filled_names(spark, at):
    return users(spark, at).select("id", first_filled(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("name")), F.col("email")).alias("name"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS "uploadedById" FROM orders WHERE o_orderkey = 32""")
def point_lookup(spark, at):
    return uploads(spark, at).where(F.col("id") == 32).select("id", "status", "uploadedById")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1""")
def default_owner(spark, at):
    return leads.first_of(users(spark, at), [F.col("c_acctbal"), F.col("id")]).select("id", "name")


_SQL_LINES = r"""SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents"""
_WORDS = "|".join(extract.COMPANY_WORDS)


@query(rf"""WITH l AS ({_SQL_LINES}), n AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(lower(x), '\b({_WORDS})\b')) AS named, list_filter(ls[1:4], lambda x: x = upper(x) AND length(x) > 3) AS capitals FROM l)
SELECT doc_id, coalesce(named[1], list_filter(capitals, lambda x: length(x) = list_max(list_transform(capitals, lambda y: length(y))))[1]) AS company FROM n""")
def extract_company(spark, at):
    return _texts(spark, at).select("doc_id", extract.lines(F.col("text")).alias("lines")).select("doc_id", extract.company(F.col("lines")).alias("company"))


_STREETS = "|".join(w.replace(".", r"\.") for w in extract.ADDRESS_WORDS)


@query(rf"""WITH l AS ({_SQL_LINES}), a AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x: NOT (length(regexp_replace(x, '[^0-9]', '', 'g')) >= 8 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) <= 3)
  AND NOT regexp_matches(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AND (regexp_matches(x, '\b[0-9]{{6}}\b') OR regexp_matches(x, '(?i)\b({_STREETS})\b'))), ', ') AS address FROM l)
SELECT doc_id, nullif(address, '') AS address, coalesce(nullif(regexp_extract(address, '\b[0-9]{{6}}\b'), ''), nullif(regexp_extract(address, '\b[0-9]{{5,6}}\b'), '')) AS "postalCode" FROM a""")
def extract_address(spark, at):
    found = _texts(spark, at).select("doc_id", extract.lines(F.col("text")).alias("lines")).select("doc_id", extract.address(F.col("lines")).alias("address"))
    return found.select("doc_id", "address", extract.postal_code(F.col("address")).alias("postalCode"))


@query("SELECT conv_id, turn, CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '\b{d}\b') THEN '{d}'" for d in extract.DEPARTMENTS) + " END AS department FROM conversations")
def find_department(spark, at):
    return table(spark, at, "conversations").select("conv_id", "turn", extract.department(F.coalesce("text", F.lit(""))).alias("department"))


@query(f"""WITH k AS ({_SQL_SUPPLIERS}) SELECT id, ne, np, nc FROM k""")
def dup_keys(spark, at):
    return dedup.keyed(_suppliers(spark, at)).select("id", "ne", "np", "nc")


@query("""SELECT p_partkey AS id, CASE WHEN p_name = '' AND p_type = '' THEN 1.0 WHEN p_name = '' OR p_type = '' THEN 0.0 ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END::DOUBLE AS similarity FROM part""")
def name_similarity(spark, at):
    return table(spark, at, "part").select(F.col("p_partkey").alias("id"), dedup.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query(rf"""WITH f AS ({_SQL_FIELDS}), s AS (SELECT page_id, email <> '' AS has, CASE WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]{{2,}}$') THEN 0.2 WHEN regexp_matches(email, '(?i)^info@') THEN 0.7 ELSE 0.99 END::DOUBLE AS e,
  CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 THEN 0.95 ELSE 0.3 END::DOUBLE AS p FROM f)
SELECT page_id, round(least(1.0::DOUBLE, 0.1::DOUBLE + (CASE WHEN has THEN e * 2 ELSE 0 END + p * 2) / (CASE WHEN has THEN 4 ELSE 2 END) * 0.8::DOUBLE), 4)::DOUBLE AS confidence FROM s""")
def lead_confidence(spark, at):
    host, k, none = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)), F.col("page_id") % 4, F.lit(None).cast("string")
    email = F.when(k == 0, F.concat(F.lit("info@"), host)).when(k == 1, F.concat(F.lit("x"), F.col("page_id"), F.lit("@"), host)).when(k == 2, host).otherwise("")
    phone = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("+91 98765 4"), F.col("page_id"))).otherwise(F.col("page_id").cast("string"))
    rows = table(spark, at, "pages").select("page_id", email.alias("email"), phone.alias("phonePrimary"), *(none.alias(c) for c in ("phoneSecondary", "website", "gstin", "linkedin", "postalCode", "address", "city", "state", "country")), F.lit("A").alias("companyName"), F.lit(None).cast(f"array<{extract.CONTACT}>").alias("contacts"))
    return validate.validate_leads(rows).select("page_id", F.col("overallConfidence").alias("confidence"))


def _companies(spark, at):
    return table(spark, at, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("city"))


def _cards(spark, at):
    return table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uploadId"), F.col("o_orderpriority").alias("side"))


def _results(spark, at):
    return table(spark, at, "orders").where(F.col("o_orderstatus") != "O").select(F.col("o_orderkey").alias("cardId"), F.concat(F.lit("card "), "o_orderkey").alias("rawText"))


def _leads(spark, at):
    trashed = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderdate"))
    return table(spark, at, "orders").where(F.col("o_orderkey") % 4 != 0).select((F.col("o_orderkey") * 10).alias("id"), F.col("o_orderkey").alias("cardId"), F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") % 17).alias("companyId"), trashed.alias("deletedAt"))


@query("""SELECT o_orderkey * 10 AS id, s_name AS company, s_nationkey AS city FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 17 AND o_orderkey % 4 = 1 WHERE o_orderkey % 4 <> 0""")
def lead_with_company(spark, at):
    return leads.with_company(_leads(spark, at), _companies(spark, at)).select("id", F.col("company.name").alias("company"), F.col("company.city").alias("city"))


@query("""SELECT o_orderkey * 10 AS id, o_custkey AS upload, o_orderpriority AS side, CASE WHEN o_orderstatus <> 'O' THEN 'card ' || o_orderkey END AS "rawText" FROM orders WHERE o_orderkey % 4 <> 0""")
def lead_with_card(spark, at):
    found = leads.with_card(_leads(spark, at), _cards(spark, at), _results(spark, at))
    return found.select("id", F.col("card.uploadId").alias("upload"), F.col("card.side").alias("side"), F.col("card.ocrResult.rawText").alias("rawText"))


@query("""SELECT c_custkey AS id, count(o_orderkey) AS cards, coalesce(string_agg(o_orderkey || o_orderpriority || CASE WHEN o_orderstatus <> 'O' THEN 'card ' || o_orderkey ELSE '-' END || CASE WHEN o_orderkey % 4 <> 0 THEN 'lead' ELSE '' END, ';' ORDER BY o_orderkey), '') AS shown
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def upload_with_cards(spark, at):
    found = leads.with_cards(users(spark, at).select("id"), _cards(spark, at), _results(spark, at), _leads(spark, at))
    shown = F.transform("cards", lambda c: F.concat(c["id"].cast("string"), c["side"], F.coalesce(c["ocrResult"]["rawText"], F.lit("-")), F.when(c["lead"].isNotNull(), "lead").otherwise("")))
    return found.select("id", F.size("cards").cast("long").alias("cards"), F.array_join(shown, ";").alias("shown"))


@query("""SELECT o_orderkey * 10 AS id FROM orders WHERE o_orderkey % 4 <> 0 AND starts_with(o_orderpriority, '1') AND o_custkey % 5 = 2 ORDER BY o_orderdate DESC, 1 LIMIT 200""")
def trash_list(spark, at):
    mine = users(spark, at).select("id", (F.col("id") % 5).alias("uploadedById"))
    return leads.trash_list(_leads(spark, at), _cards(spark, at), mine, 2, "REVIEWER").select("id")


_STATES = "CASE o_orderstatus WHEN 'F' THEN 'READY_FOR_REVIEW' WHEN 'O' THEN 'EXTRACTING' ELSE 'FAILED' END"


def _states(spark, at):
    state = F.when(F.col("status") == "F", "READY_FOR_REVIEW").when(F.col("status") == "O", "EXTRACTING").otherwise("FAILED")
    return uploads(spark, at).withColumns({"status": state, "error": F.col("source")})


@query(f"""SELECT (SELECT count(*) FROM (SELECT {_STATES} AS s FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) WHERE s = 'READY_FOR_REVIEW') AS "readyForReview", (SELECT count(*) FROM lineitem) AS "leadsCreated" """)
def lead_gap(spark, at):
    return analytics.lead_gap(_states(spark, at), lines(spark, at))


@query(f"""SELECT o_orderkey AS id, CASE WHEN {_STATES} = 'EXTRACTING' THEN 'PENDING' ELSE {_STATES} END AS status, CASE WHEN {_STATES} <> 'EXTRACTING' THEN o_orderpriority END AS error FROM orders""")
def recover_stuck(spark, at):
    return leads.recover_stuck(_states(spark, at)).select("id", "status", "error")


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (1, 2, 3, 7) THEN 'FAILED' ELSE {_STATES} END AS status, CASE WHEN o_orderkey IN (1, 2, 3, 7) THEN 'late' ELSE o_orderpriority END AS error FROM orders""")
def upload_failed(spark, at):
    return leads.set_upload(_states(spark, at), [1, 2, 3, 7], "FAILED", "late").select("id", "status", "error")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN 'REVIEWER' ELSE c_mktsegment END AS role, c_custkey <> 5 AS "isActive" FROM customer""")
def edit_user(spark, at):
    people = table(spark, at, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"), F.lit(True).alias("isActive"))
    return leads.edit_user(people, 5, 1, "REVIEWER", False)


@query(f"""WITH o AS ({_SQL_KNOWN}), m AS (SELECT c_custkey AS gone, c_custkey - 2 AS keep FROM customer WHERE c_custkey % 10 = 3),
c AS (SELECT o_custkey AS lead, lower(o_orderpriority) || '|' || regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS key, o_orderpriority AS email FROM orders)
SELECT 'lead' AS kind, c_custkey AS a, keep AS b, CASE WHEN gone IS NULL THEN 'APPROVED' ELSE 'MERGED' END AS status FROM customer LEFT JOIN m ON gone = c_custkey
UNION ALL SELECT 'contact', lead, NULL, email FROM c
UNION ALL SELECT DISTINCT 'contact', keep, NULL::BIGINT, email FROM c JOIN m ON lead = gone WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.lead = m.keep AND k.key = c.key)
UNION ALL SELECT 'pair', "leadAId", "leadBId", CASE WHEN "leadAId" IN (SELECT gone FROM m) OR "leadBId" IN (SELECT gone FROM m) THEN 'MERGED' ELSE status END FROM o""")
def merge_all(spark, at):
    c = table(spark, at, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("companyName"), F.lit("APPROVED").alias("status"), F.lit(None).cast("long").alias("mergedIntoId"), F.lit(None).cast("timestamp_ntz").alias("deletedAt"))
    people = table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("leadId"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("email"), F.lit("").alias("mobile"), F.col("o_orderpriority").alias("phone"), F.lit(True).alias("isPrimary"))
    done = dedup.merge(rows, people, _known(spark, at), _merges(spark, at), AS_OF)
    parts = [
        done["leads"].select(F.lit("lead").alias("kind"), F.col("id").alias("a"), F.col("mergedIntoId").alias("b"), "status"),
        done["contacts"].select(F.lit("contact").alias("kind"), F.col("leadId").alias("a"), F.lit(None).cast("long").alias("b"), F.col("email").alias("status")),
        done["duplicates"].select(F.lit("pair").alias("kind"), F.col("leadAId").alias("a"), F.col("leadBId").alias("b"), "status"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Of ten leads in a row: which goes into which, a chain and several into one.
_FOREST = {1: 0, 2: 1, 3: 2, 5: 0, 7: 5, 9: 0}


@query(f"""WITH l AS (SELECT c_custkey AS id, (c_custkey - 1) // 10 AS block, (c_custkey - 1) % 10 AS p, CASE WHEN c_custkey % 3 <> 0 THEN '' ELSE c_name END AS "companyName", CASE WHEN c_custkey % 4 <> 0 THEN NULL ELSE c_mktsegment END AS city FROM customer),
g AS (SELECT *, list_position([9, 5, 7, 1, 2, 3], p) AS place FROM l WHERE p IN (1, 2, 3, 5, 7, 9)),
f AS (SELECT block, arg_min("companyName", place) FILTER ("companyName" <> '') AS name, arg_min(city, place) FILTER (city IS NOT NULL) AS city FROM g GROUP BY block),
c AS (SELECT o_orderkey AS id, o_custkey AS lead, o_orderdate AS at, lower(o_orderpriority) || '|' || regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS key, o_orderpriority AS email FROM orders),
o AS ({_SQL_KNOWN})
SELECT 'lead' AS kind, l.id AS a, CASE p WHEN 1 THEN l.id - 1 WHEN 2 THEN l.id - 1 WHEN 3 THEN l.id - 1 WHEN 5 THEN l.id - 5 WHEN 7 THEN l.id - 2 WHEN 9 THEN l.id - 9 END AS b,
  coalesce(nullif(l."companyName", ''), CASE WHEN p = 0 THEN f.name END, l."companyName") AS text, coalesce(l.city, CASE WHEN p = 0 THEN f.city END) AS more, CASE WHEN p IN (1, 2, 3, 5, 7, 9) THEN 'MERGED' ELSE 'APPROVED' END AS status FROM l LEFT JOIN f USING (block)
UNION ALL SELECT 'contact', lead, id, email, NULL, NULL FROM c
UNION ALL SELECT 'added', g.block * 10 + 1, arg_min(c.id, (place, c.at, c.id)), c.email, NULL, NULL FROM c JOIN g ON g.id = c.lead WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.lead = g.block * 10 + 1 AND k.key = c.key) GROUP BY g.block, c.key, c.email
UNION ALL SELECT 'pair', "leadAId", "leadBId", NULL, NULL, CASE WHEN "leadAId" IN (SELECT id FROM g) OR "leadBId" IN (SELECT id FROM g) THEN 'MERGED' ELSE status END FROM o""")
def merge_groups(spark, at):
    """Chains of merges and several leads into one: leads, contacts and pairs after them, and which contacts were added from which."""
    c = table(spark, at, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, "").otherwise(F.col("c_name")).alias("companyName"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("city"), F.lit("APPROVED").alias("status"), F.lit(None).cast("long").alias("mergedIntoId"), F.lit(None).cast("timestamp_ntz").alias("deletedAt"))
    place = (F.col("c_custkey") - 1) % 10
    into = F.coalesce(*(F.when(place == gone, F.col("c_custkey") - gone + keep) for gone, keep in _FOREST.items()))
    # The later of two siblings was merged first.
    merges = c.select(F.col("c_custkey").alias("goneId"), into.alias("keepId"), F.timestamp_seconds(10 - place).cast("timestamp_ntz").alias("mergedAt")).where(F.col("keepId").isNotNull())
    people = table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("leadId"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("email"), F.lit("").alias("mobile"), F.col("o_orderpriority").alias("phone"), F.lit(True).alias("isPrimary"))
    done = dedup.merge(rows, people, _known(spark, at), merges, AS_OF)
    none = F.lit(None).cast("string")
    added = dedup.merge_contacts(people, merges, dedup.merge_roots(rows, merges))
    parts = [
        done["leads"].select(F.lit("lead").alias("kind"), F.col("id").alias("a"), F.col("mergedIntoId").alias("b"), F.col("companyName").alias("text"), F.col("city").alias("more"), "status"),
        done["contacts"].where("isPrimary").select(F.lit("contact").alias("kind"), F.col("leadId").alias("a"), F.col("id").alias("b"), F.col("email").alias("text"), none.alias("more"), none.alias("status")),
        added.select(F.lit("added").alias("kind"), F.col("leadId").alias("a"), F.col("id").alias("b"), F.col("email").alias("text"), none.alias("more"), none.alias("status")),
        done["duplicates"].select(F.lit("pair").alias("kind"), F.col("leadAId").alias("a"), F.col("leadBId").alias("b"), none.alias("text"), none.alias("more"), "status"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4) THEN 'FAILED' ELSE o_orderstatus END AS status, true AS few FROM orders""")
def change_few_rows(spark, at):
    """Four rows of a table in 64 buckets changed: the table after it, and whether four buckets at most were written."""
    folder, rows = workspace(spark), uploads(spark, at).select("id", "status", F.lit(None).cast("string").alias("error"))
    snapshots.publish_bucketed(spark, folder, {"uploads": (rows, "id")}, 64)
    few = rows.select("id").orderBy("id").limit(4)
    ids = [r["id"] for r in few.collect()]
    _, wrote = snapshots.change(spark, folder, {"uploads": (few, lambda old: leads.set_upload(old, ids, "FAILED", "broken"))})
    return snapshots.bucketed(spark, folder)["uploads"].select("id", "status", F.lit(wrote["uploads"] <= 4).alias("few"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS total FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""")
def second_page_with_total(spark, at):
    """The second page of a list, with the number of all rows."""
    order, rows = [("createdAt", True), ("id", False)], uploads(spark, at).where(F.col("status") != "P").select("id", "status", "createdAt")
    first, _ = leads.page_with_total(rows, order)
    last = first.orderBy(F.asc("createdAt"), F.desc("id")).first()
    found, total = leads.page_with_total(rows, order, last=last.asDict())
    return found.select("id", "status", F.lit(total).cast("long").alias("total"))


@query("""SELECT c_custkey AS id, count(o_orderkey) AS contacts, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS "firstContact" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lead_contacts(spark, at):
    """Leads with their contacts, oldest first: how many, and the first."""
    people = table(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("leadId"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("email"))
    held = leads.with_contacts(table(spark, at, "customer").select(F.col("c_custkey").alias("id")), people)
    return held.select("id", F.coalesce(F.size("contacts"), F.lit(0)).cast("long").alias("contacts"), F.get("contacts", F.lit(0))["contactId"].alias("firstContact"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'Pune' ELSE c_mktsegment END AS city, c_name AS name FROM customer""")
def edit_lead(spark, at):
    """One lead's editable fields changed; others are passed over."""
    rows = table(spark, at, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("city"), F.col("c_name").alias("name"))
    return leads.edit(rows, 7, {"city": "Pune", "name": "not editable"})


@query("""SELECT sha256('u1|LEAD_TRASH|Lead|' || o_orderkey || '|1998-06-01 00:00:00') AS id, 'u1' AS "userId", 'LEAD_TRASH' AS action, 'Lead' AS "entityType", CAST(o_orderkey AS VARCHAR) AS "entityId", TIMESTAMP '1998-06-01' AS "createdAt" FROM orders WHERE o_orderstatus = 'F'""")
def audit_log(spark, at):
    """A row of the log for each lead that went to the trash."""
    return audit.audit_rows(uploads(spark, at).where(F.col("status") == "F").select("id"), "LEAD_TRASH", "Lead", "u1", AS_OF).drop("metadata")


@query("""SELECT l_orderkey AS request, l_linenumber AS file FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 5)""")
def file_limit(spark, at):
    """Files of requests that are not too large."""
    return files.within_limit(table(spark, at, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("file")), "request", 5)


@query(f"""WITH o AS ({_SQL_KNOWN}) SELECT "leadAId" AS id, CASE WHEN "leadAId" IN (1, 4, 10) THEN 'DISMISSED' ELSE status END AS status FROM o""")
def dismiss_pairs(spark, at):
    return dedup.dismiss(_known(spark, at).withColumn("id", F.col("leadAId")), [1, 4, 10]).select("id", "status")


@query("""SELECT conv_id, turn, text FROM conversations WHERE conv_id IS DISTINCT FROM 3 UNION ALL SELECT 3, turn, text FROM conversations WHERE conv_id = 5""")
def replace_contacts(spark, at):
    turns = table(spark, at, "conversations").select("conv_id", "turn", "text")
    return leads.replace_children(turns, "conv_id", 3, turns.where(F.col("conv_id") == 5).withColumn("conv_id", F.lit(3).cast(turns.schema["conv_id"].dataType)))


_SQL_CODES = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN '27ABCDE' || lpad(cast(page_id % 10000 AS VARCHAR), 4, '0') || 'F1Z5' ELSE 'x27ABCDE1234F1Z5' END AS gstin,
  CASE WHEN page_id % 2 = 0 THEN url || 'linkedin.com/IN/x' ELSE url END AS linkedin, cast(page_id * 37 AS VARCHAR) AS postal FROM pages"""


def _codes(spark, at):
    k = F.col("page_id")
    gstin = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("27ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z5"))).otherwise("x27ABCDE1234F1Z5")
    return table(spark, at, "pages").select("page_id", gstin.alias("gstin"), F.when(k % 2 == 0, F.concat("url", F.lit("linkedin.com/IN/x"))).otherwise(F.col("url")).alias("linkedin"), (k * 37).cast("string").alias("postal"))


@query(rf"""WITH f AS ({_SQL_CODES})
SELECT page_id, CASE WHEN gstin = '' THEN 0.0 WHEN regexp_matches(gstin, '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][A-Z0-9]Z[A-Z0-9]$') THEN 0.98 ELSE 0.25 END::DOUBLE AS gstin_confidence,
  gstin <> '' AND NOT starts_with(gstin, '27') AS gstin_reason, CASE WHEN linkedin = '' THEN 0.0 WHEN regexp_matches(linkedin, '(?i)linkedin\.com/(in|company)/|^in/') THEN 0.9 ELSE 0.5 END::DOUBLE AS linkedin_confidence,
  CASE WHEN regexp_matches(postal, '^[0-9]{{5,6}}$') THEN 0.85 ELSE 0.4 END::DOUBLE AS postal_confidence FROM f""")
def validate_codes(spark, at):
    scored = _codes(spark, at).select("page_id", validate.score_gstin(F.col("gstin")).alias("g"), validate.score_linkedin(F.col("linkedin")).alias("l"), validate.score_postal(F.col("postal")).alias("p"))
    return scored.select("page_id", F.col("g.confidence").alias("gstin_confidence"), F.col("g.reason").isNotNull().alias("gstin_reason"), F.col("l.confidence").alias("linkedin_confidence"), F.col("p.confidence").alias("postal_confidence"))


@query(rf"""WITH f AS ({_SQL_CODES}), t AS (SELECT page_id, html || ' ' || lower(gstin) || chr(10) || gstin AS x FROM f JOIN pages USING (page_id))
SELECT page_id, nullif(regexp_extract(upper(x), '\b[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][A-Z0-9]Z[A-Z0-9]\b'), '') AS gstin FROM t""")
def extract_gstin(spark, at):
    text = table(spark, at, "pages").select("page_id", "html").join(_codes(spark, at), "page_id").select("page_id", F.concat("html", F.lit(" "), F.lower("gstin"), F.lit("\n"), "gstin").alias("x"))
    return text.select("page_id", extract.gstin(F.col("x")).alias("gstin"))


_SQL_INSIDE = "|".join(w.replace(".", "[.]") for w in COMPANY_WORDS + DESIGNATIONS)


@query(f"""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Nicole ' || c_mktsegment WHEN 1 THEN upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) || ' Rao' WHEN 2 THEN 'Sales Manager ' || c_name ELSE 'O''Neil A. ' || c_mktsegment END AS line FROM customer)
SELECT id, regexp_matches(line, '^[A-Z][a-zA-Z.''-]*( [A-Z][a-zA-Z.''-]*){{1,3}}$') AND NOT regexp_matches(lower(line), '{_SQL_INSIDE}') AS is_name, CASE WHEN id % 4 = 2 THEN line END AS designation FROM t""")
def name_lines(spark, at):
    c = table(spark, at, "customer")
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    shown = F.concat(F.upper(F.substring(segment, 1, 1)), F.lower(F.expr("substring(c_mktsegment, 2)")), F.lit(" Rao"))
    line = F.when(k % 4 == 0, F.concat(F.lit("Nicole "), segment)).when(k % 4 == 1, shown).when(k % 4 == 2, F.concat(F.lit("Sales Manager "), "c_name")).otherwise(F.concat(F.lit("O'Neil A. "), segment))
    return c.select(k.alias("id"), line.alias("line")).select("id", extract.is_name(F.col("line")).alias("is_name"), extract.designation(F.col("line")).alias("designation"))
