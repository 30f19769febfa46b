"""Dashboard and report figures. One pass a table; ties in every order are broken by the label or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, ratio_pct


def active(leads: DataFrame, deleted: str = "deletedAt") -> DataFrame:
    return leads.where(F.col(deleted).isNull())


def counted(df: DataFrame, **tests: Column) -> DataFrame:
    """One row: ``total`` and, for each test, the rows that meet it."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(t).alias(k) for k, t in tests.items()))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def top_n(grouped: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n largest groups with a label."""
    return grouped.where(blank_to_null(key).isNotNull()).orderBy(F.desc("count"), key).limit(n).select(F.col(key).alias("label"), "count")


def top_groups(df: DataFrame, key: str, take: int = 20) -> DataFrame:
    """The ``take`` largest groups, the null group last (its key counts as nothing), and of those the ones with a label."""
    grouped = df.groupBy(key).agg(F.count("*").alias("count"), F.count(key).alias("keyed"))
    return top_n(grouped.orderBy(F.desc("keyed"), F.asc_nulls_last(key)).limit(take), key, take)


def daily(df: DataFrame, at: str, days: int = 30) -> DataFrame:
    """Rows a day, the latest days first."""
    return df.groupBy(F.date_trunc("day", at).alias("day")).agg(F.count("*").alias("count")).orderBy(F.desc("day")).limit(days)


def employee_report(leads: DataFrame, cards: DataFrame, uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Active leads by the user who uploaded their card and by day. Lead counts a card come first, so that the joins see one row a card and day."""
    days = active(leads).groupBy("cardId", F.date_format("createdAt", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    owned = days.join(cards.select(F.col("id").alias("cardId"), "uploadId"), "cardId").join(uploads.select(F.col("id").alias("uploadId"), "uploadedById"), "uploadId")
    totals = owned.groupBy("uploadedById", "date").agg(F.sum("n").alias("count"))
    return totals.join(users.select(F.col("id").alias("uploadedById"), "name", "email"), "uploadedById").select(F.col("uploadedById").alias("userId"), "name", "email", "date", "count")


def dashboard_kpis(uploads: DataFrame, cards: DataFrame, ocr_results: DataFrame, leads: DataFrame, duplicates: DataFrame, exports: DataFrame) -> DataFrame:
    """One row with the eight figures of the dashboard."""
    live = F.col("deletedAt").isNull()
    parts = [
        uploads.agg(F.count("*").alias("totalFiles")),
        cards.agg(F.count("*").alias("cardsDetected")),
        ocr_results.agg(F.count("*").alias("cardsProcessed")),
        leads.agg(F.count_if(live).alias("leadsCreated"), F.count_if(live & (F.col("status") == "APPROVED")).alias("approved")),
        duplicates.agg(F.count_if(F.col("status") == "OPEN").alias("duplicatesFound")),
        exports.agg(F.count("*").alias("exportCount")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out.withColumn("successRate", ratio_pct(F.col("cardsProcessed"), F.col("cardsDetected")))


def data_quality(leads: DataFrame) -> DataFrame:
    """Shares of all leads (deleted ones too) that are approved and that have an e-mail, phone and GSTIN; an empty string counts as present."""
    one = leads.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "APPROVED").alias("approved"), *(F.count(c).alias(c) for c in ("email", "phonePrimary", "gstin")))
    total = F.col("total")
    return one.select(
        "total",
        "approved",
        ratio_pct(F.col("approved"), total).alias("approvedPct"),
        ratio_pct(F.col("email"), total).alias("withEmailPct"),
        ratio_pct(F.col("phonePrimary"), total).alias("withPhonePct"),
        ratio_pct(F.col("gstin"), total).alias("withGstinPct"),
    )


def _groups(df: DataFrame, keys: dict[str, Column], **tests: Column) -> DataFrame:
    """(part, label, count, keyed, <tests>): the rows of ``df`` by each key and, as part ``all``, altogether, from one scan."""
    names = list(keys)
    shown = df.select(*(c.cast("string").alias(f"k{n}") for n, c in enumerate(keys.values())), *(t.alias(k) for k, t in tests.items()))
    columns = [F.col(f"k{n}") for n in range(len(names))]
    sums = shown.groupingSets([[c] for c in columns] + [[]], *columns).agg(F.grouping_id(*columns).alias("g"), F.count("*").alias("count"), *(F.count_if(k).alias(k) for k in tests))
    every = (1 << len(names)) - 1  # bits of the keys that a row doesn't have, the first key the highest
    part, label = F.lit("all"), F.lit(None).cast("string")
    for n, name in enumerate(names):
        here = F.col("g") == every - (1 << (len(names) - 1 - n))
        part, label = F.when(here, name).otherwise(part), F.when(here, columns[n]).otherwise(label)
    return sums.select(part.alias("part"), label.alias("label"), "count", F.when(label.isNotNull(), F.col("count")).otherwise(0).alias("keyed"), *tests)


def _tops(grouped: DataFrame, most: dict[str, int], distribution: tuple[str, ...] = (), by_label: tuple[str, ...] = (), **figures: Column) -> DataFrame:
    """(part, place, label, count): the first groups of each part, and a row for each figure of the part ``all``, in one pass.

    The largest groups with a label are first; in a ``distribution`` the null group takes a place at the end; ``by_label`` parts go by falling labels (days).
    """
    named = blank_to_null("label").isNotNull()
    within = lambda parts: F.col("part").isin(*parts) if parts else F.lit(False)
    dated = F.when(within(by_label), F.col("label"))
    size = F.when(within(distribution), F.col("keyed")).otherwise(F.col("count"))
    first = Window.partitionBy("part").orderBy(F.desc_nulls_last(dated), F.desc(size), F.asc_nulls_last("label"))
    limit = F.coalesce(*(F.when(F.col("part") == k, n) for k, n in most.items()), F.lit(1))
    wanted = F.col("part").isin(*most, *["all"][: len(figures)]) & (named | within((*distribution, *by_label, "all")))
    chosen = grouped.where(wanted).withColumn("first", F.row_number().over(first)).where((F.col("first") <= max(most.values())) & (F.col("first") <= limit))
    again = Window.partitionBy("part").orderBy(F.desc_nulls_last(dated), F.desc("count"), F.asc_nulls_last("label"))
    shown = chosen.where(named | within((*by_label, "all"))).withColumn("place", F.row_number().over(again))
    row = lambda part, label, count: F.struct(part.alias("part"), F.col("place").alias("place"), label.alias("label"), count.cast("long").alias("count"))
    own = F.array(row(F.col("part"), F.col("label"), F.col("count")))
    every = F.array(*(row(F.lit(k), F.lit(None).cast("string"), v) for k, v in figures.items())) if figures else own
    return shown.select(F.explode(F.when(F.col("part") == "all", every).otherwise(own)).alias("r")).select("r.*")


def _status(df: DataFrame, key: str, name: str) -> DataFrame:
    return _tops(_groups(df, {name: F.col(key)}), {name: 1000})


def dashboard_parts(uploads: DataFrame, cards: DataFrame, ocr_results: DataFrame, leads: DataFrame, companies: DataFrame, duplicates: DataFrame, exports: DataFrame) -> DataFrame:
    """(part, place, label, count): the figures and the largest groups of the dashboard, from one scan a table."""
    live = F.col("deletedAt").isNull()
    of_leads = _groups(leads.where(live), {"topCities": F.col("city"), "topStates": F.col("state")}, approved=F.col("status") == "APPROVED")
    of_companies = _groups(companies, {"topIndustries": F.col("industry")})
    rest = {"totalFiles": uploads, "cardsDetected": cards, "cardsProcessed": ocr_results, "exportCount": exports, "duplicatesFound": duplicates.where(F.col("status") == "OPEN")}
    out = _tops(of_leads, {"topCities": 5, "topStates": 5}, leadsCreated=F.col("count"), approved=F.col("approved")).unionByName(_tops(of_companies, {"topIndustries": 5}))
    for name, df in rest.items():
        out = out.unionByName(df.agg(F.count("*").alias("count")).select(F.lit(name).alias("part"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("label"), "count"))
    return out


def report_parts(uploads: DataFrame, leads: DataFrame, companies: DataFrame, duplicates: DataFrame, exports: DataFrame) -> DataFrame:
    """(part, place, label, count): the reports, from one scan a table; deleted leads count here."""
    day = F.date_format(F.date_trunc("day", "scannedAt"), "yyyy-MM-dd")
    of_leads = _groups(
        leads, {"leadAcquisition": day, "stateDistribution": F.col("state"), "cityDistribution": F.col("city")},
        approved=F.col("status") == "APPROVED", **{k: F.col(c).isNotNull() for k, c in (("withEmail", "email"), ("withPhone", "phonePrimary"), ("withGstin", "gstin"))},
    )
    out = _tops(of_leads, {"leadAcquisition": 30, "stateDistribution": 20, "cityDistribution": 20}, ("stateDistribution", "cityDistribution"), ("leadAcquisition",), total=F.col("count"), **{k: F.col(k) for k in ("approved", "withEmail", "withPhone", "withGstin")})
    out = out.unionByName(_tops(_groups(companies, {"industryDistribution": F.col("industry")}), {"industryDistribution": 20}, ("industryDistribution",)))
    for name, df, key in (("duplicateAnalysis", duplicates, "status"), ("exportStatistics", exports, "format"), ("processingStatistics", uploads, "status")):
        out = out.unionByName(_status(df, key, name))
    return out


def _row(parts: DataFrame, lists: list[str], figures: list[str]) -> DataFrame:
    """The parts as one row: a list of (label, count) for each of ``lists``, a number for each of ``figures``."""
    held = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("place", "label", "count")))).alias(p) for p in lists]
    numbers = [F.coalesce(F.max(F.when(F.col("part") == p, F.col("count"))), F.lit(0)).alias(p) for p in figures]
    return parts.agg(*held, *numbers).select(*(F.transform(p, lambda x: F.struct(x["label"].alias("label"), x["count"].alias("count"))).alias(p) for p in lists), *figures)


def dashboard(uploads: DataFrame, cards: DataFrame, ocr_results: DataFrame, leads: DataFrame, companies: DataFrame, duplicates: DataFrame, exports: DataFrame, audit_logs: DataFrame) -> dict[str, DataFrame]:
    """``summary``, the figures and largest groups of the dashboard as one row, and the latest imports, exports and actions."""
    recent = lambda df, n: df.orderBy(F.desc("createdAt"), "id").limit(n)
    figures = ["totalFiles", "cardsDetected", "cardsProcessed", "leadsCreated", "approved", "duplicatesFound", "exportCount"]
    row = _row(dashboard_parts(uploads, cards, ocr_results, leads, companies, duplicates, exports), ["topIndustries", "topCities", "topStates"], figures)
    return {
        "summary": row.withColumn("successRate", ratio_pct(F.col("cardsProcessed"), F.col("cardsDetected"))),
        "recentImports": recent(uploads, 5), "recentExports": recent(exports, 5), "recentActivity": recent(audit_logs, 10),
    }


def reports(uploads: DataFrame, leads: DataFrame, companies: DataFrame, duplicates: DataFrame, exports: DataFrame) -> DataFrame:
    """All reports as one row."""
    lists = ["leadAcquisition", "industryDistribution", "stateDistribution", "cityDistribution", "duplicateAnalysis", "exportStatistics", "processingStatistics"]
    row = _row(report_parts(uploads, leads, companies, duplicates, exports), lists, ["total", "approved", "withEmail", "withPhone", "withGstin"])
    share = lambda c, name: ratio_pct(F.col(c), F.col("total")).alias(name)
    return row.select(*lists, F.struct("total", "approved", share("approved", "approvedPct")).alias("crmReadiness"), F.struct(*(share(c, f"{c}Pct") for c in ("withEmail", "withPhone", "withGstin"))).alias("dataQuality"))


def with_child_counts(parents: DataFrame, children: DataFrame, key: str, parent_key: str = "id", name: str = "count") -> DataFrame:
    """``parents`` with the number of their children, 0 without any."""
    counts = children.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    return parents.join(counts, parents[parent_key] == F.col("__k"), "left").select(*parents.columns, F.coalesce("__n", F.lit(0)).alias(name))


def latest_status(uploads: DataFrame, take: int = 200) -> DataFrame:
    """Status counts over the latest uploads only."""
    return group_counts(uploads.orderBy(F.desc("createdAt"), "id").limit(take), "status")


def lead_gap(uploads: DataFrame, leads: DataFrame, take: int = 200) -> DataFrame:
    """One row: how many of the latest uploads are ready for review, and how many leads there are at all."""
    ready = uploads.orderBy(F.desc("createdAt"), "id").limit(take).agg(F.count_if(F.col("status") == "READY_FOR_REVIEW").alias("readyForReview"), F.lit(0).cast("long").alias("leadsCreated"))
    made = leads.agg(F.lit(0).cast("long").alias("readyForReview"), F.count("*").alias("leadsCreated"))
    return ready.unionByName(made).agg(*(F.sum(c).alias(c) for c in ("readyForReview", "leadsCreated")))


def rate_windows(events: DataFrame, at: str, key: str, width: str = "15 minutes") -> DataFrame:
    """Requests a client and fixed window."""
    return events.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), key, "count")
