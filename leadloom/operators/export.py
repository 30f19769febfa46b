"""Export in the CRM's layout: rows, and CSV, JSON and XLSX files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import primary
from ..functions.text import first_filled
from ..functions.values import CRM_COLUMNS, CRM_DEFAULTS
from ..sources.exports import SHEET_ROWS, save


def stamp(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def crm_rows(leads: DataFrame, defaults: dict[str, str] | None = None, branch_by_source: dict[str, str] | None = None) -> DataFrame:
    """``leads`` (with ``company`` and ``contacts``) as rows of the CRM: one a lead, then one for each contact that isn't primary. ``leadId`` and ``pos`` give the order."""
    fixed = CRM_DEFAULTS | (defaults or {})
    lead, co, who = (lambda c: F.col(c)), (lambda c: F.col(f"company.{c}")), (lambda c: F.col("_p")[c])
    some = lambda *c: F.coalesce(first_filled(*c), F.lit(""))
    branch = F.lit(fixed["Sales Branch"])
    if branch_by_source:
        table = F.create_map(*(F.lit(x) for kv in branch_by_source.items() for x in kv))
        branch = F.coalesce(first_filled(F.try_element_at(table, F.col("source"))), branch)
    values = {
        "Company Name": some(lead("companyName"), co("name")),
        "Website": some(lead("website"), co("website")),
        "Email": some(lead("email"), who("email")),
        "Phone": some(lead("phonePrimary"), who("phone")),
        "Industry": some(lead("industry"), co("industry")),
        "City": some(lead("city"), co("city")),
        "State": some(lead("state"), co("state")),
        "GSTIN": some(lead("gstin"), co("gstin")),
        "Created At": stamp(lead("createdAt")),
        "Updated At": stamp(lead("updatedAt")),
        "Contact Person": some(who("fullName")),
        "Designation": some(who("designation")),
        "Mobile": some(who("mobile"), lead("phoneSecondary")),
        "Address": some(lead("address")),
        "Country": some(lead("country"), co("country")),
        "Postal Code": some(lead("postalCode"), co("postalCode")),
        "LinkedIn": some(lead("linkedin")),
        "Sales Branch": branch,
    }
    values |= {c: F.lit(v) for c, v in fixed.items() if c not in values}
    rows = leads.withColumn("_p", primary(F.col("contacts")))
    none = F.lit(None).cast(leads.schema["contacts"].dataType.elementType)
    extras = F.coalesce(F.filter("contacts", lambda c: ~F.coalesce(c["isPrimary"], F.lit(False))), F.array().cast(leads.schema["contacts"].dataType))
    rows = rows.select(F.col("id").alias("leadId"), *(values[c].alias(c) for c in CRM_COLUMNS), F.posexplode(F.concat(F.array(none), extras)).alias("pos", "_x"))
    over = {"Email": "email", "Phone": "phone", "Contact Person": "fullName", "Designation": "designation", "Mobile": "mobile"}
    shown = [F.when(F.col("pos") > 0, F.coalesce(F.col("_x")[over[c]], F.lit(""))).otherwise(F.col(c)).alias(c) if c in over else F.col(c) for c in CRM_COLUMNS]
    return rows.select("leadId", "pos", *shown)


def file_name(fmt: str, at: datetime, prefix: str = "leads") -> str:
    """A name that no other export has."""
    return f"{prefix}_{at.strftime('%Y-%m-%dT%H-%M-%S')}-{at.microsecond // 1000:03d}Z.{fmt.lower()}"


def write(rows: DataFrame, fmt: str, folder: str, at: datetime, most: int = SHEET_ROWS - 1) -> str:
    """Writes the rows in order to a new path below ``folder``, never over an old one, and returns it: one CSV, JSON or XLSX file or, where the rows make more than one part, a folder of numbered ones, each whole in itself. Tasks write the files (``sources.exports``)."""
    return f"{folder.rstrip('/')}/{write_counted(rows, fmt, folder, at, most)['path']}"


def write_counted(rows: DataFrame, fmt: str, folder: str, at: datetime, most: int = SHEET_ROWS - 1) -> dict:
    """As ``write``, but returns what was written: path, number of rows, files."""
    name, kind = file_name(fmt, at).rsplit(".", 1)
    return save(rows.orderBy("leadId", "pos").select(CRM_COLUMNS), folder, name, kind, most)


def write_logged(rows: DataFrame, fmt: str, folder: str, filters: str, user_id: str, at: datetime) -> tuple[str, DataFrame]:
    """Writes the rows and gives the path and the row for the table of exports; the rows are read once, the writer counts them."""
    done = write_counted(rows, fmt, folder, at)
    path = f"{folder.rstrip('/')}/{done['path']}"
    return path, ledger_row(rows, fmt, path, filters, user_id, at, done["rows"])


def ledger_row(rows: DataFrame, fmt: str, path: str, filters: str, user_id: str, at: datetime, written: int | None = None) -> DataFrame:
    """The row for the table of exports; ``leadCount`` is the number of rows written, counted only where it isn't given."""
    counted = rows.agg(F.count("*").cast("int").alias("leadCount")) if written is None else rows.sparkSession.range(1).select(F.lit(written).cast("int").alias("leadCount"))
    return counted.select(F.sha2(F.lit(path), 256).alias("id"), F.lit(fmt).alias("format"), F.lit(path).alias("storedPath"), "leadCount", F.lit(filters).alias("filters"), F.lit(user_id).alias("createdById"), F.lit(at).cast("timestamp_ntz").alias("createdAt"))
