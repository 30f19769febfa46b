"""Lists, filters and changes of leads. A change is a function from the old table to the new one; tables are never changed in place."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..functions.values import EDITABLE, ROLES, UPLOAD_STATUSES

PAGE, MOST = 50, 200


def contains_text(columns: list[str], query: str) -> Column:
    """Whether one of the columns holds the text, whatever its case; the text is taken literally."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return out


def status_filter(status: str | None) -> Column:
    """The export's status names: all but rejected without one."""
    if not status or status.lower() == "all":
        return F.col("status") != "REJECTED"
    return F.col("status") == ("PENDING_REVIEW" if status == "Extracted" else status.upper())


def between(column: str, start: str | None = None, end: str | None = None) -> Column:
    """Bounds in ISO form; an end without a time takes in its whole day."""
    out = F.lit(True)
    if start:
        out = out & (F.col(column) >= F.lit(datetime.fromisoformat(start)).cast("timestamp_ntz"))
    if end:
        last = datetime.combine(date.fromisoformat(end), time(23, 59, 59, 999000)) if len(end) == 10 else datetime.fromisoformat(end)
        out = out & (F.col(column) <= F.lit(last).cast("timestamp_ntz"))
    return out


def page(df: DataFrame, order: list[Column], skip: int = 0, take: int = PAGE) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(min(take, MOST))


def after(order: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come after ``last`` in an order of (column, falling): where a page begins, without counting what is before it. Columns are never null."""
    out, same = F.lit(False), F.lit(True)
    for c, falling in order:
        out = out | (same & (F.col(c) < F.lit(last[c]) if falling else F.col(c) > F.lit(last[c])))
        same = same & (F.col(c) == F.lit(last[c]))
    return out


def page_with_total(df: DataFrame, order: list[tuple[str, bool]], take: int = PAGE, last: dict | None = None) -> tuple[DataFrame, int]:
    """A page of ``df`` and how many rows there are altogether, from one pass; ``last`` is the last row of the page before.

    The rows are counted while the first ones are picked, so nothing is read twice, and a later page costs what the first does.
    """
    seen = Observation()
    whole = df.observe(seen, F.count(F.lit(1)).alias("total"))
    rows = whole if last is None else whole.where(after(order, last))
    keys = [F.desc(c) if falling else F.asc(c) for c, falling in order]
    held = rows.orderBy(*keys).limit(min(take, MOST)).toArrow()  # MOST rows at most
    return df.sparkSession.createDataFrame(held), seen.get["total"]


def visible(leads: DataFrame, cards: DataFrame, uploads: DataFrame, user_id, role: str) -> DataFrame:
    """What a user may see: all leads for an administrator, else those whose card they uploaded."""
    if role == "ADMIN":
        return leads
    mine = uploads.where(F.col("uploadedById") == user_id).select(F.col("id").alias("uploadId"))
    return leads.join(cards.join(mine, "uploadId", "left_semi").select(F.col("id").alias("cardId")), "cardId", "left_semi")


def first_of(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def uploads_without_leads(uploads: DataFrame, cards: DataFrame, leads: DataFrame) -> DataFrame:
    """Uploads with a card that has no lead."""
    bare = cards.join(leads.select(F.col("cardId").alias("id")), "id", "left_anti").select(F.col("uploadId").alias("id"))
    return uploads.join(bare, "id", "left_semi")


def with_contacts(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """``leads`` with their contacts as an array, oldest first."""
    rest = [c for c in contacts.columns if c not in ("leadId", "createdAt", "id")]
    held = contacts.groupBy(F.col("leadId").alias("id")).agg(F.array_sort(F.collect_list(F.struct("createdAt", F.col("id").alias("contactId"), *rest))).alias("contacts"))
    return leads.join(held, "id", "left")


def with_company(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """``leads`` with their company as a struct, null where there is none."""
    return leads.join(companies.select(F.col("id").alias("companyId"), F.struct(*companies.columns).alias("company")), "companyId", "left")


def with_result(cards: DataFrame, results: DataFrame) -> DataFrame:
    """``cards`` with what was read on them as a struct ``ocrResult`` (one a card at most), null where nothing was."""
    return cards.join(results.select(F.col("cardId").alias("id"), F.struct(*results.columns).alias("ocrResult")), "id", "left")


def with_card(leads: DataFrame, cards: DataFrame, results: DataFrame) -> DataFrame:
    """``leads`` with their card as a struct, which holds its ``ocrResult``."""
    full = with_result(cards, results)
    return leads.join(full.select(F.col("id").alias("cardId"), F.struct(*full.columns).alias("card")), "cardId", "left")


def with_cards(uploads: DataFrame, cards: DataFrame, results: DataFrame, leads: DataFrame) -> DataFrame:
    """``uploads`` with their cards as an array by id, each with its ``ocrResult`` and its ``lead`` (one a card at most); empty without cards."""
    full = with_result(cards, results).join(leads.select(F.col("cardId").alias("id"), F.struct(*leads.columns).alias("lead")), "id", "left")
    held = full.groupBy(F.col("uploadId").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*full.columns))).alias("cards"))
    joined = uploads.join(held, "id", "left")
    return joined.withColumn("cards", F.coalesce("cards", F.array().cast(joined.schema["cards"].dataType)))


def trash_list(leads: DataFrame, cards: DataFrame, uploads: DataFrame, user_id, role: str) -> DataFrame:
    """The leads in the trash that a user may see, the latest first, as many as a list holds at most."""
    return page(visible(leads, cards, uploads, user_id, role).where(F.col("deletedAt").isNotNull()), [F.desc("deletedAt"), F.col("id")], take=MOST)


def set_where(df: DataFrame, test: Column, **values: Column) -> DataFrame:
    """``df`` with new values in the rows that meet the test."""
    return df.withColumns({k: F.when(test, v).otherwise(F.col(k)) for k, v in values.items()})


def approve(leads: DataFrame, ids: list, user_id, as_of: datetime) -> DataFrame:
    return set_where(leads, F.col("id").isin(ids), status=F.lit("APPROVED"), reviewedById=F.lit(user_id), reviewedAt=F.lit(as_of).cast("timestamp_ntz"))


def reject(leads: DataFrame, ids: list, user_id, as_of: datetime) -> DataFrame:
    return set_where(leads, F.col("id").isin(ids), status=F.lit("REJECTED"), reviewedById=F.lit(user_id), reviewedAt=F.lit(as_of).cast("timestamp_ntz"))


def trash(leads: DataFrame, ids: list, as_of: datetime) -> DataFrame:
    return set_where(leads, F.col("id").isin(ids), deletedAt=F.lit(as_of).cast("timestamp_ntz"))


def restore(leads: DataFrame, ids: list) -> DataFrame:
    return set_where(leads, F.col("id").isin(ids), deletedAt=F.lit(None).cast("timestamp_ntz"))


def edit(leads: DataFrame, lead_id, changes: dict) -> DataFrame:
    """New values of editable fields of one lead; other fields are passed over."""
    here = F.col("id") == lead_id
    return leads.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items() if k in EDITABLE})


def set_upload(uploads: DataFrame, ids: list, status: str, error: str | None = None) -> DataFrame:
    """Uploads in another state; the error of a former state goes."""
    if status not in UPLOAD_STATUSES:
        raise ValueError(f"Unknown status of an upload: {status}")
    return set_where(uploads, F.col("id").isin(ids), status=F.lit(status), error=F.lit(error).cast("string"))


def recover_stuck(uploads: DataFrame) -> DataFrame:
    """Uploads that a stopped worker left half done wait again, without an error."""
    return set_where(uploads, F.col("status").isin("DETECTING", "EXTRACTING"), error=F.lit(None).cast("string"), status=F.lit("PENDING"))


def edit_user(users: DataFrame, user_id, by_id, role: str | None = None, is_active: bool | None = None) -> DataFrame:
    """A user's role and whether they are active, where given. Nobody takes their own administrator's rights away."""
    role = role if role in ROLES else None
    if role is None and is_active is None:
        raise ValueError("Nothing to update (isActive or role)")
    if user_id == by_id and (is_active is False or role not in (None, "ADMIN")):
        raise ValueError("You cannot deactivate or demote your own admin account")
    given = {"role": role, "isActive": is_active}
    return set_where(users, F.col("id") == user_id, **{k: F.lit(v) for k, v in given.items() if v is not None})


def replace_children(children: DataFrame, key: str, parent_id, new: DataFrame) -> DataFrame:
    """All children of one parent replaced."""
    return children.where(~F.col(key).eqNullSafe(F.lit(parent_id))).unionByName(new)


def delete_cascade(tables: dict[str, DataFrame], root: str, test: Column, links: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Rows of ``root`` that meet the test, and all that hang on them, left out. ``links``: child -> (parent, column)."""
    gone = {root: tables[root].where(test).select("id")}
    out = tables | {root: tables[root].join(gone[root], "id", "left_anti")}
    for child, (parent, column) in links.items():
        if parent in gone:
            held = gone[parent].select(F.col("id").alias(column))
            if "id" in tables[child].columns:
                more = tables[child].join(held, column, "left_semi").select("id")
                gone[child] = gone[child].unionByName(more) if child in gone else more
            out[child] = out[child].join(held, column, "left_anti")
    return out


def purge_test(as_of: datetime, days: int = 30) -> Column:
    """Deleted more than so many days ago."""
    return F.col("deletedAt") < F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), fill_blank: bool = True) -> DataFrame:
    """``old`` with ``new`` by key: new values win where they are given (blank ones don't if ``fill_blank``), but columns in ``keep`` stay as they are in rows that exist."""
    rest = [c for c in old.columns if c not in keys]
    given = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in rest if c in new.columns), F.lit(True).alias("__new"))
    joined = old.withColumn("__old", F.lit(True)).join(given, keys, "full_outer")

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        value = F.col(f"__{c}")
        if fill_blank and dict(old.dtypes)[c] == "string":
            value = blank_to_null(value)
        return F.when(F.col("__old").isNotNull(), F.col(c)).otherwise(value) if c in keep else F.coalesce(value, c)

    return joined.select(*(F.col(c) if c in keys else merged(c).alias(c) for c in old.columns))
