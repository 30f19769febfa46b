"""Entities of a card's raw text, as column expressions (no Python per row).

Steps are separate ``select``s, so that shared parts (lines, e-mails, phones) are
made once a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BOUND, NOT_WS, WS, any_word, cleaned, contains_any, digits, extracted, first_case, first_filled, let, trimmed, where_likely
from .values import ADDRESS_WORDS, COMPANY_WORDS, DEPARTMENTS, DESIGNATIONS, INDUSTRIES

# Patterns of fields.
EMAIL = rf"{BOUND}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{BOUND}"
EMAIL_INSIDE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
GSTIN = rf"{BOUND}[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][A-Z0-9]Z[A-Z0-9]{BOUND}"
URL = rf"(?i){BOUND}(?:https?://)?(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/{NOT_WS}*)?{BOUND}"
_GAP = WS.replace("]", "-]")
_DIGIT_GAP = WS.replace("]", "0-9-]")
PHONE = rf"(?:(?:\+|00)[0-9]{{1,3}}{_GAP}?)?(?:\([0-9]{{1,4}}\){_GAP}?)?[0-9](?:{_DIGIT_GAP}{{6,14}}[0-9])"
POSTAL = rf"{BOUND}[0-9]{{6}}{BOUND}"
POSTAL_LOOSE = rf"{BOUND}[0-9]{{5,6}}{BOUND}"
SOCIAL = {
    "linkedin": rf"(?i)((?:https?://)?(?:www\.)?linkedin\.com/{NOT_WS}+|in/[A-Za-z0-9-]+)",
    "twitter": rf"(?i)((?:https?://)?(?:www\.)?(?:twitter|x)\.com/{NOT_WS}+|@[A-Za-z0-9_]{{2,}})",
    "facebook": rf"(?i)((?:https?://)?(?:www\.)?facebook\.com/{NOT_WS}+)",
    "instagram": rf"(?i)((?:https?://)?(?:www\.)?instagram\.com/{NOT_WS}+)",
    "youtube": rf"(?i)((?:https?://)?(?:www\.)?youtube\.com/{NOT_WS}+)",
    "whatsapp": rf"(?i)(?:whatsapp|wa\.me){WS.replace(']', ':/]')}*([+0-9]{_DIGIT_GAP}{{7,}})",
}
CONTACT = "struct<fullName:string,designation:string,department:string,email:string,mobile:string,phone:string,isPrimary:boolean>"


def emails(text: Column) -> Column:
    """All addresses in lower case, each once, in order."""
    return F.array_distinct(F.transform(where_likely(text, "@", F.regexp_extract_all(text, F.lit(EMAIL), 0)), F.lower))


def phones(text: Column) -> Column:
    """All numbers of at least eight digits, each once, in order; one whose digits another number has within its own goes (and so do two spellings of one)."""
    found = F.transform(where_likely(text, "[0-9]", F.regexp_extract_all(text, F.lit(PHONE), 0)), trimmed)
    found = F.array_distinct(F.filter(found, lambda p: F.length(F.regexp_replace(p, "[^0-9+]", "")) >= 8))
    return F.filter(found, lambda p: ~F.exists(found, lambda o: (o != p) & digits(o).contains(digits(p))))


def urls(text: Column, emails: Column) -> Column:
    """All web addresses that are neither e-mails nor part of a mailbox name."""
    boxes = F.transform(emails, lambda e: F.substring_index(e, "@", 1))
    found = F.filter(where_likely(text, r"[A-Za-z0-9-]\.[A-Za-z0-9-]", F.regexp_extract_all(text, F.lit(URL), 0)), lambda u: ~u.contains("@"))
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", "")
    return F.filter(found, lambda u: ~F.exists(boxes, lambda b: b.contains(bare(u))))


def gstin(text: Column) -> Column:
    return F.when(text.rlike("[0-9]{4}"), extracted(F.upper(text), GSTIN))


def social(text: Column, kind: str) -> Column:
    hint = "[0-9]{2}" if kind == "whatsapp" else "[/@]"
    return F.when(text.rlike(hint), extracted(text, SOCIAL[kind], 1))


def website(urls: Column, socials: Column) -> Column:
    """The first web address that no social link holds."""
    return F.get(F.filter(urls, lambda u: ~F.exists(socials, lambda s: s.contains(u))), F.lit(0))


def lines(text: Column) -> Column:
    """The lines that aren't blank, cleaned. A text whose only white space is single spaces inside lines has nothing to clean."""
    odd = text.rlike(r"[^\n -~]") & text.rlike(rf"[^\n -~](?<={WS})")
    loose = text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.startswith(" ") | text.endswith(" ")
    parts = F.when(odd | loose, F.transform(F.split(text, "\r?\n"), cleaned)).otherwise(F.split(text, "\n"))
    return F.filter(parts, lambda x: x != "")


def company(lines: Column) -> Column:
    """The first line with a company word, else the longest of the first four that is in capitals."""
    named = F.filter(lines, lambda x: F.lower(x).rlike(any_word(COMPANY_WORDS)))
    sized = F.transform(F.slice(lines, 1, 4), lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("at"), x.alias("line")))
    capitals = F.filter(sized, lambda x: (x["line"] == F.upper(x["line"])) & (x["size"] < -3))
    return F.coalesce(F.get(named, F.lit(0)), F.array_min(capitals)["line"])


def is_name(line: Column) -> Column:
    """Two to four capitalised words, with no company or title word anywhere inside."""
    inside = "|".join(re.escape(w) for w in COMPANY_WORDS + DESIGNATIONS)
    return line.rlike(r"^[A-Z][a-zA-Z.'-]*(?: [A-Z][a-zA-Z.'-]*){1,3}$") & ~F.lower(line).rlike(inside)


def designation(line: Column) -> Column:
    """The whole line if it has a title word."""
    return F.when(F.lower(line).rlike(any_word(DESIGNATIONS)), cleaned(line))


def department(line: Column) -> Column:
    return first_case((F.lower(line).rlike(any_word([d])), F.lit(d)) for d in DEPARTMENTS)


def industry(text: Column) -> Column:
    """The first industry one of whose words occurs anywhere."""
    return let(F.lower(text), _industry)


def _industry(low: Column) -> Column:
    cases = []
    for name, words in INDUSTRIES.items():
        # A word that holds another one of its industry says nothing more.
        cases.append((contains_any(low, [w for w in words if not any(o != w and o in w for o in words)]), F.lit(name)))
    return first_case(cases)


def address(lines: Column) -> Column:
    """Lines with a postal code or an address word that are neither phone nor e-mail lines, joined; null if none."""
    phone_line = lambda x: (F.length(digits(x)) >= 8) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) <= 3)
    kept = F.filter(lines, lambda x: ((x.rlike("[0-9]{6}") & x.rlike(POSTAL)) | x.rlike("(?i)" + any_word(ADDRESS_WORDS))) & ~phone_line(x) & ~x.rlike(EMAIL_INSIDE))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def postal_code(address: Column) -> Column:
    return F.coalesce(extracted(address, POSTAL), extracted(address, POSTAL_LOOSE))


def contacts(lines: Column, emails: Column, phones: Column) -> Column:
    """One contact a name line, the title and department from the line below; e-mails and phones by position. Without a name line, one nameless contact."""
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("next")))
    people = F.filter(numbered, lambda x: is_name(x["line"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.lit("").alias("next")))
    people = F.when(F.size(people) > 0, people).otherwise(none)

    def made(x: Column, i: Column) -> Column:
        first = i == 0
        return F.struct(
            x["line"].alias("fullName"),
            designation(x["next"]).alias("designation"),
            department(x["next"]).alias("department"),
            F.get(emails, i).alias("email"),
            F.get(phones, F.when(first, 0).otherwise(i + 1)).alias("mobile"),
            F.when(first, F.get(phones, F.lit(1))).alias("phone"),
            first.alias("isPrimary"),
        )

    return F.transform(people, made).cast(f"array<{CONTACT}>")


def extract_entities(cards: DataFrame, text_col: str = "rawText") -> DataFrame:
    """``cards`` with the lead's fields and ``contacts``; a null text is an empty one."""
    have = [F.col(c) for c in cards.columns]
    now = cards.select(*have, F.coalesce(text_col, F.lit("")).alias("_t"))
    now = now.select(*have, "_t", F.lower("_t").alias("_low"), lines(F.col("_t")).alias("_lines"), emails(F.col("_t")).alias("_emails"), phones(F.col("_t")).alias("_phones"), *(social(F.col("_t"), k).alias(k) for k in SOCIAL))
    now = now.select("*", urls(F.col("_t"), F.col("_emails")).alias("_urls"), F.array_compact(F.array(*SOCIAL)).alias("_socials"), address(F.col("_lines")).alias("address"))
    none = F.lit(None).cast("string")
    return now.select(
        *have,
        company(F.col("_lines")).alias("companyName"),
        website(F.col("_urls"), F.col("_socials")).alias("website"),
        F.get("_emails", F.lit(0)).alias("email"),
        F.get("_phones", F.lit(0)).alias("phonePrimary"),
        F.get("_phones", F.lit(1)).alias("phoneSecondary"),
        "address",
        postal_code(F.col("address")).alias("postalCode"),
        gstin(F.col("_t")).alias("gstin"),
        _industry(F.col("_low")).alias("industry"),
        *SOCIAL,
        none.alias("city"),
        none.alias("state"),
        none.alias("country"),
        contacts(F.col("_lines"), F.col("_emails"), F.col("_phones")).alias("contacts"),
        F.size("_lines").alias("lineCount"),
    )


def primary(contacts: Column) -> Column:
    """The first primary contact, else the first."""
    return F.coalesce(F.get(F.filter(contacts, lambda c: c["isPrimary"]), F.lit(0)), F.get(contacts, F.lit(0)))


VISION_CARD = "struct<company:string,website:string,gstin:string,address:string,city:string,state:string,country:string,postalCode:string,linkedin:string,industry:string,contacts:array<struct<name:string,designation:string,email:string,phone:string,mobile:string,isPrimary:boolean>>,confidence:double>"


def entities_of_card(cards: DataFrame, card_col: str = "card") -> DataFrame:
    """The same fields from a structured card of a vision model, with ``aiConfidence`` from its 0 to 100."""
    card = F.col(card_col)
    given = F.when(F.size(card["contacts"]) > 0, card["contacts"]).otherwise(F.from_json(F.lit('[{"isPrimary": true}]'), "array<struct<name:string,designation:string,email:string,phone:string,mobile:string,isPrimary:boolean>>"))
    have = [c for c in cards.columns if c != card_col]
    now = cards.select(*have, card.alias("_card"), given.alias("_given"))
    now = now.select(*have, "_card", "_given", primary(F.col("_given")).alias("_first"))
    filled = lambda name: first_filled(F.col("_card")[name])
    any_email = F.get(F.filter(F.transform("_given", lambda c: c["email"]), lambda e: e != ""), F.lit(0))
    none = F.lit(None).cast("string")
    people = F.transform(
        "_given",
        lambda c: F.struct(
            first_filled(c["name"]).alias("fullName"),
            first_filled(c["designation"]).alias("designation"),
            none.alias("department"),
            first_filled(c["email"]).alias("email"),
            first_filled(c["mobile"]).alias("mobile"),
            first_filled(c["phone"]).alias("phone"),
            F.coalesce(c["isPrimary"], F.lit(False)).alias("isPrimary"),
        ),
    )
    return now.select(
        *have,
        filled("company").alias("companyName"),
        filled("website").alias("website"),
        first_filled(F.col("_first")["email"], any_email).alias("email"),
        first_filled(F.col("_first")["mobile"], F.col("_first")["phone"]).alias("phonePrimary"),
        none.alias("phoneSecondary"),
        filled("address").alias("address"),
        filled("postalCode").alias("postalCode"),
        filled("gstin").alias("gstin"),
        filled("industry").alias("industry"),
        filled("linkedin").alias("linkedin"),
        *(none.alias(k) for k in SOCIAL if k != "linkedin"),
        filled("city").alias("city"),
        filled("state").alias("state"),
        filled("country").alias("country"),
        people.cast(f"array<{CONTACT}>").alias("contacts"),
        F.when(F.col("_card")["confidence"].isNotNull(), F.least(F.col("_card")["confidence"] / 100, F.lit(1.0))).alias("aiConfidence"),
    )
