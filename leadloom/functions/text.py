"""Text helpers: blanks, white space and word bounds as the leads' rules mean them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. White space: ASCII and the Unicode spaces; a word is made of ASCII letters, digits and underscores.
WS = r"[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = WS.replace("[", "[^", 1)
BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for an empty string."""
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*map(blank_to_null, cols))


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def cleaned(c: Column | str) -> Column:
    """One space for each run of white space, none at the ends."""
    return trimmed(F.regexp_replace(_col(c), f"{WS}+", " "))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def extracted(c: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return blank_to_null(F.regexp_extract(_col(c), pattern, group))


def any_of(words: Iterable[str]) -> str:
    """A pattern for one of the words anywhere; those that begin alike are tried together."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(re.escape(w[1:]))
    return "(?:" + "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


def any_word(words: Iterable[str]) -> str:
    """A pattern for one of the words (each begins with a letter, a digit or an underscore) between word bounds."""
    by: dict[bool, list[str]] = {True: [], False: []}
    for w in words:
        by[bool(re.search(r"\w$", w, re.ASCII))].append(w)
    # Beside a letter or digit a bound means that none follows; beside another sign, that one does.
    ends = [any_of(by[k]) + end for k, end in ((True, "(?![A-Za-z0-9_])"), (False, "(?=[A-Za-z0-9_])")) if by[k]]
    return f"(?<![A-Za-z0-9_])(?:{'|'.join(ends)})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_likely(text: Column, hint: str, found: Column) -> Column:
    """``found`` (an array) for texts that have the hint, which a pattern's matches all need; none for others."""
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<string>"))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_case(cases: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if out is not None else F.lit(None)


def ratio_pct(part: Column, total: Column, places: int = 1) -> Column:
    """100 * part / total, rounded half up; 0 without a total."""
    return F.when(total > 0, F.round(100.0 * part / total, places)).otherwise(F.lit(0.0))
