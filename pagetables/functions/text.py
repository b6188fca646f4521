"""Scalar text functions: small Column expressions shared by all extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions.fixed import DATE_FORMATS, INFO_CHARS

SPACES = " \t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Also the way to bring a computed column into a lambda: a column named there only once
    may be replaced by its expression, which would then run for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build a large expression once per JVM. It names its columns, so it can be used in
    any plan; only the many calls that put it together are saved."""
    kept: dict = {}

    @wraps(build)
    def get(*options) -> Column:
        gateway = SparkContext._gateway
        if options not in kept or kept[options][0] is not gateway:
            kept[options] = gateway, build(*options)
        return kept[options][1]

    return get


def no_text() -> Column:
    return F.lit(None).cast("string")


def nonblank(c: Column) -> Column:
    """NULL instead of ''; ``c`` is evaluated once."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def contains_any(c: Column, words: Iterable[str], whole_word: bool = False) -> Column:
    """One of the words occurs in ``c``, anywhere or as a whole word."""
    pattern = "|".join(re.escape(w) for w in words)
    return c.rlike(rf"(?U)\b(?:{pattern})\b" if whole_word else pattern)


def is_letters(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def numeric_text(c: Column) -> Column:
    """Digits only once ',' and '.' are removed."""
    return F.translate(c, ",.", "").rlike("^[0-9]+$")


def integer(c: Column) -> Column:
    """Comma-free integer, NULL where the text is none."""
    return F.regexp_replace(c, ",", "").try_cast("int")


def find(c: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """First match of ``pattern``, NULL if none; \\s \\d \\b as for Unicode text."""
    return nonblank(F.regexp_extract(c, _unicode(pattern, ignore_case), group))


def find_all(c: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(c, F.lit(_unicode(pattern, ignore_case)), F.lit(group))


def _unicode(pattern: str, ignore_case: bool) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def first_match(current: Column, text: Column, patterns: list[str], group: int = 1,
                ignore_case: bool = True, prefix: str = "") -> Column:
    """``current`` if set, else the first pattern that matches; later patterns
    are not evaluated once one has matched."""
    hits = [strip(find(text, p, group, ignore_case)) for p in patterns]
    if prefix:
        hits = [F.concat(F.lit(prefix), h) for h in hits]
    return F.coalesce(current, *hits)


def clean_text(c: Column) -> Column:
    """Collapse white space, drop ':', '-' and space at both ends, '$ 5' to '$5'."""
    one_line = F.regexp_replace(c, r"(?U)\s+", " ")
    bare = F.regexp_replace(one_line, r"^[:\- ]+|[:\- ]+$", "")
    return F.regexp_replace(bare, r"\$ *([0-9])", r"\$$1")


def extraction_date(ts) -> Column:
    ts = ts if isinstance(ts, Column) else F.lit(ts)
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def truncate_info(c: Column) -> Column:
    return F.substring(c, 1, INFO_CHARS)


def yes_no(c: Column) -> Column:
    return let(F.upper(c), lambda up: (
        F.when(up.isin("YES", "Y", "HOMESTEAD EXEMPTION"), "Yes")
        .when(up.isin("NO", "N"), "No")
        .otherwise(up)))


def page_progress(page_no: Column, total: Column) -> Column:
    """Percent done with one decimal; NULL when the total is unknown or 0."""
    return F.round(page_no / F.when(total > 0, total) * 100, 1)


def money(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(18,2)")


def date_value(c: Column) -> Column:
    return F.coalesce(*[F.try_to_date(c, f) for f in DATE_FORMATS])


def flag(c: Column) -> Column:
    up = F.upper(c)
    return (F.when(up.isin("YES", "Y", "TRUE", "HOMESTEAD EXEMPTION"), True)
            .when(up.isin("NO", "N", "FALSE"), False))
