"""Text rules: ordered patterns that fill the fields of a record from its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions.fixed import (
    COMPACT_STREET_TOKENS, MAX_SQFT, MIN_SQFT, SALES_ADDRESSES, SALES_DATES, SALES_HOMESTEAD,
    SALES_OWNER_CAPS, SALES_OWNER_COMMA, SALES_OWNER_WORDS, SALES_PARCELS, SALES_PRICE,
    SALES_SQFT, SALES_TOWN_WORDS, SALES_TOWNS, STREET_TOKENS, STREET_TOKENS_SHORT,
    TEXT_OWNER_CITIES, WIDE_PATTERNS, WIDE_TOWN, WIDE_TOWN_TEXT,
)
from pagetables.functions.text import (
    contains_any, find, find_all, first_match, let, no_text, strip, yes_no,
)

# --- any table of rules --------------------------------------------------------------


def fill_from_patterns(df: DataFrame, text_col: str, rules) -> DataFrame:
    """Fill fields from a table of rules ``(field, priority, pattern, group, template)``.

    The first rule by priority that matches gives the value, put in place of '{}' in the
    template; a field already set stays as it is. One select, no shuffle.
    """
    by_field: dict[str, list] = {}
    for field, priority, pattern, group, template in rules:
        by_field.setdefault(field, []).append((priority, pattern, group, template))
    filled = {}
    for field, ranked in by_field.items():
        current = F.col(field) if field in df.columns else no_text()
        hits = []
        for _, pattern, group, template in sorted(ranked, key=lambda r: r[0]):
            hit = strip(find(F.col(text_col), pattern, group, ignore_case=True))
            before, _, after = (template or "{}").partition("{}")
            hits.append(F.concat(F.lit(before), hit, F.lit(after)) if before or after else hit)
        filled[field] = F.coalesce(F.when(current != "", current), *hits)
    return df.withColumns(filled)


# --- wide record -----------------------------------------------------------------------

def needs(text: Column, *words: str) -> Column:
    """The upper-case text holds one of the words without which no pattern can match; a
    cheap test that spares most texts the patterns. (Upper case also folds the long s.)"""
    up = F.upper(text)
    return reduce(Column.__or__, [F.contains(up, F.lit(w)) for w in words])


def _by_patterns(field: str, *words: str, prefix: str = ""):
    def rule(current: Column, text: Column) -> Column:
        hit = first_match(no_text(), text, WIDE_PATTERNS[field], prefix=prefix)
        return F.coalesce(current, F.when(needs(text, *words), hit) if words else hit)

    return rule


wide_property_address = _by_patterns("property_address")
wide_parcel_number = _by_patterns("parcel_number", "-", "PCN", "PARCEL")
wide_property_value = _by_patterns("property_value", "VALUE", prefix="$")
wide_acres = _by_patterns("acres", "AC")
wide_mail_city_state_zip = _by_patterns("mail_city_state_zip", ",")
wide_lot_size = _by_patterns("lot_size", "LOT", "LAND AREA")


def wide_municipality(current: Column, text: Column) -> Column:
    return F.coalesce(current, F.when(
        F.contains(F.lower(text), F.lit(WIDE_TOWN_TEXT)), WIDE_TOWN))


def wide_homesteaded(current: Column, text: Column) -> Column:
    return F.coalesce(current, F.when(needs(text, "HOMESTEAD"), yes_no(first_match(
        no_text(), text, WIDE_PATTERNS["homesteaded"]))))


WIDE_RULES = {
    "property_address": wide_property_address,
    "parcel_number": wide_parcel_number,
    "property_value": wide_property_value,
    "municipality": wide_municipality,
    "acres": wide_acres,
    "mail_city_state_zip": wide_mail_city_state_zip,
    "homesteaded": wide_homesteaded,
    "lot_size": wide_lot_size,
}

COMPACT_FIELDS = ["sale_price", "sale_date", "owner_name", "property_address", "municipality",
                  "square_footage", "mail_address", "mail_city_state_zip", "homesteaded"]


def parse_compact(text: Column) -> Column:
    """struct of COMPACT_FIELDS from a line ``$price date OWNER & number STREET TOWN sqft
    number STREET TOWN FL zip .. Y|N ..``; NULL if the line has another form."""
    line = strip(F.translate(text, "\u00a0", " "))
    maybe = line.rlike(r"^\$\S*\s+\d{4}-\d{2}-\d{2}") & F.contains(line, F.lit("&"))
    return F.when(maybe, let(F.split(line, r"(?U)\s+"), _compact))


def _first(tokens: Column, test) -> Column:
    """0-based index of the first token that passes, -1 if none."""
    return F.array_position(F.transform(tokens, test), True).cast("int") - 1


def _words(tokens: Column, start, n) -> Column:
    """``n`` tokens from 0-based ``start`` as text."""
    return F.array_join(_slice(tokens, start, n), " ")


def _slice(tokens: Column, start, n) -> Column:
    return F.slice(tokens, start + 1, F.greatest(n, F.lit(0)))


def _compact(tokens: Column) -> Column:
    """Cut the tokens at the '&', at both street words, at the area and at the state."""
    def street(t):
        return contains_any(F.upper(t), COMPACT_STREET_TOKENS)

    def rest(a, i):
        return F.slice(a, i + 2, F.size(a))

    def from_owner(amp):
        joined = F.substring_index(F.get(tokens, amp), "&", 1)
        owner = strip(F.when(F.get(tokens, amp) == "&", _words(tokens, F.lit(2), amp - 2)).otherwise(
            F.concat_ws(" ", _words(tokens, F.lit(2), amp - 2), joined)))
        return F.when(amp > 2, let(rest(tokens, amp), lambda t: from_address(owner, t)))

    def from_address(owner, t):
        return let(_first(t, street), lambda s: F.when(
            (s >= 0) & (F.size(t) - s - 1 >= 4),
            let(rest(t, s), lambda u: from_town(owner, _words(t, F.lit(0), s + 1), u))))

    def from_town(owner, address, u):
        return let(_first(u, lambda x: x.rlike("^[0-9]+$")), lambda q: F.when(
            q > 0, let(rest(u, q), lambda v: from_mail(
                owner, address, _words(u, F.lit(0), q), F.get(u, q), v))))

    def from_mail(owner, address, town, sqft, v):
        return let(_first(v, street), lambda s: F.when(
            (s >= 0) & (F.size(v) - s - 1 >= 4),
            let(rest(v, s), lambda w: from_state(
                owner, address, town, sqft, _words(v, F.lit(0), s + 1), w))))

    def from_state(owner, address, town, sqft, mail, w):
        return let(_first(w, lambda x: F.contains(F.upper(x), F.lit("FL"))), lambda f: F.when(
            (f >= 0) & (F.size(w) - f - 1 >= 3), F.struct(
                F.get(tokens, F.lit(0)).alias("sale_price"),
                F.get(tokens, F.lit(1)).alias("sale_date"),
                owner.alias("owner_name"),
                address.alias("property_address"),
                town.alias("municipality"),
                sqft.alias("square_footage"),
                mail.alias("mail_address"),
                _words(w, F.lit(0), f + 2).alias("mail_city_state_zip"),
                F.element_at(F.create_map(F.lit("Y"), F.lit("Yes"), F.lit("N"), F.lit("No")),
                             F.get(F.filter(F.slice(w, f + 3, F.size(w)),
                                            lambda x: x.isin("Y", "N")), F.lit(0)))
                .alias("homesteaded"))))

    return F.when(F.size(tokens) >= 10, let(
        _first(tokens, lambda t: F.contains(t, F.lit("&"))), from_owner))


def wide_record(mapped: Column, text: Column, fields: list[str]) -> Column:
    """struct of ``fields``: a compact line overrides everything it holds; otherwise the
    patterns fill what the columns left empty."""
    def record(compact):
        def value(f):
            current = mapped[f]
            by_rule = WIDE_RULES[f](current, text) if f in WIDE_RULES else current
            held = compact[f] if f in COMPACT_FIELDS else current
            return held if by_rule is current and held is current else (
                F.when(compact.isNotNull(), held).otherwise(by_rule))
        return F.struct(*[value(f).alias(f) for f in fields])

    return let(parse_compact(text), record)


# --- sales record ------------------------------------------------------------------------

SALES_TEXT_FIELDS = ["sale_price", "sale_date", "property_address", "owner_name",
                     "municipality", "square_footage", "parcel_number", "homesteaded"]


def has_digit(text: Column) -> Column:
    """A cheap test that spares most lines the patterns which need a digit."""
    return text.rlike(r"(?U)\d")


def sales_price(current: Column, text: Column) -> Column:
    return F.coalesce(current, F.when(
        F.contains(text, F.lit("$")), find(text, SALES_PRICE)))


def sales_date(current: Column, text: Column) -> Column:
    return F.coalesce(current, F.when(has_digit(text), first_match(
        no_text(), text, SALES_DATES, group=0, ignore_case=False)))


def sales_address(current: Column, text: Column) -> Column:
    return F.coalesce(current, F.when(has_digit(text), first_match(
        no_text(), text, SALES_ADDRESSES, group=0)))


def sales_owner(current: Column, text: Column, address: Column, town: Column,
                whole_word: bool = False) -> Column:
    """'Last, First'; else the first capitalised words that are neither street, town nor
    address; else a run of capitals that is no street."""
    def is_name(n):
        return (~contains_any(F.upper(n), STREET_TOKENS, whole_word)
                & ~contains_any(F.upper(n), TEXT_OWNER_CITIES)
                & ~n.eqNullSafe(address) & ~n.eqNullSafe(town) & (F.length(n) > 3))

    words = F.get(F.filter(find_all(text, SALES_OWNER_WORDS), is_name), F.lit(0))
    capitals = let(strip(find(text, SALES_OWNER_CAPS)), lambda c: F.when(
        (F.length(c) > 3) & ~contains_any(F.upper(c), STREET_TOKENS_SHORT, whole_word), c))
    return F.coalesce(current, strip(find(text, SALES_OWNER_COMMA)), words, capitals)


def sales_municipality(current: Column, text: Column, owner: Column, address: Column,
                       whole_word: bool = False) -> Column:
    """A known town, else the first run of words, that is no street, owner or address."""
    def is_town(m):
        return (~contains_any(F.upper(m), STREET_TOKENS_SHORT, whole_word)
                & ~m.eqNullSafe(owner) & ~m.eqNullSafe(address) & (F.length(m) > 2))

    hits = [F.get(F.filter(find_all(text, p, ignore_case=True), is_town), F.lit(0))
            for p in (SALES_TOWNS, SALES_TOWN_WORDS)]
    return F.coalesce(current, *hits)


def sales_square_footage(current: Column, text: Column) -> Column:
    in_range = F.filter(find_all(text, SALES_SQFT, 1),
                        lambda n: n.try_cast("int").between(MIN_SQFT, MAX_SQFT))
    return F.coalesce(current, F.when(has_digit(text), F.get(in_range, F.lit(0))))


def sales_parcel(current: Column, text: Column) -> Column:
    return first_match(current, text, SALES_PARCELS, group=0, ignore_case=False)


def sales_homestead(current: Column, text: Column) -> Column:
    return F.coalesce(current, find(text, SALES_HOMESTEAD, ignore_case=True))


def sales_record(current: Column, text: Column, whole_word: bool = False) -> Column:
    """struct of SALES_TEXT_FIELDS: fill what ``current`` lacks from one text. Owner looks
    at the address found and at the town so far, town looks at owner and address."""
    def with_address(address):
        owner = sales_owner(current["owner_name"], text, address, current["municipality"],
                            whole_word)
        return let(owner, lambda o: with_owner(address, o))

    def with_owner(address, owner):
        return F.struct(
            sales_price(current["sale_price"], text).alias("sale_price"),
            sales_date(current["sale_date"], text).alias("sale_date"),
            address.alias("property_address"),
            owner.alias("owner_name"),
            sales_municipality(current["municipality"], text, owner, address, whole_word)
            .alias("municipality"),
            sales_square_footage(current["square_footage"], text).alias("square_footage"),
            sales_parcel(current["parcel_number"], text).alias("parcel_number"),
            sales_homestead(current["homesteaded"], text).alias("homesteaded"))

    return let(sales_address(current["property_address"], text), with_address)


def empty_sales() -> Column:
    return F.struct(*[no_text().alias(f) for f in SALES_TEXT_FIELDS])


def fold_lines(lines: Column, whole_word: bool = False) -> Column:
    """One record from the lines of a page: applied in order, each fills what is empty."""
    return F.aggregate(lines, empty_sales(), lambda acc, x: sales_record(acc, x, whole_word))
