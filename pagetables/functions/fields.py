"""Header and cell rules: which cell of a row fills which field of a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions.fixed import (
    CELL_OWNER_CITIES, CELL_TOWN_CITIES, FIELD_KEYWORDS, MAX_SQFT, MIN_SQFT, MONTHS,
    STREET_TOKENS, STREET_TOKENS_SHORT,
)
from pagetables.functions.text import (
    contains_any, integer, is_letters, let, no_text, nonblank, numeric_text,
)

MAPPED_FIELDS = [field for field, _ in FIELD_KEYWORDS]
HEADED_FIELDS = ["sale_price", "sale_date", "owner_name", "property_address", "municipality",
                 "square_footage", "mail_address", "mail_city_state_zip", "homesteaded",
                 "parcel_number"]


def case(*branches: tuple[Column, object]) -> Column:
    """CASE WHEN over (condition, value) pairs, NULL if none holds."""
    (first, value), *rest = branches
    return reduce(lambda acc, b: acc.when(*b), rest, F.when(first, value))


# --- wide record: keyword table --------------------------------------------------

def field_of_header(header: Column, keywords=FIELD_KEYWORDS) -> Column:
    """The first field with a keyword contained in the lower-case header."""
    return case(*[(contains_any(header, words), field) for field, words in keywords])


def fields_of_headers(headers: Column, keywords=FIELD_KEYWORDS) -> Column:
    return F.transform(headers, lambda h: field_of_header(h, keywords))


def last_cell_of(fields: Column, texts: Column, field: str) -> Column:
    """Text of the last cell whose column has the given field. Both arrays run from
    last to first and have the same length."""
    at = F.array_position(fields, field)
    return F.when(at > 0, F.get(texts, at.cast("int") - 1))


def assign_mapped(fields: Column, texts: Column, wanted=MAPPED_FIELDS) -> Column:
    """struct of the mapped fields of a row. Cells beyond the headers are ignored; of
    several columns with one field the last cell wins, even if it is blank."""
    n = F.least(F.size(fields), F.size(texts))
    return let(F.reverse(F.slice(fields, 1, n)), lambda f: let(
        F.reverse(F.slice(texts, 1, n)), lambda t: F.struct(
            *[nonblank(last_cell_of(f, t, name)).alias(name) for name in wanted])))


# --- sales record: header and value ------------------------------------------------

def header_roles(headers: Column) -> Column:
    """Per header: may it hold a price, may it hold a date, and else which field."""
    def role(h):
        return F.struct(
            contains_any(h, ["sale", "price"]).alias("price"),
            contains_any(h, ["sale", "date"]).alias("date"),
            case((contains_any(h, ["owner", "name", "taxpayer"]), "owner_name"),
                 (contains_any(h, ["address", "location", "property"]), "property_address"),
                 (contains_any(h, ["municipality", "city"]), "municipality"),
                 (contains_any(h, ["sq", "sqft", "footage"]), "square_footage"),
                 (contains_any(h, ["mail", "mailing"]) & F.contains(h, F.lit("address")),
                  "mail_address"),
                 (F.contains(h, F.lit("mail")) & contains_any(h, ["city", "state", "zip"]),
                  "mail_city_state_zip"),
                 (F.contains(h, F.lit("homestead")), "homesteaded"),
                 (contains_any(h, ["parcel", "account"]), "parcel_number")).alias("other"))

    return F.transform(headers, role)


def assign_by_header_and_value(roles: Column, texts: Column) -> Column:
    """struct of HEADED_FIELDS: the role of the header together with the cell text picks
    the field; blanks are skipped, the last cell of a field wins."""
    n = F.least(F.size(roles), F.size(texts))

    def field(role, text):
        return case(
            (text == "", no_text()),
            (role["price"] & F.contains(text, F.lit("$")), "sale_price"),
            (role["date"] & contains_any(text, ["/", "-"]), "sale_date"),
            (F.lit(True), role["other"]))

    assigned = F.zip_with(F.slice(roles, 1, n), F.slice(texts, 1, n), field)
    return let(F.reverse(assigned), lambda f: let(
        F.reverse(F.slice(texts, 1, n)), lambda t: F.struct(
            *[last_cell_of(f, t, name).alias(name) for name in HEADED_FIELDS])))


def is_street(text: Column, whole_word: bool = False) -> Column:
    """Contains a street token anywhere, also inside a word unless ``whole_word``."""
    return contains_any(F.upper(text), STREET_TOKENS, whole_word)


def assign_by_position(texts: Column, whole_word: bool = False) -> Column:
    """struct of HEADED_FIELDS for a table without headings: columns 0-5, each guarded
    by what its text looks like."""
    def cell(i):
        return nonblank(F.get(texts, F.lit(i)))

    def has_dollar(x):
        return F.contains(x, F.lit("$"))

    dated = contains_any(cell(1), ["/", "-"]) | contains_any(F.lower(cell(1)), MONTHS)
    numeric_name = F.translate(cell(2), " ,.", "").rlike("^[0-9]+$")
    given = {
        "sale_price": case((has_dollar(cell(0)), cell(0)), (~dated & has_dollar(cell(1)), cell(1))),
        "parcel_number": F.when(~has_dollar(cell(0)) & cell(0).rlike("[0-9]"), cell(0)),
        "sale_date": F.when(dated, cell(1)),
        "owner_name": F.when((F.length(cell(2)) > 3) & ~numeric_name 
                             & ~is_street(cell(2), whole_word), cell(2)),
        "property_address": F.when(is_street(cell(3), whole_word), cell(3)),
        "municipality": F.when((F.length(cell(4)) > 2)
                               & is_letters(F.translate(cell(4), " ", "")), cell(4)),
        "square_footage": F.when(numeric_text(cell(5)), cell(5)),
    }
    return F.struct(*[given.get(name, no_text()).alias(name) for name in HEADED_FIELDS])


# --- sales record: fill what is missing from the cells ------------------------------

FILLED_FIELDS = ["sale_price", "owner_name", "property_address", "municipality",
                 "square_footage"]


def looks_like_name(text: Column) -> Column:
    """All words are letters (',' and '.' aside) and one starts with a capital."""
    return F.forall(F.split(text, r"\s+"), lambda w: is_letters(F.translate(w, ",.", ""))) & (
        text.rlike(r"(?:^|\s)\p{Lu}"))


def fill_from_cells(record: Column, texts: Column, whole_word: bool = False) -> Column:
    """Fill missing fields in one pass over the cells, left to right; a cell takes at
    most one role, and a cell that could be an owner is used up even if it is no name.
    Street tokens count inside words, too, unless ``whole_word``."""
    names = HEADED_FIELDS

    def role(acc, x, up):
        numeric = numeric_text(x)
        sqft = integer(x)
        street = contains_any(up, STREET_TOKENS, whole_word)
        return case(
            (x == "", no_text()),
            (F.contains(x, F.lit("$")) & acc["sale_price"].isNull(), "sale_price"),
            (acc["owner_name"].isNull() & (F.length(x) > 3) & ~F.contains(x, F.lit("$"))
             & ~numeric & ~street & ~contains_any(up, CELL_OWNER_CITIES),
             F.when(looks_like_name(x), "owner_name")),
            (street & acc["property_address"].isNull(), "property_address"),
            (is_letters(F.translate(x, " -", "")) & (F.length(x) > 2)
             & acc["municipality"].isNull() & ~x.eqNullSafe(acc["owner_name"])
             & ~contains_any(up, STREET_TOKENS_SHORT, whole_word),
             F.when(F.contains(x, F.lit(" ")) | contains_any(up, CELL_TOWN_CITIES),
                    "municipality")),
            (numeric & sqft.between(MIN_SQFT, MAX_SQFT) & acc["square_footage"].isNull(),
             "square_footage"))

    def step(acc, x):
        return let(role(acc, x, F.upper(x)), lambda r: F.when(r.isNull(), acc).otherwise(F.struct(
            *[(F.when(r == n, x).otherwise(acc[n]) if n in FILLED_FIELDS else acc[n]).alias(n)
              for n in names])))

    def fill(start):
        complete = reduce(Column.__and__, [start[n].isNotNull() for n in FILLED_FIELDS])
        return F.when(complete, start).otherwise(F.aggregate(texts, start, step))

    return let(record, fill)
