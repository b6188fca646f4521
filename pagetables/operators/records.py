"""Operators on extracted records: keep, type, search, de-duplicate, sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.functions import text as T
from pagetables.functions.fixed import SAMPLE_FIELDS

POSITION = ["page_id", "table_idx", "row_idx"]


def _any_set(*names: str) -> Column:
    return F.coalesce(*[T.nonblank(F.col(n)) for n in names]).isNotNull()


def keep_wide(records: DataFrame) -> DataFrame:
    return records.filter(_any_set("property_address", "owner_name", "parcel_number"))


def keep_sales(records: DataFrame) -> DataFrame:
    return records.filter(_any_set("sale_price", "property_address", "owner_name",
                                   "municipality", "parcel_number"))


def keep_text(records: DataFrame) -> DataFrame:
    return records.filter(_any_set("property_address", "owner_name"))


MONEY_FIELDS = ["sale_price", "property_value", "assessed_value", "market_value",
                "taxable_value", "tax_amount", "exemption_amount"]
INTEGER_FIELDS = ["square_footage", "lot_size", "year_built"]


def typed_record(records: DataFrame) -> DataFrame:
    """Add typed columns ``*_num``, ``*_int``, ``sale_date_value`` and ``homesteaded_flag``
    beside the raw text, and ``*_key`` for searches; text that does not parse gives NULL."""
    names = records.columns
    typed = {f"{n}_num": T.money(F.col(n)) for n in MONEY_FIELDS if n in names}
    typed |= {f"{n}_int": T.integer(F.col(n)) for n in INTEGER_FIELDS if n in names}
    if "sale_date" in names:
        typed["sale_date_value"] = T.date_value(F.col("sale_date"))
    if "homesteaded" in names:
        typed["homesteaded_flag"] = T.flag(F.col("homesteaded"))
    typed |= {f"{n}_key": search_key(F.col(n)) for n in KEY_FIELDS if n in names}
    return records.withColumns(typed)


#: Fields that searches compare without regard to case and blanks at the ends.
KEY_FIELDS = ["property_type", "municipality"]


def search_key(text: Column) -> Column:
    return F.lower(T.strip(text))


def search_records(typed: DataFrame, property_type: str | None = None,
                   municipality: str | None = None,
                   min_sqft: int | None = None, max_sqft: int | None = None,
                   min_value=None, max_value=None,
                   date_from=None, date_to=None) -> DataFrame:
    """Records that meet every given criterion; one that is None is not applied, one whose
    column the records lack raises ``ValueError``. On stored typed records every criterion
    is a plain comparison of a column, which is pushed into the scan."""
    def keyed(name):
        key = f"{name}_key"
        return (key, lambda c, v: c == v.strip().lower()) if key in typed.columns else (
            name, lambda c, v: search_key(c) == v.strip().lower())

    type_column, type_test = keyed("property_type")
    town_column, town_test = keyed("municipality")
    criteria = [
        (type_column, property_type, type_test),
        (town_column, municipality, town_test),
        ("square_footage_int", min_sqft, lambda c, v: c >= v),
        ("square_footage_int", max_sqft, lambda c, v: c <= v),
        ("sale_price_num", min_value, lambda c, v: c >= F.lit(v).cast("decimal(18,2)")),
        ("sale_price_num", max_value, lambda c, v: c <= F.lit(v).cast("decimal(18,2)")),
        ("sale_date_value", date_from, lambda c, v: c >= F.lit(v).cast("date")),
        ("sale_date_value", date_to, lambda c, v: c <= F.lit(v).cast("date")),
    ]
    given = [(n, v, test) for n, v, test in criteria if v is not None]
    if missing := sorted({n for n, _, _ in given if n not in typed.columns}):
        raise ValueError(f"the records have no column {', '.join(missing)}")
    applied = [test(F.col(n), v) for n, v, test in given]
    return typed.filter(reduce(Column.__and__, applied)) if applied else typed


def resolve_option(options: DataFrame, terms: list[str]) -> DataFrame:
    """For each search term the option it selects: the first by ``pos`` whose ``text`` or
    ``value`` contains the term, else the first with all words of the term in one of them.

    The terms are the words a user types, so they are part of the plan: one pass over the
    options and one partially aggregated group per term, without a join.
    """
    def tier(term):
        low = term.lower()
        whole = F.contains(F.col("t"), F.lit(low)) | F.contains(F.col("v"), F.lit(low))
        words = low.split()
        each = [reduce(Column.__and__, [F.contains(F.col(c), F.lit(w)) for w in words])
                for c in ("t", "v")]
        return F.struct(F.lit(term).alias("term"),
                        F.when(whole, 1).when(each[0] | each[1], 2).alias("tier"))

    scored = options.select(
        "*", F.lower(T.strip(F.col("text"))).alias("t"), F.lower(T.strip(F.col("value"))).alias("v")) \
        .select("pos", "text", "value", F.explode(F.array(*[tier(t) for t in terms])).alias("s")) \
        .filter("s.tier is not null")
    first = scored.groupBy(F.col("s.term").alias("term")).agg(
        F.min(F.struct("s.tier", "pos", "text", "value")).alias("m"))
    return first.select("term", "m.tier", "m.pos", "m.text", "m.value")


def search_by_option(typed: DataFrame, options: DataFrame, terms: list[str],
                     field: str = "municipality") -> DataFrame:
    """Records whose ``field`` is the text of the option that a term selects, with ``term``;
    an equi-join on the key, so that either side may be large."""
    chosen = resolve_option(options, terms).select(
        "term", search_key(F.col("text")).alias(f"{field}_key"))
    keyed = typed if f"{field}_key" in typed.columns else typed.withColumn(
        f"{field}_key", search_key(F.col(field)))
    return keyed.join(chosen, f"{field}_key")


def dedupe_keys() -> list[Column]:
    def key(name, lower):
        c = F.trim(F.coalesce(F.col(name), F.lit("")))
        return F.lower(c) if lower else c
    return [key("property_address", True).alias("k_address"),
            key("parcel_number", False).alias("k_parcel"),
            key("owner_name", True).alias("k_owner")]


def dedupe_first(records: DataFrame, scope: str = "page",
                 order: list[str] = POSITION) -> DataFrame:
    """First record by ``order`` of each (address, parcel, owner); records with none of
    the three are dropped. ``scope`` is 'page' or 'all'.

    The rank filter runs before the shuffle too (one record per key and map task), so a
    key with very many copies does not gather them in one task.
    """
    names = ["k_address", "k_parcel", "k_owner"]
    keyed = records.select("*", *dedupe_keys()).filter(
        F.concat(*names) != "")
    by = names + (["page_id"] if scope == "page" else [])
    first = Window.partitionBy(*by).orderBy(*order)
    return keyed.withColumn("rank", F.row_number().over(first)).filter("rank = 1") \
        .drop("rank", *names)


def sample(records: DataFrame, n: int = 2, order: list[str] = POSITION,
           url_chars: int | None = None) -> DataFrame:
    """The first ``n`` records with the key fields; blanks are NULL. ``url_chars`` cuts the
    address for display."""
    url = F.col("record_url") if url_chars is None else F.substring("record_url", 1, url_chars)
    shown = [c for c in SAMPLE_FIELDS if c in records.columns]
    return records.orderBy(*order).limit(n).select(
        *order, *[T.nonblank(T.strip(F.col(c))).alias(c) for c in shown],
        url.alias("record_url"))
