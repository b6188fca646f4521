"""Header mapping as relations, for keyword tables that users bring along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.functions import fields as K
from pagetables.functions import html as H
from pagetables.functions import text as T


def map_columns(headers: DataFrame, keywords=None) -> DataFrame:
    """Add ``field`` to a relation with ``header``: the first field with a keyword
    contained in the header, NULL if none.

    ``keywords`` is a list of (field, words), compiled into one expression, or a
    DataFrame (rank, field, keyword) of any size. For a DataFrame the substrings of the
    distinct headers meet the keywords in an equi-join, so neither side needs to be small
    and no pairs are tried that do not match.
    """
    if not isinstance(keywords, DataFrame):
        return headers.withColumn("field", K.field_of_header(
            F.lower("header"), keywords or K.FIELD_KEYWORDS))
    distinct = headers.select(F.lower("header").alias("h")).distinct()
    longest = keywords.agg(F.max(F.length("keyword"))).first()[0] or 0
    spans = distinct.select("h", F.explode(F.sequence(
        F.lit(1), F.greatest(F.length("h"), F.lit(1)))).alias("start"))
    parts = spans.select("h", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.least(F.lit(longest), F.length("h") - F.col("start") + 1),
                                        F.lit(1))),
        lambda n: F.substring(F.col("h"), F.col("start"), n))).alias("keyword")).distinct()
    first = parts.join(keywords, "keyword").groupBy("h").agg(
        F.min_by("field", "rank").alias("field"))
    return headers.withColumn("h", F.lower("header")).join(first, "h", "left").drop("h")


def assign_mapped(rows: DataFrame) -> DataFrame:
    """Rows with ``headers`` and ``row`` to mapped fields, before any text rule."""
    keys = [c for c in rows.columns if c not in ("headers", "row", "n_rows", "n_td")]
    cells = rows.select(*keys, K.fields_of_headers(F.col("headers")).alias("fields"),
                        F.transform(H.data_cells(F.col("row")), T.clean_text).alias("texts"))
    return cells.select(*keys, K.assign_mapped(F.col("fields"), F.col("texts")).alias("m")) \
        .select(*keys, "m.*")


def assign_by_header_and_value(rows: DataFrame, fill: bool = False) -> DataFrame:
    """Rows with ``headers`` and ``row`` to sales fields by heading (or by position where
    there are none); ``fill`` also looks at the remaining cells."""
    keys = [c for c in rows.columns if c not in ("headers", "row", "n_rows", "n_td")]
    cells = rows.select(*keys, K.header_roles(F.col("headers")).alias("roles"),
                        H.data_cells(F.col("row")).alias("texts"))
    start = F.when(F.size("roles") > 0, K.assign_by_header_and_value(
        F.col("roles"), F.col("texts"))).otherwise(K.assign_by_position(F.col("texts")))
    record = K.fill_from_cells(start, F.col("texts")) if fill else start
    return cells.select(*keys, record.alias("m")).select(*keys, "m.*")

