"""Records that pages carry as JSON in script blocks, as VARIANT values and as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = (r"(?is)<script\b(?=[^>]*\btype\s*=\s*[\"']?application/(?:ld\+)?json\b)[^>]*>"
         r"(.*?)(?:</script\s*>|\z)")


def json_blocks(html: Column) -> Column:
    """Texts of the JSON script blocks of a page, in order; the last one may lack its end tag. NULL without a page."""
    return F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))


def embedded_records(pages: DataFrame) -> DataFrame:
    """``(page_id, block_idx, record_idx, record, is_bad)``: one row for each record of a JSON block, as VARIANT.

    A block with an array gives a row for each element (``record_idx`` from 1), any other value one row; an empty array
    none. Blocks that are no JSON give one row whose record is NULL and ``is_bad`` true. Other columns are not
    read. Narrow, so it also runs on a stream.
    """
    blocks = pages.select("page_id", F.posexplode(json_blocks(F.col("html"))).alias("block_idx", "text"))
    parsed = blocks.select("page_id", (F.col("block_idx") + 1).alias("block_idx"), F.try_parse_json("text").alias("v"))
    whole = F.col("v")
    is_list = F.schema_of_variant(whole).startswith("ARRAY<")
    each = F.when(is_list, F.try_variant_get(whole, "$", "array<variant>")).otherwise(F.array(whole))
    return parsed.select("page_id", "block_idx", whole.isNull().alias("is_bad"), F.posexplode(each).alias(
        "record_idx", "record")).select("page_id", "block_idx", (F.col("record_idx") + 1).alias("record_idx"), "record", "is_bad")


def record_schema(records: DataFrame) -> str:
    """A type that all records fit, such as 'struct<price: double, owner: string>', found by one partly aggregated
    pass over all of them. A field with values of unlike kinds is a variant. 'variant' if they are not all objects.

    The text grows with the number of different field names; where names are data, give a schema instead.
    """
    found = records.filter("NOT is_bad").agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT<"):
        return "variant"
    return found.replace("OBJECT<", "struct<").replace(": VOID", ": STRING")


def embedded_columns(records: DataFrame, schema: str | None = None) -> DataFrame:
    """Records with their fields as columns: ``page_id, block_idx, record_idx`` and those of ``schema``, 'struct<...>'.

    Without a ``schema`` that of ``record_schema`` is used. A field that is missing, or whose value does not fit the
    type, is NULL, without loss of the record's other fields. Bad blocks are left out.
    """
    schema = schema or record_schema(records)
    good = records.filter("NOT is_bad")
    if not schema.lower().startswith("struct<"):
        return good.drop("is_bad")
    kinds = records.sparkSession.createDataFrame([], f"r {schema}").schema["r"].dataType
    fields = F.try_variant_get("record", "$", "map<string,variant>")

    def field(name: str, kind: str) -> Column:
        if name and not set(name) & set("'?\\"):
            return F.try_variant_get("record", f"$['{name}']", kind)
        return F.try_variant_get(fields[name], "$", kind)  # no path can hold these

    return good.select("page_id", "block_idx", "record_idx", *(
        field(f.name, f.dataType.simpleString()).alias(f.name) for f in kinds.fields))
