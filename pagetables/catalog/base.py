"""Registry, and SQL that says what the rendered listing pages show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EXTRACTED_AT = "2024-01-02 03:04:05"


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def work_dir(spark: SparkSession) -> str:
    """The session's shared folder for intermediate tables, else one in its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/pagetables-work")


def letters(key: str) -> str:
    return f"translate(CAST({key} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


EMPTY = "((run_no % 3 = 1 AND page_no BETWEEN 20 AND 22) OR (run_no % 3 = 2 AND page_no = 10))"
HAS_NEXT = "(page_no < 60 AND NOT (run_no % 3 = 2 AND page_no = 40))"

# base: one row per order; shown: rows on pages that are not empty, the repeated one too;
# paged: one row per page.
LISTED = f"""
WITH base AS (
  SELECT o_orderkey AS k, o_orderkey // 25 AS page_id, o_orderkey // 1500 AS run_no,
         CAST((o_orderkey % 1500) // 25 + 1 AS INTEGER) AS page_no,
         CAST(o_orderkey % 25 AS INTEGER) AS row_no,
         '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS sale_price,
         strftime(o_orderdate, '%Y-%m-%d') AS sale_date, o_orderdate AS sold_at,
         'OWNER ' || {letters('c_custkey')} AS owner_name,
         CAST(o_orderkey + 1 AS VARCHAR) || ' ' || {letters('o_orderkey')} || ' CIR'
           AS property_address,
         'CITY ' || {letters('n_nationkey')} AS municipality,
         CAST(500 + (o_orderkey * 37) % 49000 AS VARCHAR) AS square_footage,
         CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS homesteaded,
         lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-' ||
         lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' ||
         lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' ||
         lpad(CAST((o_orderkey // 100) % 10000 AS VARCHAR), 4, '0') AS parcel_number
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
listed AS (
  SELECT *, row_no AS seat FROM base UNION ALL SELECT *, 25 AS seat FROM base WHERE row_no = 7),
shown AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seat) AS INTEGER) AS row_idx,
         'http://listing.example.com/run-' || CAST(run_no AS VARCHAR) || '/search?page=' ||
         CAST(page_no AS VARCHAR) AS url,
         'run-' || CAST(run_no AS VARCHAR) AS source
  FROM listed WHERE NOT {EMPTY}),
paged AS (
  SELECT page_id, run_no, page_no, 'run-' || CAST(run_no AS VARCHAR) AS source,
         'http://listing.example.com/run-' || CAST(run_no AS VARCHAR) || '/search?page=' AS stem,
         {EMPTY} AS is_empty, {HAS_NEXT} AS has_next, count(*) AS n
  FROM listed GROUP BY ALL)
"""

LINK = "'http://listing.example.com/detail/parcel?id=' || CAST(k AS VARCHAR)"

COMPACT = """(sale_price || ' ' || sale_date || ' ' || owner_name || ' & ' || property_address ||
 ' ' || municipality || ' ' || square_footage || ' ' || property_address || ' ' ||
 municipality || ' FL ' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || ' ' ||
 CAST(k AS VARCHAR) || ' ' || homesteaded || ' QV MAP')"""

PROSE = f"""('Sold ' || strftime(sold_at, '%-m/%-d/%Y') || ' for ' || sale_price || ' by Ow' ||
 lower(substr(owner_name, 7)) || ', Ci' || lower(substr(municipality, 6)) || ' at ' ||
 CAST(k + 1 AS VARCHAR) || ' Bo' || lower({letters('k')}) || ' Lane in Jupiter, area ' ||
 square_footage || ', ' || parcel_number || ', homestead ' ||
 CASE WHEN homesteaded = 'Y' THEN 'Yes' ELSE 'No' END)"""

FACTS = f"""('Property at ' || CAST(k + 1 AS VARCHAR) || ' ' || {letters('k')} ||
 ' Avenue; PCN: ' || parcel_number || '; Just Value: ' || split_part(sale_price, '.', 1) ||
 '; West Palm Beach; ' || CAST(k % 90 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) ||
 ' acres; Mail ' || {letters('page_id')} || ' TOWN, FL ' ||
 lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || '; Homestead: ' || homesteaded ||
 '; Lot Size: ' || square_footage || ' sq ft')"""


def nulls(names, given) -> str:
    """Select list of ``names``: the given expressions, NULL for the others."""
    return ", ".join(f"{given[n] if n in given else 'CAST(NULL AS VARCHAR)'} AS {n}"
                     for n in names)
