"""Time the headline plans on listing pages and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) names the tables, ``BENCH_CPUS`` the cores. Listing pages
are rendered from the tables into a scratch folder first; rendering is not timed. A query's
time is that of building, optimising and running its plan into a sink that stores nothing,
the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagetables.catalog.base import EXTRACTED_AT  # noqa: E402
from pagetables.operators import records as O  # noqa: E402
from pagetables.operators import scan as S  # noqa: E402
from pagetables.operators import sequence as Q  # noqa: E402
from pagetables.plans import extract, listing  # noqa: E402
from pagetables.sources import render, tables  # noqa: E402


def session(cpus: int) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pagetables-bench")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.dataFrameQueryContext.enabled", "false")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session(cpus)
    scratch = tempfile.mkdtemp(prefix="pagetables-bench-")

    def stored(name, df):
        path = f"{scratch}/{name}"
        df.repartition(cpus).write.parquet(path)
        return spark.read.parquet(path)

    listed = stored("tables", render.result_pages(spark, sf_dir))
    blocks = stored("blocks", render.block_pages(spark, sf_dir))
    facts = stored("facts", render.fact_pages(spark, sf_dir))
    raw = stored("raw", tables.read_pages(spark, f"{sf_dir}/pages.parquet"))
    records = stored("records", O.typed_record(extract.extract_sales(listed, EXTRACTED_AT)))

    plans = {
        "extract_sales_tables": lambda: extract.extract_sales(listed, EXTRACTED_AT),
        "extract_sales_blocks": lambda: extract.extract_sales(blocks, EXTRACTED_AT),
        "extract_sales_raw_pages": lambda: extract.extract_sales(raw, EXTRACTED_AT),
        "extract_wide_tables": lambda: extract.extract_wide(listed, EXTRACTED_AT),
        "extract_wide_text": lambda: extract.extract_wide(facts, EXTRACTED_AT),
        "explode_cells": lambda: S.explode_cells(S.explode_rows(S.explode_tables(listed))),
        "text_lines_raw_pages": lambda: S.text_lines(raw),
        "run_listing": lambda: listing.run_listing(listed, EXTRACTED_AT, work_dir=scratch),
        "dedupe_all": lambda: O.dedupe_first(records, scope="all"),
        "page_totals": lambda: Q.page_totals(records, work_dir=scratch),
        "search_records": lambda: O.search_records(records, municipality="CITY BC", min_sqft=5000),
    }
    pages = {"listed": listed.count(), "blocks": blocks.count(), "facts": facts.count(),
             "raw": raw.count()}
    seconds, build, exchanges, rows = {}, {}, {}, {}
    for name, plan in plans.items():
        for _ in range(2):
            start = time.perf_counter()
            df = plan()
            built = time.perf_counter() - start
            df.write.format("noop").mode("overwrite").save()
            total = time.perf_counter() - start
            if name not in seconds or total < seconds[name]:
                seconds[name], build[name] = round(total, 3), round(built, 3)
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        rows[name] = df.agg(F.count(F.lit(1))).first()[0]
    used = {"extract_sales_tables": "listed", "extract_sales_blocks": "blocks",
            "extract_sales_raw_pages": "raw", "extract_wide_tables": "listed",
            "extract_wide_text": "facts", "explode_cells": "listed",
            "text_lines_raw_pages": "raw", "run_listing": "listed"}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir), "cpus": cpus,
        "plan_seconds": build, "rows": rows, "exchanges": exchanges,
        "pages_per_sec": {n: round(pages[p] / seconds[n]) for n, p in used.items()},
        "records_per_sec": {n: round(rows[n] / seconds[n]) for n in seconds},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
