"""The physical plans that scale depends on."""

from pyspark.sql import functions as F

from pagetables.operators import records as O
from pagetables.operators import scan as S
from pagetables.operators import sequence as Q
from pagetables.operators import structure
from pagetables.plans import extract, listing

AT = "2024-01-02 03:04:05"
PAGES = "/root/testdata/sf0.001/pages.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_operators_do_not_shuffle(spark):
    pages = spark.read.parquet(PAGES)
    rows = S.explode_rows(S.explode_tables(pages))
    for df in (extract.extract_sales(pages, AT), extract.extract_wide(pages, AT),
               S.explode_cells(rows), S.text_blocks(pages), S.text_lines(pages),
               S.result_blocks(pages), structure.page_structure(pages), Q.next_link(pages),
               listing.page_facts(pages)):
        text = plan(df)
        assert "Exchange" not in text and "ArrowEval" not in text and "BatchEval" not in text


def test_page_columns_are_pruned(spark):
    text = plan(Q.page_limit(spark.read.parquet(PAGES).withColumn("source", F.lit("s")).withColumn(
        "page_no", F.lit(1)).withColumn("total_pages", F.lit(1))).select("source", "page_no"))
    assert "html" not in text


def test_arrays_are_built_once(spark):
    """No filter on the exploded array is pushed below the projection that builds it."""
    text = plan(extract.extract_sales(spark.read.parquet(PAGES), AT))
    assert "DataFilters: []" in text


def test_dedupe_limits_before_the_shuffle(spark):
    df = spark.read.parquet(PAGES).select(
        "page_id", F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"),
        F.col("url").alias("property_address"), F.lit("").alias("owner_name"),
        F.lit("").alias("parcel_number"))
    text = plan(O.dedupe_first(df, scope="all"))
    before = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_search_is_pushed_into_the_scan(spark, tmp_path):
    stored = spark.range(10).select(
        F.col("id").cast("int").alias("square_footage_int"), F.lit("Boca").alias("municipality"),
        F.lit("x").alias("unused"))
    stored.write.parquet(f"{tmp_path}/r")
    found = O.search_records(spark.read.parquet(f"{tmp_path}/r"), min_sqft=5)
    text = plan(found.select("municipality"))
    assert "GreaterThanOrEqual(square_footage_int,5)" in text and "unused" not in text


def test_a_large_run_is_split_where_it_meets_its_limit(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        page = F.col("id")
        df = spark.range(0, 400_000, 1, 16).select(
            F.when(page % 10 > 0, "hot").otherwise(page.cast("string")).alias("source"), page.alias("page_no"))
        limits = df.groupBy("source").agg(F.max("page_no").alias("top"))
        joined = Q.with_run_limit(df, limits, "source")
        assert joined.filter("top >= page_no").count() == 400_000
        joined = joined.select("source", "page_no", "top")
        joined.collect()
        assert "skewed" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
