"""A stream of pages gives what a batch gives, also over a restart."""

from pyspark.sql import functions as F

from pagetables.plans import extract
from pagetables.sources import render
from pagetables.streaming import stream

SF = "/root/testdata/sf0.001"
AT = "2024-01-02 03:04:05"


def rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*names).collect()))


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    pages = render.result_pages(spark, SF)
    pages.filter("page_no <= 30").write.parquet(folder)
    schema = pages.schema

    def run():
        arriving = stream.read_pages_stream(spark, folder, schema, files_per_batch=3)
        records = extract.extract_sales(arriving, AT)
        stream.append_records(records, out, f"{tmp_path}/log").awaitTermination()
        return spark.read.schema(records.schema).parquet(out)

    batch = extract.extract_sales(spark.read.schema(schema).parquet(folder), AT)
    assert rows(run()) == rows(batch)
    pages.filter("page_no > 30").write.mode("append").parquet(folder)
    assert rows(run()) == rows(extract.extract_sales(
        spark.read.schema(schema).parquet(folder), AT))


def test_dedupe_stream_keeps_one_of_each(spark, tmp_path):
    folder = f"{tmp_path}/in"
    pages = render.result_pages(spark, SF).withColumn("arrived", F.lit(AT).cast("timestamp"))
    pages.write.parquet(folder)
    for name, arrival in (("state", None), ("watermark", "arrived")):
        arriving = stream.read_pages_stream(spark, folder, pages.schema)
        records = extract.extract_sales(arriving, AT)
        first = stream.dedupe_stream(records, arrival=arrival, unbounded_state=arrival is None)
        out = f"{tmp_path}/{name}"
        stream.append_records(first, out, f"{out}-log").awaitTermination()
        got = spark.read.schema(first.schema).parquet(out)
        assert got.count() == 1500
        assert got.select("property_address", "parcel_number", "owner_name").distinct().count() == 1500


def test_pages_of_few_files_are_spread(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", []
    render.result_pages(spark, SF).coalesce(1).write.parquet(folder)
    pages = spark.read.parquet(folder)
    arriving = stream.read_pages_stream(spark, folder, pages.schema, files_per_batch=2, partitions=12)
    facts = arriving.select("page_id", F.spark_partition_id().alias("task"))
    (facts.writeStream.foreachBatch(lambda df, batch: seen.extend(df.collect()))
     .option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination())
    assert len({r["task"] for r in seen}) == 12
    assert sorted(r["page_id"] for r in seen) == sorted(r["page_id"] for r in pages.collect())
