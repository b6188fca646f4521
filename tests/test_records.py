"""Operators on records, sinks and sources."""

import csv
import datetime
import glob
import json

import pytest
from pyspark.sql import functions as F

from pagetables.functions.fixed import FRIENDLY_HEADINGS, SALES_FIELDS, WIDE_FIELDS
from pagetables.operators import records as O
from pagetables.plans import extract, listing
from pagetables.sources import tables

AT = "2024-01-02 03:04:05"
RECORD = ("page_id bigint, table_idx int, row_idx int, property_address string, "
          "parcel_number string, owner_name string")


@pytest.fixture
def records(spark):
    rows = [(1, 0, 1, "1 A ST", "p", "Ann"), (1, 0, 2, " 1 a st ", "p ", "ANN"),
            (1, 0, 3, "1 A ST", "q", "Ann"), (1, 1, 1, None, None, "Bob"),
            (1, 1, 2, "", "", "bob"), (1, 1, 3, None, "", " "), (2, 0, 1, "1 A ST", "p", "Ann")]
    return spark.createDataFrame(rows, RECORD)


def where(df):
    return sorted((r["page_id"], r["table_idx"], r["row_idx"]) for r in df.collect())


def test_dedupe_first(records):
    per_page = O.dedupe_first(records)
    assert where(per_page) == [(1, 0, 1), (1, 0, 3), (1, 1, 1), (2, 0, 1)]
    assert where(O.dedupe_first(records, scope="all")) == [(1, 0, 1), (1, 0, 3), (1, 1, 1)]
    assert where(O.dedupe_first(per_page)) == where(per_page)


def test_dedupe_in_page_gives_the_same(pages, spark):
    rows = [["Ann", "1 A ST", "p"], ["ANN", "1 a st", "p"], ["Ann", "1 A ST", "q"], ["", "", ""],
            ["Bob", "", ""], ["bob", "", ""]]
    html = "<table><tr><th>Owner<th>Location<th>Parcel" + "".join(
        "<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    got = extract.extract_wide(pages(html, html), AT)
    assert where(got) == [(1, 0, 1), (1, 0, 3), (1, 0, 5), (2, 0, 1), (2, 0, 3), (2, 0, 5)]


def test_search(spark):
    rows = [(1, "Commercial", "Lake Park", 5000, "10.00", "2020-01-01"),
            (2, "commercial", "LAKE PARK", 4999, "20.00", "2021-01-01"),
            (3, None, "Boca", 9000, None, None)]
    df = spark.createDataFrame(rows, "i int, property_type string, municipality string, "
                               "square_footage_int int, sale_price_num string, d string")
    df = df.withColumn("sale_price_num", F.col("sale_price_num").cast("decimal(18,2)")) \
        .withColumn("sale_date_value", F.col("d").cast("date"))

    def found(**criteria):
        return sorted(r["i"] for r in O.search_records(df, **criteria).collect())

    assert found() == [1, 2, 3]
    assert found(property_type="Commercial", municipality="lake park") == [1, 2]
    assert found(property_type="Commercial", min_sqft=5000) == [1]
    assert found(max_sqft=5000, min_value=15) == [2]
    assert found(date_from="2020-01-01", date_to="2020-12-31") == [1]
    with pytest.raises(ValueError):
        O.search_records(df.drop("property_type"), property_type="x")


def test_resolve_option(spark):
    options = spark.createDataFrame(
        [(0, "All", "0"), (1, "BEACH OF PALM", "b"), (2, "North Palm Beach ", "n"),
         (3, "Palm Beach", "p"), (4, "", "palm beach")], "pos int, text string, value string")
    got = O.resolve_option(options, ["palm beach", "beach palm of", "none", "b"]).collect()
    assert {r["term"]: (r["tier"], r["pos"]) for r in got} == {
        "palm beach": (1, 2), "beach palm of": (2, 1), "b": (1, 1)}


def test_sample_shows_key_fields(pages):
    html = "<table><tr><th>Owner<th>Sale Date" + "".join(f"<tr><td>O{i}<td>" for i in range(5))
    got = O.sample(extract.extract_wide(pages(html + "</table>"), AT)).collect()
    assert [(r["owner_name"], r["sale_date"]) for r in got] == [("O0", None), ("O1", None)]


@pytest.fixture
def wide(pages):
    return extract.extract_wide(pages(
        "<table><tr><th>Owner<th>Location<tr><td>\"Ann\", Ê<td>1 A<br>ST<tr><td>Bob<td></table>"), AT)


def read_parts(path, encoding="utf-8"):
    parts = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, encoding=encoding, newline="") as f:
            parts.append(f.read())
    return parts


def test_wide_csv(wide, tmp_path):
    path = tables.write_wide_csv(wide, f"{tmp_path}/w", ordered=True, line_end="\r\n")
    parts = [p for p in read_parts(path) if p]
    assert all(p.startswith("﻿") for p in parts)
    rows = [r for p in read_parts(path, "utf-8-sig") for r in list(csv.reader(p.splitlines(True)))]
    heads, data = [r for r in rows if r[0] == "Parcel Number"], [r for r in rows if r[1:2] == [""]]
    assert heads[0] == [FRIENDLY_HEADINGS[f] for f in WIDE_FIELDS]
    at = WIDE_FIELDS.index("owner_name")
    assert sorted(r[at] for r in data) == ['"Ann", Ê', "Bob"]
    assert {r[at + 1] for r in data} == {"1 A ST", ""}
    assert any("\r\n" in p for p in parts)


def test_sales_csv_and_empty_result(pages, tmp_path, spark):
    sales = extract.extract_sales(pages("<table><tr><th>A<tr><td>$1<td>b<td>c</table>"), AT)
    tables.write_sales_csv(sales, f"{tmp_path}/s")
    back = tables.read_csv(spark, f"{tmp_path}/s")
    assert back.columns == SALES_FIELDS
    assert back.first()["sale_price"] == "$1" and back.first()["owner_name"] == ""
    tables.write_sales_csv(sales.filter("false"), f"{tmp_path}/e")
    assert tables.read_csv(spark, f"{tmp_path}/e").count() == 0


def test_json(wide, tmp_path):
    tables.write_json(wide, f"{tmp_path}/j")
    rows = [json.loads(line) for p in read_parts(f"{tmp_path}/j") for line in p.splitlines()]
    assert {r["owner_name"] for r in rows} == {'"Ann", Ê', "Bob"}
    assert all(list(r) == WIDE_FIELDS and r["acres"] == "" for r in rows)
    assert "Ê" in "".join(read_parts(f"{tmp_path}/j"))


def test_runs_are_appended_by_time(wide, tmp_path, spark):
    for day in (1, 2):
        tables.write_run(wide, f"{tmp_path}/r", datetime.datetime(2024, 1, day, 3, 4, 5))
    got = spark.read.parquet(f"{tmp_path}/r").groupBy("run_ts").count().collect()
    assert {r["run_ts"]: r["count"] for r in got} == {"20240101_030405": 2, "20240102_030405": 2}
    assert tables.run_path("f/", "n", datetime.datetime(2024, 1, 2, 3, 4, 5)) == \
        "f/n_20240102_030405"


def test_page_sources(pages, tmp_path, spark):
    df = pages("<title>a</title>", "<p>é</p>")
    df.write.json(f"{tmp_path}/j")
    df.write.parquet(f"{tmp_path}/p")
    expected = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, tables.read_pages(spark, f"{tmp_path}/j", "json").collect())) == expected
    spread = tables.read_pages(spark, f"{tmp_path}/p", partitions=3)
    assert sorted(map(tuple, spread.collect())) == expected and spread.rdd.getNumPartitions() == 3
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.html").write_text("<p>é</p>", encoding="utf-8")
    files = tables.read_pages(spark, f"{tmp_path}/h", "binaryFile").collect()
    assert len(files) == 1 and files[0]["html"] == "<p>é</p>" and files[0]["url"].endswith("x.html")


class Cluster:
    """A session that names a shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return "/shared/" if name == "spark.checkpoint.dir" else default


def test_scratch_follows_the_session(spark):
    assert tables.scratch_path(Cluster, "x").startswith("/shared/x-")
    assert tables.scratch_path(Cluster, "x", "/mine").startswith("/mine/x-")
    assert tables.materialise(spark.range(3), "m").count() == 3


class Nameless:
    """A session that names no folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_no_folder_is_an_error():
    with pytest.raises(ValueError):
        tables.scratch_path(Nameless, "x")


def test_search_of_sales_by_type_is_an_error(pages):
    with pytest.raises(ValueError):
        listing.search_listing(pages("<p>"), AT, property_type="Commercial")
