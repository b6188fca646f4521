"""Scalar functions and text rules on the worked examples and on their edge cases."""

import datetime
import decimal

from pyspark.sql import functions as F

from pagetables.functions import rules as R
from pagetables.functions import text as T

def col():
    return F.col("t")


none = T.no_text


def test_clean_text(evaluate):
    texts = [" : $ 5  x - ", "a\n b\tc", "--", "", "$ 7", "x:y"]
    assert evaluate(texts, T.clean_text(col())) == ["$5 x", "a b c", "", "", "$7", "x:y"]


def test_numbers_dates_flags(evaluate):
    texts = ["$1,234.50", "abc", "", "1.5"]
    assert evaluate(texts, T.money(col()), T.integer(col())) == [
        (decimal.Decimal("1234.50"), None), (None, None), (None, None),
        (decimal.Decimal("1.50"), None)]
    dates = ["01/15/2024", "01-15-2024", "2024-01-15", "Jan 15, 2024", "Jan 5 2024", "13/45/2024"]
    day = datetime.date(2024, 1, 15)
    assert evaluate(dates, T.date_value(col())) == [day] * 4 + [datetime.date(2024, 1, 5), None]
    assert evaluate(["yes", "N", "Homestead exemption", "maybe"], T.yes_no(col()), T.flag(col())) \
        == [("Yes", True), ("No", False), ("Yes", True), ("MAYBE", None)]
    assert evaluate(["1,234", "1.5", "-1", "", "12a"], T.numeric_text(col())) == [
        True, True, False, False, False]


def test_progress(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 0), (1, None)], "p int, n int")
    got = [r[0] for r in df.select(T.page_progress(F.col("p"), F.col("n"))).collect()]
    assert got == [33.3, 66.7, None, None]


def test_first_match_keeps_what_is_set(evaluate):
    rule = T.first_match(F.when(col() == "a1", "set"), col(), [r"z(\d)", r"[ab](\d)"])
    assert evaluate(["a1", "b2 z3", "b2", "c"], rule) == ["set", "3", "2", None]


def test_fill_from_patterns_never_changes_a_set_field(spark):
    df = spark.createDataFrame([("n 5", "set"), ("n 6", ""), ("x", None)], "t string, n string")
    got = R.fill_from_patterns(df, "t", [("n", 1, r"n (\d)", 1, "<{}>")]).collect()
    assert [r["n"] for r in got] == ["set", "<6>", None]


WORKED = ("$100 2004-11-12 BACON JOHN D & 712 LAKESIDE CIR NORTH PALM BEACH 9068 712 LAKESIDE CIR "
          "NORTH PALM BEACH FL 33408 4523 Y QV MAP")


def test_compact_line(evaluate):
    joined = WORKED.replace("D & 712", "D&X 712")
    no_flag = WORKED.replace(" Y QV", " QV")
    got = evaluate([WORKED, joined, no_flag, WORKED.replace("&", "and"), WORKED.replace("$", ""),
                    WORKED.replace("FL", "GA"), WORKED.replace(" 33408 4523 Y QV MAP", " 33408"),
                    "\n " + WORKED.replace(" ", "  ")], R.parse_compact(col()))
    expected = ("$100", "2004-11-12", "BACON JOHN D", "712 LAKESIDE CIR", "NORTH PALM BEACH", "9068",
                "712 LAKESIDE CIR", "NORTH PALM BEACH FL 33408", "Yes")
    assert tuple(got[0]) == expected and tuple(got[1]) == expected and tuple(got[7]) == expected
    assert tuple(got[2]) == expected[:-1] + (None,)
    assert got[3:7] == [None] * 4


def wide(evaluate, field, *texts):
    return evaluate(list(texts), R.WIDE_RULES[field](none(), col()))


def test_wide_rules(evaluate):
    assert wide(evaluate, "parcel_number", "12-3456-789-0123", "PCN: 12-AB", "parcel 7", "pcn") == [
        "12-3456-789-0123", "12-AB", "7", None]
    assert wide(evaluate, "property_value", "Just Value: $1,234", "TOTAL VALUE $5", "Value $5") == [
        "$1,234", "$5", None]
    assert wide(evaluate, "acres", "2.5 acres", "Acre: 3", "7 ac", "7") == ["2.5", "3", "7", None]
    assert wide(evaluate, "homesteaded", "Homestead: N", "Homestead Exemption",
                "yes, it is a homestead", "no") == ["No", "Yes", "Yes", None]
    assert wide(evaluate, "lot_size", "Lot Size: 7,500 sq ft", "land area 9", "8 sq ft lot") == [
        "7,500", "9", "8"]
    assert wide(evaluate, "mail_city_state_zip", "JUPITER, FL 33458-1234", "x") == [
        "JUPITER, FL 33458-1234", None]
    assert wide(evaluate, "municipality", "in West Palm Beach", "Boca") == ["Palm Beach", None]
    assert wide(evaluate, "property_address", "at 12 Oak ST APT 4b", "9 Long Circle", "Oak ST") == [
        "12 Oak ST APT 4b", "9 Long Cir", None]


def test_sales_rules(evaluate):
    assert evaluate(["$5 and $1,200.50", "5"], R.sales_price(none(), col())) == ["$5", None]
    dates = ["01/15/2024", "01-15-2024", "2024-01-15", "Jan 15, 2024", "1/5/24"]
    assert evaluate(dates, R.sales_date(none(), col())) == dates[:4] + [None]
    assert evaluate(["12-3456-7890", "12-34-56-78901", "12-3456-789-0123", "ABCDEF123456"],
                    R.sales_parcel(none(), col())) == [
        "12-3456-7890", "12-34-56", "12-3456-789", "ABCDEF123456"]
    assert evaluate(["499 500", "50001", "099"], R.sales_square_footage(none(), col())) == [
        "500", None, None]
    assert evaluate(["is it y or no", "maybe"], R.sales_homestead(none(), col())) == ["y", None]
    assert evaluate(["12 Main Street x", "12 Oak Hill LN", "Main Street"],
                    R.sales_address(none(), col())) == ["12 Main Street", "12 Oak Hill LN", None]


def test_sales_owner_and_town(evaluate):
    owner = R.sales_owner(none(), col(), none(), none())
    assert evaluate(["by Smith, John Paul at", "John Smith", "Boca Raton John Doe9 Ann Lee",
                     "JOHN DOE", "Best Steak", "Jo"], owner) == [
        "Smith, John Paul", "John Smith", "Ann Lee", "JOHN DOE", None, None]
    town = R.sales_municipality(none(), col(), F.lit("ann lee"), none())
    assert evaluate(["in boca raton", "West Palm Beach", "ann lee", "x1 lake park", "12"], town) == [
        "boca raton", None, None, "lake park", None]


def test_long_runs_of_words_do_not_exhaust_the_stack(evaluate):
    words = " ".join(["Alpha"] * 20000)
    got = evaluate([words], R.sales_owner(none(), col(), none(), none()),
                   R.sales_municipality(none(), col(), none(), none()))
    assert got == [(words, words)]


def test_lines_fill_in_order(spark):
    lines = ["Smith, John", "$5 Lake Worth", "$6 Ann Lee 12 Main Street", "Yes"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    r = df.select(R.fold_lines(F.col("l")).alias("r")).first()["r"]
    assert (r["sale_price"], r["owner_name"], r["municipality"], r["property_address"],
            r["homesteaded"]) == ("$5", "Smith, John", "Smith", "12 Main Street", "Yes")
