"""Marked text: tags, entities, tables, links, elements."""

from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.operators import scan as S
from pagetables.operators import sequence as Q
from pagetables.operators import structure


def rows_of(df):
    rows = S.explode_rows(S.explode_tables(df))
    return [(r["table_idx"], r["row_idx"], [tuple(c) for c in r["c"]])
            for r in rows.withColumn("c", H.cells(F.col("row"))).orderBy(
                "page_id", "table_idx", "row_idx").collect()]


def test_missing_end_tags_and_capitals(pages):
    got = rows_of(pages("<TABLE a=1><TR><TH>A<TH title='x > y'>B<tr><td>1<td>2</table>"))
    assert got == [(0, 0, [("th", "A"), ("th", "B")]), (0, 1, [("td", "1"), ("td", "2")])]


def test_scripts_and_comments_hold_no_tables(pages):
    html = "<script>'<table><tr><td>1'</script><!-- <table><tr><td>2 --><style>table{}</style>"
    assert rows_of(pages(html)) == []


def test_nested_tables_own_their_rows(pages):
    got = rows_of(pages("<table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</td></tr>"
                        "<tr><td>e</td></tr></table><table><tr><td>f</td></tr></table>"))
    assert got == [(0, 0, [("td", "a\nc"), ("td", "d")]), (0, 1, [("td", "e")]),
                   (1, 0, [("td", "b")]), (2, 0, [("td", "f")])]


def test_entities(evaluate):
    texts = ["a &amp; b", "&lt;b&gt; &amp;lt;", "&eacute;&#8364;&#x20AC;&nbsp;x", "&bogus; & &#0; &",
             "&copy;&middot;&quot;", "&#128512;"]
    assert evaluate(texts, H.decode_entities(F.col("t"))) == [
        "a & b", "<b> &lt;", "é€€ x", "&bogus; & &#0; &", '©·"', "😀"]


def test_text_as_laid_out(evaluate):
    html = "<head><title>t</title></head><body> a  b<br>c<p>d <b>e</b></p><td>f</td><td>g</td>\n\nh"
    assert evaluate([html], H.body_text(H.marked(F.col("t")))) == ["a b\nc\nd e\nf g h"]


def test_links_are_made_absolute(pages, spark):
    hrefs = ["x", "/y?a=1&amp;b=2", "../z", "//h.test/i", "?q=2", "#k", "mailto:m", "./w/"]
    html = "<table>" + "".join(f"<tr><td><a href='{h}'>l</a>" for h in hrefs) + \
        "<tr><td><a name=n>l</a><a href=other>m</a><tr><td>none</table>"
    rows = S.first_link(S.explode_rows(S.explode_tables(pages(html)))).orderBy("row_idx")
    base = "http://a.test/list/"
    assert [r["record_url"] for r in rows.collect()] == [
        base + "x", "http://a.test/y?a=1&b=2", "http://a.test/z", "http://h.test/i",
        base + "p?q=2", base + "p?page=1#k", "mailto:m", base + "w/", None, None]


def test_result_blocks_take_the_first_kind_with_several_members(pages):
    df = pages(
        "<div class='result'>only</div><div class=record>a<div>in</div></div><div class=record>b",
        "<ul><li class='x search-result'>c<li class='search-result'>d</ul>",
        "<div class=results><div class=result>e</div></div>",
        "<p id=result1>f</p><p id='my-result'>g</p>", "<div class=result>one</div>")
    got = S.result_blocks(df).orderBy("page_id", "block_idx").collect()
    assert [(r["page_id"], r["kind"], r["text"]) for r in got] == [
        (1, 3, "a\nin"), (1, 3, "b"), (2, 4, "c\nd"), (2, 4, "d"),
        (3, 0, "e"), (3, 0, "e"), (4, 6, "f"), (4, 6, "g")]


def test_page_structure_and_readiness(pages):
    df = pages("<table><tr><td>Owner<tr><td>x</table>", "<table><tr><td>1<td>2<td>3</table>",
               "<table><tr><td>PALM BEACH x<tr><td>1<td>2<td>3</table>", "<p>Owner</p>",
               "<div>Loading..</div><table><tr><td>1</table>", "<p>No results</p>",
               "<i class='big spinner'></i>")
    got = structure.page_structure(df).orderBy("page_id").collect()
    assert [(r["structure_type"], r["total_results"]) for r in got][:4] == [
        ("table", 1), ("rows", 1), ("rows", 1), ("text_based", 0)]
    ready = structure.page_readiness(df).orderBy("page_id").collect()
    assert [r["readiness"] for r in ready] == [
        "ready", "ready", "ready", "pending", "loading", "empty", "loading"]


def test_results_page(pages):
    df = pages("<title>My property</title>", "<title>x</title>", url="http://a.test/ListSearch")
    assert all(r["is_results_page"] for r in structure.is_results_page(df).collect())
    strict = structure.is_results_page(df, "ListSearch").collect()
    assert [r["is_results_page"] for r in strict] == [True, True]
    plain = structure.is_results_page(pages("<title>My property</title>", "<title>x</title>"))
    assert [r["is_results_page"] for r in plain.orderBy("page_id").collect()] == [True, False]


def test_pager(pages):
    df = pages(
        "Page 1 of 15", "1 of 15 <a>99</a>", "at 1/15", "sold 01/15/2024",
        "<a>1</a><a>7</a><a>2000</a>", "<div class=pagination><span>12</span> 1300 x</div>",
        "<span class='x current'> 4 </span>", "<li class=active><a href=x>5</a></li>",
        "<div class=pager><b class=active>6</b></div>", "<a class=current>many</a>")
    totals = [r["total_pages"] for r in Q.total_pages(df).orderBy("page_id").collect()]
    assert totals == [15, 15, 15, None, 7, 12, None, 5, 6, None]
    current = [r["page_no"] for r in Q.current_page(df).orderBy("page_id").collect()]
    assert current == [1, 1, 1, 1, 1, 1, 4, 5, 6, 1]


def test_next_link_ranks(pages):
    df = pages(
        "<a href=a>&gt;</a><a href=b>Next page</a>", "<button disabled>Next</button>",
        "<button>Next</button>", "<input type=button value='Next 5'>", "<a href=c>2</a>",
        "<a href=d title='Next Page'><img></a>", "<i class=go-next></i>", "<i id=next1></i>", "x")
    got = Q.next_link(df).orderBy("page_id").collect()
    base = "http://a.test/list/"
    assert [(r["next_rank"], r["next_url"]) for r in got] == [
        (1, base + "b"), (None, None), (2, None), (3, None), (6, base + "c"), (7, base + "d"),
        (8, None), (9, None), (None, None)]


def test_marks_of_our_own_and_no_break_spaces_go(evaluate):
    texts = ["a\u0001b<p>\u0002c", " x&nbsp;y ", "<ſcript>1</script>z", "plain", None]
    got = evaluate(texts, H.marked(F.col("t")))
    assert got[:2] == [f"ab{H.OPEN}p{H.SHUT}c", " x y "] and got[3:] == ["plain", None]


def test_pages_are_not_looked_up_by_character(pages):
    """'translate' stands behind a test for the marks, and nowhere else in the marking."""
    plan = S.mark_pages(pages("<p>x</p>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.index("Contains") < plan.index("translate(")
