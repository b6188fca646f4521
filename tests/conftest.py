import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = compare.session()
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """Make pages from HTML texts; page ids count from 1."""
    def make(*htmls, url="http://a.test/list/p?page=1#x"):
        return spark.createDataFrame(
            [(i, url, h) for i, h in enumerate(htmls, 1)],
            "page_id bigint, url string, html string")
    return make


@pytest.fixture
def evaluate(spark):
    """Values of expressions over a column ``t`` with the given texts."""
    def run(texts, *expressions):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        rows = df.select("i", *[e.alias(f"e{n}") for n, e in enumerate(expressions)]).collect()
        rows = sorted(rows, key=lambda r: r["i"])
        return [r[1] if len(expressions) == 1 else tuple(r)[1:] for r in rows]
    return run
