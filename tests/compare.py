"""Run a registered query and its SQL on the same tables and compare them.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "long",
         "varchar": "string", "timestamp without time zone": "timestamp"}


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("pagetables-checks")
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagetables-checks-"))
             .config("spark.sql.dataFrameQueryContext.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db, sql: str) -> str | None:
    """None if both agree in columns, types and rows; else what differs."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {d[0]: str(d[1]).lower() for d in found.description}
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    for n in names:
        theirs = KINDS.get(kinds[n], kinds[n]).replace("long", "bigint")
        if mine[n].split("(")[0] != theirs.split("(")[0]:
            return f"type of {n}: {mine[n]} != {kinds[n]}"
    actual = [tuple(r) for r in df.collect()]
    order = sorted(names)
    a = _rows(actual, [df.columns.index(n) for n in order])
    e = _rows(expected, [names.index(n) for n in order])
    if len(a) != len(e):
        return f"{len(a)} rows != {len(e)}; first {[x for x in a if x not in set(e)][:1]} vs " \
               f"{[x for x in e if x not in set(a)][:1]}"
    for x, y in zip(a, e):
        if x != y:
            return f"{order}: {x} != {y}"
    return None


def main():
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, db = session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, db, oracles[name]) if name in oracles else f"no SQL, {df.count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"RESULT {name} {time.time() - start:.1f}s {'ok' if problem is None else problem}",
              flush=True)
    print(f"RESULT {len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
