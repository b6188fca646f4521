"""Decontamination against brute force over all windows."""

import random
import re

from pyspark.sql import functions as F

from pagetables.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=13):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(length, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s:s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(i) for i in windows[k] if i is not None}
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def ours(docs, bench):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]))
                   for r in D.contamination(docs, bench).collect()), key=repr)


def test_against_brute_force(spark, documents):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "x9", "Zé"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 12, 13, 14, 20, 40]))) for i in range(25)]
    items += [(90, items[0][1]), (None, items[5][1]), (91, None), (92, ""), (93, "...")]
    texts = []
    for i in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            source = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(0, 5)
            parts += [" ".join(source[cut:]).upper(), text(rng.randrange(0, 9))]
        texts.append((i, " \n".join(parts), "en", "s"))
    texts += [texts[0], texts[1], (None, texts[2][1], None, None), (3, "other " + text(30), "", "")]
    docs = documents(texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert ours(docs, bench) == brute([t[:2] for t in texts], items)


def test_odd_rows_and_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ours(odd, none) == brute(rows, [])
    one = spark.createDataFrame([(1, "one TWO three"), (2, "à"), (3, "À")], "item_id bigint, text string")
    assert ours(odd, one) == brute(rows, [(1, "one TWO three"), (2, "à"), (3, "À")])
    assert D.contamination(odd.limit(0), one).count() == 0


def test_removal_keeps_columns(spark, odd):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    kept = D.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert "one two three" not in {r.text for r in kept.collect()} and kept.count() == odd.count() - 3


def test_no_python_in_the_plan(spark, odd):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    plan = D.contamination(odd, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
