"""Queries with SQL agree with it; the pipeline's stages do what they say."""

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from pagetables.llm import decontaminate, langid, simhash
from pagetables.llm.common import stored
from pagetables.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare.compare(QUERIES[name](spark, SF), compare.duck(SF), ORACLES[name]) is None


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stored(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        ids, left = {r.doc_id for r in before.collect()}, {r.doc_id for r in kept.collect()}
        assert left <= ids and left
        if name == "language_id":
            rejected = {r.doc_id for r in langid.language_of(before).collect() if r.rejected}
            assert left == ids - rejected
        elif name == "line_dedup":
            seen, emptied = set(), set()
            for r in before.orderBy("doc_id").collect():
                if r.text in seen and r.text.strip():
                    emptied.add(r.doc_id)
                seen.add(r.text)
            assert not emptied & left
        elif name == "simhash_near_dedup":
            groups = simhash.simhash_groups(before).collect()
            assert left == {r.component_id for r in groups}
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(before, bench).filter(
                decontaminate.contaminated(decontaminate.F.col("n_words"), decontaminate.F.col("n_hit"))).collect()}
            assert left == ids - bad
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == packed.count() and whole.columns == packed.columns
