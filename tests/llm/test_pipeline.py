"""Each stage on its own input, and the registered queries."""

import pytest

import corpus_pipeline
from tablescope.llm import hamming_trees, queries
from tablescope.llm.shared import written
from tablescope.llm.tokens import word_ids

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], FOLDER), name))
    return tables


def test_order_of_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "packing"]


def test_columns_stay(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])
    counts = [t.count() for t in stages[:-1]]
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0


def test_one_document_of_each_group_stays(stages):
    members = hamming_trees.document_components(stages[1])
    wanted = {r.component_id for r in members.select("component_id").distinct().collect()}
    assert {r.doc_id for r in stages[2].collect()} == wanted


def test_no_benchmark_passage_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r.doc_id for r in stages[2].collect() if any(i in (r.text or "") for i in items)}
    after = {r.doc_id for r in stages[3].collect()}
    assert before and not before & after
    assert len(after) >= stages[2].count() - len(before) - 2


def test_every_id_is_packed(stages):
    pieces = stages[5].collect()
    total = sum(len(word_ids().of_texts(__import__("pyarrow").array([r.text or ""]))[0]) + 1 for r in stages[4].collect())
    assert sum(p.length for p in pieces) == total
    assert {p.doc_id for p in pieces} == {r.doc_id for r in stages[4].collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns[:2] == ["doc_id", "start"]


def test_one_query_for_each_operator():
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
