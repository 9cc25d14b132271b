"""The pipeline over the smallest tables, stage by stage."""

import duckdb
import numpy as np

import __spark_entry__
import corpus_pipeline
from merchantry.llm import queries
from merchantry.llm.common import table, written


def test_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, small), name)
        assert after.columns == docs.columns
        if name != "mixing":
            assert after.count() == after.select("doc_id").distinct().count() <= before.count()
            assert after.exceptAll(before).count() == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert last.count() == before.count()
    assert last.where("n_tokens = 0").count() == before.where("text is null or trim(text) = ''").count()


def test_registered_queries_agree_with_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        want = con.sql(sql)
        got = __spark_entry__.queries()[name](spark, small)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_near_duplicates_of_the_tables(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    from tests.llm.test_llm_operators import brute_components

    want = brute_components(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_near_duplicates(spark, small).collect()}
    assert got == want
    assert np.all([a in want for a in got])
