"""Build, search, explain, correction, incremental indexing from a stream, SQL functions."""

import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators.index import postings
from lodestone.plans.retrieval import corpus
from lodestone.streaming.events import LiveIndex


@pytest.fixture(scope="module")
def index(spark, small):
    tables = corpus(spark, small)
    return api.build(tables.table("t_pages"), tables.table("t_links"))


def test_search_pages(spark, small, index):
    queries = corpus(spark, small).table("t_queries").limit(5)
    first, second = (api.search(index, queries, page=n, snippets=False).collect() for n in (1, 2))
    assert {(r.qid, r.page_id) for r in first}.isdisjoint({(r.qid, r.page_id) for r in second})
    assert max(r.slot for r in first) <= 10 and min(r.slot for r in second) == 11
    assert all(r.snippet and len(r.snippet) <= 250 for r in api.search(index, queries).collect())
    only = {r.page_id: r.final for r in api.search(index, queries, alpha=1.0, per_page=3, snippets=False).collect()}
    assert only


def test_explain(spark, small, index):
    stages = api.explain(index, corpus(spark, small).table("t_queries").limit(3), k1=2.0)
    assert set(stages) == {"tokens", "lookups", "bm25", "combined", "freshness", "ranking"}
    assert stages["ranking"].where("final > combined + 1e-9").count() == 0


def test_correction(spark, index):
    term = index.terms.where("length(term) > 6 and df > 1").orderBy("term").first().term
    queries = spark.createDataFrame([(1, term + "q"), (2, "the of")], "qid bigint, query string")
    vocab = index.terms.select(F.col("term").alias("word"))
    got = api.search_with_correction(index, queries, vocab).collect()
    assert {r.qid for r in got} == {1} and all(r.correction for r in got)


def test_stream_equals_bulk(spark, small, tmp_path):
    pages = corpus(spark, small).table("t_pages").where("page_id < 60").select("page_id", "title", "body_text")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    live = LiveIndex(spark)
    live.follow(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages")))
    live.take(pages.where("page_id < 9"))
    bulk, got = postings(pages), live.postings.select(postings(pages).columns)
    assert bulk.exceptAll(got).count() == 0 and got.exceptAll(bulk).count() == 0
    live.drop(pages.where("page_id < 10"))
    assert live.postings.where("page_id < 10").count() == 0 and live.corpus().first().total_docs <= 50


def test_functions(spark):
    api.register(spark)
    row = spark.sql("select search_tokens('Season 2024/25, Goals!') as t, chunk_text(repeat('word ', 400)) as c").first()
    assert row.t == ["season", "2024", "goals"] and len(row.c) == 1
