"""Entry points for users: build an index, search a batch of queries, explain them, register SQL functions."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import RANKING, Ranking
from .operators import rag, rank, text
from .operators.index import doc_stats, postings, query_terms
from .operators.text import chunk_texts
from .storage import materialise


@dataclass
class Index:
    """Stored tables that queries read."""

    pages: DataFrame
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    ranks: DataFrame


def build(pages: DataFrame, links: DataFrame | None = None, live_only: bool = False, damping: float = RANKING.damping, iterations: int = RANKING.iterations) -> Index:
    """Postings, statistics and PageRank of pages (page_id, url, title, body_text, crawled_at, last_checked_at, is_dead)."""
    if live_only:
        pages = pages.where(~F.col("is_dead"))
    index = materialise(postings(pages), "postings")
    lengths = materialise(doc_stats(pages, index), "docstats")
    terms = materialise(index.groupBy("term").agg(F.count("*").alias("df")), "terms")
    corpus = lengths.agg(F.count("*").alias("total_docs"), F.avg("doc_length").alias("avg_doc_length"))
    if links is None:
        ranks = pages.select("page_id", F.lit(None).cast("double").alias("score")).limit(0)
    else:
        ranks = materialise(rank.pagerank(pages.select("page_id"), materialise(rank.edges(links, pages), "edges"), damping, iterations), "pagerank")
    return Index(pages, index, terms, lengths, corpus, ranks)


def search(index: Index, queries: DataFrame, page: int = 1, snippets: bool = True, **params) -> DataFrame:
    """Result pages for a DataFrame of queries (qid, query): qid, slot, page_id, url, title, scores, total_results, snippet.

    params override ranking parameters: k1, b, alpha, per_page, per_domain and the others of config.Ranking.
    """
    p: Ranking = replace(RANKING, **params)
    terms = materialise(query_terms(queries), "terms")
    hits = rank.bm25f(terms, index.postings, index.terms, index.lengths, index.corpus, p)
    ranked = materialise(rank.ranked(hits, index.ranks, index.pages, p), "ranked")
    totals = ranked.groupBy("qid").agg(F.count("*").alias("total_results"))
    out = rank.assembled(ranked, index.pages, page, p).join(totals, "qid").select("qid", "slot", "page_id", "url", "title", "bm25", "pagerank", "final", "total_results")
    if snippets:
        out = materialise(out, "results")
        bodies = out.join(index.pages.select("page_id", "body_text"), "page_id").select("qid", "page_id", "body_text")
        out = out.join(text.snippets(bodies, terms), ["qid", "page_id"], "left")
    return out


def explain(index: Index, queries: DataFrame, top: int = 10, **params) -> dict[str, DataFrame]:
    """The stages of a search by name: tokens, lookups, bm25, combined, freshness, ranking (its first `top`)."""
    p: Ranking = replace(RANKING, **params)
    terms = materialise(query_terms(queries), "terms")
    hits = materialise(rank.bm25f(terms, index.postings, index.terms, index.lengths, index.corpus, p), "bm25")
    both = rank.combined(hits, index.ranks, p.alpha)
    fresh = rank.linear_freshness(index.pages, p=p)
    final = both.join(fresh, "page_id").withColumn("final", F.col("combined") * F.col("boost"))
    return {
        "tokens": text.explain_tokens(queries), "lookups": terms.join(index.terms, "term", "left"), "bm25": hits, "combined": both,
        "freshness": fresh, "ranking": rank.top(final, top),
    }


def search_with_correction(index: Index, queries: DataFrame, vocab: DataFrame, **params) -> DataFrame:
    """Searches; queries without results are corrected and run again. Adds correction (null: none)."""
    first = materialise(search(index, queries, snippets=False, **params), "first")
    empty = queries.join(first.select("qid").distinct(), "qid", "left_anti")
    fixed = materialise(text.corrected(empty, vocab).where("corrected is not null"), "fixed")
    again = search(index, fixed.select("qid", F.col("corrected").alias("query")), snippets=False, **params)
    return first.withColumn("correction", F.lit(None).cast("string")).unionByName(again.join(fixed.select("qid", F.col("corrected").alias("correction")), "qid"))


def overview(index: Index, queries: DataFrame, chunks: DataFrame, embed: rag.Embedder | None = None, model=None, least_results: int = 3, least_chunks: int = 2) -> DataFrame:
    """qid, context, answer: an answer from the best chunks of each query (qid, query) that has enough results and chunks.
    chunks: chunk_id, page_id, content, embedding; embed and model are plugged in, with offline defaults."""
    terms = materialise(query_terms(queries), "terms")
    hits = materialise(rank.bm25f(terms, index.postings, index.terms, index.lengths, index.corpus), "bm25")
    enough = hits.groupBy("qid").count().where(F.col("count") >= least_results).select("qid")
    best = rag.retrieved(queries.join(enough, "qid", "left_semi"), hits.join(enough, "qid", "left_semi"), index.postings, terms, chunks, embed)
    found = best.join(chunks.select("chunk_id", "content"), "chunk_id").join(index.pages.select("page_id", "title"), "page_id")
    found = materialise(found, "found")
    full = found.groupBy("qid").count().where(F.col("count") >= least_chunks).select("qid")
    contexts = materialise(rag.context(found.join(full, "qid", "left_semi")), "contexts")
    return contexts.join(rag.answered(contexts, model), "qid")


def chat(index: Index, messages: DataFrame, chunks: DataFrame, embed: rag.Embedder | None = None, model=None, window: int = 10) -> DataFrame:
    """conv_id, query, answer: the answer to the latest question of each conversation (conv_id, turn, role, text) from its last
    `window` messages; null where too little is found."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= window).drop("rn")
    queries = materialise(rag.chat_queries(recent), "chat")
    return queries.join(overview(index, queries, chunks, embed, model), "qid", "left").select(F.col("qid").alias("conv_id"), "query", "answer")


def register(spark: SparkSession) -> None:
    """SQL functions search_tokens(text) and chunk_text(text)."""

    @F.pandas_udf("array<string>")
    def chunk_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_texts(t or ""))

    spark.udf.register("chunk_text", chunk_text)
    spark.sql(r"""
        create or replace temporary function search_tokens(t string) returns array<string> return
        filter(split(trim(regexp_replace(regexp_replace(lower(t), r'\b(\d{4})[/\-]\d{2}\b', '$1'), r'[^a-z0-9\s]', ' ')), r'\s+'), x -> length(x) between 2 and 30)""")
