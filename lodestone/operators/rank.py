"""Scores: BM25F, PageRank, normalisation, combination, freshness, reranking, assembly of result pages.

Ranks within a query are only computed up to a limit, which Spark applies before it brings a query's rows together; what is
needed of all matches of a query (extremes, counts) is aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AS_OF, RANKING, Ranking
from ..storage import discard, materialise

#: Edges and nodes up to which a graph is ranked in one task; a larger one is ranked in rounds of joins.
TASK_EDGES, TASK_NODES = 4_000_000, 1_000_000
#: Edges of one source that are dealt out together.
SOURCE_EDGES = 1 << 20


def bm25f(terms: DataFrame, index: DataFrame, df: DataFrame, lengths: DataFrame, corpus: DataFrame, p: Ranking = RANKING) -> DataFrame:
    """qid, page_id, score for all queries at once. A repeated query term counts each time.

    The asked terms are written first: a small table is then known to be small, and meets the postings where they lie."""
    asked = materialise(terms.groupBy("qid", "term").agg(F.count("*").alias("times")).join(df, "term"), "asked")
    hits = index.join(asked, "term").join(lengths, "page_id").join(F.broadcast(corpus))  # corpus: one row
    weight = p.title_weight * F.col("title_freq") + p.body_weight * F.col("body_freq")
    weight = F.when(weight == 0, F.col("term_freq").cast("double")).otherwise(weight)
    idf = F.log((F.col("total_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = p.k1 * (1 - p.b + p.b * F.col("doc_length") / F.col("avg_doc_length"))
    return hits.groupBy("qid", "page_id").agg(F.sum(F.col("times") * idf * weight * (p.k1 + 1) / (weight + norm)).alias("score"))


def edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct edges (s, t) between known pages."""
    known = pages.select(F.col("page_id").alias("t"), "url")
    return links.join(known, links["target_url"] == known["url"]).select(F.col("source_id").alias("s"), "t").join(pages.select(F.col("page_id").alias("s")), "s", "left_semi").distinct()


def pagerank(nodes: DataFrame, graph: DataFrame, damping: float = RANKING.damping, iterations: int = RANKING.iterations) -> DataFrame:
    """page_id, score after a fixed number of rounds. A graph of a checked, small size is ranked in one task; a larger one in
    rounds of joins. Edges to unknown pages count as links of their source and lead nowhere."""
    n = nodes.count()
    if not n:
        return nodes.select("page_id", F.lit(0.0).alias("score"))
    small = n <= TASK_NODES and graph.limit(TASK_EDGES + 1).count() <= TASK_EDGES
    return (_in_one_task if small else _in_rounds)(nodes, graph, n, damping, iterations)


def _in_one_task(nodes: DataFrame, graph: DataFrame, n: int, damping: float, iterations: int) -> DataFrame:
    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        ids = np.sort(own["page_id"].to_numpy())
        place = lambda x: np.minimum(np.searchsorted(ids, x), n - 1)
        source, target = links["s"].to_numpy(), links["t"].to_numpy()
        known = ids[place(source)] == source
        source, target = place(source[known]), target[known]
        outs = np.bincount(source, minlength=n)
        share = 1.0 / outs[source]
        known = ids[place(target)] == target
        source, target, share = source[known], place(target[known]), share[known]
        score = np.full(n, 1.0 / n)
        for _ in range(iterations):
            score = (1 - damping) / n + damping * score[outs == 0].sum() / n + damping * np.bincount(target, score[source] * share, n)
        return pa.table({"page_id": pa.array(ids, pa.int64()), "score": pa.array(score)})

    whole = lambda df: df.withColumn("graph", F.lit(0)).groupBy("graph")
    return whole(nodes.select(F.col("page_id").cast("bigint"))).cogroup(whole(graph.select(F.col("s").cast("bigint"), F.col("t").cast("bigint")))).applyInArrow(run, "page_id bigint, score double")


def _in_rounds(nodes: DataFrame, graph: DataFrame, n: int, damping: float, iterations: int) -> DataFrame:
    """Edges are dealt out once by source, a hot source's in parts, and kept so; a round is one job, in which the mass of pages
    without links is a one-row side, and its ranks are written, which bounds what a loss can cost."""
    outs = graph.groupBy("s").agg(F.count("*").alias("o"))
    linking = materialise(nodes.join(outs.select(F.col("s").alias("page_id"), "o"), "page_id", "left").select("page_id", F.coalesce("o", F.lit(0)).alias("o")), "nodes")
    parts = F.ceil(F.col("o") / SOURCE_EDGES)
    weighted = graph.join(outs, "s").select(F.col("s").alias("page_id"), "t", (1.0 / F.col("o")).alias("share"), F.pmod(F.xxhash64("t"), parts).alias("part"))
    weighted = materialise(weighted, "edges").repartition("page_id", "part").persist()
    ranks = materialise(linking.withColumn("score", F.lit(1.0 / n)), "ranks")
    for _ in range(iterations):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("o") == 0, F.col("score"))), F.lit(0.0)).alias("loose"))  # one row
        spread = ranks.where("o > 0").select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), "score")
        got = weighted.join(spread, ["page_id", "part"]).groupBy(F.col("t").alias("page_id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - damping) / n + damping * F.col("loose") / n + damping * F.coalesce("got", F.lit(0.0))
        before, ranks = ranks, materialise(linking.join(got, "page_id", "left").crossJoin(F.broadcast(loose)).select("page_id", "o", score.alias("score")), "ranks")
        discard(before)
    weighted.unpersist()
    return ranks.select("page_id", "score")


def scaled(score: Column, low: Column, high: Column) -> Column:
    """Min-max; 1 where all scores are equal; null stays null."""
    return F.when(score.isNull(), None).when(high == low, 1.0).otherwise((score - low) / (high - low))


def normalised(df: DataFrame, by: str, **scores: str) -> DataFrame:
    """df with columns that hold other columns' min-max over all rows of a group; extremes are aggregated and joined."""
    marks = {out: (f"{out}_low", f"{out}_high") for out in scores}
    extremes = [x for out, c in scores.items() for x in (F.min(c).alias(marks[out][0]), F.max(c).alias(marks[out][1]))]
    met = df.join(df.groupBy(by).agg(*extremes), by)
    return met.select(*df.columns, *(scaled(F.col(c), *map(F.col, marks[out])).alias(out) for out, c in scores.items()))


def combined(bm25: DataFrame, ranks: DataFrame, alpha: float = RANKING.alpha) -> DataFrame:
    """qid, page_id, bm25, pagerank, combined."""
    both = bm25.withColumnRenamed("score", "bm25").join(ranks.withColumnRenamed("score", "pagerank"), "page_id", "left").select("qid", "page_id", "bm25", "pagerank")
    out = normalised(materialise(both, "matches"), "qid", b="bm25", p="pagerank")
    return out.select("qid", "page_id", "bm25", "pagerank", (alpha * F.col("b") + (1 - alpha) * F.coalesce("p", F.lit(0.0))).alias("combined"))


def age_days(ts: Column, as_of: str = AS_OF) -> Column:
    days = F.timestamp_diff("DAY", ts, F.lit(as_of).cast("timestamp"))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def freshness(pages: DataFrame, as_of: str = AS_OF, p: Ranking = RANKING) -> DataFrame:
    """page_id, days, boost: exponential decay, with a bonus for the newest pages; no time, no change."""
    days = age_days(F.coalesce("last_checked_at", "crawled_at"), as_of)
    decay = p.freshness_floor + (1 - p.freshness_floor) * F.exp(-days * p.freshness_decay)
    boost = F.when(days < p.fresh_days, F.least(decay * p.fresh_bonus, F.lit(p.fresh_cap))).otherwise(decay)
    return pages.select("page_id", days.alias("days"), F.coalesce(boost, F.lit(1.0)).alias("boost"))


def linear_freshness(pages: DataFrame, as_of: str = AS_OF, p: Ranking = RANKING) -> DataFrame:
    """The explain view's rule: linear on the crawl time, without bonus."""
    days = F.timestamp_diff("DAY", F.col("crawled_at"), F.lit(as_of).cast("timestamp"))
    return pages.select("page_id", days.alias("days"), F.coalesce(F.greatest(F.lit(p.freshness_floor), 1.0 - days * p.freshness_decay), F.lit(1.0)).alias("boost"))


def best_first(score: str = "final") -> list[Column]:
    return [F.desc(F.round(score, 12)), F.col("page_id")]


def ranked(bm25: DataFrame, ranks: DataFrame, pages: DataFrame, p: Ranking = RANKING) -> DataFrame:
    """qid, page_id, bm25, pagerank, combined, days, boost, final of all matches."""
    return combined(bm25, ranks, p.alpha).join(freshness(pages, p=p), "page_id").withColumn("final", F.col("combined") * F.col("boost"))


def top(scored: DataFrame, n: int, score: str = "final") -> DataFrame:
    """The n best of each query, with their position."""
    order = Window.partitionBy("qid").orderBy(*best_first(score))
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


#: Scores of (query, text) pairs, higher is better; None: no model.
Reranker = Callable[[list[tuple[str, str]]], "list[float] | None"]


def reranked(scored: DataFrame, queries: DataFrame, pages: DataFrame, model: Reranker | None = None, score: str = "final", p: Ranking = RANKING) -> DataFrame:
    """qid, page_id, position, rerank_score, reranked (the new position) of each query's best, those at the cut or below left
    out. The model sees the query and the title with the first 300 characters of the body. Without one, or where it fails, scores
    are null and the order stays."""
    best = top(scored, p.rerank_top, score).join(queries.select("qid", "query"), "qid").join(pages.select("page_id", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("body_text", F.lit("")), 1, 300)).alias("seen")), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model(list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))) if model else None
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(got or [None] * batch.num_rows, pa.float64())], ["qid", "page_id", "position", "rerank_score"])

    rows = best.select(F.col("qid").cast("bigint"), F.col("page_id").cast("bigint"), F.col("position").cast("int"), "query", "seen")
    made = rows.mapInArrow(run, "qid bigint, page_id bigint, position int, rerank_score double") if model else rows.select("qid", "page_id", "position", F.lit(None).cast("double").alias("rerank_score"))
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "position")
    kept = made.where(F.col("rerank_score").isNull() | (F.col("rerank_score") > p.rerank_cut))
    return kept.withColumn("reranked", F.row_number().over(order).cast("int"))


def overlap_model(pairs: list[tuple[str, str]]) -> list[float]:
    """An offline stand-in for a cross-encoder: the logit of the share of the query's words that the text has, between -9 and 9."""
    out = []
    for query, text in pairs:
        words = set((query or "").lower().split())
        share = len(words & set((text or "").lower().split())) / max(1, len(words))
        out.append(18.0 * share - 9.0)
    return out


def assembled(results: DataFrame, pages: DataFrame, page: int = 1, p: Ranking = RANKING) -> DataFrame:
    """The result page: at most two of a domain, greedy in rank order, which is a rank within the domain."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"www\.", "")
    known = results.join(pages.select("page_id", "url", "title"), "page_id").withColumn("host", host)
    within = Window.partitionBy("qid", "host").orderBy(*best_first())
    kept = known.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= p.per_domain)
    slot = F.row_number().over(Window.partitionBy("qid").orderBy(*best_first()))
    return kept.withColumn("slot", slot).where((F.col("slot") <= page * p.per_page) & (F.col("slot") > (page - 1) * p.per_page))
