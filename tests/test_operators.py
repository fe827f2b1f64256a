"""Operators on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import crawl, intent, rag, rank
from lodestone.operators.index import doc_stats, postings, query_terms
from lodestone.operators.text import corrected


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, title string, body_text string")


def scores(spark, docs, query):
    p = pages(spark, docs)
    index = postings(p)
    lengths = doc_stats(p, index)
    corpus = lengths.agg(F.count("*").alias("total_docs"), F.avg("doc_length").alias("avg_doc_length"))
    terms = query_terms(spark.createDataFrame([(1, query)], "qid bigint, query string"))
    got = rank.bm25f(terms, index, index.groupBy("term").agg(F.count("*").alias("df")), lengths, corpus)
    return {r.page_id: r.score for r in got.collect()}


def test_bm25f(spark):
    docs = [(1, "goal", "match report"), (2, "news", "goal goal match"), (3, "", "weather"), (4, None, None)]
    once = scores(spark, docs, "goal")
    assert set(once) == {1, 2} and once[1] > once[2]  # a title counts four times
    assert scores(spark, docs, "goal goal") == {k: pytest.approx(2 * v) for k, v in once.items()}
    assert scores(spark, docs, "unknown") == {} and scores(spark, [], "goal") == {}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize(("n", "edges"), [(3, [(0, 1), (1, 2), (2, 0)]), (4, [(0, 1), (1, 1), (0, 2)]), (2, []), (40, [(0, t) for t in range(40)] + [(t, 0) for t in range(1, 30)])])
def test_pagerank(spark, monkeypatch, n, edges, small):
    """Both ways, hot sources in parts."""
    monkeypatch.setattr(rank, "TASK_EDGES", 1000 if small else -1)
    monkeypatch.setattr(rank, "SOURCE_EDGES", 7)
    nodes = spark.range(n).withColumnRenamed("id", "page_id")
    got = {r.page_id: r.score for r in rank.pagerank(nodes, spark.createDataFrame(edges, "s bigint, t bigint")).collect()}
    now = [1 / n] * n
    for _ in range(20):
        loose = sum(now[i] for i in range(n) if not any(s == i for s, _ in edges))
        now = [0.15 / n + 0.85 * loose / n + 0.85 * sum(now[s] / sum(x == s for x, _ in edges) for s, t in edges if t == i) for i in range(n)]
    assert got == {i: pytest.approx(x, abs=1e-12) for i, x in enumerate(now)} and sum(got.values()) == pytest.approx(1)


def test_no_pages(spark):
    assert rank.pagerank(spark.range(0).withColumnRenamed("id", "page_id"), spark.createDataFrame([], "s bigint, t bigint")).count() == 0


def test_normalised(spark):
    rows = rank.normalised(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (3, None), (3, 1.0)], "q int, s double"), "q", n="s").collect()
    assert {(r.q, r.s): r.n for r in rows} == {(1, 2.0): 0.0, (1, 4.0): 1.0, (2, 3.0): 1.0, (3, None): None, (3, 1.0): 1.0}


def test_freshness(spark):
    ages = [0, 6, 7, 30, 90, 400, -5, None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "page_id bigint, age int")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    got = rank.freshness(rows.select("page_id", (now - F.make_dt_interval(F.col("age"))).alias("crawled_at"), F.lit(None).cast("timestamp").alias("last_checked_at"))).orderBy("page_id").collect()
    import math

    want = [min(1.2, 1.15 * (0.5 + 0.5 * math.exp(-0.02 * max(a, 0)))) if a < 7 else 0.5 + 0.5 * math.exp(-0.02 * a) for a in ages[:-1]] + [1.0]
    assert [r.boost for r in got] == [pytest.approx(w) for w in want]


def test_domain_cap(spark):
    hits = spark.createDataFrame([(1, i, -float(i)) for i in range(1, 9)], "qid bigint, page_id bigint, final double")
    urls = spark.createDataFrame([(i, f"https://www.h{i % 3}.org/{i}", "t") for i in range(1, 9)], "page_id bigint, url string, title string")
    got = rank.assembled(hits, urls).orderBy("slot").collect()
    assert [r.page_id for r in got] == [1, 2, 3, 4, 5, 6]


def test_spelling(spark):
    vocab = spark.createDataFrame([("goal",), ("goat",), ("keeper",)], "word string")
    rows = spark.createDataFrame([(1, "goal"), (2, "gaol keper"), (3, "xyzzyq"), (4, "ab"), (5, "goa")], "qid bigint, query string")
    assert {r.qid: r.corrected for r in corrected(rows, vocab).collect()} == {1: None, 2: "goal keeper", 3: None, 4: None, 5: "goal"}


def test_html():
    page = '<html><head><title> A </title><title>B</title></head><body><nav>menu <a href="/n">n</a></nav>tail gone<div class="stock">no</div><div class="ad">yes</div><main><p>One [1] two [Edit]</p><table><tr><td>9</td></tr></table>lost <a href="rel#f">l</a><a href="#x">x</a><a href="mailto:a">m</a></main></body></html>'
    got = crawl.parse_html("https://h.org/d/p", page)
    assert got["title"] == "A" and got["body_text"] == "One two lxm" and got["links"] == ["https://h.org/d/rel"]
    assert crawl.parse_html("https://h.org", "")["body_text"] == ""
    assert crawl.clean_text("a" * 600 + " References b") == "a" * 600 and "References" in crawl.clean_text("a" * 400 + " References b")


def test_scope(spark):
    rows = [("https://en.wikipedia.org/wiki/Tea", 1, True), ("https://en.wikipedia.org/wiki/Tea", 2, False), ("https://en.wikipedia.org/wiki/FIFA", 3, True), ("https://bet365.com/x", 0, False), ("https://www.bet365.com/x", 0, False), ("https://fbref.com", 0, False), ("https://fbref.com/x", 0, True)]
    df = spark.createDataFrame(rows, "url string, depth int, want boolean").withColumn("got", crawl.in_scope(F.col("url"), F.col("depth")))
    assert df.where("got <> want").count() == 0
    free = crawl.in_scope(F.lit("https://www.bet365.com/x"), F.lit(0), restrict=False)
    assert spark.range(1).select(free.alias("f")).first().f


def test_intent(spark):
    want = {"man utd next match": ("upcoming", 33, None), "premier league table": ("standings", None, 39), "scorer list": ("live", None, None), "liverpool": ("live", 40, None), "arsenal": ("upcoming", 42, None), "arsenal history": (None, 42, None), "real madrid vs barcelona": ("h2h", 529, None), "table": (None, None, None)}
    got = {r.query: (r.action, r.team_id, r.league_id) for r in intent.detected(spark.createDataFrame([(q,) for q in want], "query string")).collect()}
    assert {q: got[q][0] for q in want} == {q: w[0] for q, w in want.items()}
    assert got["man utd next match"] == want["man utd next match"] and got["premier league table"] == want["premier league table"]


def test_hybrid(spark):
    vectors = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 10, 0.8), (1, 3, 20, 0.7), (2, 4, 30, 0.6)], "qid bigint, chunk_id bigint, page_id bigint, sim double")
    keyword = spark.createDataFrame([(1, 20, 5.0), (1, 30, 3.0)], "qid bigint, page_id bigint, score double")
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "chunk_id bigint, page_id bigint")
    got = {r.chunk_id: (r.rn, round(r.combined, 6)) for r in rag.hybrid(vectors, keyword, chunks).where("qid = 1").collect()}
    assert [(r.qid, r.chunk_id) for r in rag.hybrid(vectors, keyword, chunks).where("qid = 2").collect()] == [(2, 4)]
    assert got == {1: (1, 0.6), 3: (2, 0.4), 4: (3, 0.0)}


def test_embedding_batches(spark):
    rows = spark.createDataFrame([(i, f"text {i}", None) for i in range(120)], "chunk_id bigint, content string, embedding array<float>").coalesce(1)
    sizes = rag.embedded(rows, lambda b: [[float(len(b))]] * len(b) if len(b) == 50 else None).collect()
    assert sum(r.embedding is not None for r in sizes) == 100


def test_rerank(spark):
    scored = spark.createDataFrame([(1, i, float(-i)) for i in range(8)] + [(2, 3, 1.0)], "qid bigint, page_id bigint, final double")
    pages = spark.createDataFrame([(i, "goal" if i == 3 else "news", "the final match" if i != 1 else "zzz") for i in range(8)], "page_id bigint, title string, body_text string")
    queries = spark.createDataFrame([(1, "goal final"), (2, "final")], "qid bigint, query string")
    none = rank.reranked(scored, queries, pages).collect()
    assert {(r.qid, r.page_id): (r.position, r.reranked, r.rerank_score) for r in none} == {**{(1, i): (i + 1, i + 1, None) for i in range(5)}, (2, 3): (1, 1, None)}
    got = {(r.qid, r.page_id): r.reranked for r in rank.reranked(scored, queries, pages, rank.overlap_model).collect()}
    assert got == {(1, 0): 1, (1, 2): 2, (1, 3): 3, (1, 4): 4, (2, 3): 1}  # page 1 has no word of the query: cut; titles end in a full stop
    assert all(r.rerank_score is None for r in rank.reranked(scored, queries, pages, lambda pairs: None).collect())


def test_nearest_words(spark):
    """All pairs within two edits, against a comparison of every pair."""
    import random

    from lodestone.operators.text import nearest_words

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(250)})
    asked, vocab = words[::3], words[1::2]
    a, b = (spark.createDataFrame([(w,) for w in x], "word string") for x in (asked, vocab))
    want = {(r.word, r.other, r.d) for r in a.crossJoin(b.withColumnRenamed("word", "other")).select("word", "other", F.levenshtein("word", "other").alias("d")).where("d <= 2").collect()}
    assert {(r.word, r.candidate, r.distance) for r in nearest_words(a, b).collect()} == want and len(want) > 100


def test_vectors(spark, monkeypatch):
    """Blocks of any size give what a comparison of all pairs gives; the approximate index finds most of it."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[:60] = x[60:120] + 0.1 * rng.standard_normal((60, 16))
    rows = [(i, i % 7, x[i].tolist() if i % 11 else None) for i in range(300)] + [(300, 0, [0.0] * 16), (301, 0, [1.0] * 4)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, page_id bigint, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(q, q + 100, x[q].tolist()) for q in range(40)], "qid bigint, vid bigint, embedding array<float>")
    own = {i: np.array(v, np.float32).astype(float) for i, _, v in rows if v and len(v) == 16}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in own.items()}
    want = {}
    for q in range(40):
        v = x[q].astype(np.float32).astype(float)
        best = sorted((-round(float(u @ v / np.linalg.norm(v)), 9), i) for i, u in unit.items())[:10]
        want |= {(q, q + 100, k + 1): i for k, (_, i) in enumerate(best)}
    for size in (4096, 7):
        monkeypatch.setattr(rag, "CHUNKS", size)
        assert {(r.qid, r.vid, r.rn): r.chunk_id for r in rag.vector_search(queries, chunks).collect()} == want
    near = {(r.qid, r.chunk_id) for r in rag.approximate_search(queries, chunks, 1).collect()}
    assert sum((q, c) in near for (q, _, k), c in want.items() if k == 1) >= 36


def test_html_rules(spark):
    """Noise, boilerplate, main content and links on pages that have them."""
    raw = [
        (1, "https://www.bbc.com/sport/1", "<body><article>News <script>bad()</script>text<a href='/x'>x</a></article><div>other</div></body>"),
        (2, "https://example.org/a/b", "<body><header>top</header><div class='sidebar'>side</div><main>Main <a href='../c#z'>c</a><a href='tel:1'>t</a></main></body>"),
        (3, "https://example.org/", "<body><style>s</style><p>plain</p><a href='https://other.org/p'>o</a></body>"),
    ]
    got = {r.page_id: r for r in crawl.parsed_pages(spark.createDataFrame(raw, "page_id bigint, url string, html string")).collect()}
    assert got[1].body_text == "News x" and got[1].links == ["https://www.bbc.com/x"]
    assert "top" not in got[2].body_text and "side" not in got[2].body_text and got[2].body_text.startswith("Main") and got[2].links == ["https://example.org/c"]
    assert got[3].links == ["https://other.org/p"] and "plain" in got[3].body_text


def test_places(spark):
    from lodestone.operators import order

    rows = spark.createDataFrame([(i * 7 % 101, float(i % 3)) for i in range(101)], "k bigint, v double").repartition(5)
    got = {r.k: r.place for r in order.placed(rows, F.desc("v"), F.col("k")).collect()}
    want = sorted(((-float(i % 3), i * 7 % 101) for i in range(101)))
    assert got == {k: i + 1 for i, (_, k) in enumerate(want)}
    for block in (1 << 17, 10, 7):
        sums = {r.k: r.s for r in order.following_sum(order.placed(rows, F.col("k")), "v", 6, "s", block=block).collect()}
        v = [x for _, x in sorted((r.k, r.v) for r in rows.collect())]
        assert sums == {i: sum(v[i : i + 7]) for i in range(101)}
    assert order.placed(rows.limit(0), F.col("k")).count() == 0
