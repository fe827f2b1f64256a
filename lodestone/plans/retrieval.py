"""Queries with operators of their own: text, ranking, retrieval, crawling, intent, streams; with independent oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AS_OF, CRAWL, RANKING, RETRIEVAL
from ..functions import fixed
from ..functions.sql import quoted
from ..functions.text import duck_stems, duck_tokens, sentences, tokens
from ..operators import crawl, intent, order, rag, rank, text
from ..operators.index import reindex, without_pages
from ..sources import logical
from ..sources.logical import Corpus, duck
from ..storage import materialise
from ..streaming import events as streams

NOW = f"TIMESTAMP '{AS_OF}'"
R6 = "cast(round({}, 6) as double)".format
A, FLOOR, DECAY = RANKING.alpha, RANKING.freshness_floor, RANKING.freshness_decay

# --- further logical tables: DuckDB text here, Spark properties below -------------------------------------------------

logical.EXTRA.update({
    "t_vsim": "select q.vid, c.chunk_id, c.page_id, list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])) as sim from t_queryvec q, t_vchunks c where c.embedding is not null",
    "t_fansim": "select q.qid, q.vid, c.chunk_id, c.page_id, list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])) as sim from t_fanvec q, t_vchunks c where c.embedding is not null",
    "t_fantop": f"select * from (select *, row_number() over (partition by qid, vid order by round(sim, 9) desc, chunk_id) as rn from t_fansim) where rn <= {RETRIEVAL.vector_top}",
    "t_rerank": f"""select qid, page_id, cast(position as integer) as position, 18.0::double * found / greatest(n, 1) - 9 as rerank_score from (
        select r.qid, r.page_id, r.position, len(qw) as n, len(list_intersect(qw, list_distinct(string_split_regex(trim(lower(p.title || '. ' || left(p.body_text, 300))), '\\s+')))) as found
        from t_ranked r join t_pages p on p.page_id = r.page_id join (select qid, list_distinct(list_filter(string_split_regex(trim(lower(query)), '\\s+'), lambda x: x <> '')) as qw from t_queries) q on q.qid = r.qid where r.position <= {RANKING.rerank_top})""",
    "t_sptok": f"select qid, unnest(ws) as w0 from (select qid, {duck_tokens('query')} as ws from t_spell)",
    "t_vtop": f"select * from (select *, row_number() over (partition by vid order by round(sim, 9) desc, chunk_id) as rn from t_vsim) where rn <= {RETRIEVAL.vector_top}",
    "t_fresh": f"""select page_id, greatest(datesub('day', coalesce(last_checked_at, crawled_at), {NOW}), 0) as days,
        case when days < 7 then least(1.15::double * ({FLOOR}::double + {1 - FLOOR}::double * exp(-{DECAY}::double * days)), 1.2::double) else {FLOOR}::double + {1 - FLOOR}::double * exp(-{DECAY}::double * days) end as boost from t_pages""",
    "t_combined": f"""select qid, page_id, bm25, pagerank, {A}::double * case when bh = bl then 1 else (bm25 - bl) / (bh - bl) end
            + {1 - A}::double * coalesce(case when pagerank is null then null when ph = pl then 1 else (pagerank - pl) / (ph - pl) end, 0) as combined
        from (select b.qid, b.page_id, b.score as bm25, r.score as pagerank, min(b.score) over q as bl, max(b.score) over q as bh, min(r.score) over q as pl, max(r.score) over q as ph
              from t_bm25 b left join t_pagerank r on r.page_id = b.page_id window q as (partition by b.qid))""",
    "t_ranked": "select *, row_number() over (partition by qid order by round(final, 12) desc, page_id) as position from (select c.*, f.days, f.boost, combined * boost as final from t_combined c join t_fresh f on f.page_id = c.page_id)",
    "t_results": f"""select * from (select *, row_number() over (partition by qid order by position) as slot from (
        select r.*, p.url, p.title, p.body_text, row_number() over (partition by qid, replace(p.domain, 'www.', '') order by position) as nth from t_ranked r join t_pages p on p.page_id = r.page_id)
        where nth <= {RANKING.per_domain}) where slot <= {RANKING.per_page}""",
    "t_vocab": """select word from (select regexp_replace(lower(w), '[^a-z]', '', 'g') as word from (select unnest(string_split_regex(trim(title), '\\s+')) as w from t_pages where not is_dead)) where length(word) between 3 and 20
        union select term from t_terms where length(term) between 3 and 20""",
    "t_spell": "select p_partkey as qid, case p_partkey % 3 when 0 then left(p_name, 2) || substr(p_name, 4) when 1 then p_name else p_name || 'x' end as query from part",
    "t_units": f"""select page_id, row_number() over (partition by page_id order by pi, si) as pos, words from (
        select page_id, pi, generate_subscripts(ss, 1) as si, list_filter(string_split_regex(trim(unnest(ss)), '\\s+'), lambda x: x <> '') as words from (
            select page_id, pi, case when len(list_filter(string_split_regex(trim(para), '\\s+'), lambda x: x <> '')) <= {RETRIEVAL.chunk_words} then [para]
                else string_split(regexp_replace(trim(para), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) end as ss
            from (select page_id, generate_subscripts(ps, 1) as pi, unnest(ps) as para from (select page_id, string_split_regex(title || '. ' || body_text, '\\n\\s*\\n|\\.\\s{{2,}}') as ps from t_pages)))) where len(words) > 0""",
    "t_bfs": f"""select page_id, min(depth) as depth from (with recursive walk(page_id, depth) as (select page_id, 0 from t_pages where page_id < 5 union
        select e.t, w.depth + 1 from walk w join t_edges e on e.s = w.page_id where w.depth < {CRAWL.max_depth}) select * from walk) group by 1""",
})

SPELL = "select p_partkey as qid, case p_partkey % 3 when 0 then left(p_name, 2) || substr(p_name, 4) when 1 then p_name else p_name || 'x' end as query from part"
SPORTS = ["man utd next match", "premier league table", "scorer list", "liverpool", "arsenal", "arsenal history", "real madrid vs barcelona", "table", "La Liga", "epl standings", "when do chelsea play", "winter sale", "romania", "bayern h2h dortmund", "world cup", ""]


def _results(c: Corpus) -> DataFrame:
    return rank.assembled(c.t_ranked, c.table("t_pages"))


class More(Corpus):
    """The corpus with the tables that this module's queries share."""

    @cached_property
    def t_vtop(self) -> DataFrame:
        return materialise(rag.vector_search(self.table("t_queryvec"), self.table("t_vchunks")), "vtop")

    @cached_property
    def t_vsim(self) -> DataFrame:
        return rag.similarities(self.table("t_queryvec"), self.table("t_vchunks"))

    @cached_property
    def t_fantop(self) -> DataFrame:
        return materialise(rag.vector_search(self.table("t_fanvec"), self.table("t_vchunks")), "fantop")

    @cached_property
    def t_bfs(self) -> DataFrame:
        return materialise(crawl.levels(self.table("t_pages").where("page_id < 5"), self.t_edges), "bfs")

    @cached_property
    def t_rerank(self) -> DataFrame:
        scored = rank.reranked(self.t_ranked, self.table("t_queries"), self.table("t_pages"), rank.overlap_model, p=replace(RANKING, rerank_cut=float("-inf")))
        return materialise(scored.select("qid", "page_id", "position", "rerank_score"), "rerank")

    @cached_property
    def t_ranked(self) -> DataFrame:
        return materialise(rank.ranked(self.t_bm25, self.t_pagerank, self.table("t_pages")), "ranked")

    @cached_property
    def t_results(self) -> DataFrame:
        return materialise(_results(self), "results")

    @cached_property
    def t_vocab(self) -> DataFrame:
        return materialise(self.sql(RELATIONAL_VOCAB), "vocab")

    @cached_property
    def t_spell(self) -> DataFrame:
        return self.sql(SPELL)


def corpus(spark: SparkSession, sf_dir: str) -> More:
    return More.of(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(build: Callable[[More], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(corpus(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return build

    return wrap


def plain(name: str, sql: str) -> None:
    """One text for both engines, over tables that each builds in its own way."""
    query(name, sql)(lambda c: c.sql(sql))


from .relational import QUERIES as _RELATIONAL  # noqa: E402

RELATIONAL_VOCAB = _RELATIONAL["h2_vocabulary"]


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- text core --------------------------------------------------------------------------------------------------------


@query("j1_tokenize", f"select page_id, cast(len(ws) as bigint) as n, md5(array_to_string(ws, ' ')) as words from (select page_id, {duck_tokens('body_text')} as ws from t_pages)")
def _j1(c):
    return c.table("t_pages").select("page_id", tokens("body_text").alias("ws")).select("page_id", F.size("ws").cast("bigint").alias("n"), F.md5(F.array_join("ws", " ")).alias("words"))


plain("j3_stem", "select w0 as word, w as term from t_stems where w0 in (select w0 from t_tok)")
plain("j10_build_index", "select page_id, term, term_freq, title_freq, body_freq from t_postings")
plain("j2_stopwords", f"select w0 from (select distinct w0 from t_tok) t where w0 in ({quoted(fixed.STOPWORDS)})")


@query("j4_explain_tokens", f"""
    with w as (select qid, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as w0 from (select qid, string_split_regex(trim(regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g')), '\\s+') as ws from t_queries)),
    s as ({duck_stems("select distinct w0 from w where w0 <> ''")})
    select qid, pos, w.w0 as word, kept, case when kept then s.w end as term from (select *, w0 not in ({quoted(fixed.STOPWORDS)}) and length(w0) > 1 as kept from w where w0 <> '') w join s on s.w0 = w.w0""")
def _j4(c):
    return text.explain_tokens(c.table("t_queries"))


@query("i3_sentences", "select page_id, cast(len(ss) as bigint) as n, ss[1] as first from (select page_id, string_split(regexp_replace(body_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss from t_pages)")
def _i3(c):
    return c.table("t_pages").select("page_id", sentences(F.col("body_text")).alias("ss")).select("page_id", F.size("ss").cast("bigint").alias("n"), F.element_at("ss", 1).alias("first"))


@query("f7_positions", f"select page_id, pos, w0 from (select page_id, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as w0 from (select page_id, {duck_tokens('title')} as ws from t_pages))")
def _f7(c):
    return c.table("t_pages").select("page_id", F.posexplode(tokens("title")).alias("pos", "w0"))


@query("j5_snippet", f"""
    with s as (select qid, page_id, generate_subscripts(ss, 1) - 1 as i, unnest(ss) as sent from (
        select qid, page_id, string_split(regexp_replace(left(trim(regexp_replace(regexp_replace(regexp_replace(body_text, '\\[\\d+\\]', '', 'g'), '\\[edit\\]', '', 'g'), '\\s+', ' ', 'g')), 3000), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss from t_results)),
    w as (select qid, page_id, i, unnest(string_split_regex(lower(sent), '\\s+')) as w0 from s),
    st as ({duck_stems("select distinct w0 from w where w0 <> ''")}),
    n as (select w.qid, w.page_id, i, count(*) as n from w join st on st.w0 = w.w0 where exists (select 1 from t_qterms q where q.qid = w.qid and q.term = st.w) group by all),
    best as (select s.qid, s.page_id, arg_max(s.i, coalesce(n.n, 0) + case when s.i < 3 then 0.5 else 0 end - s.i * 1e-7) as i from s left join n on n.qid = s.qid and n.page_id = s.page_id and n.i = s.i group by 1, 2)
    select b.qid, b.page_id, left(case when length(trim(s.sent)) < 100 and x.sent is not null then trim(s.sent) || ' ' || trim(x.sent) else trim(s.sent) end, 250) as snippet
    from best b join s on s.qid = b.qid and s.page_id = b.page_id and s.i = b.i left join s x on x.qid = b.qid and x.page_id = b.page_id and x.i = b.i + 1 where length(s.sent) > 0""")
def _j5(c):
    return text.snippets(c.t_results.join(c.table("t_pages").select("page_id", "body_text"), "page_id").select("qid", "page_id", "body_text"), c.t_qterms)


plain("j6_levenshtein", "select w0 as word, w as other, case when levenshtein(w0, w) <= 2 then cast(levenshtein(w0, w) as bigint) else 3 end as distance from t_stems where w0 in (select w0 from t_tok)")
plain("j7_vocabulary", "select word, cast(length(word) as bigint) as n from t_vocab")

_BANDED = "select u.word, v.word as candidate, cast(levenshtein(u.word, v.word) as bigint) as distance from u join t_vocab v on abs(length(u.word) - length(v.word)) <= 2 and levenshtein(u.word, v.word) <= 2"
_UNKNOWN = "u as (select distinct word from (select regexp_replace(lower(w), '[^a-z]', '', 'g') as word from (select unnest(string_split_regex(trim(query), '\\s+')) as w from t_spell)) where length(word) >= 3 and word not in (select word from t_vocab))"


def _unknown(c):
    words = c.t_spell.select(F.explode(F.split(F.trim(F.lower("query")), r"\s+")).alias("w")).select(F.regexp_replace("w", "[^a-z]", "").alias("word")).where("length(word) >= 3").distinct()
    return words.join(c.t_vocab, "word", "left_anti")


@query("d16_fuzzy_band_join", f"with {_UNKNOWN} {_BANDED}")
def _d16(c):
    return text.nearest_words(_unknown(c), c.t_vocab).withColumn("distance", F.col("distance").cast("bigint"))


@query("j8_correct_query", f"""
    with {_UNKNOWN}, n as ({_BANDED}), best as (select word, candidate from (select *, row_number() over (partition by word order by distance, length(candidate), candidate) as rn from n) where rn = 1),
    w as (select qid, query, generate_subscripts(ws, 1) as pos, unnest(ws) as raw from (select qid, query, string_split_regex(trim(lower(query)), '\\s+') as ws from t_spell))
    select qid, query, case when count(candidate) > 0 then string_agg(coalesce(candidate, raw), ' ' order by pos) end as corrected from w left join best on best.word = regexp_replace(raw, '[^a-z]', '', 'g') and length(best.word) >= 3 group by qid, query""")
def _j8(c):
    return text.corrected(c.t_spell, c.t_vocab)


logical.EXTRA["t_corrected"] = ORACLES["j8_correct_query"]


@query("j9_spell_retry", f"""
    with st as ({duck_stems("select distinct w0 from t_sptok")}), h as (select distinct t.qid from t_sptok t join st on st.w0 = t.w0 join t_terms x on x.term = st.w),
    c as (select * from t_corrected)
    select c.qid, c.query as original_query, case when h.qid is null then c.corrected end as correction from c left join h on h.qid = c.qid""")
def _j9(c):
    fixed_queries = text.corrected(c.t_spell, c.t_vocab)
    from ..operators.index import query_terms

    first = query_terms(c.t_spell).join(c.t_terms, "term").groupBy("qid").agg(F.count("*").alias("hits"))
    return fixed_queries.join(first, "qid", "left").select("qid", F.col("query").alias("original_query"), F.when(F.coalesce("hits", F.lit(0)) == 0, F.col("corrected")).alias("correction"))


# --- index and ranking ------------------------------------------------------------------------------------------------


@query("a8_bulk_load", "select page_id, term, term_freq from t_postings")
def _a8(c):
    return materialise(c.t_postings, "bulk").select("page_id", "term", "term_freq")


@query("j11_index_page", "select page_id, term, term_freq from t_postings")
def _j11(c):
    batch = c.table("t_pages").where("page_id % 50 = 7")
    return reindex(without_pages(c.t_postings, batch.where("page_id % 100 = 7")), batch).select("page_id", "term", "term_freq")


@query("j12_deindex_page", "select page_id, term, term_freq from t_postings where page_id not in (select page_id from t_pages where page_id % 9 = 2)")
def _j12(c):
    return without_pages(c.t_postings, c.table("t_pages").where("page_id % 9 = 2")).select("page_id", "term", "term_freq")


plain("j13_bm25f", f"select qid, page_id, {R6('score')} as score from t_bm25")
plain("j14_pagerank", f"select page_id, {R6('score')} as score from t_pagerank")
FLAGSHIP = f"select qid, page_id, rn, {R6('score')} as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) x where rn <= 10"
plain("search_bm25_top10", FLAGSHIP)


@query("l12_pagerank_params", f"""
    with recursive outs as (select s, count(*) as o from t_edges group by 1), n as (select count(*) as n from t_pages), r(i, page_id, score) as (
        select 0, page_id, 1.0::double / n.n from t_pages, n union all
        select x.i + 1, p.page_id, 0.5::double / n.n + 0.5::double * x.d / n.n + 0.5::double * coalesce(y.got, 0) from t_pages p cross join n
        cross join (select max(r.i) as i, coalesce(sum(r.score) filter (outs.s is null), 0) as d from r left join outs on outs.s = r.page_id) x
        left join (select e.t, sum(r.score / outs.o) as got from r join t_edges e on e.s = r.page_id join outs on outs.s = e.s group by 1) y on y.t = p.page_id where x.i < 5)
    select page_id, {R6('score')} as score from r where i = 5""")
def _l12(c):
    return rank.pagerank(c.table("t_pages").select("page_id"), c.t_edges, damping=0.5, iterations=5).select("page_id", r6("score"))


@query("j16_combine", f"select qid, page_id, {R6('combined')} as combined from t_combined")
def _j16(c):
    return rank.combined(c.t_bm25, c.t_pagerank).select("qid", "page_id", r6("combined"))


@query("j15_normalize", f"select qid, page_id, {R6('case when hi = lo then 1 else (score - lo) / (hi - lo) end')} as norm from (select *, min(score) over (partition by qid) as lo, max(score) over (partition by qid) as hi from t_bm25)")
def _j15(c):
    return rank.normalised(c.t_bm25, "qid", norm="score").select("qid", "page_id", r6("norm"))


@query("j17a_freshness", f"select page_id, cast(days as bigint) as days, {R6('boost')} as boost from t_fresh")
def _j17a(c):
    return rank.freshness(c.table("t_pages")).select("page_id", F.col("days").cast("bigint").alias("days"), r6("boost"))


@query("j19_rerank_fallback", "select qid, page_id, position, cast(null as double) as rerank_score from t_ranked where position <= 5")
def _j19(c):
    return rank.reranked(c.t_ranked, c.table("t_queries"), c.table("t_pages")).select("qid", "page_id", "position", "rerank_score")


plain("j20_assemble", "select qid, page_id, slot from t_results")
plain("j21_search_full", f"select qid, page_id, slot, url, title, {R6('bm25')} as bm25, {R6('coalesce(pagerank, 0)')} as pagerank, {R6('final')} as final from t_results")
plain("j21_total_results", "select qid, count(*) as total_results from t_ranked group by qid")


@query("j22_explain", f"""
    select qid, page_id, position, {R6('combined')} as combined, {R6('final')} as final from (select *, row_number() over (partition by qid order by round(final, 12) desc, page_id) as position from (
        select c.*, combined * greatest({FLOOR}::double, 1 - {DECAY}::double * datesub('day', p.crawled_at, {NOW})) as final from t_combined c join t_pages p on p.page_id = c.page_id)) where position <= 10""")
def _j22(c):
    scored = rank.combined(c.t_bm25, c.t_pagerank).join(rank.linear_freshness(c.table("t_pages")), "page_id").withColumn("final", F.col("combined") * F.col("boost"))
    return rank.top(scored, 10).select("qid", "page_id", "position", r6("combined"), r6("final"))


# --- retrieval --------------------------------------------------------------------------------------------------------

plain("d17_vector_cross", f"select vid, chunk_id, {R6('sim')} as sim from t_vsim")
plain("j25_vector_search", f"select vid, chunk_id, rn, {R6('sim')} as sim from t_vtop")
plain("g5_knn", "select vid, chunk_id from t_vtop where rn <= 3")
plain("e17_max_merge", f"select chunk_id, {R6('max(sim)')} as sim from t_vtop group by chunk_id")
plain("e18_new_unique", "select first_vid as vid, count(*) as new_unique from (select chunk_id, min(vid) as first_vid from t_vtop group by chunk_id) f group by first_vid")
plain("j29_retrieval_stats", "select (select count(distinct chunk_id) from t_vtop) as total_vector, (select count(*) from t_vtop) as found")
plain("j27_fanout", """
    with top as (select qid, page_id from (select qid, page_id, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) x where rn <= 10),
    pool as (select qid, term, total from (select qid, term, total, row_number() over (partition by qid order by total desc, term) as rn from (
        select t.qid, o.term, sum(o.term_freq) as total from top t join t_postings o on o.page_id = t.page_id group by t.qid, o.term) s) r where rn <= 50),
    rel as (select qid, term, row_number() over (partition by qid order by total desc, term) as rn from pool p where not exists (select 1 from t_qterms q where q.qid = p.qid and q.term = p.term)),
    own as (select qid, term, min(pos) as pos from t_qterms group by qid, term)
    select o.qid, AGG(o.term, ' ', o.pos) as tokens, r.sub_more, r.sub_other from own o
    join (select qid, AGG(case when rn <= 2 then term end, ' ', rn) as sub_more, AGG(case when rn <= 4 then term end, ' ', rn) as sub_other from rel where rn <= 8 group by qid) r on r.qid = o.qid
    group by o.qid, r.sub_more, r.sub_other""")


@query("j28_hybrid", f"""
    with v as (select qid, chunk_id, page_id, max(sim) as sim from t_fantop group by 1, 2, 3), top as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) where rn <= 10),
    k as (select t.qid, c.chunk_id, c.page_id, t.score from top t join t_vchunks c on c.page_id = t.page_id),
    m as (select coalesce(a.qid, k.qid) as qid, coalesce(a.chunk_id, k.chunk_id) as chunk_id, coalesce(a.page_id, k.page_id) as page_id, a.sim, k.score from v a full join k on k.qid = a.qid and k.chunk_id = a.chunk_id),
    s as (select qid, chunk_id, page_id, case when sim is null then 0 else (sim - min(sim) over q) / case when max(sim) over q <> min(sim) over q then max(sim) over q - min(sim) over q else 1 end end as vs,
        case when score is null then 0 else (score - min(score) over q) / case when max(score) over q <> min(score) over q then max(score) over q - min(score) over q else 1 end end as ks from m window q as (partition by qid)),
    f as (select *, 0.6::double * vs + 0.4::double * ks as combined from s), o as (select *, row_number() over (partition by qid, page_id order by round(combined, 9) desc, chunk_id) as nth from f)
    select qid, chunk_id, page_id, {R6('combined')} as combined, rn from (select *, row_number() over (partition by qid order by round(combined, 9) desc, chunk_id) as rn from o where nth = 1) where rn <= 8""")
def _j28(c):
    return rag.hybrid(c.t_fantop, c.t_bm25, c.table("t_vchunks")).select("qid", "chunk_id", "page_id", r6("combined"), "rn")


def _context(c):
    best = rag.hybrid(c.t_fantop, c.t_bm25, c.table("t_vchunks"))
    hits = best.join(c.table("t_vchunks").select("chunk_id", "content"), "chunk_id").join(c.table("t_pages").select("page_id", "title"), "page_id")
    return rag.context(hits)


@query("j30_overview_context", ORACLES["j28_hybrid"].rsplit("select qid, chunk_id", 1)[0] + """
    select r.qid, string_agg(chr(10) || chr(10) || '[' || r.rn || '] ' || p.title || ':' || chr(10) || left(c.content, 500), '' order by r.rn) as context
    from (select *, row_number() over (partition by qid order by round(combined, 9) desc, chunk_id) as rn from o where nth = 1) r join t_vchunks c on c.chunk_id = r.chunk_id join t_pages p on p.page_id = r.page_id where r.rn <= 5 group by r.qid""")
def _j30(c):
    return _context(c)


query("a17_answer", ORACLES["j28_hybrid"].rsplit("select qid, chunk_id", 1)[0] + """
    select r.qid, string_agg(array_to_string(list_filter(string_split_regex(trim(left(c.content, 500)), '\\s+'), lambda x: x <> '')[1:12], ' ') || ' [' || r.rn || ']', ' ' order by r.rn) as answer
    from (select *, row_number() over (partition by qid order by round(combined, 9) desc, chunk_id) as rn from o where nth = 1) r join t_vchunks c on c.chunk_id = r.chunk_id where r.rn <= 5 group by r.qid""")(lambda c: rag.answered(_context(c)))
query("a19_event_frames")(lambda c: rag.frames(rag.answered(_context(c))))
query("a16_embed")(lambda c: rag.embedded(c.table("t_vchunks")).select("chunk_id", F.size("embedding").alias("dim")))
query("j23_embed_batches")(lambda c: rag.embedded(c.table("t_vchunks").withColumn("embedding", F.lit(None).cast("array<float>"))).select("chunk_id", F.round(F.element_at("embedding", 1), 6).alias("first")))


@query("j18_chunk", f"""
    with recursive u as (select page_id, pos, len(words) as n from t_units), walk(page_id, pos, cur, cid) as (
        select page_id, pos, n, 1 from u where pos = 1 union all
        select u.page_id, u.pos, case when w.cur + u.n > {RETRIEVAL.chunk_words} then u.n else w.cur + u.n end, case when w.cur + u.n > {RETRIEVAL.chunk_words} then w.cid + 1 else w.cid end
        from walk w join u on u.page_id = w.page_id and u.pos = w.pos + 1),
    c as (select w.page_id, w.cid, sum(len(t.words)) as n, string_agg(array_to_string(t.words, ' '), ' ' order by w.pos) as content from walk w join t_units t on t.page_id = w.page_id and t.pos = w.pos group by 1, 2)
    select page_id, cast(row_number() over (partition by page_id order by cid) - 1 as integer) as chunk_idx, content from c where n >= {RETRIEVAL.min_chunk_words}""")
def _j18(c):
    return text.chunked(c.table("t_pages"))


@query("f8_greedy_packing", f"select page_id, count(*) as chunks, max(cast(len(string_split(content, ' ')) as bigint)) as most_words from ({ORACLES['j18_chunk']}) group by page_id")
def _f8(c):
    return text.chunked(c.table("t_pages")).groupBy("page_id").agg(F.count("*").alias("chunks"), F.max(F.size(F.split("content", " "))).alias("most_words"))


plain("l7_explore_index", """
    select t.term, t.df, o.page_id, o.rn from (select term, df from t_terms order by df desc, term limit 30) t
    join (select term, page_id, row_number() over (partition by term order by term_freq desc, page_id) as rn from t_postings) o on o.term = t.term where o.rn <= 4""")


@query("l10_explore_chunks", "select chunk_id, page_id, left(content, 200) as preview, cast(round(cast(embedding[1] as double), 4) as double) as x1, cast(len(embedding[1:64]) as bigint) as dims from t_vchunks where page_id = 7 and embedding is not null")
def _l10(c):
    own = c.table("t_vchunks").where("page_id = 7 and embedding is not null")
    return own.select("chunk_id", "page_id", F.substring("content", 1, 200).alias("preview"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("x1"), F.size(F.slice("embedding", 1, 64)).cast("bigint").alias("dims"))


# --- crawl ------------------------------------------------------------------------------------------------------------

_URLS = ["https://en.wikipedia.org/wiki/Arsenal_F.C.", "https://en.wikipedia.org/wiki/Tea", "https://en.wikipedia.org/w/index.php", "https://www.bbc.com/news", "https://bet365.com/x", "https://www.bet365.com/x", "https://fbref.com/en/players", "https://fbref.com", "https://example.org/", "https://www.espn.com/soccer/team"]


def _scope_rows(c):
    rows = c.spark.createDataFrame([(u, d) for u in _URLS for d in (0, 1, 2, 3)], "url string, depth int")
    return rows.union(c.table("t_pages").select("url", F.lit(1).alias("depth")))


_VALUES = ", ".join(f"('{u}', {d})" for u in _URLS for d in (0, 1, 2, 3))


@query("b10_crawl_scope", f"""
    with u as (select * from (values {_VALUES}) v(url, depth) union all select url, 1 from t_pages), p as (select url, depth, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from u)
    select url, depth, case when host in ({quoted(fixed.BLOCKED_DOMAINS)}) then false when host not in ({quoted(fixed.ALLOWED_DOMAINS)}) then false
        when host = 'en.wikipedia.org' then contains(path, '/wiki/') and (depth <= 1 or len(list_filter([{quoted(fixed.TOPIC_WORDS)}], lambda k: contains(lower(path), k))) > 0)
        else len(list_filter([{quoted(fixed.ALLOWED_PATHS)}], lambda k: contains(path, k))) > 0 end as in_scope from p""")
def _b10(c):
    return _scope_rows(c).select("url", "depth", crawl.in_scope(F.col("url"), F.col("depth")).alias("in_scope"))


@query("c8_url_parts", "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_replace(url, '#.*$', '') as bare from pages")
def _c8(c):
    return c.read("pages").select("page_id", crawl.netloc(F.col("url")).alias("host"), crawl.path(F.col("url")).alias("path"), F.regexp_replace("url", "#.*$", "").alias("bare"))


plain("c5_text_clean", "select page_id, trim(RX(RX(RX(RX(body_text, R'\\s+', ' '), R'\\[\\d+\\]', ''), R'(?i)\\[edit\\]', ''), R'\\s+', ' ')) as body from t_pages")
plain("c6_trailing_cut", "select page_id, case when instr(body_text, ' References ') > 501 then left(body_text, cast(instr(body_text, ' References ') as int) - 1) when instr(body_text, ' External links ') > 501 then left(body_text, cast(instr(body_text, ' External links ') as int) - 1) else body_text end as body from t_pages")


@query("c1_title", "select page_id, trim(regexp_extract(html, '(?s)<title[^>]*>([^<]*)', 1)) as title from pages")
def _c1(c):
    return c.read("pages").select("page_id", F.trim(F.regexp_extract("html", "(?s)<title[^>]*>([^<]*)", 1)).alias("title"))


query("a7_html_parse")(lambda c: crawl.parsed_pages(c.read("pages")).select("page_id", "title", "body_text", "content_hash", F.size("links").alias("n_links")))
query("c2_noise_strip")(lambda c: crawl.parsed_pages(c.read("pages")).select("page_id", F.length("body_text").alias("chars")))
query("c3_boilerplate_strip")(lambda c: crawl.parsed_pages(c.read("pages")).select("page_id", F.md5("body_text").alias("hash"), F.substring("body_text", 1, 80).alias("start")))
query("c4_main_content")(lambda c: crawl.parsed_pages(c.read("pages")).select("page_id", "body_text"))
query("c7_links")(lambda c: crawl.parsed_pages(c.read("pages")).select("page_id", F.explode("links").alias("target_url")).distinct())


@query("a5_robots", "select url, page_id % 3 = 0 or regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) not like '/private%' as allowed from pages")
def _a5(c):
    rules = "User-agent: *\nDisallow: /private\nAllow: /"
    return crawl.robots_allowed(c.read("pages").select("url", F.when(F.col("page_id") % 3 > 0, F.lit(rules)).alias("robots")))


@query("c11_bfs", "select page_id, cast(depth as integer) as depth from t_bfs")
def _c11(c):
    return crawl.levels(c.table("t_pages").where("page_id < 5"), c.t_edges)


@query("k8_resumable_frontier", "select page_id, cast(depth as integer) as depth from t_bfs where depth <= 2")
def _k8(c):
    return crawl.levels(c.table("t_pages").where("page_id < 5"), c.t_edges, 2)


@query("c14_refresh", "select page_id, term, term_freq from t_postings where page_id not in (select page_id from t_refresh where failed group by page_id having count(*) >= 3)")
def _c14(c):
    dead = c.table("t_refresh").where("failed").groupBy("page_id").count().where("count >= 3")
    return without_pages(c.t_postings, dead).select("page_id", "term", "term_freq")


# --- intent -----------------------------------------------------------------------------------------------------------


def _map(names: dict[str, int]) -> str:
    return ", ".join(f"('{n}', {i}, {k})" for k, (n, i) in enumerate(names.items()))


def _like(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(q, '{w}')" for w in words) + ")"


@query("j35_sports_detect", f"""
    with t(name, id, k) as (values {_map(fixed.TEAMS)}), l(name, id, k) as (values {_map(fixed.LEAGUES)}), s(query, q) as (select query, trim(lower(query)) from (values {", ".join(f"('{x}')" for x in SPORTS)}) v(query)),
    m as (select s.*, (select arg_max(t.name, length(t.name) * 1000 - t.k) from t where contains(q, t.name)) as team, (select arg_max(l.name, length(l.name) * 1000 - l.k) from l where contains(q, l.name)) as league,
        len(string_split_regex(q, '\\s+')) as n from s)
    select query, case when {_like(fixed.LIVE_WORDS)} then 'live' when {_like(fixed.STANDINGS_WORDS)} and league is not null then 'standings' when {_like(fixed.H2H_WORDS)} and team is not null then 'h2h'
        when {_like(fixed.FIXTURE_WORDS)} and (team is not null or league is not null) then 'upcoming' when team is not null and n <= 2 and q in (select name from t) then 'upcoming'
        when league is not null and n <= 3 and q in (select name from l) then 'standings' end as action,
        (select id from t where name = team) as team_id, (select id from l where name = league) as league_id, coalesce(team, league, '') as matched_name from m""")
def _j35(c):
    return intent.detected(c.spark.createDataFrame([(q,) for q in SPORTS], "query string"))


@query("g8_longest_key", f"""
    with t(name, id, k) as (values {_map(fixed.TEAMS)}), s(query) as (values {", ".join(f"('{x}')" for x in SPORTS)})
    select query, (select arg_max(t.name, length(t.name) * 1000 - t.k) from t where contains(lower(query), t.name)) as team from s""")
def _g8(c):
    rows = c.spark.createDataFrame([(q,) for q in SPORTS], "query string")
    return rows.select("query", intent._longest(F.lower("query"), fixed.TEAMS).alias("team"))


@query("d18_dictionary_match", f"select page_id, len(list_filter([{quoted(fixed.TEAMS)}], lambda k: contains(lower(body_text), k))) as n from t_pages")
def _d18(c):
    names = F.array(*(F.lit(n) for n in fixed.TEAMS))
    return c.table("t_pages").select("page_id", F.size(F.filter(names, lambda n: F.lower("body_text").contains(n))).cast("bigint").alias("n"))


_MATCHES = '{"response": [{"fixture": {"id": 7, "date": "2024-02-01T15:00:00", "venue": {"name": "Old Ground"}, "status": {"short": "NS", "elapsed": null}}, "league": {"name": "Cup", "round": "1"}, "teams": {"home": {"name": "A"}, "away": {"name": "B"}}, "goals": {"home": null, "away": 2}}, {"fixture": {"id": 8}, "league": {}, "teams": {}}]}'
_TABLE = '{"response": [{"league": {"standings": [[{"rank": 1, "team": {"name": "A"}, "all": {"played": 3, "win": 2, "draw": 1, "lose": 0, "goals": {"for": 5, "against": 1}}, "goalsDiff": 4, "points": 7, "form": "WWD"}], [{"rank": 1, "team": {"name": "B"}}]]}}]}'
_FIXTURES = f"""
    select cast(f->>'$.fixture.id' as bigint) as id, f->>'$.fixture.date' as date, coalesce(f->>'$.fixture.venue.name', '') as venue, coalesce(f->>'$.fixture.status.short', 'NS') as status,
        cast(f->>'$.fixture.status.elapsed' as bigint) as elapsed, coalesce(f->>'$.league.name', '') as league, coalesce(f->>'$.league.round', '') as round, coalesce(f->>'$.teams.home.name', '') as home_team,
        coalesce(f->>'$.teams.away.name', '') as away_team, cast(f->>'$.goals.home' as bigint) as score_home, cast(f->>'$.goals.away' as bigint) as score_away
    from (select unnest(cast(cast('{_MATCHES}' as json)->'$.response' as json[])) as f)"""
query("j36_fixtures", _FIXTURES)(lambda c: intent.fixtures(c.spark.createDataFrame([(_MATCHES,)], "json string")))
query("i18_nested_json", f"""
    select cast(t->>'$.rank' as bigint) as rank, coalesce(t->>'$.team.name', '') as team, coalesce(cast(t->>'$.all.played' as bigint), 0) as played, coalesce(cast(t->>'$.all.win' as bigint), 0) as won,
        coalesce(cast(t->>'$.all.draw' as bigint), 0) as drawn, coalesce(cast(t->>'$.all.lose' as bigint), 0) as lost, coalesce(cast(t->>'$.all.goals.for' as bigint), 0) as gf, coalesce(cast(t->>'$.all.goals.against' as bigint), 0) as ga,
        coalesce(cast(t->>'$.goalsDiff' as bigint), 0) as gd, coalesce(cast(t->>'$.points' as bigint), 0) as points, coalesce(t->>'$.form', '') as form
    from (select unnest(cast(g as json[])) as t from (select unnest(cast(l->'$.league.standings' as json[])) as g from (select unnest(cast(cast('{_TABLE}' as json)->'$.response' as json[])) as l)))""")(lambda c: intent.standings(c.spark.createDataFrame([(_TABLE,)], "json string")))
query("a18_sports_source", f"{_FIXTURES} union all {_FIXTURES}")(lambda c: intent.fixtures(c.spark.createDataFrame([(_MATCHES,), ('{"response": []}',)], "json string")).unionByName(intent.fixtures(c.spark.createDataFrame([(_MATCHES,)], "json string"))))


@query("i14_time_labels", "select id, strftime(created_at, '%H:%M') as label, strftime(created_at, '%Y-%m-%d') as day from t_log")
def _i14(c):
    return c.table("t_log").select("id", F.date_format("created_at", "HH:mm").alias("label"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("i15_breadcrumb", "select page_id, array_to_string(list_concat([regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')], list_transform(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: replace(x, '_', ' '))), ' › ') as crumb from t_pages")
def _i15(c):
    parts = F.transform(F.filter(F.split(crawl.path(F.col("url")), "/"), lambda x: x != ""), lambda x: F.replace(F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")))
    return c.table("t_pages").select("page_id", F.array_join(F.concat(F.array(F.regexp_replace(crawl.netloc(F.col("url")), r"^www\.", "")), parts), " › ").alias("crumb"))


@query("i16_citations", "select qid, cast(len(regexp_extract_all(t, '\\[\\d+(?:,\\s*\\d+)*\\]')) as bigint) as groups, cast(list_sum(list_transform(regexp_extract_all(t, '\\d+'), lambda x: cast(x as bigint))) as bigint) as total from (select qid, 'a [1] b [2, 3] [' || qid || ']' as t from t_queries)")
def _i16(c):
    t = c.table("t_queries").select("qid", F.concat(F.lit("a [1] b [2, 3] ["), F.col("qid"), F.lit("]")).alias("t"))
    numbers = F.transform(F.regexp_extract_all("t", F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
    return t.select("qid", F.size(F.regexp_extract_all("t", F.lit(r"(\[\d+(?:,\s*\d+)*\])"), 1)).cast("bigint").alias("groups"), F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("i19_stem_map", f"select qid, '{{' || string_agg('\"' || word || '\":\"' || term || '\"', ',' order by word, term) || '}}' as stems from (select distinct qid, word, term from ({ORACLES['j4_explain_tokens']}) where kept and word <> term) group by qid")
def _i19(c):
    kept = text.explain_tokens(c.table("t_queries")).where("kept and word <> term").groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("word", "term")))).alias("m"))
    return kept.select("qid", F.to_json("m").alias("stems"))


@query("i20_slices", "select id, cast(len(ws[1:2]) as bigint) as n, list_contains(ws, 'view') as has_view, cast(list_sum(list_transform(ws, lambda x: length(x))) as bigint) as chars from (select id, string_split(query, ' ') as ws from t_log)")
def _i20(c):
    rows = c.table("t_log").select("id", F.split("query", " ").alias("ws"))
    chars = F.aggregate(F.transform("ws", lambda x: F.length(x)), F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select("id", F.size(F.slice("ws", 1, 2)).cast("bigint").alias("n"), F.exists("ws", lambda x: x == "view").alias("has_view"), chars.alias("chars"))


@query("h3_stopword_union", f"select word, length(word) as n from (select unnest([{quoted(fixed.STOPWORDS)}]) as word)")
def _h3(c):
    return c.spark.range(1).select(F.explode(F.array(*(F.lit(w) for w in fixed.STOPWORDS))).alias("word")).select("word", F.length("word").cast("bigint").alias("n"))


plain("j32_cache_ttl", f"""
    select cache_key, id from (select cache_key, id, created_at, row_number() over (partition by cache_key order by created_at desc, id desc) as rn from (
        select JOINED(SORTED(WORDS(lower(query))), ' ') as cache_key, id, created_at from t_log) k) x where rn = 1 and created_at > {NOW} - INTERVAL '24' HOUR""")
plain("l3_snapshot", _RELATIONAL["a22_snapshot"])
plain("l15_search_endpoint", f"select h.qid, h.slot, h.url, {R6('h.final')} as final, n.total_results from t_results h join (select qid, count(*) as total_results from t_ranked group by qid) n on n.qid = h.qid")


@query("l16_overview", f"select qid, context from ({ORACLES['j30_overview_context']}) o where qid in (select qid from t_bm25 group by qid having count(*) >= 3)")
def _l16(c):
    enough = c.t_bm25.groupBy("qid").count().where("count >= 3")
    return _context(c).join(enough, "qid", "left_semi")


@query("l11_embed_query")
def _l11(c):
    asked = c.table("t_queries").select(F.col("qid").alias("chunk_id"), F.col("query").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    return rag.embedded(asked).select(F.col("chunk_id").alias("qid"), F.posexplode("embedding").alias("i", "x")).select("qid", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("l14_sports_lookup", f"""
    with t(name, id, k) as (values {_map(fixed.TEAMS)}), l(name, id, k) as (values {_map(fixed.LEAGUES)}), a(kind, name) as (values ('matches', 'arsenal'), ('matches', 'nobody'), ('standings', 'epl'), ('standings', 'la liga'), ('standings', 'arsenal'))
    select a.kind, a.name, case when a.kind = 'matches' then t.id else l.id end as id, case when a.kind = 'matches' then t.id else l.id end is null as unknown from a left join t on t.name = a.name left join l on l.name = a.name""")
def _l14(c):
    rows = c.spark.createDataFrame([("matches", "arsenal"), ("matches", "nobody"), ("standings", "epl"), ("standings", "la liga"), ("standings", "arsenal")], "kind string, name string")
    ids = F.when(F.col("kind") == "matches", F.get(F.transform(F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i in fixed.TEAMS.items())), lambda x: x["n"] == F.col("name")), lambda x: x["i"]), F.lit(0)))
    ids = ids.otherwise(F.get(F.transform(F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i in fixed.LEAGUES.items())), lambda x: x["n"] == F.col("name")), lambda x: x["i"]), F.lit(0)))
    return rows.select("kind", "name", ids.alias("id"), ids.isNull().alias("unknown"))


# --- places in a total order ------------------------------------------------------------------------------------------


@query("a15_surrogate_keys", "select term, row_number() over (order by term) as term_id from t_terms")
def _a15(c):
    return order.placed(c.t_terms.select("term"), F.col("term"), name="term_id")


@query("g1_full_sort", f"select page_id, {R6('score')} as score, row_number() over (order by round(score, 9) desc, page_id) as pos from t_pagerank")
def _g1(c):
    rows = c.t_pagerank.withColumn("rounded", F.round("score", 9))
    return order.placed(rows, F.desc("rounded"), F.col("page_id"), name="pos").select("page_id", r6("score"), "pos")


@query("f10_sliding_window", "select page_id, pos, cast(sum(hit) over (order by pos rows between current row and 29 following) as bigint) as hits from (select page_id, page_id as pos, case when is_dead then 1 else 0 end as hit from t_pages) x")
def _f10(c):
    rows = c.table("t_pages").select("page_id", F.col("page_id").alias("pos"), F.col("is_dead").cast("int").alias("hit"))
    return order.following_sum(order.placed(rows, F.col("pos")), "hit", 29, "hits").select("page_id", "pos", F.col("hits").cast("bigint").alias("hits"))


query("j26_ann_index")(lambda c: rag.approximate_search(c.table("t_fanvec"), c.table("t_vchunks")).select("qid", "vid", "rn", "chunk_id"))


# --- streams ----------------------------------------------------------------------------------------------------------


def _live(c):
    live = streams.LiveIndex(c.spark)
    pages = c.table("t_pages")
    for part in ("page_id % 2 = 0", "page_id % 2 = 1", "page_id % 7 = 0"):
        live.take(pages.where(part))
    return live


query("k1_incremental_index", "select page_id, term, term_freq, title_freq, body_freq from t_postings")(lambda c: _live(c).postings)
query("k2_running_stats", f"select count(*) as total_docs, {R6('avg(doc_length)')} as avg_doc_length from t_docstats where doc_length > 0")(lambda c: _live(c).corpus().select("total_docs", r6("avg_doc_length")))


@query("k3_failure_state", _RELATIONAL["c15_dead_pages"])
def _k3(c):
    runs = streams.drained(streams.failure_runs(streams.event_stream(c.spark, c.dir)), "failures")
    return runs.groupBy("page_id").agg(F.max("longest_run").alias("longest_run"), F.max("dead").alias("dead")).select("page_id", "dead", "longest_run")


_MARK = "(select max(cast(ts as timestamp)) - interval 1 day from events)"


@query("ext_tumbling_windows", f"select cast(floor(epoch(w)) as bigint) as start, event_type, count(*) as n, {R6('avg(value)')} as mean from (select time_bucket(interval 6 hours, cast(ts as timestamp), timestamp '1970-01-01') as w, * from events) where w + interval 6 hours <= {_MARK} group by w, event_type")
def _tumbling(c):
    return streams.drained(streams.closed_windows(streams.event_stream(c.spark, c.dir), "6 hours"), "tumbling")


@query("ext_sliding_windows", f"select cast(floor(epoch(w)) as bigint) as start, event_type, count(*) as n, {R6('avg(value)')} as mean from (select time_bucket(interval 6 hours, cast(ts as timestamp), timestamp '1970-01-01') - s * interval 6 hours as w, e.* from events e, (values (0), (1)) v(s)) where w + interval 12 hours <= {_MARK} group by w, event_type")
def _sliding(c):
    return streams.drained(streams.closed_windows(streams.event_stream(c.spark, c.dir), "12 hours", "6 hours"), "sliding")


@query("ext_session_windows", f"""
    select user_id, cast(floor(epoch(min(ts))) as bigint) as start, cast(floor(epoch(max(ts) + interval 12 hours)) as bigint) as stop, count(*) as n from (
        select user_id, ts, sum(case when gap is null or gap > interval 12 hours then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from (
            select user_id, event_id, cast(ts as timestamp) as ts, cast(ts as timestamp) - lag(cast(ts as timestamp)) over (partition by user_id order by ts, event_id) as gap from events))
    group by user_id, k having max(ts) + interval 12 hours <= {_MARK}""")
def _sessions(c):
    return streams.drained(streams.closed_sessions(streams.event_stream(c.spark, c.dir)), "sessions")


ORACLE_SQL = {name: duck(sql) for name, sql in ORACLES.items()}
