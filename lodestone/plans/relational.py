"""Queries that are plain SQL over the logical tables: lookups, updates, joins, aggregates, rankings, dashboards.

One text serves Spark, over DataFrames, and DuckDB, over common table expressions.
"""

from __future__ import annotations

from ..config import AS_OF, CRAWL
from ..functions.fixed import BAD_TITLES, REDIRECTS
from ..functions.sql import quoted

NOW = f"TIMESTAMP '{AS_OF}'"
R6 = "cast(round({}, 6) as double)".format
HOST = "RX(lower(RX(url, R'^[a-z]+://([^/?#]*).*$', '')), R'^$', '')"

QUERIES: dict[str, str] = {
    # --- sources, scans, sinks ---
    "a1_page_scan": "select page_id, title, cast(length(body_text) as bigint) as body_chars from t_pages",
    "a2_point_lookup": "select page_id, url, title from t_pages where page_id = 17",
    "a3_batched_lookup": "select page_id, title from t_pages where page_id in (select target_id from t_links where source_id = 1)",
    "a4_page_source": "select page_id, url, cast(length(html) as bigint) as html_chars from pages where url like 'http%'",
    "a6_rate_limit": f"select page_id, domain, (row_number() over (partition by domain order by page_id) - 1) * cast({CRAWL.delay_seconds} as double) as earliest_second from t_pages",
    "a10_upsert": """
        select query, results_count, id from (
            select *, row_number() over (partition by query order by priority desc, id desc) as rn from (
                select query, results_count, id, 0 as priority from t_log where id % 2 = 0
                union all select query, results_count + 100, id, 1 from t_log where id % 5 = 0) u) r
        where rn = 1""",
    "a11_insert_ignore": """
        select page_id, url, 'old' as origin from t_pages where page_id % 3 = 0
        union all select n.page_id, n.url, 'new' from t_pages n left join (select url from t_pages where page_id % 3 = 0) o on o.url = n.url where o.url is null and n.page_id % 2 = 0""",
    "a12_delete_by_key": "select page_id, term, term_freq from t_postings where page_id not in (select page_id from t_pages where is_dead)",
    "a13_conditional_update": f"""
        select page_id, failures + 1 as failures, failures + 1 >= {CRAWL.max_failures} as is_dead
        from (select page_id, count(case when failed then 1 end) as failures from t_refresh group by page_id) f""",
    "a14_column_fill": """
        select c.chunk_id, c.embedding is not null as had, coalesce(c.embedding, e.embedding) is not null as has
        from t_vchunks c left join embeddings e on e.vec_id = c.chunk_id""",
    "a21_log_append": "select id, query, results_count, time_ms from t_log union all select 1000000 + qid, query, 0, cast(0 as double) from t_queries",
    "a22_snapshot": f"""
        select (select count(*) from t_pages) as pages_crawled, (select count(*) from t_terms) as terms_indexed, (select count(*) from t_postings) as postings_count,
            (select count(*) from t_vchunks) as chunks_count, (select count(*) from t_vchunks where embedding is not null) as chunks_embedded,
            (select round(avg_doc_length, 1) from t_corpus) as avg_doc_length, (select count(*) from t_log) as queries_total,
            (select round(coalesce(avg(time_ms), 0), 1) from t_log where created_at > {NOW} - INTERVAL '24' HOUR) as avg_latency_ms""",
    # --- filters and projections ---
    "b1_live_pages": "select page_id, url from t_pages where not is_dead",
    "b2_null_predicates": "select chunk_id from t_vchunks where embedding is null",
    "b3_projected_predicate": "select chunk_id, embedding is not null as has_embedding from t_vchunks",
    "b4_relative_time": f"""
        select id, query, created_at > {NOW} - INTERVAL '24' HOUR as last_day, created_at > {NOW} - INTERVAL '7' DAY as last_week from t_log where created_at > {NOW} - INTERVAL '14' DAY""",
    "b5_prefix_ilike": "select id, query from t_log where query ilike 'VI%' and lower(query) <> lower('view 1')",
    "b6_coalesce": "select page_id, EPOCH(coalesce(last_checked_at, crawled_at)) as seen_at from t_pages",
    "b7_previews": "select page_id, left(title, 60) as title_60, left(body_text, 500) as body_500, left(body_text, 200) as body_200 from t_pages",
    "b8_lengths": "select page_id, cast(length(body_text) as bigint) as chars, cast(cardinality(WORDS(body_text)) as bigint) as words from t_pages",
    "b9_quality_gate": f"""
        select page_id, cardinality(WORDS(body_text)) >= {CRAWL.min_words} as enough_words,
            title <> '' and lower(trim(title)) not in ({quoted(BAD_TITLES)}) as good_title,
            not MATCH(lower(left(body_text, 1000)), R'({'|'.join(REDIRECTS)})') as no_redirect,
            row_number() over (partition by content_hash order by page_id) = 1 as first_of_hash
        from t_pages""",
    "b11_depth_limit": f"select page_id, level as depth, level + 1 <= {CRAWL.max_depth} as enqueue_links, level > {CRAWL.max_depth} as skip from (select page_id, depth as level from t_bfs) p",
    "b12_js_only": """
        select p.page_id, length(body_text) < 500 and coalesce(n, 0) = 0 as js_only from t_pages p left join (select source_id, count(*) as n from t_links group by source_id) l on l.source_id = p.page_id""",
    "b13_rerank_cut": f"select qid, page_id, {R6('rerank_score')} as rerank_score, rerank_score is null or rerank_score > -8 as kept from t_rerank",
    "b14_overview_gate": """
        select q.qid, coalesce(n, 0) >= 3 as asked, coalesce(c, 0) >= 2 as answered from t_queries q
        left join (select b.qid, count(*) as n from t_bm25 b group by b.qid) r on r.qid = q.qid
        left join (select b.qid, count(*) as c from t_bm25 b join t_vchunks v on v.page_id = b.page_id group by b.qid) s on s.qid = q.qid""",
    "b15_min_chunk": "select chunk_id, cardinality(WORDS(content)) >= 20 as kept from t_vchunks",
    "b16_link_scheme": """
        select href, href <> '' and not MATCH(href, R'^(#|javascript:|mailto:|tel:)') as kept from (
            select '' as href union all select '#top' union all select 'javascript:x' union all select 'mailto:a' union all select 'tel:1' union all select '/rel' union all select url from pages) h""",
    "b17_zero_results": f"select count(*) as n from t_log where results_count = 0 and created_at > {NOW} - INTERVAL '7' DAY",
    "b18_conditional_predicate": "select chunk_id, page_id from t_vchunks where page_id = 7 and embedding is not null",
    # --- crawl ---
    "c9_content_hash": "select page_id, md5(body_text) as content_hash from t_pages",
    "c10_content_dedup": "select page_id, content_hash, row_number() over (partition by content_hash order by page_id) > 1 as duplicate, count(*) over (partition by content_hash) > 1 as refresh_rejects from t_pages",
    "c12_seed_clear": """
        select url, 0 as depth from t_pages where not is_dead
        union all select distinct l.target_url, 1 from t_links l left join (select url from t_pages where not is_dead) p on p.url = l.target_url where p.url is null""",
    "c13_queue_states": f"""
        select status, count(*) as n from (
            select p.page_id, case when b.page_id is null then 'pending' when d.page_id is not null then 'failed' when b.depth > {CRAWL.max_depth} or cardinality(WORDS(p.body_text)) < {CRAWL.min_words} then 'skipped' else 'crawled' end as status
            from t_pages p left join t_bfs b on b.page_id = p.page_id
            left join (select page_id from t_refresh where failed group by page_id having count(*) >= {CRAWL.max_failures}) d on d.page_id = p.page_id) q
        group by status""",
    "c15_dead_pages": f"""
        select page_id, max(run) >= {CRAWL.max_failures} as dead, max(run) as longest_run from (
            select page_id, island, count(case when failed then 1 end) as run from (
                select page_id, failed, sum(case when failed then 0 else 1 end) over (partition by page_id order by ts, event_id rows between unbounded preceding and current row) as island from t_refresh) i
            group by page_id, island) r
        group by page_id""",
    "c16_due_schedules": f"""
        select id, strategy, next_run <= {NOW} as due, EPOCH(next_run + INTERVAL '7' DAY) as next_after from (
            select id, case when id % 2 = 0 then 'seed' else 'top_pagerank' end as strategy, created_at + INTERVAL '3' DAY as next_run from t_log) s""",
    # --- joins ---
    "d1_postings_docstats": "select o.page_id, o.term, o.term_freq, d.doc_length from t_postings o join t_docstats d on d.page_id = o.page_id where o.term in (select term from t_qterms)",
    "d2_terms_postings": "select t.term, t.df, o.page_id, o.term_freq from t_terms t join t_postings o on o.term = t.term where t.df >= 50",
    "d3_postings_pages": """
        select term, page_id, title, term_freq from (
            select o.term, o.page_id, p.title, o.term_freq, row_number() over (partition by o.term order by o.term_freq desc, o.page_id) as rn
            from t_postings o join t_pages p on p.page_id = o.page_id where o.term in (select term from t_qterms)) x where rn <= 4""",
    "d4_links_pages": "select distinct l.source_id, p.page_id as target_id from t_links l join t_pages p on p.url = l.target_url where l.source_id in (select page_id from t_pages)",
    "d5_chunks_pages": "select c.chunk_id, c.chunk_idx, p.title, p.url from t_vchunks c join t_pages p on p.page_id = c.page_id",
    "d6_pagerank_pages": f"select p.page_id, p.title, {R6('r.score')} as score from t_pagerank r join t_pages p on p.page_id = r.page_id",
    "d7_outlink_titles": "select l.source_id, l.target_url, p.title from t_links l left join (select * from t_pages where not is_dead) p on p.url = l.target_url",
    "d8_inlinks_of_page": "select source_id from t_links where target_url = (select url from t_pages where page_id = 3)",
    "d9_correlated_counts": "select p.page_id, (select count(*) from t_links l where l.source_id = p.page_id) as outlinks, (select count(*) from t_links l where l.target_url = p.url) as inlinks from t_pages p",
    "d10_bm25_pagerank": f"select b.qid, b.page_id, {R6('b.score')} as bm25, {R6('coalesce(r.score, 0)')} as pagerank from t_bm25 b left join t_pagerank r on r.page_id = b.page_id",
    "d11_full_outer": """
        select coalesce(v.page_id, k.page_id) as page_id, coalesce(v.n, 0) as vector_chunks, coalesce(k.n, 0) as keyword_hits
        from (select page_id, count(*) as n from t_vchunks where embedding is not null group by page_id) v full join (select page_id, count(*) as n from t_bm25 group by page_id) k on v.page_id = k.page_id""",
    "d12_related_not_asked": """
        select distinct x.qid, o.term from (select qid, page_id, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) x
        join t_postings o on o.page_id = x.page_id where x.rn <= 10 and not exists (select 1 from t_qterms q where q.qid = x.qid and q.term = o.term)""",
    "d13_not_reranked": """
        select qid, page_id from t_bm25 b where not exists (
            select 1 from (select qid, page_id, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) t where t.rn <= 5 and t.qid = b.qid and t.page_id = b.page_id)""",
    "d14_semi_join": "select page_id, title from t_pages where page_id in (select page_id from t_bm25 where qid = 3)",
    "d15_exists_probe": "select p.page_id, exists (select 1 from t_pages o where o.content_hash = p.content_hash and o.page_id < p.page_id) as seen from t_pages p",
    # --- aggregates ---
    "e1_table_counts": "select 'pages' as name, count(*) as n from t_pages union all select 'links', count(*) from t_links union all select 'chunks', count(*) from t_vchunks union all select 'log', count(*) from t_log",
    "e2_document_frequency": "select term, count(*) as df from t_postings group by term",
    "e3_top_terms": "select term, count(*) as df, cast(sum(term_freq) as bigint) as total from t_postings group by term order by df desc, term limit 30",
    "e4_terms_of_top_pages": """
        select term, cast(sum(term_freq) as bigint) as total from t_postings where page_id in (
            select page_id from (select page_id, row_number() over (order by round(score, 9) desc, page_id) as rn from t_bm25 where qid = 1) x where rn <= 10) group by term""",
    "e5_window_average": f"select {R6('coalesce(avg(time_ms), 0)')} as avg_day, {R6('coalesce((select avg(time_ms) from t_log where id < 0), 0)')} as avg_none from t_log where created_at > {NOW} - INTERVAL '24' HOUR",
    "e6_by_query": f"select query, count(*) as n, {R6('avg(time_ms)')} as avg_ms, {R6('avg(results_count)')} as avg_results from t_log group by query",
    "e7_daily_buckets": f"select cast(cast(created_at as date) as STR) as day, count(*) as n, {R6('avg(time_ms)')} as avg_ms from t_log group by cast(created_at as date)",
    "e8_last_crawl": "select EPOCH(max(crawled_at)) as last_crawl from t_pages",
    "e9_filtered_counts": f"select count(*) as n, count(case when results_count = 0 then 1 end) as zero, count(case when created_at > {NOW} - INTERVAL '24' HOUR then 1 end) as today from t_log",
    "e10_term_counts": "select page_id, term, term_freq, title_freq, body_freq from t_postings",
    "e11_most_common": """
        select page_id, term, term_freq, rn from (select page_id, term, term_freq, row_number() over (partition by page_id order by term_freq desc, term) as rn from t_postings) x where rn <= 15""",
    "e12_corpus_stats": f"select total_docs, {R6('avg_doc_length')} as avg_doc_length from t_corpus",
    "e13_incremental_stats": f"""
        select total - gone as total_docs, {R6('(words - gone_words) / cast(total - gone as double)')} as avg_doc_length from (
            select count(*) as total, sum(doc_length) as words, count(case when page_id % 10 = 4 then 1 end) as gone, sum(case when page_id % 10 = 4 then doc_length else 0 end) as gone_words from t_docstats) s""",
    "e14_min_max": f"select qid, {R6('min(score)')} as low, {R6('max(score)')} as high from t_bm25 group by qid",
    "e15_dangling_mass": f"select {R6('sum(case when o.s is null then r.score else 0 end)')} as dangling from t_pagerank r left join (select distinct s from t_edges) o on o.s = r.page_id",
    "e16_score_sum": f"select qid, count(*) as matches, {R6('sum(score)')} as total from t_bm25 group by qid",
    "e19_distinct_pairs": "select distinct source_id, target_id from t_links",
    "e20_domain_running_count": "select page_id, domain, count(*) over (partition by domain order by page_id rows between unbounded preceding and current row) as so_far from t_pages",
    "e21_total_step_time": f"select query, {R6('sum(time_ms)')} as total_ms from t_log group by query",
    "e22_chunks_per_page": "select (select count(*) from t_vchunks) / cast(greatest((select count(*) from t_pages), 1) as double) as ratio",
    # --- windows, sorts, sets ---
    "f1_rank_change": """
        with b as (select qid, page_id, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25),
        c as (select x.qid, x.page_id, row_number() over (partition by x.qid order by round(x.score + 100 * r.score, 9) desc, x.page_id) as rn from t_bm25 x join t_pagerank r on r.page_id = x.page_id)
        select c.qid, c.page_id, case when b.rn <= 10 then cast(b.rn as STR) else '>10' end as bm25_rank, c.rn as final_rank from c join b on b.qid = c.qid and b.page_id = c.page_id where c.rn <= 10""",
    "f2_rerank_ranks": """
        select qid, page_id, position as before_rank, row_number() over (partition by qid order by rerank_score desc, position) as after_rank from t_rerank where rerank_score > -8""",
    "f3_domain_cap": """
        with r as (select b.qid, b.page_id, p.domain, row_number() over (partition by b.qid order by round(b.score, 9) desc, b.page_id) as pos from t_bm25 b join t_pages p on p.page_id = b.page_id),
        k as (select *, row_number() over (partition by qid, domain order by pos) as nth from r)
        select qid, page_id, slot from (select qid, page_id, row_number() over (partition by qid order by pos) as slot from k where nth <= 2) s where slot <= 10""",
    "f4_best_chunk": "select page_id, chunk_id from (select page_id, chunk_id, row_number() over (partition by page_id order by chunk_id % 13 desc, chunk_id) as rn from t_vchunks) x where rn = 1",
    "f5_sample_docs": """
        select term, page_id, rn from (select o.term, o.page_id, row_number() over (partition by o.term order by o.term_freq desc, o.page_id) as rn
            from t_postings o join (select term from t_terms order by df desc, term limit 30) t on t.term = o.term) x where rn <= 4""",
    "f6_min_max_norm": f"""
        select qid, page_id, {R6('case when hi = lo then cast(1 as double) else (score - lo) / (hi - lo) end')} as norm from (
            select *, min(score) over (partition by qid) as lo, max(score) over (partition by qid) as hi from t_bm25) x""",
    "f9_snapshot_series": """
        select day, n, n - lag(n) over (order by day) as delta, cast(sum(n) over (order by day rows between unbounded preceding and current row) as bigint) as running from (
            select cast(cast(created_at as date) as STR) as day, count(*) as n from t_log group by cast(created_at as date)) d""",
    "g2_top_pages": "select qid, page_id, rn from (select qid, page_id, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) x where rn <= 10",
    "g3_order_limit": "select query, count(*) as n from t_log group by query order by n desc, query limit 20",
    "g4_paging": "select page_id, url from t_pages order by page_id limit 20 offset 40",
    "g6_fifo_pop": "select page_id, url from t_pages where page_id % 5 = 0 order by page_id limit 1",
    "g7_ordered_limit": "select page_id, title from t_pages where not is_dead order by page_id limit 5000",
    "g9_result_page": """
        select qid, page_id, rn from (select qid, page_id, row_number() over (partition by qid order by round(score, 9) desc, page_id) as rn from t_bm25) x where rn between 11 and 20""",
    "h1_key_union": "select page_id from t_vchunks where embedding is not null union select page_id from t_bm25",
    "h2_vocabulary": """
        select word from (select RX(lower(w), R'[^a-z]', '') as word from (select FLAT(WORDS(title)) as w from t_pages where not is_dead and title is not null) t) v where length(word) between 3 and 20
        union select term from t_terms where length(term) between 3 and 20""",
    "h4_set_difference": "select distinct term from t_postings except select term from t_qterms",
    "h5_link_set": "select distinct source_id, target_url from t_links",
    # --- scalar functions ---
    "i1_lower_strip": "select page_id, lower(trim(title)) as title from t_pages",
    "i2_regex_replace": "select page_id, RX(lower(title), R'[^a-z0-9 ]', ' ') as cleaned from t_pages",
    "i4_regex_search": f"select page_id, MATCH(lower(body_text), R'(the|and)') as common, MATCH(lower(left(body_text, 1000)), R'({'|'.join(REDIRECTS)})') as redirect from t_pages",
    "i5_whitespace_join": "select id, JOINED(WORDS(lower(query)), ' ') as q from t_log",
    "i6_substrings": "select page_id, substr(title, 2, 3) as s, cast(instr(title, 'e') as bigint) as at_e, title like 'T%' as starts_t, title like '%.' as ends_dot from t_pages",
    "i7_digits": "select n, MATCH(n, R'^[0-9]+$') as digits, length(n) between 2 and 30 as bounded from (select cast(page_id as STR) as n from t_pages union all select title from t_pages) x",
    "i8_exp_log": f"select page_id, {R6('exp(-0.02 * (page_id % 100))')} as e, {R6('ln(page_id + 1)')} as l from t_pages",
    "i9_round": "select page_id, round(page_id / cast(7 as double), 4) as r4, round(page_id / cast(7 as double), 6) as r6 from t_pages",
    "i10_least_greatest": "select page_id, least(page_id, 50) as lo, greatest(page_id, 50) as hi, abs(page_id - 50) as distance from t_pages",
    "i11_age_days": f"select page_id, cast(DAYS(crawled_at, {NOW}) as bigint) as days from t_pages",
    "i12_dates": "select id, cast(cast(created_at as date) as STR) as day, EPOCH(created_at + INTERVAL '6' HOUR) as later from t_log",
    "i13_md5": "select page_id, md5(title) as h from t_pages",
    "i17_sparkline": f"select day, {R6('(n - least(lo, 0)) / cast(greatest(hi - least(lo, 0), 1) as double)')} as y from (select day, n, min(n) over () as lo, max(n) over () as hi from (select cast(cast(created_at as date) as STR) as day, count(*) as n from t_log group by cast(created_at as date)) d) x",
    # --- dashboards ---
    "l1_suggest": "select query, count(*) as freq from t_log where query ilike 'pu%' and lower(query) <> 'pu' group by query order by freq desc, query limit 6",
    "l2_stats": """
        select (select count(*) from t_pages) as pages_crawled, (select count(*) from t_terms) as total_terms, (select count(*) from t_postings) as total_postings, (select count(*) from t_vchunks) as total_chunks,
            (select count(*) from t_vchunks where embedding is not null) as chunks_embedded, (select round(avg_doc_length, 1) from t_corpus) as avg_doc_length, (select EPOCH(max(crawled_at)) from t_pages) as last_crawl,
            (select count(*) from t_pages where page_id % 5 = 4) as pages_failed, (select count(*) from t_pages where page_id % 5 = 0) as pages_pending""",
    "l4_stats_history": f"""
        select day, sum(pages) as pages, sum(queries) as queries, {R6('sum(ms) / greatest(sum(queries), 1)')} as avg_ms from (
            select cast(cast(crawled_at as date) as STR) as day, 1 as pages, 0 as queries, cast(0 as double) as ms from t_pages where crawled_at > {NOW} - INTERVAL '30' DAY
            union all select cast(cast(created_at as date) as STR), 0, 1, time_ms from t_log where created_at > {NOW} - INTERVAL '30' DAY) x group by day""",
    "l5_dashboard_totals": f"""
        select count(*) as total, count(case when created_at > {NOW} - INTERVAL '24' HOUR then 1 end) as today, {R6('avg(time_ms)')} as avg_ms,
            count(case when results_count = 0 and created_at > {NOW} - INTERVAL '7' DAY then 1 end) as zero_7d from t_log""",
    "l5_dashboard_popular": f"select query, count(*) as n, {R6('avg(time_ms)')} as avg_ms, {R6('avg(results_count)')} as avg_results from t_log group by query order by n desc, query limit 20",
    "l5_dashboard_recent": "select id, query, results_count, EPOCH(created_at) as at from t_log order by created_at desc, id desc limit 20",
    "l6_explore_pages": "select p.page_id, p.url, cast(length(body_text) as bigint) as chars, (select count(*) from t_links l where l.source_id = p.page_id) as outlinks from t_pages p order by page_id limit 20",
    "l8_explore_pagerank": f"""
        select page_id, title, score, inlinks from (select p.page_id, p.title, {R6('r.score')} as score, (select count(*) from t_links l where l.target_url = p.url) as inlinks from t_pages p join t_pagerank r on r.page_id = p.page_id) x
        order by score desc, page_id limit 20""",
    "l9_page_journey": """
        select 'term' as kind, term as name, term_freq as n from (select term, term_freq, row_number() over (order by term_freq desc, term) as rn from t_postings where page_id = 5) x where rn <= 15
        union all select 'out', target_url, 1 from (select target_url, row_number() over (order by target_url) as rn from t_links where source_id = 5) x where rn <= 10
        union all select 'in', cast(source_id as STR), 1 from (select source_id, row_number() over (order by source_id) as rn from t_links where target_url = (select url from t_pages where page_id = 5)) x where rn <= 10
        union all select 'chunk', left(content, 40), chunk_idx from t_vchunks where page_id = 5 and chunk_idx < 8""",
    "k4_six_hour_snapshots": f"select cast(floor(EPOCH(created_at) / 21600) as bigint) * 21600 as window_start, count(*) as n, {R6('avg(time_ms)')} as avg_ms from t_log group by cast(floor(EPOCH(created_at) / 21600) as bigint) * 21600",
    "k5_rolling_metrics": f"""
        select sum(case when created_at > {NOW} - INTERVAL '24' HOUR then 1 else 0 end) as day_n, sum(case when created_at > {NOW} - INTERVAL '7' DAY then 1 else 0 end) as week_n,
            {R6("avg(case when created_at > " + NOW + " - INTERVAL '7' DAY then time_ms end)")} as week_ms from t_log""",
    "k6_ttl_cache": f"""
        select query, id from (select query, id, created_at, row_number() over (partition by query order by created_at desc, id desc) as rn from t_log) x
        where rn = 1 and created_at > {NOW} - INTERVAL '24' HOUR""",
    "j31_cache_key": "select id, JOINED(SORTED(WORDS(lower(query))), ' ') as cache_key from t_log",
    "j33_chat_query": """
        select conv_id, case when users > 1 and instr(lower(latest), lower(first)) = 0 then first || ' ' || latest else latest end as query from (
            select conv_id, count(*) as users, min_by(text, turn) as first, max_by(text, turn) as latest from t_chat where role = 'user' group by conv_id) u""",
    "j34_chat_window": "select conv_id, turn, role from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as rn from t_chat) x where rn <= 10",
    "j17b_linear_freshness": f"""
        select page_id, {R6(f'greatest(cast(0.5 as double), 1 - cast(0.02 as double) * DAYS(crawled_at, {NOW}))')} as boost from t_pages""",
    "j24_dimension_guard": "select chunk_id, embedding is not null and cardinality(embedding) = 64 as fits from t_vchunks",
}
