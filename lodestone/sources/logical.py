"""The engine's logical tables over the input files, in SQL that both Spark and DuckDB read, and the index built from them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AS_OF, RANKING
from ..functions.sql import DUCK, SPARK, render
from ..functions.text import duck_stems, duck_tokens, stemmed, tokens
from ..storage import materialise

NOW = f"TIMESTAMP '{AS_OF}'"
#: Plain tables. A name t_... in a text stands for another logical table.
SQL = {
    "t_pages": f"""
        select d.doc_id as page_id, 'https://' || source || '.example.org/' || lang || '/' || cast(d.doc_id as STR) as url,
            source || '.example.org' as domain,
            left(case when instr(text, chr(10)) > 0 then left(text, cast(instr(text, chr(10)) as int) - 1) else text end, 80) as title,
            case when instr(text, chr(10)) > 0 then substr(text, cast(instr(text, chr(10)) as int) + 1) else text end as body_text,
            200 as status_code, md5(text) as content_hash,
            {NOW} - (d.doc_id * 7 % 120) * INTERVAL '1' DAY - (d.doc_id % 24) * INTERVAL '1' HOUR as crawled_at,
            case when d.doc_id % 5 = 0 then {NOW} - (d.doc_id * 7 % 120) * INTERVAL '1' DAY - (d.doc_id % 24) * INTERVAL '1' HOUR + INTERVAL '3' DAY end as last_checked_at,
            coalesce(l.toxic = 1, false) as is_dead
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "t_links": """
        select distinct e.source_id, e.target_id, p.url as target_url
        from (select a.l_partkey % n.n as source_id, b.l_partkey % n.n as target_id
              from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1, (select count(*) as n from documents) n) e
        join t_pages p on p.page_id = e.target_id
        where e.source_id % 10 <> 0""",
    "t_vchunks": """
        select vec_id as chunk_id, vec_id % 200 as page_id, cast(floor(vec_id / 200) as int) as chunk_idx, left(d.text, 500) as content,
            case when vec_id % 17 = 0 then null else embedding end as embedding
        from embeddings e join documents d on d.doc_id = e.vec_id % 200""",
    "t_queryvec": "select vec_id as vid, embedding from embeddings where vec_id in (1, 2, 3)",
    "t_fanvec": """
        select f.qid, f.vid, e.embedding
        from (select q.qid, (q.qid * 3 + n.k) % 500 as vid from t_queries q cross join (select 1 as k union all select 2 union all select 3) n) f join embeddings e on e.vec_id = f.vid""",
    "t_log": """
        select event_id as id, event_type || ' ' || JSONK(props) as query, k % 7 as results_count, value as time_ms, cast(ts as timestamp) as created_at
        from (select *, cast(JSONK(props) as bigint) as k from events)""",
    "t_refresh": "select user_id as page_id, event_id, cast(ts as timestamp) as ts, event_type = 'error' as failed from events",
    "t_chat": "select conv_id, turn, role, text from conversations",
    "t_queries": "select item_id as qid, FIRST4(text) as query from benchmark",
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _special(text: str, dialect: str) -> str:
    if dialect == SPARK:
        text = re.sub(r"JSONK\((\w+)\)", r"get_json_object(\1, '$.k')", text)
        return re.sub(r"FIRST4\((\w+)\)", r"array_join(slice(split(trim(\1), r'\\s+'), 1, 4), ' ')", text)
    text = re.sub(r"JSONK\((\w+)\)", r"json_extract_string(\1, '$.k')", text)
    return re.sub(r"FIRST4\((\w+)\)", r"array_to_string(string_split_regex(trim(\1), '\\s+')[1:4], ' ')", text)


K1, B, TITLE, BODY = RANKING.k1, RANKING.b, RANKING.title_weight, RANKING.body_weight
#: Derived tables as DuckDB text; Spark builds them below, on its own.
DUCK_DERIVED = {
    "t_tok": f"""
        select page_id, field, unnest(ws) as w0 from (
            select page_id, 'title' as field, {duck_tokens("title")} as ws from t_pages
            union all select page_id, 'body', {duck_tokens("body_text")} from t_pages)""",
    "t_qtok": f"select qid, unnest(ws) as w0, generate_subscripts(ws, 1) as pos from (select qid, {duck_tokens('query')} as ws from t_queries)",
    "t_stems": duck_stems("select distinct w0 from (select w0 from t_tok union all select w0 from t_qtok)"),
    "t_postings": """
        select page_id, s.w as term, count(*) as term_freq, count(*) filter (field = 'title') as title_freq, count(*) filter (field = 'body') as body_freq
        from t_tok join t_stems s using (w0) group by 1, 2""",
    "t_terms": "select term, count(*) as df from t_postings group by 1",
    "t_docstats": "select p.page_id, cast(coalesce(sum(term_freq), 0) as bigint) as doc_length from t_pages p left join t_postings o on p.page_id = o.page_id group by 1",
    "t_corpus": "select count(*) as total_docs, avg(doc_length) as avg_doc_length from t_docstats",
    "t_qterms": "select qid, pos, s.w as term from t_qtok join t_stems s using (w0)",
    "t_bm25": f"""
        select q.qid, o.page_id, sum(ln((c.total_docs - t.df + 0.5::double) / (t.df + 0.5::double) + 1)
            * (o.title_freq * {TITLE}::double + o.body_freq * {BODY}::double) * {K1 + 1}::double
            / (o.title_freq * {TITLE}::double + o.body_freq * {BODY}::double + {K1}::double * (1 - {B}::double + {B}::double * d.doc_length / c.avg_doc_length))) as score
        from t_qterms q join t_terms t on q.term = t.term join t_postings o on o.term = q.term join t_docstats d on d.page_id = o.page_id, t_corpus c
        group by 1, 2""",
    "t_edges": "select distinct l.source_id as s, p.page_id as t from t_links l join t_pages p on p.url = l.target_url where l.source_id in (select page_id from t_pages)",
    "t_pagerank": f"""
        with recursive outs as (select s, count(*) as o from t_edges group by 1), n as (select count(*) as n from t_pages),
        r(i, page_id, score) as (
            select 0, page_id, 1.0::double / n.n from t_pages, n
            union all
            select x.i + 1, p.page_id, {1 - RANKING.damping}::double / n.n + {RANKING.damping}::double * x.dangling / n.n + {RANKING.damping}::double * coalesce(y.got, 0)
            from t_pages p cross join n cross join (select max(r.i) as i, coalesce(sum(r.score) filter (outs.s is null), 0) as dangling from r left join outs on outs.s = r.page_id) x
            left join (select e.t, sum(r.score / outs.o) as got from r join t_edges e on e.s = r.page_id join outs on outs.s = e.s group by 1) y on y.t = p.page_id
            where x.i < {RANKING.iterations})
        select page_id, score from r where i = {RANKING.iterations}""",
}


def duck(sql: str) -> str:
    """DuckDB SQL with the logical tables that it names as common table expressions."""
    known = {k: render(_special(v, DUCK), DUCK) for k, v in SQL.items()} | DUCK_DERIVED | EXTRA
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bt_\w+", text)):
            if name in known and name not in order:
                need(known[name])
                if name not in order:
                    order.append(name)

    body = render(_special(sql, DUCK), DUCK).strip()
    need(body)
    if not order:
        return body
    # materialized: a table that several others name is computed once
    ctes = ",\n".join(f"{name} as materialized ({known[name]})" for name in order)
    if m := re.match(r"with\s+(recursive\s+)?", body):
        return f"with {m[1] or ''}{ctes},\n{body[m.end() :]}"
    return f"with {ctes}\n{body}"


#: Further DuckDB tables that other modules add.
EXTRA: dict[str, str] = {}
_kept: dict[tuple[str, str], Corpus] = {}


class Corpus:
    """Logical tables of one input folder as DataFrames. Index tables are built once and written, so plans over them stay small."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        """The session's corpus of this folder."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _kept:
            _kept.clear()
            _kept[key] = cls(spark, sf_dir)
        return _kept[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Runs text in which t_... names stand for logical tables and the input files' names for these."""
        text = render(_special(text, SPARK), SPARK)
        frames = {}
        for name in dict.fromkeys(re.findall(r"\bt_\w+", text)):
            if hasattr(self, name) or name in SQL:
                frames[name] = self.table(name)
        for name in BASE:
            if re.search(rf"\b(from|join|,)\s+{name}\b", text):
                frames[name] = self.read(name)
        text = text.replace("{", "{{").replace("}", "}}")
        for name in frames:
            text = re.sub(rf"\b(from|join|,)(\s+){name}\b", rf"\1\2{{{name}}}", text)
        return self.spark.sql(text, **frames) if frames else self.spark.sql(text.replace("{{", "{").replace("}}", "}"))

    def table(self, name: str) -> DataFrame:
        if name in SQL:
            cached = self.__dict__.setdefault("_plain", {})
            if name not in cached:
                cached[name] = self.sql(SQL[name])
            return cached[name]
        return getattr(self, name)

    # --- the index ---

    @cached_property
    def t_postings(self) -> DataFrame:
        from ..operators.index import postings

        return materialise(postings(self.table("t_pages")), "postings")

    @cached_property
    def t_terms(self) -> DataFrame:
        return materialise(self.t_postings.groupBy("term").agg(F.count("*").alias("df")), "terms")

    @cached_property
    def t_docstats(self) -> DataFrame:
        from ..operators.index import doc_stats

        return materialise(doc_stats(self.table("t_pages"), self.t_postings), "docstats")

    @cached_property
    def t_corpus(self) -> DataFrame:
        return self.t_docstats.agg(F.count("*").alias("total_docs"), F.avg("doc_length").alias("avg_doc_length"))

    @cached_property
    def t_qterms(self) -> DataFrame:
        from ..operators.index import query_terms

        return materialise(query_terms(self.table("t_queries")), "qterms")

    @cached_property
    def t_bm25(self) -> DataFrame:
        from ..operators.rank import bm25f

        return materialise(bm25f(self.t_qterms, self.t_postings, self.t_terms, self.t_docstats, self.t_corpus), "bm25")

    @cached_property
    def t_edges(self) -> DataFrame:
        from ..operators.rank import edges

        return materialise(edges(self.table("t_links"), self.table("t_pages")), "edges")

    @cached_property
    def t_pagerank(self) -> DataFrame:
        from ..operators.rank import pagerank

        return materialise(pagerank(self.table("t_pages").select("page_id"), self.t_edges), "pagerank")

    @cached_property
    def t_tok(self) -> DataFrame:
        pages = self.table("t_pages")
        both = pages.select("page_id", F.lit("title").alias("field"), tokens("title").alias("ws")).union(pages.select("page_id", F.lit("body"), tokens("body_text")))
        return both.select("page_id", "field", F.explode("ws").alias("w0"))

    @cached_property
    def t_stems(self) -> DataFrame:
        return stemmed(self.t_tok.select(F.col("w0").alias("word")).distinct(), "word", "term").withColumnsRenamed({"word": "w0", "term": "w"})
