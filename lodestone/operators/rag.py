"""Retrieval for grounded answers: vectors, fan-out, fusion, context, embedding and model plug-ins."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL, Retrieval
from ..storage import materialise

Embedder = Callable[[list[str]], "list[list[float]] | None"]


#: Vectors to a block of chunks and of queries, and cells of the join for each shuffle partition at most.
CHUNKS, ASKED, CELLS = 4096, 256, 8


def _blocks(vectors: DataFrame, ids: list[str], size: int) -> DataFrame:
    """dim, ids (arrays), vectors (unit length, packed doubles): rows in blocks by dimension. Null vectors take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(len(ids))).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                for k in range(0, len(rows), size):
                    part = pa.array(rows[k : k + size])
                    x = batch.column(len(ids)).take(part).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([batch.column(i).take(part).to_pylist()], pa.list_(pa.int64())) for i in range(len(ids))), pa.array([unit.tobytes()], pa.binary())], ["dim", *ids, "vectors"])

    rows = vectors.where("embedding is not null").select(*(F.col(c).cast("bigint") for c in ids), "embedding")
    return rows.mapInArrow(run, "dim int, " + ", ".join(f"{c} array<bigint>" for c in ids) + ", vectors binary")


def similarities(queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
    """The ids of queries (all columns but embedding), chunk_id, page_id, sim: cosine of every query vector with every embedded
    chunk, or with the `top` best of each block of chunks. Blocks of chunks and blocks of queries meet once each, by an equi-join
    on a cell, whatever the number of either; a zero vector is like nothing (0)."""
    names = [c for c in queries.columns if c != "embedding"]
    stored = materialise(_blocks(chunks, ["chunk_id", "page_id"], CHUNKS), "chunk-blocks")
    cells = max(1, min(stored.count(), CELLS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    asked = _blocks(queries, names, ASKED).withColumnRenamed("vectors", "asked").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))))
    met = stored.withColumn("cell", F.pmod(F.xxhash64(F.element_at("chunk_id", 1)), F.lit(cells))).join(asked, ["cell", "dim"]).select("dim", "chunk_id", "page_id", "vectors", "asked", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column(0)[k].as_py()
                chunk, page = (np.array(batch.column(i)[k].as_py(), np.int64) for i in (1, 2))
                own, other = (np.frombuffer(batch.column(i)[k].as_buffer()).reshape(-1, dim) for i in (3, 4))
                sims = other @ own.T
                if top is not None and top < len(chunk):
                    order = np.array([np.lexsort((chunk, -np.round(s, 9)))[:top] for s in sims])
                else:
                    order = np.broadcast_to(np.arange(len(chunk)), sims.shape)
                of = np.repeat(np.arange(len(sims)), order.shape[1])
                at = order.ravel()
                ids = [pa.array(np.array(batch.column(5 + i)[k].as_py(), np.int64)[of]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(chunk[at]), pa.array(page[at]), pa.array(sims[of, at])], [*names, "chunk_id", "page_id", "sim"])

    return met.mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", chunk_id bigint, page_id bigint, sim double")


def vector_search(queries: DataFrame, chunks: DataFrame, top: int = RETRIEVAL.vector_top) -> DataFrame:
    """The best chunks of each query vector, with their rank rn: exact."""
    names = [c for c in queries.columns if c != "embedding"]
    order = Window.partitionBy(*names).orderBy(F.desc(F.round("sim", 9)), "chunk_id")
    return similarities(queries, chunks, top).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)


def approximate_search(queries: DataFrame, chunks: DataFrame, top: int = RETRIEVAL.vector_top, bits: int = 8, tables: int = 6, seed: int = 3) -> DataFrame:
    """As vector_search over an approximate index: chunks lie in buckets by the signs of random projections, in several tables; a
    query looks into its bucket of each and those one bit away. Candidates get exact similarities."""
    names = [c for c in queries.columns if c != "embedding"]

    def keyed(vectors: DataFrame, ids: list[str], near: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = pc.list_value_length(batch.column(len(ids))).to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths[lengths > 0]).tolist():
                    rows = np.flatnonzero(lengths == dim)
                    x = batch.column(len(ids)).take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                    planes = np.random.default_rng(seed + dim).standard_normal((tables, bits, dim))
                    code = ((np.einsum("tbd,nd->ntb", planes, x) > 0) << np.arange(bits)).sum(axis=2)
                    flips = np.r_[0, 1 << np.arange(bits)] if near else np.zeros(1, np.int64)
                    keys = (np.arange(tables)[None, :, None] << 32 | (code[:, :, None] ^ flips)).reshape(len(rows), -1)
                    of = pa.array(np.repeat(rows, keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(ids) + 1)), pa.array(keys.ravel(), pa.int64())], [*ids, "embedding", "key"])

        rows = vectors.where("embedding is not null").select(*(F.col(c).cast("bigint") for c in ids), F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ids) + ", embedding array<double>, key bigint")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    stored = keyed(chunks, ["chunk_id", "page_id"], False).withColumnRenamed("embedding", "own")
    met = keyed(queries, names, True).join(stored, "key").where(F.size("own") == F.size("embedding")).dropDuplicates([*names, "chunk_id"])
    norm = F.sqrt(dot("own", "own") * dot("embedding", "embedding"))
    scored = met.select(*names, "chunk_id", "page_id", F.when(norm > 0, dot("own", "embedding") / norm).otherwise(0.0).alias("sim"))
    order = Window.partitionBy(*names).orderBy(F.desc(F.round("sim", 9)), "chunk_id")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)


def hybrid(vectors: DataFrame, keyword: DataFrame, chunks: DataFrame, p: Retrieval = RETRIEVAL) -> DataFrame:
    """qid, chunk_id, page_id, vector_score, keyword_score, combined, rn: best chunk per page, top_k pages.

    vectors: qid, chunk_id, page_id, sim (top lists of each query's fan-out); keyword: qid, page_id, score (all matches)."""
    best = vectors.groupBy("qid", "chunk_id", "page_id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "page_id")
    pages = keyword.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= p.keyword_pages)
    words = pages.join(chunks.select("chunk_id", "page_id"), "page_id").select("qid", "chunk_id", F.col("page_id").alias("kp"), "score")
    both = best.join(words, ["qid", "chunk_id"], "full").withColumn("page_id", F.coalesce("page_id", "kp"))
    # a query has some tens of rows from here on
    over = Window.partitionBy("qid")
    spread = lambda c: F.when(F.max(c).over(over) != F.min(c).over(over), F.max(c).over(over) - F.min(c).over(over)).otherwise(1.0)
    score = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise((F.col(c) - F.min(c).over(over)) / spread(c))
    scored = both.select("qid", "chunk_id", "page_id", score("sim").alias("vector_score"), score("score").alias("keyword_score"))
    scored = scored.withColumn("combined", p.vector_share * F.col("vector_score") + p.keyword_share * F.col("keyword_score"))
    in_page = Window.partitionBy("qid", "page_id").orderBy(F.desc(F.round("combined", 9)), "chunk_id")
    one = scored.withColumn("nth", F.row_number().over(in_page)).where("nth = 1")
    slot = Window.partitionBy("qid").orderBy(F.desc(F.round("combined", 9)), "chunk_id")
    return one.withColumn("rn", F.row_number().over(slot)).where(F.col("rn") <= p.top_k).drop("nth")


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """The offline default: signed hashes of words, unit length."""
    v = [0.0] * dim
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embedded(chunks: DataFrame, embed: Embedder | None = None, p: Retrieval = RETRIEVAL) -> DataFrame:
    """chunk_id, embedding for chunks without one: batches of 50, the first 1500 characters; a failed batch stays null."""
    embed = embed or (lambda batch: [hashed_embedding(t) for t in batch])
    size = p.embed_batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                got = embed([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got or [None] * part.num_rows, pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    todo = chunks.where("embedding is null").select(F.col("chunk_id").cast("bigint"), F.substring("content", 1, p.embed_chars).alias("content"))
    return todo.mapInArrow(run, "chunk_id bigint, embedding array<float>")


def context(hits: DataFrame, p: Retrieval = RETRIEVAL, top: int = 5) -> DataFrame:
    """qid, context from (qid, rn, title, content): numbered blocks of the first results, as a model's prompt takes them."""
    block = F.concat(F.lit("\n\n["), F.col("rn").cast("string"), F.lit("] "), F.col("title"), F.lit(":\n"), F.substring("content", 1, p.context_chars))
    rows = hits.where(F.col("rn") <= top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rn", block.alias("b")))).alias("bs"))
    return rows.select("qid", F.array_join(F.transform("bs", lambda x: x["b"]), "").alias("context"))


def answered(contexts: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """qid, answer. The offline default answers with the first words of each block and its citation."""

    def extract(text: str) -> str:
        blocks = [b for b in (text or "").split("\n\n[") if b]
        return " ".join(f"{' '.join(b.partition(':' + chr(10))[2].split()[:12])} [{b.partition(']')[0]}]" for b in blocks)

    answer = model or extract

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([answer(t) for t in batch.column(1).to_pylist()], pa.string())], ["qid", "answer"])

    return contexts.select(F.col("qid").cast("bigint"), "context").mapInArrow(run, "qid bigint, answer string")


def frames(answers: DataFrame) -> DataFrame:
    """qid, seq, frame: an answer as a stream's event frames: sources, one token a frame, done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for qid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                events = [{"type": "sources"}, *({"type": "token", "content": w} for w in (text or "").split()), {"type": "done"}]
                rows += [(qid, i, f"data: {json.dumps(e)}\n\n") for i, e in enumerate(events)]
            ids, seq, out = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seq, pa.int32()), pa.array(out, pa.string())], ["qid", "seq", "frame"])

    return answers.select(F.col("qid").cast("bigint"), "answer").mapInArrow(run, "qid bigint, seq int, frame string")


def fan_out(queries: DataFrame, hits: DataFrame, postings: DataFrame, terms: DataFrame, p: Retrieval = RETRIEVAL) -> DataFrame:
    """qid, vid, query: each request's own sub-queries: as asked, with the first two, and with the first four of the terms that
    its best pages share and it doesn't name. hits: qid, page_id, score; terms: qid, term."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "page_id")
    best = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= p.keyword_pages).select("qid", "page_id")
    total = best.join(postings.select("page_id", "term", "term_freq"), "page_id").groupBy("qid", "term").agg(F.sum("term_freq").alias("total"))
    common = Window.partitionBy("qid").orderBy(F.desc("total"), "term")
    pool = total.withColumn("rn", F.row_number().over(common)).where(F.col("rn") <= p.related_pool)
    related = pool.join(terms.select("qid", "term").distinct(), ["qid", "term"], "left_anti").withColumn("rn", F.row_number().over(common)).where(F.col("rn") <= p.related)
    words = related.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]).alias("more"))
    with_more = queries.select("qid", "query").join(words, "qid", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    texts = F.array(*(F.struct(F.lit(i).cast("bigint").alias("vid"), F.concat_ws(" ", F.col("query"), F.slice("more", 1, n)).alias("query")) for i, n in enumerate((0, 2, 4), 1)))
    return with_more.select("qid", F.explode(F.when(F.size("more") > 0, texts).otherwise(F.slice(texts, 1, 1))).alias("s")).select("qid", "s.vid", "s.query")


def retrieved(queries: DataFrame, hits: DataFrame, postings: DataFrame, terms: DataFrame, chunks: DataFrame, embed: Embedder | None = None, p: Retrieval = RETRIEVAL) -> DataFrame:
    """The hybrid result of each request: its own sub-queries embedded, their best chunks joined with those of its keyword pages.
    chunks: chunk_id, page_id, content, embedding."""
    asked = materialise(fan_out(queries, hits, postings, terms, p), "fan-out").withColumn("chunk_id", F.xxhash64("qid", "vid"))
    vectors = embedded(asked.select("chunk_id", F.col("query").alias("content"), F.lit(None).cast("array<float>").alias("embedding")), embed, p)
    own = asked.join(vectors, "chunk_id").select("qid", "vid", "embedding")
    return hybrid(vector_search(own, chunks, p.vector_top).select("qid", "chunk_id", "page_id", "sim"), hits, chunks, p)


def chat_queries(messages: DataFrame) -> DataFrame:
    """qid (the conversation), query: the latest question, with the first before it unless that says it already."""
    asked = messages.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("latest"))
    alone = (F.col("n") == 1) | F.lower("latest").contains(F.lower("first"))
    return asked.select(F.col("conv_id").alias("qid"), F.when(alone, F.col("latest")).otherwise(F.concat_ws(" ", "first", "latest")).alias("query"))
