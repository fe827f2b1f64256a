"""Operators over texts: snippets, chunks, spelling, explain tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions.fixed import STOPWORDS
from ..functions.text import sentences, stemmed

SPACE = r"(?U)\s+"
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n|\.\s{2,}"), re.compile(r"(?<=[.!?])\s+")


def snippets(hits: DataFrame, terms: DataFrame, length: int = 250) -> DataFrame:
    """qid, page_id, snippet. hits: qid, page_id, body_text; terms: qid, term.

    The sentence of the first 3000 characters with most words whose stems are query terms, the first three with a bonus of
    a half, the first of equals; a short one takes the next along. Meant for result pages, so after their limit.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("body_text", r"\[\d+\]", ""), r"\[edit\]", ""), SPACE, " "))
    split = hits.select("qid", "page_id", sentences(F.substring(clean, 1, 3000)).alias("ss")).where(F.length(F.element_at("ss", 1)) > 0)
    words = split.select("qid", "page_id", F.posexplode("ss").alias("i", "s")).select("qid", "page_id", "i", F.explode(F.split(F.lower("s"), SPACE)).alias("word")).where("word <> ''")
    found = stemmed(words, "word", "term").join(terms.select("qid", "term").distinct(), ["qid", "term"]).groupBy("qid", "page_id", "i").agg(F.count("*").alias("n"))
    scored = found.withColumn("score", F.col("n") + F.when(F.col("i") < 3, 0.5).otherwise(0.0))
    best = scored.groupBy("qid", "page_id").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("i"))
    chosen = split.join(best, ["qid", "page_id"], "left").withColumn("i", F.coalesce("i", F.lit(0)))
    own, after = F.trim(F.get("ss", F.col("i"))), F.trim(F.get("ss", F.col("i") + 1))
    return chosen.select("qid", "page_id", F.substring(F.when((F.length(own) < 100) & after.isNotNull(), F.concat(own, F.lit(" "), after)).otherwise(own), 1, length).alias("snippet"))


def chunk_texts(text: str, limit: int = RETRIEVAL.chunk_words, least: int = RETRIEVAL.min_chunk_words) -> list[str]:
    """Greedy packing of paragraphs, and of the sentences of paragraphs that are too long, into chunks of about `limit` words."""
    units: list[list[str]] = []
    for paragraph in PARAGRAPH.split(text):
        words = paragraph.split()
        units += [words] if len(words) <= limit else [s.split() for s in SENTENCE.split(paragraph.strip())]
    chunks: list[list[str]] = []
    for unit in units:
        if chunks and len(chunks[-1]) + len(unit) <= limit:
            chunks[-1] += unit
        elif unit:
            chunks.append(list(unit))
    return [" ".join(c) for c in chunks if len(c) >= least]


def chunked(pages: DataFrame) -> DataFrame:
    """page_id, chunk_idx, content of every page's title and body. Packing is sequential per page, so one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [(p, i, c) for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, c in enumerate(chunk_texts(t or ""))]
                ids, index, content = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(content, pa.string())], ["page_id", "chunk_idx", "content"])

    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("body_text", F.lit("")))
    return pages.select(F.col("page_id").cast("bigint"), text.alias("text")).mapInArrow(run, "page_id bigint, chunk_idx int, content string")


def _deletions(word: Column, most: int) -> Column:
    """The first seven letters of a word with up to `most` of them left out, each result once."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, F.length(x))))
    found = level = F.array(F.substring(word, 1, 7))
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.length(x) > 0), without)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def nearest_words(words: DataFrame, vocab: DataFrame, most: int = 2) -> DataFrame:
    """word, candidate, distance for all pairs at most `most` edits apart. Two such words' beginnings become equal by leaving out
    at most that many letters of each, so an equi-join on what deletions leave finds them all; the distance is then computed."""
    spread = words.select("word", F.explode(_deletions(F.col("word"), most)).alias("left"))
    known = vocab.select(F.col("word").alias("candidate")).withColumn("left", F.explode(_deletions(F.col("candidate"), most)))
    near = F.abs(F.length("word") - F.length("candidate")) <= most
    met = spread.join(known, "left").where(near).select("word", "candidate").distinct()
    return met.withColumn("distance", F.levenshtein("word", "candidate", most)).where("distance >= 0")


def corrected(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """qid, query, corrected: null where nothing changes. Of equal distances the shorter, then the first word wins."""
    words = queries.select("qid", "query", F.posexplode(F.split(F.trim(F.lower("query")), SPACE)).alias("pos", "raw")).withColumn("word", F.regexp_replace("raw", "[^a-z]", ""))
    asked = words.where(F.length("word") >= 3).select("word").distinct()
    unknown = asked.join(vocab, "word", "left_anti")
    best = nearest_words(unknown, vocab).groupBy("word").agg(F.min(F.struct("distance", F.length("candidate").alias("size"), "candidate")).alias("b")).select("word", F.col("b.candidate").alias("best"))
    fixed = words.join(best, "word", "left").withColumn("out", F.coalesce("best", "raw"))
    rows = fixed.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("w"), F.count("best").alias("n"))
    return rows.select("qid", "query", F.when(F.col("n") > 0, F.array_join(F.transform("w", lambda x: x["out"]), " ")).alias("corrected"))


def explain_tokens(queries: DataFrame) -> DataFrame:
    """qid, pos, word, kept, term: the explain view's own rule, without seasons, numbers or an upper length."""
    cleaned = F.split(F.trim(F.regexp_replace(F.lower("query"), r"[^a-z0-9\s]", " ")), r"\s+")
    words = queries.select("qid", F.posexplode(cleaned).alias("pos", "word")).where("word <> ''")
    kept = words.withColumn("kept", ~F.col("word").isin(STOPWORDS) & (F.length("word") > 1))
    return stemmed(kept, "word", "term").select("qid", F.col("pos").cast("bigint").alias("pos"), "word", "kept", F.when(F.col("kept"), F.col("term")).alias("term"))


def best_nearest(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, candidate, distance: the nearest word of the vocabulary for each word."""
    order = Window.partitionBy("word").orderBy("distance", F.length("candidate"), "candidate")
    return nearest_words(words, vocab).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
