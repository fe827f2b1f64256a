"""Inverted index: postings, document and corpus statistics, query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import indexed, stemmed, tokens, words

#: Parts that one term's postings are dealt to.
SALTS = 16


def postings(pages: DataFrame) -> DataFrame:
    """page_id, term, term_freq, title_freq, body_freq. Pages: page_id, title, body_text.

    Fields are exploded together and words counted before they are stemmed. Postings come out dealt by term, a common term's in
    SALTS parts, and sorted by it, so that a scan for some terms skips what it doesn't need.
    """
    both = F.array(F.struct(F.lit(True).alias("title"), words("title").alias("ws")), F.struct(F.lit(False).alias("title"), words("body_text").alias("ws")))
    found = pages.select("page_id", F.explode(both).alias("f")).select("page_id", F.col("f.title").alias("in_title"), F.explode("f.ws").alias("word")).where(indexed(F.col("word")))
    counted = found.groupBy("page_id", "word").agg(F.count("*").alias("n"), F.count_if("in_title").alias("t"))
    terms = stemmed(counted, "word", "term").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).repartition("term", "salt")
    summed = terms.groupBy("page_id", "term", "salt").agg(F.sum("n").alias("term_freq"), F.sum("t").alias("title_freq"), F.sum(F.col("n") - F.col("t")).alias("body_freq"))
    return summed.drop("salt").sortWithinPartitions("term", "page_id")


def doc_stats(pages: DataFrame, index: DataFrame) -> DataFrame:
    """page_id, doc_length for every page, those without terms at 0."""
    lengths = index.groupBy("page_id").agg(F.sum("term_freq").alias("doc_length"))
    return pages.select("page_id").join(lengths, "page_id", "left").select("page_id", F.coalesce("doc_length", F.lit(0)).cast("bigint").alias("doc_length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, pos (from 1), term: repeated terms stay."""
    words = queries.select("qid", F.posexplode(tokens("query")).alias("pos", "word"))
    return stemmed(words, "word", "term").select("qid", (F.col("pos") + 1).alias("pos"), "term")


def without_pages(table: DataFrame, gone: DataFrame) -> DataFrame:
    """An index table without the rows of some pages."""
    return table.join(gone.select("page_id"), "page_id", "left_anti")


def reindex(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Postings after a batch of pages came in: old rows of these pages go, new ones come."""
    return without_pages(index, batch).unionByName(postings(batch))
