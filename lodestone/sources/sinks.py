"""Tables that are appended to: the query log, snapshots of statistics, a crawl's queue and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "query string, results_count bigint, time_ms double, created_at timestamp"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What has been appended; nothing where nothing has been."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def log_queries(results: DataFrame, queries: DataFrame, time_ms: float, path: str) -> None:
    """Appends a batch of searches: each query with the number of its results and its share of the batch's time."""
    n = max(1, queries.count())
    counts = results.groupBy("qid").agg(F.max("total_results").alias("n"))
    rows = queries.join(counts, "qid", "left").select("query", F.coalesce("n", F.lit(0)).cast("bigint").alias("results_count"), F.lit(float(time_ms) / n).alias("time_ms"), F.current_timestamp().alias("created_at"))
    append(rows, path)


def snapshot(pages: DataFrame, terms: DataFrame, postings: DataFrame, chunks: DataFrame, lengths: DataFrame, log: DataFrame, now) -> DataFrame:
    """One row of eight statistics at a time (a Column or a text)."""
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    count = lambda df, name, c="*": df.agg(F.count(c).alias(name))
    recent = log.where(F.col("created_at") > at - F.expr("interval 24 hours")).agg(F.round(F.coalesce(F.avg("time_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"))
    parts = [
        count(pages, "pages_crawled"), count(terms, "terms_indexed"), count(postings, "postings_count"), count(chunks, "chunks_count"), count(chunks, "chunks_embedded", "embedding"),
        lengths.agg(F.round(F.coalesce(F.avg("doc_length"), F.lit(0.0)), 1).alias("avg_doc_length")), count(log, "queries_total"), recent,
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    return row.withColumn("snapshot_at", at)
