"""Streams over the event log: windows with watermarks, failure runs, and the index kept up page by page."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CRAWL
from ..operators.index import postings, without_pages
from ..storage import materialise, shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote to the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def closed_windows(events: DataFrame, *window: str, delay: str = "1 day") -> DataFrame:
    """Counts and means by window and event type; a window comes out once the watermark has passed it."""
    w = F.window("ts", *window)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def closed_sessions(events: DataFrame, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("stop"), "n")


def failure_runs(events: DataFrame) -> DataFrame:
    """page_id, run, dead after each batch: failures in a row, kept as state per page."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, longest = state.get if state.exists else (0, 0)
        for failed in pd.concat(list(parts)).sort_values(["ts", "event_id"])["failed"]:
            run = run + 1 if failed else 0
            longest = max(longest, run)
        state.update((run, longest))
        yield pd.DataFrame({"page_id": [key[0]], "longest_run": [longest], "dead": [longest >= CRAWL.max_failures]})

    rows = events.select(F.col("user_id").alias("page_id"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("page_id").applyInPandasWithState(step, "page_id bigint, longest_run bigint, dead boolean", "run bigint, longest bigint", "append", GroupStateTimeout.NoTimeout)


class LiveIndex:
    """Postings and document lengths that take pages batch by batch; a page that comes again replaces its rows.

    A batch writes its own postings and page ids only. What stands is the base without the pages of later batches, and each
    batch without those of later ones; every COMPACT batches this is written as the new base."""

    COMPACT = 8

    def __init__(self, spark: SparkSession, index: DataFrame | None = None):
        empty = spark.createDataFrame([], "page_id bigint, term string, term_freq bigint, title_freq bigint, body_freq bigint")
        self.base = index if index is not None else empty
        self.deltas: list[tuple[DataFrame, DataFrame | None]] = []

    @property
    def postings(self) -> DataFrame:
        gone, found = None, []
        for pages, rows in reversed([(None, self.base), *self.deltas]):
            if rows is not None:
                found.append(rows if gone is None else without_pages(rows, gone))
            if pages is not None:
                gone = pages if gone is None else gone.union(pages)
        out = found[0]
        for rows in found[1:]:
            out = out.unionByName(rows)
        return out

    def _add(self, pages: DataFrame, rows: DataFrame | None) -> None:
        self.deltas.append((materialise(pages.select("page_id").distinct(), "live-pages"), None if rows is None else materialise(rows, "live")))
        if len(self.deltas) >= self.COMPACT:
            self.base, self.deltas = materialise(self.postings, "live-base"), []

    def take(self, batch: DataFrame, epoch: int = 0) -> None:
        self._add(batch, postings(batch))

    def follow(self, stream: DataFrame) -> None:
        """Takes all that a stream of pages (page_id, title, body_text) has, micro-batch by micro-batch."""
        base = f"{shared_dir(stream.sparkSession)}/follow-{uuid.uuid4().hex}"
        stream.writeStream.foreachBatch(self.take).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()

    def drop(self, pages: DataFrame) -> None:
        self._add(pages, None)

    def lengths(self) -> DataFrame:
        """page_id, doc_length: pages without terms have no row here and are not counted."""
        return self.postings.groupBy("page_id").agg(F.sum("term_freq").alias("doc_length"))

    def corpus(self) -> DataFrame:
        return self.lengths().agg(F.count("*").alias("total_docs"), F.avg("doc_length").alias("avg_doc_length"))
