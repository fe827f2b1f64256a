"""A crawl as a state machine over tables: level by level, resumable, behind a transport that is plugged in.

States of a URL: pending, crawling, then crawled, skipped or failed. The queue is a table of events that is only appended to; a
URL's state is that of its last event, so a run that was stopped or lost goes on from what is written. What a lost run left
as crawling counts as pending.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CRAWL, Crawl
from ..functions.fixed import BAD_TITLES, REDIRECTS
from ..sources.sinks import append, stored
from ..storage import discard, materialise
from . import crawl as rules

#: A URL's status, content type and body; None: no answer.
Transport = Callable[[str], "tuple[int, str, str] | None"]
QUEUE = "url string, depth int, status string, step int"
PAGES = "url string, depth int, title string, body_text string, content_hash string, links array<string>"


def fetched(urls: DataFrame, transport: Transport, delay: float = CRAWL.delay_seconds) -> DataFrame:
    """url, depth, outcome (fetched, disallowed, unreachable, not_html), html. A host's URLs are fetched one after the other, with
    a delay between them, after its robots rules; hosts side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib import robotparser

        robots: dict[str, robotparser.RobotFileParser] = {}
        last: dict[str, float] = {}
        for batch in batches:
            out, html = [], []
            for url in batch.column(0).to_pylist():
                at = urlparse(url)
                if at.netloc not in robots:
                    robots[at.netloc] = robotparser.RobotFileParser()
                    got = transport(f"{at.scheme}://{at.netloc}/robots.txt")
                    robots[at.netloc].parse(got[2].splitlines() if got and got[0] == 200 else [])
                if not robots[at.netloc].can_fetch("*", url):
                    out.append("disallowed")
                    html.append(None)
                    continue
                time.sleep(max(0.0, last.get(at.netloc, 0.0) + delay - time.monotonic()))
                last[at.netloc] = time.monotonic()
                got = transport(url)
                good = bool(got) and got[0] < 400
                out.append("fetched" if good and "text/html" in got[1] else "not_html" if good else "unreachable")
                html.append(got[2] if out[-1] == "fetched" else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(html, pa.string())], ["url", "depth", "outcome", "html"])

    by_host = urls.select("url", "depth").withColumn("host", rules.netloc(F.col("url"))).repartition("host").sortWithinPartitions("host", "url")
    return by_host.select("url", "depth").mapInArrow(run, "url string, depth int, outcome string, html string")


def states(queue: DataFrame) -> DataFrame:
    """url, depth, status of every URL."""
    return queue.groupBy("url").agg(F.min("depth").alias("depth"), F.max_by("status", "step").alias("status"))


def status_counts(queue: DataFrame) -> DataFrame:
    return states(queue).groupBy("status").agg(F.count("*").alias("n"))


def good_pages(parsed: DataFrame, known: DataFrame, p: Crawl = CRAWL) -> DataFrame:
    """parsed with `kept`: enough words, a title that is none of the bad ones, no redirect notice, and the first of its content."""
    words = F.size(F.filter(F.split(F.trim("body_text"), r"\s+"), lambda w: w != ""))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("url")) == 1
    seen = known.select("content_hash").distinct().withColumn("seen", F.lit(True))
    good = (words >= p.min_words) & (F.trim("title") != "") & ~F.lower(F.trim("title")).isin(list(BAD_TITLES)) & ~F.lower(F.substring("body_text", 1, 1000)).rlike(f"({'|'.join(REDIRECTS)})")
    return parsed.withColumn("first", first).join(seen, "content_hash", "left").withColumn("kept", good & F.col("first") & F.col("seen").isNull()).drop("first", "seen")


def seed(spark: SparkSession, folder: str, urls: list[str], clear: bool = False) -> None:
    """Puts new URLs into the queue at depth 0; `clear` first skips all that is pending."""
    queue = stored(spark, f"{folder}/queue", QUEUE)
    if clear:
        append(states(queue).where("status = 'pending'").select("url", "depth", F.lit("skipped").alias("status"), F.lit(2).alias("step")), f"{folder}/queue")
        queue = stored(spark, f"{folder}/queue", QUEUE)
    rows = spark.createDataFrame([(u, 0, "pending", 0) for u in dict.fromkeys(urls)], QUEUE)
    append(rows.join(queue.select("url").distinct(), "url", "left_anti").select("url", "depth", "status", "step"), f"{folder}/queue")


def run(spark: SparkSession, folder: str, transport: Transport, restrict: bool = True, delay: float = CRAWL.delay_seconds, per_round: int = 500,
        stop: Callable[[], bool] = lambda: False, progress: Callable[..., None] = lambda **event: None, p: Crawl = CRAWL) -> DataFrame:
    """Crawls what the queue in `folder` holds until nothing is pending, max_pages are kept or `stop`; returns the pages."""
    done = stored(spark, f"{folder}/pages", PAGES).count()
    while done < p.max_pages and not stop():
        queue = stored(spark, f"{folder}/queue", QUEUE)
        front = states(queue).where("status in ('pending', 'crawling')").orderBy("depth", "url").limit(min(per_round, p.max_pages - done))
        front = materialise(front.select("url", "depth"), "front")
        if front.limit(1).count() == 0:
            break
        mark = lambda rows, status, step: append(rows.select("url", "depth", F.lit(status).alias("status"), F.lit(step).alias("step")), f"{folder}/queue")
        mark(front, "crawling", 1)
        got = materialise(fetched(front, transport, delay), "fetched")
        parsed = rules.parsed_pages(got.where("outcome = 'fetched'").select(F.xxhash64("url").alias("page_id"), "url", "html"))
        parsed = parsed.join(front, "url").select("url", "depth", "title", "body_text", "content_hash", "links")
        judged = materialise(good_pages(parsed, stored(spark, f"{folder}/pages", PAGES), p), "judged")
        kept = judged.where("kept").select("url", "depth", "title", "body_text", "content_hash", "links")
        append(kept, f"{folder}/pages")
        found = judged.where(F.col("depth") < p.max_depth).select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth")).groupBy("url").agg(F.min("depth").alias("depth"))
        found = found.where(rules.in_scope(F.col("url"), F.col("depth"), restrict)).join(queue.select("url").distinct(), "url", "left_anti")
        mark(materialise(found, "found"), "pending", 0)
        mark(kept, "crawled", 2)
        mark(judged.where("not kept"), "skipped", 2)
        mark(got.where("outcome in ('disallowed', 'not_html')"), "skipped", 2)
        mark(got.where("outcome = 'unreachable'"), "failed", 2)
        done += kept.count()
        progress(type="progress", pages=done)
        discard(front, got, judged)
    return stored(spark, f"{folder}/pages", PAGES)
