"""Control of crawl, index, embedding and refresh jobs, and of crawl schedules: driver functions over tables in a folder."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .config import CRAWL, Crawl
from .jobs import Job, Jobs, top_pages
from .operators import frontier, rag
from .operators.text import chunked
from .sources.sinks import stored
from .storage import materialise

STRATEGIES = ("seed", "top_pagerank")


@dataclass(frozen=True)
class Schedule:
    id: int
    strategy: str
    seed_urls: tuple[str, ...]
    interval_hours: int
    next_run_at: dt.datetime
    max_pages: int = CRAWL.max_pages
    max_depth: int = CRAWL.max_depth
    enabled: bool = True
    last_run_at: dt.datetime | None = None


class Control:
    """One engine's jobs. `transport` fetches pages, `embed` embeds texts; both are plugged in."""

    def __init__(self, spark: SparkSession, folder: str, transport: frontier.Transport, embed: rag.Embedder | None = None, restrict: bool = True, delay: float = CRAWL.delay_seconds):
        self.spark, self.folder, self.transport, self.embed, self.restrict, self.delay = spark, folder, transport, embed, restrict, delay
        self.jobs = Jobs()
        self.index: api.Index | None = None
        self.chunks: DataFrame | None = None
        self._schedules: dict[int, Schedule] = {}

    # --- jobs ---

    def pages(self) -> DataFrame:
        """The crawled pages as the index takes them."""
        rows = stored(self.spark, f"{self.folder}/pages", frontier.PAGES)
        return rows.select(F.xxhash64("url").alias("page_id"), "url", "title", "body_text", "content_hash", F.current_timestamp().alias("crawled_at"), F.lit(None).cast("timestamp").alias("last_checked_at"), F.lit(False).alias("is_dead"))

    def links(self) -> DataFrame:
        rows = stored(self.spark, f"{self.folder}/pages", frontier.PAGES)
        return rows.select(F.xxhash64("url").alias("source_id"), F.explode("links").alias("target_url")).distinct()

    def _crawl(self, p: Crawl):
        def work(job: Job) -> None:
            frontier.run(self.spark, self.folder, self.transport, self.restrict, self.delay, stop=job.stopping.is_set, progress=lambda **e: self.jobs.emit(job, **e), p=p)

        return work

    def crawl(self, urls: list[str], clear: bool = False, max_pages: int = CRAWL.max_pages, max_depth: int = CRAWL.max_depth) -> Job:
        """Seeds the queue and crawls it; with no URLs, goes on with what is pending."""
        if any(j["kind"] == "crawl" and j["state"] == "running" for j in self.jobs.all()):
            raise RuntimeError("a job of kind crawl is running")
        frontier.seed(self.spark, self.folder, urls, clear)
        return self.jobs.start("crawl", self._crawl(replace(CRAWL, max_pages=max_pages, max_depth=max_depth)))

    def rebuild_index(self) -> Job:
        def work(job: Job) -> None:
            self.index = api.build(materialise(self.pages(), "pages"), self.links())
            self.jobs.emit(job, type="progress", postings=self.index.postings.count())

        return self.jobs.start("index", work)

    def rebuild_embeddings(self) -> Job:
        def work(job: Job) -> None:
            rows = materialise(chunked(self.pages()).withColumn("chunk_id", F.xxhash64("page_id", "chunk_idx")).withColumn("embedding", F.lit(None).cast("array<float>")), "chunks")
            self.chunks = materialise(rows.drop("embedding").join(rag.embedded(rows, self.embed), "chunk_id"), "embedded")
            self.jobs.emit(job, type="progress", chunks=self.chunks.count())

        return self.jobs.start("embed", work)

    def refresh(self, n: int = 100) -> Job:
        """Fetches the pages of highest rank again; their outcomes are the job's last event."""
        if self.index is None:
            raise RuntimeError("no index yet")
        rows = top_pages(self.index.ranks, self.index.pages, n).select("url", F.lit(0).alias("depth"))

        def work(job: Job) -> None:
            got = frontier.fetched(rows, self.transport, self.delay).groupBy("outcome").agg(F.count("*").alias("n"))
            self.jobs.emit(job, type="progress", **{r.outcome: r.n for r in got.collect()})  # four outcomes at most

        return self.jobs.start("refresh", work)

    def stop(self, job_id: str) -> None:
        self.jobs.stop(job_id)

    # --- schedules ---

    def create_schedule(self, strategy: str, interval_hours: int, now: dt.datetime, seed_urls: tuple[str, ...] = (), **limits: int) -> Schedule:
        if strategy not in STRATEGIES or interval_hours < 1:
            raise ValueError(f"a strategy of {STRATEGIES} and an interval of an hour or more")
        made = Schedule(max(self._schedules, default=0) + 1, strategy, tuple(seed_urls), interval_hours, now + dt.timedelta(hours=interval_hours), **limits)
        self._schedules[made.id] = made
        return made

    def schedules(self) -> list[dict]:
        return [asdict(s) for s in self._schedules.values()]

    def toggle_schedule(self, schedule_id: int) -> Schedule:
        self._schedules[schedule_id] = replace(self._schedules[schedule_id], enabled=not self._schedules[schedule_id].enabled)
        return self._schedules[schedule_id]

    def delete_schedule(self, schedule_id: int) -> None:
        del self._schedules[schedule_id]

    def run_due(self, now: dt.datetime) -> list[Job]:
        """Starts what is due, one after the other, and moves it on by its interval."""
        started = []
        for s in [s for s in self._schedules.values() if s.enabled and s.next_run_at <= now]:
            job = self.crawl(list(s.seed_urls), max_pages=s.max_pages, max_depth=s.max_depth) if s.strategy == "seed" else self.refresh(s.max_pages)
            job.finished.wait()
            self._schedules[s.id] = replace(s, last_run_at=now, next_run_at=now + dt.timedelta(hours=s.interval_hours))
            started.append(job)
        return started
