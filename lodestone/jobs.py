"""Jobs on the driver: one of a kind at a time, progress events, cooperative stop, schedules that are due."""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .config import AS_OF


@dataclass
class Job:
    """A job's id, kind, state (running, done, stopped, failed) and events; work checks `stopping` between its steps."""

    kind: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])
    state: str = "running"
    events: list[dict] = field(default_factory=list)
    stopping: threading.Event = field(default_factory=threading.Event)
    finished: threading.Event = field(default_factory=threading.Event)
    error: str = ""


class Jobs:
    def __init__(self):
        self._lock = threading.Lock()
        self._jobs: dict[str, Job] = {}
        self._listeners: list[Callable[[Job, dict], None]] = []

    def subscribe(self, listener: Callable[[Job, dict], None]) -> None:
        self._listeners.append(listener)

    def emit(self, job: Job, **event) -> None:
        job.events.append(event)
        for listener in self._listeners:
            listener(job, event)

    def start(self, kind: str, work: Callable[[Job], None]) -> Job:
        """Starts work in a thread; while one of its kind runs, another is refused."""
        with self._lock:
            if any(j.kind == kind and j.state == "running" for j in self._jobs.values()):
                raise RuntimeError(f"a job of kind {kind} is running")
            job = Job(kind)
            self._jobs[job.id] = job

        def run() -> None:
            try:
                work(job)
                job.state = "stopped" if job.stopping.is_set() else "done"
            except Exception as e:  # the job's own failure is its result
                job.state, job.error = "failed", str(e)
            finally:
                self.emit(job, type=job.state)
                job.finished.set()

        threading.Thread(target=run, daemon=True).start()
        return job

    def stop(self, job_id: str) -> None:
        self._jobs[job_id].stopping.set()

    def all(self) -> list[dict]:
        return [{"id": j.id, "kind": j.kind, "state": j.state, "error": j.error} for j in self._jobs.values()]


class Progress(StreamingQueryListener):
    """Gathers rows per micro-batch of streaming queries by their id."""

    def __init__(self):
        self.rows: dict[str, list[int]] = defaultdict(list)

    def onQueryStarted(self, event):
        self.rows[str(event.id)] = []

    def onQueryProgress(self, event):
        self.rows[str(event.progress.id)].append(event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def due(schedules: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Enabled schedules (id, strategy, interval_hours, enabled, next_run_at) whose time has come, with the next one after."""
    now = F.lit(as_of).cast("timestamp")
    ready = schedules.where(F.col("enabled") & (F.col("next_run_at") <= now))
    return ready.withColumn("next_run_after", now + F.make_dt_interval(hours=F.col("interval_hours").cast("int")))


def top_pages(ranks: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """What a refresh of the n pages of highest rank visits."""
    return ranks.join(pages.select("page_id", "url"), "page_id").orderBy(F.desc(F.round("score", 12)), "page_id").limit(n)
