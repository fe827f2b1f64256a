"""Jobs, progress and schedules."""

import threading

import pytest

from lodestone.jobs import Jobs, Progress, due, top_pages
from lodestone.streaming import events as streams


def test_single_flight_and_stop():
    jobs, seen, go = Jobs(), [], threading.Event()
    jobs.subscribe(lambda job, event: seen.append((job.kind, event["type"])))

    def work(job):
        for i in range(1000):
            jobs.emit(job, type="progress", done=i)
            go.set()
            if job.stopping.wait(0.05):
                return

    job = jobs.start("crawl", work)
    with pytest.raises(RuntimeError):
        jobs.start("crawl", work)
    other = jobs.start("index", lambda j: 1 / 0)
    go.wait(5)
    jobs.stop(job.id)
    assert job.finished.wait(5) and other.finished.wait(5)
    assert job.state == "stopped" and other.state == "failed" and ("crawl", "progress") in seen
    assert {j["state"] for j in jobs.all()} == {"stopped", "failed"}


def test_progress(spark, small):
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        streams.drained(streams.closed_windows(streams.event_stream(spark, small), "6 hours"), "progress")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(sum(r) for r in listener.rows.values()) in (0, 1000)


def test_due(spark):
    rows = spark.sql("select * from values (1, 'seed', 168, true, timestamp '2024-01-30 00:00:00'), (2, 'seed', 24, false, timestamp '2024-01-01 00:00:00'), (3, 'top_pagerank', 24, true, timestamp '2024-02-01 00:00:00') t(id, strategy, interval_hours, enabled, next_run_at)")
    got = due(rows).collect()
    assert [(r.id, str(r.next_run_after)) for r in got] == [(1, "2024-02-07 00:00:00")]


def test_top_pages(spark):
    ranks = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.5)], "page_id bigint, score double")
    pages = spark.createDataFrame([(i, f"u{i}") for i in (1, 2, 3)], "page_id bigint, url string")
    assert [r.url for r in top_pages(ranks, pages, 2).collect()] == ["u2", "u3"]


def page(title, words, *links):
    body = " ".join(f"word{i}" for i in range(words))
    return f"<html><head><title>{title}</title></head><body><main>{title} {body} {''.join(f'<a href={x!r}>x</a>' for x in links)}</main></body></html>"


WEB = {
    "https://a.org/": (200, "text/html", page("Home", 120, "/one", "/two", "/private/x", "https://b.org/", "/file")),
    "https://a.org/one": (200, "text/html; charset=utf-8", page("One", 130, "/", "/deep")),
    "https://a.org/two": (200, "text/html", page("Two", 20)),
    "https://a.org/deep": (200, "text/html", page("Deep", 140, "/deeper")),
    "https://a.org/deeper": (200, "text/html", page("Deeper", 150)),
    "https://a.org/private/x": (200, "text/html", page("Secret", 200)),
    "https://a.org/file": (200, "application/pdf", "%PDF"),
    "https://a.org/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /private"),
    "https://b.org/": (200, "text/html", page("Home", 120, "/one", "/two", "/private/x", "https://b.org/", "/file")),
}


def offline(url):
    return WEB.get(url)


def test_crawl_states(spark, tmp_path):
    """The queue's states, the gate, robots, content types, depth, and going on after a stop."""
    import dataclasses

    from lodestone.config import CRAWL
    from lodestone.operators import frontier

    folder, p = str(tmp_path), dataclasses.replace(CRAWL, max_depth=2)
    frontier.seed(spark, folder, ["https://a.org/", "https://a.org/"])
    rounds = []
    frontier.run(spark, folder, offline, restrict=False, delay=0.0, stop=lambda: len(rounds) > 0, progress=lambda **e: rounds.append(e), p=p)
    queue = lambda: {r.url: (r.depth, r.status) for r in frontier.states(frontier.stored(spark, f"{folder}/queue", frontier.QUEUE)).collect()}
    assert rounds == [{"type": "progress", "pages": 1}] and queue()["https://a.org/one"] == (1, "pending")
    pages = frontier.run(spark, folder, offline, restrict=False, delay=0.0, p=p)
    assert queue() == {
        "https://a.org/": (0, "crawled"), "https://a.org/one": (1, "crawled"), "https://a.org/two": (1, "skipped"), "https://a.org/private/x": (1, "skipped"),
        "https://a.org/file": (1, "skipped"), "https://b.org/": (1, "skipped"), "https://a.org/deep": (2, "crawled"), "https://b.org/one": (2, "failed"), "https://b.org/two": (2, "failed"),
        "https://b.org/private/x": (2, "failed"), "https://b.org/file": (2, "failed"),
    }
    assert sorted(r.title for r in pages.collect()) == ["Deep", "Home", "One"]
    frontier.seed(spark, folder, ["https://c.org/"])
    frontier.seed(spark, folder, ["https://d.org/"], clear=True)
    assert queue()["https://c.org/"] == (0, "skipped") and queue()["https://d.org/"] == (0, "pending")


def test_control(spark, tmp_path):
    import datetime as dt

    from lodestone import api
    from lodestone.control import Control

    control = Control(spark, str(tmp_path), offline, restrict=False, delay=0.0)
    job = control.crawl(["https://a.org/"], max_depth=2)
    assert job.finished.wait(120) and job.state == "done", job.error
    for job in (control.rebuild_index(), control.rebuild_embeddings()):
        assert job.finished.wait(120) and job.state == "done", job.error
    assert control.index.pages.count() == 3 and control.chunks.where("embedding is not null").count() >= 3
    asked = spark.createDataFrame([(1, "word5 home"), (2, "nothing")], "qid bigint, query string")
    answers = {r.qid: r.answer for r in api.overview(control.index, asked, control.chunks).collect()}
    assert set(answers) == {1} and "[1]" in answers[1]
    talk = spark.createDataFrame([(7, 0, "user", "word5"), (7, 1, "assistant", "yes"), (7, 2, "user", "and word9"), (8, 0, "user", "zzz")], "conv_id bigint, turn bigint, role string, text string")
    said = {r.conv_id: (r.query, r.answer) for r in api.chat(control.index, talk, control.chunks).collect()}
    assert said[7][0] == "word5 and word9" and "[1]" in said[7][1] and said[8] == ("zzz", None)
    now = dt.datetime(2024, 1, 1)
    made = control.create_schedule("top_pagerank", 24, now, max_pages=2)
    control.create_schedule("seed", 48, now, ("https://a.org/",))
    assert control.run_due(now) == []
    assert not control.toggle_schedule(2).enabled
    (job,) = control.run_due(now + dt.timedelta(hours=50))
    assert job.events[0] == {"type": "progress", "fetched": 2} and control.schedules()[0]["last_run_at"] == now + dt.timedelta(hours=50)
    control.delete_schedule(made.id)
    assert [s["id"] for s in control.schedules()] == [2]
    with pytest.raises(ValueError):
        control.create_schedule("never", 1, now)


def test_sinks(spark, tmp_path):
    from lodestone.sources import sinks

    log = str(tmp_path / "log")
    assert sinks.stored(spark, log, sinks.LOG).count() == 0
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "qid bigint, query string")
    results = spark.createDataFrame([(1, 30), (1, 30)], "qid bigint, total_results bigint")
    for _ in range(2):
        sinks.log_queries(results, queries, 10.0, log)
    rows = sinks.stored(spark, log, sinks.LOG)
    assert sorted((r.query, r.results_count, r.time_ms) for r in rows.collect()) == [("a", 30, 5.0)] * 2 + [("b", 0, 5.0)] * 2
    one = spark.createDataFrame([(1, None)], "page_id bigint, embedding array<float>")
    shot = sinks.snapshot(one, one, one, one, spark.createDataFrame([(2,)], "doc_length bigint"), rows, "2999-01-01 00:00:00")
    sinks.append(shot, str(tmp_path / "shots"))
    got = spark.read.parquet(str(tmp_path / "shots")).first()
    assert (got.pages_crawled, got.chunks_embedded, got.avg_doc_length, got.queries_total, got.avg_latency_ms) == (1, 0, 2.0, 4, 0.0)
