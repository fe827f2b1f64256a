"""python -m lodestone build|query|pagerank|chunks|embed|overview SF_DIR [words of a query]
python -m lodestone crawl FOLDER PAGES.parquet URL...     crawls stored pages (url, html) as if they were the web"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from . import api
from .operators import frontier
from .operators.rag import embedded
from .operators.text import chunked
from .plans.retrieval import corpus
from .session import build_session


def stored_pages(path: str) -> frontier.Transport:
    """A transport that answers from a file of pages (url, html)."""
    import pyarrow.parquet as pq

    kept: dict[str, str] = {}

    def fetch(url: str) -> tuple[int, str, str] | None:
        if not kept:
            rows = pq.read_table(path, columns=["url", "html"])
            kept.update(zip(rows["url"].to_pylist(), rows["html"].to_pylist(), strict=True))
        return (200, "text/html", kept[url]) if url in kept else None

    return fetch


def main(args: list[str]) -> None:
    if len(args) < 2 or args[0] not in ("build", "query", "pagerank", "chunks", "embed", "overview", "crawl"):
        sys.exit(__doc__)
    spark = build_session("lodestone")
    if args[0] == "crawl":
        folder, source, *urls = args[1:]
        frontier.seed(spark, folder, urls)
        frontier.run(spark, folder, stored_pages(source), restrict=False, delay=0.0, progress=lambda **e: print(e)).select("url", "depth", "title").show(20, truncate=60)
        return
    tables = corpus(spark, args[1])
    pages = tables.table("t_pages")
    if args[0] == "chunks":
        chunked(pages).groupBy("page_id").count().show()
        return
    if args[0] == "embed":
        rows = chunked(pages).withColumn("chunk_id", F.xxhash64("page_id", "chunk_idx")).withColumn("embedding", F.lit(None).cast("array<float>"))
        embedded(rows).select(F.count("*").alias("chunks"), F.count("embedding").alias("embedded")).show()
        return
    index = api.build(pages, None if args[0] == "build" else tables.table("t_links"))
    if args[0] == "build":
        print(f"{index.terms.count()} terms, {index.postings.count()} postings")
    elif args[0] == "pagerank":
        index.ranks.orderBy(F.desc("score"), "page_id").show(20)
    else:
        asked = spark.createDataFrame([(1, " ".join(args[2:]))], "qid bigint, query string")
        if args[0] == "overview":
            api.overview(index, asked, tables.table("t_vchunks")).select("answer").show(truncate=False)
            return
        api.search(index, asked).orderBy("slot").select("slot", "url", "title", "final", "snippet").show(truncate=80)


if __name__ == "__main__":
    main(sys.argv[1:])
