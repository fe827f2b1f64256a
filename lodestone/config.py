"""Parameters of ranking, retrieval and crawling. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ranking:
    k1: float = 1.2
    b: float = 0.75
    title_weight: float = 4.0
    body_weight: float = 1.0
    alpha: float = 0.8
    damping: float = 0.85
    iterations: int = 20
    freshness_floor: float = 0.5
    freshness_decay: float = 0.02
    fresh_days: int = 7
    fresh_bonus: float = 1.15
    fresh_cap: float = 1.2
    rerank_top: int = 5
    rerank_cut: float = -8.0
    per_domain: int = 2
    per_page: int = 10


@dataclass(frozen=True)
class Retrieval:
    vector_top: int = 10
    keyword_pages: int = 10
    vector_share: float = 0.6
    keyword_share: float = 0.4
    top_k: int = 8
    chunk_words: int = 300
    min_chunk_words: int = 20
    related_pool: int = 50
    related: int = 8
    context_chars: int = 500
    embed_chars: int = 1500
    embed_batch: int = 50


@dataclass(frozen=True)
class Crawl:
    max_depth: int = 3
    max_pages: int = 3000
    delay_seconds: float = 1.5
    min_words: int = 100
    max_failures: int = 3


RANKING, RETRIEVAL, CRAWL = Ranking(), Retrieval(), Crawl()
#: The moment that stands for now in every time-dependent query.
AS_OF = "2024-01-31 00:00:00"
