"""Crawl side: scope, frontier, robots rules, HTML."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib import robotparser
from urllib.parse import urldefrag, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CRAWL
from ..functions.fixed import ALLOWED_DOMAINS, ALLOWED_PATHS, BLOCKED_DOMAINS, BOILERPLATE, MAIN, STRIPPED_TAGS, TOPIC_WORDS, TRAILING
from ..storage import materialise


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def in_scope(url: Column, depth: Column, restrict: bool = True) -> Column:
    """Blocked hosts never; unrestricted, all others; else allowed hosts, the encyclopaedia by depth and topic, others by path."""
    host, at = netloc(url), path(url)
    topical = F.lit(False)
    for word in TOPIC_WORDS:
        topical = topical | F.lower(at).contains(word)
    allowed = F.lit(False)
    for part in ALLOWED_PATHS:
        allowed = allowed | at.contains(part)
    return (
        F.when(host.isin(BLOCKED_DOMAINS), False).when(F.lit(not restrict), True).when(~host.isin(ALLOWED_DOMAINS), False)
        .when(host == "en.wikipedia.org", at.contains("/wiki/") & ((depth <= 1) | topical)).otherwise(allowed)
    )


def levels(seeds: DataFrame, edges: DataFrame, max_depth: int = CRAWL.max_depth) -> DataFrame:
    """page_id, depth reached from seeds along edges (s, t): a round per level; what was seen goes out by an anti-join."""
    seen = materialise(seeds.select("page_id", F.lit(0).alias("depth")).distinct(), "frontier")
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front["page_id"] == edges["s"]).select(F.col("t").alias("page_id")).distinct()
        front = materialise(found.join(seen, "page_id", "left_anti").select("page_id", F.lit(depth).alias("depth")), "frontier")
        seen = seen.unionByName(front)
    return seen


def robots_allowed(urls: DataFrame, agent: str = "*") -> DataFrame:
    """url, allowed from (url, robots): a null robots text allows all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers: dict[str, robotparser.RobotFileParser] = {}
        for batch in batches:
            out = []
            for url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    out.append(True)
                    continue
                if text not in parsers:
                    parsers[text] = robotparser.RobotFileParser()
                    parsers[text].parse(text.splitlines())
                out.append(parsers[text].can_fetch(agent, url))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], ["url", "allowed"])

    return urls.select("url", "robots").mapInArrow(run, "url string, allowed boolean")


# --- HTML -------------------------------------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def _walk(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        now = stack.pop()
        yield now
        stack += [p for p in reversed(now.parts) if isinstance(p, _Node)]


def _strip(root: _Node, noisy) -> None:
    """Removes noisy elements with all in them and the text that follows them up to the next element."""
    for node in list(_walk(root)):
        kept, dropping = [], False
        for part in node.parts:
            if isinstance(part, _Node):
                dropping = noisy(part)
                if not dropping:
                    kept.append(part)
            elif not dropping:
                kept.append(part)
        node.parts = kept


def _text(node: _Node) -> str:
    out, stack = [], [node]
    while stack:
        now = stack.pop()
        if isinstance(now, str):
            out.append(now)
        else:
            stack += reversed(now.parts)
    return "".join(out)


def clean_text(text: str) -> str:
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"(?i)\[edit\]", "", re.sub(r"\[\d+\]", "", text))
    text = re.sub(r"\s+", " ", text).strip()
    for mark in TRAILING:
        at = text.find(mark)
        if at > 500:
            return text[:at].strip()
    return text


def parse_html(url: str, html: str) -> dict:
    """title, body_text, links (sorted), content_hash of a page."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    title = next((_text(n).strip() for n in _walk(root) if n.tag == "title" and _text(n)), "")
    _strip(root, lambda n: n.tag in STRIPPED_TAGS)

    def boilerplate(n: _Node) -> bool:
        marks = " ".join(n.attrs.get(k, "") for k in ("class", "id", "role")).lower()
        return any(p in marks for p in BOILERPLATE)

    _strip(root, boilerplate)
    host, main = urlparse(url).netloc, root
    for only, tag, key, value, whole in MAIN:
        if only in (None, host):
            hit = next((n for n in _walk(root) if n.tag == tag and (key is None or (n.attrs.get(key) == value if whole else value in n.attrs.get(key, "")))), None)
            if hit:
                main = hit
                break
    links = set()
    for n in _walk(root):
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if href and not href.startswith(("#", "javascript:", "mailto:", "tel:")):
            target = urldefrag(urljoin(url, href))[0]
            if urlparse(target).scheme in ("http", "https"):
                links.add(target)
    body = clean_text(_text(main))
    return {"title": title, "body_text": body, "links": sorted(links), "content_hash": hashlib.md5(body.encode()).hexdigest()}


def parsed_pages(raw: DataFrame) -> DataFrame:
    """page_id, url, title, body_text, links, content_hash from (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [parse_html(u or "", h or "") for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                kinds = {"title": pa.string(), "body_text": pa.string(), "links": pa.list_(pa.string()), "content_hash": pa.string()}
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([g[c] for g in got], t) for c, t in kinds.items())], ["page_id", "url", *kinds])

    return raw.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, title string, body_text string, links array<string>, content_hash string")
