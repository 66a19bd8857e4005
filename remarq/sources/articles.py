"""Articles and other context around a match: metadata, paragraphs and images of stored pages."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_PARAGRAPH, MOST_BODY, MOST_SUMMARY, MOST_TITLE, MOST_IMAGES, MOST_URLS, MOST_MANUAL = 24, 1800, 2400, 300, 6, 6, 3000
SKIPPED_IMAGES = ("avatar", "logo", "icon", ".gif")
TIME_KEYS = ("article:published_time", "publishdate", "pubdate")
# Titles of items that no article gave.
MANUAL_TITLE, FAILED_TITLE = "用户提供的比赛背景", "新闻上下文读取失败"
# End of fixed values.
SCHEMA = "url string, title string, summary string, published string, image_urls array<string>, status string, error string"


def public_url(url: str) -> bool:
    """Whether an address may be fetched: http(s), a public host by name, or a global IP."""
    parts = urlsplit(url or "")
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith((".local", ".localhost")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return "." in host


class _Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title = ""
        self.title_at: tuple[tuple[int, int], int] | None = None
        self.title_ends: tuple[int, int] | None = None
        self.paragraphs: list[str] = []
        self.images: list[str] = []
        self.inside: list[str] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            self.meta.setdefault(key, a.get("content", "").strip())
        elif tag == "img":
            if any(t in ("article", "main", "content") for t in self.inside):
                self.images.append(a.get("src") or a.get("data-src") or "")
        else:
            if tag == "p":
                self._end_paragraph()
                self.text = []
            elif tag == "title":
                self.text = []
                self.title_at = self.title_at or (self.getpos(), len(self.get_starttag_text()))
            name = "content" if tag == "div" and "content" in a.get("class", "").split() else tag
            if name in ("article", "main", "content", "div"):
                self.inside.append(name)

    def handle_endtag(self, tag):
        if tag == "title" and self.title_at:
            self.title_ends = self.title_ends or self.getpos()
        if tag == "p":
            self._end_paragraph()
        elif tag == "title" and self.text is not None:
            self.title, self.text = self.title or " ".join("".join(self.text).split()), None
        elif tag in ("article", "main", "div") and self.inside:
            self._end_paragraph()
            self.inside.pop()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def _end_paragraph(self):
        if self.text is not None:
            self.paragraphs.append(" ".join("".join(self.text).split()))
            self.text = None


def _place(html: str, at: tuple[int, int]) -> int:
    """Where a parser's line (from 1) and column are in the text."""
    start = 0
    for _ in range(at[0] - 1):
        start = html.index("\n", start) + 1
    return start + at[1]


def _title_written(page: _Article, html: str) -> str:
    """The first title element's text as the page has it, character references undecoded."""
    if not page.title_at or not page.title_ends:
        return ""
    return html[_place(html, page.title_at[0]) + page.title_at[1] : _place(html, page.title_ends)]


def parse_article(html: str, url: str) -> dict:
    page = _Article()
    page.feed(html or "")
    page.close()
    page._end_paragraph()
    title = (page.meta.get("og:title") or page.meta.get("title") or page.title)[:MOST_TITLE]
    kept: list[str] = []
    for p in dict.fromkeys(page.paragraphs):
        if len(p) >= LEAST_PARAGRAPH and sum(map(len, kept)) < MOST_BODY:
            kept.append(p)
    description = page.meta.get("description") or page.meta.get("og:description") or ""
    summary = "\n".join(x for x in (description, "\n".join(kept)[:MOST_BODY]) if x)[:MOST_SUMMARY]
    images = [urljoin(url, i) for i in (page.meta.get("og:image", ""), *page.images) if i]
    images = [i for i in dict.fromkeys(images) if i.startswith(("http://", "https://")) and not any(s in i.lower() for s in SKIPPED_IMAGES)][:MOST_IMAGES]
    published = next((page.meta[k] for k in TIME_KEYS if page.meta.get(k)), "")
    return {"url": url, "title": title, "summary": summary, "published": published, "image_urls": images, "status": "fetched", "error": "", "title_written": None if html is None else _title_written(page, html)}


def articles(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A row per page; one that fails, or whose address is not public, is a row with status ``error``. ``title`` is decoded and may come from metadata; ``title_written`` is the
    title element's text as it stands in the page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for address, body in zip(part["url"], part["html"], strict=True):
                try:
                    if not public_url(address):
                        raise ValueError("address is not public")
                    rows.append(parse_article(body, address))
                except Exception as e:  # noqa: BLE001  one page's failure is a row
                    rows.append({"url": address, "title": FAILED_TITLE, "summary": str(e)[:300], "published": "", "image_urls": [], "status": "error", "error": str(e)[:300], "title_written": ""})
            yield pd.DataFrame(rows, columns=["url", "title", "summary", "published", "image_urls", "status", "error", "title_written"])

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, SCHEMA + ", title_written string")


def manual(spark: SparkSession, note: str) -> DataFrame:
    """A note given by hand as a context item."""
    rows = [("", MANUAL_TITLE, note.strip()[:MOST_MANUAL], "", [], "provided", "")] if note.strip() else []
    return spark.createDataFrame(rows, SCHEMA)


def fetched(spark: SparkSession, urls: list[str], fetch: Callable[[str], str]) -> DataFrame:
    """Articles of the first distinct addresses through a given fetch function; one that fails is a row with status ``error``."""
    pages, failed = [], []
    for url in list(dict.fromkeys(urls))[:MOST_URLS]:
        try:
            pages.append((url, fetch(url) if public_url(url) else ""))
        except Exception as e:  # noqa: BLE001  whatever the function throws
            failed.append((url, FAILED_TITLE, str(e)[:300], "", [], "error", str(e)[:300]))
    return articles(spark.createDataFrame(pages, "url string, html string")).drop("title_written").unionByName(spark.createDataFrame(failed, SCHEMA))


def context(spark: SparkSession, note: str, urls: list[str], fetch: Callable[[str], str] | None = None) -> DataFrame:
    """A run's context items in order: the note, then the articles. Without a fetch function addresses are errors."""

    def none(url: str) -> str:
        raise ValueError("no way to fetch was given")

    parts = [manual(spark, note).withColumn("part", F.lit(0)), fetched(spark, urls, fetch or none).withColumn("part", F.lit(1))]
    order = F.create_map(*(F.lit(x) for i, u in enumerate(dict.fromkeys(urls)) for x in (u, i))) if urls else None
    place = F.coalesce(F.try_element_at(order, F.col("url")), F.lit(0)) if order is not None else F.lit(0)
    whole = parts[0].unionByName(parts[1])
    return whole.withColumns({"seq": F.col("part") * 1000 + place, "source_url": F.col("url")}).drop("part")
