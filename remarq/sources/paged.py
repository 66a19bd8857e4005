"""Stored forum pages as a data source: threads are read page by page, and only as far as their share asks.

Pages lie in bundles: a file of pages one after the other, and beside it a file that says where each thread's pages begin. Tasks write bundles in parallel; a manifest (a Parquet
table) names those that count. ``spark.read.format("stored_threads").option("path", manifest)`` gives a row per page read, one task a bundle. ``share`` ends a thread when its pages hold as many
visible posts (what is counted here is never more than what parsing keeps, so none is missed), the page total that a page states ends it too; filters on thread and page are applied before pages
are read. As a stream the source gives the pages of bundles that were added to the manifest since the offset, which is the number of its bundles in order of arrival.

Defined cases: a page without the embedded JSON holds no posts and states no total; threads without pages are not there; rows of equal thread and page follow each other; null
pages count as empty; an empty manifest gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from ..storage import fresh_folder, open_fs
from .threads import PAGE_SIZE

NAME = "stored_threads"
SCHEMA = "thread_id string, page int, url string, html string"
_SCRIPT = re.compile(r'<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', re.S)
_SIGN = re.compile(r"[^\s ]")


def write_pages(pages: DataFrame, folder: str | None = None, bundles: int | None = None) -> str:
    """Pages ``thread_id, page, url, html`` to bundles in a folder; gives back the manifest's URI. A thread's pages lie in one bundle, in order. Adding to a folder appends to its manifest."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "stored-threads")
    n = bundles or 2 * spark.sparkContext.defaultParallelism

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = open_fs(f"{folder}/bundles")
        files.create_dir(path, recursive=True)
        name, at, index = uuid.uuid4().hex, 0, []
        with files.open_output_stream(f"{path}/{name}.pages") as out:
            for part in parts:
                for row in part.itertuples(index=False):
                    body = (row.html or "").encode()
                    out.write(body)
                    index.append((row.thread_id, int(row.page), row.url, at, len(body)))
                    at += len(body)
        if index:
            with files.open_output_stream(f"{path}/{name}.index") as out:
                out.write("\n".join(map(json.dumps, index)).encode())
            yield pd.DataFrame({"bundle": [f"{folder}/bundles/{name}"], "n_pages": [len(index)]})
        else:
            files.delete_file(f"{path}/{name}.pages")

    wanted = pages.select(F.col("thread_id").cast("string").alias("thread_id"), F.col("page").cast("int").alias("page"), F.col("url").cast("string").alias("url"), "html").where("thread_id is not null and page is not null")
    dealt = wanted.repartition(n, "thread_id").sortWithinPartitions("thread_id", "page")
    # the manifest is written by one job: a task that ran twice is in it once, and what its other attempt wrote is never read
    dealt.mapInPandas(run, "bundle string, n_pages long").withColumn("added", F.current_timestamp()).write.mode("append").parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def visible_posts(html: str) -> tuple[set[str], int | None]:
    """Ids of a page's posts that are surely shown, and the number of pages that it states."""
    found = _SCRIPT.search(html)
    try:
        detail = json.loads(found[1])["props"]["pageProps"]["detail"] if found else {}
        replies = detail.get("replies") or {}
        posts = [p for p in (*(replies.get("list") or ()), *(detail.get("lights") or ())) if isinstance(p, dict)]
        total = -(-int(float(replies.get("total") or 0)) // max(1, int(float(replies.get("size") or PAGE_SIZE))))
    except (ValueError, KeyError, TypeError, AttributeError):
        return set(), None

    def shown(p: dict) -> bool:
        hidden = any(str(p.get(k)).lower() in ("true", "1") for k in ("isDelete", "isSelfDelete", "isHidden"))
        return not hidden and bool(_SIGN.search(re.sub("<[^>]+>|&nbsp;", " ", str(p.get("content") or ""))))

    return {str(p.get("pid")) for p in posts if shown(p)}, total or None


@dataclass
class _Bundle(InputPartition):
    uri: str
    threads: frozenset[str] | None = None
    last: int | None = None
    share: int | None = None


def read_bundle(part: _Bundle) -> Iterator[tuple[str, int, str, str]]:
    """Pages of a bundle's threads, each thread until its share or its last page."""
    files, path = open_fs(part.uri)
    with files.open_input_stream(f"{path}.index") as f:
        rows = [json.loads(x) for x in f.read().decode().split("\n")]
    of: dict[str, list] = defaultdict(list)
    for thread, page, url, at, size in rows:
        if (part.threads is None or thread in part.threads) and (part.last is None or page <= part.last):
            of[thread].append((page, url, at, size))
    with files.open_input_file(f"{path}.pages") as pages:
        for thread, own in of.items():
            seen: set[str] = set()
            for page, url, at, size in own:
                pages.seek(at)
                html = pages.read(size).decode()
                yield thread, page, url, html
                shown, total = visible_posts(html)
                seen |= shown
                if (part.share is not None and len(seen) >= part.share) or (total and page >= total):
                    break


def _manifest(uri: str) -> list[str]:
    files, path = open_fs(uri)
    table = pads.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=False).to_table(columns=["bundle", "added"])
    return [r["bundle"] for r in sorted(table.to_pylist(), key=lambda r: (r["added"], r["bundle"]))]


def _share(options: dict) -> int | None:
    return int(options["share"]) if options.get("share") else None


@dataclass
class _Wanted:
    """What filters leave."""

    threads: frozenset[str] | None = None
    last: int | None = None
    taken: list[Filter] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        if isinstance(f, EqualTo | In) and f.attribute == ("thread_id",):
            own = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.threads = own if self.threads is None else self.threads & own
        elif isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("page",):
            last = f.value - isinstance(f, LessThan)
            self.last = last if self.last is None else min(self.last, last)
        else:
            return False
        return True


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.share, self.wanted = options["path"], _share(options), _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.wanted.take(f))

    def partitions(self) -> list[InputPartition]:
        return [_Bundle(b, self.wanted.threads, self.wanted.last, self.share) for b in _manifest(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None:
            yield from read_bundle(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.share = options["path"], _share(options)

    def initialOffset(self) -> dict:
        return {"bundles": 0}

    def latestOffset(self) -> dict:
        return {"bundles": len(_manifest(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Bundle(b, share=self.share) for b in _manifest(self.path)[start["bundles"] : end["bundles"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_bundle(partition)


class StoredThreads(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def stored_threads(spark: SparkSession, manifest: str, share: int | None = None) -> DataFrame:
    """The pages of stored threads; filters on ``thread_id`` and ``page`` reach the reader."""
    spark.dataSource.register(StoredThreads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format(NAME).option("path", manifest)
    return (source.option("share", share) if share else source).load()


def streamed_threads(spark: SparkSession, manifest: str, share: int | None = None) -> DataFrame:
    spark.dataSource.register(StoredThreads)
    source = spark.readStream.format(NAME).option("path", manifest)
    return (source.option("share", share) if share else source).load()
